"""Packing of tokenized documents into sequences: bulk-synchronous best fit.

Documents are cut into pieces of at most ``capacity`` ids; the pieces and the gaps left in open sequences
are two distributed tables.  Both are in order by size: sizes are whole numbers up to ``capacity``, so
a range of equal sizes is a class, and a row's place is its class and its rank in it.  In each round

* a sweep over the classes, the longest pieces first, matches runs of pieces with the gaps that are the
  smallest to hold them (their successors); a gap takes as many pieces of the run as it has room for;
* where more pieces want a class of gaps than it has, the lower ranks win; the others go on to the next
  larger gaps, wait for a gap that this round has changed, or open new sequences if there is none;
* every gap finds its own run by its rank, and is written anew with what is left of it.

Rounds are repeated until every piece has a place.  A gap takes one run a round, so there are as many rounds
as runs of different sizes in a sequence (a sequence of 2048 ids holds 63 different sizes at most).  Only
counts by class (at most ``capacity`` numbers) reach the driver, and only runs and moves (at most a few
for each class) are broadcast.  At the end pieces and gaps meet in one join on round, class and rank.

Ranks come from counts by class and cell, ``cells`` hashed parts of the rows, so a class that holds a third
of all rows is ranked by as many tasks as there are cells.

Null and empty texts are the end id alone.  Rows without an id keep a null id; repeated rows and ids are
packed row by row.  Only the id and the text are read, so further columns cannot clash.  An empty table
gives no rows.  A very long text is a piece shorter than ``capacity``, if it doesn't come out even, and
full ones after it, each a sequence of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, materialise, sliced
from .token_binary import AtomEncoder, ragged, texts_of

_encoders: dict[str, AtomEncoder] = {}
_PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """row, doc_id, piece, start, length and ids (little-endian, four bytes each) of every piece.

    ``row`` tells rows with equal ids apart.  Only documents longer than ``capacity`` are cut; all their
    pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = AtomEncoder(tokenizer_path)
        for batch in sliced(batches, chars=500_000):
            ids, counts = _encoders[tokenizer_path].encode(*texts_of(batch.column(1)))
            lens = counts + 1
            ends = np.cumsum(lens)
            ended = np.full(ends[-1], end_id, "<u4")
            keep = np.ones(len(ended), bool)
            keep[ends - 1] = False
            ended[keep] = ids
            n = -(-lens // capacity)
            doc, piece = np.repeat(np.arange(len(lens)), n), ragged(np.zeros(len(n), np.int64), n)
            first = lens - (n - 1) * capacity
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            bounds = np.append((ends - lens)[doc] + start, ends[-1]) * 4
            payload = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ended)])
            taken = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(taken), batch.column(0).take(taken), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), payload], ["row", "doc_id", "piece", "start", "length", "ids"])

    return id_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _PIECES)


class Sweep:
    """One round: which pieces (by length and rank) go to which gaps (by free space and rank).

    ``runs`` are (length, first piece, pieces, pieces a gap, free, first gap); ``moves`` are (free, first gap,
    gaps, new free, new first rank, touched) and cover all gaps, those that this round opens included.
    """

    def __init__(self, waiting: np.ndarray, placed: np.ndarray, gaps: np.ndarray):
        capacity = len(gaps) - 1
        self.runs: list[tuple[int, ...]] = []
        self.opened = 0
        untouched, used = gaps.copy(), np.zeros_like(gaps)  # gaps of each class that are left, that are taken
        changed = np.zeros_like(gaps)  # gaps of this round by their new free space, less what waits for them
        left = np.zeros_like(waiting)
        taken: list[tuple[int, int, int, int]] = []  # free, first gap, gaps, new free

        def take(length: int, pieces: int, each: int, free: int, count: int) -> None:
            self.runs.append((length, int(placed[length]), pieces, each, free, int(used[free])))
            taken.append((free, int(used[free]), count, free - min(each, pieces) * length))
            placed[length] += pieces
            used[free] += count
            untouched[free] -= count
            changed[taken[-1][3]] += count

        for length in np.flatnonzero(waiting)[::-1].tolist():
            pieces = int(waiting[length])
            while pieces:
                fit = np.flatnonzero(untouched[length:])
                if len(fit):
                    free = int(fit[0]) + length
                else:
                    fit = np.flatnonzero(changed[length:])
                    if len(fit):  # they wait; what they will leave of these gaps counts for shorter pieces
                        free = int(fit[0]) + length
                        each = free // length
                        count = min(int(changed[free]), -(-pieces // each))
                        own = min(pieces, count * each)
                        full = min(count, own // each)
                        changed[free] -= count
                        changed[free - each * length] += full
                        if count > full:
                            changed[free - (own - full * each) * length] += 1
                        left[length] += own
                        pieces -= own
                        continue
                    free = capacity
                    untouched[free] = -(-pieces // (capacity // length))
                    self.opened += int(untouched[free])
                each = free // length
                full = min(int(untouched[free]), pieces // each)
                if full:
                    take(length, full * each, each, free, full)
                    pieces -= full * each
                if pieces and untouched[free]:
                    take(length, pieces, each, free, 1)
                    pieces = 0
        self.waiting = left
        least = int(np.flatnonzero(left)[0]) if left.any() else capacity + 1
        self.gaps = np.zeros_like(gaps)
        self.moves: list[tuple[int, int, int, int, int, bool]] = []
        kept = [(int(free), int(used[free]), int(untouched[free]), int(free), False) for free in np.flatnonzero(untouched)]
        for free, first, count, now, touched in [(*x, True) for x in taken] + kept:
            self.moves.append((free, first, count, now if now >= least else -1, int(self.gaps[now]), touched))
            self.gaps[now] += count
        self.gaps[:least] = 0  # nothing that waits fits in


def _ranked(rows: DataFrame, cells: int) -> DataFrame:
    """Adds each row's ``rank`` among those of its length, from 0."""
    celled = rows.withColumn("cell", F.expr(f"pmod(xxhash64(row, piece), {cells})"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = celled.groupBy("length", "cell").agg(F.count("*").alias("n")).select("length", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row", "piece"))
    return celled.withColumn("own", own).join(starts, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("cell", "own", "before")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, cells: int = 4096) -> DataFrame:
    """The pieces with their sequence_id and their offset in it.

    Needs row, piece and length; further columns are carried along, so leave out what is large (ids are
    joined again by row and piece, see ``packed_sequences``).
    """
    spark = pieces.sparkSession
    rows = materialise(pieces, "pack-pieces")
    waiting, placed, gaps = (np.zeros(capacity + 1, np.int64) for _ in range(3))
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        waiting[r["length"]] = r["n"]
    runs: list[tuple[int, ...]] = []
    touched: list[DataFrame] = []
    held: DataFrame | None = None
    rounds = opened = 0
    while waiting.any():
        sweep = Sweep(waiting, placed, gaps)
        runs += [(rounds, *r) for r in sweep.runs]
        fresh = spark.range(opened, opened + sweep.opened).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("free"), (F.col("id") - opened).alias("rank"))
        moves = spark.createDataFrame(sweep.moves, "free int, first long, count long, now int, base long, touched boolean")
        there = fresh if held is None else held.unionByName(fresh)
        moved = there.join(F.broadcast(moves), "free").where("rank >= first AND rank < first + count")
        moved = materialise(moved.select("sequence_id", "free", "rank", "now", (F.col("base") + F.col("rank") - F.col("first")).alias("then"), "touched"), "pack-gaps")
        touched.append(moved.where("touched").select(F.lit(rounds).alias("round"), "free", F.col("rank").alias("gap"), "sequence_id"))
        held = moved.where("now >= 0").select("sequence_id", F.col("now").alias("free"), F.col("then").alias("rank"))
        waiting, gaps, opened, rounds = sweep.waiting, sweep.gaps, opened + sweep.opened, rounds + 1
    if not rounds:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    every = touched[0]
    for more in touched[1:]:
        every = every.unionByName(more)
    run = spark.createDataFrame(runs, "round int, length long, first long, count long, each long, free int, base long")
    at = F.col("rank") - F.col("first")
    found = _ranked(rows, cells).join(F.broadcast(run), "length").where("rank >= first AND rank < first + count")
    wanted = found.select(*rows.columns, "round", "free", (F.col("base") + F.floor(at / F.col("each"))).alias("gap"), (capacity - F.col("free") + at % F.col("each") * F.col("length")).alias("offset"))
    return wanted.join(every, ["round", "free", "gap"]).select(*rows.columns, "sequence_id", "offset")


def packed_sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence; no group is larger than the capacity."""
    own = packed.select("row", "piece", "sequence_id", "offset").join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    per = own.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"]))
    return per.select("sequence_id", ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")
