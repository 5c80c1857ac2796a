"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

Tokens are words (A-Z lower-cased) and one end for each text; the end is also the first word's
context.  The probability of a token is

    w2[b] * c(context, word) / c(context)  +  w1[b] * c(word) / N  +  w0[b] / (V + 1)

where b = floor(log2(c(context) + 1)) is the context's frequency bucket.  The weights of every
bucket are learned by expectation-maximisation on held-out counts: a fixed seventh of the
training texts is kept out of the estimates while the weights are learned, and counted in
afterwards.  V + 1 types (one unseen) share the uniform part, so the model sums to one.

The corpus is cut into blocks of one kind (estimated, tuned, scored only).  Each block sends its
distinct words and bigrams, as 64-bit hashes with counts, to ``fan`` hash ranges; a range adds them
up over all blocks and sends every block back the totals of what it asked for.  Where a range of all
blocks would be too large for one task, ``fan`` blocks at a time are first added up within a range,
and the sums go on to its ``fan`` parts, as deep as it takes; totals come back the same way.  So every
level has ``fan`` rows a block, whatever the size of the corpus, a frequent word is one entry of each
block, and memory is bounded by a block and by ``bucket_bytes``.  The depth follows the text bytes
that the blocks have counted.  Only the weights, their histogram of bounded size, N and V reach the driver.

The held-out histogram rounds each estimate to an eighth of a doubling, so the likelihoods that EM
sees are within 4.5 percent; scores themselves are computed from exact counts.  Counts, V and the base
score rest on 64-bit hashes: at V distinct words one clash is expected at about V = 4 billion.

Null and empty texts hold the end alone.  Texts without an id are scored, not learned from, and keep
a null id.  Without training texts all counts are 0 and every token has the one uniform share, so
scores are 0.  Repeated rows are scored, and counted, as often as they occur.  Only id and text are
read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, id_text, materialise, sliced

ESTIMATE, TUNE, SCORE = 0, 1, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = xxhash.xxh3_64_intdigest(b" end ")
_STEPS = 8  # histogram cells for each doubling of a probability


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them, by byte planes, compressed."""
    if not len(values):
        return b""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max()) < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    raw = np.ascontiguousarray(planes).tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


_BINARY = ("ids", "named", "lens", "words", "sequence")
_BLOCK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("size", pa.int64()), *((c, pa.binary()) for c in _BINARY)])
_BLOCK_DDL = "block long, kind int, size long, ids binary, named binary, lens binary, words binary, sequence binary"


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents as blocks of one kind: ids, token counts, sorted word hashes, word places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: dict[int, list] = {k: [[], [], [], 0, {b" ": 0}] for k in (ESTIMATE, TUNE, SCORE)}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal made
            ids, lens, parts, size, known = held[kind]
            hashes = np.fromiter((_END if w == b" " else xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = {
                "block": (TaskContext.get().partitionId() << 24) + made,
                "kind": kind,
                "size": size,
                "ids": np.array([x or 0 for x in ids], np.int64).tobytes(),
                "named": np.array([x is not None for x in ids], np.uint8).tobytes(),
                "lens": pack(np.array(lens, np.int64)),
                "words": pack_sorted(hashes[order]),
                "sequence": pack(place[np.concatenate(parts)]),
            }
            made += 1
            held[kind] = [[], [], [], 0, {b" ": 0}]
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in sliced(batches, chars=1_000_000):
            for doc, text, kind in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = held[kind]
                raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
                words, known = raw.split(), own[4]
                for w in set(words).difference(known):
                    known[w] = len(known)
                places = np.zeros(len(words) + 1, np.int32)
                places[:-1] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                own[0].append(doc)
                own[1].append(len(places))
                own[2].append(places)
                own[3] += len(raw) + 8
                if own[3] >= block_bytes:
                    yield flush(kind)
        for kind in held:
            if held[kind][0]:
                yield flush(kind)

    return docs.mapInArrow(run, _BLOCK_DDL)


class Block:
    """A block unpacked: places of words and contexts, and the distinct bigrams by hash."""

    def __init__(self, lens: bytes, words: bytes, sequence: bytes):
        self.lens = unpack(lens).astype(np.int64)
        self.words = unpack_sorted(words)
        self.word = unpack(sequence).astype(np.int64)
        starts = np.cumsum(self.lens) - self.lens
        end = self.word[starts[0] + self.lens[0] - 1]
        self.starts = starts
        self.context = np.concatenate(([end], self.word[:-1]))
        self.context[starts] = end

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct bigrams, their counts, and the place of each token's bigram."""
        n = len(self.words)
        distinct, inverse, counts = np.unique(self.context * n + self.word, return_inverse=True, return_counts=True)
        with np.errstate(over="ignore"):
            h = self.words[distinct // n] * np.uint64(0x9E3779B97F4A7C15) + (self.words[distinct % n] ^ np.uint64(0xD1B54A32D192ED03))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return h[order], counts[order], place[inverse]


_ASKED = ("words", "words_est", "words_tune", "pairs", "pairs_est", "pairs_tune")
_ENTRY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("tuned", pa.bool_()), *((c, pa.binary()) for c in _ASKED)])
_ENTRY_DDL = "block long, bucket long, tuned boolean, " + ", ".join(f"{c} binary" for c in _ASKED)
_GIVEN = ("words", "pairs", "words_est", "pairs_est")
_TOTAL = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in _GIVEN), *((c, pa.int64()) for c in ("n", "v", "n_est", "v_est"))])
_TOTAL_DDL = "block long, bucket long, words binary, pairs binary, words_est binary, pairs_est binary, n long, v long, n_est long, v_est long"


def _bits(fan: int) -> int:
    return fan.bit_length() - 1


def _parts(hashes: np.ndarray, level: int, fan: int) -> np.ndarray:
    """Bounds of the ``fan`` parts of sorted hashes that agree in all bits above this level."""
    part = (hashes >> np.uint64(64 - _bits(fan) * (level + 1))) & np.uint64(fan - 1)
    return np.searchsorted(part, np.arange(fan + 1, dtype=np.uint64))


def _dealt(block: int, bucket: int, level: int, fan: int, tuned: bool, what: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[dict]:
    """One entry for each part of a range that is asked for: hashes, estimated and tuned counts."""
    bounds = {w: _parts(x[0], level, fan) for w, x in what.items()}
    for k in range(fan):
        if any(b[k] < b[k + 1] for b in bounds.values()):
            row = {"block": block, "bucket": bucket * fan + k, "tuned": tuned}
            for w, (hashes, est, tune) in what.items():
                own = slice(bounds[w][k], bounds[w][k + 1])
                row |= {w: pack_sorted(hashes[own]), f"{w}_est": pack(est[own]) if est[own].any() else b"", f"{w}_tune": pack(tune[own]) if tune[own].any() else b""}
            yield row


def _entries(blocks: DataFrame, fan: int) -> DataFrame:
    """What each block asks of each hash range: hashes, and counts where the block is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row["lens"], row["words"], row["sequence"])
                pairs, n_pairs, _ = own.pairs()
                counts = {"words": (own.words, np.bincount(own.word, minlength=len(own.words))), "pairs": (pairs, n_pairs)}
                what = {w: (h, n * (row["kind"] == ESTIMATE), n * (row["kind"] == TUNE)) for w, (h, n) in counts.items()}
                yield pa.RecordBatch.from_pylist(list(_dealt(row["block"], 0, 0, fan, row["kind"] == TUNE, what)), _ENTRY)

    return blocks.select("block", "kind", "lens", "words", "sequence").mapInArrow(run, _ENTRY_DDL)


def _added(rows: list[dict], what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of entries, their summed counts, the place of each asked hash, and where each row's places end."""
    hashes = [unpack_sorted(r[what]) for r in rows]
    sizes = np.array([len(h) for h in hashes], np.int64)
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = []
    for c in ("est", "tune"):
        counts = np.concatenate([unpack(r[f"{what}_{c}"]).astype(np.int64) if r[f"{what}_{c}"] else np.zeros(n, np.int64) for r, n in zip(rows, sizes.tolist(), strict=True)])
        sums.append(np.bincount(place, counts, len(distinct)).astype(np.int64))
    return distinct, *sums, place, np.cumsum(sizes)


def _answers(rows: list[dict], what: str, total: np.ndarray, estimate: np.ndarray, place: np.ndarray, ends: np.ndarray, back: list[dict]) -> None:
    """Put each row's totals, in the order it asked, into its answer."""
    start = 0
    for r, e, out in zip(rows, ends.tolist(), back, strict=True):
        own = place[start:e]
        out |= {what: pack(total[own]), f"{what}_est": pack(estimate[own]) if r["tuned"] else b""}
        start = e


def _sum_bucket(rows: list[dict]) -> Iterator[dict]:
    """Totals of one hash range, for each entry in the order it asked; then N and V of the range."""
    back: list[dict] = [{"block": r["block"], "bucket": r["bucket"]} for r in rows]
    last = {"block": -1, "bucket": rows[0]["bucket"]}
    for what in ("words", "pairs"):
        _, est, tune, place, ends = _added(rows, what)
        _answers(rows, what, est + tune, est, place, ends, back)
        if what == "words":
            last |= {"n": int((est + tune).sum()), "v": int((est + tune > 0).sum()), "n_est": int(est.sum()), "v_est": int((est > 0).sum())}
    yield from back
    yield last


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows that follow each other with the same keys."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and any(rows[0][k] != row[k] for k in keys):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _totals(entries: DataFrame, n_blocks: int, level: int, depth: int, fan: int) -> DataFrame:
    """The answers to entries of ranges at this level; with them one row for each range that was summed."""
    if level + 1 == depth:

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _runs(batches, "bucket"):
                yield pa.RecordBatch.from_pylist(list(_sum_bucket(rows)), _TOTAL)

        return entries.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(total, _TOTAL_DDL)

    groups = -(-n_blocks // fan)
    entries = materialise(entries.withColumn("grp", F.expr(f"pmod(xxhash64(block), {groups})")), "entries", compression="zstd")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket", "grp"):
            what = {w: _added(rows, w)[:3] for w in ("words", "pairs")}
            yield pa.RecordBatch.from_pylist(list(_dealt(rows[0]["grp"], rows[0]["bucket"], level + 1, fan, any(r["tuned"] for r in rows), what)), _ENTRY)

    merged = entries.repartition("bucket", "grp").sortWithinPartitions("bucket", "grp", "block").mapInArrow(merge, _ENTRY_DDL)
    given = materialise(_totals(merged, groups, level + 1, depth, fan), "part-totals", compression="zstd")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket", "grp"):
            asked, answers = [r for r in rows if r["part"] < 0], [r for r in rows if r["part"] >= 0]
            back: list[dict] = [{"block": r["block"], "bucket": r["bucket"]} for r in asked]
            tuned = any(r["tuned"] for r in asked)
            for what in ("words", "pairs"):
                _, _, _, place, ends = _added(asked, what)
                total, estimate = (np.concatenate([unpack(r[c]).astype(np.int64) for r in answers]) for c in (what, f"{what}_est"))
                _answers(asked, what, total, estimate if tuned else total, place, ends, back)
            yield pa.RecordBatch.from_pylist(back, _TOTAL)

    columns = ["bucket", "grp", "block", "part", "tuned", *dict.fromkeys((*_ASKED, *_GIVEN))]
    # Totals of a part come back under its range; its number puts them in the order of hashes.
    answers = given.where("block >= 0").select(F.expr(f"bucket div {fan}").alias("bucket"), F.col("block").alias("grp"), F.expr("-1L").alias("block"), F.expr(f"cast(bucket % {fan} AS int)").alias("part"), F.lit(None).cast("boolean").alias("tuned"), *[F.col(c) if c in _GIVEN else F.lit(None).cast("binary").alias(c) for c in columns[5:]])
    asked = entries.withColumn("part", F.lit(-1)).select(*columns)
    both = asked.unionByName(answers).repartition("bucket", "grp").sortWithinPartitions("bucket", "grp", "part", "block")
    return both.mapInArrow(scatter, _TOTAL_DDL).unionByName(given.where("block < 0"))


def _meet(blocks: DataFrame, totals: DataFrame, est: bool) -> DataFrame:
    """Every block's row followed by its totals in the order of buckets, in one partition."""
    tail = "_est" if est else ""
    none = F.lit(None).cast("binary")
    left = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), *_BINARY, none.alias("cw"), none.alias("cp"))
    right = totals.select("block", "bucket", *[none.alias(c) for c in _BINARY], F.col(f"words{tail}").alias("cw"), F.col(f"pairs{tail}").alias("cp"))
    return left.unionByName(right).repartition("block").sortWithinPartitions("block", "bucket")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, block, c(word), c(context), c(context, word)) of each block, by token."""
    head: dict | None = None
    words: list[np.ndarray] = []
    pairs: list[np.ndarray] = []

    def done() -> tuple[dict, Block, np.ndarray, np.ndarray, np.ndarray]:
        own = Block(head["lens"], head["words"], head["sequence"])
        _, _, place = own.pairs()
        c1, c2 = np.concatenate(words).astype(np.float64), np.concatenate(pairs).astype(np.float64)
        return head, own, c1[own.word], c1[own.context], c2[place]

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                if head is not None:
                    yield done()
                head, words, pairs = row, [], []
            else:
                words.append(unpack(row["cw"]))
                pairs.append(unpack(row["cp"]))
    if head is not None:
        yield done()


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts + 1)).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    """The histogram cell of a probability; 1 for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1)) * _STEPS), 1).astype(np.int64)


def _held_out_histogram(met: DataFrame, n: int) -> DataFrame:
    """bucket, cell of the bigram estimate, cell of the unigram estimate -> held-out tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, c1, ch, c2 in _met(batches):
            key = np.stack([context_bucket(ch), _cell(c2 / np.maximum(ch, 1)), _cell(c1 / max(n, 1))], 1)
            cells, counts = np.unique(key, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(cells[:, k]) for k in range(3)), pa.array(counts.astype(np.int64))], ["b", "p2", "p1", "n"])

    return met.mapInArrow(run, "b long, p2 long, p1 long, n long").groupBy("b", "p2", "p1").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, v: int, rounds: int = 60, buckets: int = 64) -> np.ndarray:
    """EM over the held-out histogram (b, p2 cell, p1 cell, tokens) -> weights [bucket, (w2, w1, w0)].

    Buckets without held-out tokens take the weights of the next lower one that has some; a context
    that was never seen has no bigram part.
    """
    weights = np.tile([0.0, 0.7, 0.3], (buckets, 1))
    value = lambda c: np.where(c > 0, 0.0, 2.0 ** (c / _STEPS))
    last = weights[0]
    for b in range(buckets):
        own = cells[cells[:, 0] == b] if len(cells) else cells
        if len(own):
            p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1.0 / (v + 1))], 1)
            w = np.array([1e-9 if b == 0 else 1.0, 1.0, 1.0])
            w /= w.sum()
            for _ in range(rounds):
                part = p * w
                part *= (own[:, 3] / part.sum(1))[:, None]
                w = (part.sum(0) + 1e-3) / (part.sum() + 3e-3)
            if b == 0:
                w = np.array([0.0, w[1], w[2]]) / (w[1] + w[2])
            last = w
        weights[b] = last
    return weights


def _scores(met: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, c1, ch, c2 in _met(batches):
            w = weights[context_bucket(ch)]
            p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
            sums = [np.add.reduceat(x, own.starts) for x in ((c1 > 0).astype(np.int64), np.log10((c1 + 1) / (n + v + 1)), np.log10(p))]
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["named"], np.uint8) == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.lens), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return met.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, training: Column | None = None, block_bytes: int = 4_000_000, bucket_bytes: int = 16_000_000, fan: int = 64) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``training`` marks the rows to learn from (default: all that have an id).  ``bucket_bytes`` is how
    much text one summed hash range stands for; ``fan``, a power of two, is the number of parts of a range.
    """
    learns = F.col("doc_id").isNotNull() & (F.lit(True) if training is None else F.coalesce(training, F.lit(False)))
    kind = F.when(~learns, SCORE).when(F.expr("pmod(xxhash64(doc_id, 'held out'), 7)") == 0, TUNE).otherwise(ESTIMATE)
    texts = id_text(docs)
    blocks = materialise(_blocks(texts.select("doc_id", "text", kind.alias("kind")), block_bytes), "blocks", compression="zstd")
    n_blocks, size = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    depth = 1
    while size > bucket_bytes * fan**depth and _bits(fan) * (depth + 1) < 64:
        depth += 1
    totals = materialise(_totals(_entries(blocks, fan), n_blocks, 0, depth, fan), "totals", compression="zstd")
    n, v, n_est, v_est = (x or 0 for x in totals.where("block < 0").agg(F.sum("n"), F.sum("v"), F.sum("n_est"), F.sum("v_est")).first())
    asked = totals.where("block >= 0")
    tuned = blocks.where(F.col("kind") == TUNE)
    tuned = _meet(tuned, asked.join(tuned.select("block"), "block", "left_semi"), True)
    cells = np.array([tuple(r) for r in _held_out_histogram(tuned, n_est).collect()], np.float64).reshape(-1, 4)
    weights = learn_weights(cells, v_est) if n else np.tile([0.0, 0.0, 1.0], (64, 1))
    scored = _scores(_meet(blocks, asked, False), weights, n, v)
    return scored.withColumn("train_tokens", F.lit(int(n)))


def training_fold(column: str = "doc_id") -> Column:
    """Rows whose id has crc32 modulo 7 other than 2."""
    return fold_of(column, 7) != 2
