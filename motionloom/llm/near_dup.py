"""Near duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification.

A text's words are lower-cased runs of letters and digits (and any non-ASCII characters); its
shingles are all runs of five words, weighted by how often they occur (a text of fewer words is
one shingle).  Similarity is probability Jaccard of the weights; two texts are linked at 0.8 or
more, and a class is a connected component of links.

1. Equal texts are one node.
2. ProbMinHash: each shingle is a Poisson process whose rate is its weight; every arrival goes to
   a random slot, a slot keeps its first arrival, and a process ends as soon as it is later than
   every slot.  Two signatures agree in a slot with probability equal to their similarity.
3. Banding: texts that agree in all slots of a band share a bucket; the slots are banded twice, in
   two orders.  A bucket is not expanded into pairs: its most popular member (the one whose band
   keys are shared by most texts, as those of a copied original are) leads it and all members are
   compared to the leader.  So a bucket costs in proportion to its size.
4. Every pair whose signatures agree well enough is verified on the whole texts.
5. Components by alternating large and small stars; each round is written to the shared folder.
6. The rest: a bucket is settled when verified links, never estimates, make it one class.  All pairs of different
   classes among the members of the other buckets are found without loss by their rarest shingles.
   If a and b are the shares of two texts' weight outside their common shingles, similarity is at
   most 1 / (1/(1-a) + 1/(1-b) - 1).  So, in one order of all shingles from rare to frequent, the
   first common shingle of a pair at 0.8 has at most 1/5 of either text's weight before it, and at
   most 1/9 of one's.  Texts are not paired there but held in blocks of a few hundred, large classes in
   blocks of their own: where two blocks share such a shingle, the texts of one meet the other block,
   in which an inverted index gives both shares exactly; what they allow is verified, without any estimate.

Texts of a bucket's leader, and of a block, are sent once for each few thousand that are compared with
them, and such groups are dealt out, so neither a hot leader nor a hot block is one task's work.  No step
gathers a bucket or a class in one task, and nothing but row counts reaches the driver.

Null and empty texts are equal to each other and to no other text; texts without words are only
equal to exact copies.  A class is named by its least id (null if none of its rows has an id).  Texts
that share an id are nodes of their own, so near copies of each of them are found; repeated rows fall
together.  Only id and text are read, so further columns cannot clash.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TMP, drop, id_text, materialise, sliced, text_of
from .token_binary import ragged

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INSIDE = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])


class Shingler:
    """Hashes of the word shingles of texts, computed for a batch of texts at once.

    A word's hash is a polynomial over its bytes, taken from running sums over the batch.
    """

    def __init__(self, size: int = 5):
        self.size = size
        self.powers = self.backs = np.ones(1, np.uint64)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct shingles and their counts of each text."""
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        inside = _INSIDE[buffer]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.concatenate(([0], np.searchsorted(start, ends)))
        with np.errstate(over="ignore"):
            if len(self.powers) <= len(buffer):
                n = len(buffer) + 1
                self.powers = np.concatenate(([np.uint64(1)], np.full(n, np.uint64(_BASE)))).cumprod(dtype=np.uint64)
                self.backs = np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(_BASE, -1, 1 << 64))))).cumprod(dtype=np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.powers[: len(buffer)], dtype=np.uint64)))
            h = mixed((sums[end] - sums[start]) * self.backs[start])
            n = max(len(h) - self.size + 1, 0)
            flat = h[:n].copy()
            for k in range(1, self.size):
                flat = mixed(flat * np.uint64(31) + h[k : k + n])
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= self.size:
                    own = flat[a : b - self.size + 1]
                elif b > a:
                    own = mixed(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64))
                else:
                    own = h[:0]
                out.append(np.unique(own, return_counts=True))
        return out


def signature(elements: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """ProbMinHash: the element whose process arrives first in each slot."""
    first = np.full(slots, np.inf)
    winner = np.zeros(slots, np.uint64)
    at_once = int(np.ceil(1.6 * slots * np.log(slots) / len(elements)))
    d, rate, time, done = elements, weights.astype(np.float64), np.zeros(len(elements)), 0
    with np.errstate(over="ignore"):
        while len(d):
            turn = (np.arange(done, done + at_once, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _GOLD
            draw = mixed(d[:, None] + turn)
            gaps = -np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40)
            times = time[:, None] + np.cumsum(gaps, 1) / rate[:, None]
            slot = ((draw & np.uint64(0xFFFFFF)) * np.uint64(slots) >> np.uint64(24)).astype(np.int64)
            flat, to = times.ravel(), slot.ravel()
            early = np.flatnonzero(flat < first[to])
            early = early[np.argsort(-flat[early], kind="stable")]  # the earliest is written last
            first[to[early]] = flat[early]
            winner[to[early]] = d[early // at_once]
            alive = times[:, -1] < first.max()
            d, rate, time = d[alive], rate[alive], times[alive, -1]
            done += at_once
    return winner


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weightings, exactly."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = x[::-1].cumsum()[::-1]
    below = np.concatenate(([0.0], y.cumsum()[:-1]))
    denominator = a[1].sum() - x.sum() + above + ratio * (b[1].sum() - y.sum() + below)
    return float((x / denominator).sum())


_NO_ID = (1 << 63) - 1  # stands for null, after all ids


def _own_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(_NO_ID))


def _digest(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """did, digest of the text, 32 bits of each slot's winner, band keys (null without words)."""
    slots = bands * rows
    orders = np.stack([np.arange(slots), np.argsort(mixed(np.arange(1, slots + 1, dtype=np.uint64)))]).reshape(-1, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in sliced(batches, chars=1_000_000):
            texts = batch.column(1).to_pylist()
            fresh = list(dict.fromkeys(texts))  # copies in the batch are signed once
            made: dict[str, tuple[bytes, list[int]] | None] = {}
            with np.errstate(over="ignore"):
                for text, (elements, weights) in zip(fresh, shingler(fresh), strict=True):
                    if not len(elements):
                        made[text] = None
                        continue
                    winners = signature(elements, weights, slots)
                    keys = np.arange(1, len(orders) + 1, dtype=np.uint64) * _GOLD
                    for column in winners[orders].T:
                        keys = mixed(keys * np.uint64(31) + column)
                    made[text] = ((winners >> np.uint64(32)).astype("<u4").tobytes(), keys.view(np.int64).tolist())
            got = [made[t] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([g and g[0] for g in got], pa.binary()), pa.array([g and g[1] for g in got], pa.list_(pa.int64()))],
                ["did", "digest", "sig", "keys"],
            )

    return docs.mapInArrow(run, "did long, digest string, sig binary, keys array<long>")


def _compare(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(id, leader) -> share of agreeing slots."""
    own = pairs.join(sigs.select(F.col("node").alias("id"), F.col("sig").alias("a")), "id")
    both = own.join(sigs.select(F.col("node").alias("leader"), F.col("sig").alias("b")), "leader").select("id", "leader", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(1))], ["id", "leader", "agree"])

    return both.mapInArrow(run, "id long, leader long, agree double")


def _buckets(sigs: DataFrame) -> DataFrame:
    """(id, key, n): the buckets of at least two members."""
    banded = sigs.select(F.col("node").alias("id"), F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(banded.join(sizes, "key"), "shared")


def _candidates(shared: DataFrame, sigs: DataFrame) -> DataFrame:
    """All compared (id, leader, agree): members of every bucket with its leader."""
    popular = shared.groupBy("id").agg(F.sum("n").alias("popular"))
    members = materialise(shared.select("id", "key").join(popular, "id"), "buckets")
    heads = members.groupBy("key").agg(F.max(F.struct("popular", (-F.col("id")).alias("low"))).alias("lead")).select("key", (-F.col("lead.low")).alias("leader"))
    led = members.join(heads, "key").where("id <> leader").select("id", "leader").distinct()
    return materialise(_compare(led, sigs), "compared")


def _unsettled(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class) of the members of all buckets that hold more than one class."""
    own = shared.select("id", "key").join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("class", "id").alias("class"))
    own = materialise(own, "labelled")
    several = own.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    return materialise(own.join(several, "key").select("id", "class").distinct(), "unsettled")


class _Block:
    """An inverted index over the shingles of some texts."""

    def __init__(self, members: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]):
        self.ids, self.classes = (np.array([m[k] for m in members], np.int64) for k in (0, 1))
        self.sets = [m[2] for m in members]
        flat = np.concatenate([e for e, _ in self.sets])
        order = np.argsort(flat, kind="stable")
        self.elements = flat[order]
        self.owners = np.repeat(np.arange(len(members)), [len(e) for e, _ in self.sets])[order]
        self.weights = np.concatenate([w for _, w in self.sets])[order]
        self.totals = np.array([w.sum() for _, w in self.sets], np.float64)

    def links(self, node: int, own_class: int, own: tuple[np.ndarray, np.ndarray], least: float) -> list[int]:
        """One member of each other class that is similar enough to a text."""
        first, last = (np.searchsorted(self.elements, own[0], side) for side in ("left", "right"))
        places = ragged(first, last - first)
        owners = self.owners[places]
        mine = np.bincount(owners, np.repeat(own[1], last - first), len(self.ids)) / max(own[1].sum(), 1)
        theirs = np.bincount(owners, self.weights[places], len(self.ids)) / np.maximum(self.totals, 1)
        both = (mine > 0) & (self.classes != own_class) & (self.ids != node)
        able = np.flatnonzero(both)
        able = able[1 / mine[able] + 1 / theirs[able] - 1 <= 1 / least + 1e-9]
        found: dict[int, int] = {}
        for k in able[np.argsort(-mine[able], kind="stable")].tolist():
            if int(self.classes[k]) not in found and similarity(own, self.sets[k]) >= least:
                found[int(self.classes[k])] = int(self.ids[k])
        return list(found.values())


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes given with their did and digest; repeated rows count once."""
    once = docs.groupBy("digest", "did").agg(F.first("text").alias("text"))
    return once.join(nodes.select("digest", "did", "node"), ["digest", "did"]).select("node", "text")


def _links(asked: DataFrame, members: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, least: float, at_once: int = 4000) -> DataFrame:
    """(id, other): verified links of the texts ``asked`` (id, class, block) to ``members`` (id, class, block) of the block.

    A text and a member of one class are not compared, and one link to each class is enough.  A block
    is sent again for every ``at_once`` texts asked, so that tasks are of like size.
    """
    load = asked.groupBy("block").agg(F.ceil(F.count("*") / at_once).cast("int").alias("chunks"))
    one = asked.join(load, "block").select("block", F.expr("pmod(xxhash64(id), chunks)").cast("int").alias("chunk"), F.lit(1).alias("kind"), "id", "class")
    other = members.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "id", "class")
    rows = materialise(one.unionByName(other), "asked")
    held = nodes.join(rows.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    told = rows.join(_texts(docs, held), F.col("id") == F.col("node")).select("block", "chunk", "kind", "id", "class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        at, members, block = None, [], None
        for batch in sliced(batches, chars=1_000_000):
            with np.errstate(over="ignore"):
                sets = shingler(batch.column(5).to_pylist())
            ids, others = [], []
            for key, chunk, kind, node, own_class, own in zip(*(batch.column(k).to_pylist() for k in range(5)), sets, strict=True):
                if at != (key, chunk):
                    at, members, block = (key, chunk), [], None
                if kind == 0:
                    members.append((node, own_class, own))
                    continue
                block = block or _Block(members)
                found = block.links(node, own_class, own, least)
                ids += [node] * len(found)
                others += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], ["id", "other"])

    dealt = told.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind", "id")
    return dealt.mapInArrow(run, "id long, other long")


def _rarest(rest: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, shingle, before): each text's rarest shared shingles and the share of its weight before them; (id, total weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in sliced(batches, chars=250_000):
            with np.errstate(over="ignore"):
                own = shingler(batch.column(1).to_pylist())
            lens = [len(e) for e, _ in own]
            totals = np.repeat([int(w.sum()) for _, w in own], lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), lens)), pa.array(np.concatenate([e for e, _ in own]).view(np.int64)), pa.array(np.concatenate([w for _, w in own]).astype(np.int64)), pa.array(totals.astype(np.int64))],
                ["id", "shingle", "weight", "total"],
            )

    held = nodes.join(rest.select(F.col("id").alias("node")), "node", "left_semi")
    every = materialise(_texts(docs, held).mapInArrow(run, "id long, shingle long, weight long, total long"), "shingles")
    often = every.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    shared = every.join(often, "shingle")
    # What no other text holds comes first in the order and counts as weight only.
    whole = Window.partitionBy("id")
    before = F.col("total") - F.sum("weight").over(whole) + F.sum("weight").over(whole.orderBy("often", "shingle").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    rows = shared.select("id", "shingle", (before / F.col("total")).alias("before")).where(F.col("before") <= 1 - least + 1e-9)
    return rows, every.groupBy("id").agg(F.max("total").alias("total"))


def _in_blocks(rest: DataFrame, compared: DataFrame, totals: DataFrame, texts: int = 256, weight: int = 1_000_000) -> DataFrame:
    """(id, class, block, own): blocks of about ``texts`` texts, or ``weight`` shingles.

    Large classes have blocks of their own (``own`` is the class, else null); other texts lie with those
    whose most similar leader is of the same class.
    """
    best = compared.groupBy("id").agg(F.max_by("leader", F.struct("agree", "leader")).alias("leader"))
    leaders = rest.select(F.col("id").alias("leader"), F.col("class").alias("around"))
    large = rest.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") >= texts).select("class", F.col("class").alias("own"))
    placed = rest.join(totals, "id").join(best, "id", "left").join(leaders, "leader", "left").join(large, "class", "left")
    placed = placed.select("id", "class", "own", "total", F.coalesce("own", "around", "class").alias("around"), F.coalesce("own", F.lit(-1)).alias("grp"))
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("around", "grp").agg(F.ceil(F.greatest(F.count("*") / texts, F.sum("total") / weight)).cast("long").alias("parts"))
    return placed.join(sizes, ["around", "grp"]).select("id", "class", F.xxhash64("around", "grp", F.expr("pmod(xxhash64(id), parts)")).alias("block"), "own")


def _late_links(rest: DataFrame, compared: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """(id, other): links between different classes of ``rest`` (id, class)."""
    rows, totals = _rarest(rest, docs, nodes, size, least)
    blocks = materialise(_in_blocks(rest, compared, totals), "blocks")
    held = rows.join(blocks, "id").groupBy("shingle", "block", "own").agg(F.min("before").alias("before"))
    held = materialise(held, "rarest")
    other = held.select("shingle", F.col("block").alias("there"), F.col("own").alias("theirs"), F.col("before").alias("their_before"))
    near = (F.col("block") >= F.col("there")) & ~F.coalesce(F.col("own") == F.col("theirs"), F.lit(False)) & (1 / (1 - F.col("before")) + 1 / (1 - F.col("their_before")) <= 1 + 1 / least + 1e-9)
    meet = held.join(other, "shingle").where(near).select("block", "there").distinct()
    asked = blocks.select("id", "class", "block").join(meet, "block").select("id", "class", F.col("there").alias("block"))
    return _links(asked, blocks.select("id", "class", "block"), docs, nodes, size, least)


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of every node of ``edges`` (u, v): class is the least node of its component."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        drop(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = materialise(small, "small-star")
        drop(large)
        # Stars around least nodes, and nothing else, no longer change.
        inner = small.select(F.col("v").alias("u")).distinct().join(small.select("u").distinct(), "u", "left_semi")
        many = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if inner.isEmpty() and many.isEmpty():
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())


def _classes(docs: DataFrame, size: int, least: float, bands: int, rows: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """Rows' (did, digest), and (digest, did, class, class_id) of every text: its least id, its class, that one's least id."""
    texts = id_text(docs).select(_own_id().alias("did"), "text", _digest(F.col("text")).alias("digest"))
    signed = materialise(_signatures(texts, size, bands, rows), "signatures")
    once = signed.groupBy("digest").agg(F.min("did").alias("did"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = materialise(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    standing = nodes.where("sig IS NOT NULL")
    shared = _buckets(standing)
    compared = _candidates(shared, standing)
    close = compared.where(F.col("agree") >= least - slack).select("id", F.col("id").alias("class"), F.col("leader").alias("block"))
    leaders = close.select(F.col("block").alias("id"), F.col("block").alias("class"), "block").distinct()
    links = _links(close, leaders, texts, nodes, size, least)
    classes = materialise(components(links.select(F.col("id").alias("u"), F.col("other").alias("v"))), "classes")
    rest = _unsettled(shared, classes)
    named = nodes.select("digest", "did", "node").join(classes, "node", "left").select("digest", "did", F.coalesce("class", "node").alias("class"))
    if not rest.isEmpty():
        late = _late_links(rest, compared, texts, nodes, size, least)
        late = late.join(rest.select("id", F.col("class").alias("u")), "id").join(rest.select(F.col("id").alias("other"), F.col("class").alias("v")), "other")
        joins = components(late.select("u", "v")).select(F.col("node").alias("class"), F.col("class").alias("joined"))
        named = named.join(joins, "class", "left").select("digest", "did", F.coalesce("joined", "class").alias("class"))
    named = materialise(named, "named")
    least_ids = named.groupBy("class").agg(F.min("did").alias("class_id"))
    return signed.select("did", "digest"), named.join(least_ids, "class").select("digest", "did", "class", "class_id")


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5, slack: float = 0.14) -> DataFrame:
    """doc_id, class_id (the least id of the class) of every row.

    ``bands`` x ``rows`` slots: a pair at 0.8 shares a band of the first order alone with
    probability 0.9996.  A pair of a bucket's leader is verified if its signatures agree in at least
    ``least - slack`` of the slots (three and a half standard errors below the threshold).
    """
    found, named = _classes(docs, size, least, bands, rows, slack)
    known = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias("doc_id" if c == "did" else c)
    return found.join(named.select("digest", "class_id"), "digest").select(known("did"), known("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: the one with the least id (of equal rows, any)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    _, named = _classes(docs, 5, 0.8, 20, 5, 0.14)
    # Of several texts with the class's least id the one with the least digest stays.
    kept = named.where("did = class_id").groupBy("class").agg(F.min(F.struct("did", "digest")).alias("k")).select(F.col("k.did").alias(f"{TMP}did"), F.col("k.digest").alias(f"{TMP}digest"))
    marked = docs.withColumns({f"{TMP}did": _own_id(id_col), f"{TMP}digest": _digest(text_of(text_col))})
    keys = [f"{TMP}did", f"{TMP}digest"]
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*own)
