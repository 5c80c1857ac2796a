"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Texts and benchmark items are normalised alike: A-Z to lower case, every run of ASCII characters
other than letters and digits to one space.  The automaton reads words, each as one character that
stands for it in the benchmark's vocabulary, and holds every window of ``width`` consecutive item words (an item of fewer
words is one window); a text is scanned once, and each match is a run of word places, which is
mapped to offsets in the original text.

Repeated items count once, and long ones are cut into runs of ``run_words`` words that share ``width`` - 1
with the next, so every window is in one of them.  The automaton is built from at most about
``block_bytes`` of benchmark text, whose distinct words are then fewer than the characters there are, so neither the
driver nor a worker ever holds more.  A larger benchmark is cut into blocks: the documents are numbered and
written once, the blocks scan them one after the other, each with an automaton of its own that returns
only the rows it hits, and these are joined to the documents at the end.

Null, empty and wordless texts have no words and no hits; null items have no windows.  The windows
of an item without an id are hits like any other, but such an item is not listed.  Repeated
documents, and documents without an id, are scanned alike, row by row; repeated items are reported
once each by id.  Overlapping and repeated occurrences count each word once.  Further columns
cannot clash: only ids and texts are read.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, materialise, sliced, text_of

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def _folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def _words(text: str) -> list[bytes]:
    return [w for w in _folded(text).split(b" ") if w]


class Matcher:
    """The automaton over all windows of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        self.vocabulary: dict[bytes, str] = {}
        windows: dict[str, list[int | None]] = {}
        for item, text in items:
            words = _words(text or "")
            for w in words:
                if w not in self.vocabulary:
                    place = len(self.vocabulary) + 1
                    self.vocabulary[w] = chr(place if place < 0xD800 else place + 0x800)  # no surrogates
            line = "".join(map(self.vocabulary.__getitem__, words))
            for at in range(max(1, len(line) - width + 1) if line else 0):
                windows.setdefault(line[at : at + width], []).append(item)
        self.automaton = ahocorasick.Automaton() if windows else None
        for window, owners in windows.items():
            self.automaton.add_word(window, (len(window), owners))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words of the text, hit places [first, end) in words, ids of items with an occurring window."""
        words = _words(text)
        if self.automaton is None or not words:
            return len(words), [], set()
        get = self.vocabulary.get
        found = list(self.automaton.iter("".join([get(w, "\0") for w in words])))
        return len(words), [(end + 1 - n, end + 1) for end, (n, _) in found], {i for _, (_, owners) in found for i in owners if i is not None}


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching places as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word places as character offsets [start, end) of the original text."""
    if not places:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in places]


_matchers: dict[str, Matcher] = {}
_FOUND = "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<long>, items_sha256 string"


def _matcher(key: str, items: list[tuple[int | None, str]], width: int) -> Matcher:
    """The automaton of one block; a Python worker keeps the last one it has built."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, width)
    return _matchers[key]


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _item_runs(benchmark: DataFrame, width: int, run_words: int) -> DataFrame:
    """The distinct items, those of many words as overlapping runs of words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text")).distinct()
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    cut = items.withColumn("words", words).withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(run_words))))
    return cut.select("item_id", F.array_join(F.slice("words", F.col("first") + 1, F.lit(run_words + width - 1)), " ").alias("text"))


def _blocks(benchmark: DataFrame, width: int, block_bytes: int, run_words: int) -> list[DataFrame]:
    """The items in blocks of at most about ``block_bytes``."""
    runs = _item_runs(benchmark, width, run_words)
    total = runs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    if total <= block_bytes:
        return [runs]
    n = -(-2 * total // block_bytes)
    held = materialise(runs.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {n})")), "decontaminate-items")
    return [held.where(F.col("block") == k).drop("block") for k in range(n)]


def _held(block: DataFrame) -> list[tuple[int | None, str]]:
    return [(r.item_id, r.text) for r in block.collect()]


def _pair_list(first: str, second: str) -> pa.DataType:
    return pa.list_(pa.struct([(first, pa.int64()), (second, pa.int64())]))


def _scan_once(docs: DataFrame, items: list[tuple[int | None, str]], width: int) -> DataFrame:
    """The whole result by one automaton: a narrow map."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _matcher(key, items, width)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            got = [(n, merged(places), sorted(ids)) for n, places, ids in map(own.scan, texts)]
            where = pa.array([[{"start": s, "end": e} for s, e in spans(t, p)] for t, (_, p, _) in zip(texts, got, strict=True)], _pair_list("start", "end"))
            hits = pa.array([sum(b - a for a, b in p) for _, p, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in got], pa.int64()), hits, where, pa.array([i for _, _, i in got], pa.list_(pa.int64())), pa.array([_digest(i) for _, _, i in got], pa.string())],
                ["doc_id", "n_words", "n_hit", "spans", "items", "items_sha256"],
            )

    return docs.mapInArrow(run, _FOUND)


def _scan_blocks(docs: DataFrame, blocks: list[DataFrame], width: int) -> DataFrame:
    """The result by several automata: hits of each block, joined by row."""
    numbered = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")  # equal rows are told apart
    places = "row long, places array<struct<a:long,b:long>>, items array<long>"

    def hits(block: DataFrame) -> DataFrame:
        items, key = _held(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _matcher(key, items, width)
            for batch in sliced(batches):
                got = [(r, merged(p), sorted(i)) for r, (_, p, i) in zip(batch.column(2).to_pylist(), map(own.scan, batch.column(1).to_pylist()), strict=True) if p]
                spots = pa.array([[{"a": a, "b": b} for a, b in p] for _, p, _ in got], _pair_list("a", "b"))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in got], pa.int64()), spots, pa.array([i for _, _, i in got], pa.list_(pa.int64()))], ["row", "places", "items"])

        return materialise(numbered.mapInArrow(run, places), "decontaminate-hits")

    found = hits(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(hits(block))
    # Places and items of one document: never more than its words and the benchmark's items.
    per = found.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            spots = [merged([(p["a"], p["b"]) for p in own or []]) for own in batch.column(2).to_pylist()]
            items = [sorted(i or []) for i in batch.column(3).to_pylist()]
            where = pa.array([[{"start": s, "end": e} for s, e in spans(t, p)] for t, p in zip(texts, spots, strict=True)], _pair_list("start", "end"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(_words(t)) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in p) for p in spots], pa.int64()), where, pa.array(items, pa.list_(pa.int64())), pa.array(list(map(_digest, items)), pa.string())],
                ["doc_id", "n_words", "n_hit", "spans", "items", "items_sha256"],
            )

    return numbered.join(per, "row", "left").select("doc_id", "text", "places", "items").mapInArrow(finish, _FOUND)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4_000_000, run_words: int = 5000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (offsets in the text), items, items_sha256, contaminated."""
    blocks = _blocks(benchmark, width, block_bytes, run_words)
    rows = id_text(docs)
    found = _scan_once(rows, _held(blocks[0]), width) if len(blocks) == 1 else _scan_blocks(rows, blocks, width)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def clean_of(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", block_bytes: int = 4_000_000, run_words: int = 5000) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs.

    One narrow pass; with a benchmark of several blocks, one after the other over the rows that none before has hit.
    """
    blocks = _blocks(benchmark, width, block_bytes, run_words)
    clean = docs
    for k, block in enumerate(blocks):
        items, key = _held(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items: list = items, key: str = key) -> Iterator[pa.RecordBatch]:
            own = _matcher(key, items, width)
            for batch in sliced(batches, text=text_col):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not own.scan(t or "")[1] for t in texts], pa.bool_()))

        before, clean = clean, clean.mapInArrow(run, docs.schema)
        if k + 1 < len(blocks):  # written, so that each block has workers of its own
            clean = materialise(clean, "decontaminate-clean")
            if before is not docs:
                drop(before)
    return clean
