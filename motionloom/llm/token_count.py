"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array.  In each round every sequence finds its own
lowest-rank adjacent pair and all occurrences of it are merged at once, for all sequences of
the batch together; a sequence is done when none of its pairs has a rank, and its token count
is the number of symbols that survive.  Merge ranks rise with the symbols they build, so
merging all occurrences of the lowest pair together equals the usual one-at-a-time order.

Texts are cut before every single space that stands between two other characters: the
pre-tokenizer always begins a pre-token there.  The pieces repeat a lot, so their counts are
kept in a dictionary of bounded size (entries of at most ``longest`` characters).  A text with any other run of white space around a
space is pre-tokenized as a whole.

Null and empty texts have 0 tokens.  Rows without an id keep a null id; repeated rows give repeated results.  Only the id and the
text are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced

#: The byte-level pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    hidden = (b for b in range(256) if b not in shown)
    shown.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [shown[b] for b in range(256)]


class RankMerger:
    """Counts the tokens of whole texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_size: int = 400_000, longest: int = 64):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.width = len(vocab) + len(spec["added_tokens"]) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.words = regex.compile(PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache_size, self.longest, self.cache = cache_size, longest, {}

    def merge_counts(self, sequences: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte sequence, all merged together."""
        lens = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out, alive = lens.copy(), np.flatnonzero(lens > 1)
        symbols = self.byte_ids[np.frombuffer(b"".join(sequences[i] for i in alive), np.uint8)]
        lens = lens[alive]
        while len(alive):
            starts = np.cumsum(lens) - lens
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1] = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
            rank[starts + lens - 1] = NO_RANK
            best = np.minimum.reduceat(rank, starts)
            open_ = best < NO_RANK
            hit = (rank == np.repeat(best, lens)) & (rank < NO_RANK)
            if (hit[1:] & hit[:-1]).any():  # a pair of equal symbols in a run: every second place counts
                place = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, -1))
                hit &= (place - first) % 2 == 0
            places = np.flatnonzero(hit)
            symbols[places] = self.merged[rank[places]]
            keep = np.repeat(open_, lens)
            lens = lens - np.add.reduceat(hit.astype(np.int64), starts)
            keep[places + 1] = False
            symbols = symbols[keep]
            alive, lens = alive[open_], lens[open_]
            out[alive] = lens
            short = lens > 1
            if not short.all():
                symbols = symbols[np.repeat(short, lens)]
                alive, lens = alive[short], lens[short]
        return out

    def pieces(self, text: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a text and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        return [w.encode("utf-8", "surrogatepass") for p in parts for w in self.words.findall(p)], len(parts) - 1

    def count_each(self, texts: list[str]) -> np.ndarray:
        """Counts without the dictionary; pre-tokens that repeat in the call are merged once."""
        found = [self.pieces(t) for t in texts]
        distinct: dict[bytes, int] = {}
        where = [distinct.setdefault(w, len(distinct)) for words, _ in found for w in words]
        counts = self.merge_counts(list(distinct))[where] if where else np.zeros(0, np.int64)
        ends = np.cumsum([len(words) for words, _ in found])
        total = np.concatenate(([0], np.cumsum(counts)))[ends]
        return np.diff(total, prepend=0) + np.array([n for _, n in found], np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole texts."""
        chunks: list[str] = []
        ends = []
        for text in texts:
            if "\0" in text:  # the mark of a first chunk
                chunks.append("\0\0")
                ends.append(len(chunks))
                continue
            first, *rest = text.split(" ")
            chunks.append("\0" + first)  # no space before it
            chunks += rest
            ends.append(len(chunks))
        missing = list(set(chunks).difference(self.cache))
        if len(self.cache) + len(missing) > self.cache_size:
            self.cache.clear()
            missing = list(set(chunks))
        if missing:
            plain = [c[1:] if c[:1] == "\0" else " " + c for c in missing]
            # A chunk of, or beside, other white space cannot be cut off safely.
            odd = [not c or c[-1:].isspace() or c[:1].isspace() or (c[:1] == "\0" and (c[1:2].isspace() or c[1:2] == "\0")) for c in missing]
            self.cache.update(zip(missing, np.where(odd, -(1 << 40), self.count_each(["" if o else p for p, o in zip(plain, odd, strict=True)])).tolist(), strict=True))
        counts = np.fromiter(map(self.cache.__getitem__, chunks), np.int64, len(chunks))
        for c in missing:
            if len(c) > self.longest:  # long chunks hardly come again, and would fill the memory
                del self.cache[c]
        out = np.diff(np.concatenate(([0], np.cumsum(counts)))[ends], prepend=0)
        whole = np.flatnonzero(out < 0)
        if len(whole):
            out[whole] = self.count_each([texts[i] for i in whole])
        return out


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One merger for each Python worker and file."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row; narrow, no shuffle.

    ``tokenizer_path`` must be readable on every executor (it ships with the Python environment).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(tokenizer_path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(own.count(batch.column(1).to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = id_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
