"""Token ids in a compressed binary format: Re-Pair grammars with random access.

Whole texts are encoded with the tokenizers library, an end id is appended to each, and the
documents are laid out in ascending id order.  The layout is cut into segments of about
``segment_tokens`` ids; each segment is one file record with its own grammar.  In each round every
adjacent pair of the segment that occurs often enough to pay for its rule, and more often than the
pairs it overlaps with, is replaced by a new nonterminal (never across a document's end).  Rounds go
on until no pair pays any more.  Symbols take two bytes where the vocabulary leaves room for
``ROOM`` rules or more: when the 65,536 symbols are used up, another rule would double the record, so
none pays.  Symbols of larger vocabularies take four bytes, which no segment uses up.  The record keeps
the two sides and the expansion length of each rule, so any document is decoded from its own symbols
alone.

Records are kept in Parquet tables, so any Hadoop file system holds them.  Memory is bounded by
a segment (or one document, if that is longer) and by the chunk dictionary.

Null and empty texts hold the end id only.  Null ids come first and are read back as null.  Equal
(and null) ids keep an order by their text, and are dealt to tasks by how their texts begin, so that an
id of many rows is many tasks' work.  Only the id and the text are read, so further columns cannot
clash.  An empty table gives no records.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, materialise, sliced

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIIII")  # magic, documents, rules, symbols, base, bytes of a symbol
#: Rules that a vocabulary must leave room for if its symbols take two bytes.
ROOM = 1 << 13
#: ``first`` is the number of ids before the record in its shard.
RECORD = "shard int, part int, first long, n_docs int, n_tokens long, payload binary"


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lens, lens)


#: Byte classes: letters (and all non-ASCII, checked later), digits, other marks, line end, space,
#: further white space, and marks that need their whole chunk (apostrophes, controls).
_L, _D, _P, _N, _S, _W, _GLUE = range(1, 8)
_CLASS = np.full(256, _GLUE, np.uint8)
_CLASS[33:127] = _P
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _L
_CLASS[48:58] = _D
_CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = _W
_CLASS[[10, 32, 39]] = _N, _S, _GLUE
_BLANK = (_CLASS == _N) | (_CLASS == _S) | (_CLASS == _W)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class AtomEncoder:
    """Encodes whole texts with the library by way of a dictionary of pre-tokens, in numpy.

    A batch of texts is cut at once, by byte classes, where the pre-tokenizer always cuts: before
    a single space, and between letters, digits, other marks and a single line end.  Each piece is
    looked up by a 64-bit hash in one array and its bytes are compared with those the entry was made
    of; new pieces go to the library, many at once.  A chunk between spaces that holds anything less
    simple is one piece, and a text with other white space, special strings or a piece whose hash
    belongs to other bytes is handed to the library whole.

    The array doubles when it is half full.  What is kept from batch to batch is bounded by ``MOST``.
    """

    #: Entries, bytes of pieces and ids of pieces: a dictionary with more of one is emptied.
    MOST = 3 << 19, 1 << 25, 1 << 24

    def __init__(self, path: str, table_bits: int = 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.first_bits = Tokenizer.from_file(path), table_bits
        # New pieces are pre-tokens already: the same model, cut at line ends only and without its own
        # cache, gives their ids at less cost.
        self.liner = Tokenizer.from_file(path)
        self.liner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        model = self.liner.model
        model._resize_cache(0)
        self.liner.model = model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.powers = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.bits, self.filled = self.first_bits, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.starts, self.lens, self.held = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0  # the pieces' own bytes, and where they lie
        self.raw_starts, self.raw_lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -9 where a key is new."""
        place = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -9, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[place]
            same = there == keys[left]
            out[left[same]] = self.values[place[same]]
            on = ~same & (there != 0)
            left, place = left[on], (place[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.filled += len(keys)
        if self.filled > 1 << (self.bits - 1):
            own = np.flatnonzero(self.keys)
            keys, values = np.concatenate((self.keys[own], keys)), np.concatenate((self.values[own], values))
            self.bits = self.filled.bit_length() + 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        place = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[place] == 0)
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[place[won]], self.values[place[won]] = keys[won], values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, values, place = keys[lost], values[lost], (place[lost] + 1) & ((1 << self.bits) - 1)

    def _add(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Append runs of ids to the store; their numbers."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.held + len(lens) > len(self.starts):
            self.starts, self.lens = np.concatenate((self.starts, np.zeros_like(self.starts))), np.concatenate((self.lens, np.zeros_like(self.lens)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.held : self.held + len(lens)] = self.used + np.cumsum(lens) - lens
        self.lens[self.held : self.held + len(lens)] = lens
        self.used += len(ids)
        self.held += len(lens)
        return np.arange(self.held - len(lens), self.held)

    def _note(self, numbers: np.ndarray, own: np.ndarray, lens: np.ndarray) -> None:
        """Keep the bytes of the pieces (one after the other) that have these numbers in the store."""
        while self.raw_used + len(own) > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
        if len(self.raw_starts) < len(self.starts):
            grown = np.zeros(len(self.starts), np.int64)
            self.raw_starts, self.raw_lens = (np.concatenate((x, grown[len(x) :])) for x in (self.raw_starts, self.raw_lens))
        self.raw[self.raw_used : self.raw_used + len(own)] = own
        self.raw_starts[numbers], self.raw_lens[numbers] = self.raw_used + np.cumsum(lens) - lens, lens
        self.raw_used += len(own)

    def _others(self, buffer: np.ndarray, found: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each piece found has other bytes than its entry; pieces lie one after the other."""
        size = ends - at
        other = (found >= 0) & (self.raw_lens[np.maximum(found, 0)] != size)
        held = (found >= 0) & ~other
        own = buffer if held.all() else buffer[np.repeat(held, size)]  # pieces tile the buffer
        wrong = self.raw[ragged(self.raw_starts[found[held]], size[held])] != own
        if wrong.any():
            other[np.flatnonzero(held)[np.searchsorted(np.cumsum(size[held]), np.flatnonzero(wrong), side="right")]] = True
        return other

    def _learn(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole_chunks: bool) -> None:
        """New pieces: ids from the library; -1 (take the chunk) or -2 (take the text) where a piece is not simple."""
        lens = ends - starts
        own = np.frombuffer(raw, np.uint8)[ragged(starts, lens)]
        at = np.cumsum(lens) - lens
        pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        values = np.zeros(len(pieces), np.int64)
        blank = np.logical_and.reduceat(_BLANK[own], at)
        if whole_chunks:
            lines, single = np.zeros(0, np.int64), []
            for k, piece in enumerate(pieces):
                p = piece.decode("utf-8", "surrogatepass")
                if any(map(str.isspace, p[1:])) or p[:1].isspace() and p[:1] != " " or p.isspace() and len(p) > 1:
                    values[k] = -2
                else:
                    single.append(k)
        else:
            simple = np.maximum.reduceat(own, at) < 128
            for k in np.flatnonzero(~simple).tolist():
                if pieces[k].decode("utf-8", "surrogatepass").lstrip(" ").isalpha():
                    simple[k] = True
                else:
                    values[k] = -1
            lines, single = np.flatnonzero(simple & ~blank), np.flatnonzero(simple & blank).tolist()
        if single:
            ids = self._library([pieces[k].decode("utf-8", "surrogatepass") for k in single])
            values[single] = self._add(np.concatenate(ids), np.array(list(map(len, ids)), np.int64))
        groups = [lines[k : k + 100] for k in range(0, len(lines), 100)]
        texts = [b"\n".join([pieces[k] for k in group.tolist()]).decode("utf-8", "surrogatepass") for group in groups]
        for group, coded in zip(groups, self.liner.encode_batch_fast(texts, add_special_tokens=False) if texts else [], strict=True):
            ids = np.array(coded.ids, np.int32)
            marks = np.concatenate((np.flatnonzero(ids == self.line[0]), [len(ids)]))
            if len(self.line) != 1 or len(marks) != len(group):
                raise ValueError("the vocabulary has no line end of its own")
            values[group] = self._add(ids[ids != self.line[0]], np.diff(marks, prepend=-1) - 1)
        kept = values >= 0
        self._note(values[kept], own if kept.all() else own[np.repeat(kept, lens)], lens[kept])
        self._insert(keys, values)

    def _values(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole_chunks: bool) -> np.ndarray:
        found = self._find(keys)
        new = np.flatnonzero(found == -9)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            self._learn(raw, distinct, starts[new[first]], ends[new[first]], whole_chunks)
            found[new] = self._find(keys[new])
        return found

    def encode(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts, one after the other -> all ids, and the number of ids of each text."""
        sizes = np.diff(offsets)
        if not len(buffer):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        with np.errstate(over="ignore"):
            if len(self.powers) <= len(buffer):
                n = len(buffer) + 1
                self.powers = np.concatenate(([np.uint64(1)], np.full(n, _BASE))).cumprod(dtype=np.uint64)
                self.backs = np.concatenate(([np.uint64(1)], np.full(n, _BACK))).cumprod(dtype=np.uint64)
            raw = buffer.tobytes()
            kind = _CLASS[buffer]
            same = np.empty(len(buffer), bool)
            same[0] = False
            same[1:] = kind[1:] == kind[:-1]
            after_space = np.concatenate(([False], kind[:-1] == _S))
            start = (~same | (kind == _N) | (kind == _S)) & ~(after_space & (kind != _N) & (kind != _S))
            docs = offsets[:-1][sizes > 0]
            start[docs] = True
            # Texts with runs of white space or special strings go to the library whole.
            blank = (kind == _N) | (kind == _S) | (kind == _W)
            run = np.flatnonzero(blank[1:] & blank[:-1]) + 1
            bad = np.zeros(len(sizes) + 1, bool)
            doc_of = lambda places: np.searchsorted(offsets, places, side="right") - 1
            bad[doc_of(run)] = True
            bad[doc_of(np.flatnonzero(kind == _W))] = True
            for x in self.specials:
                at = raw.find(x.encode())
                while at >= 0:
                    bad[doc_of(at)] = True
                    at = raw.find(x.encode(), at + 1)
            # Chunks with glue are one piece.
            chunk = start & ((kind == _S))
            chunk[docs] = True
            chunk_starts = np.flatnonzero(chunk)
            glued = np.zeros(len(chunk_starts), bool)
            glued[np.searchsorted(chunk_starts, np.flatnonzero(kind == _GLUE), side="right") - 1] = True
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.powers[: len(buffer)], dtype=np.uint64)))

            def pieces(glued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                at = np.flatnonzero(start)
                if glued.any():
                    inside = np.searchsorted(chunk_starts, at, side="right") - 1
                    at = at[~glued[inside] | (at == chunk_starts[inside])]
                ends = np.append(at[1:], len(buffer))
                h = (sums[ends] - sums[at]) * self.backs[at]
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                return at, ends, (h ^ (h >> np.uint64(29))) | np.uint64(1)

            at, ends, keys = pieces(glued)
            inside = np.searchsorted(chunk_starts, at, side="right") - 1 if glued.any() else None
            whole = glued[inside] & np.ones(len(at), bool) if inside is not None else np.zeros(len(at), bool)
            keys[whole] ^= np.uint64(0x5555555555555554)  # chunks and simple pieces are told apart
            found = np.empty(len(at), np.int64)
            for flag in (False, True):
                own = np.flatnonzero(whole == flag)
                if len(own):
                    found[own] = self._values(raw, keys[own], at[own], ends[own], flag)
            if (found == -1).any():
                glued[np.searchsorted(chunk_starts, at[found == -1], side="right") - 1] = True
                at, ends, keys = pieces(glued)
                whole = glued[np.searchsorted(chunk_starts, at, side="right") - 1]
                keys[whole] ^= np.uint64(0x5555555555555554)
                found = np.empty(len(at), np.int64)
                for flag in (False, True):
                    own = np.flatnonzero(whole == flag)
                    if len(own):
                        found[own] = self._values(raw, keys[own], at[own], ends[own], flag)
            bad[doc_of(at[found == -2])] = True
            bad[doc_of(at[self._others(buffer, found, at, ends)])] = True
        bad = bad[:-1]
        first = np.searchsorted(at, offsets)  # pieces of each text
        held, used = self.held, self.used
        if bad.any():
            texts = [raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass") for i in np.flatnonzero(bad)]
            ids = self._library(texts)
            numbers = self._add(np.concatenate(ids), np.array(list(map(len, ids)), np.int64))
            keep = ~np.repeat(bad, np.diff(first))
            keep[first[:-1][bad]] = True
            found[first[:-1][bad]] = numbers
            found = found[keep]
            first = np.concatenate(([0], np.cumsum(keep)))[first]
        lens = self.lens[found].astype(np.int64)
        out = self.flat[ragged(self.starts[found], lens)]
        counts = np.diff(np.concatenate(([0], np.cumsum(lens)))[first])
        self.held, self.used = held, used  # the ids of whole texts are not kept
        if any(x > most for x, most in zip((self.filled, self.raw_used, len(self.flat)), self.MOST, strict=True)):
            self.forget()
        if len(self.powers) > 1 << 22:
            self.powers = self.backs = np.ones(1, np.uint64)
        return out, counts


def texts_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def symbol_width(base: int) -> int:
    """Bytes of a symbol of a vocabulary's records."""
    return 2 if base + ROOM <= 1 << 16 else 4


def pair_rules(symbols: np.ndarray, last: np.ndarray, base: int, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: symbols and document ends -> fewer symbols, their document ends, rule sides.

    A rule takes two sides and a length of four bytes: as much as four symbols of two bytes, so that
    a pair pays from five occurrences on, or three of four bytes, so that it pays from four on.

    The first rounds close the gaps of merged symbols.  Once few places are live, symbols stay where
    they are and are linked to their neighbours, so that a round costs its live places.
    """
    least, most = (5, 1 << 16) if width == 2 else (4, 1 << 31)
    whole, half = (np.uint32, np.uint32(16)) if width == 2 else (np.uint64, np.uint64(32))
    sides: list[np.ndarray] = []
    made, linked = 0, False
    live = np.flatnonzero(~last[:-1])  # places whose pair may pay; a rare pair only does so with a new symbol in it
    while len(live) and base + made < most:
        if linked:
            second = following.take(live)
            key = (symbols.take(live).astype(whole) << half) | symbols.take(second).astype(whole)
        else:
            second, wide = live + 1, symbols.astype(whole)
            key = ((wide[:-1] << half) | wide[1:]).take(live)
        seen, counts = _counted(key)
        seen, counts = seen[counts >= least], counts[counts >= least].astype(np.int32)
        if not len(seen):
            break
        at = _placed(seen, key)
        known = np.flatnonzero(at >= 0)
        live, second, at = live.take(known), second.take(known), at.take(known)
        # A place is taken if its pair is more frequent than those it overlaps with; on a tie the first is.
        weight = counts.take(at)
        beside = second[:-1] == live[1:]
        before, after = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32)
        np.multiply(weight[:-1], beside, out=before[1:])
        np.multiply(weight[1:], beside, out=after[:-1])
        highest = weight >= after
        taken = (weight > before) & highest
        level = (weight == before) & highest
        if level.any():
            taken |= _every_second(level, taken)
        own = np.flatnonzero(taken)
        uses = np.bincount(at.take(own), minlength=len(seen))
        chosen = np.flatnonzero(uses >= least)
        if not len(chosen):  # overlaps leave no pair enough places: pair by pair, the most frequent first
            taken, uses = _one_by_one(live, second, at, counts, least)
            own, chosen = np.flatnonzero(taken), np.flatnonzero(uses)
            if not len(chosen):
                break
        chosen = chosen[np.argsort(-uses[chosen], kind="stable")[: most - base - made]]
        number = np.full(len(seen), -1, np.int32)
        number[chosen] = np.arange(base + made, base + made + len(chosen), dtype=np.int32)
        rule = number.take(at.take(own))
        ruled = np.flatnonzero(rule >= 0)
        own, rule = own.take(ruled), rule.take(ruled)
        places, merged = live.take(own), second.take(own)
        sides.append(np.stack([seen[chosen] >> half, seen[chosen] & ((whole(1) << half) - whole(1))], 1).astype(np.int64))
        symbols[places] = rule
        last[places] = last.take(merged)
        made += len(chosen)
        again = np.zeros(len(symbols), bool)
        again[live] = True
        if linked:
            there[merged] = False
            following[places] = after = following.take(merged)
            former[after] = places
            again[np.maximum(former.take(places), 0)] = True  # the pair of a new symbol with the one before it
            again[merged] = False
            again &= ~last
            live = np.flatnonzero(again)
            continue
        gone = np.zeros(len(symbols) + 1, bool)
        gone[merged] = True
        # The pair of a new symbol with the one before it, past one that has just gone.
        again[np.maximum(places - 1 - gone.take(places - 1), 0)] = True
        keep = np.flatnonzero(~gone[:-1])
        symbols, last, again = symbols.take(keep), last.take(keep), again.take(keep)
        again &= ~last
        live = np.flatnonzero(again[:-1])
        if len(live) < len(symbols) // 2:
            linked, following, former, there = True, np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols)), np.ones(len(symbols), bool)
    if linked:
        symbols, last = symbols[there], last[there]
    rules = np.concatenate(sides) if sides else np.zeros((0, 2), np.int64)
    return symbols, last, rules[:, 0], rules[:, 1]


def _placed(seen: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key in ``seen``; -1 if it isn't there.  A table by hash, and a search for those that share a slot."""
    slot = np.full(1 << 18, -1, np.int64)
    factor, drop = (np.uint32(0x9E3779B1), np.uint32(14)) if seen.dtype == np.uint32 else (_BASE, np.uint64(46))
    spread = lambda k: ((k * factor) >> drop).astype(np.int64)
    own = spread(seen)
    slot[own] = np.arange(len(seen))
    at = slot.take(spread(key))
    other = np.flatnonzero((at >= 0) & (seen.take(at, mode="wrap") != key))
    second = np.flatnonzero(slot[own] != np.arange(len(seen)))
    if len(second):
        rest = key.take(other)
        near = second[np.minimum(np.searchsorted(seen[second], rest), len(second) - 1)]
        at[other] = np.where(seen[near] == rest, near, -1)
    else:
        at[other] = -1
    return at


def _one_by_one(live: np.ndarray, second: np.ndarray, at: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places taken pair by pair, by falling counts, where no pair before has taken a symbol; uses of each pair."""
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(counts) + 1))
    taken, uses, gone = np.zeros(len(live), bool), np.zeros(len(counts), np.int64), np.zeros(int(second[-1]) + 1 if len(live) else 0, bool)
    for k in np.argsort(-counts, kind="stable").tolist():
        own = order[bounds[k] : bounds[k + 1]]
        own = own[~gone[live[own]] & ~gone[second[own]]]
        own = own[_alternate(live[own], second[own])]
        if len(own) >= least:
            taken[own], uses[k] = True, len(own)
            gone[live[own]] = gone[second[own]] = True
    return taken, uses


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and their counts."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.diff(first, append=len(key))


def _alternate(places: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Every second one of places that follow each other without a gap; ``second``: the places after them."""
    turn = np.arange(len(places))
    fresh = np.concatenate(([True], places[1:] != second[:-1])) if len(places) else np.zeros(0, bool)
    return (turn - np.maximum.accumulate(np.where(fresh, turn, 0))) % 2 == 0 if len(places) else fresh


def _every_second(level: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Of runs of equally frequent overlapping pairs, whose first is ``taken``, every second further place."""
    run = np.zeros(len(level), bool)
    place = np.flatnonzero(level & ~taken)
    if len(place):
        fresh = np.concatenate(([True], np.diff(place) != 1))
        head = place[fresh][np.cumsum(fresh) - 1]
        run[place[taken[head - 1] & (head > 0) & ((place - head) % 2 == 1)]] = True
    return run


def pack(doc_ids: np.ndarray, named: np.ndarray, ids: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """One file record of whole documents (each with its end id); ``named`` is false for null ids."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    width = symbol_width(base)
    symbols, last, left, right = pair_rules(ids.copy(), last, base, width)
    lens = [1] * base
    for x, y in zip(left.tolist(), right.tolist(), strict=True):  # sides are always older than the rule
        lens.append(lens[x] + lens[y])
    kind = f"<u{width}"
    return b"".join(
        [
            _HEAD.pack(MAGIC, len(doc_ids), len(left), len(symbols), base, width),
            doc_ids.astype("<i8").tobytes(),
            named.astype(np.uint8).tobytes(),
            np.concatenate(([0], np.flatnonzero(last) + 1)).astype("<u4").tobytes(),
            left.astype(kind).tobytes(),
            right.astype(kind).tobytes(),
            np.array(lens[base:], "<u4").tobytes(),
            symbols.astype(kind).tobytes(),
        ]
    )


class Record:
    """A packed record; documents are decoded one by one or all together."""

    def __init__(self, payload: bytes):
        magic, docs, rules, n, self.base, width = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a record of this format")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, count, at)
            at += got.nbytes
            return got

        self.doc_ids, self.named, self.bounds = take("<i8", docs), take("u1", docs) > 0, take("<u4", docs + 1).astype(np.int64)
        left, right, lens = take(f"<u{width}", rules), take(f"<u{width}", rules), take("<u4", rules).astype(np.int64)
        self.symbols = take(f"<u{width}", n).astype(np.int64)
        self.lens = np.concatenate((np.ones(self.base, np.int64), lens))
        self.starts = np.concatenate((np.arange(self.base), self.base + np.cumsum(lens) - lens))
        self.flat = np.empty(self.base + int(lens.sum()), "<u4")
        self.flat[: self.base] = np.arange(self.base)
        left, right = left.astype(np.int64), right.astype(np.int64)
        depth = np.zeros(self.base + rules, np.int64)
        while True:  # rules of equal depth are expanded together
            new = 1 + np.maximum(depth[left], depth[right])
            if (new == depth[self.base :]).all():
                break
            depth[self.base :] = new
        for level in range(1, int(depth.max()) + 1):
            own = np.flatnonzero(depth[self.base :] == level)
            sides = np.stack([left[own], right[own]], 1).ravel()
            to = ragged(self.starts[self.base + own], lens[own])
            self.flat[to] = self.flat[ragged(self.starts[sides], self.lens[sides])]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[symbols], self.lens[symbols])]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, without touching the others."""
        return self.expand(self.symbols[self.bounds[k] : self.bounds[k + 1]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each document."""
        ends = np.concatenate(([0], np.cumsum(self.lens[self.symbols])))[self.bounds]
        return self.expand(self.symbols), np.diff(ends)


_encoders: dict[str, AtomEncoder] = {}


def encoder_of(path: str) -> AtomEncoder:
    """The worker's own encoder, which knows the pieces of its earlier tasks.

    Workers take a module's function from the module; a table named in a nested function would come to
    each task as an empty copy.
    """
    if path not in _encoders:
        _encoders[path] = AtomEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, segment_tokens: int = 256_000) -> DataFrame:
    """Encode and pack all documents; returns the written table of records (see RECORD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, part = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        base = own.library.get_vocab_size(with_added_tokens=True)
        held: list[tuple[np.ndarray, ...]] = []
        size = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, part, before
            doc_ids, named, ids, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "first": before, "n_docs": len(doc_ids), "n_tokens": len(ids), "payload": pack(doc_ids, named, ids, counts, base)}], schema)
            held, size, part, before = [], 0, part + 1, before + len(ids)
            return row

        for batch in sliced(batches, chars=500_000):
            ids, counts = own.encode(*texts_of(batch.column(1)))
            ended = np.full(len(ids) + len(counts), end_id, np.int32)
            keep = np.ones(len(ended), bool)
            keep[np.cumsum(counts + 1) - 1] = False
            ended[keep] = ids
            own_ids = batch.column(0)
            held.append((own_ids.fill_null(0).to_numpy(), own_ids.is_valid().to_numpy(zero_copy_only=False), ended, counts + 1))
            size += len(ended)
            if size >= segment_tokens:
                yield flush()
        if held:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    # The beginning of a text orders as the text does, and keeps what the range sampler gathers small.
    laid = id_text(docs).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return materialise(laid.mapInArrow(run, RECORD), "token-records", compression="zstd")


def read_tokens(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                record = Record(batch.column(1)[i].as_buffer())
                ids, counts = record.documents()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e].data) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                first = batch.column(0)[i].as_py()
                doc_ids = pa.array(record.doc_ids, mask=~record.named)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each shard, of which there are as many as partitions wrote: broadcast, so payloads stay where they are.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = records.join(F.broadcast(shards), "shard").select((F.col("first") + F.col("before")).alias("first"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
