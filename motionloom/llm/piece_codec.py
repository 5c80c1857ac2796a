"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into a normaliser (its character map, white space, U+2581 for spaces,
a leading one), a trie of piece arcs, and byte or unknown arcs for characters that no piece covers.
Encoding composes the machine with the input on the fly and relaxes the arcs in the tropical
semiring, place by place; the cheapest path gives the pieces.

An arc costs minus its piece's score.  Of a unigram model that is all.  A BPE model is composed with
one more machine, which remembers the last piece: a pair of pieces costs nothing if it is stable under
the model's merges and infinity otherwise.  (Scores alone would not give the merges' result.)  Each
prefix then has one path of finite cost, the model's own encoding of it.

No piece continues after a character into U+2581, so the machine is back at its start at every
word; words are composed once and kept in a dictionary of bounded size.  Of equally cheap paths the
one whose last arc starts first is taken; costs are doubles.

Null and empty texts give no pieces and decode to the empty string.  Invalid byte sequences of
pieces decode to U+FFFD.  Rows without an id keep a null id; repeated rows give repeated results.
Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, id_text, sliced
from .token_binary import ragged

INFINITY = float("inf")
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict:
    """A model's compiled character map as a trie of characters; the empty key holds what replaces a path.

    The file has the size of a double array, its units, and the replacements, each ended by a zero.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, strings = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    below = (units >> 10) << ((units & 512) >> 6)
    labels, every = units & 0x800000FF, np.arange(1, 256)
    trie: dict = {}
    open_ = [(int(below[0]), b"")]
    while open_:
        base, path = open_.pop()
        at = base ^ every
        inside = at < len(units)
        for byte in every[inside][labels[at[inside]] == every[inside]].tolist():
            unit, child, own = int(units[base ^ byte]), base ^ byte ^ int(below[base ^ byte]), path + bytes([byte])
            if unit >> 8 & 1:  # a path ends here
                start, node = int(units[child]) & 0x7FFFFFFF, trie
                for c in own.decode():
                    node = node.setdefault(c, {})
                node[""] = strings[start : strings.index(b"\0", start)].decode()
            open_.append((child, own))
    return trie


class PieceMachine:
    """The compiled transducer of one model file."""

    def __init__(self, path: str, cache_size: int = 450_000, pair_size: int = 300_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        settings: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for field, value in _fields(open(path, "rb").read()):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif field == 2:
                settings = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.bpe = settings.get(3, 1) == 2
        if settings.get(3, 1) not in (1, 2) or settings.get(24, 0) or self.bpe and _UNUSED in kinds:
            raise ValueError("word and character models, spaces at the end of pieces and unused BPE pieces are not supported")
        self.map, self.squeeze = character_map(normaliser.get(2, b"")), bool(normaliser.get(4, 1))
        self.space = SPACE if normaliser.get(5, 1) else " "
        self.prefix = self.space if normaliser.get(3, 1) else ""
        self.fallback = bool(settings.get(35, 0))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (_NORMAL, _USER)}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif k == _UNKNOWN:
                self.unknown = i
                self.raw.append(settings.get(44, " \u2047 ".encode()))
            else:
                self.raw.append(b"" if k == _CONTROL else p.replace(SPACE, " ").encode())
        user = sorted((p for p, k in zip(self.pieces, kinds, strict=True) if k == _USER), key=len, reverse=True)
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        normal = [x for x, k in zip(self.scores, kinds, strict=True) if k == _NORMAL]
        self.spaced = {i for p, i in self.ids.items() if p[:1] == SPACE}
        self.worst = 10.0 - min(normal, default=0.0)
        # A given piece of a unigram model beats any other way to cover its characters.
        self.weights = [0.1 - len(p) * max(normal, default=0.0) if k == _USER and not self.bpe else -x for p, x, k in zip(self.pieces, self.scores, kinds, strict=True)]
        self.by_word = not any(self.space in p.lstrip(self.space) for p in self.ids)
        self.segments = re.compile(f"{self.space}*[^{self.space}]+|{self.space}+$") if self.by_word else re.compile("(?s).+")
        self.trie: dict = {}
        order = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.turn, self.halves = [-1] * len(self.pieces), [(i, i) for i in range(len(self.pieces))]  # when a piece is merged, and of what
        for p, i in self.ids.items():
            if self.bpe:
                parts, joined = self._merge(p)
                if kinds[i] == _USER or parts != [p]:
                    continue  # merges never build it
                if len(p) > 1:
                    self.turn[i], self.halves[i] = order[self.scores[i]], (self.ids.get(p[:joined], -1), self.ids.get(p[joined:], -1))
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        if any(min(h) < 0 or self.turn[i] < max(self.turn[h[0]], self.turn[h[1]]) for i, h in enumerate(self.halves) if self.turn[i] >= 0):
            raise ValueError("a BPE model whose pieces are merged before their halves is not supported")
        self.pair_size, self.cache_size = pair_size, cache_size
        self.forget()

    def forget(self) -> None:
        """Empty the dictionaries of words and pairs."""
        self.stable: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.starts, self.lens, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Keep the words that came up again, at most the half of the dictionary used most."""
        keep = np.zeros(len(self.uses), bool)
        keep[np.argsort(-self.uses, kind="stable")[: self.cache_size // 2]] = True
        keep &= self.uses > 1
        place, kept = (np.cumsum(keep) - 1).tolist(), keep.tolist()
        self.words = {w: place[i] for w, i in self.words.items() if kept[i]}
        self.flat = self.flat[ragged(self.starts[keep], self.lens[keep])]
        self.lens, self.uses = self.lens[keep], self.uses[keep] // 2
        self.starts = np.cumsum(self.lens) - self.lens

    def _merge(self, text: str) -> tuple[list[str], int]:
        """The merges of a BPE model on a short text, best score first, then leftmost; where the last one joined."""
        parts, joined = list(text), 0
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            joined = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, joined

    def allowed(self, left: int, right: int) -> bool:
        """Whether two adjacent pieces of a BPE model stay apart under its merges.

        They do unless two parts beside the border could have merged before one of them grew into its
        piece: the border's parts are followed back, the one that was built last first.  (Of merges of
        equal score the leftmost comes first.)
        """
        key = left * len(self.pieces) + right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= self.pair_size:
                self.stable.clear()
            known = self.stable[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        pieces, ids, turn, halves, limit = self.pieces, self.ids, self.turn, self.halves, INFINITY
        while True:
            both = ids.get(pieces[left] + pieces[right])
            if both is not None and turn[both] < limit:
                return False
            if turn[left] > turn[right]:
                limit, left = turn[left], halves[left][1]
            elif turn[right] >= 0:
                limit, right = turn[right] + 1, halves[right][0]
            else:
                return True

    def shortest_path(self, text: str) -> list[int]:
        """Piece ids of normalised text."""
        out: list[int] = []
        parts = self.user.split(text) if self.bpe and self.user else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.ids[part])
                continue
            for at, piece in self._relaxed(part) if part else ():
                if piece >= 0:
                    out.append(piece)
                elif self.fallback:
                    out.extend(self.bytes[b] for b in part[at].encode("utf-8", "surrogatepass"))
                elif not out or out[-1] != self.unknown:  # unknown characters in a row are one piece
                    out.append(self.unknown)
        return out

    def _relaxed(self, text: str) -> list[tuple[int, int]]:
        """Arcs (start, piece) of the cheapest path; piece -1 stands for a character that no piece covers.

        Arcs are relaxed from an agenda: of a unigram model all of them, place by place; of a BPE model
        those of the places reached, longest first, until the end is.  A place of a BPE model has one
        state of finite cost, so the first path that comes to it is the cheapest.
        """
        n, trie, ids, weights, stable, width, bpe = len(text), self.trie, self.ids, self.weights, self.stable, len(self.pieces), self.bpe
        cost, back, via = [0.0] + [INFINITY] * n, [0] * (n + 1), [-1] * (n + 1)
        agenda: list[tuple[int, int, int]] = []
        for place in (0,) if bpe else range(n - 1, -1, -1):
            self._arcs(text, place, agenda)
        while agenda:
            at, end, piece = agenda.pop()
            if bpe:
                if cost[end] < INFINITY or piece >= 0 and (last := via[at]) >= 0 and not (stable[k] if (k := last * width + piece) in stable else self.allowed(last, piece)):
                    continue  # already there, or at infinite cost
                cost[end], back[end], via[end] = cost[at] + (weights[piece] if piece >= 0 else self.worst), at, piece
                if end == n:
                    break
                if text[end] not in ids:
                    agenda.append((end, end + 1, -1))
                node, to = trie, end
                while to < n:
                    node = node.get(text[to])
                    if node is None:
                        break
                    to += 1
                    if "" in node:
                        agenda.append((end, to, node[""]))
                continue
            total = cost[at] + (weights[piece] if piece >= 0 else self.worst)
            if total < cost[end]:
                cost[end], back[end], via[end] = total, at, piece
        steps, at = [], n
        while at > 0:
            steps.append((back[at], via[at]))
            at = back[at]
        return steps[::-1]

    def _arcs(self, text: str, at: int, agenda: list[tuple[int, int, int]]) -> None:
        """Put the arcs of a place on the agenda, the longest last."""
        if text[at] not in self.ids:
            agenda.append((at, at + 1, -1))
        node, to = self.trie, at
        while to < len(text):
            node = node.get(text[to])
            if node is None:
                break
            to += 1
            if "" in node:
                agenda.append((at, to, node[""]))

    def normalised(self, text: str) -> str:
        """The text as the machine reads it."""
        if self.map:
            kept = self.user.split(text) if self.user else [text]  # given pieces stay as they are
            text = "".join(x if k % 2 else self._mapped(x) for k, x in enumerate(kept))
        if self.squeeze:
            text = re.sub(" +", " ", text).lstrip(" ")
        text = self.prefix + text.replace(" ", self.space) if text else ""
        return text.rstrip(self.space) if self.squeeze else text

    def _mapped(self, text: str) -> str:
        """The longest path of the character map at each place, replaced."""
        out, at, n = [], 0, len(text)
        while at < n:
            node, end, best = self.map, at, (text[at], at + 1)
            while end < n:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                if "" in node:
                    best = node[""], end
            out.append(best[0])
            at = best[1]
        return "".join(out)

    def _learn(self, keys: list[str]) -> None:
        paths = [self.shortest_path(k[1:] if k[0] == "\0" else k if self.space in k else self.space + k) for k in keys]
        lens = np.fromiter(map(len, paths), np.int64, len(paths))
        self.words.update(zip(keys, range(len(self.lens), len(self.lens) + len(keys)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.uses = np.concatenate((self.uses, np.zeros(len(lens), np.int64)))
        self.flat = np.concatenate((self.flat, np.fromiter((i for p in paths for i in p), np.int32, int(lens.sum()))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids, one text after the other, and the number of pieces of each text."""
        words: list[str] = []
        ends = []
        plain = self.by_word and self.prefix == SPACE and not self.map and not self.user
        for text in texts:
            if not text:
                pass
            elif plain and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text and "\0" not in text:
                words += text.split(" ")  # each has one U+2581 in front, left out of its key
            else:
                words += ["\0" + w if "\0" in w or self.space not in w else w for w in self.segments.findall(self.normalised(text))]
            ends.append(len(words))
        missing = set(words).difference(self.words)
        if len(self.words) + len(missing) > self.cache_size:
            self._shrink()
            missing = set(words).difference(self.words)
        if missing:
            self._learn(list(missing))
        index = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self.uses += np.bincount(index, minlength=len(self.uses))
        lens = self.lens[index]
        ids = self.flat[ragged(self.starts[index], lens)]
        counts = np.diff(np.concatenate(([0], np.cumsum(lens)))[np.array(ends, np.int64)], prepend=0)
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of piece ids; the leading space of the normaliser is taken off."""
        raw, out, at = self.raw, [], 0
        every = ids.tolist()
        for n in counts.tolist():
            own = every[at : at + n]
            parts = [raw[i] for i in own]
            if self.prefix or self.squeeze:
                for k, i in enumerate(own):  # with white space squeezed, all spaces in front go
                    if i in self.spaced:
                        parts[k] = parts[k][1:]
                    if parts[k] or not self.squeeze:
                        break
            out.append(b"".join(parts).decode("utf-8", "replace"))
            at += n
        return out


_machines: dict[tuple[str, int, int], PieceMachine] = {}


def machine(path: str, cache_size: int, pair_size: int) -> PieceMachine:
    """One machine for each Python worker, model and size of dictionaries."""
    key = path, cache_size, pair_size
    if key not in _machines:
        _machines[key] = PieceMachine(*key)
    return _machines[key]


def encode_pieces(docs: DataFrame, model_path: str, cache_size: int = 450_000, pair_size: int = 300_000, keep: bool = True) -> DataFrame:
    """doc_id, n_pieces, pieces (ids), decoded (text of the pieces) of every row; no shuffle.

    ``cache_size`` words and ``pair_size`` pairs of pieces are remembered by each Python worker: about
    300 bytes each, for speed only.  With ``keep`` they are remembered from task to task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model_path, cache_size, pair_size)
        for batch in sliced(batches, chars=1_000_000):
            ids, counts = own.encode(batch.column(1).to_pylist())
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(own.decode(ids, counts), pa.string())], ["doc_id", "n_pieces", "pieces", "decoded"])
        if not keep:
            own.forget()
            give_back()

    return id_text(docs).mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, decoded string")
