"""Repair of conversations: the cheapest edits that make roles alternate, by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``, a machine of four states (start, after
the system, after the user, after the assistant).  Rows are kept, given another role, deleted or put in
between.  For a run of rows, a forward vector holds the least cost of reaching each state, a backward vector
the least cost of ending well from each; the two meet in the middle of the conversation, the crossing
whose audit is least in ASCII among the cheapest is chosen, and both halves are solved alone.  So no
table of all rows and states is kept.

Which of two cheapest audits is less is known without the audits: those that reach different states over the same
rows never begin with each other, as each ends with the edit of the last row, so the forward vector
carries the order of its four audits.  Differences inside a vector are few, so its steps are remembered.

Rows are sorted by ranges of (conv_id, turn), so a very long conversation is spread over tasks; it is cut into
chunks of bounded size, and only the chunks' codes (a character a row, as the audit itself has) meet
in one place.  The repaired text is then hashed chunk by chunk, in order, as a digest of one conversation must be.

Nulls of id and turn stay null, null ids being one conversation; null roles and texts are one space.
Null turns come first, equal turns are taken by role and text.  Repeated rows are duplicates of each
other.  Empty and very long texts are rows like any other.  Roles count by their first character; a
row whose role has another one than s, u or a can't be kept as it is.  Further columns are never read, so their
names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_NEXT, _WANTED = (2, 2, 3, 2), "uuau"  # by state: the state after the role that may follow, and that role
_CLOSING = ("", "II", "I", "")  # what ends a conversation well, by state
_FAR = 1 << 60
#: A row's code is its role's initial (other ones: x), in upper case if the row is truncated; blank and repeated rows are b and d.
_NAMES = {"u": "user", "a": "assistant"}
_INK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _tiny(code: str, state: int) -> Iterator[tuple[int, int, str]]:
    """Cost, state and edits of every way to take one row from a state."""
    for inserts in range(3):
        paid, made = INSERT * inserts, "I" * inserts
        yield paid + DELETE, state, made + "D"
        if code not in "bd":
            more, role = paid + TRUNCATED * code.isupper(), code.lower()
            yield more + REROLE, _NEXT[state], made + "R"
            if role == _WANTED[state]:
                yield more, _NEXT[state], made + "K"
            elif role == "s" and state == 0:
                yield more, 1, made + "K"
        state = _NEXT[state]


@lru_cache(maxsize=1 << 16)
def _forward_step(costs: tuple[int, ...], ranks: tuple[int, ...], code: str, onward: bool) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    best: dict[int, tuple[int, int, str]] = {}
    for state in range(4):
        if costs[state] < _FAR:
            for cost, to, made in _tiny(code, state):
                way = (costs[state] + cost, ranks[state], made)
                if to not in best or way < best[to]:
                    best[to] = way
    if onward and 3 in best:
        # After the assistant all is possible that is at the start, but for keeping a system row (or deleting it),
        # and all that is after the system; so states that cost more than that never win.
        best = {s: way for s, way in best.items() if s > 1 or way[0] <= best[3][0] + DELETE * (s == 0)}
    order = sorted(best, key=lambda to: best[to][1:])
    low = min(way[0] for way in best.values())
    return low, tuple(best[s][0] - low if s in best else _FAR for s in range(4)), tuple(order.index(s) if s in best else 4 for s in range(4))


@lru_cache(maxsize=1 << 16)
def _backward_step(costs: tuple[int, ...], code: str) -> tuple[int, tuple[int, ...]]:
    found = [min([_FAR, *(cost + costs[to] for cost, to, _ in _tiny(code, state) if costs[to] < _FAR)]) for state in range(4)]
    low = min(found)
    return low, tuple(c - low if c < _FAR else _FAR for c in found)


def forward(codes: str, start: int, onward: bool) -> tuple[list[int], tuple[int, ...]]:
    """Least cost of reaching each state over the rows, and the order of the states' least audits.

    ``onward``: what follows does not end at the start or after the system, so states that can't win are left out.
    """
    costs, ranks, paid = tuple(0 if s == start else _FAR for s in range(4)), (0, 0, 0, 0), 0
    for code in codes:
        low, costs, ranks = _forward_step(costs, ranks, code, onward)
        paid += low
    return [c + paid if c < _FAR else _FAR for c in costs], ranks


def backward(codes: str, end: int | None) -> list[int]:
    """Least cost from each state over the rows to ``end``, or to a good end of the conversation."""
    costs, paid = tuple(INSERT * len(_CLOSING[s]) if end is None else 0 if s == end else _FAR for s in range(4)), 0
    for code in reversed(codes):
        low, costs = _backward_step(costs, code)
        paid += low
    return [c + paid if c < _FAR else _FAR for c in costs]


def audit_of(codes: str) -> str:
    """The least of the cheapest audits of a conversation's row codes."""
    done: list[str] = []
    work: list[tuple[int, int, int, int | None]] = [(0, len(codes), 0, None)]
    while work:
        lo, hi, start, end = work.pop()
        if hi == lo:
            done.append(_CLOSING[start])
        elif hi == lo + 1:
            ways = [(cost + INSERT * len(_CLOSING[to]), made + _CLOSING[to]) if end is None else (cost, made) for cost, to, made in _tiny(codes[lo], start) if end is None or to == end]
            done.append(min(ways)[1])
        else:
            mid = (lo + hi) // 2
            costs, ranks = forward(codes[lo:mid], start, end is None or end > 1)
            rest = backward(codes[mid:hi], end)
            cross = min((costs[s] + rest[s], ranks[s], s) for s in range(4) if costs[s] < _FAR and rest[s] < _FAR)[2]
            work += [(mid, hi, cross, end), (lo, mid, start, cross)]
    return "".join(done)


def cost_of(codes: str, audit: str) -> int:
    """What an audit costs."""
    rows = iter(codes)
    paid = 0
    for edit in audit:
        code = next(rows) if edit != "I" else ""
        paid += INSERT if edit == "I" else DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * code.isupper()
    return paid


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage, by the checksum of ``conv_id:turn``; dropped rows stay as rows with a null role.

    Nulls count as one space in the checksum, and null roles and texts become one.
    """
    id_, turn = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    draw = F.crc32(F.encode(F.concat(id_, F.lit(":"), turn), "UTF-8")) % 20
    hurt = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    whose = F.when(draw == 0, F.lit(None)).when(draw == 4, F.lit("user")).otherwise(role)
    times = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), whose.alias("role"), F.when(draw == 0, F.lit(None)).otherwise(hurt).alias("text"), F.explode(times).alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """Adds ``initial``, ``again`` (role and text seen earlier) and ``code``; dropped rows have none of them."""
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    first = F.substring("role", 1, 1)
    rows = rows.withColumns({"initial": F.when(F.col("role").isNotNull(), F.when(first.isin("s", "u", "a"), first).otherwise("x")), "again": F.row_number().over(seen) > 1})
    whole = F.when(F.col("text").rlike(_ENDED), F.col("initial")).otherwise(F.upper("initial"))
    return rows.withColumn("code", F.when(~F.col("text").rlike(_INK), "b").when(F.col("again"), "d").otherwise(whole))


_CHUNK = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("codes", pa.string()), ("initials", pa.string()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_CHUNKS = "conv_id long, part int, no int, codes string, initials string, turns long, first_turn long, last_turn long, roles array<string>, texts array<string>"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SOLVED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())])
_RESULT = _SOLVED.append(pa.field("repaired_sha256", pa.string()))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _chunks(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Sorted rows as chunks of one conversation each; a chunk counts its distinct turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, size = TaskContext.get().partitionId(), 0, 0
        own: dict | None = None
        ready: list[dict] = []
        for batch in batches:
            for conv, turn, role, text, initial, code in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None or own["conv_id"] != conv or len(own["texts"]) >= most_rows or size >= most_chars:
                    own, no = {"conv_id": conv, "part": part, "no": no, "codes": "", "initials": "", "turns": 0, "first_turn": None, "last_turn": None, "roles": [], "texts": []}, no + 1
                    if len(ready) >= 500 or size >= most_chars:
                        yield pa.RecordBatch.from_pylist(ready, _CHUNK)
                        ready, size = [], 0
                    ready.append(own)
                if role is None:  # the row is gone, its conversation is not
                    continue
                own["codes"] += code
                own["initials"] += initial
                own["roles"].append(role)
                own["texts"].append(text)
                size += len(text)
                if turn is not None and turn != own["last_turn"]:
                    own["turns"] += 1
                    own["first_turn"] = turn if own["first_turn"] is None else own["first_turn"]
                    own["last_turn"] = turn
        if ready:
            yield pa.RecordBatch.from_pylist(ready, _CHUNK)

    return rows.mapInArrow(run, _CHUNKS)


def summary(chunks: list[dict]) -> dict:
    """Counts, audit and cost of a conversation from its chunks, in order, without their texts."""
    codes, initials = "".join([c["codes"] for c in chunks]), "".join([c["initials"] for c in chunks])
    turns, first, last = 0, None, None
    for c in chunks:
        if c["turns"]:
            turns += c["turns"] - (c["first_turn"] == last)
            first, last = c["first_turn"] if first is None else first, c["last_turn"]
    audit = audit_of(codes)
    return {
        "gaps": 0 if first is None else last - first + 1 - turns,
        "blank": codes.count("b"),
        "duplicate": codes.count("d"),
        "truncated": sum(map(str.isupper, codes)),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost_of(codes, audit),
        "audit": audit,
    }


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = batch.slice(at, 200).to_pylist()
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], **summary(sorted(r["chunks"], key=lambda c: (c["part"], c["no"])))} for r in rows], _SOLVED)


class Repaired:
    """The digest of a conversation's repaired lines, fed row by row with its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, 0, hashlib.sha256(), False

    def _line(self, role: str | None, text: str) -> str:
        wanted = _WANTED[self.state]
        self.state = 1 if role is not None and role[:1] == "s" else _NEXT[self.state]
        line = ("\n" if self.begun else "") + f"{_NAMES[wanted] if role is None else role}:{text}"
        self.begun = True
        return line

    def _inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._line(None, "")

    def rows(self, roles: list[str], texts: list[str]) -> None:
        lines: list[str] = []
        for role, text in zip(roles, texts, strict=True):
            lines += self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                lines.append(self._line(role if edit == "K" else None, text))
        self.digest.update("".join(lines).encode("utf-8", "surrogatepass"))

    def sha256(self) -> str:
        self.digest.update("".join(self._inserted()).encode())
        return self.digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, of each conversation its audit and then its chunks: the result with the digests."""
    head: dict | None = None
    own = Repaired("")
    for batch in batches:
        ended: list[dict] = []
        for row in batch.to_pylist():
            if row["part"] >= 0:
                own.rows(row["roles"], row["texts"])
                continue
            if head is not None:
                ended.append(head | {"repaired_sha256": own.sha256()})
            head, own = {k: row[k] for k in _SOLVED.names}, Repaired(row["audit"])
        yield pa.RecordBatch.from_pylist(ended, _RESULT)
    if head is not None:
        yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": own.sha256()}], _RESULT)


def repair(rows: DataFrame, most_rows: int = 4096, most_chars: int = 4_000_000) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``rows`` holds conv_id, turn, role and text; a row with a null role has been dropped, and only keeps
    its conversation in the result.
    """
    turn = F.col("turn").asc_nulls_first()
    laid = _coded(rows).repartitionByRange("conv_id", turn).sortWithinPartitions("conv_id", turn, "role", "text", "again")
    chunks = materialise(_chunks(laid.select("conv_id", "turn", "role", "text", "initial", "code"), most_rows, most_chars), "conversation-chunks")
    # Two characters a row of a conversation meet here, as one does in the audit that is asked for.
    narrow = chunks.groupBy("conv_id").agg(F.collect_list(F.struct("part", "no", "codes", "initials", "turns", "first_turn", "last_turn")).alias("chunks"))
    solved = narrow.mapInArrow(_solve, _ddl(_SOLVED))
    audits = solved.withColumns({"part": F.lit(-1), "no": F.lit(-1), "roles": F.lit(None).cast("array<string>"), "texts": F.lit(None).cast("array<string>")})
    held = chunks.select("conv_id", *[F.lit(None).cast(kind).alias(c) for c, kind in solved.dtypes[1:]], "part", "no", "roles", "texts")
    return audits.unionByName(held).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(_hashed, _ddl(_RESULT))
