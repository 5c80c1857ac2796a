"""Fill-in-the-middle, packing and conversation repair against brute force; odd inputs."""

import collections
import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionloom.llm import best_fit, conversation_repair
from motionloom.llm.conversation_repair import audit_of, cost_of, damage, repair
from motionloom.llm.fill_middle import fill_middle, restored, unit_lists

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "ab", "x  y", "日本語 テキスト", "🙂🙂é", "a\0b", "has <P> in it", "<S>", "x<M>", "<", "<P", "S>", "a<b>c<P", "line one\nline two\r\nthree\n", "word " * 3000, "same", "same"]
SCHEMA = "doc_id long, text string, n int, form string, output string, row long, piece int, length long, rank int, free int"


def table_of(spark, texts, ids=None):
    return spark.createDataFrame([(ids[k] if ids else k, t, 1, "f", "o", 2, 3, 4, 5, 6) for k, t in enumerate(texts)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def middle_by_hand(doc, text, units):
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("unit", ["char", "line"])
def test_fill_middle(spark, unit):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(["a", "é", "日", "🙂", "<", "P>", "S", "\n", " "], k=rng.randint(0, 40))) for _ in range(300)]
    ids = [None, *range(1, len(texts) - 1), -5]
    made = fill_middle(table_of(spark, texts, ids), unit=unit, batch_chars=300)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = []
    for doc, t in zip(ids, texts):
        t = t or ""
        units = list(t) if unit == "char" else [line + "\n" for line in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
        want.append((doc, *middle_by_hand(doc, t, units), t))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_of_an_empty_table_and_other_units(spark):
    assert fill_middle(table_of(spark, ["x"]).where("false")).count() == 0
    with pytest.raises(ValueError):
        fill_middle(table_of(spark, ["x"]), unit="word")
    texts = pa.array(["skip", "añb", "", "c"])[1:]
    assert unit_lists(texts).to_pylist() == [["a", "ñ", "b"], [], ["c"]]


def test_fill_middle_of_a_very_long_text(spark):
    text = "naïve words, " * 80_000
    got = fill_middle(table_of(spark, [text, "after"], [1, 2])).withColumn("back", restored(F.col("output"), F.col("form"))).orderBy("doc_id").collect()
    assert (got[0].n, got[0].back) == (len(text), text) and got[1].back == "after"


def best_fit_by_hand(sizes, capacity):
    """Best fit decreasing, piece by piece: the number of sequences."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


def sequences_of(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_takes_every_piece_once(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    texts = ODD + ["many words here " * k for k in (1, 5, 20, 21, 22, 60)] * 2
    ids = [None, None, *range(2, len(texts))]
    pieces = best_fit.cut_pieces(table_of(spark, texts, ids), BPE, capacity=64)
    packed = best_fit.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=64, cells=4)
    got = packed.collect()
    want = []
    for doc, t in zip(ids, texts):
        own = lib.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(own) if len(own) <= 64 else len(own) % 64 or 64
        for k, at in enumerate([0, *range(first, len(own), 64)]):
            part = own[at : first if k == 0 else at + 64]
            want.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=lambda r: (r[0] or -1, *r[1:])) == sorted(want, key=lambda r: (r[0] or -1, *r[1:]))
    assert sequences_of(got, 64) <= best_fit_by_hand([r.length for r in got], 64)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_as_tight_as_best_fit(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 33, 400), rng.integers(1, 5, 500), np.full(300, 9), np.concatenate((np.full(200, 17), rng.integers(1, 16, 200)))][seed].tolist()
    rows = spark.createDataFrame([(k, 0, int(s)) for k, s in enumerate(sizes)], "row long, piece int, length long")
    got = best_fit.pack_pieces(rows, capacity=32, cells=3).collect()
    assert sorted((r.row, r.length) for r in got) == list(enumerate(sizes))
    assert sequences_of(got, 32) <= best_fit_by_hand(sizes, 32)


def test_packing_of_nothing_and_the_sequences_themselves(spark):
    none = best_fit.cut_pieces(table_of(spark, ["x"]).where("false"), BPE)
    assert best_fit.pack_pieces(none.drop("ids")).count() == 0
    pieces = best_fit.cut_pieces(table_of(spark, ["a b c", None, "d e f g " * 30]), BPE, capacity=50).cache()
    packed = best_fit.pack_pieces(pieces.drop("ids"), capacity=50)
    parts = {(r.row, r.piece): bytes(r.ids) for r in pieces.collect()}
    want = collections.defaultdict(bytes)
    for r in sorted(packed.collect(), key=lambda r: r.offset):
        want[r.sequence_id] += parts[r.row, r.piece]
    got = {r.sequence_id: (r.length, bytes(r.ids)) for r in best_fit.packed_sequences(pieces, packed).collect()}
    assert got == {k: (len(v) // 4, v) for k, v in want.items()}


def test_a_sweep_moves_every_gap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        waiting, gaps = np.bincount(rng.integers(1, 17, rng.integers(1, 40)), minlength=17), np.bincount(rng.integers(1, 16, rng.integers(0, 20)), minlength=17)
        before, gap_count = waiting.copy(), gaps.copy()
        sweep = best_fit.Sweep(waiting, placed := np.zeros(17, np.int64), gaps)
        assert (placed + sweep.waiting == before).all() and placed.sum() > 0
        gap_count[16] += sweep.opened
        for free in range(17):
            own = sorted((first, count) for f, first, count, *_ in sweep.moves if f == free)
            assert [x for first, count in own for x in range(first, first + count)] == list(range(gap_count[free]))


def cheapest(codes):
    """The least audit of least cost, by search over all edits."""
    heap = [(0, "", 0, 0)]
    done = set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(codes) and state in (0, 3):
            return cost, audit
        if (at, state) in done:  # reached before, cheaper or by a less audit
            continue
        done.add((at, state))
        to, wanted = (2, "u") if state != 2 else (3, "a")
        heapq.heappush(heap, (cost + 3, audit + "I", at, to))
        if at < len(codes):
            code = codes[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if code not in "bd":
                more = cost + 3 * code.isupper()
                heapq.heappush(heap, (more + 3, audit + "R", at + 1, to))
                if code.lower() == wanted:
                    heapq.heappush(heap, (more, audit + "K", at + 1, to))
                elif code.lower() == "s" and state == 0:
                    heapq.heappush(heap, (more, audit + "K", at + 1, 1))


def test_audits_are_the_least_of_the_cheapest():
    rng = random.Random(1)
    cases = ["".join(c) for n in range(4) for c in itertools.product("suaxSUAXbd", repeat=n)]
    cases += ["".join(rng.choices("suaxSUAXbduaua", k=rng.randint(4, 30))) for _ in range(2500)]
    for codes in cases:
        audit = audit_of(codes)
        assert (cost_of(codes, audit), audit) == cheapest(codes), codes


def repaired_by_hand(rows):
    """Counts, audit and digest of one conversation's rows (turn, role, text), by the plain rules."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = sorted({t for t, _, _ in rows if t is not None})
    seen, codes, white = set(), "", " \t\n\v\f\r"
    for _, role, text in rows:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        body = text.strip(white)
        codes += "b" if not body else "d" if (role, text) in seen else initial if body[-1] in ".!?" else initial.upper()
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(codes)
    state, lines, left = 0, [], iter(rows)
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "D":
            continue
        to, name = (2, "user") if state != 2 else (3, "assistant")
        lines.append(f"{row[1] if edit == 'K' else name}:{row[2] if row else ''}")
        state = 1 if edit == "K" and row[1][:1] == "s" else to
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    return gaps, codes.count("b"), codes.count("d"), sum(c.isupper() for c in codes), illegal, cost, audit, sha("\n".join(lines))


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        elif draw == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        own += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


@pytest.mark.parametrize("most_rows,most_chars", [(4096, 4_000_000), (1, 10), (3, 40)])
def test_conversations_by_hand(spark, most_rows, most_chars):
    rng = random.Random(most_rows)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.choice([1, 2, 5, 8, 30])):
            rows.append((conv, rng.choice([None, rng.randint(-2, 12), rng.randint(0, 40)]), rng.choice([None, "", "system", "user", "assistant", "assistant", "user", "tool", "User"]), rng.choice([None, "", "\t\n", "Yes.", "Yes.", "No", "Why?\n ", "é! ", "a ", f"t{rng.random()}."])))
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(500)] + [(71, 5, "user", "w " * 100_000)] * 3
    data = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part int, codes string, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in repair(damage(data), most_rows, most_chars).collect()}
    assert got == {conv: repaired_by_hand(own) for conv, own in damaged_by_hand(rows).items()}


def test_conversations_without_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert repair(damage(spark.createDataFrame([], kind))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    r = repair(damage(spark.createDataFrame([(9, gone, "user", "Hi.")], kind))).first()
    assert tuple(r) == (9, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_steps_are_remembered():
    audit_of("uauaSUAbd" * 4000)
    assert conversation_repair._forward_step.cache_info().currsize < 2_000


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_best_fit_packing", "op13_conversation_repair"])
def test_queries_match_sql(spark, name):
    import duckdb

    from motionloom.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    if name not in queries.oracle_sql():
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        rows = got.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
        assert sequences_of(rows, 2048) <= best_fit_by_hand([r.length for r in rows], 2048)
        return
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


@pytest.mark.parametrize("shards", [8, 300])
def test_no_virtual_node_is_lost(spark, shards):
    from motionloom.llm import shard_ring

    ring = shard_ring.ring_positions(spark, shards, 64)
    bits = shard_ring.ring_bits(shards, 64)
    arcs = ring.groupBy("arc").agg(F.count("*").alias("n"), F.min("owner").alias("owner"), F.max("owner").alias("other")).collect()
    assert len(arcs) == 64 * shards and sum(r.n for r in arcs) == 1 << bits and all(r.owner == r.other for r in arcs)
    assert set(collections.Counter(r.owner for r in arcs).values()) == {64}
    part = collections.Counter()
    for r in arcs:
        part[r.owner] += r.n
    assert max(part.values()) < 2 * (1 << bits) / shards
