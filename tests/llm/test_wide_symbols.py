"""Grammars of vocabularies whose symbols take four bytes."""

import numpy as np
import pytest

from motionloom.llm import token_binary


def texts_of_phrases(base, seed=7):
    """Documents of repeated phrases and single ids, every one with end id 2."""
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(3, base, rng.integers(2, 9)) for _ in range(40)]
    docs = []
    for _ in range(120):
        parts = [phrases[k] if rng.random() < 0.8 else rng.integers(3, base, 1) for k in rng.integers(0, 40, rng.integers(0, 12))]
        docs.append(np.concatenate([*parts, [2]]).astype(np.int32))
    return np.concatenate(docs), np.array(list(map(len, docs)))


@pytest.mark.parametrize("base", [57_344, 57_345, 65_535, 65_536, 100_000, 1_000_000])
def test_any_vocabulary_has_rules_and_comes_back(base):
    ids, counts = texts_of_phrases(base)
    record = token_binary.Record(token_binary.pack(np.arange(120), np.ones(120, bool), ids, counts, base))
    assert token_binary.symbol_width(base) == (2 if base <= 57_344 else 4)
    assert len(record.symbols) < len(ids) / 2
    got, sizes = record.documents()
    assert (got == ids).all() and (sizes == counts).all()
    ends = np.cumsum(counts)
    assert all((record.document(k) == ids[ends[k] - counts[k] : ends[k]]).all() for k in (0, 1, 60, 119))


@pytest.mark.parametrize("width,least", [(2, 5), (4, 4)])
def test_no_pair_is_left_that_pays(width, least):
    ids, counts = texts_of_phrases(300)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, ends, left, right = token_binary.pair_rules(ids.copy(), last.copy(), 300, width)
    seen, after = {}, {}
    for i in range(len(symbols) - 1):
        pair = (symbols[i], symbols[i + 1])
        if not ends[i] and after.get(pair) != i:  # places of one pair that do not overlap
            seen[pair] = seen.get(pair, 0) + 1
            after[pair] = i + 1
    assert max(seen.values()) < least
    sides = [(x,) for x in range(300)]
    for x, y in zip(left, right, strict=True):
        sides.append(sides[x] + sides[y])
    assert [x for s in symbols for x in sides[s]] == ids.tolist()


def test_both_widths_make_the_same_symbols_where_both_may_be_used():
    ids, counts = texts_of_phrases(500)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    narrow = token_binary.pair_rules(ids.copy(), last.copy(), 500, 2)
    wide = token_binary.pair_rules(ids.copy(), last.copy(), 500, 4)
    assert len(wide[0]) <= len(narrow[0])  # a rule pays from four occurrences on instead of five


def test_one_hot_id_is_many_tasks_work(spark):
    rows = [(7, f"text number {k}") for k in range(4000)] + [(k, "x") for k in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    laid = token_binary.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "/opt/tokenizers/byte_bpe_50k.json", segment_tokens=2000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in laid.groupBy("shard").agg({"n_docs": "sum"}).toDF("shard", "n").collect()]
    assert sum(sizes) == 4100 and max(sizes) < 4000
    got = token_binary.read_tokens(laid).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r[0] for r in rows)
