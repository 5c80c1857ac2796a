"""Benchmarks of long and repeated items: cut into runs, held in blocks, with the same result."""

import numpy as np

from motionloom.llm import decontaminate
from motionloom.llm.decontaminate import clean_of, find_benchmark


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), tuple(map(tuple, r.spans))) for r in df.collect())


def test_long_items_are_cut_without_loss(spark):
    rng = np.random.default_rng(4)
    long = [f"w{k}" for k in range(900)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "short one"), (3, "Ten words, exactly ten, no more; no less than ten!"), (4, None)], "item_id long, text string")
    texts = [" ".join(long[a : a + n]) for a, n in zip(rng.integers(0, 880, 120).tolist(), rng.integers(1, 40, 120).tolist())] + [" ".join(long), "a short one here", "ten words exactly ten no more no less than ten", None, ""]
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    want = rows_of(find_benchmark(docs, bench))
    for runs, block in ((50, 4_000_000), (11, 700), (1, 4_000_000), (400, 3000)):
        assert rows_of(find_benchmark(docs, bench, run_words=runs, block_bytes=block)) == want
        kept = clean_of(docs, bench, run_words=runs, block_bytes=block)
        assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, hit, *_ in want if not hit] and kept.columns == docs.columns
    assert docs.count() == len(texts)


def test_repeated_items_are_one(spark):
    bench = spark.createDataFrame([(7, "the same benchmark text again")] * 400 + [(8, "the same benchmark text again")], "item_id long, text string")
    blocks = decontaminate._blocks(bench, 10, 4_000_000, 5000)
    assert len(blocks) == 1 and blocks[0].count() == 2
    docs = spark.createDataFrame([(1, "The same, benchmark text again.")], "doc_id long, text string")
    assert rows_of(find_benchmark(docs, bench))[0][3] == (7, 8)


def test_blocks_stay_small(spark):
    items = [(k, " ".join(f"{k}x{j}" for j in range(3000))) for k in range(3)] + [(9, "tiny")]
    blocks = decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), 10, 20_000, 100)
    sizes = [sum(len(t) for _, t in decontaminate._held(b)) for b in blocks]
    assert len(blocks) > 5 and max(sizes) <= 20_000
