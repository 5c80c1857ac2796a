"""A worker's tasks share one encoder, whose dictionary is bounded and of no fixed room."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from motionloom.llm import token_binary

BPE = "/opt/tokenizers/byte_bpe_50k.json"


def encoded(encoder, texts):
    ids, counts = encoder.encode(*token_binary.texts_of(pa.array(texts)))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_tasks_of_a_worker_share_their_encoder(spark, monkeypatch):
    sent, made = [], []
    first = token_binary.AtomEncoder.__init__

    def noted(self, *args, **options):
        made.append(self)
        first(self, *args, **options)

    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, func, schema: sent.append(func))
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, func, schema: sent.append(func))
    monkeypatch.setattr(token_binary, "materialise", lambda *args, **options: None)
    token_binary.write_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), BPE)
    monkeypatch.setattr(token_binary.AtomEncoder, "__init__", noted)
    monkeypatch.setattr(TaskContext, "get", lambda: Task())
    token_binary._encoders.clear()
    data = cloudpickle.dumps(sent[0])
    rows = []
    for text in ("some words", "some words and more"):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
        rows += [r for made_batch in cloudpickle.loads(data)(iter([batch])) for r in made_batch.to_pylist()]
    token_binary._encoders.clear()
    assert len(rows) == 2 and len(made) == 1


@pytest.mark.parametrize("bits", [4, 10])
def test_a_text_of_more_pieces_than_slots(bits):
    encoder = token_binary.AtomEncoder(BPE, table_bits=bits)
    texts = [" ".join(f"word{k:x}q don't{k}" for k in range(3000)), "", "ünï – 42 🙂🙂 end\n", "word1 word2"]
    for _ in range(2):
        assert encoded(encoder, texts) == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.filled == np.count_nonzero(encoder.keys) <= len(encoder.keys) // 2


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(token_binary.AtomEncoder, "MOST", (500, 20_000, 70_000))
    encoder = token_binary.AtomEncoder(BPE, table_bits=4)
    # Words, long pieces, pieces without entries of their own (white space of other scripts), long texts.
    kinds = [lambda k: " ".join(f"x{j}y" for j in range(k, k + 90)), lambda k: "'" * 3000 + str(k), lambda k: " ".join(f"a{j}　b" for j in range(k, k + 90)), lambda k: f" \t{k} word" * 20_000]
    for kind in kinds:
        for k in range(0, 1500, 250):
            text = kind(k)
            assert encoded(encoder, [text]) == [encoder.library.encode(text, add_special_tokens=False).ids]
            assert encoder.filled <= 500 and encoder.raw_used <= 20_000 and len(encoder.flat) <= 70_000


def test_powers_of_one_long_text_are_not_kept():
    encoder = token_binary.AtomEncoder(BPE)
    text = "many words " * 400_000
    assert encoded(encoder, [text]) == [encoder.library.encode(text, add_special_tokens=False).ids]
    assert len(encoder.powers) <= 1 << 22
    assert encoded(encoder, ["more words"]) == [encoder.library.encode("more words", add_special_tokens=False).ids]
