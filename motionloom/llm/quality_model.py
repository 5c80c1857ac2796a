"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes one vector of statistics of its bytes, words and lines (nothing but the text
is an input).  A bounded sample of labelled rows (``sample_rows``, chosen by a hash of the id) is
brought to the driver after its ids have been matched; features are cut into at most ``bins`` quantile bins, and each tree is
grown level by level from gradient histograms.  The trees are flattened into arrays (feature,
threshold, children, value), and all documents of a batch walk all trees at once in numpy.

Null and empty texts have all-zero statistics and get a score like any other.  Without labels of
both classes every score is the share of label 1 (0.5 without any label).  Repeated labels of an
id count by their mean (0.5 or more is 1); repeated documents are scored alike, and all texts of a
labelled id carry its label.  Rows without an id are scored and never learned from.  Further columns
cannot clash: only ids, texts and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, sliced

#: Byte classes whose shares are features.
_CLASSES: dict[str, bytes] = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" ",
    "line_end": b"\n",
    "sentence": b".,;:",
    "exclaim": b"!?",
    "pipe": b"|",
    "marks": b"#*$%&<>=+~^_@\\/",
    "quotes": b"\"'`()[]{}-",
    "high": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_length", "distinct_words", "most_frequent", "distinct_pairs", "short_words", "capital_words", "distinct_lines", "log_line_words", "byte_entropy"]
_GROUPS = np.array([[b in members for members in _CLASSES.values()] for b in range(256)], np.float64)


def statistics(texts: list[str]) -> np.ndarray:
    """The feature matrix of a batch of texts."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), len(FEATURES) - len(_CLASSES)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n = max(len(words), 1)
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        share = counts[i][counts[i] > 0] / len(raw)
        rest[i] = (
            np.log1p(len(raw)),
            np.log1p(len(words)),
            sum(map(len, words)) / n,
            len(seen) / n,
            max(seen.values(), default=0) / n,
            len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
            sum(k for w, k in seen.items() if len(w) <= 3) / n,
            sum(k for w, k in seen.items() if w[0].isupper()) / n,
            len(set(lines)) / max(len(lines), 1),
            np.log1p(len(words) / max(len(lines), 1)),
            -(share * np.log(share)).sum(),
        )
    return np.hstack([counts @ _GROUPS / np.maximum(counts.sum(1, keepdims=True), 1), rest]).astype(np.float32)


class BoostedTrees:
    """Trees flattened into arrays; a leaf points to itself."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.start, self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.depth = start, feature, threshold, left, right, value, roots, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_weight: float = 2.0) -> BoostedTrees:
    """Logistic boosting on histograms of gradients, level by level."""
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    start = float(np.log(p / (1 - p)))
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        n_features, raw, used = x.shape[1], np.full(len(y), start), 0
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            size = 2 ** (depth + 1) - 1
            feature, threshold = np.zeros(size, np.int32), np.full(size, np.inf, np.float32)
            left, right, value = np.arange(size), np.arange(size), np.zeros(size)
            open_ = [0]
            for level in range(depth):
                first = 2**level - 1
                width = 2**level
                active = np.flatnonzero((node >= first) & (node < first + width))
                if not len(active):
                    break
                flat = (((node[active] - first)[:, None] * n_features + np.arange(n_features)) * bins + code[active]).ravel()
                G, H = (np.bincount(flat, np.repeat(w[active], n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(2) for w in (g, h))
                gt, ht = G[:, :, -1:], H[:, :, -1:]
                gain = G**2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt**2 / (ht + ridge)
                gain[(H < least_weight) | (ht - H < least_weight)] = -1
                for k in [o for o in open_ if first <= o < first + width]:
                    f, b = np.unravel_index(np.argmax(gain[k - first]), gain.shape[1:])
                    if gain[k - first, f, b] <= 1e-6 or b >= len(edges[f]):
                        continue
                    feature[k], threshold[k] = f, edges[f][b]
                    left[k], right[k] = 2 * k + 1, 2 * k + 2
                    open_ += [2 * k + 1, 2 * k + 2]
                    own = node == k
                    node[own] = np.where(x[own, f] <= threshold[k], 2 * k + 1, 2 * k + 2)
            G, H = np.bincount(node, g, size), np.bincount(node, h, size)
            value = -rate * G / (H + ridge)
            raw += value[node]
            roots.append(used)
            for part, own in zip(parts, (feature, threshold, left + used, right + used, value), strict=True):
                part.append(own)
            used += size
    joined = [np.concatenate(part) if part else np.zeros(0) for part in parts]
    return BoostedTrees(start, *joined, np.array(roots, np.int64), depth)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = 20_000) -> BoostedTrees:
    """Fit on at most ``sample_rows`` labelled rows of ``docs`` for which ``usable`` (over doc_id) holds.

    Ids are matched first, so only the chosen rows' statistics are computed.
    """
    own = id_text(docs)
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    by = F.xxhash64("doc_id"), F.col("doc_id")
    ids = own.select("doc_id").where(F.lit(True) if usable is None else usable).join(marks, "doc_id").distinct().orderBy(*by).limit(sample_rows)
    rows = own.join(F.broadcast(materialise(ids, "labelled-ids")), "doc_id").orderBy(*by, F.xxhash64("text"), "text").limit(sample_rows)  # at most sample_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = statistics(batch.column(1).to_pylist())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([values, batch.column(2)], ["x", "y"])

    known = rows.select("doc_id", "text", "y").mapInArrow(run, "x array<float>, y int").toPandas()
    x = np.stack(known["x"].to_list()) if len(known) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(np.asarray(x, np.float32), known["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, cut: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row; learns from labelled rows where ``usable`` holds; no shuffle of texts."""
    model = train(docs, labels, usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1).to_pylist())))], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_predicted(docs: DataFrame, labels: DataFrame, usable: Column | None = None, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted to be good: a narrow pass, each row judged by its own text."""
    model = train(docs, labels, usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text=text_col):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(model.score(statistics(texts)) >= cut))

    return docs.mapInArrow(run, docs.schema)
