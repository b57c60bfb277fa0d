"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are worked out in the executors. The trees are grown on the driver from a
bounded sample of labelled rows, on histograms of binned statistics, and flattened into arrays; scoring
walks all rows of a batch through all trees side by side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import answered, extended, fold, materialise, table, without

#: Labelled rows that training takes at most, those with the smallest hash of id and text.
SAMPLE = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LEAF = 8
THRESHOLD = 0.3
_MARKS = b"!#$%&*|.,;:?<>@=/\\_-"
_CLASSES = [range(97, 123), range(65, 91), range(48, 58), range(128, 256), [32], [10], [b for b in range(33, 127) if not chr(b).isalnum()], *[[b] for b in _MARKS]]
NAMES = [f"share_{k}" for k in range(len(_CLASSES))] + [
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeat_next", "upper_words", "mark_ended", "packed", "log_lines", "distinct_lines", "short_words",
]
_IN_CLASS = np.array([[b in c for c in map(set, _CLASSES)] for b in range(256)], np.float32)


def statistics(text: str) -> np.ndarray:
    """A text's statistics, in the order of NAMES; zeros for the empty text."""
    raw = text.encode()
    if not raw:
        return np.zeros(len(NAMES), np.float32)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32) @ _IN_CLASS / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    seen = Counter(words)
    more = [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(w[-1] in b"!#$%&*|" for w in words) / n,
        len(zlib.compress(raw, 1)) / len(raw),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        sum(len(w) <= 3 for w in words) / n,
    ]
    return np.concatenate([shares, np.array(more, np.float32)])


def with_statistics(docs: DataFrame, *, text_col: str = "text", out_col: str = "statistics", keep_text: bool = True) -> DataFrame:
    """docs plus its whole texts' statistics as an array of floats; less the text if ``keep_text`` is false. Null counts as empty; row by row; a column of that name is replaced."""
    whole = without(docs, out_col)
    place = whole.columns.index(text_col)
    less = () if keep_text else (text_col,)
    schema = extended(whole, f"`{out_col}` array<float>", less)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t.as_py() or "") for t in batch.column(place)]
            flat = pa.array(np.concatenate(got) if got else np.zeros(0, np.float32), pa.float32())
            cuts = pa.array(np.arange(len(got) + 1, dtype=np.int32) * len(NAMES))
            yield answered(batch, less, schema, pa.ListArray.from_arrays(cuts, flat))

    return whole.mapInArrow(run, schema)


class Forest:
    """Trees as flat arrays, one row a tree, laid out as binary heaps: feature (-1: a leaf), threshold, value."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.bias, self.feature, self.threshold, self.value = bias, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost trees for the log-loss of labels y (0 or 1). With one label alone, or no row, the forest is its share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    size = 2 ** (DEPTH + 1) - 1
    features, thresholds, values = [], [], []
    bias = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        flat = binned + np.arange(x.shape[1]) * BINS
        margin = np.full(len(y), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            groups = {0: np.arange(len(y))}
            for node in range(size):
                rows = groups.pop(node, None)
                if rows is None:
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = RATE * g / (h + 1)
                if 2 * node + 2 >= size or len(rows) < 2 * LEAF:
                    continue
                cells = flat[rows].ravel()
                many = x.shape[1]

                def hist(w: np.ndarray, cells: np.ndarray = cells, many: int = many) -> np.ndarray:
                    return np.bincount(cells, np.repeat(w, many), many * BINS).reshape(many, BINS).cumsum(1)

                gl, hl, nl = hist(grad[rows]), hist(hess[rows]), hist(np.ones(len(rows)))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-9:
                    continue
                feature[node], threshold[node] = f, edges[f][b]
                left = binned[rows, f] <= b
                groups[2 * node + 1], groups[2 * node + 2] = rows[left], rows[~left]
                value[node] = 0
            tree = Forest(0.0, feature[None], threshold[None], value[None])
            raw = tree.score(x)
            margin += np.log(raw / (1 - raw))
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
    shape = (len(features), size)
    return Forest(bias, np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape), np.array(values).reshape(shape))


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, ids: DataFrame | None = None) -> Forest:
    """Grow the trees from at most ``sample`` rows that have statistics and a non-null label, those with the smallest hash.

    ``ids`` may give the rows' ids where counting them in ``stats`` would cost a pass over texts. Null ids
    and labels are left out, repeated labels all count; without rows the forest scores 0.5.
    """
    marked = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("_label"))
    rows = stats.join(marked, id_col).select("statistics", "_label", F.xxhash64(F.lit(7), F.col(id_col), F.col("statistics")).alias("_at"))
    # Only rows that can be among the smallest hashes are sorted, twice as many as are taken, so that what partitions send to the driver does not grow with their number.
    share = min(1.0, 2 * sample / max(1, (stats if ids is None else ids).select(id_col).join(marked, id_col).count()))
    if share < 1:
        rows = rows.filter(F.col("_at") < int(-(2**63) + share * 2**64))
    got = rows.orderBy("_at", "_label").limit(sample).select("statistics", "_label").toArrow()
    x = np.array(got.column(0).to_pylist(), np.float32).reshape(-1, len(NAMES))
    return grow(x, np.array(got.column(1).to_pylist(), np.float64))


def predict(stats: DataFrame, forest: Forest, *, threshold: float = THRESHOLD) -> DataFrame:
    """stats plus score (probability of label 1) and predicted (1 if score >= threshold); columns of those names are replaced. Row by row; empty in, empty out."""
    whole = without(stats, "score", "predicted")
    place = whole.columns.index("statistics")
    schema = extended(whole, "score double, predicted int")
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(place).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [f.name for f in schema.fields])

    return whole.mapInArrow(run, schema)


def judge(docs: DataFrame, forest: Forest, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score and predicted, in one pass over its whole texts and without a shuffle; columns of those names are replaced.

    Null and empty texts have zero statistics and a score like any other. Row by row, so repeated rows and null ids pass through; empty in, empty out.
    """
    whole = without(docs, "score", "predicted")
    place = whole.columns.index(text_col)
    schema = extended(whole, "score double, predicted int")
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(place)], np.float32).reshape(-1, len(NAMES))
            s = shared.value.score(x)
            yield answered(batch, (), schema, pa.array(s), pa.array((s >= threshold).astype(np.int32)))

    return whole.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """The trees, from the texts and labels of documents where ``train`` holds. Statistics meet the labels, texts are not shuffled. Edge cases are those of fit()."""
    known = docs.filter(train).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return fit(with_statistics(known, text_col="_text", keep_text=False), labels, id_col=id_col, label_col=label_col, ids=known)


def classify(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, row, statistics, score, predicted) for every row of docs, row being the text's xxhash64, learning from the labels of documents where ``train`` holds.

    Null and empty texts have zero statistics and a score like any other. Labels that are null, or of
    unknown or null ids, are ignored; repeated labels all count. Without usable labels every score is
    0.5; with one kind of label every score is its smoothed share. Rows that repeat an id are scored
    each by its own text. Empty in, empty out.
    """
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`"), F.xxhash64(text).alias("row"), text.alias("_text"))
    stats = materialise(with_statistics(slim, text_col="_text", keep_text=False), "statistics")
    return predict(stats, fit(stats.filter(train), labels, id_col=id_col, label_col=label_col))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
