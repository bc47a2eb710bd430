"""Quality by Bradley-Terry pairwise ranking.

Preference pairs are drawn from labelled documents, a good one before a bad one.
The chance that a document is preferred is the logistic function of the
difference of two scores, which are linear in features of the text; the weights
minimise the logistic loss on feature differences. The threshold is the quantile
of the scores of all documents that leaves out the share that is labelled bad.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.labelled import SAMPLE_ROWS, logistic, sample, sigmoid
from lodestream.llm.scratch import save, without
from lodestream.llm.words import lean, slices

#: Bins of a pass over the scores.
BINS = 4096
#: Preference pairs that the weights are learned from.
PAIRS = 40_000
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")
LETTERS = re.compile(r"[^\W\d_]")


def features(text: str) -> list[float]:
    """Shares and logarithms; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 18
    chars = len(text)
    counts = Counter(words)
    once = sum(1 for c in counts.values() if c == 1)
    same = sum(map(str.__eq__, words, words[1:])) / n
    symbols = (chars - len(SYMBOLS.sub("", text))) / chars
    letters = text.lower() != text and sum(map(str.isupper, words)) / n or 0.0
    digits = sum(map(text.count, "0123456789")) / chars
    lines = text.split("\n")
    ends = sum(line.rstrip().endswith((".", "!", "?", '"', ":")) for line in lines) / len(lines)
    bars = text.count("|") / n
    marks = (text.count("!") + text.count("?")) / n
    stops = (text.count(".") + text.count(",")) / n
    short = sum(len(w) <= 3 for w in words) / n
    length = (chars - n) / n
    distinct = len(counts) / n
    most = counts.most_common(1)[0][1] / n
    return [
        math.log1p(n),
        math.log1p(n) ** 2,
        length,
        abs(length - 5),
        distinct,
        once / n,
        same,
        math.sqrt(same),
        symbols,
        math.sqrt(symbols),
        float(symbols > 0.05),
        letters,
        digits,
        math.sqrt(bars),
        ends,
        math.sqrt(marks),
        abs(stops - 0.25),
        abs(short - 0.35) + most,
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


class Model:
    def __init__(self, mean, scale, weights, cut: float, slope: float) -> None:
        self.mean, self.scale, self.weights, self.cut, self.slope = np.asarray(mean), np.asarray(scale), np.asarray(weights), cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, texts: list[str], threshold: float) -> np.ndarray:
        """In 0 to 1; the threshold where the raw score meets the quantile."""
        x = np.array([features(t) for t in texts]).reshape(-1, len(self.weights))
        return sigmoid(self.slope * (self.raw(x) - self.cut) + math.log(threshold / (1 - threshold)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Model:
    """A model from at most `rows` labelled documents for which train (a condition on _key) holds.

    If all labels are equal, or there are none, there is no pair to learn from:
    the scores are then all equal and at the threshold or below it, as the
    labels are.
    """
    got = sample(docs, labels, "quality", train, key, text, rows).mapInArrow(lean(_featured), "x array<double>, y int").collect()
    width = len(features(""))
    x, y = np.array([r["x"] for r in got]).reshape(-1, width), np.array([r["y"] for r in got])
    # in an order of their own, so that a rerun draws the same pairs
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0 if len(good) else 1.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    drawn = np.random.default_rng(0)
    apart = z[drawn.choice(good, pairs)] - z[drawn.choice(bad, pairs)]
    weights = logistic(apart, np.ones(pairs), 1e-3)
    model = Model(mean, scale, weights, 0.0, 1.0)
    model.cut = quantile(save(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(lean(_raw(model)), "raw double"), "quality-raw"), "raw", len(bad) / len(y))
    # a little lower, so that rounding does not part texts that meet the cut
    model.cut -= 1e-9 * max(1.0, abs(model.cut))
    return model


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(model.weights))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x))], names=["raw"])

    return run


def quantile(df: DataFrame, column: str, share: float) -> float:
    """The value below which this share of all rows lie, exactly and whatever the order of the rows; 0 without rows.

    Rows are counted in bins, and those of the bin that holds the value again,
    until it has one value: a few passes, of which BINS rows each reach the driver.
    """
    v = F.col(column)
    all_ = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if not all_.n:
        return 0.0
    lo, hi, rank = all_.lo, all_.hi, min(all_.n - 1, round(share * all_.n))
    while lo < hi:
        place = F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = df.where((v >= lo) & (v <= hi)).groupBy(place.alias("bin")).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: b.lo):
            if rank < b.n:
                break
            rank -= b.n
        lo, hi = b.lo, b.hi
    return float(lo)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to every document.

    Only the text counts. Null is as empty; a text without words has all
    features zero. Repeated rows get the same score. Input columns named like an
    output are replaced. Without rows the result is empty.
    """
    docs = without(docs, "score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers
    spare = [f"_c{i}" for i in range(len(docs.columns))]
    rows, text_col = docs.toDF(*spare), spare[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            found = own.scores([t or "" for t in batch.column(text_col).to_pylist()], threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "_score"])

    result = rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))
    result = result.select(*[F.col(s).alias(c) for s, c in zip(spare, docs.columns, strict=True)], F.col("_score").alias("score"))
    return result.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
