"""Quality rules and a calibrated classifier over hashed word and character n-grams.

Words, pairs of words and character triples of a text are hashed into one space of
weights; a text's features are their shares of the text. Logistic regression is
fitted on labelled rows, its margin mapped to a probability by a second regression on
rows the first has not seen. Texts are scored in Arrow batches against fixed limits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.textarrays import Hasher, code_points, mix, owners, runs, word_bounds

# Hashed weights: the first half for words and pairs, the second for characters.
DIMENSIONS = 1 << 14
# Labelled rows the classifier is fitted on, at most; a fifth of them calibrates it.
TRAIN_ROWS = 6000
REGULARIZATION = 1e-4
# Fixed limits.
LEAST_PROBABILITY = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 0.5
SYMBOLS = "#*$%&|<>"

REPORT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, probability double, kept boolean"
)


@dataclass(frozen=True)
class QualityModel:
    """Weights of the hashed features, and the line from margin to log odds."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -700, 700)))


# Without labels of both kinds nothing is known against any text.
KEEP_ALL = QualityModel(np.zeros(DIMENSIONS), 0.0, 0.0, 50.0)


class _Texts:
    """A run of texts as arrays."""

    def __init__(self, texts: Sequence[str], hasher: Hasher) -> None:
        self.count = len(texts)
        self.codes, self.starts = code_points(texts)
        self.first, self.end = word_bounds(self.codes)
        self.hashes = hasher.words(self.codes, self.first, self.end)
        self.owner = owners(self.starts, self.first)

    def per_text(self, owner: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=self.count)

    def features(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Hashed places and texts of words and pairs, and of character triples."""
        half = np.uint64(DIMENSIONS // 2 - 1)
        pair = self.owner[:-1] == self.owner[1:]
        pairs = mix(self.hashes[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:][pair], 21)
        words = np.concatenate([self.hashes, pairs]) & half
        codes = self.codes.astype(np.uint64)
        count = max(len(codes) - 2, 0)
        triples = (codes[:count] << np.uint64(42)) | (codes[1 : count + 1] << np.uint64(21)) | codes[2 : count + 2]
        owner = np.repeat(np.arange(self.count), np.diff(self.starts))[:count]
        chars = (mix(triples, 22) & half) + half + np.uint64(1)
        return (words.astype(np.int64), np.concatenate([self.owner, self.owner[:-1][pair]])), (chars.astype(np.int64), owner)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.count)
        for places, owner in self.features():
            total += self.per_text(owner, weights[places]) / np.maximum(self.per_text(owner), 1)
        return total

    def repeated_words(self) -> np.ndarray:
        """Words inside runs of three words that the text has twice or more."""
        count = max(len(self.hashes) - 2, 0)
        whole = np.flatnonzero(self.owner[:count] == self.owner[2 : count + 2]) if count else np.zeros(0, np.int64)
        step = np.uint64(0x9E3779B97F4A7C15)
        h = self.hashes
        value = mix((h[whole] * step + h[whole + 1]) * step + h[whole + 2]) ^ mix(self.owner[whole], 23)
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(whole), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(h), dtype=bool)
        for k in range(3):
            covered[whole[again] + k] = True
        return self.per_text(self.owner[covered])


def _repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``train_rows`` labelled rows, chosen by a hash of the key.

    Rows without a text, a key or a quality are left out. Where only one quality is
    left, every text gets a probability near 1.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    labelled = (
        labels.select(F.col(key).cast("long").alias("key"), F.col("quality").cast("double").alias("label"))
        .filter("key is not null and label in (0, 1)")
        .groupBy("key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(train_rows)
    )

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows: list[tuple] = []
            for at, some in runs(batch["text"].tolist()):
                data = _Texts(some, hasher)
                parts: list[list[np.ndarray]] = [[] for _ in some]
                shares: list[list[np.ndarray]] = [[] for _ in some]
                for places, owner in data.features():
                    cells, counts = np.unique(owner * DIMENSIONS + places, return_counts=True)
                    text_of = cells // DIMENSIONS
                    total = np.maximum(data.per_text(owner), 1)
                    edges = np.searchsorted(text_of, np.arange(len(some) + 1))
                    for i in range(len(some)):
                        cut = slice(edges[i], edges[i + 1])
                        parts[i].append(cells[cut] % DIMENSIONS)
                        shares[i].append(counts[cut] / total[i])
                for i in range(len(some)):
                    row = batch.iloc[at + i]
                    rows.append((int(row["key"]), row["label"], np.concatenate(parts[i]), np.concatenate(shares[i])))
            yield pd.DataFrame(rows, columns=["key", "label", "places", "shares"])

    # bounded by train_rows
    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    rows = chosen.join(F.broadcast(labelled), "key").mapInPandas(
        featurize, "key long, label double, places array<int>, shares array<double>"
    )
    vector = F.udf(lambda places, shares: SparseVector(DIMENSIONS, places, shares), VectorUDT())
    rows = rows.select("key", "label", vector("places", "shares").alias("features")).repartition(8, "key").cache()
    try:
        calibrates = F.pmod(F.xxhash64("key", F.lit("calibration")), F.lit(5)) == 0
        kinds = {(row[0], row[1]) for row in rows.select(calibrates, "label").distinct().collect()}
        if len(kinds) < 4:
            return KEEP_ALL
        fitted = LogisticRegression(regParam=REGULARIZATION, maxIter=60).fit(rows.filter(~calibrates))
        weights, intercept = fitted.coefficients.toArray(), float(fitted.intercept)
        margin = F.udf(lambda x: SparseVector(1, [0], [float(x.dot(weights)) + intercept]), VectorUDT())
        seen = rows.filter(calibrates).select("label", margin("features").alias("features"))
        line = LogisticRegression(regParam=1e-3, maxIter=60).fit(seen)
        return QualityModel(weights, intercept, float(line.coefficients[0]), float(line.intercept))
    finally:
        rows.unpersist()


def assess(text: Column, model: QualityModel, df: DataFrame) -> Column:
    """A struct of the rule counts, the rules' verdict, the probability and the final verdict.

    Words are runs without white space. ``base_failed``: fewer than 50 words, or more
    than half of the words in repeated runs of three. ``kept``: not failed and at least
    the least probability of good quality. A null text has no words and fails.
    """
    # bounded by DIMENSIONS
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.intercept, model.slope, model.offset))

    @F.pandas_udf(REPORT_SCHEMA)
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher, own = Hasher(), QualityModel(*shared.value)
        symbol = np.zeros(128, dtype=bool)
        symbol[[ord(c) for c in SYMBOLS]] = True
        for batch in batches:
            frames = []
            for _, some in runs([t if isinstance(t, str) else "" for t in batch]):
                data = _Texts(some, hasher)
                words = data.per_text(data.owner)
                marks = np.flatnonzero((data.codes < 128) & symbol[np.minimum(data.codes, 127)])
                repeated = data.repeated_words()
                failed = (words < LEAST_WORDS) | (repeated > MOST_REPEATED * words)
                chance = own.probability(data.margins(own.weights) + own.intercept)
                frames.append(
                    pd.DataFrame(
                        {
                            "n_words": words,
                            "word_chars": data.per_text(data.owner, data.end - data.first).astype(np.int64),
                            "n_symbols": data.per_text(owners(data.starts, marks)),
                            "n_dup_lines": [_repeated_lines(t) for t in some],
                            "n_repeat_words": repeated,
                            "base_failed": failed,
                            "probability": chance,
                            "kept": ~failed & (chance >= LEAST_PROBABILITY),
                        }
                    )
                )
            columns = [part.split()[0] for part in REPORT_SCHEMA.split(", ")]
            yield pd.concat(frames) if frames else pd.DataFrame(columns=columns)

    return work(text.cast("string"))
