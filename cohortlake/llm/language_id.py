"""Language identification by bit-sliced Bloom filters of letter n-grams.

One filter serves all languages: every slot is a mask with a bit for each language.
The slots of an n-gram, combined by AND, name all languages that hold it at once. For
a text the bits are counted per language; the count expected from false positives,
known from the share of slots a language has set, is taken off; the language
with the largest corrected count wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.textarrays import code_points, mix, runs

GRAM = 4
HASHES = 2
# Slots per n-gram learned, and the largest filter (16 million slots, 128 MB a word of languages).
SLOTS_PER_GRAM = 12
MOST_SLOTS = 1 << 24
# A language holds an n-gram that is at least this frequent in it, against the
# language in which it is most frequent: keeps quotations and slips out.
LEAST_RATE = 0.1
UNKNOWN = "und"
_COUNTED = 4_000_000


@dataclass(frozen=True)
class LanguageFilter:
    """``masks`` has a row per slot and a column for each 64 languages."""

    languages: tuple[str, ...]
    masks: np.ndarray
    default: int

    @property
    def false_rates(self) -> np.ndarray:
        """How often an n-gram that is in no language seems to be in each."""
        rates = [
            float(((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES
            for i in range(len(self.languages))
        ]
        return np.array(rates)


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; those past the first planes share one answer."""
    return np.array([chr(i).isalpha() for i in range(0x30000)], dtype=bool)


def grams(texts: Sequence[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, 16 bits a letter, and the text each is from.

    An n-gram has letters only, but for a first or last place that stands for
    the border of a word.
    """
    codes, starts = code_points([text.lower() for text in texts])
    known = letters[np.minimum(codes, len(letters) - 1)]
    plain = np.where(known, codes & 0xFFFF, 32).astype(np.uint64)
    count = max(len(codes) - GRAM + 1, 0)
    good = np.ones(count, dtype=bool)
    for k in range(1, GRAM - 1):
        good &= known[k : k + count]
    at = np.flatnonzero(good)
    values = plain[at]
    for k in range(1, GRAM):
        values = (values << np.uint64(16)) | plain[at + k]
    return values, np.searchsorted(starts, at + 1, side="right") - 1


def _slots(values: np.ndarray, which: int, size: int) -> np.ndarray:
    return (mix(values, 11 + which) & np.uint64(size - 1)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageFilter:
    """Learn the filter from all rows with a language.

    N-grams are counted inside the tasks, then over all of them; the driver gets
    the filter's slots, at most ``MOST_SLOTS``. Without any labelled row the
    filter has no language.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter(
        "lang is not null and text is not null"
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[str, int] = {}
        rows: dict[str, int] = {}

        def fold(name: str) -> None:
            keys = np.concatenate([one for one, _ in held[name]])
            counts = np.concatenate([one for _, one in held[name]])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
            held[name] = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]
            size[name] = len(first)

        for batch in batches:
            for name, group in batch.groupby("lang")["text"]:
                rows[name] = rows.get(name, 0) + len(group)
                for _, some in runs(group.tolist()):
                    values, _ = grams(some, letters)
                    values = np.sort(values)
                    first = np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0)
                    held.setdefault(name, []).append((values[first], np.diff(first, append=len(values))))
                    size[name] = size.get(name, 0) + len(first)
                    if size[name] > _COUNTED:
                        fold(name)
        for name in held:
            fold(name)
            keys, counts = held[name][0]
            yield pd.DataFrame({"lang": name, "gram": keys.view(np.int64), "n": counts, "docs": 0})
            yield pd.DataFrame({"lang": [name], "gram": [-1], "n": [int(counts.sum())], "docs": [rows[name]]})

    counted = (
        labelled.mapInPandas(count, "lang string, gram long, n long, docs long")
        .groupBy("gram", "lang")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    from cohortlake.llm.common import stored

    counted = stored(counted, "language-grams")
    totals = sorted((row["lang"], row["n"], row["docs"]) for row in counted.filter("gram = -1").collect())
    languages = tuple(name for name, _, _ in totals)
    if not languages:
        return LanguageFilter((), np.zeros((64, 1), dtype=np.uint64), 0)
    default = max(range(len(totals)), key=lambda i: (totals[i][2], -i))
    # two rows per language
    names = docs.sparkSession.createDataFrame([(name, i, float(max(n, 1))) for i, (name, n, _) in enumerate(totals)], "lang string, number int, total double")
    rated = counted.filter("gram <> -1").join(F.broadcast(names), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("number", "rate")).alias("all"))
    size = 1 << max(6, min(MOST_SLOTS, SLOTS_PER_GRAM * max(most.count(), 1)).bit_length() - 1)
    kept = most.select("gram", F.explode(F.expr(f"filter(all, x -> x.rate >= {LEAST_RATE} * most).number")).alias("number"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["gram"].to_numpy().view(np.uint64)
            for which in range(HASHES):
                yield pd.DataFrame({"slot": _slots(values, which, size), "number": batch["number"]})

    placed = (
        kept.mapInPandas(place, "slot long, number int")
        .groupBy("slot", F.expr("number div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, number % 64)")).alias("mask"))
        .toPandas()
    )
    masks = np.zeros((size, -(-len(languages) // 64)), dtype=np.uint64)
    masks[placed["slot"].to_numpy(), placed["word"].to_numpy()] = placed["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return LanguageFilter(languages, masks, default)


def predict_texts(texts: Sequence[str], model: LanguageFilter, letters: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the corrected share of n-grams found."""
    names, scores = [], []
    rates = model.false_rates
    size = len(model.masks)
    for _, some in runs(texts):
        values, owner = grams(some, letters)
        total = np.bincount(owner, minlength=len(some)).astype(float)
        edges = np.searchsorted(owner, np.arange(len(some)))
        filled = np.flatnonzero(total)
        found = model.masks[_slots(values, 0, size)]
        for which in range(1, HASHES):
            found &= model.masks[_slots(values, which, size)]
        shares = np.zeros((len(some), max(len(model.languages), 1)))
        for i, rate in enumerate(rates):
            bits = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            if len(filled):
                hits = np.add.reduceat(bits.astype(np.int64), edges[filled])
                expected = rate * total[filled]
                shares[filled, i] = np.clip((hits - expected) / (total[filled] * max(1 - rate, 1e-9)), 0, 1)
        best = shares.argmax(axis=1)
        top = shares.max(axis=1)
        best[top == 0] = model.default
        for i, text in enumerate(some):
            lettered = bool(model.languages) and (total[i] > 0 or any(map(str.isalpha, text)))
            names.append(model.languages[best[i]] if lettered else UNKNOWN)
            guess = float(top[i]) if total[i] else 1 / max(len(model.languages), 1)
            scores.append(guess if lettered else 0.0)
    return names, scores


def predict(text: Column, model: LanguageFilter, df: DataFrame) -> Column:
    """A struct of ``lang_pred`` and ``score`` (0 to 1) for a text column of ``df``.

    A text that is null or has no letter is ``und`` with score 0. A text with letters
    but no known n-gram gets the language of most learned rows; its score is 0, or the
    chance level if its words are too short for any n-gram.
    """
    # bounded by MOST_SLOTS
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.default))

    @F.pandas_udf("lang_pred string, score double")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, own = _letters(), LanguageFilter(*shared.value)
        for batch in batches:
            names, scores = predict_texts([t if isinstance(t, str) else "" for t in batch], own, letters)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return work(text.cast("string"))


def keep_known(docs: DataFrame, model: LanguageFilter, least_score: float, text: str = "text") -> DataFrame:
    """Rows whose language is known with at least the given score, with their own columns."""
    from cohortlake.llm.common import spare_name

    name = spare_name(docs, "language")
    found = docs.withColumn(name, predict(F.col(text), model, docs))
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).select(docs.columns)
