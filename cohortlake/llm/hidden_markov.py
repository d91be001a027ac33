"""A hidden Markov language model over words.

Latent states follow each other in a text and emit its words. Frequent words have an
emission of their own in every state; each other word is emitted as "rare" and then
drawn from the smoothed counts of rare words, so that the probabilities of all texts
are those of one model. Baum-Welch rounds run over the whole training corpus: tasks
sum up expected counts, the sums are added up over all tasks, and the next parameters
follow from them. The scaled forward recursion gives the exact likelihood of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import stored
from cohortlake.llm.textarrays import runs

STATES = 8
# Words with an emission of their own; the rest share one, each with its exact count.
FREQUENT = 16_000
ROUNDS = 2
# The first parameters come from this many training texts.
SEED_TEXTS = 400
SEED_ROUNDS = 25
SMOOTHING = 0.5
# Texts that step through the recursion together, and the states held for them.
LANES = 512
CELLS = 400_000
# Emission columns that are summed up in one group.
CHUNK = 1024
FOLDS = 32

END, RARE = 0, 1

def tokens(text: str) -> list[bytes]:
    """Words between white space in UTF-8, A to Z in lower case."""
    # lower() and split() of bytes know ASCII only
    return text.encode("utf-8", "surrogatepass").lower().split()


@dataclass(frozen=True)
class Parameters:
    """First state, next state, and emission (a row per symbol, a column per state)."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


@dataclass(frozen=True)
class Counts:
    """Expected counts of one round."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def parameters(self) -> Parameters:
        states = len(self.first)
        first = self.first + SMOOTHING
        step = self.step + SMOOTHING
        # smoothing in proportion to the symbol's use in all states
        use = self.emit.sum(axis=1, keepdims=True) + 1e-3
        emit = self.emit + 20 * use / use.sum() + 1e-9
        return Parameters(first / first.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)) if states else None


def _lanes(texts: Sequence[np.ndarray]) -> Iterator[list[int]]:
    """Places of texts of similar length, few enough for the memory of their states."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        width = max(1, min(LANES, CELLS // max(len(texts[order[at]]), 1)))
        yield order[at : at + width]
        at += width


def _grid(texts: Sequence[np.ndarray], places: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(texts[i]) for i in places])
    grid = np.zeros((int(lengths.max()), len(places)), dtype=np.int64)
    for lane, i in enumerate(places):
        grid[: lengths[lane], lane] = texts[i]
    # lanes come longest first: how many of them reach each step
    active = np.searchsorted(-lengths, -np.arange(1, len(grid) + 1), side="right")
    return grid, active


def log_likelihoods(texts: Sequence[np.ndarray], model: Parameters) -> np.ndarray:
    """log10 probability of each text of symbols, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    for places in _lanes(texts):
        grid, active = _grid(texts, places)
        total = np.zeros(len(places))
        state = np.broadcast_to(model.first, (len(places), len(model.first)))
        for t, count in enumerate(active.tolist()):
            now = state[:count] if t == 0 else state[:count] @ model.step
            now = now * model.emit[grid[t, :count]]
            scale = now.sum(axis=1)
            state = now / scale[:, None]
            total[:count] += np.log10(scale)
        out[places] = total
    return out


def expected_counts(texts: Sequence[np.ndarray], model: Parameters, counts: Counts) -> None:
    """Add the texts' expected counts to ``counts``: the forward and backward recursions."""
    states = len(model.first)
    emit = model.emit.astype(np.float32)
    step = model.step.astype(np.float32)
    for places in _lanes(texts):
        grid, active = _grid(texts, places)
        steps, lanes = grid.shape
        alpha = np.zeros((steps, lanes, states), dtype=np.float32)
        scales = np.ones((steps, lanes), dtype=np.float32)
        likely = emit[grid]
        for t in range(steps):
            count = active[t]
            now = model.first.astype(np.float32) if t == 0 else alpha[t - 1, :count] @ step
            now = now * likely[t, :count]
            scale = now.sum(axis=1)
            scales[t, :count] = scale
            np.divide(now, scale[:, None], out=alpha[t, :count])
        beta = np.ones((lanes, states), dtype=np.float32)
        back = step.T.copy()
        moved = np.zeros((states, states), dtype=np.float64)
        for t in range(steps - 1, -1, -1):
            count = active[t]
            if t + 1 < steps:
                ahead = active[t + 1]
                follow = likely[t + 1, :ahead] * beta[:ahead]
                follow /= scales[t + 1, :ahead, None]
                moved += alpha[t, :ahead].T @ follow
                beta[:ahead] = follow @ back
            # where a text ends, beta is still 1; from here alpha holds the posterior
            alpha[t, :count] *= beta[:count]
        counts.step[...] += moved * model.step
        counts.first[...] += alpha[0].sum(axis=0)
        inside = np.arange(lanes) < active[:, None]
        symbols, weights = grid[inside], alpha[inside]
        for s in range(states):
            counts.emit[:, s] += np.bincount(symbols, weights=weights[:, s], minlength=len(emit))


def seed_parameters(texts: Sequence[np.ndarray], symbols: int, states: int) -> Parameters:
    """First parameters: rounds over a few texts, started from texts drawn apart.

    Each state starts from one text, chosen far from the others by the cosine
    of their symbols, so that the states differ from the beginning.
    """
    use = np.zeros((len(texts), symbols), dtype=np.float32)
    for i, text in enumerate(texts):
        use[i] = np.bincount(text, minlength=symbols)
    use = np.sqrt(use)
    use /= np.maximum(np.linalg.norm(use, axis=1, keepdims=True), 1e-9)
    longest = int(np.argmax([len(text) for text in texts]))
    picked = [longest]
    nearest = use @ use[longest]
    while len(picked) < min(states, len(texts)):
        nearest[[i for i, text in enumerate(texts) if len(text) < 20]] += 2
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, use @ use[picked[-1]])
    shares = use @ use[picked].T
    closest = shares.argmax(axis=1)
    base = np.bincount(np.concatenate(texts), minlength=symbols) + 0.5
    emit = np.tile((base / base.sum())[:, None], (1, states))
    for i, text in enumerate(texts):
        emit[:, closest[i]] += 2 * np.bincount(text, minlength=symbols) / sum(map(len, texts))
    noise = np.random.default_rng(5).uniform(0.9, 1.1, size=emit.shape)
    emit = emit * noise
    step = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    model = Parameters(np.full(states, 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for _ in range(SEED_ROUNDS):
        counts = _no_counts(symbols, states)
        expected_counts(texts, model, counts)
        model = counts.parameters()
    return model


def _no_counts(symbols: int, states: int) -> Counts:
    return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words in the training texts, summed inside the task as far as memory allows."""
    held: Counter[bytes] = Counter()

    def given() -> Iterator[pd.DataFrame]:
        words, counts = [word.decode() for word in held], list(held.values())
        for at in range(0, len(words), 50_000):
            yield pd.DataFrame({"word": words[at : at + 50_000], "n": counts[at : at + 50_000]})

    for batch in batches:
        texts = batch["text"].tolist()
        held[b""] += len(texts)
        for _, some in runs(texts):
            held.update(tokens(" ".join(some)))
        if len(held) > 1_500_000:
            yield from given()
            held.clear()
    yield from given()


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, equal counts by word.

    Counts are first told apart by size class, so that only the words of the classes
    needed are sorted and sent, not as many words from each task.
    """
    size = F.floor(F.log2("n") * 16)
    left, least = most, 0
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        least, left = row["size"], left - row["count"]
        if left <= 0:
            break
    return counts.filter(size >= least).orderBy(F.desc("n"), "word").limit(most).collect()


def _encode(ids: dict[bytes, int]):
    """Texts as symbols (unsigned 16 bits, the end last) and their rare words with counts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                symbols, rare_words, rare_counts = [], [], []
                for text in some["text"]:
                    words = tokens(text)
                    symbols.append(np.array([ids.get(word, RARE) for word in words] + [END], dtype="<u2").tobytes())
                    rare = Counter([word for word in words if word not in ids])
                    rare_words.append([word.decode() for word in rare])
                    rare_counts.append(list(rare.values()))
                row = np.arange(number, number + len(some))
                number += len(some)
                yield pd.DataFrame(
                    {
                        "row": row,
                        "doc_id": some["doc_id"].array,
                        "held_out": some["held_out"].array,
                        "symbols": symbols,
                        "rare_words": rare_words,
                        "rare_counts": rare_counts,
                    }
                )

    return work


def _symbols(raw: Sequence[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(one, dtype="<u2") for one in raw]


def _round(coded: DataFrame, model: Parameters) -> Counts:
    """Expected counts of all training texts under the present parameters.

    A task gives one row for each ``CHUNK`` symbols; rows are added up in two steps, so
    that no group grows with the number of tasks beyond a share of them. The driver
    gets the sums, whose size is that of the parameters.
    """
    symbols, states = model.emit.shape
    shared = coded.sparkSession.sparkContext.broadcast((model.first, model.step, model.emit))
    schema = "chunk int, fold int, sums binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = Parameters(*shared.value)
        counts = _no_counts(symbols, states)
        for batch in batches:
            expected_counts(_symbols(batch["symbols"].tolist()), own, counts)
        fold = TaskContext.get().partitionId() % FOLDS
        parts = [np.vstack([counts.first[None, :], counts.step])]
        parts.extend(counts.emit[at : at + CHUNK] for at in range(0, symbols, CHUNK))
        yield pd.DataFrame({"chunk": range(len(parts)), "fold": fold, "sums": [part.tobytes() for part in parts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(one) for one in rows["sums"]], axis=0)
        return rows.iloc[:1].assign(sums=[total.tobytes()])

    given = coded.filter("not held_out").select("symbols").mapInPandas(count, schema)
    folded = given.groupBy("chunk", "fold").applyInPandas(add, schema)
    summed = folded.groupBy("chunk").applyInPandas(add, schema).collect()
    shared.destroy()
    parts = {row["chunk"]: np.frombuffer(row["sums"]).reshape(-1, states) for row in summed}
    if not parts:
        return _no_counts(symbols, states)
    emit = np.vstack([parts[i] for i in range(1, len(parts))])
    return Counts(parts[0][0].copy(), parts[0][1:].copy(), emit)


def score(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    states: int = STATES,
    frequent: int = FREQUENT,
    rounds: int = ROUNDS,
    seed_texts: int = SEED_TEXTS,
) -> DataFrame:
    """Learn from the rows that are not held out, then score all rows.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: the
    text's tokens with its end, those seen in training, all tokens of the training
    texts, the log10 probability by smoothed counts, and that by the model.

    Counts cover every word of every training text; words beyond the ``frequent`` ones are
    counted and joined by Spark. A null text is empty: its end alone. Null and
    repeated keys are scored like others. Without training texts the model knows
    nothing and gives what the smoothed counts give.
    """
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    training = slim.filter("not held_out").select("text")
    counts = stored(
        training.mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    tokens_all, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # bounded by the parameter
    top = _most_frequent(counts.filter("word <> ''"), min(frequent, 65_000))
    ids = {row["word"].encode(): i + 2 for i, row in enumerate(top)}
    ends = counts.filter("word = ''").select("n").first()
    known = np.array([ends["n"] if ends else 0, 0, *[row["n"] for row in top]], dtype=np.float64)

    spark = docs.sparkSession
    shared_ids = spark.sparkContext.broadcast(ids)
    coded = stored(
        slim.mapInPandas(
            lambda batches: _encode(shared_ids.value)(batches),
            "row long, doc_id long, held_out boolean, symbols binary, rare_words array<string>, rare_counts array<int>",
        ),
        "symbols",
    )
    model = _train(coded, len(known), states, rounds, seed_texts)

    rare_total = tokens_all - known.sum()
    rare_distinct = distinct - np.count_nonzero(known)
    floor = np.log10(tokens_all + SMOOTHING * (distinct + 1))
    rare_floor = np.log10(rare_total + SMOOTHING * (rare_distinct + 1))
    shared = spark.sparkContext.broadcast((model.first, model.step, model.emit, known))

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, step, emit, seen = shared.value
        own = Parameters(first, step, emit)
        weight = np.log10(seen + SMOOTHING) - floor
        weight[RARE] = 0.0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                texts = _symbols(some["symbols"].tolist())
                yield pd.DataFrame(
                    {
                        "row": some["row"].array,
                        "doc_id": some["doc_id"].array,
                        "held_out": some["held_out"].array,
                        "n_tokens": [len(one) for one in texts],
                        "seen": [int((seen[one] > 0).sum()) for one in texts],
                        "base": [float(weight[one].sum()) for one in texts],
                        "model": log_likelihoods(texts, own),
                    }
                )

    scored = coded.select("row", "doc_id", "held_out", "symbols").mapInPandas(
        forward, "row long, doc_id long, held_out boolean, n_tokens long, seen long, base double, model double"
    )
    rare = (
        coded.select("row", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("pair"))
        .select("row", F.col("pair.rare_words").alias("word"), F.col("pair.rare_counts").alias("times"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_seen"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("rare_log"),
            F.sum("times").alias("rare_tokens"),
        )
    )
    none = F.lit(0)
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", none)).alias("n_known"),
        F.lit(int(tokens_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_log", none) - F.coalesce("rare_tokens", none) * F.lit(float(floor))).alias("base_score"),
        (F.col("model") + F.coalesce("rare_log", none) - F.coalesce("rare_tokens", none) * F.lit(float(rare_floor))).alias("score"),
    )


def _train(coded: DataFrame, symbols: int, states: int, rounds: int, seed_texts: int) -> Parameters:
    # numbers first: sorting whole texts would send as many of them from every task
    training = coded.filter("not held_out")
    picked = training.select("doc_id", "row").orderBy(F.xxhash64("doc_id"), "row").limit(seed_texts)
    numbers = [row["row"] for row in picked.collect()]
    chosen = training.filter(F.col("row").isin(numbers)).select("row", "symbols").collect()
    by_row = {row["row"]: row["symbols"] for row in chosen}
    seeds = _symbols([by_row[number] for number in numbers])
    if not seeds:
        even = np.full(states, 1 / states)
        return Parameters(even, np.tile(even, (states, 1)), np.full((symbols, states), 1 / symbols))
    model = seed_parameters(seeds, symbols, states)
    for _ in range(rounds):
        model = _round(coded, model).parameters()
    return model
