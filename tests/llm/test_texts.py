"""Operators on single texts and on the order of texts against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import hidden_markov, language_id, mixing, personal_data, quality, queries, sharding
from cohortlake.llm.common import number_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# language


def test_languages_held_out(spark, small_dir, documents):
    truth = {r[0]: r[2] for r in documents[1]}
    found = queries.op1_language_id(spark, small_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(truth)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(held) / len(held) > 0.95


def test_filter_against_sets(spark, documents):
    """The filter holds every n-gram kept, and false positives are as rare as stated."""
    df, rows = documents
    model = language_id.learn(df)
    letters = language_id._letters()
    counts = {name: Counter() for name in model.languages}
    for _, text, lang, _ in rows:
        counts[lang].update(language_id.grams([text], letters)[0].tolist())
    totals = {name: sum(c.values()) for name, c in counts.items()}
    for gram in random.Random(1).sample(sorted(set().union(*counts.values())), 2000):
        rates = {name: counts[name][gram] / totals[name] for name in counts}
        slots = [int(language_id._slots(np.array([gram], dtype=np.uint64), k, len(model.masks))[0]) for k in range(2)]
        mask = int(model.masks[slots[0], 0] & model.masks[slots[1], 0])
        for i, name in enumerate(model.languages):
            if rates[name] >= language_id.LEAST_RATE * max(rates.values()):
                assert mask >> i & 1
    fresh = np.random.default_rng(2).integers(1 << 40, 1 << 60, 50_000).astype(np.uint64)
    found = model.masks[language_id._slots(fresh, 0, len(model.masks)), 0] & model.masks[language_id._slots(fresh, 1, len(model.masks)), 0]
    for i, rate in enumerate(model.false_rates):
        assert abs(float((found >> np.uint64(i) & np.uint64(1)).mean()) - rate) < 0.01


def test_many_languages(spark):
    """More languages than one mask has bits."""
    rng = random.Random(3)
    rows = []
    for k in range(70):
        letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
        rows += [(k * 10 + j, " ".join(letters[i : i + 6] for i in range(0, 34, 3)), f"l{k:02}") for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert model.masks.shape[1] == 2 and len(model.languages) == 70
    found = df.select("lang", language_id.predict(F.col("text"), model, df).alias("p")).collect()
    assert all(r["lang"] == r["p"]["lang_pred"] for r in found)


def test_odd_languages(spark, odd_docs, no_docs):
    model = language_id.learn(odd_docs)
    assert model.languages == ("de", "en")
    found = {r["doc_id"]: r["p"] for r in odd_docs.select("doc_id", language_id.predict(F.col("text"), model, odd_docs).alias("p")).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (4, 5, 6, 7))
    assert found[9]["lang_pred"] == "de" and found[1]["lang_pred"] == "en"
    kept = language_id.keep_known(odd_docs, model, 0.1)
    assert kept.columns == odd_docs.columns
    assert not {4, 5, 6, 7} & {r["doc_id"] for r in kept.collect()}
    nothing = language_id.learn(no_docs)
    assert nothing.languages == ()
    assert {r[0]["lang_pred"] for r in odd_docs.select(language_id.predict(F.col("text"), nothing, odd_docs)).collect()} == {"und"}


# sharding


def test_shards(spark, small_dir, documents):
    rows = queries.op2_sharding(spark, small_dir).collect()
    texts = {r[0]: (r[1] or "").encode() for r in documents[1]}
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(slots) == set(range(8))
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_draws_follow_weights_and_move_little(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))

    def place(tree):
        return {r["k"]: r["s"] for r in keys.select("k", sharding.shard_of(F.col("k"), tree).alias("s")).collect()}

    for count in (8, 11):
        before, after = place(sharding.tree_of(count)), place(sharding.tree_of(count + 1))
        moved = [k for k in before if before[k] != after[k]]
        assert {after[k] for k in moved} == {count}
        assert abs(len(moved) / len(before) - 1 / (count + 1)) < 0.01
    tree = sharding.tree_of(8)
    heavy = [sharding.Shard(x.region, x.rack, x.number, 3.0 if x.number == 1 else 1.0) for x in tree]
    before, after = place(tree), place(heavy)
    assert abs(Counter(after.values())[1] / len(after) - 0.3) < 0.015
    # in the other region, where no weight has changed, keys leave but never move about
    assert all(after[k] < 4 or after[k] == before[k] for k in before if before[k] >= 4)
    assert 2 not in place([x for x in tree if x.number != 2] + [sharding.Shard("region0", "rack1", 2, 0.0)]).values()


def test_odd_shards(spark, odd_docs, odd_rows, no_docs):
    rows = sharding.assign(odd_docs, sharding.tree_of(3), sharding.tree_of(4)).collect()
    assert len(rows) == len(odd_rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 4} == {(1, 0)}
    assert sharding.assign(no_docs, sharding.tree_of(3)).collect() == []


def test_numbers_have_no_gaps(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), "id")
    groups = defaultdict(list)
    for r in number_rows(df.union(df.limit(100)), ["g"], ["id"], "n").collect():
        groups[r["g"]].append(r["n"])
    assert all(sorted(found) == list(range(len(found))) for found in groups.values())


# mixing


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1}, {"a": 97, "b": 2, "c": 1}, {"x": 4}])
def test_less_than_one_block_of_deviation(weights):
    slots = mixing.one_round(weights)
    total = sum(map(len, slots.values()))
    order = {slot: name for name, places in slots.items() for slot in places}
    given = dict.fromkeys(weights, 0)
    for t in range(total):
        given[order[t]] += 1
        for name, weight in weights.items():
            assert abs(given[name] - Fraction(weight, sum(weights.values())) * (t + 1)) < 1


def test_phases_against_play():
    """Block by block: earliest deadline first, anew whenever a source runs out."""
    weights, left = {"a": 5, "b": 3, "c": 2}, {"a": 7, "b": 40, "c": 3}
    plan = mixing.phases(left, weights)
    played, now = [], dict(left)
    while now:
        round_slots = mixing.one_round({name: weights[name] for name in now})
        order = {slot: name for name, places in round_slots.items() for slot in places}
        t = 0
        while all(now.values()):
            name = order[t % len(order)]
            played.append(name)
            now[name] -= 1
            t += 1
        now = {name: count for name, count in now.items() if count}
    laid = {}
    for phase in plan:
        for name, count in phase.blocks.items():
            places = phase.slots[name]
            for j in range(count):
                laid[phase.start + j // len(places) * phase.round_slots + places[j % len(places)]] = name
    assert [laid[t] for t in range(50)] == played


def test_mix(spark, small_dir, documents):
    rows = queries.op5_mixing(spark, small_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in documents[1])
    positions = defaultdict(set)
    for r in rows:
        positions[r["mix_position"]].add((r["mix_source"], r["mix_block"]))
    assert sorted(positions) == list(range(len(positions))) and all(len(x) == 1 for x in positions.values())
    counts = Counter(r["mix_source"] for r in rows)
    weights = mixing.weights_by_size(counts)
    given, total = Counter(), sum(weights.values())
    for t in range(min(-(-counts[s] // mixing.BLOCK_ROWS) * total // weights[s] for s in counts)):
        given[next(iter(positions[t]))[0]] += 1
        assert all(abs(given[s] - weights[s] / total * (t + 1)) < 1 + 1e-9 for s in counts)


def test_fractional_weights(spark):
    assert mixing.whole_weights({"a": 0.7, "b": 0.3}) == {"a": 7, "b": 3}
    assert mixing.whole_weights({"a": 4, "b": 2, "c": "1/3"}) == {"a": 12, "b": 6, "c": 1}
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0})
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs, {"a": 0.7, "b": 0.3}, block_rows=1).filter("mix_position < 1000").collect()
    assert len(rows) == 1000
    for t in range(10, 1001, 10):
        assert sum(r["source"] == "a" for r in rows if r["mix_position"] < t) == 7 * t // 10


def test_odd_mix(spark, odd_docs, odd_rows, no_docs):
    rows = mixing.mixed(odd_docs, {"a": 2, "b": 1})
    assert rows.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r[0] for r in odd_rows)
    assert mixing.mixed(no_docs).collect() == []


# personal data

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for match in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", match.group())
            good = (
                kind == 0
                or kind == 1 and all(int(part) <= 255 for part in match.group().split("."))
                or kind == 2 and 14 <= len(digits) <= 19 and personal_data.luhn(digits)
                or kind == 3 and 10 <= len(digits) <= 15
            )
            if good:
                out.append((match.start(), match.end(), kind))
    return sorted(out, key=lambda span: (span[0], span[2]))


def test_spans_against_patterns(documents):
    finder, rng = personal_data.Finder(), random.Random(5)
    texts = [r[1] for r in documents[1]]
    texts += ["".join(rng.choice("aB0123456789@@..+- ()%://_é\n") for _ in range(rng.randint(0, 60))) for _ in range(15_000)]
    texts += ["".join(rng.choice("0123456789.. -+") for _ in range(rng.randint(0, 60))) for _ in range(15_000)]
    for text in texts:
        assert [span for span in finder(text) if span[2] < 4] == base_spans(text)


def test_added_spans():
    found = personal_data.Finder()("IBAN: DE89 3704 0044 0532 0130 00, Account no. 12345678; ssn 123-45-6789")
    assert personal_data.listed(found) == "account:6:33,account:47:55,account:61:72"
    assert personal_data.listed(personal_data.Finder()("ftp://bob:pw@host.org/x")).startswith("url:0:21")
    for clean in ("an account of 1984", "iban: DE00 3704 0044 0532 0130 00", "http://a.b/c", "ssn", "iban: ", "x://@:"):
        assert personal_data.Finder()(clean) == []


def test_digest(spark, small_dir, documents):
    texts = {r[0]: r[1] for r in documents[1]}
    for r in queries.op8_personal_data(spark, small_dir).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[2] == k for s in spans) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(personal_data.listed(spans).encode()).hexdigest()


def test_redact(spark, odd_docs, odd_rows, no_docs):
    done = personal_data.redact(odd_docs)
    assert done.schema == odd_docs.schema
    rows = done.select("doc_id", "text", "n_chars").collect()
    text = next(r for r in rows if r["doc_id"] == 10)
    assert text["text"] == "mail [EMAIL] or [PHONE], card [CARD], host [IP]" and text["n_chars"] == len(text["text"])
    assert Counter(r["text"] for r in rows if r["doc_id"] != 10) == Counter(r[1] for r in odd_rows if r[0] != 10)
    assert personal_data.redact(no_docs).collect() == []
    spans = odd_docs.select("doc_id", personal_data.find_spans(F.col("text")).alias("s")).collect()
    assert {r["doc_id"] for r in spans if r["s"]} == {10}


# quality


def plain_counts(text):
    words = WORD.findall(text or "")
    lines, seen, again = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    covered = {i + k for i, triple in enumerate(triples) if count[triple] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, again, len(covered), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality(spark, small_dir, documents):
    texts = {r[0]: r[1] for r in documents[1]}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    rows = queries.op9_quality_rules(spark, small_dir).collect()
    right = []
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == plain_counts(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality.LEAST_PROBABILITY)
        if r["doc_id"] in good and not r["base_failed"]:
            right.append(r["kept"] == bool(good[r["doc_id"]]))
    assert len(rows) == len(texts) and sum(right) / len(right) > 0.95


def test_quality_on_rows_not_fitted(spark):
    """Fit on some labelled rows of a larger table, judge the others."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    fitted = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = quality.fit(docs, labels.filter(fitted))
    rest = docs.join(labels.filter(~fitted), "doc_id").select("quality", quality.assess(F.col("text"), model, docs).alias("a"))
    judged = [(r["quality"] == 1, r["a"]["probability"]) for r in rest.collect()]
    assert sum((p >= 0.5) == good for good, p in judged) / len(judged) > 0.9
    assert abs(np.mean([p for _, p in judged]) - np.mean([good for good, _ in judged])) < 0.1


def test_odd_quality(spark, odd_docs, odd_rows, no_docs):
    assert quality.fit(no_docs, spark.createDataFrame([], "doc_id long, quality int")) is quality.KEEP_ALL
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None), (4, 0), (99, 0)], "doc_id long, quality int")
    assert quality.fit(odd_docs, labels) is quality.KEEP_ALL
    rows = odd_docs.select("doc_id", "text", quality.assess(F.col("text"), quality.KEEP_ALL, odd_docs).alias("a")).collect()
    for r in rows:
        assert tuple(r["a"][c] for c in COUNTS) == plain_counts(r["text"])
        assert r["a"]["kept"] == (not r["a"]["base_failed"])
    assert no_docs.select(quality.assess(F.col("text"), quality.KEEP_ALL, no_docs)).collect() == []


# language model


def _random_model(rng, states, symbols):
    first, step, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hidden_markov.Parameters(first / first.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    model = _random_model(rng, 3, 4)
    texts = [rng.integers(0, 4, n).astype("<u2") for n in (1, 5, 3, 5, 2)]
    got = hidden_markov.log_likelihoods(texts, model)
    for text, value in zip(texts, got, strict=True):
        total = 0.0
        for path in product(range(3), repeat=len(text)):
            p = model.first[path[0]] * model.emit[text[0], path[0]]
            for a, b, symbol in zip(path, path[1:], text[1:], strict=False):
                p *= model.step[a, b] * model.emit[symbol, b]
            total += p
        assert abs(value - math.log10(total)) < 1e-9
    everything = [np.array(t, dtype="<u2") for t in product(range(4), repeat=3)]
    assert abs(sum(10**hidden_markov.log_likelihoods(everything, model)) - 1) < 1e-9


def test_expected_counts_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    model = _random_model(rng, 2, 3)
    texts = [rng.integers(0, 3, n).astype("<u2") for n in (4, 1, 6)]
    got = hidden_markov._no_counts(3, 2)
    hidden_markov.expected_counts(texts, model, got)
    want = hidden_markov._no_counts(3, 2)
    for text in texts:
        weights = {}
        for path in product(range(2), repeat=len(text)):
            p = model.first[path[0]] * model.emit[text[0], path[0]]
            for a, b, symbol in zip(path, path[1:], text[1:], strict=False):
                p *= model.step[a, b] * model.emit[symbol, b]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            want.first[path[0]] += p / total
            for symbol, state in zip(text, path, strict=True):
                want.emit[symbol, state] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want.step[a, b] += p / total
    for name in ("first", "step", "emit"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-4)


def check_scores(rows, docs):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [(doc, [*WORD.findall((text or "").translate(low)), ""]) for doc, text in docs]
    count = Counter(w for doc, some in words if crc(doc) % 5 != 1 or doc is None for w in some)
    total, distinct = sum(count.values()), len(count)
    want = sorted(
        (
            str(doc), len(some), sum(count[w] > 0 for w in some), total,
            round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in some), 4),
        )
        for doc, some in words
    )
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(abs(a[4] - b[4]) < 1e-3 for a, b in zip(got, want, strict=True))


def test_scores(spark, small_dir, documents):
    rows = queries.op6_hidden_markov(spark, small_dir).collect()
    check_scores(rows, [(r[0], r[1]) for r in documents[1]])
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rounds_improve(spark, documents):
    df, _ = documents
    none, two = (
        sum(r["score"] for r in hidden_markov.score(df, F.lit(False), frequent=300, states=4, rounds=n, seed_texts=20).collect())
        for n in (0, 2)
    )
    assert two > none


def test_odd_scores(spark, odd_docs, odd_rows, no_docs):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = hidden_markov.score(odd_docs, held_out, frequent=10).collect()
    check_scores(rows, [(r[0], r[1]) for r in odd_rows])
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    untrained = hidden_markov.score(odd_docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)
    assert hidden_markov.score(no_docs, F.lit(False)).collect() == []


@pytest.mark.parametrize(
    "text, span",
    [
        ("account number for payments: 12345678", "account:29:37"),
        ("Passport C01X00T47", "account:9:18"),
        ("your account X1234567, thanks", "account:13:21"),
        ("SSN 123 45 6789", "account:4:15"),
        ("iBaN DE89370400440532013000", "account:5:27"),
        ("Account closed. Call 1234567", ""),
        ("account\n1234567", ""),
        ("passport of 1999", ""),
    ],
)
def test_numbers_behind_cues(text, span):
    assert personal_data.listed(personal_data.Finder()(text)) == span


@pytest.mark.parametrize(
    "text", ["IBAN " * 200_000, "iban " + "AB " * 300_000, "account " * 130_000, "account " + "word and " * 110_000, "iban DE89" + " " * 900_000]
)
def test_long_texts_of_cues_take_linear_time(text):
    start = time.process_time()
    assert personal_data.Finder()(text) == []
    assert time.process_time() - start < 10
