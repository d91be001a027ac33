import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators.regression import (
    count_rows,
    logistic_terms,
    min_group_size,
    odds_ratios,
    profile_bounds,
    propensity_score,
    score_equations,
)
from cohortlake.plans.queries import STUDY_QUERIES, TEST_PARAMETERS
from cohortlake.plans.study import Study

# (outcome, drug, persons)
CELLS = [(1, "a", 30), (0, "a", 70), (1, "b", 45), (0, "b", 55)]


@pytest.fixture(scope="module")
def two_by_two(spark):
    rows = [(y, drug) for y, drug, n in CELLS for _ in range(n)]
    return spark.createDataFrame(rows, "y int, drug string")


def test_closed_form(two_by_two):
    terms = {r.term: r for r in logistic_terms(two_by_two, "y", ("drug",)).collect()}
    assert set(terms) == {"(Intercept)", "drugb"}
    assert terms["(Intercept)"].estimate == pytest.approx(math.log(30 / 70), abs=1e-8)
    assert terms["drugb"].estimate == pytest.approx(math.log(45 / 55 / (30 / 70)), abs=1e-8)
    se = math.sqrt(sum(1 / n for _, _, n in CELLS))
    assert terms["drugb"].std_error == pytest.approx(se, abs=1e-8)
    z = terms["drugb"].statistic
    assert terms["drugb"].p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-8)


def test_odds(two_by_two):
    row = odds_ratios(logistic_terms(two_by_two, "y", ("drug",))).filter("term = 'drugb'").first()
    assert row.odds_ratio == pytest.approx((45 / 55) / (30 / 70))
    assert row.bottom_ci < row.odds_ratio < row.top_ci


def test_counted_patterns_equal_single_rows(spark):
    """Patterns with counts fit like the rows they stand for."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = spark.range(600).select(
        (F.col("id") % 50).cast("double").alias("age"),
        F.concat(F.lit("g"), F.col("id") % 3).alias("grp"),
        ((F.col("id") * 7919 % 101) < 30 + F.col("id") % 50).cast("int").alias("y"),
    )
    ours = {r.term: r for r in logistic_terms(df, "y", ("age", "grp")).collect()}
    formula = RFormula(formula="y ~ age + grp", stringIndexerOrderType="alphabetDesc").fit(df)
    plain = GeneralizedLinearRegression(family="binomial", tol=1e-10).fit(formula.transform(df))
    assert ours["(Intercept)"].estimate == pytest.approx(plain.intercept, abs=1e-7)
    assert ours["age"].estimate == pytest.approx(plain.coefficients[0], abs=1e-7)
    assert ours["age"].std_error == pytest.approx(plain.summary.coefficientStandardErrors[0], abs=1e-7)


def test_score_is_the_share_of_each_level(spark, two_by_two):
    scored = propensity_score(two_by_two.withColumnRenamed("y", "has_lsd"), covariates=("drug",))
    got = {r.drug: r.score for r in scored.distinct().collect()}
    assert got == {"a": pytest.approx(0.30, abs=1e-8), "b": pytest.approx(0.45, abs=1e-8)}


def test_gap_gets_no_score(spark, two_by_two):
    extra = spark.createDataFrame([(0, None)], "y int, drug string")
    scored = propensity_score(two_by_two.union(extra).withColumnRenamed("y", "has_lsd"), covariates=("drug",))
    assert scored.count() == 201 and scored.filter("score is null").count() == 1


def test_group_floor(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)] * 3, "k string")
    assert sorted(r.k or "-" for r in min_group_size(df, "k", 2).collect()) == ["-"] * 3 + ["a"] * 3


def test_score_equations_hold_at_the_fit_only(spark):
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.2 + 0.1 * (i % 3)), float(i % 7), "abc"[i % 3]) for i in range(600)]
    rows += [(600, 1, None, "a"), (601, 0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, y int, x double, level string")
    scored = propensity_score(df, "y", ("x", "level"))
    sums = score_equations(scored, "y", "score", ("x", "level")).collect()
    assert {r.term for r in sums} == {"(Intercept)", "x", "levela", "levelb", "levelc"}
    assert all(abs(r.observed - r.fitted) < 1e-6 for r in sums)
    off = scored.withColumn("score", F.col("score") * 0.99)
    assert all(abs(r.observed - r.fitted) > 1e-3 for r in score_equations(off, "y", "score", ("x", "level")).collect())


def test_profile_bounds_cut_the_likelihood(spark):
    """At a bound, the best fit of the other terms has lost half the quantile."""
    rnd = random.Random(2)
    rows = [(int(rnd.random() < 0.3 + 0.05 * (i % 5)), float(i % 5), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, x double, level string")
    bounds = {r.term: r for r in profile_bounds(df, "y", ("x", "level")).collect()}
    wald = {r.term: r for r in logistic_terms(df, "y", ("x", "level")).collect()}

    def best(fixed):
        """Largest likelihood with the slope of x held, by Newton steps on the other two."""
        a = b = 0.0
        for _ in range(60):
            g = [0.0, 0.0]
            h = [[1e-12, 0.0], [0.0, 1e-12]]
            total = 0.0
            for y, x, level in rows:
                one = 1.0 if level == "b" else 0.0
                eta = a + b * one + fixed * x
                p = 1 / (1 + math.exp(-eta))
                total += y * eta - math.log1p(math.exp(eta))
                for i, u in enumerate((1.0, one)):
                    g[i] += u * (y - p)
                    for j, v in enumerate((1.0, one)):
                        h[i][j] += u * v * p * (1 - p)
            det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
            a += (h[1][1] * g[0] - h[0][1] * g[1]) / det
            b += (h[0][0] * g[1] - h[1][0] * g[0]) / det
        return total

    top = best(bounds["x"].estimate)
    for bound in (bounds["x"].conf_low, bounds["x"].conf_high):
        assert 2 * (top - best(bound)) == pytest.approx(3.841458820694124, abs=1e-5)
    for term, row in bounds.items():
        assert row.conf_low < row.estimate < row.conf_high
        assert row.conf_low == pytest.approx(wald[term].conf_low, abs=0.1)


def test_profile_of_a_level_without_outcome(spark):
    rows = [(1, "a")] * 20 + [(0, "a")] * 30 + [(0, "b")] * 25
    found = {r.term: r for r in profile_bounds(spark.createDataFrame(rows, "y int, level string"), "y", ("level",)).collect()}
    assert found["levelb"].conf_low is None and found["levelb"].conf_high is not None and found["levelb"].conf_high < 0
    assert found["(Intercept)"].conf_low < found["(Intercept)"].estimate < found["(Intercept)"].conf_high


def _values(df, *keys):
    """Rows by key, with what tells them apart rounded as little as sums in another order need."""
    return {tuple(r[k] for k in keys): [None if v is None else pytest.approx(v, abs=1e-7) for k, v in r.asDict().items() if k not in keys] for r in df.collect()}


def test_counted_rows_stand_for_single_ones(spark):
    rnd = random.Random(7)
    rows = [(int(rnd.random() < 0.3 + 0.1 * (i % 4)), float(i % 4), "abc"[i % 3]) for i in range(300)]
    rows += [(1, None, "a"), (0, 2.0, None), (0, 2.0, None), (None, 1.0, "b"), (1, 1.0, "rare"), (1, 1.0, "rare")]
    df = spark.createDataFrame(rows, "y int, x double, level string")
    counted = count_rows(df, df.columns, "n")
    assert counted.count() == len(set(rows)) and counted.agg(F.sum("n")).first()[0] == len(rows)

    plain, short = min_group_size(df, "level", 2), min_group_size(counted, "level", 2, count="n")
    assert {r.level for r in short.collect()} == {"a", "b", "c"} == {r.level for r in plain.collect()}
    assert short.agg(F.sum("n")).first()[0] == plain.count() == 302

    terms = ("x", "level")
    scored, short_scored = propensity_score(plain, "y", terms), propensity_score(short, "y", terms, count="n")
    assert short_scored.columns == [*short.columns, "score"]
    assert _values(short_scored.drop("n"), "y", *terms) == _values(scored.distinct(), "y", *terms)
    sums = score_equations(scored, "y", "score", terms)
    assert _values(score_equations(short_scored, "y", "score", terms, count="n"), "term") == _values(sums, "term")


def test_no_complete_row_gives_no_score(spark):
    df = spark.createDataFrame([(1, None), (0, None)], "y int, level string")
    scored = propensity_score(df, "y", ("level",))
    assert scored.dtypes == [*df.dtypes, ("score", "double")]
    assert [(r.y, r.score) for r in scored.orderBy("y").collect()] == [(0, None), (1, None)]
    assert propensity_score(df.limit(0), "y", ("level",)).count() == 0


def test_drug_rows_are_found_once(spark):
    """Group sizes, fit, scores and sums read counted rows, not the joins of all drugs again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.4), f"drug {i % 2}", 20 + i % 30, "AB"[i % 5 % 2], "MF"[i % 7 % 2]) for i in range(200)]
    rows += [(1, "rare", 30, "A", "M")]
    kinds = "Binary_Severity int, drug_concept_name string, age_at_covid int, race string, sex string"
    study = Study({}, TEST_PARAMETERS)
    study.__dict__["outcome_drugs"] = spark.createDataFrame(rows, kinds).mapInPandas(seen, kinds)
    sums = {r.term: r for r in STUDY_QUERIES["severity_model_equations"](study).collect()}
    assert sums["(Intercept)"].observed == sums["(Intercept)"].fitted == sum(y for y, *_ in rows[:-1])
    assert "drug_concept_namerare" not in sums
    assert read.value == len(rows)
