"""Logistic regression on counted covariate patterns."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import cut_lineage

# Executors need not have this package installed: its functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_PATTERNS = 200_000
# Steps towards profile bounds, the largest move of a coefficient in a step, and the
# size beyond which a coefficient counts as infinite.
PROFILE_STEPS = 60
MOST_MOVE = 2.0
INFINITE = 50.0
FAR = 12.0
FLAT = 1e-9


def count_rows(df: DataFrame, columns: Sequence[str], count: str = "n_rows") -> DataFrame:
    """The distinct rows of the columns, each with its number in ``count``; stored.

    ``df`` is planned and read once, however often the result is read. Functions with
    a parameter ``count`` take such rows by the name of their count.
    """
    return cut_lineage(df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count)))


def _number(count: str | None) -> Column:
    """How many rows a row stands for."""
    return F.lit(1) if count is None else F.col(count)


def _patterns(df: DataFrame, label: str, features: Sequence[str], count: str | None = None) -> DataFrame:
    """The distinct covariate patterns: share exposed and count, stored. Rows with a gap are left out."""
    patterns = (
        df.select(F.col(label).cast("double").alias("outcome"), *features, _number(count).alias("_number"))
        .dropna()
        .groupBy(*features)
        .agg(
            (F.sum(F.col("outcome") * F.col("_number")) / F.sum("_number")).alias("outcome"),
            F.sum("_number").cast("double").alias("_weight"),
        )
    )
    return cut_lineage(patterns)


def _fit(patterns: DataFrame, features: Sequence[str]):
    """Binomial fit on the distinct covariate patterns.

    Equal rows carry the same information, so every iteration reads patterns
    (ages x races x ...) instead of persons. The alphabetically first level of a
    text column is the reference level.
    """
    formula = RFormula(
        formula="outcome ~ " + " + ".join(features),
        featuresCol="_features",
        labelCol="_y",
        stringIndexerOrderType="alphabetDesc",
        handleInvalid="error",
    ).fit(patterns)
    fitted = GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        labelCol="_y",
        featuresCol="_features",
        weightCol="_weight",
        predictionCol="_prediction",
        maxIter=50,
        tol=1e-10,
    ).fit(formula.transform(patterns))
    return formula, fitted


def propensity_score(
    df: DataFrame, treat: str = "has_lsd", covariates: Sequence[str] = ("Age", "Race", "Sex"), count: str | None = None
) -> DataFrame:
    """Add ``score``, the fitted probability of exposure; NULL where a covariate is.

    Scores are computed once per covariate pattern and joined back, so that
    persons with equal covariates have the very same score. The patterns are
    broadcast only when their counted number is small. Without a complete row there
    is no fit and no score. ``df`` is read twice; where it is dear, give rows counted
    by ``count_rows`` and the name of their ``count``.
    """
    patterns = _patterns(df, treat, covariates, count)
    found = patterns.count()
    if not found:
        return df.withColumn("score", F.lit(None).cast("double"))
    formula, fitted = _fit(patterns, covariates)
    scores = fitted.transform(formula.transform(patterns)).select(*covariates, F.col("_prediction").alias("score"))
    if found <= BROADCAST_PATTERNS:
        scores = F.broadcast(scores)
    return df.join(scores, list(covariates), "left").select(*df.columns, "score")


def score_equations(df: DataFrame, outcome: str, score: str, features: Sequence[str], count: str | None = None) -> DataFrame:
    """Sums of the outcome and of its fitted probability, each weighted by every term: ``term, observed, fitted``.

    A logistic fit with an intercept is the one at which both sums agree for the intercept,
    each number and each level of a text, so this checks a fit of any size without
    another one. Rows without a score are left out. Terms are named feature, then level.
    With ``count`` a row stands for as many.
    """
    kinds = dict(df.dtypes)
    used = df.filter(F.col(score).isNotNull())
    weights = [(F.lit("(Intercept)"), F.lit(1.0))]
    for feature in features:
        text = kinds[feature] == "string"
        weights.append((F.concat(F.lit(feature), F.col(feature)) if text else F.lit(feature), F.lit(1.0) if text else F.col(feature).cast("double")))
    terms = F.array(*[F.struct(name.alias("term"), (weight * _number(count)).alias("weight")) for name, weight in weights])
    spread = used.select(F.col(outcome).cast("double").alias("_y"), F.col(score).alias("_p"), F.inline(terms))
    return spread.groupBy("term").agg(F.sum(F.col("_y") * F.col("weight")).alias("observed"), F.sum(F.col("_p") * F.col("weight")).alias("fitted"))


def min_group_size(df: DataFrame, key: str, n: int = 500, count: str | None = None) -> DataFrame:
    """Rows of the groups that have more than ``n`` rows.

    Group sizes are aggregated and joined back; a window would put all rows of a
    group into one task. With ``count`` a row stands for as many.
    """
    sizes = df.groupBy(key).agg(F.sum(_number(count)).alias("_size"))
    large = sizes.filter(F.col("_size") > n).select(F.col(key).alias("_key"))
    return df.join(large, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def _term(name: str, features: Sequence[str]) -> str:
    """Level columns are named feature then level, without a separator."""
    owner = max((f for f in features if name.startswith(f + "_")), key=len, default=None)
    return name if owner is None or name in features else owner + name[len(owner) + 1 :]


def _names(designed: DataFrame, features: Sequence[str]) -> list[str]:
    """Terms in the order of the coefficients, the intercept first."""
    meta = designed.schema["_features"].metadata["ml_attr"]["attrs"]
    attributes = sorted((a for kind in meta.values() for a in kind), key=lambda a: a["idx"])
    return ["(Intercept)", *[_term(a["name"], features) for a in attributes]]


def _likelihoods(designed: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and second derivatives at several coefficient vectors, in one job."""
    count, size = candidates.shape

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((count, 1 + size + size * size))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), np.stack(batch["x"])])
            y, w = batch["outcome"].to_numpy()[:, None], batch["_weight"].to_numpy()[:, None]
            eta = x @ candidates.T
            share = 0.5 * (1 + np.tanh(eta / 2))
            total[:, 0] += (w * (y * eta - np.logaddexp(0, eta))).sum(axis=0)
            total[:, 1 : size + 1] += (x.T @ (w * (y - share))).T
            spread = w * share * (1 - share)
            for k in range(count):
                total[k, size + 1 :] -= (x.T @ (spread[:, k : k + 1] * x)).ravel()
        yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    sums = designed.mapInPandas(parts, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    whole = np.zeros(count * (1 + size + size * size))
    whole[sums["place"].to_numpy()] = sums["value"].to_numpy()
    whole = whole.reshape(count, -1)
    return whole[:, 0], whole[:, 1 : size + 1], whole[:, size + 1 :].reshape(count, size, size)


def profile_bounds(df: DataFrame, label: str, features: Sequence[str], conf: float = 0.95) -> DataFrame:
    """Profile-likelihood bounds: ``term, estimate, conf_low, conf_high``.

    A bound of a coefficient is where the likelihood, all other coefficients fitted anew,
    has fallen by half the chi-square quantile. Both bounds of all terms are sought at
    once: each step is one job over the patterns that gives the derivatives at all
    candidates, and each candidate moves to where the quadratic it sees there has the
    wanted height with the other slopes zero. A bound that runs off or does not settle
    is NULL.
    """
    patterns = _patterns(df, label, features)
    formula, fitted = _fit(patterns, features)
    transformed = formula.transform(patterns)
    names = _names(transformed, features)
    designed = cut_lineage(transformed.select(vector_to_array("_features").alias("x"), "outcome", "_weight"))
    best = np.array([fitted.intercept, *fitted.coefficients.toArray()])
    size = len(best)
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    top, _, second = _likelihoods(designed, best[None])
    goal = top[0] - z * z / 2
    spread = -np.linalg.pinv(second[0])
    term, side = np.repeat(np.arange(size), 2), np.tile([-1.0, 1.0], size)
    now = best + side[:, None] * z * spread[term] / np.sqrt(np.maximum(spread[term, term], 1e-12))[:, None]
    # a level without outcome has no finite estimate, yet one finite bound: start where there are slopes
    endless = np.abs(best).max() > FAR
    now = np.where(endless, np.clip(best, -FAR / 2, FAR / 2), now)
    done = np.zeros(len(term), dtype=bool)
    lost = ~np.isfinite(now).all(axis=1)
    for _ in range(PROFILE_STEPS):
        open_ = np.flatnonzero(~done & ~lost)
        if not len(open_):
            break
        height, slope, second = _likelihoods(designed, now[open_])
        for i, k in enumerate(open_):
            inverse = np.linalg.pinv(second[i])
            own = inverse[term[k], term[k]]
            # without curvature the likelihood is flat: the coefficient has run off
            if not own < 0 or second[i][term[k], term[k]] > -FLAT:
                lost[k] = True
                continue
            fall = goal - height[i] + slope[i] @ inverse @ slope[i] / 2
            push = -side[k] * np.sqrt(max(2 * fall / own, 0.0))
            move = -inverse @ slope[i] + push * inverse[:, term[k]]
            move *= min(1.0, MOST_MOVE / max(np.abs(move).max(), 1e-300))
            now[k] += move
            others = np.abs(np.delete(slope[i], term[k])).max(initial=0.0)
            done[k] = np.abs(move).max() < 1e-9 and abs(height[i] - goal) < 1e-7 and others <= 1e-5 * abs(slope[i][term[k]])
            lost[k] = abs(now[k, term[k]]) > INFINITE
    found = [float(value) if good else None for value, good in zip(now[np.arange(len(term)), term], done, strict=True)]
    rows = [(name, float(estimate), found[2 * i], found[2 * i + 1]) for i, (name, estimate) in enumerate(zip(names, best, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, conf_low double, conf_high double")


def logistic_terms(df: DataFrame, label: str, features: Sequence[str], conf: float = 0.95) -> DataFrame:
    """One row per model term with estimate, error, z, p and Wald bounds."""
    patterns = _patterns(df, label, features)
    formula, fitted = _fit(patterns, features)
    names = _names(formula.transform(patterns), features)
    summary = fitted.summary
    errors = summary.coefficientStandardErrors
    p_values = summary.pValues
    # the summary lists the intercept last
    estimates = [fitted.intercept, *fitted.coefficients.toArray().tolist()]
    errors = [errors[-1], *errors[:-1]]
    p_values = [p_values[-1], *p_values[:-1]]
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    rows = [
        (name, est, se, est / se, p, est - z * se, est + z * se)
        for name, est, se, p in zip(names, estimates, errors, p_values, strict=True)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "term string, estimate double, std_error double, statistic double, p_value double, "
        "conf_low double, conf_high double",
    )


def odds_ratios(terms: DataFrame) -> DataFrame:
    """Terms with odds ratio and bounds."""
    return terms.withColumns(
        {"odds_ratio": F.exp("estimate"), "top_ci": F.exp("conf_high"), "bottom_ci": F.exp("conf_low")}
    )
