"""Logistic regressions of uptake, fitted for every group in the same Spark jobs.

Newton steps on (intercept, slope) per group: each step is one aggregation over histograms of x, which meets the small
table of the fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import tails
from ..session import stored
from .common import count_if, null_safe_join

STATE_BYTES = 256  # of a fit, at most, with its keys
BROADCAST_BYTES = 8 << 20


def offered_subjects(facts: DataFrame) -> DataFrame:
    """(provider, subjects): the subjects that each provider offers, in one row."""
    return facts.groupBy("provider").agg(F.collect_set("subject").alias("subjects"))


def exposed(people: DataFrame, facts: DataFrame) -> DataFrame:
    """``people`` with the array ``subjects`` that their provider offers, stored: one row a person, however many subjects.

    Rows are dealt evenly over the session's shuffle partitions, since what is made of them later is many times as large.
    """
    parts = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(people.join(offered_subjects(facts), "provider").repartition(parts), "exposed")


def per_subject(rows: DataFrame) -> DataFrame:
    """Rows of ``exposed`` once per offered subject: made where they are read, to be aggregated there."""
    return rows.withColumn("subject", F.explode("subjects")).drop("subjects")


def uptake_fits(people: DataFrame, facts: DataFrame, groups: Sequence[str], x: str, min_n: int = 0) -> DataFrame:
    """P(sits) ~ x per subject and ``groups`` (attributes of ``people``), among people whose provider offers the subject.

    Nobody is repeated per subject in any stored or shuffled table: the histogram of x per provider and group meets the
    provider's list of subjects, and what the fit needs from the takers are two sums, which come from the facts.
    """
    known = people.filter(F.col(x).isNotNull()).select("pupil", "provider", *groups, F.col(x).cast("double").alias("__x"))
    histogram = known.groupBy("provider", *groups, "__x").agg(F.count("*").alias("__n"))
    takers = facts.select("pupil", "provider", "subject").join(known, ["pupil", "provider"])
    sums = takers.groupBy("subject", *groups).agg(F.count("*").alias("s"), F.sum("__x").alias("sx"))
    return fit(per_subject(exposed(histogram, facts).drop("provider")), sums, ["subject", *groups], min_n)


def grouped_logit(
    df: DataFrame, groups: Sequence[str], y: str, x: str, min_n: int = 0, steps: int = 30, tolerance: float = 1e-10
) -> DataFrame:
    """y ~ x per group: one row per group with coefficients, standard errors and deviances."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = known.groupBy(*groups, F.col(x).cast("double").alias("__x")).agg(F.count("*").alias("__n"), F.sum(y).alias("__s"))
    counts = stored(counts, "counts")
    sums = counts.groupBy(*groups).agg(F.sum("__s").alias("s"), F.sum(F.col("__s") * F.col("__x")).alias("sx"))
    return fit(counts.drop("__s"), sums, groups, min_n, steps, tolerance)


def fit(rows: DataFrame, takers: DataFrame, keys: Sequence[str], min_n: int = 0, steps: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """Logistic regressions of all groups from sufficient statistics.

    Up to ``BROADCAST_BYTES`` of counted fits are sent to the histogram; more are joined by shuffle.

    ``rows``: keys, ``__x`` and ``__n``, the population's histogram, read once a Newton step and aggregated where it is
    read; ``takers``: keys, number ``s`` of positive outcomes and their sum ``sx`` of x. The state of the fits is a small
    table of its own, written once a step; only whether fits are open comes to the driver. Groups where the outcome or
    the predictor does not vary are left out; ``converged`` is false where the estimates ran off (complete separation) or
    the steps were used up.
    """
    x, n = F.col("__x"), F.col("__n")
    summary = rows.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.sum(x * n).alias("__sx"), F.sum(x * x * n).alias("__sxx"), (F.min("__x") < F.max("__x")).alias("__varies"))
    start = null_safe_join(summary, takers, keys, "inner").filter((F.col("n") > min_n) & (F.col("s") > 0) & (F.col("s") < F.col("n")) & F.col("__varies"))
    mean = F.col("__sx") / F.col("n")
    start = start.withColumns({"mean": mean, "scale": F.sqrt(F.greatest(F.col("__sxx") / F.col("n") - mean * mean, F.lit(0.0))), "share": F.col("s") / F.col("n")})
    start = start.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    none = F.lit(float("nan"))
    state = start.select(
        *keys, "n", F.col("s").cast("double").alias("s"), ((F.col("sx") - F.col("s") * F.col("mean")) / F.col("scale")).alias("sz"), "mean", "scale",
        (-2 * (F.col("s") * F.ln("share") + (F.col("n") - F.col("s")) * F.ln(1 - F.col("share")))).alias("null_deviance"),
        F.ln(F.col("share") / (1 - F.col("share"))).alias("a"), F.lit(0.0).alias("b"), *[none.alias(c) for c in ("v00", "v01", "v11", "deviance")],
        F.lit(False).alias("done"), F.lit(False).alias("failed"))
    state = stored(state, "state")
    few = state.count() * STATE_BYTES <= BROADCAST_BYTES
    for _ in range(steps):
        open_ = state.filter("not done")
        stepped = _newton_step(rows, F.broadcast(open_) if few else open_, keys, tolerance)
        state = stored(state.filter("done").unionByName(stepped), "state")
        if state.filter("not done").isEmpty():
            break
    ratio = F.col("mean") / F.col("scale")
    return state.select(
        *keys, "n", (F.col("a") - F.col("b") * ratio).alias("b0"), (F.col("b") / F.col("scale")).alias("b1"),
        F.sqrt(F.col("v00") - 2 * ratio * F.col("v01") + ratio * ratio * F.col("v11")).alias("se0"), (F.sqrt("v11") / F.col("scale")).alias("se1"),
        "deviance", "null_deviance", (F.col("done") & ~F.col("failed")).alias("converged"))


def _newton_step(rows: DataFrame, state: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """The fits after one step; at the solution they keep their estimates and are done."""
    kept = [c for c in state.columns if c not in keys]
    z = (F.col("__x") - F.col("mean")) / F.col("scale")
    met = null_safe_join(rows, state, keys, "inner").withColumn("__z", z)
    met = met.withColumn("__eta", F.col("a") + F.col("b") * F.col("__z")).withColumn("__p", 1 / (1 + F.exp(-F.col("__eta"))))
    n, p, zz, eta = (F.col(c) for c in ("__n", "__p", "__z", "__eta"))
    w = n * p * (1 - p)
    missed = -(F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))  # logarithm of 1 - p
    sums = met.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in kept], F.sum(n * p).alias("__s0"), F.sum(n * p * zz).alias("__s1"), F.sum(w).alias("__h00"), F.sum(w * zz).alias("__h01"),
        F.sum(w * zz * zz).alias("__h11"), F.sum(n * missed).alias("__missed"))
    h00, h01, h11 = F.col("__h00"), F.col("__h01"), F.col("__h11")
    sums = sums.withColumns({"__det": h00 * h11 - h01 * h01, "__g0": F.col("s") - F.col("__s0"), "__g1": F.col("sz") - F.col("__s1")})
    det = F.when(F.col("__det") > 0, F.col("__det"))
    sums = sums.withColumns({"__da": (h11 * F.col("__g0") - h01 * F.col("__g1")) / det, "__db": (h00 * F.col("__g1") - h01 * F.col("__g0")) / det})
    was, nan, failed = F.col("done"), F.lit(float("nan")), F.col("__da").isNull()
    arrived = failed | (F.greatest(F.abs("__da"), F.abs("__db")) < tolerance)
    new = {
        "v00": F.coalesce(h11 / det, nan), "v01": F.coalesce(-h01 / det, nan), "v11": F.coalesce(h00 / det, nan),
        "deviance": -2 * (F.col("a") * F.col("s") + F.col("b") * F.col("sz") + F.col("__missed")), "done": arrived, "failed": failed,
        "a": F.when(arrived, F.col("a")).otherwise(F.col("a") + F.col("__da")), "b": F.when(arrived, F.col("b")).otherwise(F.col("b") + F.col("__db")),
    }
    return sums.select(*keys, *[F.when(was, F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in kept])


def coefficient_rows(fits: DataFrame, groups: Sequence[str], x: str) -> DataFrame:
    """One row per coefficient of the converged fits with z and its p."""
    terms = F.explode(F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.col("b0").alias("est"), F.col("se0").alias("std_error")),
        F.struct(F.lit(x).alias("term"), F.col("b1").alias("est"), F.col("se1").alias("std_error")),
    ))
    rows = fits.filter("converged").select(*groups, "n", terms.alias("__c")).select(*groups, "n", "__c.*")
    return rows.withColumn("z", F.try_divide("est", "std_error")).withColumn("p", tails.p_of_z(F.col("z")))


def logit_uptake_by_flag(cohort: DataFrame, facts: DataFrame, flag: str = "flag", min_n: int = 0) -> DataFrame:
    """P(sits) ~ flag per (subject, gender) among pupils of providers offering the subject, in closed form.

    With a binary predictor the fit is the 2x2 table, so pupils are counted per provider before they meet the
    provider's subjects: no pupil is repeated.
    """
    people = cohort.filter(F.col(flag).isNotNull() & F.col("gender").isNotNull())
    offered = facts.select("provider", "subject").distinct()
    population = (
        people.groupBy("provider", "gender").agg(count_if(F.col(flag) == 0).alias("n0"), count_if(F.col(flag) == 1).alias("n1"))
        .join(offered, "provider")
        .groupBy("subject", "gender").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    takers = (
        facts.join(people.select("pupil", "provider", "gender", flag), ["pupil", "provider"])
        .groupBy("subject", "gender").agg(count_if(F.col(flag) == 0).alias("s0"), count_if(F.col(flag) == 1).alias("s1"))
    )
    table = population.join(takers, ["subject", "gender"]).filter(
        (F.col("n0") + F.col("n1") > min_n) & (F.col("s0") > 0) & (F.col("s1") > 0)
        & (F.col("s0") < F.col("n0")) & (F.col("s1") < F.col("n1"))
    )
    odds0, odds1 = F.col("s0") / (F.col("n0") - F.col("s0")), F.col("s1") / (F.col("n1") - F.col("s1"))
    v0 = 1 / F.col("s0") + 1 / (F.col("n0") - F.col("s0"))
    v1 = 1 / F.col("s1") + 1 / (F.col("n1") - F.col("s1"))
    return table.select(
        "subject", "gender", (F.col("n0") + F.col("n1")).alias("n"),
        F.ln(odds0).alias("b0"), F.sqrt(v0).alias("se0"),
        (F.ln(odds1) - F.ln(odds0)).alias("b1"), F.sqrt(v0 + v1).alias("se1"),
    )


def logit_interaction(fits: DataFrame, groups: Sequence[str], x: str, category: str) -> DataFrame:
    """y ~ x * category per group, the largest category being the base; ``fits`` are those per group and category.

    A full interaction is the same model as one regression per category, so the coefficients are those of the
    base and the differences from it, with independent standard errors.
    """
    fits = fits.filter("converged")
    top = fits.groupBy(*groups).agg(F.max(F.struct("n", category, "b0", "b1", "se0", "se1")).alias("base"))
    joined = null_safe_join(fits, top, groups, "inner")
    is_base = F.col(category).eqNullSafe(F.col(f"base.{category}"))
    terms = []
    for i, (main, other) in enumerate([("(Intercept)", ""), (x, f"{x}:")]):
        est = F.when(is_base, F.col(f"b{i}")).otherwise(F.col(f"b{i}") - F.col(f"base.b{i}"))
        own, base = F.pow(f"se{i}", 2), F.pow(F.col(f"base.se{i}"), 2)
        se = F.sqrt(F.when(is_base, own).otherwise(own + base))
        name = F.when(is_base, main).otherwise(F.concat(F.lit(other), F.col(category).cast("string")))
        terms.append(F.struct(name.alias("term"), est.alias("est"), se.alias("std_error")))
    rows = joined.select(*groups, "n", F.explode(F.array(*terms)).alias("__c")).select(*groups, "n", "__c.*")
    return rows.withColumn("z", F.try_divide("est", "std_error")).withColumn("p", tails.p_of_z(F.col("z")))


def logit_fit_quality(fits: DataFrame, x: str) -> DataFrame:
    """Model chi-squared with p, three pseudo R squared, and Wald intervals of the odds ratios, of the converged fits."""
    fits = fits.filter("converged")
    chi = F.col("null_deviance") - F.col("deviance")
    cox = 1 - F.exp(-chi / F.col("n"))
    out = fits.withColumns({
        "chi2": chi, "chi2_df": F.lit(1),
        "r2_hosmer": 1 - F.col("deviance") / F.col("null_deviance"), "r2_cox": cox,
        "r2_nagelkerke": cox / (1 - F.exp(-F.col("null_deviance") / F.col("n"))),
    })
    z = 1.959963984540054
    for i in (0, 1):
        out = out.withColumns({
            f"or{i}_low": F.exp(F.col(f"b{i}") - z * F.col(f"se{i}")), f"or{i}_high": F.exp(F.col(f"b{i}") + z * F.col(f"se{i}")),
        })
    return out.withColumn("p", tails.p_of_chi2(F.col("chi2"), F.lit(1.0))).withColumn("predictor", F.lit(x))
