"""Group statistics from moments: one aggregation gives every test and every regression at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tails
from .common import count_if, percent

# Bounds of the effect size below which a name applies.
EFFECT_SIZES = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]


def two_group_moments(value: Column, in_a: Column, in_b: Column) -> list[Column]:
    """Count, mean and variance of a value in two groups, as aggregates."""
    out = []
    for name, member in (("a", in_a), ("b", in_b)):
        v = F.when(member, value)
        out += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}")]
    return out


def welch(moments: DataFrame) -> DataFrame:
    """Welch t, degrees of freedom, Cohen's d with magnitude, from columns n_/mean_/var_ of a and b."""
    ea, eb = F.try_divide("var_a", "n_a"), F.try_divide("var_b", "n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    freedom = F.try_divide(F.pow(ea + eb, 2), F.try_divide(ea * ea, F.col("n_a") - 1) + F.try_divide(eb * eb, F.col("n_b") - 1))
    pooled = F.try_divide(
        (F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), F.col("n_a") + F.col("n_b") - 2
    )
    out = moments.withColumns({
        "t": F.try_divide(diff, F.sqrt(ea + eb)), "df": freedom, "d": F.try_divide(diff, F.sqrt(pooled)),
    })
    size = None
    for bound, name in EFFECT_SIZES:
        hit = F.abs("d") < bound
        size = F.when(hit, name) if size is None else size.when(hit, name)
    return out.withColumn("magnitude", F.when(F.col("d").isNotNull(), size.otherwise("large")))


def welch_ttest(df: DataFrame, groups: Sequence[str], value: Column, in_a: Column, in_b: Column) -> DataFrame:
    return welch(df.groupBy(*groups).agg(*two_group_moments(value, in_a, in_b)))


def with_p(tests: DataFrame) -> DataFrame:
    """Two-sided p of a t column, and the test as text; a test without a value has no text."""
    out = tests.withColumn("p", tails.p_of_t(F.col("t"), F.col("df")))
    known = F.col("df").isNotNull() & F.col("t").isNotNull() & F.col("p").isNotNull() & F.col("d").isNotNull()
    text = F.format_string("_t_(%.0f)=%.3f _p_=%.3f _d_=%.2f", "df", "t", "p", "d")
    return out.withColumn("description", F.when(known, text))


# --- least squares ----------------------------------------------------------------------------------------------


def two_predictor_moments(y: str, x1: str, x2: str) -> list[Column]:
    """Centred second moments (divided by n - 1) of a response and two predictors."""
    return [
        F.count("*").alias("n"),
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.var_samp(y).alias("vy"), F.var_samp(x1).alias("v1"), F.var_samp(x2).alias("v2"),
        F.covar_samp(x1, x2).alias("c12"), F.covar_samp(x1, y).alias("c1"), F.covar_samp(x2, y).alias("c2"),
    ]


def solve_two_predictors(moments: DataFrame) -> DataFrame:
    """Coefficients, standard errors, fit and the gain over the second predictor alone, in closed form."""
    det = F.col("v1") * F.col("v2") - F.pow("c12", 2)
    out = moments.withColumns({
        "b1": F.try_divide(F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12"), det),
        "b2": F.try_divide(F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12"), det),
        "__det": det, "__k": F.col("n") - 1, "res_df": F.col("n") - 3,
    }).withColumns({
        "b0": F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2"),
        "rss": F.col("__k") * (F.col("vy") - F.col("b1") * F.col("c1") - F.col("b2") * F.col("c2")),
        "tss": F.col("__k") * F.col("vy"),
        # residual sum of squares of the model with the second predictor only
        "rss_reduced": F.col("__k") * (F.col("vy") - F.try_divide(F.pow("c2", 2), "v2")),
    })
    sigma2 = F.try_divide("rss", "res_df")
    scale = F.try_divide(sigma2, F.col("__k") * F.col("__det"))
    mean_form = (
        F.pow("m1", 2) * F.col("v2") + F.pow("m2", 2) * F.col("v1") - 2 * F.col("m1") * F.col("m2") * F.col("c12")
    )
    return out.withColumns({
        "se0": F.sqrt(F.try_divide(sigma2, "n") + scale * mean_form),
        "se1": F.sqrt(scale * F.col("v2")), "se2": F.sqrt(scale * F.col("v1")),
        "r2": 1 - F.try_divide("rss", "tss"),
        "adj_r2": 1 - F.try_divide(sigma2, "vy"),
        "f": F.try_divide((F.col("tss") - F.col("rss")) / 2, sigma2),
        "sum_sq": F.col("rss_reduced") - F.col("rss"),
        "chi2": F.try_divide(F.col("rss_reduced") - F.col("rss"), sigma2),
    }).drop("__det", "__k")


def coefficient_rows(fitted: DataFrame, keys: Sequence[str], terms: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per coefficient: est, se, t."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"b{i}").alias("est"), F.col(f"se{i}").alias("std_error"))
        for i, t in enumerate(terms)
    ]))
    return (
        fitted.select(*keys, *keep, rows.alias("__c")).select(*keys, *keep, "__c.*")
        .withColumn("t", F.try_divide("est", "std_error"))
    )


def ols_by_subject(
    facts: DataFrame, gender: str = "gender", male: str = "M", prior: str = "prior", min_n: int = 60, min_prior: int = 40
) -> DataFrame:
    """points ~ male + mean of the other subjects, for every subject with enough pupils."""
    enough = facts.groupBy("subject").agg(F.count("*").alias("pupils"), F.count(prior).alias("__prior")).filter(
        (F.col("pupils") > min_n) & (F.col("__prior") > min_prior)
    ).drop("__prior")
    used = facts.filter(F.col(gender).isNotNull() & F.col("other_mean").isNotNull()).withColumn(
        "__male", (F.col(gender) == male).cast("double")
    )
    moments = used.groupBy("subject").agg(*two_predictor_moments("points", "__male", "other_mean"))
    fitted = solve_two_predictors(moments.join(enough, "subject"))
    return coefficient_rows(fitted, ["subject"], ["(Intercept)", "male", "other_mean"], ["pupils", "n", "res_df", "r2", "adj_r2", "f"])


def ols_simple(df: DataFrame, groups: Sequence[str], y: str, x: str) -> DataFrame:
    """y ~ x per group: intercept and slope rows with standard errors, t and R squared."""
    used = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    moments = used.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.var_samp(y).alias("vy"),
        F.var_samp(x).alias("vx"), F.covar_samp(x, y).alias("cxy"),
    )
    fitted = moments.withColumn("b1", F.try_divide("cxy", "vx")).withColumns({
        "b0": F.col("my") - F.col("b1") * F.col("mx"),
        "r2": F.try_divide(F.col("b1") * F.col("cxy"), F.col("vy")),
        "res_df": F.col("n") - 2,
    })
    sigma2 = F.try_divide((F.col("n") - 1) * (F.col("vy") - F.col("b1") * F.col("cxy")), F.col("res_df"))
    sxx = (F.col("n") - 1) * F.col("vx")
    fitted = fitted.withColumns({
        "se1": F.sqrt(F.try_divide(sigma2, sxx)),
        "se0": F.sqrt(sigma2 * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.pow("mx", 2), sxx))),
    })
    return coefficient_rows(fitted, groups, ["(Intercept)", x], ["n", "res_df", "r2"])


def with_t_p(rows: DataFrame) -> DataFrame:
    """p of coefficient rows."""
    return rows.withColumn("p", tails.p_of_t(F.col("t"), F.col("res_df").cast("double")))


def anova_p(fitted: DataFrame) -> DataFrame:
    """Chi-squared p of the nested comparison."""
    return fitted.withColumn("anova_p", tails.p_of_chi2(F.col("chi2"), F.lit(1.0)))


# --- data quality -----------------------------------------------------------------------------------------------


def field_health(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Per field: rows, missing (null or blank), present, missing share; one aggregation for all fields."""
    fields = list(fields or df.columns)
    missing = [count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in fields]
    one_row = df.agg(F.count("*").alias("__n"), *missing)
    return one_row.unpivot(["__n"], fields, "field", "missing").select(
        "field", F.col("__n").alias("n"), "missing", (F.col("__n") - F.col("missing")).alias("present"),
        F.round(F.try_divide("missing", "__n"), 6).alias("missing_share"),
    )


def missing_report(df: DataFrame, field: str) -> DataFrame:
    blank = F.coalesce(F.col(field).cast("string"), F.lit("")) == ""
    return df.agg(F.count("*").alias("n"), count_if(blank).alias("missing")).withColumn("per", percent("missing", "n", 2))


def dedupe_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct ids, and the rows beyond one per id."""
    per_key = df.groupBy(key).agg(F.count("*").alias("__n"))
    return per_key.agg(F.sum("__n").alias("n"), F.count(key).alias("ids")).withColumns({
        "surplus": F.col("n") - F.col("ids"), "per": percent(F.col("n") - F.col("ids"), "n", 2),
    })
