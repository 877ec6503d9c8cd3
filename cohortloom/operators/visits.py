"""Visit series: numbering, time from baseline, first values, slopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.operators.ranks import number_rows, rows_per_slice
from cohortloom.operators.tables import keep_repeated

DAYS_PER_YEAR = 365.25


def days_from_baseline(df: DataFrame, subject: str, date: str, out: str = "day") -> DataFrame:
    """Days since the subject's first date."""
    start = df.groupBy(subject).agg(F.min(date).alias("_start"))
    return df.join(start, subject).withColumn(out, F.datediff(date, "_start")).drop("_start")


def number_visits(df: DataFrame, subject: str, day: str, tiebreak: Sequence[str],
                  at_least: int = 2) -> DataFrame:
    """Subjects with enough visits, visits numbered in date order, years from baseline."""
    kept = keep_repeated(df, subject, at_least)
    numbered = number_rows(kept, [subject], [day, *tiebreak], "visit")
    return numbered.withColumn("years", F.col(day) / F.lit(DAYS_PER_YEAR))


def visit_series(df: DataFrame, subject: str, date: str, tiebreak: Sequence[str],
                 at_least: int = 2) -> DataFrame:
    """Days and years from baseline and visit numbers, for dated rows.

    First date and row count come from one aggregate over two columns, which
    also tells whether any subject is too large for a plain window; rows are
    then shuffled by subject once, for the join and the numbering alike.
    """
    summary = df.groupBy(subject).agg(F.min(date).alias("_start"), F.count(F.lit(1)).alias("_rows"))
    largest = summary.agg(F.max("_rows")).first()[0] or 0
    kept = df.join(summary.where(F.col("_rows") >= at_least), subject)
    dated = kept.withColumn("day", F.datediff(date, "_start")).drop("_start", "_rows")
    small = largest <= rows_per_slice(df)
    numbered = number_rows(dated, [subject], ["day", *tiebreak], "visit", small_groups=small)
    return numbered.withColumn("years", F.col("day") / F.lit(DAYS_PER_YEAR))


def baseline_rows(df: DataFrame, subject: str, day: str) -> DataFrame:
    """All rows at the subject's first time."""
    start = df.groupBy(subject).agg(F.min(day).alias(day))
    return df.join(start, [subject, day], "left_semi")


def slopes(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares intercept and slope per group; NULL where x does not vary."""
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def slopes_of_moments(stats: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """``slopes`` from moment rows of columns near zero mean; a variance that is only rounding counts as none."""
    varies = F.col(f"c_{x}|{x}") > 1e-12 * F.pow(f"m_{x}", 2)
    slope = F.when(varies, F.col(f"c_{y}|{x}") / F.col(f"c_{x}|{x}"))
    return stats.select(*by, F.col("n").cast("long").alias("n"), slope.alias("slope"),
                        (F.col(f"m_{y}") - slope * F.col(f"m_{x}")).alias("intercept"))


def trend_lines(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Line per group with what its confidence band needs.

    se(x0) = sigma * sqrt(1/n + (x0 - mean_x)^2 / sxx)
    """
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.avg(x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    rss = F.col("_syy") - F.try_divide(F.pow("_sxy", 2), "sxx")
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(rss, F.col("n") - 2)))
    return fit.withColumn("sigma", sigma).drop("_syy", "_sxy")
