"""Scalar expressions for participant and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Fixed values: (first site, second site, call) for the two-site allele call.
ALLELE_CALLS = (
    ("0/0", "1/1", "22"),
    ("0/0", "0/1", "23"),
    ("0/1", "0/1", "24"),
    ("0/0", "0/0", "33"),
    ("0/1", "0/0", "34"),
    ("1/1", "0/0", "44"),
)
# Calls that carry the risk allele.
CARRIER_CALLS = ("24", "34", "44")


def unphased(genotype: Column) -> Column:
    """``1|0`` and ``1/0`` become ``0/1``; a missing allele gives NULL."""
    alleles = F.array_sort(F.split(F.translate(genotype, "|", "/"), "/"))
    return F.when(~F.contains(genotype, F.lit(".")), F.concat_ws("/", alleles))


def allele_call(first: Column, second: Column) -> Column:
    """Allele call from the genotypes at two sites; NULL for any other pair."""
    pair = F.concat_ws(" ", unphased(first), unphased(second))
    calls = [F.lit(v) for a, b, call in ALLELE_CALLS for v in (f"{a} {b}", call)]
    return F.try_element_at(F.create_map(*calls), pair)


def carrier_flag(call: Column, unknown: str = "non_carrier") -> Column:
    """1 for carriers, else 0.  ``unknown='null'`` keeps a missing call missing."""
    flag = call.isin(*CARRIER_CALLS).cast("int")
    return flag if unknown == "null" else F.coalesce(flag, F.lit(0))


def clean_code(code: Column, to_null: Sequence[int] = (), to_zero: Sequence[int] = ()) -> Column:
    """Questionnaire code with some values read as missing and some as zero."""
    out = code
    if to_zero:
        out = F.when(code.isin(*to_zero), F.lit(0)).otherwise(out)
    if to_null:
        out = F.when(code.isin(*to_null), F.lit(None)).otherwise(out)
    return out


def number_or_null(text: Column) -> Column:
    """Text as a double; text that is no number gives NULL, also in ANSI mode."""
    return F.trim(text).try_cast("double")


def number_or_default(text: Column, default: float = 0.0) -> Column:
    """Blank or missing text gives ``default``; text that is no number gives NULL."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit(float(default))).otherwise(number_or_null(text))


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values and keep all others."""
    entries = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), value), value)


def joined_key(*parts: Column, sep: str = ",", missing: str = "NA") -> Column:
    """Key built from several columns, a missing part written as ``missing``."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])


def safe_log2(value: Column) -> Column:
    """log2 for positive values, else NULL."""
    return F.when(value > 0, F.log2(value))


def row_sum(*columns: Column) -> Column:
    """Row-wise sum with missing values as zero."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0))
    return total


def exceeds(total: Column, threshold: float) -> Column:
    """0/1 flag for a total above a threshold."""
    return (total > threshold).cast("int")


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


def wald_low(estimate: Column, std_error: Column, z: float = 1.96) -> Column:
    return estimate - F.lit(z) * std_error


def wald_high(estimate: Column, std_error: Column, z: float = 1.96) -> Column:
    return estimate + F.lit(z) * std_error


def outcome_flag(status: Column, positive: str) -> Column:
    """1 for the positive label, 0 for any other."""
    return (status == positive).cast("int")


def tertile_group(value: Column, low: Column, high: Column) -> Column:
    """fast / mid / slow by the lower and upper tertile."""
    return (
        F.when(value <= low, "fast").when(value >= high, "slow").when(value.isNotNull(), "mid")
    )


def specificity_category(first: Column, second: Column, third: Column,
                         names: Sequence[str]) -> Column:
    """Category of a feature from three high/low flags.

    ``names`` are the labels for: all three, only the first, only the second,
    only the third, anything else (two of three, or none).
    """
    shared, only_first, only_second, only_third, other = names
    return (
        F.when(first & second & third, shared)
        .when(first & ~second & ~third, only_first)
        .when(~first & second & ~third, only_second)
        .when(~first & ~second & third, only_third)
        .otherwise(other)
    )
