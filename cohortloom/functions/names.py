"""Cleaning of identifiers that arrive as column headers or row labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the genotype headers (`[3]ID-b38:GT`) and of the
# run names (`ID-P12_x`).
GENOTYPE_HEADER = r"^\[[0-9]+\]|-b38(?=:GT)|:GT$"
RUN_SUFFIX = r"(-P).+$"


def clean_genotype_header(header: Column) -> Column:
    """Sample id inside a genotype table header."""
    return F.regexp_replace(header, GENOTYPE_HEADER, "")


def clean_run_name(run: Column) -> Column:
    """Sample id of a mass-spectrometry run: suffix dropped, `_` as `-`."""
    return F.regexp_replace(F.regexp_replace(run, RUN_SUFFIX, "$1"), "_", "-")


def part(text: Column, separator: str, position: int) -> Column:
    """The ``position``-th part (from 1) of a delimited text, NULL when absent."""
    return F.try_element_at(F.split(text, separator), F.lit(position))


def syntactic(name: Column) -> Column:
    """Name usable as a column: odd characters to dots, ``X`` before a bad start."""
    dotted = F.regexp_replace(name, r"[^A-Za-z0-9._]", ".")
    return F.when(F.regexp_like(dotted, F.lit(r"^([A-Za-z]|\.([^0-9]|$))")), dotted).otherwise(
        F.concat(F.lit("X"), dotted)
    )
