"""Participant tables: carrier status and clinical covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import names, scalars
from cohortloom.operators import tables
from cohortloom.sources import lookups


def genotype_rows(wide: DataFrame, site_columns: Sequence[str] = ("#[1]CHROM", "[2]POS")) -> DataFrame:
    """One-site genotype table (a column per sample) as rows (sample_id, genotype)."""
    samples = [c for c in wide.columns if c not in set(site_columns)]
    quoted = wide.select(*[F.col(f"`{c}`") for c in samples])
    long = quoted.unpivot([], [F.col(f"`{c}`") for c in samples], "header", "genotype")
    return long.select(names.clean_genotype_header(F.col("header")).alias("sample_id"), "genotype")


def carrier_table(first: DataFrame, second: DataFrame, participants: DataFrame, demographics: DataFrame,
                  check: bool = True) -> DataFrame:
    """Allele call and carrier status of every participant with genotypes and demographics.

    ``first``/``second``: (sample_id, genotype); ``participants``: (participant,
    sample_id, ...); ``demographics``: (participant, age).
    """
    if check:
        tables.require_same_keys(first, second, "sample_id")
    calls = first.withColumnRenamed("genotype", "_g1").join(
        second.withColumnRenamed("genotype", "_g2"), "sample_id"
    ).select("sample_id", scalars.allele_call(F.col("_g1"), F.col("_g2")).alias("variant"))
    joined = participants.join(calls, "sample_id").join(demographics, "participant")
    return joined.withColumn("carrier", scalars.carrier_flag(F.col("variant")))


def place_scores(places: DataFrame, town: str, state: str, score: str, order: Sequence[str]) -> DataFrame:
    """First score of every town,state key."""
    keyed = places.withColumn("place", scalars.joined_key(F.col(town), F.col(state)))
    return tables.first_per_key(keyed.select("place", score, *order), ["place"], order).select("place", score)


def environment_table(answers: DataFrame, places: DataFrame, participant: str, subject: str,
                      order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Environment questionnaire: first answer per subject, numbers parsed, place recoded and scored.

    Reads concussrb, concusstb, driavgtb, drinktb, city1, state1 and ``keep``;
    ``places`` is (place, score).
    """
    first = tables.first_per_key(answers, [subject], order)
    concussions = F.coalesce(F.col("concussrb").cast("double"), F.lit(2.0)) * scalars.number_or_default(F.col("concusstb"))
    town = scalars.recode(F.col("city1"), lookups.CITY_CORRECTIONS)
    state = scalars.recode(F.col("state1"), lookups.STATE_CORRECTIONS)
    cleaned = first.select(
        participant, *keep, concussions.alias("concus"),
        scalars.number_or_default(F.col("driavgtb")).alias("driavgtb"),
        scalars.number_or_default(F.col("drinktb")).alias("drinktb"),
        scalars.joined_key(town, state).alias("place"),
    )
    return cleaned.join(places, "place").drop("place")


def mutation_flag(mutations: DataFrame, participant: str, genes: Sequence[str]) -> DataFrame:
    """1 when any gene is reported mutated; code 2 is unknown."""
    known = [scalars.clean_code(F.col(g), to_null=[2]) for g in genes]
    return mutations.select(participant, scalars.exceeds(scalars.row_sum(*known), 0).alias("general_mut"))


def vital_signs(vitals: DataFrame, participant: str, day: str, columns: Sequence[str]) -> DataFrame:
    """Baseline vital signs as numbers."""
    return vitals.where(F.col(day) == 0).select(
        participant, *[scalars.number_or_null(F.col(c)).alias(c) for c in columns])


def family_history(history: DataFrame, participant: str, relatives: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Flag for more than one affected kind of relative, first record per participant."""
    total = scalars.row_sum(*[F.col(c) for c in relatives])
    flagged = history.withColumn("history_tot", scalars.exceeds(total, 1))
    picked = [participant, *relatives, "history_tot", *[o for o in order if o not in relatives]]
    return tables.first_per_key(flagged.select(*picked), [participant], order).select(participant, *relatives, "history_tot")


def clinical_covariates(diagnosis: DataFrame, codes: Sequence[str], others: Sequence[DataFrame],
                        participant: str, check_unique: bool = True) -> DataFrame:
    """Diagnosis codes (90 missing, 2 as no) with all other tables joined to them."""
    clean = tables.across(diagnosis, codes, lambda c: scalars.clean_code(c, to_null=[90], to_zero=[2]))
    return tables.left_join_chain(clean, others, participant, check_unique)
