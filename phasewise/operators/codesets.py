"""Named code sets and the sheet that turns them into indicator columns."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions import flags
from phasewise.functions.sizing import bounded
from phasewise.names import CONCEPT

SET_NAME = "concept_set_name"
INDICATOR = "indicator_prefix"


def current_members(concept_sets: DataFrame) -> DataFrame:
    """Members of the current version of each set; the flag may be text or boolean."""
    return concept_sets.where(F.col("is_most_recent_version").cast("string") == "true")


def concept_ids(concept_sets: DataFrame, names: list[str]) -> DataFrame:
    """Distinct concept ids of the named sets, current version only."""
    return bounded(
        current_members(concept_sets)
        .where(F.col(SET_NAME).isin(*names))
        .select(CONCEPT)
        .distinct()
    )


def concept_roles(concept_sets: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row per concept with a boolean column for each role (role -> set name).

    Replaces one id list per set: an event table is then joined once for all roles.
    """
    return (
        current_members(concept_sets)
        .where(F.col(SET_NAME).isin(*set(roles.values())))
        .groupBy(CONCEPT)
        .agg(*[F.bool_or(F.col(SET_NAME) == name).alias(role) for role, name in roles.items()])
    )


def concept_indicator_map(concept_sets: DataFrame, sheet: DataFrame, domain: str) -> DataFrame:
    """(concept, indicator) pairs the sheet asks for in one domain.

    The members meet the sheet where they are: it is the sheet that is sent to them, never the
    members, whose number grows, to the sheet.
    """
    wanted = sheet.where(F.col("domain").contains(domain)).select(SET_NAME, INDICATOR)
    return (
        current_members(concept_sets)
        .join(bounded(wanted), SET_NAME)
        .select(CONCEPT, INDICATOR)
        .distinct()
    )


def indicator_words(pairs: DataFrame, indicators: list[str]) -> DataFrame:
    """One row per concept (and domain, if there is one): its indicators as bit words.

    A concept in several sets stays one row, so joining events to it never multiplies them.
    """
    keys = [c for c in ("domain", CONCEPT) if c in pairs.columns]
    return (
        pairs.select(*keys, *flags.words_by_label(INDICATOR, indicators))
        .groupBy(*keys)
        .agg(*flags.merged(indicators))
    )


def domain_indicator_map(concept_sets: DataFrame, sheet: DataFrame, domains: list[str]) -> DataFrame:
    """(domain, concept, indicator) for all given domains at once."""
    named = F.array(*[F.when(F.col("domain").contains(d), F.lit(d)) for d in domains])
    wanted = sheet.select(SET_NAME, INDICATOR, F.explode(F.array_compact(named)).alias("domain"))
    return (
        current_members(concept_sets)
        .join(bounded(wanted), SET_NAME)
        .select("domain", CONCEPT, INDICATOR)
        .distinct()
    )


def merge_sheets(required: DataFrame, custom: DataFrame) -> DataFrame:
    """Full outer join on all columns of the required sheet; equal nulls match (C12)."""
    keys = required.columns
    same: Column = reduce(
        lambda a, b: a & b, [required[k].eqNullSafe(custom[k]) for k in keys]
    )
    return required.join(custom, same, "full").select(
        *[F.coalesce(required[k], custom[k]).alias(k) for k in keys],
        *[custom[c] for c in custom.columns if c not in keys],
    )
