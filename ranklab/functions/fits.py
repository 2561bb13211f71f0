"""Structured-term features of a (gig, provider) pair as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ranklab.functions.keys import key_to_long, seeded_key
from ranklab.functions.lexicon import AVAILABILITY_DECAY_DAYS, AVAILABILITY_PHRASES, GRADE_SCORE, SENIORITY


def budget_fit(lo: Column, hi: Column, rate: Column) -> Column:
    """1 inside the band, else 1 - gap / max(width, 1), at least 0. Cheaper is penalised like dearer."""
    width = F.greatest(hi - lo, F.lit(1.0))
    gap = F.when(rate < lo, lo - rate).otherwise(rate - hi)
    return F.when((rate >= lo) & (rate <= hi), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap / width))


def seniority_level(value: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), SENIORITY.items(), F).otherwise(F.lit(None).cast("int"))


def seniority_fit(needed: Column, has: Column) -> Column:
    """1 same level, .5 one apart, 0 two apart; unknown .5."""
    return F.coalesce(F.lit(1.0) - F.abs(seniority_level(needed) - seniority_level(has)) / F.lit(2.0), F.lit(0.5))


def sentinel_date(value: Column, as_of: Column) -> Column:
    """ISO date; 'now' and 'asap' are the anchor date; anything else NULL. The sentinels are tested first because a
    date cast would read 'now' as the current day."""
    iso = F.when(F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), value)
    return F.when(value.isin("now", "asap"), as_of).otherwise(iso.try_cast("date"))


def avail_immediacy(available_from: Column, start_by: Column, availability: Column, as_of: Column) -> Column:
    """Both dates: 1 if in time, decaying to 0 over 60 days. Otherwise the first phrase found; otherwise .5."""
    gap = F.datediff(sentinel_date(available_from, as_of), sentinel_date(start_by, as_of))
    dated = F.when(gap <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(AVAILABILITY_DECAY_DAYS)))
    text = F.lower(F.coalesce(availability, F.lit("")))
    phrase = reduce(lambda acc, kv: acc.when(F.contains(text, F.lit(kv[0])), F.lit(kv[1])), AVAILABILITY_PHRASES, F).otherwise(F.lit(0.5))
    return F.when(gap.isNotNull(), dated).otherwise(phrase)


def serious_term_mismatch(budget_hi: Column, rate: Column, needed: Column, has: Column, start_by: Column,
                          available_from: Column, commitment: Column, capacity: Column, as_of: Column) -> Column:
    """Array of mismatch kinds; a missing value never counts as one."""
    late = F.datediff(sentinel_date(available_from, as_of), sentinel_date(start_by, as_of))
    kinds = F.array(
        F.when(rate > budget_hi * 1.4, F.lit("budget")),
        F.when(F.abs(seniority_level(needed) - seniority_level(has)) == 2, F.lit("seniority")),
        F.when(late > 30, F.lit("start")),
        F.when(commitment - capacity >= 2, F.lit("days")))
    return F.array_compact(kinds)


def formula_relevance(same_speciality: Column, lo: Column, hi: Column, rate: Column, needed: Column, has: Column,
                      noise: Column) -> Column:
    """70 same speciality / 35 same category, +-10 budget, +-10 seniority, noise in -5..5, clipped to 1..100. The
    caller joins on category; pairs of different categories score 0 and are not rows."""
    base = F.when(same_speciality, F.lit(70)).otherwise(F.lit(35))
    budget = (F.when((rate >= lo) & (rate <= hi), F.lit(10))
              .when((rate >= lo * 0.75) & (rate <= hi * 1.25), F.lit(0)).otherwise(F.lit(-10)))
    diff = F.abs(seniority_level(needed) - seniority_level(has))
    level = F.when(diff == 0, F.lit(10)).when(diff == 1, F.lit(0)).otherwise(F.lit(-10))
    return F.greatest(F.lit(1), F.least(F.lit(100), base + budget + level + noise)).cast("int")


def relevance_noise(seed: int, *ids) -> Column:
    return (F.pmod(key_to_long(seeded_key(seed, "noise", *ids)), F.lit(11)) - 5).cast("int")


def score_of_grade(grade: Column) -> Column:
    """round(grade * 100 / 3)."""
    return reduce(lambda acc, kv: acc.when(grade == kv[0], F.lit(kv[1])), GRADE_SCORE.items(), F).otherwise(F.lit(0))


def grade_of_score(score: Column) -> Column:
    """round(score * 3 / 100)."""
    return F.bround(score * F.lit(3.0) / F.lit(100.0), 0).cast("int")
