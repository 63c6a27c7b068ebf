"""A posting filter as one predicate.

Every field follows one rule: an unknown fact fails the filter unless ``include_unknown``
names the field, and exclusions beat inclusions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rolling windows of "posted within".
WINDOWS = {"24h": "INTERVAL 24 HOURS", "3d": "INTERVAL 3 DAYS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}
MANAGER_TITLE = r"(?i)\b(manager|director|head|chief|vp)\b"


def or_unknown(passes: Column, unknown: Column, include: bool) -> Column:
    """``passes`` where the fact is known; unknown facts pass only if included."""
    return F.when(unknown, F.lit(include)).otherwise(F.coalesce(passes, F.lit(False)))


def status(value: str = "open") -> Column:
    return F.col("status") == value


def any_of(column: str, values: list[str], include: bool = False) -> Column:
    return or_unknown(F.col(column).isin(values), F.col(column).isNull(), include)


def overlaps(column: str, values: list[str], include: bool = False) -> Column:
    wanted = F.array(*[F.lit(v) for v in values])
    unknown = F.col(column).isNull() | (F.size(column) == 0)
    return or_unknown(F.arrays_overlap(F.col(column), wanted), unknown, include)


def excludes(column: str, values: list[str]) -> Column:
    return ~F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])), F.lit(False))


def max_years(n: int, include: bool = False) -> Column:
    years = F.coalesce("years_min", "years_max")
    return or_unknown(years <= n, years.isNull(), include)


def posted_within(window: str, now: str, include: bool = False) -> Column:
    return or_unknown(F.col("posted_at") >= F.expr(f"TIMESTAMP_NTZ '{now}' - {WINDOWS[window]}"), F.col("posted_at").isNull(), include)


def pay_top(currency: str = "USD") -> Column:
    """Top of the yearly range in a currency; other currencies are unknown, never converted."""
    return F.when(F.col("currency") == currency, F.coalesce("annual_max", "annual_min"))


def min_pay(n: float, include: bool = False, currency: str = "USD") -> Column:
    return or_unknown(pay_top(currency) >= n, pay_top(currency).isNull(), include)


def remote_regions(values: list[str], include: bool = False) -> Column:
    """Remote postings open to one of the regions or to the world; remote without a scope is unknown."""
    wanted = F.array(*[F.lit(v) for v in [*values, "WORLDWIDE"]])
    inside = F.when(F.col("remote_regions").isNull(), F.lit(include)).otherwise(F.arrays_overlap("remote_regions", wanted))
    return F.when(F.col("work_model") == "remote", inside).when(F.col("work_model").isNull(), F.lit(include)).otherwise(F.lit(False))


def sponsors(likely: Column) -> Column:
    """Stated yes, or likely by history; a stated no always fails."""
    said = F.coalesce("sponsorship", F.lit("unstated"))
    return (said != "no") & ((said == "yes") | F.coalesce(likely, F.lit(False)))


def flag_off(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def is_manager() -> Column:
    return F.coalesce(F.col("level") == "manager", F.lit(False)) | F.col("title").rlike(MANAGER_TITLE)


def role_type(kind: str) -> Column:
    return is_manager() if kind == "manager" else ~is_manager()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def title_phrase(phrase: str) -> Column:
    """The phrase's words stand next to each other in the title."""
    padded = F.concat(F.lit(" "), F.array_join(words(F.col("title")), " "), F.lit(" "))
    return F.instr(padded, " " + " ".join(phrase.lower().split()) + " ") > 0


def job_function(functions: list[str]) -> Column:
    """All words of any function stand in the title."""
    have = words(F.col("title"))
    each = [reduce(lambda a, b: a & b, [F.array_contains(have, w) for w in f.lower().split()]) for f in functions]
    return reduce(lambda a, b: a | b, each)


#: Field -> builder(value, include_unknown).
FIELDS: dict[str, Callable] = {
    "status": lambda v, _: status(v),
    "levels": lambda v, u: any_of("level", v, u),
    "work_models": lambda v, u: any_of("work_model", v, u),
    "employment_types": lambda v, u: any_of("employment_type", v, u),
    "max_years": max_years,
    "posted_within": lambda v, u: posted_within(v[0], v[1], u),
    "min_pay": min_pay,
    "countries": lambda v, u: any_of("country", v, u),
    "remote_regions": remote_regions,
    "skills": lambda v, u: overlaps("skills", v, u),
    "exclude_skills": lambda v, _: excludes("skills", v),
    "sources": lambda v, u: overlaps("source_ids", v, u),
    "companies": lambda v, _: F.col("company_key").isin(v),
    "exclude_companies": lambda v, _: ~F.col("company_key").isin(v),
    "industries": lambda v, u: any_of("industry", v, u),
    "exclude_clearance": lambda v, _: flag_off("clearance_required") if v else F.lit(True),
    "exclude_citizen_only": lambda v, _: flag_off("us_citizen_only") if v else F.lit(True),
    "role_type": lambda v, _: role_type(v),
    "exclude_title": lambda v, _: reduce(lambda a, b: a & b, [~title_phrase(p) for p in v]),
    "job_functions": lambda v, _: job_function(v),
}


def compile_filter(spec: dict, include_unknown: list[str] = ()) -> Column:
    """One predicate of all fields of ``spec``; status is 'open' unless stated."""
    unknown_fields = set(spec) - set(FIELDS)
    if unknown_fields:
        raise ValueError(f"no such filter: {sorted(unknown_fields)}")
    parts = [FIELDS[k](v, k in include_unknown) for k, v in {"status": "open", **spec}.items() if v is not None]
    return reduce(lambda a, b: a & b, parts)
