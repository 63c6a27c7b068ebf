"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tracking parameters that never tell postings apart.
TRACKING = r"^(?:utm_[a-z]+|ref|source|gclid|fbclid|trk)=.*"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """https, lower-case host, tracking parameters and fragments off, parameters sorted, no trailing slash."""
    kept = F.array_sort(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lit("https://"), host(url), F.regexp_replace(path(url), "/+$", ""), tail)


def identity(url: Column) -> Column:
    """Host without www or a two-letter country label, path in lower case."""
    return F.concat(F.regexp_replace(host(url), r"^(?:www|[a-z]{2})\.", ""), F.lower(F.regexp_replace(path(url), "/+$", "")))


def in_domain(url: Column, domain: str) -> Column:
    return (host(url) == domain) | host(url).endswith(f".{domain}")


def ats_family(url: Column) -> Column:
    """Which applicant system a link belongs to; null for none known."""
    return F.when(in_domain(url, "greenhouse.io"), "greenhouse").when(in_domain(url, "lever.co"), "lever").when(in_domain(url, "ashbyhq.com"), "ashby")
