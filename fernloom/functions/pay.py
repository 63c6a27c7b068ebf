r"""Pay from free text: all money spans, each judged by the words around it, then the best that do not overlap.

Three patterns propose spans: a marked amount or range (``$60,000 - $70,000``), one with the mark behind
(``60.000 EUR``) and bare numbers (``48k - 60k``).  A span is read with its clause: words after it and before it
tell the period, "up to" and "from" leave a bound open, cue words speak for pay, others for bonuses, benefits, company
money, market figures or amounts on top.  Of spans that overlap, the set with the largest sum of scores stays.  Base
pay goes before other pay, totals are read only if nothing else is stated, several ranges are counted and
the one that names the place is taken, else the first.

All steps are columns; each is a projection of its own, so nothing is computed twice.  A text has few money
spans, and lists hold one text's.

Defined cases: a null text and one without usable spans give null; a bare ``$`` is the country's, else USD; a figure
without a period is yearly from 10,000 and hourly below 500 (in units of its currency), else not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.functions.facts import PER_YEAR, first_case, js_round, parse_number

PAY = "struct<min:double,max:double,currency:string,period:string,annual_min:double,annual_max:double,ranges:int,start:int,end:int>"

#: Marks and the currencies they stand for, countries' own, and rough units to a dollar (for plausibility only).
MARKS = {
    "US$": "USD", "C$": "CAD", "CA$": "CAD", "A$": "AUD", "AU$": "AUD", "MX$": "MXN", "€": "EUR", "£": "GBP", "¥": "JPY", "円": "JPY", "₹": "INR",
    "USD": "USD", "EUR": "EUR", "GBP": "GBP", "CAD": "CAD", "AUD": "AUD", "CHF": "CHF", "INR": "INR", "JPY": "JPY", "SEK": "SEK", "MXN": "MXN",
}
OF_COUNTRY = {"US": "USD", "CA": "CAD", "AU": "AUD", "MX": "MXN", "GB": "GBP", "DE": "EUR", "FR": "EUR", "ES": "EUR", "IT": "EUR", "NL": "EUR", "IE": "EUR", "CH": "CHF", "SE": "SEK", "JP": "JPY", "IN": "INR"}
DOLLARS = ["US", "CA", "AU", "MX"]
SCALE = {"USD": 1.0, "CAD": 1.35, "AUD": 1.5, "MXN": 18.0, "EUR": 0.92, "GBP": 0.79, "CHF": 0.88, "SEK": 10.5, "JPY": 150.0, "INR": 83.0}
#: Least and largest plausible pay of a period, in dollars.
PLAUSIBLE = {"hour": (2, 500), "day": (20, 5_000), "week": (80, 20_000), "month": (300, 100_000), "year": (5_000, 3_000_000)}

MARK = r"(?:US\$|CA?\$|AU?\$|MX\$|[$€£¥₹]|(?:USD|EUR|GBP|CAD|AUD|CHF|INR|JPY|SEK|MXN)(?![A-Za-z]))"
BEHIND = r"(?:€|£|円|(?:USD|EUR|GBP|CAD|AUD|CHF|INR|JPY|SEK|MXN|euros?)(?![A-Za-z]))"
NUM = r"(?<![\dA-Za-z.,\-])(?:\d{1,3}(?:[,.' ]\d{2,3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)(?!\d)"
AFTER_MARK = NUM.replace(r"(?<![\dA-Za-z.,\-])", "")
K = r"(?:\s?[kK](?![A-Za-z]))?"
UNIT = r"(?:\s?(?:/|per|an?)\s?(?:hour|hr|h|day|week|wk|month|mo|year|yr|yearly|annum)(?![A-Za-z]))?"
TO = r"\s*(?:-|–|—|\bto\b|\bbis\b|\bà\b|\band\b(?: go up to)?|\band go up to\b)\s*"
MARKED = rf"{MARK}\s?(?:{MARK}\s?)?\(?{AFTER_MARK}{K}{UNIT}(?:{TO}(?:{MARK}\s?)?{AFTER_MARK}{K}(?![\d]))?"
MARKED_BEHIND = rf"{NUM}{K}\s?(?:{BEHIND})?(?:{TO}{AFTER_MARK}{K}\s?)?(?<![A-Za-z]){BEHIND}"
BARE = rf"{NUM}{K}(?:{TO}{AFTER_MARK}{K})?"

CUE = r"(?i)\b(?:pay|paid|pays|hourly|salary|salaries|salario|sueldo|compensation|comp|wages?|rates?|earn\w*|income|remuneration|rémunération|\w*gehalt|vergütung|\w*lohn|range|base)\b"
#: Patterns of spans, each with what a text must hold for one of them to count: bare numbers do so only by a cue.
PATTERNS = [(MARKED, MARK), (MARKED_BEHIND, BEHIND), (BARE, CUE.replace(r"\b", ""))]

BASE = r"(?i)\b(?:base|basic|fixed|fixe|guaranteed)\b"
TOTAL = r"(?i)\b(?:ote|on[- ]target|total (?:target )?(?:compensation|comp|cash|pay|package|earnings)|(?:with|including) (?:commissions?|bonus(?:es)?|tips)|package)\b"
NOT_PAY = (
    r"(?i)\b(?:bonus(?:es)?|sign[- ]?(?:on|up)|retention|referrals?|relocation|stipends?|allowances?|reimburs\w*|tuition|401|match(?:ing)?|hsa|fsa|hra|fertility|pension|retirement|equity|stock|commissions?"
    r"|differentials?|incentives?|overtime|revenues?|funding|raised|valuation|invest\w*|budgets?|loans?|credits?|discounts?|grants?|prizes?|fees?|costs?|deposits?|insurance|savings|deals?|quota|portfolio"
    r"|per diem for|wellness|learning|parking|meals?|customers?|clients?|experience)\b"
)
MARKET = r"(?i)\b(?:prevailing wages?|wage records?|according to|similar (?:roles?|positions?|jobs?)|comparable (?:roles?|positions?|jobs?)|other (?:companies|employers)|(?:typically|usually) (?:pay|earn|make)|(?:median|average|typical) (?:\w+ ){0,2}(?:salary|pay|wages?)|(?:national|market|industry) (?:average|median))\b"
ON_TOP = r"(?i)(?:\bplus\b|\+|\badditional\b|\bextra\b|\bon top of\b)\s*(?:an?\s*)?(?:of\s*)?$"
REJECTED = r"(?i)^\s*(?:%|percent|years?(?![a-z])|yrs?(?![a-z])|million|billion|m(?![a-z])|mm(?![a-z])|b(?![a-z])|bn(?![a-z])|hours? (?:of|per|a)|employees|people|customers|(?:/|per|an?)\s*(?:mile|visit|shift|class|unit|session|patient|case|call|delivery))"
UP_TO = r"(?i)(?:up to|as much as|maximum(?: of)?|max\.?:?|capped at|jusqu'à|hasta)\s*$"
FROM = r"(?i)(?:\bfrom|starting(?: (?:at|from|pay|rate|wage|salary))?(?: (?:of|at|is))?|starts at|at least|minimum(?: of)?|min\.?:?|\bab|desde|à partir de)\s*$"
FROM_AFTER = r"(?i)^\s*(?:\+(?=\s*(?:$|[/.,;:)\n]|per\b|an?\s|hourly|annually))|(?:or more|and up|minimum)(?![a-z]))"
OTHER_JOBS = r"(?im)^[ \t]*(?:similar|other|more|related|recommended) (?:jobs|positions|openings)[ \t]*:?[ \t]*$[\s\S]*"
#: Period words right behind a figure (fillers such as "gross" may stand between), and before it.
FILLER = r"(?i)^(?:\s*(?:gross|brutto|brut|net|before tax|base(?: salary| pay)?|usd|eur|cad|gbp|aud|\(|\)))*"
UNIT_WORDS = {
    "hour": (r"(?:(?:/|per|an?|por|par|pro|each)\s*(?:hours?|hrs?|h|hora|heure|stunde)|hourly)", r"(?:hourly|per hour|an hour|時給)"),
    "day": (r"(?:(?:/|per|an?|por|par|pro)\s*(?:days?|día|jour|tag)|daily)", r"(?:daily|per day|day rate)"),
    "week": (r"(?:(?:/|per|an?|por|par|pro)\s*(?:weeks?|wk|semana|semaine|woche)|weekly)", r"(?:weekly|per week)"),
    "month": (r"(?:(?:/|per|an?|por|par|pro)\s*(?:months?|mo|mes|mois|monat)|monthly|mensual(?:es)?|mensuel(?:le)?|monatlich)", r"(?:monthly|per month|mensual|monatlich)"),
    "year": (r"(?:(?:/|per|an?|por|par|pro)\s*(?:years?|yrs?|yearly|annum|año|an|jahr)|annual(?:ly)?|yearly|annuel(?:le)?|jährlich|p\.?a\.?)", r"(?:annual(?:ly)?|yearly|per year|per annum|jährlich|年収)"),
}
LAST_UNIT = r"(?s)^.*((?i:(?<![a-z])(?:" + "|".join(rx for _, rx in UNIT_WORDS.values()) + r")(?![a-z])))"


def _last(rx: str, text: Column) -> Column:
    """Length of a text up to the end of the last match, 0 if none."""
    return F.length(F.regexp_extract(text, rf"(?s)^(.*{rx})", 1))


def _reach(text: Column, rx: str) -> Column:
    """Of each match of a pattern, the length from the end of the match before it to its own end."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{rx})"), F.lit(0)), F.length)


def _placed(hits: str, reach: str, mark: int) -> Column:
    """``array<struct<start,end,s,mark>>`` of the matches in one column and their reach in another, so that the text is not searched again for each."""
    end = lambda i: F.aggregate(F.slice(reach, F.lit(1), i + 1), F.lit(0), lambda a, n: a + n)
    return F.transform(hits, lambda h, i: F.struct((end(i) - F.length(h)).alias("start"), end(i).alias("end"), h.alias("s"), F.lit(mark).alias("mark")))


class _Spans:
    """The list of spans of each row; every step adds fields made from those there are, so no expression is repeated."""

    def __init__(self, rows: DataFrame, names: list[str]):
        self.rows, self.names = rows, names

    def add(self, **fields) -> None:
        names = self.names
        self.rows = self.rows.withColumn("_c", F.transform("_c", lambda m: F.struct(*[m[n].alias(n) for n in names], *[f(m).alias(k) for k, f in fields.items()])))
        self.names = [*names, *fields]


def _mapped(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("")))


def _plausible(units: Column, period: Column) -> Column:
    return F.coalesce(first_case([(period == k, units.between(lo, hi)) for k, (lo, hi) in PLAUSIBLE.items()]), F.lit(False))


def _soon(rx: str, words: int) -> str:
    """The words stand shortly behind."""
    return rf"(?i)^\W*(?:\w+\W+){{0,{words}}}(?:{rx[4:]})"


def _read(spans: _Spans, home: Column, dollar: Column) -> None:
    """Numbers, currency and period of every span, from its own text and the clause around it."""
    aside = r"(?:[^\w+]|\bin\b|\ban?\b|\bannual(?:ly)?\b|\bper year\b|/ ?(?:year|yr|month)\b)*"
    spans.add(
        tokens=lambda m: F.regexp_extract_all(m["s"], F.lit(rf"({AFTER_MARK})"), F.lit(1)),
        ks=lambda m: F.regexp_extract_all(m["s"], F.lit(rf"{AFTER_MARK}\s?([kK]?)"), F.lit(1)),
        sign=lambda m: F.regexp_extract(m["s"], rf"({MARK}|{BEHIND})", 1),
        second=lambda m: F.regexp_extract(m["s"], rf"{MARK}\s?({MARK})", 1),
        ahead=lambda m: F.regexp_extract(m["before"], r"\b(USD|EUR|GBP|CAD|AUD|CHF|INR|JPY|SEK|MXN)\s*$", 1),
        behind=lambda m: F.regexp_replace(F.regexp_extract(m["after"], r"^[^\n]*", 0), FILLER, ""),
        tail=lambda m: F.substr(m["before"], _last(CUE, m["before"]) + 1),  # what stands between the last cue and the span
        base=lambda m: m["before"].rlike(BASE) | m["after"].rlike(_soon(BASE, 1)),
        nearest=lambda m: F.regexp_extract(m["before"], LAST_UNIT, 1),
    )
    spans.add(
        n1=lambda m: F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(F.get(m["tokens"], F.lit(0)), F.lit("")), "[' ]", ","), r"^(\d{1,3})\.(\d{3}),(\d{1,2})$", "$1$2.$3"), F.lit("")),
        n2=lambda m: F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(F.get(m["tokens"], F.lit(1)), F.lit("")), "[' ]", ","), r"^(\d{1,3})\.(\d{3}),(\d{1,2})$", "$1$2.$3"), F.lit("")),
        k1=lambda m: F.coalesce(F.get(m["ks"], F.lit(0)), F.lit("")) != "",
        k2=lambda m: F.coalesce(F.get(m["ks"], F.lit(1)), F.lit("")) != "",
        after_p=lambda m: first_case([(m["behind"].rlike(rf"(?i)^\s*{rx}(?![a-z])"), k) for k, (rx, _) in UNIT_WORDS.items()]),
        inside_p=lambda m: first_case([(m["s"].rlike(rf"(?i)\d\s?[kK]?\s?{rx}(?![a-z])"), k) for k, (rx, _) in UNIT_WORDS.items()]),
        code=lambda m: F.coalesce(F.when(F.length(m["ahead"]) == 3, m["ahead"]), F.when(F.length(m["second"]) == 3, m["second"])),
        total=lambda m: (m["before"].rlike(TOTAL) & ~m["tail"].rlike(BASE)) | m["after"].rlike(_soon(TOTAL, 1)),
        bad=lambda m: m["tail"].rlike(NOT_PAY)
        | (m["after"].rlike(rf"(?i)^{aside}(?:\w+\W+){{0,1}}(?:{NOT_PAY[4:]})") & ~m["after"].rlike(r"^\s*[+,]"))
        | m["before"].rlike(MARKET) | m["after"].rlike(MARKET) | m["tail"].rlike(ON_TOP) | m["after"].rlike(REJECTED),
    )
    spans.add(v1=lambda m: parse_number(m["n1"]), v2=lambda m: parse_number(m["n2"]), before_p=lambda m: F.when(m["nearest"] != "", first_case([(m["nearest"].rlike(rf"(?i)^{rx}$"), k) for k, (_, rx) in UNIT_WORDS.items()])))
    spans.add(
        w1=lambda m: m["v1"] * F.when(m["k1"] | (m["k2"] & (m["v1"] < 1000)), 1000).otherwise(1),  # a k behind the second counts for both
        w2=lambda m: m["v2"] * F.when(m["k2"] | (m["k1"] & (m["v2"] < 1000)), 1000).otherwise(1),
        told=lambda m: F.coalesce(m["after_p"], m["inside_p"], m["before_p"]),
        currency=lambda m: F.when(m["sign"] == "$", F.coalesce(m["code"], dollar)).when(m["sign"] == "", home).otherwise(F.coalesce(F.when(m["sign"].rlike("^euro"), "EUR"), _mapped(MARKS, m["sign"]))),
    )
    spans.add(low=lambda m: F.least(m["w1"], m["w2"]), top=lambda m: F.greatest(m["w1"], m["w2"]), two=lambda m: m["w2"].isNotNull(), scale=lambda m: _mapped(SCALE, m["currency"]))


def _close(spans: _Spans) -> None:
    """Bounds, period and weight of every span, and whether it can be pay."""
    spans.add(
        period=lambda m: F.coalesce(m["told"], F.when(m["top"] / m["scale"] >= 10_000, "year").when(m["top"] / m["scale"] < 500, "hour")),
        upto=lambda m: m["before"].rlike(UP_TO) & ~m["two"],
        least=lambda m: (m["before"].rlike(FROM) | m["after"].rlike(FROM_AFTER)) & ~m["two"],
        weight=lambda m: F.when(m["mark"] < 2, 2.0).otherwise(0.0) + m["told"].isNotNull().cast("double") + m["cue"].cast("double") + F.when(m["two"], 0.5).otherwise(0.0),
    )
    spans.add(min=lambda m: F.when(~m["upto"], m["low"]), max=lambda m: F.when(m["two"] | m["upto"] | ~m["least"], m["top"]))
    spans.add(
        fine=lambda m: F.coalesce(
            ~m["bad"]
            & (m["told"].isNotNull() | m["cue"] | (m["two"] & (m["top"] / m["scale"] >= 10_000)))
            & ((m["mark"] < 2) | (m["cue"] & (m["k1"] | m["k2"] | m["told"].isNotNull()) & (m["two"] | m["told"].isNotNull())))
            & _plausible(m["low"] / m["scale"], m["period"])
            & _plausible(m["top"] / m["scale"], m["period"])
            & (m["top"] / m["low"] <= F.when(m["total"], 8).otherwise(5)),
            F.lit(False),
        )
    )


def best_apart(spans: Column) -> Column:
    """Of ``array<struct<end,start,weight,...>>``, sorted, the spans that do not overlap with the largest sum of weights, in order.

    A fold over the spans by their end: the best choice up to each span either leaves it out or joins it to the best
    choice that ends before it.
    """
    kind = "struct<end:int,sum:double,picks:array<int>>"
    ordered = spans
    start = F.array(F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("picks")).cast(kind))
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))

    def step(table: Column, i: Column) -> Column:
        m = F.get(ordered, i)
        fits = F.filter(table, lambda t: t["end"] <= m["start"])
        base, last = F.element_at(fits, -1), F.element_at(table, -1)
        joined = F.struct(m["end"].alias("end"), (base["sum"] + m["weight"]).alias("sum"), F.concat(base["picks"], F.array(i)).alias("picks")).cast(kind)
        kept = F.struct(m["end"].alias("end"), last["sum"].alias("sum"), last["picks"].alias("picks")).cast(kind)
        return F.concat(table, F.array(F.when(joined["sum"] > kept["sum"], joined).otherwise(kept)))

    picks = F.element_at(F.aggregate(places, start, step), -1)["picks"]
    return F.transform(picks, lambda i: F.get(ordered, i))


def _annual(value: Column, period: Column) -> Column:
    return F.when(period == "year", value).otherwise(js_round(value * first_case([(period == k, F.lit(v)) for k, v in PER_YEAR.items()])))


def _same_or_inside(a: Column, b: Column) -> Column:
    """Whether a says what b says: nearly the same range, or one figure inside it."""
    near = lambda x, y: (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= F.greatest(F.lit(1.0), 0.03 * F.greatest(x, y)), F.lit(False))
    same = (a["currency"] == b["currency"]) & near(_annual(a["min"], a["period"]), _annual(b["min"], b["period"])) & near(_annual(a["max"], a["period"]), _annual(b["max"], b["period"]))
    one = F.coalesce(a["min"], a["max"])
    single = a["min"].isNull() | a["max"].isNull() | (a["min"] == a["max"])
    return same | (single & (a["currency"] == b["currency"]) & (a["period"] == b["period"]) & F.coalesce(one.between(b["min"], b["max"]), F.lit(False)))


def with_pay(df: DataFrame, text: str, country: str | None = None, places: str | None = None, name: str = "pay") -> DataFrame:
    """``df`` plus a struct ``name`` (see ``PAY``), null where no pay is stated.

    ``country`` (ISO code) names a bare ``$``; ``places`` (array) has words of the posting's place, to choose among ranges.
    """
    t, home = F.col("_text"), F.col(country) if country else F.lit(None).cast("string")
    dollar = F.when(home.isin(DOLLARS), _mapped(OF_COUNTRY, home)).otherwise("USD")
    rows = df.withColumn("_text", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), OTHER_JOBS, ""))
    for k, (rx, needed) in enumerate(PATTERNS):
        some, none = t.rlike(r"\d") & t.rlike(needed), F.array()
        rows = rows.withColumn(f"_s{k}", F.when(some, F.regexp_extract_all(t, F.lit(rx), F.lit(0))).otherwise(none.cast("array<string>")))
        rows = rows.withColumn(f"_r{k}", F.when(F.size(f"_s{k}") > 0, _reach(t, rx)).otherwise(none.cast("array<int>")))
    all_ = range(len(PATTERNS))
    spans = _Spans(rows.withColumn("_c", F.concat(*[_placed(f"_s{k}", f"_r{k}", k) for k in all_])).drop(*[f"_{x}{k}" for x in "sr" for k in all_]), ["start", "end", "s", "mark"])
    spans.add(
        before=lambda m: F.regexp_extract(F.substr(t, F.greatest(m["start"] - 90, F.lit(0)) + 1, F.least(m["start"], F.lit(90))), r"(?:[^.!?;\n•|]|\.(?=\S))*$", 0),
        after=lambda m: F.regexp_extract(F.substr(t, m["end"] + 1, F.lit(60)), r"^(?:[^.!?;\n•|]|\.(?=[a-z0-9]))*", 0),
    )
    spans.add(cue=lambda m: m["before"].rlike(CUE) | m["after"].rlike(_soon(CUE, 3)))
    spans.rows = spans.rows.withColumn("_c", F.filter("_c", lambda m: (m["mark"] < 2) | m["cue"]))  # bare numbers without one are never pay
    _read(spans, _mapped(OF_COUNTRY, home), dollar)
    _close(spans)
    rows = spans.rows
    slim = F.transform(F.filter("_c", lambda m: m["fine"]), lambda m: F.struct(*[m[c].alias(c) for c in ("end", "start", "weight", "min", "max", "currency", "period", "base", "total")], F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", m["before"], m["after"])), r"[^\p{L}\p{N}]+", " "), F.lit(" ")).alias("label")))
    rows = rows.withColumn("_c", F.array_sort(slim))
    rows = rows.withColumn("_c", best_apart(F.col("_c")))
    rows = rows.withColumn("_c", F.when(F.exists("_c", lambda m: ~m["total"]), F.filter("_c", lambda m: ~m["total"])).otherwise(F.col("_c")))
    kept = F.filter("_c", lambda m, i: ~F.exists(F.slice("_c", F.lit(1), i), lambda e: _same_or_inside(m, e)))  # said before
    rows = rows.withColumn("_c", kept)
    rows = rows.withColumn("_c", F.filter("_c", lambda m, i: ~F.exists(F.slice("_c", i + 2, F.size("_c")), lambda e: _same_or_inside(m, e) & ~_same_or_inside(e, m))))  # a figure inside a later range
    here = F.array().cast("array<string>") if places is None else F.filter(F.transform(F.coalesce(F.col(places), F.array().cast("array<string>")), lambda w: F.trim(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", " "))), lambda w: F.length(w) >= 2)
    named = F.filter("_c", lambda m: F.exists(here, lambda w: F.contains(m["label"], F.concat(F.lit(" "), w, F.lit(" ")))))
    base = F.filter("_c", lambda m: m["base"])
    first = F.get("_c", F.lit(0))
    chosen = F.when((F.size("_c") > 1) & (F.size(named) == 1), F.get(named, F.lit(0))).when(~first["base"] & (F.size(base) > 0), F.get(base, F.lit(0))).otherwise(first)
    rows = rows.withColumn("_pick", chosen)
    p = F.col("_pick")
    pay = F.struct(p["min"].alias("min"), p["max"].alias("max"), p["currency"].alias("currency"), p["period"].alias("period"), _annual(p["min"], p["period"]).cast("double").alias("annual_min"), _annual(p["max"], p["period"]).cast("double").alias("annual_max"), F.size("_c").alias("ranges"), p["start"].alias("start"), p["end"].alias("end"))
    return rows.withColumn(name, F.when(p.isNotNull(), pay).cast(PAY)).drop("_text", "_c", "_pick")
