"""Text functions, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms, and letters that need two.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
PAIRS = {"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "đ": "d", "ı": "i"}
#: Legal endings of company names.
LEGAL = "inc|incorporated|llc|ltd|limited|corp|corporation|co|company|gmbh|plc|lp|llp|sa|ag"
#: Words dropped from a query when others remain.
QUERY_STOP_WORDS = ["a", "an", "the", "and", "or", "not", "near", "of", "in", "on", "at", "for", "to", "with", "by", "from", "as", "is", "job", "jobs"]
#: Frequent English words, for content words and the guess of a language.
STOP_WORDS = ["the", "of", "and", "a", "to", "in", "it", "that", "for", "on"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular replacements one after the other."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def normalize(text: Column) -> Column:
    """Odd spaces, dashes and quotes become plain ones; runs of blanks become one."""
    return F.trim(chain(text, ("[  -  　]", " "), ("[​﻿]", ""), ("[‐-―]", "-"), ("[‘’]", "'"), ("[“”]", '"'), ("[ \\t]+", " ")))


def fold_accents(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), PAIRS.items(), F.translate(text, MARKED, PLAIN))


def dictionary_key(text: Column) -> Column:
    """Lower case, accents folded, & as and, punctuation as spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(fold_accents(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def place_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", " "))


def special_tokens(text: Column) -> Column:
    """Names that symbols belong to become words."""
    return chain(F.lower(text), (r"c\+\+", "cplusplus"), (r"c#", "csharp"), (r"(^|[^a-z0-9])\.net", "$1dotnet"), (r"([a-z]+)\.js", "$1js"), (r"401\(k\)", "401k"), (r"r&d", "randd"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold_accents(special_tokens(text)), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: Column, most: int = 12) -> Column:
    """Distinct terms of the first 500 characters, without stop words unless nothing else is left."""
    found = F.array_distinct(tokens(F.substr(text, F.lit(1), F.lit(500))))
    rest = F.array_except(found, F.array(*[F.lit(w) for w in QUERY_STOP_WORDS]))
    return F.slice(F.when(F.size(rest) > 0, rest).otherwise(found), 1, most)


def snippet(text: Column, term: str, width: int = 400) -> Column:
    """``width`` characters around a term's first place."""
    at = F.locate(term, F.lower(text))
    return F.substr(text, F.greatest(F.lit(1), at - width // 4), F.lit(width))


def company_key(name: Column) -> Column:
    """Match key: dba and parentheses off, & as and, leading the and legal endings off."""
    base = chain(F.lower(fold_accents(name)), (r"\([^)]*\)", " "), (r"&", " and "), (r"\b([a-z])\.", "$1"), (r"[^a-z0-9]+", " "), (r"^ *the ", ""), (r"^ +| +$", ""))
    return F.regexp_replace(base, rf"(?: (?:{LEGAL}))+$", "")


def split_dba(name: Column) -> Column:
    return F.transform(F.split(name, r"(?i) +d/?b/?a +"), lambda x: F.trim(x))


def title_key(title: Column) -> Column:
    """Title without parentheses, years and seasons."""
    return F.trim(chain(F.lower(title), (r"\([^)]*\)", " "), (r"\b(?:19|20)[0-9]{2}\b", " "), (r"\b(?:spring|summer|fall|autumn|winter)\b", " "), (r"[^a-z0-9+#]+", " ")))


def decode_entities(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), text)


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments off; blocks become lines; entities decoded."""
    body = chain(html, (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", ""), (r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|nav|title|body|head|html)\b[^>]*>", "\n"), (r"<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(decode_entities(body), r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def cut_at(text: Column, heading: str) -> Column:
    """Lines before the first that matches a heading."""
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(heading)), True)
    return F.when(first > 0, F.array_join(F.slice(lines, F.lit(1), (first - 1).cast("int")), "\n")).otherwise(text)


def drop_block(text: Column, start: str, stop: str) -> Column:
    """Lines from one that matches ``start`` up to the next that matches ``stop`` are left out."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("off"))

    def step(a: Column, x: Column) -> Column:
        off = F.when(x.rlike(stop), False).when(x.rlike(start), True).otherwise(a["off"])
        return F.struct(F.when(off, a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"), off.alias("off"))

    return F.array_join(F.aggregate(F.split(text, "\n"), state, step, lambda a: a["out"]), "\n")


def language_guess(text: Column) -> Column:
    """en or other by the share of English stop words; null for very short texts."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    share = F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))) / F.size(words)
    return F.when(F.size(words) < 5, None).when(share >= 0.15, "en").otherwise("other")


def fold_word(word: Column) -> Column:
    """Plural and inflection folded."""
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(?:[sx]|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard share of content words."""
    content = lambda c: F.array_except(F.array_distinct(F.transform(tokens(c), fold_word)), F.array(*[F.lit(w) for w in STOP_WORDS]))
    both = F.size(F.array_union(content(a), content(b)))
    return F.when(both > 0, F.size(F.array_intersect(content(a), content(b))) / both).otherwise(F.lit(0.0))
