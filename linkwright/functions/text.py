"""Normalisation and tokens of names; built-in functions but for Unicode decomposition, which runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a word consists of, and the edges of a word, for any script.
LETTERS = r"\p{L}\p{N}_"
START, END = rf"(?<![{LETTERS}])", rf"(?![{LETTERS}])"

# Legal suffixes, replaced in this order.
LEGAL = (
    ("incorporated", "inc"), ("corporation", "corp"), ("company", "co"), ("limited liability company", "llc"), ("limited liability partnership", "llp"),
    ("limited", "ltd"), ("public limited company", "plc"), ("gmbh", "gmbh"), ("pvt", "pvt"), ("private", "pvt"),
)
# Business words in names, replaced in this order; blanks stand for any space.
CANONICAL = (
    ("private limited", "pvt ltd"), ("private ltd", "pvt ltd"), ("pvt limited", "pvt ltd"), ("limited", "ltd"), ("technologies", "tech"), ("technology", "tech"), ("corporation", "corp"),
    ("enterprises", "enterprise"), ("company", "co"), ("industries", "ind"), ("industry", "ind"), ("services", "service"), ("solutions", "solution"),
)
# Words that say nothing, for blocking, for the large runs, and for the reranking runs; corporate words for shingles.
STOP_BLOCKING = (
    "the", "and", "of", "in", "at", "for", "on", "a", "an", "inc", "corp", "llc", "ltd", "co", "company", "corporation", "services", "group",
    "holdings", "solutions", "enterprises",
)
STOP_LARGE = (
    "the", "and", "of", "in", "at", "for", "on", "a", "an", "to", "by", "with", "inc", "corp", "llc", "ltd", "co", "company", "corporation",
    "limited", "pvt", "private", "public", "plc", "gmbh", "international", "national", "associates", "consulting", "center", "centre", "trust",
    "foundation", "institute", "india", "usa", "us", "america", "global", "null", "services", "solutions", "trading", "technologies", "industries",
    "enterprises", "technology", "developers", "ventures", "traders", "marketing", "group", "holdings", "management", "tech", "store", "sas",
    "france", "eurl", "des", "les", "aux", "pour", "dans", "par", "sur", "de", "du", "la", "le", "un", "une", "d", "l", "en", "au", "cie", "saint",
    "pc", "lp", "pllc", "llp", "brothers", "consultants", "consultancy", "sons",
)
STOP_RERANK = (
    "the", "and", "of", "in", "at", "for", "on", "a", "an", "to", "by", "with", "inc", "corp", "llc", "ltd", "co", "company", "corporation",
    "limited", "pvt", "private", "public", "plc", "gmbh", "null",
)
CORPORATE = (
    "private", "limited", "ltd", "pvt", "llp", "inc", "corp", "company", "co", "the", "and", "of", "in", "at", "for", "on", "a", "an",
)


@F.arrow_udf(T.StringType())
def nfkd(text: pa.Array) -> pa.Array:
    """Compatibility decomposition; marks stay."""
    return pc.utf8_normalize(text, form="NFKD")


@F.arrow_udf(T.StringType())
def fold(text: pa.Array) -> pa.Array:
    """Decomposed, what is not ASCII dropped, lower case."""
    return pc.ascii_lower(pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), r"[^\x00-\x7F]+", ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, where a column used repeatedly would be computed repeatedly."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word(pattern: str) -> str:
    return f"{START}(?:{pattern}){END}"


def replace_words(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.regexp_replace(c, word(old.replace(" ", r"(?U:\s)+")), new)
    return c


def normalize_name(text: Column) -> Column:
    x = F.lower(nfkd(F.coalesce(text, F.lit(""))))
    x = F.replace(F.replace(x, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    x = F.regexp_replace(x, rf"(?U)[^{LETTERS}\s\-]", " ")
    x = F.regexp_replace(x, r"(?U)\s*-\s*", " ")
    # a suffix of several words is sought with single blanks, as it stands then
    for old, new in LEGAL:
        x = F.regexp_replace(x, word(old), new)
    return clean_whitespace(x)


def tokens(c: Column) -> Column:
    """Words between white space, in order, with repeats."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def _outside(words: Sequence[str]):
    listed = F.array(*map(F.lit, words))
    return lambda x: ~F.array_contains(listed, x)


def informative_tokens(name: Column, least: int = 3) -> Column:
    keep = _outside(STOP_BLOCKING)
    return F.filter(tokens(name), lambda x: (F.length(x) >= least) & keep(x))


def longest_token(found: Column) -> Column:
    """The first of the longest; null for none."""
    return F.aggregate(found, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def tokens_large(text: Column, indic: Column | None = None) -> Column:
    """Tokens of two letters or more that are no stop word, domain endings dropped; all of two or more if none is left.

    indic is the transliterated text, for records whose country asks for it.
    """
    x = fold(F.coalesce(indic if indic is not None else text, F.lit("")))
    x = F.regexp_replace(x, r"\.(com|org|net|in|co|io|fr)" + END, "")
    every = F.filter(tokens(F.regexp_replace(x, r"[^a-z0-9\s]", " ")), lambda t: F.length(t) >= 2)
    keep = _outside(STOP_LARGE)
    return let(F.struct(every.alias("every"), F.filter(every, keep).alias("kept")), lambda s: F.when(F.size(s["kept"]) > 0, s["kept"]).otherwise(s["every"]))


def tokens_plain(text: Column) -> Column:
    return F.filter(tokens(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9\s]", " ")), lambda t: F.length(t) >= 2)


def tokens_rerank(text: Column) -> Column:
    return F.filter(tokens_plain(text), _outside(STOP_RERANK))


def canonical_name(name: Column) -> Column:
    return clean_whitespace(replace_words(name, CANONICAL))


def shingle(name: Column) -> Column:
    """The first two words that are not corporate, joined; one alone; or empty."""
    return F.array_join(F.slice(F.filter(tokens_plain(name), _outside(CORPORATE)), 1, 2), "_")


def clean_and_sort(ids: Column, own: Column | None = None) -> Column:
    """A list of ids stripped, without empty ones and the own id, each once, sorted; null is empty."""
    x = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.regexp_replace(i, r"(?U)^\s+|\s+$", ""))
    x = F.filter(x, lambda i: i != "")
    if own is not None:
        x = F.filter(x, lambda i: i != own)
    return F.array_sort(F.array_distinct(x))


def split_ids(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def cardinality(ids: Column) -> Column:
    n = F.size(ids)
    return F.when(n == 0, "singleton").when(n == 1, "single_match").otherwise("multi_match")
