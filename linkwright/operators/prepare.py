"""Records made ready for blocking and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address, text
from ..functions.translit import transliterate_large, transliterate_rerank

# The countries that are processed.
COUNTRIES = ("France", "US", "India")


def processed(records: DataFrame, name: str = "name", addr: str = "address") -> DataFrame:
    """Normalised name and address, the raw ones kept, and the parts of the normalised address."""
    out = records.withColumns({"raw_name": F.col(name), "raw_address": F.col(addr)})
    out = out.withColumns({"name": text.normalize_name(F.col("raw_name")), "address": address.normalize_address(F.col("raw_address"))})
    return out.select("*", F.explode(F.array(address.parse_address(F.col("address")))).alias("_parts")).select("*", "_parts.*").drop("_parts")


def prepared_large(records: DataFrame, indic_address: bool = True, transliterate: bool = True) -> DataFrame:
    """clean_name, clean_addr, tokens (as they stand), addr_tokens (each once), house and postal.

    Names, and addresses if indic_address, of the country India are transliterated; without transliterate none is, which keeps
    records of other countries out of that worker.
    """
    india = (F.col("country") == "India") & F.lit(transliterate)
    name, addr = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("address", F.lit("")))
    if transliterate:
        name_in, addr_in = F.when(india, transliterate_large(name)).otherwise(name), F.when(india, transliterate_large(addr)).otherwise(addr) if indic_address else addr
    else:
        name_in, addr_in = name, addr
    out = records.withColumns({"clean_name": text.fold(name_in), "clean_addr": text.fold(addr_in)})
    c_addr = F.col("clean_addr")
    return out.withColumns({"tokens": text.tokens_large(F.col("clean_name")), "addr_tokens": F.array_distinct(text.tokens_large(c_addr)), "house": address.house_number_large(c_addr), "postal": address.postal_code(c_addr)})


def prepared_rerank(records: DataFrame, stop_words: bool = True, indic: bool = True) -> DataFrame:
    """As above with the reranking rules: other tokens and house numbers, and the name's shingle."""
    source = {c: transliterate_rerank(F.coalesce(c, F.lit(""))) if indic else F.coalesce(c, F.lit("")) for c in ("name", "address")}
    out = records.withColumns({"clean_name": text.fold(source["name"]), "clean_addr": text.fold(source["address"])})
    toks = text.tokens_rerank if stop_words else text.tokens_plain
    c_addr = F.col("clean_addr")
    return out.withColumns({"tokens": toks(F.col("clean_name")), "addr_tokens": F.array_distinct(toks(c_addr)), "house": address.house_number_rerank(c_addr), "postal": address.postal_code(c_addr), "shingle": text.shingle(F.col("clean_name"))})


def only_countries(records: DataFrame, countries: Sequence[str] = COUNTRIES) -> DataFrame:
    """Records of the countries that are processed; others, and those of no country, go."""
    return records.where(F.col("country").isin(list(countries)))


def is_subset(inner: Column, outer: Column) -> Column:
    """Whether all of one array's elements are in another; so are those of an empty array, and of a null one it is unknown."""
    return F.size(F.array_except(inner, outer)) == 0
