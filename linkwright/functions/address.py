"""Addresses: normalisation, parsing into parts, house numbers, postal codes and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import END, LETTERS, START, clean_whitespace, let, nfkd, word

# Street words, then directions, replaced in this order.
STREETS = (
    ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("road", "rd"), ("drive", "dr"), ("lane", "ln"), ("court", "ct"), ("circle", "cir"),
    ("parkway", "pkwy"), ("highway", "hwy"), ("suite", "ste"), ("apartment", "apt"), ("building", "bldg"), ("floor", "fl"),
)
DIRECTIONS = (("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"), ("northeast", "ne"), ("northwest", "nw"), ("southeast", "se"), ("southwest", "sw"))
# Codes of states and provinces.
STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc on bc ab mb sk qc ns nb".split()
# Names of places and the region of each; the first that an address contains decides.
REGIONS_INDIA = (
    ("mumbai", "MH"), ("pune", "MH"), ("nagpur", "MH"), ("maharashtra", "MH"), ("thane", "MH"), ("nashik", "MH"), ("delhi", "DL"), ("new delhi", "DL"),
    ("bangalore", "KA"), ("bengaluru", "KA"), ("karnataka", "KA"), ("mysore", "KA"), ("chennai", "TN"), ("tamil nadu", "TN"), ("coimbatore", "TN"), ("madurai", "TN"),
    ("hyderabad", "TS"), ("telangana", "TS"), ("secunderabad", "TS"), ("kolkata", "WB"), ("howrah", "WB"), ("west bengal", "WB"), ("siliguri", "WB"),
    ("ahmedabad", "GJ"), ("surat", "GJ"), ("gujarat", "GJ"), ("vadodara", "GJ"), ("rajkot", "GJ"), ("jaipur", "RJ"), ("rajasthan", "RJ"), ("jodhpur", "RJ"), ("udaipur", "RJ"),
    ("lucknow", "UP"), ("kanpur", "UP"), ("uttar pradesh", "UP"), ("noida", "UP"), ("ghaziabad", "UP"), ("agra", "UP"), ("varanasi", "UP"), ("patna", "BR"), ("bihar", "BR"), ("muzaffarpur", "BR"),
    ("bhubaneswar", "OD"), ("orissa", "OD"), ("odisha", "OD"), ("cuttack", "OD"), ("chandigarh", "PB"), ("punjab", "PB"), ("ludhiana", "PB"), ("amritsar", "PB"),
    ("indore", "MP"), ("bhopal", "MP"), ("madhya pradesh", "MP"), ("gwalior", "MP"), ("kochi", "KL"), ("kerala", "KL"), ("trivandrum", "KL"), ("ernakulam", "KL"),
)
REGIONS_US = (
    ("ca", "CA"), ("california", "CA"), ("ny", "NY"), ("new york", "NY"), ("tx", "TX"), ("texas", "TX"), ("fl", "FL"), ("florida", "FL"), ("il", "IL"), ("illinois", "IL"),
    ("pa", "PA"), ("pennsylvania", "PA"), ("oh", "OH"), ("ohio", "OH"), ("ga", "GA"), ("georgia", "GA"), ("nc", "NC"), ("north carolina", "NC"), ("mi", "MI"), ("michigan", "MI"),
    ("nj", "NJ"), ("new jersey", "NJ"), ("va", "VA"), ("virginia", "VA"), ("wa", "WA"), ("washington", "WA"), ("az", "AZ"), ("arizona", "AZ"), ("ma", "MA"), ("massachusetts", "MA"),
    ("tn", "TN"), ("tennessee", "TN"), ("in", "IN"), ("indiana", "IN"), ("mo", "MO"), ("missouri", "MO"), ("md", "MD"), ("maryland", "MD"), ("wi", "WI"), ("wisconsin", "WI"),
    ("co", "CO"), ("colorado", "CO"), ("mn", "MN"), ("minnesota", "MN"),
)
# Patterns of house numbers and postal codes.
HOUSE_LARGE = (
    r"(?i)(?:^\s*([a-z0-9\-\/]*\d+[a-z0-9\-\/]*))|(?:\b(?:door\s*no\.?|h\.?\s*no\.?|flat\s*no\.?|shop\s*no\.?|plot\s*no\.?|survey\s*no\.?|kh\s*no\.?|no\.?|plot|shop|flat|room|door|gala|survey)"
    r"\s*[:#\-\.\s]*([a-z0-9\-\/]*\d+[a-z0-9\-\/]*))"
)
HOUSE_RERANK = (
    r"(?i)(?:(?:plot|flat|shop|house|door|khasra|kh|survey|sy|gala|room|block|sector|sec|road|lane|gali|no|h\.?no)\s*[\.\:\-\#]?\s*([0-9]+[a-zA-Z0-9\-\/\_]*)"
    r"|(?:\b|^)([0-9]{1,4}[a-zA-Z]?(?:[\-\/][0-9]{1,4}[a-zA-Z]?)+)\b|(?:\b|^)([0-9]{1,4}[a-z]?)\s*,)"
)
POSTAL = r"\d{5}(?:-\d{4})?|[a-zA-Z]\d[a-zA-Z]\s*\d[a-zA-Z]\d"


def normalize_address(text: Column) -> Column:
    x = F.lower(nfkd(F.coalesce(text, F.lit(""))))
    x = F.regexp_replace(F.regexp_replace(x, r"[,;]+", " , "), r"(?U)#\s*", "ste ")
    x = F.regexp_replace(x, rf"(?U)[^{LETTERS}\s\-,]", " ")
    for old, new in (*STREETS, *DIRECTIONS):
        x = F.regexp_replace(x, word(old), new)
    return clean_whitespace(F.regexp_replace(x, r"(?U)\s*,\s*", ", "))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def address_number(address: Column) -> Column:
    """The first number, a letter after it included; null if there is none."""
    return _nonempty(F.regexp_extract(address, rf"{START}(\p{{Nd}}+[a-z]?){END}", 1))


def parse_address(address: Column) -> Column:
    """struct (house_number, unit, street, city, state, postal_code), null where missing."""
    whole = strip(F.coalesce(address, F.lit("")))

    def cut(text: Column) -> Column:
        rest = F.regexp_replace(text, rf"(?s)^(.*?){word(POSTAL)}(.*)$", "$1$2")
        postal = F.replace(F.lower(F.regexp_extract(text, word(f"({POSTAL})"), 1)), F.lit(" "), F.lit(""))
        parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
        return F.struct(text.alias("text"), rest.alias("rest"), _nonempty(postal).alias("postal"), parts.alias("parts"))

    def with_state(c: Column) -> Column:
        found = F.regexp_extract_all(c["rest"], F.lit(f"(?i){word('(' + '|'.join(STATES) + ')')}"), F.lit(1))
        return F.struct(c.alias("c"), F.lower(F.try_element_at(found, F.lit(-1))).alias("state"))

    def fields(x: Column) -> Column:
        c, state = x["c"], x["state"]
        rest, parts = c["rest"], c["parts"]
        house = F.lower(F.regexp_extract(rest, rf"^(?U:\s*)(\p{{Nd}}+[a-zA-Z]?){END}", 1))
        unit = F.lower(F.regexp_extract(rest, rf"(?i)(?:{START}(?:ste|suite|apt|apartment|unit|bldg|building|fl|floor)|(?<=[{LETTERS}])#)(?U:\s*)([a-z0-9\-]+){END}", 1))
        second = F.get(parts, F.lit(1))
        kept = F.array_join(F.filter(F.split(second, r"(?U)\s+"), lambda t: (t != "") & ~t.rlike(f"^(?:{POSTAL}){END}") & (state.isNull() | (F.lower(t) != state))), " ")
        two = F.size(parts) >= 2
        street = F.when(two, F.get(parts, F.lit(0))).when(c["text"] != "", strip(rest))
        city = F.when(two, F.coalesce(_nonempty(kept), second))
        return F.struct(_nonempty(house).alias("house_number"), _nonempty(unit).alias("unit"), street.alias("street"), city.alias("city"), state.alias("state"), c["postal"].alias("postal_code"))

    return let(let(let(whole, cut), with_state), fields)


def _first_group(address: Column, pattern: str, groups: int) -> Column:
    found = F.coalesce(address, F.lit(""))
    return F.lower(strip(F.coalesce(*(_nonempty(F.regexp_extract(found, pattern, g)) for g in range(1, groups + 1)), F.lit(""))))


def house_number_large(address: Column) -> Column:
    return _first_group(address, HOUSE_LARGE, 2)


def house_number_rerank(address: Column) -> Column:
    return _first_group(address, HOUSE_RERANK, 3)


def postal_code(address: Column) -> Column:
    return F.regexp_extract(F.coalesce(address, F.lit("")), rf"{START}([0-9]{{5,6}}){END}", 1)


def region(address: Column, country: Column) -> Column:
    """Code of the first listed place that the address contains; empty for other countries."""
    low = F.lower(F.coalesce(address, F.lit("")))

    def first(places) -> Column:
        out = F.lit("")
        for name, code in reversed(places):
            out = F.when(F.contains(low, F.lit(name)), code).otherwise(out)
        return out

    return F.when(country == "India", first(REGIONS_INDIA)).when(country == "US", first(REGIONS_US)).otherwise("")
