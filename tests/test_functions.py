import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from linkwright.functions import address, kernels, text, translit


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    rows = ["Société Élan & Cie", "limited liability company", "public limited company", "A-B  @ C", "S.A. Widgets", None, ""]
    assert values(spark, rows, text.normalize_name) == ["socie te e lan and cie", "ltd liability co", "public ltd co", "a b at c", "s a widgets", "", ""]
    assert values(spark, ["Große Straße é.com Services"], lambda c: F.array_join(text.tokens_large(c), " ")) == ["groe strae"]
    assert values(spark, ["the and of"], lambda c: F.array_join(text.tokens_large(c), " ")) == ["the and of"]
    assert values(spark, ["acme private  limited technologies", "industry solutions"], text.canonical_name) == ["acme pvt ltd tech", "ind solution"]
    assert values(spark, ["The Acme Widget Co Ltd", "Acme", "the of", None], text.shingle) == ["acme_widget", "acme", "", ""]
    assert values(spark, ["the big green house", "aa bb", "house green"], lambda c: text.longest_token(text.informative_tokens(c))) == ["green", None, "house"]
    assert values(spark, [" b ,a,b,,self"], lambda c: F.array_join(text.clean_and_sort(text.split_ids(c), F.lit("self")), "|")) == ["a|b"]


def test_addresses(spark):
    rows = ["75 Wall Street #1200, New York NY 10005", "12-14 North Oak Avenue; Suite 4", None]
    assert values(spark, rows, address.normalize_address) == ["75 wall st ste 1200, new york ny 10005", "12-14 n oak ave, ste 4", ""]
    parse = lambda x: tuple(values(spark, [x], address.parse_address)[0])
    assert parse("75 wall st ste 1200, new york ny 10005") == ("75", "1200", "75 wall st ste 1200", "new york", "ny", "10005")
    assert parse("12345 oak rd, reno nv") == (None, None, "12345 oak rd", "reno", "nv", "12345")
    assert parse("12-14 oak rd") == ("12", None, "12-14 oak rd", None, None, None)
    assert parse("1809 null fairview ave, k1a 0b1") == ("1809", None, "1809 null fairview ave", "k1a 0b1", None, "k1a0b1")
    assert parse(None) == (None,) * 6 and parse("") == (None,) * 6
    assert values(spark, ["Door No. 12-A, x", "45/2 main", "main road"], address.house_number_large) == ["12-a", "45/2", ""]
    assert values(spark, ["Plot No. 12-A, x", "12/3-B main", "45b , x", "main"], address.house_number_rerank) == ["12-a", "12/3", "45b", ""]
    assert values(spark, ["x 560001 y", "1234567", "12345-6"], address.postal_code) == ["560001", "", "12345"]
    assert values(spark, ["Chicago IL", "Austin texas", "nowhere"], lambda c: address.region(c, F.lit("US"))) == ["CA", "TX", ""]
    assert values(spark, ["New Delhi", None], lambda c: address.region(c, F.lit("India"))) == ["DL", ""]
    assert values(spark, ["abc 12b", "none"], address.address_number) == ["12b", None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_kernels_against_plain_tables():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert kernels.lcs(a, b) == lcs(a, b)
        assert kernels.ratio(a, b) == pytest.approx(100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b)))
        short, long = sorted((a, b), key=len)
        if short:
            windows = {long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))}
            best = max(200 * lcs(short, w) / (len(short) + len(w)) for w in windows)
            assert kernels.partial_ratio(a, b) >= best - 1e-9 and (len(a) == len(b) or kernels.partial_ratio(a, b) <= best + 1e-9)
    assert kernels.lcs("kitten", "sitting") == 4
    assert kernels.token_sort_ratio("new york mets", "mets new york") == 100
    assert kernels.token_set_ratio("summit financial", "summit financial partners") == 100
    assert kernels.token_set_ratio("", "x") == 0 and kernels.ratio("", "") == 100
    assert kernels.partial_ratio("blue", "the blue star") == 100
    assert kernels.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and kernels.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_indian_and_french_variants():
    assert kernels.token_sort_ratio("door no 5 mg road bangalore ka", "5 mg road bangalore ka") > 80
    assert kernels.token_set_ratio("boulangerie martin sarl", "sarl boulangerie martin") >= 90


def test_registered_in_sql(spark):
    kernels.register(spark)
    assert spark.sql("SELECT token_sort_ratio('b a', 'a b') AS x").first()["x"] == 100


def test_transliteration():
    assert translit.large("राम होटल") == "ram hotel" and translit.large("abc") == "abc" and translit.large(None) == ""
    assert translit.rerank("दीप १२") == "deep 12"
    bengali = "".join(chr(ord(c) - 0x0900 + 0x0980) for c in "क")
    assert translit.large(bengali) == "k" and translit.rerank(bengali) == "k"
    assert unicodedata.name("क").startswith("DEVANAGARI")
