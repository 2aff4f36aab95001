import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.plain import fuzzy as plain
from weftlink.functions import fuzzy
from weftlink.functions import text as X


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_business_names(spark):
    cases = {
        "ABC Corporation Pvt. Ltd.": "abc corporation",
        "McDonald's, Inc.": "mcdonalds",
        "A & B Intl.": "a and b international",
        "ＡＣＭＥ LLC": "acme",
        "Limited Edition": "limited edition",
        "Straße GmbH": "strasse gmbh",
        "Ltd": "ltd",
        "Acme Inc Ltd LLC": "acme",
        "Corp Corp svcs": "corporation corporation services",
        None: "",
        "  ": "",
    }
    assert column(spark, lambda c: X.business_name(X.normalize_text(c)), list(cases)) == list(cases.values())


def test_marks_of_other_scripts_stay(spark):
    assert column(spark, X.normalize_text, ["क्षेत्र-१", "南国 Co.", "O'Neil’s"]) == ["क्षेत्र १", "南国 co", "oneils"]


def test_ascii_mode_agrees(spark):
    values = ["12 Main Street, Town", "A&B 'x'", "", None, "Tab\tand\nline"]
    assert column(spark, lambda c: X.normalize_text(c, True), values) == column(spark, X.normalize_text, values)


def test_addresses(spark):
    df = spark.createDataFrame([("12 Sample Road, Example City, Region 12345",), ("7 High Street, Town SW1A 1AA",), ("1 Rue X, Y K1A0B1",), ("no hints",), (None,)], "v string")
    got = df.select(*[c.alias(k) for k, c in X.address_parts(F.col("v")).items()]).collect()
    assert got[0].asDict() == {"postal_code": "12345", "city": "example city", "state": "region", "street_number": "12", "street_tokens": "sample rd example city region"}
    assert [r.postal_code for r in got] == ["12345", "sw1a1aa", "k1a0b1", "", ""]
    assert got[1].city == "town" and got[3].city == "" and got[4].street_tokens == ""


def test_contacts(spark):
    df = spark.createDataFrame([("Info@Example.COM | https://www.example.com/path/ | Tel: +91 (080) 0123-4567",), ("phone: 12",), (None,)], "v string")
    got = df.select(*[c.alias(k) for k, c in X.contacts(F.col("v")).items()]).collect()
    assert got[0].asDict() == {"email": "Info@example.com", "email_domain": "example.com", "website_domain": "example.com", "phone": "+9108001234567"}
    assert not any(got[1].asDict().values()) and not any(got[2].asDict().values())


def test_soundex_resets_on_every_letter_without_code(spark):
    assert column(spark, X.soundex, ["ashcraft", "robert", "rupert", "tymczak", "a", ""]) == ["A226", "R163", "R163", "T522", "A000", ""]


def test_transliteration(spark):
    assert column(spark, X.transliterated, ["कमल", "élan", "abc"]) == ["kml", "elan", "abc"]
    assert column(spark, X.transliterated_by_name, ["कमल", "abc"]) == ["kamala", "abc"]
    assert column(spark, X.fold_accents, ["Été Ångström"]) == ["ete angstrom"]
    assert column(spark, X.skeleton, ["phone", "shadow", "Bhatt"]) == ["fn", "sdv", "bt"]


def test_ngrams_and_sets(spark):
    assert [sorted(x) for x in column(spark, lambda c: X.ngrams(c, 3), ["ab cd", "ab", "", None])] == [["abc", "bcd"], ["ab"], [], []]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("x"), F.col("y"))).collect()] == [1 / 3, 0.0]


def test_acronyms_and_classes(spark):
    df = spark.createDataFrame([("ibm", "international business machines"), ("iob", "international business of machines"), ("ib", "international business machines"), ("x", "y z"), ("abc ltd", "alpha beta co")], "a string, b string")
    assert [r[0] for r in df.select(X.acronym_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.7, 0.0, 0.0]
    one = df.select(X.legal_classes(X.split_words(F.col("a"))).alias("l"), X.categories(F.array(F.lit("bank"), F.lit("clinic"))).alias("c")).collect()
    assert one[4].l == [3] and one[0].c == ["medical", "finance"]


def test_numeric(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "p double")
    z = [r[0] for r in df.select(X.logit(F.col("p"))).collect()]
    assert math.isclose(z[1], math.log(0.3 / 0.7)) and math.isclose(z[0], -z[2], rel_tol=1e-9)
    assert math.isclose(df.select(X.sigmoid(X.logit(F.col("p")))).collect()[1][0], 0.3)
    f = spark.createDataFrame([(0.5, 1.0), (0.0, 0.0)], "p double, r double").select(X.fbeta(F.col("p"), F.col("r"))).collect()
    assert math.isclose(f[0][0], 1.25 * 0.5 / 1.125) and f[1][0] == 0


def test_rule_names(spark):
    assert spark.range(1).select(X.rules_text(F.lit(33))).first()[0] == "country_name|strong_name"


TEXTS = st.lists(st.tuples(st.text("abcé d", max_size=20), st.text("abcé d", max_size=24)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_kernels_equal_their_plain_forms(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert fuzzy.lcs(a, b).tolist() == [plain.lcs(x, y) for x, y in pairs]
    for name, kernel in fuzzy.KERNELS.items():
        assert kernel(a, b) == pytest.approx([getattr(plain, name)(x, y) for x, y in pairs])


def test_long_texts_leave_the_machine_word():
    r = random.Random(5)
    a = ["".join(r.choice("abc \0") for _ in range(r.choice((62, 63, 64, 65, 130)))) for _ in range(40)]
    b = [x[: r.randrange(len(x))] + "".join(r.choice("abcd ") for _ in range(r.randrange(80))) for x in a]
    clean = [[x.replace("\0", "\uffff") for x in v] for v in (a, b)]
    for name in fuzzy.KERNELS:
        x, y = (a, b) if "token" not in name and name != "weighted" else clean  # NUL sorts before other letters
        assert fuzzy.KERNELS[name](x, y) == pytest.approx([getattr(plain, name)(u, v) for u, v in zip(*clean, strict=True)])


def test_kernels():
    one = lambda kind, a, b: fuzzy.KERNELS[kind]([a], [b])[0]
    assert round(one("jaro_winkler", "martha", "marhta"), 4) == 0.9611
    assert one("token_sort", "b a", "a b") == 1 and one("token_set", "a b", "a b c") == 1
    assert one("partial", "abc", "xxabcxx") == 1 and one("indel", "", "a") == 0


def test_similarity_udf(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("ab ") for _ in range(8)), "".join(r.choice("ab ") for _ in range(8))) for _ in range(50)] + [(None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(F.col("a"), F.col("b"), fuzzy.similarity("weighted", F.col("a"), F.col("b")).alias("s")).collect()
    assert [x.s for x in got] == pytest.approx([plain.weighted(x.a or "", x.b or "") for x in got])


def test_any_script(spark):
    assert column(spark, X.romanized, ["कमल", "Été", "Москва", "αθήνα", None]) == ["kamala", "ete", "moskva", "athena", ""]
    df = spark.createDataFrame([("ib", "international business"), ("ib", "indian bank ltd"), ("a", "alpha"), ("", "x y")], "a string, b string")
    assert [r[0] for r in df.select(X.is_acronym(F.col("a"), F.col("b"))).collect()] == [False, True, False, False]
