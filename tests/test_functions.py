"""Check digits, write operators, patterns and expressions on golden values."""

import re

import pytest
from pyspark.sql import functions as F

from maskweave import patterns as P
from maskweave.functions import checksums as C
from maskweave.functions import writing as W
from maskweave.functions.formulas import expression_ok

CASES = [
    ("luhn", "4111111111111111", True), ("luhn", "378282246310005", True), ("luhn", "4111111111111112", False), ("luhn", "", False),
    ("verhoeff", "234123412346", True), ("verhoeff", "234123412347", False),
    ("credit_card", "4111 1111 1111 1111", True), ("credit_card", "4242-4242-4242-4242", True), ("credit_card", "1234-5678-9012-3456", False),
    ("npi", "1234567893", True), ("npi", "1234567890", False), ("sin_ca", "046-454-286", True), ("sin_ca", "123-456-782", True), ("sin_ca", "123-456-789", False),
    ("iban", "GB82WEST12345698765432", True), ("iban", "DE89 3704 0044 0532 0130 00", True), ("iban", "GB00WEST12345698765432", False), ("iban", "GB82WEST1234569876543", False), ("iban", "ZZ82WEST12345698765432", False), ("iban", "", False),
    ("vin", "1HGCM82633A004352", True), ("vin", "1FTFW1EF0EFA00001", True), ("vin", "1HGCM82633A123456", False), ("dni_es", "12345678Z", True), ("dni_es", "12345678A", False), ("nie_es", "Y1234567X", True), ("nie_es", "Y1234567A", False),
    ("resident_id_cn", "110105199001011232", True), ("resident_id_cn", "110105199001011234", False), ("aadhaar_in", "2345 6789 0124", True), ("aadhaar_in", "1234 5678 9012", False),
    ("cpf_br", "123.456.789-09", True), ("cpf_br", "111.111.111-11", False), ("pesel_pl", "44051401359", True), ("pesel_pl", "44051401350", False), ("codice_fiscale_it", "RSSMRA85M01H501Q", True), ("codice_fiscale_it", "RSSMRA85M01H501Z", False),
]


def test_checksums(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(CASES)], "i int, v string")
    names = sorted({n for n, _, _ in CASES})
    got = {r.i: r for r in df.select("i", *[getattr(C, n)(F.col("v")).alias(n) for n in names]).collect()}
    assert [(n, v) for i, (n, v, ok) in enumerate(CASES) if got[i][n] is not ok] == []


def test_checksums_of_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert all(x in (None, False) for x in df.select(*[f(F.col("v")) for f in C.CHECKS.values()]).first())


def test_relabel(spark):
    from maskweave.operators.detect import relabelled

    df = spark.createDataFrame([("IBAN", "GB82WEST12345698765432"), ("IBAN", "GB00WEST12345698765432"), ("PHONE", "123")], "t string, v string")
    assert [r[0] for r in df.select(relabelled(F.col("t"), F.col("v"))).collect()] == ["IBAN", "IBAN_LIKE", "PHONE"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, type_, want",
    [
        ("2019-06-20", "DATE", "2019"), ("02139", "ADDRESS", "021**"), ("12 Main St, 02139-1234", "ADDRESS", "12 Main St, 021**"), ("47", "AGE", "40-49"), ("91", "AGE", "90+"), ("old", "AGE", "old"), ("Austin", "LOCATION", "Austin"),
        ("2019-02-30", "DATE", "2019-02-30"), ("1987", "DATE", "1987"), ("44", "ID", "40-49"), ("444", "ID", "444"), ("2020-01-02T03:04:05", "DATE_ISO", "2020"),
    ],
)
def test_generalize(spark, value, type_, want):
    assert one(spark, value, lambda c: W.generalize(c, F.lit(type_))) == want


@pytest.mark.parametrize(
    "value, type_, want",
    [
        ("4111 1111 1111 1234", "CREDIT_CARD", "**** **** **** 1234"), ("123-45-6789", "SSN_US", "***-**-6789"), ("GB82WEST12345698765432", "IBAN_LIKE", "******************5432"), ("12ab", "PHONE", "****"),
        ("jane@example.com", "EMAIL", "j***@e***.com"), ("nobody", "EMAIL", "******"), ("x", "EMAIL", "****"), ("Jane Doe", "PERSON", "**** ***"), ("Room 12345", "ID", "**** *2345"), ("", "PERSON", "****"),
    ],
)
def test_mask(spark, value, type_, want):
    assert one(spark, value, lambda c: W.mask(c, F.lit(type_))) == want


def test_shift_and_hash(spark):
    import hashlib
    from datetime import date, timedelta

    n = int(hashlib.sha256(f"{W.SHIFT_SALT}:base".encode()).hexdigest()[:4], 16) % 365 - 182
    assert one(spark, "2020-03-01T10:00:00", lambda c: W.shift(c, F.lit("base"))) == (date(2020, 3, 1) + timedelta(n)).isoformat() + "T10:00:00"
    assert one(spark, "no date", lambda c: W.shift(c, F.lit("base"))) == "no date"
    assert one(spark, "x", W.hashed) == "H_" + hashlib.sha256(b"x").hexdigest()[:16]


@pytest.mark.parametrize(
    "type_, shape",
    [("PERSON", r"[A-Z]\w+ [A-Z]\w+"), ("EMAIL", r"[a-z]+\.[a-z]+@example\.org"), ("PHONE", r"555-010\d"), ("CREDIT_CARD_LIKE", r"4111( \d{4}){3}"), ("SSN_US", r"000-00-\d{4}"), ("IBAN", r"GB00FAKE\d{10}"), ("IP_ADDRESS", r"203\.0\.113\.\d{1,3}"), ("AGE", r"\d\d"), ("DATE_ISO", r"2011-\d\d-\d\d"), ("VIN", r"1HGCM8263\dA\d{6}"), ("OTHER", r"[A-Z]\w+")],
)
def test_fakes_are_stable_and_shaped(spark, type_, shape):
    a, b = (one(spark, v, lambda c: W.fake(c, F.lit(type_), F.lit("base"), "s")) for v in ("2011-05-06", "2011-05-06"))
    assert a == b and re.fullmatch(shape, a)
    assert one(spark, "2011-05-06", lambda c: W.fake(c, F.lit(type_), F.lit("base"), "another")) is not None


def test_specs():
    assert W.parse_specs(["credit_card=MASK"]) == {"CREDIT_CARD": "mask"}
    for bad in ("x", "=mask", "A=burn"):
        with pytest.raises(ValueError):
            W.parse_specs([bad])
    ops = {"CREDIT_CARD": "mask", "DATE": "shift"}
    assert [W.operator_of(t, ops) for t in ("CREDIT_CARD_LIKE", "DATE_ISO", "EMAIL")] == ["mask", "shift", "replace"]


def test_countries():
    kept = P.select(["us", "GB"])
    assert {"SSN", "SSN_US", "NINO_GB", "EMAIL", "GB_PASSPORT", "US_PASSPORT"} <= set(kept) and not {"PESEL_PL", "AADHAAR_IN"} & set(kept)
    assert len(P.select()) == len(P.select([])) == 93
    with pytest.raises(ValueError):
        P.select(["XX"])
    assert (P.priority("IBAN_LIKE"), P.priority("UNHEARD_LIKE"), P.priority("UNHEARD")) == (13, -1, 0)


def test_one_word_patterns_equal_the_scan(spark):
    """The quick way finds what the pattern itself finds, on texts made to break it."""
    import random

    from maskweave.operators.detect import hits

    rng = random.Random(11)
    glue = ["é", "ß", "٣", "😀", "\x0b", "_", "-", ".", "$", "(", " ", "\n", "a", "A", "7", ""]
    seeds = ["123456789", "AB123456C", "1234567890", "DE123456789", "X1234567L", "12345678Z", "123-45-6789", "GB82WEST12345698765432", "4111 1111 1111 1111", "a.b@c.de", ".a@b.cc", "(555) 123-4567", "10.0.0.1", "fe80::1", "1:2:3:4:5:6:7:8", "00:1B:44:11:3A:B7", "$ 1,234.50", "USD\t12", "0x" + "a" * 40, "2020-01-02T03:04:05Z", "110105199001011232", "11010519900101123X", "ABCDEFGH", "ABCDEFGHXXX", "CHE123456789MWST", "756.1234.5678.97"]
    texts = ["".join(rng.choice(glue) + rng.choice(seeds) + rng.choice(glue) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in hits(df, checked=False).collect():
        got.setdefault((r.doc_id, r.type), []).append((r.match_idx, r.text))
    scan = {t.upper(): P.python(p) for t, p in P.PATTERNS.items()}
    want = {}
    for i, x in enumerate(texts):
        for t, rx in scan.items():
            found = [m[0] for m in rx.finditer(x)]
            if found:
                want[i, t] = list(enumerate(found))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("formula, ok", [("=A1", 1), ("=A0", 0), ("=SUM(A1:B2)", 1), ('=IF(A1="x","yes, ok","no")', 1), ('=IF(A1="x","y")z', 0), ('=LEFT(A1,"x)', 0), ("=9C", 0), ("=", 0), ("=A1+", 0), ("=-A1*2%", 1), ('="a""b"&B2', 1), ("=#REF!", 0), ("=Jane& X", 0), ("=IF(A1>1,B2))", 0), ("=$B$4", 1), ("A1", 0), (None, 0), ("", 0), ("=" + "(" * 5000 + "1" + ")" * 5000, 1)])
def test_expressions(formula, ok):
    assert expression_ok(formula) == bool(ok)
