"""Check digits as column expressions.

Every function takes a column and gives a boolean column; null gives null.
Nothing leaves the JVM: digits are split into arrays and folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Weights and letters of the other checks.
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_LETTERS, VIN_DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CN_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CN_CHECK = "10X98765432"
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
# Codice fiscale, odd places: of 0-9, then of A-Z.
CF_ODD_DIGITS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)
CF_ODD_LETTERS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def _dihedral(a: int, b: int) -> int:
    """Product in the group of symmetries of a pentagon."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    """The eight powers of Verhoeff's permutation."""
    step, rows = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), [list(range(10))]
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    return rows


def digits(c: Column) -> Column:
    """The digits of a text."""
    return F.regexp_replace(c, "[^0-9]", "")


def alnum(c: Column) -> Column:
    """The letters and digits of a text in upper case."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def _ints(c: Column) -> Column:
    """Digits as an array of numbers; empty for an empty text."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.cast("int"))


def _weighted(values: Column, weights: tuple[int, ...]) -> Column:
    products = F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda v, w: v * w)
    return F.aggregate(products, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _letter(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), at + 1, F.lit(1))


def luhn(c: Column) -> Column:
    """Luhn's check over the digits; false without any."""
    d = digits(c)
    odd_sum = F.aggregate(
        F.reverse(_ints(d)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
        lambda s, x: F.struct((s["sum"] + F.when(s["at"] % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))).alias("sum"), (s["at"] + 1).alias("at")),
        lambda s: s["sum"],
    )
    return (d != "") & (odd_sum % 10 == 0)


def verhoeff(c: Column) -> Column:
    """Verhoeff's check over the digits; false without any."""
    d = digits(c)
    products = F.array(*[F.array(*[F.lit(_dihedral(a, b)) for b in range(10)]) for a in range(10)])
    powers = F.array(*[F.array(*[F.lit(x) for x in row]) for row in _permutations()])
    total = F.aggregate(
        F.reverse(_ints(d)), F.struct(F.lit(0).alias("c"), F.lit(0).alias("at")),
        lambda s, x: F.struct(products[s["c"]][powers[s["at"] % 8][x]].alias("c"), (s["at"] + 1).alias("at")),
        lambda s: s["c"],
    )
    return (d != "") & (total == 0)


def credit_card(c: Column) -> Column:
    return F.length(digits(c)).between(13, 19) & luhn(c)


def npi(c: Column) -> Column:
    return (F.length(digits(c)) == 10) & luhn(F.concat(F.lit("80840"), digits(c)))


def sin_ca(c: Column) -> Column:
    return (F.length(digits(c)) == 9) & luhn(c)


def iban(c: Column) -> Column:
    """Length of a known country, and 1 as the remainder by 97 of the rotated number."""
    a = alnum(c)
    known = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    turned = F.concat(F.substr(a, F.lit(5)), F.substr(a, F.lit(1), F.lit(4)))
    parts = F.filter(F.split(turned, ""), lambda x: x != "")
    rest = F.aggregate(parts, F.lit(0), lambda acc, x: F.when(x.between("0", "9"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97))
    length = F.try_element_at(known, F.substr(a, F.lit(1), F.lit(2)))
    return F.when(a.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$"), F.coalesce(length == F.length(a), F.lit(False)) & (rest == 1)).otherwise(F.when(c.isNotNull(), F.lit(False)))


def vin(c: Column) -> Column:
    a = alnum(c)
    numbers = F.translate(a, VIN_LETTERS, VIN_DIGITS)
    rest = _weighted(_ints(numbers), VIN_WEIGHTS) % 11
    return F.when(a.rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.substr(a, F.lit(9), F.lit(1)) == F.when(rest == 10, "X").otherwise(rest.cast("string"))).otherwise(F.when(c.isNotNull(), F.lit(False)))


def dni_es(c: Column) -> Column:
    a = alnum(c)
    right = F.substr(a, F.lit(9), F.lit(1)) == _letter(DNI_LETTERS, (F.substr(a, F.lit(1), F.lit(8)).try_cast("int") % 23).cast("int"))
    return F.when(a.rlike("^[0-9]{8}[A-Z]$"), right).otherwise(F.when(c.isNotNull(), F.lit(False)))


def nie_es(c: Column) -> Column:
    a = alnum(c)
    return F.when(a.rlike("^[XYZ][0-9]{7}[A-Z]$"), dni_es(F.concat(F.translate(F.substr(a, F.lit(1), F.lit(1)), "XYZ", "012"), F.substr(a, F.lit(2))))).otherwise(F.when(c.isNotNull(), F.lit(False)))


def resident_id_cn(c: Column) -> Column:
    a = alnum(c)
    rest = _weighted(_ints(F.substr(a, F.lit(1), F.lit(17))), CN_WEIGHTS) % 11
    return F.when(a.rlike("^[0-9]{17}[0-9X]$"), F.substr(a, F.lit(18), F.lit(1)) == _letter(CN_CHECK, rest)).otherwise(F.when(c.isNotNull(), F.lit(False)))


def aadhaar_in(c: Column) -> Column:
    d = digits(c)
    return d.rlike("^[2-9][0-9]{11}$") & verhoeff(d)


def cpf_br(c: Column) -> Column:
    """Two digits, each from the weighted sum of those before; eleven equal digits are refused."""
    d = digits(c)

    def check(n: int) -> Column:
        rest = _weighted(_ints(F.substr(d, F.lit(1), F.lit(n))), tuple(range(n + 1, 1, -1))) * 10 % 11
        return F.when(rest == 10, 0).otherwise(rest).cast("string") == F.substr(d, F.lit(n + 1), F.lit(1))

    return F.when(d.rlike("^[0-9]{11}$") & ~d.rlike(r"^([0-9])\1{10}$"), check(9) & check(10)).otherwise(F.when(c.isNotNull(), F.lit(False)))


def codice_fiscale_it(c: Column) -> Column:
    a = alnum(c)
    odd = F.create_map(*[F.lit(x) for i, v in enumerate(CF_ODD_DIGITS) for x in (str(i), v)], *[F.lit(x) for i, v in enumerate(CF_ODD_LETTERS) for x in (chr(65 + i), v)])
    parts = F.slice(F.split(a, ""), 1, 15)
    value = lambda x, i: F.when(i % 2 == 0, F.element_at(odd, x)).otherwise(F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 65))
    total = F.aggregate(F.transform(parts, value), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(a.rlike("^[A-Z0-9]{15}[A-Z]$"), F.substr(a, F.lit(16), F.lit(1)) == F.char(total % 26 + 65)).otherwise(F.when(c.isNotNull(), F.lit(False)))


def pesel_pl(c: Column) -> Column:
    d = digits(c)
    rest = (10 - _weighted(_ints(F.substr(d, F.lit(1), F.lit(10))), PESEL_WEIGHTS) % 10) % 10
    return F.when(F.length(d) == 11, F.substr(d, F.lit(11), F.lit(1)) == rest.cast("string")).otherwise(F.when(c.isNotNull(), F.lit(False)))


#: Types with a check.
CHECKS = {
    "CREDIT_CARD": credit_card, "IBAN": iban, "VIN": vin, "MEDICAL_NPI_US": npi, "SIN_CA": sin_ca, "DNI_ES": dni_es, "NIE_ES": nie_es, "RESIDENT_ID_CN": resident_id_cn,
    "AADHAAR_IN": aadhaar_in, "CPF_BR": cpf_br, "CODICE_FISCALE_IT": codice_fiscale_it, "PESEL_PL": pesel_pl,
}


def passes(type_: Column, text: Column, types: list[str] | None = None) -> Column:
    """Whether a text passes its type's check; true for types without one. ``types`` limits the checks that are built."""
    out = F.when(F.lit(False), F.lit(True))
    for name, check in CHECKS.items():
        if types is None or name in types:
            out = out.when(type_ == name, check(text))
    return out.otherwise(F.lit(True))
