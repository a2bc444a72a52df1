"""What is written in place of a value: the write operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.patterns import LIKE

OPERATORS = ("replace", "mask", "hash", "generalize", "shift", "fake")
#: Salts of the stable offsets and fakes; change them together with the maps that were made with them.
SHIFT_SALT = "maskweave-date-shift"
FAKE_SECRET = "maskweave-fake"
# Own word lists for fakes; a fake keeps its shape and is the same for the same base form.
_FIRST = "Avery Blake Casey Dana Ellis Finley Gray Harper Indigo Jordan Kai Lane Morgan Noel Oakley Parker Quinn Reese Sage Taylor".split()
_LAST = "Ashdown Birchall Coldwell Dunmore Eastlake Fairholt Greenley Hartwood Ingleby Jarrow Kingsley Longmere Marwood Northcott Oakhurst Penrose Quarry Redfern Stanmore Thornbury".split()
_CITY = "Ashford Brookvale Clearwater Dunhaven Eastmere Fairview Glenholm Highfield Ironbridge Kingsport Lakeside Millbrook Newhaven Oakdale Pinehurst Ridgeway".split()
_STREET = "Alder Beech Cedar Dogwood Elm Fir Hazel Juniper Laurel Maple Oak Pine Rowan Spruce Willow Yew".split()
_WORDS = "amber breeze cobalt drift ember fable garnet harbor ivory jade lagoon meadow nectar opal prairie quartz".split()
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"


def kind_of(type_: Column) -> Column:
    """The type, or the one it looks like."""
    upper = F.upper(type_)
    return F.when(upper.endswith(LIKE) & (F.length(upper) > len(LIKE)), F.substr(upper, F.lit(1), F.length(upper) - len(LIKE))).otherwise(upper)


def hashed(c: Column) -> Column:
    """H_ and the first 16 hex digits of the SHA-256."""
    return F.concat(F.lit("H_"), F.substr(F.sha2(c, 256), F.lit(1), F.lit(16)))


def keep_last(c: Column, keep: int = 4) -> Column:
    """All letters and all but the last digits hidden; every digit if there are no more than ``keep``."""
    n = F.length(F.regexp_replace(c, r"\P{Nd}", ""))
    most = F.regexp_replace(c, r"\p{Nd}(?=(?:\P{Nd}*\p{Nd}){" + str(keep) + "})", "*")
    return F.regexp_replace(F.when(n > keep, most).otherwise(F.regexp_replace(c, r"\p{Nd}", "*")), r"\p{L}", "*")


def mask_email(c: Column) -> Column:
    """a***@e***.tld; stars only for what has no @."""
    local, domain = F.substring_index(c, "@", 1), F.substr(c, F.length(F.substring_index(c, "@", 1)) + 2)
    name, tld = F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 1), F.substring_index(domain, ".", -1)
    first = lambda x: F.concat(F.substr(x, F.lit(1), F.lit(1)), F.lit("***"))
    host = F.when(domain.contains("."), F.concat(first(name), F.lit("."), tld)).otherwise(first(domain))
    return F.when(~c.contains("@"), F.repeat(F.lit("*"), F.greatest(F.length(c), F.lit(4)))).otherwise(F.concat(first(local), F.lit("@"), host))


def mask(c: Column, type_: Column) -> Column:
    """A value with a little of its shape left, by its type."""
    kind = kind_of(type_)
    numeric = kind.isin("CREDIT_CARD", "SSN", "SSN_US", "SIN_CA", "MEDICAL_NPI_US", "PHONE") | kind.startswith("SSN") | kind.endswith("IBAN")
    some = F.length(F.regexp_replace(c, r"\P{Nd}", "")) >= 4
    plain = F.when(c == "", F.lit("****")).otherwise(F.regexp_replace(c, r"[\p{L}\p{N}]", "*"))
    return F.when(numeric, keep_last(c)).when(kind == "EMAIL", mask_email(c)).when(some, keep_last(c)).otherwise(plain)


def parse_date(c: Column) -> Column:
    """The date at the beginning of an ISO text; null if there is none or it is none of the calendar."""
    return F.when(F.trim(c).rlike(_ISO), F.try_to_date(F.substr(F.trim(c), F.lit(1), F.lit(10)), "yyyy-MM-dd"))


def age_band(n: Column) -> Column:
    low = F.floor(n / 10) * 10
    return F.when(n > 89, F.lit("90+")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def generalize(c: Column, type_: Column) -> Column:
    """Year of a date, first three digits of a ZIP code, decade of an age; anything else unchanged.

    An AGE that is no number is left unchanged too.
    """
    kind, trimmed, date = kind_of(type_), F.trim(c), parse_date(c)
    number = F.when(trimmed.rlike("^[0-9]{1,9}$"), trimmed.cast("int"))
    zip_code = trimmed.rlike(r"^[0-9]{5}(-[0-9]{4})?$")
    short = r"(?<![\p{L}\p{N}_])([0-9]{3})[0-9]{2}(?:-[0-9]{4})?(?![\p{L}\p{N}_])"
    return (
        F.when(date.isNotNull(), F.year(date).cast("string"))
        .when(zip_code, F.concat(F.substr(trimmed, F.lit(1), F.lit(3)), F.lit("**")))
        .when(kind == "ADDRESS", F.regexp_replace(c, short, "$1**"))
        .when((kind == "AGE") & number.isNotNull(), age_band(number))
        .when((kind == "ID") & number.between(1, 120), age_band(number))
        .when(kind.startswith("DATE") & number.isNotNull(), trimmed)
        .otherwise(c)
    )


def shift(c: Column, base: Column, salt: str = SHIFT_SALT) -> Column:
    """A date moved by up to half a year, by as much for the same base form; a time after it stays; other values stay."""
    date = parse_date(c)
    days = (F.conv(F.substr(F.sha2(F.concat(F.lit(f"{salt}:"), base), 256), F.lit(1), F.lit(4)), 16, 10).cast("int") % 365 - 182).cast("int")
    moved = F.concat(F.date_format(F.date_add(date, days), "yyyy-MM-dd"), F.substr(F.trim(c), F.lit(11)))
    return F.when(date.isNotNull(), moved).otherwise(c)


def fake(c: Column, type_: Column, base: Column, secret: str = "") -> Column:
    """A stable stand-in of the same shape; the same base form always gets the same one.

    The SHA-256 of secret, type and base form is cut into blocks of eight hex
    digits; each part of a fake is picked by a block of its own.
    """
    kind = kind_of(type_)
    sha = F.sha2(F.concat(F.lit(f"{secret or FAKE_SECRET}:"), kind, F.lit(":"), base), 256)
    number = lambda i, n: F.conv(F.substr(sha, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") % n
    pick = lambda words, i: F.array(*[F.lit(w) for w in words])[number(i, len(words)).cast("int")]
    padded = lambda i, width: F.lpad(number(i, 10**width).cast("string"), width, "0")
    date = parse_date(c)
    year = F.coalesce(F.year(date), (number(0, 41) + 1980).cast("int"))
    return (
        F.when(kind == "PERSON", F.concat_ws(" ", pick(_FIRST, 0), pick(_LAST, 1)))
        .when(kind == "EMAIL", F.concat(F.lower(pick(_FIRST, 0)), F.lit("."), F.lower(pick(_LAST, 1)), F.lit("@example.org")))
        .when(kind.isin("PHONE", "FAX"), F.concat(F.lit("555-010"), padded(0, 1)))
        .when(kind == "LOCATION", pick(_CITY, 0))
        .when(kind == "ADDRESS", F.concat((number(0, 997) + 1).cast("string"), F.lit(" "), pick(_STREET, 1), F.lit(" Street")))
        .when(kind == "ORGANIZATION", F.concat(pick(_LAST, 0), F.lit(" Ltd")))
        .when(kind == "JOB_TITLE", F.concat(F.lit("Officer "), F.initcap(pick(_WORDS, 0))))
        .when(kind.startswith("DATE"), F.date_format(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), number(1, 362).cast("int")), "yyyy-MM-dd"))
        .when(kind == "AGE", (number(0, 60) + 21).cast("string"))
        .when(kind.startswith("CREDIT_CARD"), F.concat_ws(" ", F.lit("4111"), padded(0, 4), padded(1, 4), padded(2, 4)))
        .when(kind.startswith("SSN") | (kind == "SIN_CA"), F.concat(F.lit("000-00-"), padded(0, 4)))
        .when(kind.endswith("IBAN"), F.concat(F.lit("GB00FAKE"), padded(0, 5), padded(1, 5)))
        .when(kind.isin("IPV4_ADDRESS", "IP_ADDRESS"), F.concat(F.lit("203.0.113."), (number(0, 254) + 1).cast("string")))
        .when(kind == "URL", F.concat(F.lit("https://example.test/"), pick(_WORDS, 0), F.lit("-"), pick(_WORDS, 1)))
        .when(kind == "VIN", F.concat(F.lit("1HGCM8263"), padded(0, 1), F.lit("A"), padded(1, 6)))
        .otherwise(F.initcap(pick(_WORDS, 0)))
    )


def parse_specs(specs: list[str] | None) -> dict[str, str]:
    """``TYPE=operator`` texts as a dict; ValueError for anything else."""
    out = {}
    for spec in specs or []:
        type_, eq, operator = (spec or "").partition("=")
        type_, operator = type_.strip().upper(), operator.strip().lower()
        if not eq or not type_:
            raise ValueError(f"{spec!r} is not TYPE=operator")
        if operator not in OPERATORS:
            raise ValueError(f"{operator!r} is no operator; there are {', '.join(OPERATORS)}")
        out[type_] = operator
    return out


def operator_of(type_: str, operators: dict[str, str]) -> str:
    """The operator of a type: its own, its parent's, for dates that of DATE, else replace."""
    upper = type_.upper()
    base = upper[: -len(LIKE)] if upper.endswith(LIKE) and upper != LIKE else upper
    return operators.get(upper) or operators.get(base) or (operators.get("DATE") if base.startswith("DATE") else None) or "replace"


def chosen_operator(type_: Column, operators: dict[str, str]) -> Column:
    """The same for a column of types; ``operators`` holds one entry a type."""
    if not operators:
        return F.when(type_.isNotNull(), "replace")
    table = F.create_map(*[F.lit(x) for pair in operators.items() for x in pair])
    kind = kind_of(type_)
    return F.coalesce(F.try_element_at(table, F.upper(type_)), F.try_element_at(table, kind), F.when(kind.startswith("DATE"), F.try_element_at(table, F.lit("DATE"))), F.when(type_.isNotNull(), "replace"))


def by_type(c: Column, type_: Column, label: Column, base: Column, operators: dict[str, str], secret: str = "") -> Column:
    """What each value's operator writes; only the operators in use are built."""
    if not operators:
        return label
    chosen = chosen_operator(type_, operators)
    write = {"mask": lambda: mask(c, type_), "hash": lambda: hashed(c), "generalize": lambda: generalize(c, type_), "shift": lambda: shift(c, base), "fake": lambda: fake(c, type_, base, secret)}
    out = F.when(chosen == "replace", label)
    for name in sorted(set(operators.values()) - {"replace"}):
        out = out.when(chosen == name, write[name]())
    return out.otherwise(label)
