"""Rows that fail to parse (problem 4).

Strict load plus anti-join: every raw record keeps its offset; only conforming
records are loaded, as ten typed fields; the loaded offsets are subtracted from
all offsets; what remains is diagnosed, so the reasons are worked out for the
rejected records only.

A record is cut into fields by one JVM regular expression: its matches must
cover the record without a gap, else its quoting is broken.  Only the grammar of
spreadsheet expressions is checked in Python, for records that pass everything
else and hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.formulas import expression_ok_udf

#: The fields of a roster.
FIELDS = ("name", "email", "ssn", "phone", "notes", "city", "id", "formula", "concat", "empty_col")
HEADER = ("name", "email", "ssn", "phone", "notes", "city", "id", "formula", "concat", "empty")
_EMAIL = r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)*\.\p{L}{2,}$"
_SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
_PHONE = r"^[0-9 +().-]*$"
_ID = r"^[0-9]+$"


def _with_fields(raw: DataFrame, text: str, delimiter: str) -> DataFrame:
    """Adds _fields (array) and _covered (whether they make up the record)."""
    d = F.coalesce(F.col(delimiter), F.lit(","))
    quoted = F.concat(F.lit("\\Q"), d, F.lit("\\E"))
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\uFEFF|\r?\n$", "")
    whole = F.concat(d, body)
    field = F.concat(quoted, F.lit(r'((?:"[^"]*+(?:""[^"]*+)*+"(?='), quoted, F.lit(r'|$(?![\r\n])))|(?:(?!"|'), quoted, F.lit(r")[^\r\n](?:(?!"), quoted, F.lit(r")[^\r\n])*+)?)"))
    cut = raw.withColumn("_whole", whole).withColumn("_parts", F.regexp_extract_all("_whole", field, F.lit(0))).withColumn("_d", F.length(d))
    length = F.aggregate("_parts", F.lit(0), lambda n, x: n + F.length(x))
    plain = F.transform("_parts", lambda x: F.substr(x, F.col("_d") + 1))
    unquoted = F.transform(plain, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(x))
    # a generator of one row: filters on what it makes are not pushed below it, so a record is cut once
    one = F.inline(F.array(F.struct((length == F.length("_whole")).alias("_covered"), unquoted.alias("_fields"))))
    return cut.select(*[c for c in raw.columns if c not in ("_covered", "_fields")], one)


def _value(k: int) -> Column:
    return F.get("_fields", F.lit(k))


def _problems() -> list[tuple[str, Column]]:
    """(reason, whether it holds) for all checks but those of expressions, in the order they are reported."""
    ok = {
        "email": _value(1).rlike(_EMAIL),
        "ssn": _value(2).rlike(_SSN),
        "phone": _value(3).rlike(_PHONE) & (F.length(F.regexp_replace(_value(3), "[^0-9]", "")) >= 7),
        "id": _value(6).rlike(_ID),
    }
    at = {"email": 1, "ssn": 2, "phone": 3, "id": 6}
    return [
        ("quoting", ~F.col("_covered")),
        ("width", F.size("_fields") != len(FIELDS)),
        *[(name, (_value(at[name]) != "") & ~good) for name, good in ok.items()],
        ("empty_col", _value(9) != ""),
    ]


def _blank() -> Column:
    return F.col("_covered") & F.forall("_fields", lambda x: F.trim(x) == "")


def _header() -> Column:
    return F.col("_covered") & (F.transform("_fields", lambda x: F.lower(F.trim(x))) == F.array(*[F.lit(h) for h in HEADER]))


def _located(raw: DataFrame, sheets: DataFrame, text: str) -> DataFrame:
    """Raw records with their sheet's delimiter and an offset that tells repeated identifiers apart.

    A record of an unknown sheet, or of one without a delimiter, is read with a comma.
    """
    known = sheets.groupBy("sheet_id").agg(F.min("delimiter").alias("_delimiter"))
    offset = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("sheet_id", "row_no", text)])
    return raw.select("record_id", "sheet_id", "row_no", text).join(known, "sheet_id", "left").withColumn("_offset", offset)


def load_valid(raw: DataFrame, sheets: DataFrame, text: str = "raw") -> DataFrame:
    """The conforming roster rows: record_id, sheet_id, row_no and ten string fields.

    Header and blank records (null ones too) are valid but hold no row.
    """
    rows = _conforming(_located(raw, sheets, text), text).where(~F.col("_no_row"))
    return rows.select("record_id", "sheet_id", "row_no", *[_value(k).alias(f) for k, f in enumerate(FIELDS)])


def _conforming(located: DataFrame, text: str) -> DataFrame:
    """The records that can be loaded, with their fields and ``_no_row``; each is cut once.

    The JVM's checks come first; Python is given the expressions of records
    that pass them, and nulls for all others.
    """
    cut = _with_fields(located, text, "_delimiter").withColumn("_no_row", _blank() | _header())
    sound = F.lit(True)
    for _, wrong in _problems():
        sound = sound & ~wrong
    cut = cut.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    asked = lambda k: F.when(~F.col("_no_row") & F.col("_sound") & (_value(k) != ""), _value(k))
    checked = cut.withColumn("_e7", asked(7)).withColumn("_e8", asked(8)).withColumn("_ok7", expression_ok_udf("_e7")).withColumn("_ok8", expression_ok_udf("_e8"))
    good = (F.col("_e7").isNull() | F.col("_ok7")) & (F.col("_e8").isNull() | F.col("_ok8"))
    return checked.where(F.col("_no_row") | F.col("_sound") & good)


def rejected(raw: DataFrame, sheets: DataFrame, text: str = "raw") -> DataFrame:
    """(record_id, sheet_id, row_no, raw, reason) of the records that cannot be loaded.

    reason: quoting, width, email, ssn, phone, id, empty_col, formula or concat,
    the first that holds in this order.  Repeated records have a row each.
    """
    located = _located(raw, sheets, text)
    loaded = _conforming(located, text).select(F.col("record_id").alias("_id"), F.col("_offset").alias("_loaded")).distinct()
    rest = located.join(loaded, F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("_offset") == F.col("_loaded")), "left_anti")
    cut = _with_fields(rest, text, "_delimiter")
    reason = F.when(F.lit(False), F.lit(""))
    for name, wrong in _problems():
        reason = reason.when(wrong, F.lit(name))
    formula_ok = (_value(7) == "") | expression_ok_udf(F.coalesce(_value(7), F.lit("")))
    return cut.withColumn("_formula_ok", formula_ok).select(
        "record_id", "sheet_id", "row_no", F.col(text).alias("raw"), reason.when(~F.col("_formula_ok"), F.lit("formula")).otherwise(F.lit("concat")).alias("reason")
    )
