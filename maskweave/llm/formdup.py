"""Duplicates hidden by formatting differences (problem 3).

Two rows are the same record if type and text are equal apart from white space,
letter case and punctuation; for field-list types also apart from the order of
the fields.  The canonical key is made by JVM expressions only.

Copies are found in three steps that never put a hot group into one task:

1. one shuffle counts the keys with partial (map-side) counts, so that a key
   held by a third of all rows arrives as one row per map task; this detects the
   hot keys exactly;
2. hot keys are aggregated in two levels, first by (key, salt), then by key;
3. all other keys are aggregated in one level.

A key is hot from ``max(hot_rows, rows / HOT_KEYS_MOST)`` rows on, so there are at
most ``HOT_KEYS_MOST`` hot keys whatever the input: the hot list is safe to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.session import staged

#: At most so many keys can be hot; with keys of at most 65 characters that is a broadcast of under 1 MB.
HOT_KEYS_MOST = 10_000
#: Keys longer than this are replaced by their SHA-256.
LONG_KEY = 64
SALTS = 32
#: White space, controls, punctuation and the ASCII symbols that count as punctuation.
_FORM = r"[\s\p{Z}\p{C}\p{P}$+<=>^`|~]+"


def _plain(c: Column) -> Column:
    # upper before lower folds what has several lower-case forms (ß and ss, ς and σ)
    return F.regexp_replace(F.lower(F.upper(c)), _FORM, "")


def record_key(text: Column, type_: Column, field_types: tuple[str, ...] = ("CUSTOM",)) -> Column:
    """Canonical key of a record; null if the text is null.

    A null type is a type of its own.  A text of punctuation only has the empty
    key of its type, so such texts are equal to each other.  Empty fields of a
    field list do not count.
    """
    kind = F.when(type_.isNull(), F.lit("?")).otherwise(_plain(type_))
    fields = F.array_sort(F.filter(F.transform(F.split(text, "[;|]"), _plain), lambda x: x != ""))
    body = F.when(kind.isin([f.lower() for f in field_types]), F.array_join(fields, "|")).otherwise(_plain(text))
    whole = F.concat(kind, F.lit(":"), body)
    return F.when(text.isNotNull(), F.when(F.length(whole) > LONG_KEY, F.concat(F.lit("#"), F.sha2(whole, 256))).otherwise(whole))


def keyed(df: DataFrame, id_col: str, text: str = "text", type_: str = "type", field_types: tuple[str, ...] = ("CUSTOM",)) -> DataFrame:
    """(rec_key, rec_id) of every row with a text; all other columns are dropped, so none can clash."""
    return df.select(record_key(F.col(text), F.col(type_), field_types).alias("rec_key"), F.col(id_col).alias("rec_id")).where("rec_key is not null")


def _split_hot(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(staged rows, their hot keys, hot rows, other rows)."""
    rows = staged(rows, "formdup")
    least = max(hot_rows, -(-rows.count() // HOT_KEYS_MOST))
    hot = staged(rows.groupBy("rec_key").count().where(F.col("count") >= least).select("rec_key"), "formdup-hot")
    few = F.broadcast(hot)  # at most HOT_KEYS_MOST rows, see the module's text
    return rows, hot, rows.join(few, "rec_key", "left_semi"), rows.join(few, "rec_key", "left_anti")


def _first(rows: DataFrame) -> list[Column]:
    return [F.min("rec_id").alias("first_id"), F.count("*").alias("copies")]


def _representatives(hot_part: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    salted = hot_part.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)))
    two_level = (
        salted.groupBy("rec_key", "salt").agg(*_first(salted))
        .groupBy("rec_key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    )
    return two_level, rest.groupBy("rec_key").agg(*_first(rest))


def records(df: DataFrame, id_col: str, text: str = "text", type_: str = "type", field_types: tuple[str, ...] = ("CUSTOM",), hot_rows: int = 20_000) -> DataFrame:
    """One row (first_id, copies) for each distinct record, named by its smallest identifier.

    Rows with a null text are no record.  Repeated identifiers count as copies.
    """
    _, _, hot_part, rest = _split_hot(keyed(df, id_col, text, type_, field_types), hot_rows)
    hot, others = _representatives(hot_part, rest)
    return hot.unionByName(others).select("first_id", "copies")


def copies(df: DataFrame, id_col: str, text: str = "text", type_: str = "type", field_types: tuple[str, ...] = ("CUSTOM",), hot_rows: int = 20_000) -> DataFrame:
    """One row (first_id, copy_id) for each row of a record but the smallest identifier.

    A hot key's rows meet their representative by broadcast and are not
    shuffled; the others meet theirs in one shuffle by key.
    """
    _, _, hot_part, rest = _split_hot(keyed(df, id_col, text, type_, field_types), hot_rows)
    hot, others = _representatives(hot_part, rest)
    of_hot = hot_part.join(F.broadcast(hot), "rec_key")  # one row per hot key, bounded as the hot list
    of_rest = rest.join(others.where("copies > 1"), "rec_key")
    return of_hot.unionByName(of_rest).where("rec_id <> first_id").select("first_id", F.col("rec_id").alias("copy_id"))
