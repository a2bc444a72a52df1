"""Rewriting texts: where entities stand, which places are kept, what is written there.

Where a text's own map meets it, one Arrow batch is rewritten at a time.  The
search itself is Python's, since its rules are Unicode's: a place counts only if
its ends are words' ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.session import shuffled


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def locate(text: str, entity: str) -> Iterator[tuple[int, int]]:
    """Places of an entity in a text; a side that is a letter, digit or _ must be a word's end."""
    if not entity:
        return
    n, size = len(text), len(entity)
    front, back = _wordy(entity[0]), _wordy(entity[-1])
    at = text.find(entity)
    while at >= 0:
        end = at + size
        if (not front or at == 0 or not _wordy(text[at - 1])) and (not back or end == n or not _wordy(text[end])):
            yield at, end
            at = text.find(entity, end)
        else:
            at = text.find(entity, at + 1)


def choose(text: str, entities: Iterable[str]) -> list[tuple[int, int, str]]:
    """Places that don't overlap, the longest first and of equals the leftmost; sorted by place."""
    found = [(start - end, start, end, e) for e in dict.fromkeys(entities) for start, end in locate(text, e)]
    free = bytearray(len(text))
    out = []
    for _, start, end, e in sorted(found):
        if not any(free[start:end]):
            free[start:end] = b"\x01" * (end - start)
            out.append((start, end, e))
    return sorted(out)


def rewrite(text: str, entities: Iterable[str], written: dict[str, str]) -> str:
    """The text with the chosen places of its entities written anew; entities without a written form stay."""
    parts, at = [], 0
    for start, end, e in choose(text, entities):
        if e in written:
            parts += [text[at:start], written[e]]
            at = end
    return "".join([*parts, text[at:]])


def boundary_pattern(c: Column) -> Column:
    """A JVM pattern that finds a value as it stands, with words' ends where its ends are word characters."""
    quoted = F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    word = r"[\p{L}\p{N}_]"
    front = F.when(F.substr(c, F.lit(1), F.lit(1)).rlike(word), F.lit(f"(?<!{word})")).otherwise(F.lit(""))
    back = F.when(F.substr(c, F.length(c), F.lit(1)).rlike(word), F.lit(f"(?!{word})")).otherwise(F.lit(""))
    return F.concat(front, quoted, back)


def chosen_spans(docs: DataFrame, entities: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start_pos, end_pos, entity): the places that are rewritten in each document."""

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int,entity:string>>")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[{"start_pos": a, "end_pos": b, "entity": e} for a, b, e in choose(t, list(n))] for t, n in zip(texts, names, strict=True)])

    names = entities.groupBy(doc).agg(F.collect_set("text").alias("_n")).withColumnRenamed(doc, "_nd")
    joined = docs.where(F.col(text).isNotNull()).join(names, docs[doc] == F.col("_nd"))
    return joined.select(doc, F.explode(run(F.col(text), F.col("_n"))).alias("s")).select(doc, "s.start_pos", "s.end_pos", "s.entity")


def rewritten(docs: DataFrame, mapping: DataFrame, doc: str = "doc_id", text: str = "text", entities: DataFrame | None = None) -> DataFrame:
    """The documents with their entities written anew; only entities found in a document are searched there.

    mapping: (doc, original, written) and, if originals may be there that were
    not found, ``seen``; or ``entities``: (doc, text) of what was found.  One
    row with a document's map meets its text, so the text is shuffled once.
    Documents without entities, null and empty texts come out as they are.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, names: pd.Series, originals: pd.Series, forms: pd.Series) -> pd.Series:
        out = []
        for t, n, o, w in zip(texts, names, originals, forms, strict=True):
            out.append(t if t is None or n is None else rewrite(t, list(n), dict(zip(o, w, strict=True)) if o is not None else {}))
        return pd.Series(out)

    seen = F.col("seen") if "seen" in mapping.columns else F.lit(True)
    side = mapping.groupBy(doc).agg(F.collect_list(F.struct("original", "written", seen.alias("seen"))).alias("_m"))
    side = side.select(doc, F.transform("_m", lambda x: x["original"]).alias("_o"), F.transform("_m", lambda x: x["written"]).alias("_w"), F.transform(F.filter("_m", lambda x: x["seen"]), lambda x: x["original"]).alias("_n"))
    if entities is not None:
        names = entities.where("text <> ''").groupBy(doc).agg(F.collect_set("text").alias("_names"))
        side = shuffled(names, side.drop("_n"), doc, "left").withColumnRenamed("_names", "_n").hint("merge")  # of staged tables
    side = side.withColumnRenamed(doc, "_sd")
    joined = docs.join(side, docs[doc] == F.col("_sd"), "left")
    new = run(F.col(text), F.col("_n"), F.col("_o"), F.col("_w"))
    return joined.withColumn(text, new).select(*docs.columns)


def holders(parts: DataFrame, forms: DataFrame, keys: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(_d, keys…, form, payload): the parts of documents that may hold a form of their document between words' ends.

    forms: (doc, form, payload).  Every word of a form is a word of a part that
    holds it, so parts and forms are joined by the form's rarest word; forms
    without any word are looked for in every part of their document.
    """
    word = r"[\p{L}\p{N}_]+"
    f = forms.where("form <> ''").select(F.col(doc).alias("_d"), "form", "payload")
    runs = f.select("_d", "form", "payload", F.explode_outer(F.array_distinct(F.regexp_extract_all("form", F.lit(word), F.lit(0)))).alias("_w"))
    counts = runs.groupBy("_d", "_w").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", (-F.length("_w")).alias("l"), "_w"))["_w"]
    keyed = runs.join(counts, ["_d", "_w"], "left").groupBy("_d", "form", "payload").agg(rarest.alias("_w"))
    filled = parts.where(F.col(text) != "").select(F.col(doc).alias("_d"), *keys, F.col(text).alias("_t"))
    held = filled.select("_d", *keys, F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(word), F.lit(0)))).alias("_w"))
    pairs = held.join(keyed.where("_w is not null"), ["_d", "_w"]).select("_d", *keys, "form", "payload")
    signs = keyed.where("_w is null").drop("_w")
    everywhere = filled.join(signs, "_d").where(F.col("_t").contains(F.col("form"))).select("_d", *keys, "form", "payload")
    return pairs.unionByName(everywhere)


def rewritten_parts(parts: DataFrame, mapping: DataFrame, keys: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The parts of documents (cells of tables) with the entities of the whole document written anew in each.

    A document may have very many parts and entities, so each part meets only
    the entities that can stand in it, see ``holders``.  ``keys`` name a part
    within its document.
    """
    m = mapping.where("seen") if "seen" in mapping.columns else mapping
    pairs = holders(parts, m.select(doc, F.col("original").alias("form"), F.col("written").alias("payload")), keys, doc, text)
    side = pairs.groupBy("_d", *keys).agg(F.collect_list(F.struct("form", "payload")).alias("_m"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, originals: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([t if o is None else rewrite(t, list(o), dict(zip(o, w, strict=True))) for t, o, w in zip(texts, originals, forms, strict=True)])

    joined = parts.join(side.withColumnsRenamed({k: f"_k{k}" for k in keys}), [parts[doc] == F.col("_d"), *[parts[k] == F.col(f"_k{k}") for k in keys]], "left")
    new = run(F.col(text), F.transform("_m", lambda x: x["form"]), F.transform("_m", lambda x: x["payload"]))
    return joined.withColumn(text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(new)).select(*parts.columns)
