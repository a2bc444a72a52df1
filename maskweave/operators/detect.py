"""Detecting personal data by patterns, phrase lists and types."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave import patterns as P
from maskweave.functions import checksums


def hits(docs: DataFrame, doc: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None, countries: list[str] | None = None, checked: bool = True, chunk: str | None = None) -> DataFrame:
    """(doc, chunk_idx, stage, pattern_idx, match_idx, text, type, base_form): every match of every pattern.

    One narrow stage of JVM expressions: each pattern's matches make an array,
    and one generator unfolds them all.  The words that one-word patterns can
    match are cut out in a single scan, and each of those patterns looks at them
    only; other patterns are tried where a quick test lets them match.  Matches of white space only are left
    out.  With ``checked``, a match that fails its type's check digit becomes
    ``<TYPE>_LIKE``.  Null texts have no hits.  Patterns that the country list
    leaves out are not built.
    """
    library = P.select(countries, patterns)
    if not library:
        kind = docs.schema[doc].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{doc} {kind}, chunk_idx long, stage int, pattern_idx int, match_idx int, text string, type string, base_form string")

    def found(i: int, type_: str, pattern: str) -> Column:
        word = P.one_word(pattern)
        if word is None:
            matches = F.regexp_extract_all(F.col("_text"), F.lit(P.java(pattern, type_)), F.lit(0))
            if quick := P.needs(type_, pattern):
                plain = quick.isalnum() or quick == "@"
                there = F.col("_text").contains(quick) if plain else F.col("_text").rlike(quick)
                matches = F.when(there, matches).otherwise(F.array().cast("array<string>"))
        elif sized := P.lengths(word):
            only_digits, least, most = sized
            matches = F.filter("_numbers" if only_digits else "_words", lambda w: F.length(w).between(least, most))
        else:
            matches = F.filter("_words", lambda w: w.rlike(f"^(?:{word})$"))
        return F.transform(matches, lambda m, k: F.struct(F.lit(i).alias("p"), k.cast("int").alias("k"), m.alias("t")))

    chunk_idx = F.lit(0) if chunk is None else F.col(chunk)
    every = F.concat(*[found(i, t, p) for i, (t, p) in enumerate(library.items())]) if len(library) > 1 else found(0, *next(iter(library.items())))
    rows = docs.select(F.col(doc).alias("_doc"), chunk_idx.cast("long").alias("chunk_idx"), F.col(text).alias("_text")).where("_text is not null")
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(P.ONE_WORD), F.lit(0)))
    rows = rows.withColumn("_numbers", F.filter("_words", lambda w: w.rlike("^[0-9]+$")))
    one = rows.select("_doc", "chunk_idx", F.explode(every).alias("h"))
    names = F.array(*[F.lit(t.upper()) for t in library])
    out = one.select("_doc", "chunk_idx", F.col("h.p").alias("pattern_idx"), F.col("h.k").alias("match_idx"), F.col("h.t").alias("text"), names[F.col("h.p")].alias("type"))
    out = out.where(F.col("text").rlike(r"[^\s\p{Z}]"))
    if checked:
        out = out.withColumn("type", relabelled(F.col("type"), F.col("text"), [t.upper() for t in library]))
    return out.select(F.col("_doc").alias(doc), "chunk_idx", F.lit(0).alias("stage"), "pattern_idx", "match_idx", "text", "type", F.col("text").alias("base_form"))


def relabelled(type_: Column, text: Column, types: list[str] | None = None) -> Column:
    """The type, or its look-alike where a check digit is wrong."""
    return F.when(checksums.passes(type_, text, types), type_).otherwise(F.concat(type_, F.lit(P.LIKE)))


def located_hits(docs: DataFrame, doc: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """(doc, pattern_idx, match_idx, type, start_pos, end_pos): places of the matches, in code points, end exclusive.

    The JVM's functions give matches without places; this scan runs in Arrow
    batches and is for reports that need them.
    """
    library = P.select(countries, patterns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = [(i, t.upper(), P.python(p)) for i, (t, p) in enumerate(library.items())]
        for b in batches:
            rows = [
                (d, i, k, t, m.start(), m.end())
                for d, x in zip(b["d"], b["x"], strict=True)
                for i, t, rx in scan
                for k, m in enumerate(rx.finditer(x))
                if m[0].strip()
            ]
            if rows:
                yield pd.DataFrame(rows, columns=[doc, "pattern_idx", "match_idx", "type", "start_pos", "end_pos"])

    kind = docs.schema[doc].dataType.simpleString()
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("x"))
    return chosen.mapInPandas(run, f"{doc} {kind}, pattern_idx int, match_idx int, type string, start_pos int, end_pos int")


def type_allowed(type_: Column, allowed: list[str]) -> Column:
    """Whether a type, or the one it looks like, is listed, or begins or ends with a listed one and ``_``."""
    upper = F.upper(type_)
    base = F.when(upper.endswith(P.LIKE) & (F.length(upper) > len(P.LIKE)), F.substr(upper, F.lit(1), F.length(upper) - len(P.LIKE))).otherwise(upper)
    out = F.lit(False)
    for item in sorted({a.upper() for a in allowed}):
        for t in (upper, base):
            out = out | (t == item) | t.startswith(f"{item}_") | t.endswith(f"_{item}")
    return out


def denied(docs: DataFrame, entities: DataFrame, phrases: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, phrase_idx, text, type, base_form): the first place of each denied phrase in a document, as written there.

    Case doesn't count and words' ends are no condition.  Phrases that are
    entities of the document already are left out.  ``phrases`` is a parameter:
    the list becomes part of the plan, one expression a phrase.
    """
    wanted = list(dict.fromkeys(p.lower() for p in phrases if p))
    if not wanted:
        kind = docs.schema[doc].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{doc} {kind}, phrase_idx int, text string, type string, base_form string")
    low = F.lower(text)

    def place(i: int, p: str) -> Column:
        at = F.locate(p, low)
        return F.struct(F.lit(i).alias("phrase_idx"), F.when(at > 0, F.substr(F.col(text), at, F.lit(len(p)))).alias("text"))

    found = docs.select(F.col(doc).alias("_d"), F.explode(F.array(*[place(i, p) for i, p in enumerate(wanted)])).alias("f")).select("_d", "f.phrase_idx", "f.text").where("text is not null")
    known = entities.select(F.col(doc).alias("_e"), F.lower("text").alias("_t")).distinct()
    new = found.join(known, (F.col("_d") == F.col("_e")) & (F.lower(found["text"]) == F.col("_t")), "left_anti")
    return new.select(F.col("_d").alias(doc), "phrase_idx", "text", F.lit("CUSTOM").alias("type"), F.col("text").alias("base_form"))


def kept_out(entities: DataFrame, phrases: list[str]) -> DataFrame:
    """The entities whose text and base form are not on the keep-list; case doesn't count."""
    skip = sorted({p.lower() for p in phrases if p})
    if not skip:
        return entities
    return entities.where(~F.coalesce(F.lower("text").isin(skip), F.lit(False)) & ~F.coalesce(F.lower("base_form").isin(skip), F.lit(False)))
