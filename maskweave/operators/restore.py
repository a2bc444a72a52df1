"""Restoring originals from placeholders."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as a placeholder in a text when leftovers are listed; it need not begin at a word's start.
LABEL_IN_TEXT = "[A-Z_]+_[0-9]+(?:\\.v_[0-9]+)?"
#: What may be a written form: a run of characters that labels, hashes and masks are made of, with a variation's ending.
_LABEL_RUN = re.compile(r"[A-Z][A-Z0-9_]*_[0-9]+(?:\.v_[0-9]+)?(?![0-9])")


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def _label_at(run: str, text: str, start: int, end: int, originals: dict[str, str]) -> tuple[int, str] | None:
    """(beginning, written form) of the longest known label that ends a run of label characters; None if there is none.

    A label stands between words' ends as far as its original does: one for
    ``$4`` may have a letter before it.
    """
    after = end < len(text) and _wordy(text[end])
    for cut in range(len(run)):
        if not run[cut].isupper():
            continue
        full = run[cut:]
        for form in (full, full.split(".v_")[0]):
            whole = originals.get(form)
            if whole is None or not whole:
                continue
            before = start + cut > 0 and _wordy(text[start + cut - 1])
            if not (before and _wordy(whole[0])) and not (after and _wordy(whole[-1])):
                return start + cut, form
    return None


def restore(text: str, originals: dict[str, str]) -> tuple[str, set[str]]:
    """The text with every known written form replaced, and the labels and forms that were used, as they stood.

    Labels are read run by run; a variation that the map doesn't hold falls back
    to its base.  Other written forms (hashes, years, masks) are looked for
    between words' ends by ``spans``, longest first, in what labels leave over.
    """
    from maskweave.operators.spans import choose

    places: list[tuple[int, int, str]] = []
    used: set[str] = set()
    for m in _LABEL_RUN.finditer(text):
        end = m.end()
        found = _label_at(m[0], text, m.start(), end, originals)
        if not found and ".v_" in m[0]:  # something that only looks like a variation
            base = m[0].split(".v_")[0]
            end = m.start() + len(base)
            found = _label_at(base, text, m.start(), end, originals)
        if found:
            places.append((found[0], end, originals[found[1]]))
            used.add(text[found[0] : end])
    others = [k for k in originals if not _LABEL_RUN.fullmatch(k)]
    if others:
        taken = bytearray(len(text))
        for a, b, _ in places:
            taken[a:b] = b"\x01" * (b - a)
        for a, b, form in choose(text, others):
            if not any(taken[a:b]):
                places.append((a, b, originals[form]))
                used.add(form)
    parts, at = [], 0
    for a, b, original in sorted(places):
        parts += [text[at:a], original]
        at = b
    return "".join([*parts, text[at:]]), used


def label_candidates(text: Column) -> Column:
    """Every written form that the labels of a text may stand for: the ends of each run of label characters, with and without its variation."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(_LABEL_RUN.pattern), F.lit(0)))
    ends = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i))))
    ends = F.filter(ends, lambda x: x.rlike("^[A-Z]"))
    return F.array_distinct(F.concat(ends, F.transform(ends, lambda x: F.substring_index(x, ".v_", 1))))


def restored(docs: DataFrame, inverse: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with originals restored, and ``used``: the written forms that were met.

    inverse: (doc, written, original).  Documents without a map and null texts
    come out as they are, with an empty ``used``.
    """

    @F.pandas_udf("text string, used array<string>")
    def run(texts: pd.Series, forms: pd.Series, originals: pd.Series) -> pd.DataFrame:
        out = []
        for t, w, o in zip(texts, forms, originals, strict=True):
            if t is None or w is None:
                out.append((t, []))
            else:
                new, used = restore(t, dict(zip(w, o, strict=True)))
                out.append((new, sorted(used)))
        return pd.DataFrame(out, columns=["text", "used"])

    pairs = inverse.groupBy(doc).agg(F.collect_list(F.struct("written", "original")).alias("_m"))
    side = pairs.select(F.col(doc).alias("_sd"), F.transform("_m", lambda x: x["written"]).alias("_w"), F.transform("_m", lambda x: x["original"]).alias("_o"))
    joined = docs.join(side, docs[doc] == F.col("_sd"), "left").withColumn("_r", run(F.col(text), F.col("_w"), F.col("_o")))
    return joined.select(*[F.col("_r.text").alias(c) if c == text else F.col(c) for c in docs.columns if c != "used"], F.col("_r.used").alias("used"))


def restored_parts(parts: DataFrame, inverse: DataFrame, keys: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Parts of documents (cells of tables) with originals restored.

    A document may have very many parts and written forms, so a part meets only
    the labels that its runs of label characters can end in, and of other
    written forms those whose rarest word it holds.  ``keys`` name a part within
    its document.
    """
    from maskweave.operators.spans import holders

    is_label = F.col("written").rlike(f"^(?:{_LABEL_RUN.pattern})$")
    filled = parts.where(F.col(text) != "")
    can = filled.select(F.col(doc).alias("_d"), *keys, F.explode(label_candidates(F.col(text))).alias("written"))
    labels = can.join(inverse.where(is_label).select(F.col(doc).alias("_d"), "written", "original"), ["_d", "written"]).select("_d", *keys, "written", "original")
    others = inverse.where(~is_label)
    words = holders(filled, others.withColumnRenamed("original", "_o").select(doc, F.col("written").alias("form"), F.col("_o").alias("payload")), keys, doc, text)
    side = labels.unionByName(words.select("_d", *keys, F.col("form").alias("written"), F.col("payload").alias("original"))).groupBy("_d", *keys).agg(F.collect_list(F.struct("written", "original")).alias("_m"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, forms: pd.Series, originals: pd.Series) -> pd.Series:
        return pd.Series([t if w is None else restore(t, dict(zip(w, o, strict=True)))[0] for t, w, o in zip(texts, forms, originals, strict=True)])

    joined = parts.join(side.withColumnsRenamed({k: f"_k{k}" for k in keys}), [parts[doc] == F.col("_d"), *[parts[k] == F.col(f"_k{k}") for k in keys]], "left")
    new = run(F.col(text), F.transform("_m", lambda x: x["written"]), F.transform("_m", lambda x: x["original"]))
    return joined.withColumn(text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(new)).select(*parts.columns)


def unknown_labels(masked: DataFrame, used: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, label): labels that a masked text holds and the map doesn't know.

    The pattern knows no digits in types and no word's start, so IPV4_ADDRESS_1
    shows as _ADDRESS_1; that is kept for equal reports.
    """
    there = masked.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(LABEL_IN_TEXT), F.lit(0)))).alias("label"))
    met = used.select(F.col(doc).alias("_d"), F.explode("used").alias("_u")).distinct()
    return there.join(met, (there[doc] == F.col("_d")) & (F.col("label") == F.col("_u")), "left_anti")


def unused_labels(inverse: DataFrame, used: DataFrame, doc: str = "doc_id", exact: bool = False) -> DataFrame:
    """(doc, label): written forms of a map that its text doesn't hold.

    Only bases count as used, so every variation is listed; with ``exact`` a
    variation that was met is not.
    """
    met = used.select(F.col(doc).alias("_d"), F.explode("used").alias("_u"))
    base = F.substring_index("_u", ".v_", 1)
    met = met.select("_d", F.explode(F.array(F.col("_u"), base)).alias("_u") if exact else base.alias("_u")).distinct()
    return inverse.select(doc, F.col("written").alias("label")).join(met, (F.col(doc) == F.col("_d")) & (F.col("label") == F.col("_u")), "left_anti")
