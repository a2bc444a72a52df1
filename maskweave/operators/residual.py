"""What is left in masked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave import model
from maskweave.operators.detect import hits
from maskweave.operators.mapping import is_label


def leftovers(masked: DataFrame, doc: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """(doc, text, type, base_form): distinct hits that are no labels; one text may have several types."""
    h = hits(masked, doc, text, patterns, countries)
    trimmed = F.trim("text")
    return h.where(~is_label(F.col("text"))).select(doc, trimmed.alias("text"), "type", F.col("base_form")).dropDuplicates([doc, "text", "type"])


def model_leftovers(masked: DataFrame, client: model.Client, doc: str = "doc_id", text: str = "text", retries: int = 3) -> DataFrame:
    """The same from a model's answers about each masked text."""
    one = masked.where(F.col(text).isNotNull()).select(doc, F.lit(0).alias("chunk_idx"), F.col(text).alias("text"))
    found, _ = model.model_hits(one, client, model.PROMPTS["residual"], doc, retries)
    trimmed = F.trim("text")
    kept = found.where(~is_label(F.col("text"))).select(doc, trimmed.alias("text"), "type", F.coalesce("base_form", trimmed).alias("base_form"))
    return kept.dropDuplicates([doc, "text", "type"])


def leftover_report(masked: DataFrame, found: DataFrame, doc: str = "doc_id", model_found: DataFrame | None = None) -> DataFrame:
    """(doc, residual_count, regex_hits, llm_hits, rewritten): one row for each text; texts are never changed."""
    entry = F.sort_array(F.collect_list(F.struct("text", "type", "base_form")))
    out = masked.select(doc)
    for name, one in (("regex_hits", found), ("llm_hits", model_found)):
        if one is None:
            out = out.withColumn(name, F.array().cast("array<struct<text:string,type:string,base_form:string>>"))
        else:
            grouped = one.groupBy(F.col(doc).alias("_d")).agg(entry.alias(name))
            out = out.join(grouped, out[doc] == F.col("_d"), "left").drop("_d").withColumn(name, F.coalesce(name, F.array()))
    return out.select(doc, (F.size("regex_hits") + F.size("llm_hits")).alias("residual_count"), "regex_hits", "llm_hits", F.lit(False).alias("rewritten"))
