"""The row-local operators over streams.

Detection and rewriting with a fixed map look at one row at a time, so they run
under Structured Streaming as they are.  Numbering of new placeholders depends
on the order of entities; ``mask_stream`` therefore writes what needs no number
(mask, hash, generalize, shift, fake), for each micro-batch by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskweave.operators import detect, entities, spans
from maskweave.functions import writing


def hits_stream(docs: DataFrame, doc: str = "doc_id", text: str = "text", countries: list[str] | None = None) -> DataFrame:
    """Hits of a stream of documents, without state."""
    return detect.hits(docs, doc, text, countries=countries)


def hit_counts_stream(docs: DataFrame, time: str, doc: str = "doc_id", text: str = "text", window: str = "1 hour", late: str = "1 day", countries: list[str] | None = None) -> DataFrame:
    """(window, type, hits) of a stream; rows later than ``late`` behind the newest are dropped with their window's state."""
    keyed = docs.withWatermark(time, late).withColumn("_k", F.struct(F.col(doc).alias("d"), F.col(time).alias("t")))
    found = detect.hits(keyed, "_k", text, countries=countries)
    timed = found.select(F.col("_k.t").alias(time), "type")
    return timed.groupBy(F.window(time, window), "type").agg(F.count("*").alias("hits"))


def masked_batch(docs: DataFrame, operators: dict[str, str] | None = None, doc: str = "doc_id", text: str = "text", default: str = "hash", countries: list[str] | None = None) -> DataFrame:
    """Documents with every entity written by its type's operator, ``default`` where none is named."""
    found = entities.distinct_entities(detect.hits(docs, doc, text, countries=countries), doc)
    every = {t: (operators or {}).get(t, default) for t in {k.upper() for k in operators or {}}}
    label = writing.hashed(F.col("text")) if default == "hash" else writing.mask(F.col("text"), F.col("type"))
    written = writing.by_type(F.col("text"), F.col("type"), label, F.col("base_form"), {k: v for k, v in every.items() if v != "replace"})
    mapped = found.select(doc, F.col("text").alias("original"), written.alias("written"))
    return spans.rewritten(docs, mapped, doc, text)


def mask_stream(docs: DataFrame, sink: str, checkpoint: str, operators: dict[str, str] | None = None, doc: str = "doc_id", text: str = "text", countries: list[str] | None = None, **trigger: object) -> StreamingQuery:
    """Write masked documents of a stream to a parquet folder, each micro-batch once."""

    def write(batch: DataFrame, number: int) -> None:
        masked_batch(batch, operators, doc, text, countries=countries).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
