"""The whole way: detect, number, rewrite, restore, verify, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave import model as M
from maskweave.config import Config, profile
from maskweave.operators import chunking, detect, entities, mapping, residual, restore, risk, spans, tables
from maskweave.session import by_key, shuffled, spread, staged


@dataclass(frozen=True)
class Masked:
    """Masked documents, the map (doc, ord, original, written, type, base_form), the entities (doc, ord, text, type, base_form) and a model's new answers."""

    docs: DataFrame
    mapping: DataFrame
    entities: DataFrame
    answers: DataFrame | None = None


def _as_seed(docs: DataFrame, seed: DataFrame | dict[str, str] | None) -> DataFrame | None:
    """An earlier map as a table (original, written); a dict is one that a caller holds already."""
    if isinstance(seed, dict):
        return docs.sparkSession.createDataFrame(list(seed.items()), "original string, written string") if seed else None
    return seed


def anonymize(
    docs: DataFrame, config: Config | None = None, doc: str = "doc_id", text: str = "text", countries: list[str] | None = None, types: list[str] | None = None,
    operators: dict[str, str] | None = None, secret: str = "", seed: DataFrame | dict[str, str] | None = None, keep: list[str] | None = None, deny: list[str] | None = None,
    client: M.Client | None = None, scope: str = "document", cache: DataFrame | None = None,
) -> Masked:
    """Mask every document by itself, or (scope "corpus") with one numbering for all.

    Texts are chunked for a model only, and then patterns read the same chunks,
    so that hits come in one order; without a model patterns read whole texts and
    no value is cut in two.  A profile that asks for a model needs a client; without one
    ValueError says so.  cache: earlier answers (key, entities), which are not
    asked for again; what is new is in ``Masked.answers``.  seed: an earlier map
    (original, written), joined, that every document goes on from.
    """
    config = config or profile("regex-only")
    if config.use_model and client is None:
        raise ValueError("the profile asks for a model; pass a client, or choose regex-only")
    seed = _as_seed(docs, seed)
    docs = by_key(docs, doc)  # the only shuffle of texts: entities, numbers and rewriting all go by document
    source = docs.where(F.col(text).isNotNull()).select(doc, F.col(text).alias("text"))
    pieces = chunking.chunks(source, config.chunk_size, config.chunk_overlap, doc) if config.use_model else source.withColumn("chunk_idx", F.lit(0))
    hits = detect.hits(pieces, doc, "text", config.patterns, countries, chunk="chunk_idx")
    answers = None
    if config.use_model:
        asked, answers = M.model_hits(pieces, client, M.PROMPTS[config.prompt], doc, config.max_retries, config.base_delay, config.max_delay, cache, config.model)
        hits = hits.unionByName(asked)
    found = entities.finalised(hits, source, doc, "text", types, deny, keep, seed)
    if scope == "corpus":
        every = mapping.corpus_numbered(found, doc)
        mapped = found.select(doc, "ord", F.col("text").alias("original")).join(every, "original")
    else:
        mapped = mapping.numbered(found, doc, seed, free=config.use_model)
    if operators:
        mapped = mapping.written_by_operator(mapped, operators, secret)
    if seed is None:
        return Masked(spans.rewritten(docs, mapped, doc, text), mapped, found, answers)
    mapped = staged(mapped, "seeded-map")
    old = shuffled(found.select(doc, F.col("text").alias("original")), seed, "original").select(doc, "original", "written")
    return Masked(spans.rewritten(docs, mapped.select(doc, "original", "written").unionByName(old), doc, text, found), mapped, found, answers)


def anonymize_tables(
    cells: DataFrame, config: Config | None = None, countries: list[str] | None = None, types: list[str] | None = None, operators: dict[str, str] | None = None, secret: str = "", keep: list[str] | None = None,
    deny: list[str] | None = None, seed: DataFrame | dict[str, str] | None = None, client: M.Client | None = None, sheets: DataFrame | None = None, cache: DataFrame | None = None,
) -> Masked:
    """Mask tables cell by cell; denied phrases come before the type filter here, so CUSTOM can be filtered out.

    A table may hold a large share of all cells: they are spread over all tasks
    for the scan, and entities are numbered in ranges of keys.  With a model
    (then ``sheets`` is needed), rows are asked about in batches, and what it
    names counts only if it stands in a cell.
    """
    config = config or profile("regex-only")
    if config.use_model and (client is None or sheets is None):
        raise ValueError("the profile asks for a model; pass a client and the sheets, or choose regex-only")
    seed = _as_seed(cells, seed)
    # a cell's address stands in for the chunk: sheet, row and column in reading order
    sheet = F.col("sheet_no") if "sheet_no" in cells.columns else F.lit(1)
    address = (F.shiftleft(sheet.cast("long"), 40) + F.shiftleft(F.col("row").cast("long"), 16) + F.col("col")).alias("chunk_idx")
    filled = by_key(cells.where("search_text <> ''").select("doc_id", "kind", "search_text", address), "doc_id", "chunk_idx")
    hits = detect.hits(filled.where(F.col("kind").isin(*tables.SEARCHED)), "doc_id", "search_text", config.patterns, countries, chunk="chunk_idx")
    late, answers = F.lit(2**62).cast("long").alias("chunk_idx"), None
    if config.use_model:
        batches = tables.model_batches(cells, tables.header_labels(cells, sheets), sheets, config.chunk_size).select("doc_id", F.col("batch_no").alias("chunk_idx"), "text")
        asked, answers = M.model_hits(batches, client, M.PROMPTS[config.prompt], "doc_id", config.max_retries, config.base_delay, config.max_delay, cache, config.model)
        told = tables.in_some_cell(asked, cells)
        hits = hits.unionByName(told.withColumn("chunk_idx", F.lit(2**61).cast("long") + F.col("chunk_idx")))
    if deny:
        extra = detect.denied(filled, hits.limit(0), deny, "doc_id", "search_text")
        hits = hits.unionByName(extra.select("doc_id", late, F.lit(2).alias("stage"), F.col("phrase_idx").alias("pattern_idx"), F.lit(0).alias("match_idx"), "text", "type", "base_form"))
    found = entities.finalised(hits, None, "doc_id", "text", types, None, keep, seed, hot=True)
    mapped = mapping.numbered(found, "doc_id", seed, hot=True, free=config.use_model)
    if operators:
        mapped = mapping.written_by_operator(mapped, operators, secret)
    mapped = staged(mapped, "table-map")  # read twice: words are counted before they are joined
    if seed is None:
        return Masked(tables.masked_cells(cells, mapped), mapped, found, answers)
    old = found.select("doc_id", F.col("text").alias("original")).join(seed, "original").select("doc_id", "original", "written")
    both = mapped.where("seen").select("doc_id", "original", "written").unionByName(old)
    return Masked(tables.masked_cells(cells, both), mapped, found, answers)


def deanonymize(masked: DataFrame, inverse: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(restored documents, labels that the map doesn't know, labels of the map that no text holds)."""
    out = restore.restored(masked, inverse, doc, text)
    return out.select(*masked.columns), restore.unknown_labels(masked, out, doc, text), restore.unused_labels(inverse, out, doc)


def verify(masked: DataFrame, doc: str = "doc_id", text: str = "text", countries: list[str] | None = None, client: M.Client | None = None) -> DataFrame:
    """One report row for each masked text, of what patterns (and a model, if there is a client) still find."""
    masked = spread(masked, doc)
    told = None if client is None else residual.model_leftovers(masked, client, doc, text)
    return residual.leftover_report(masked, residual.leftovers(masked, doc, text, None, countries), doc, told)


def report_risk(masked: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One summary row for each masked text."""
    return risk.risk_summary(risk.risk_windows(masked, doc, text), masked, doc)


def deanonymize_tables(cells: DataFrame, inverse: DataFrame) -> DataFrame:
    """Cells with originals restored; the apostrophe that kept a formula from running is taken away again.

    inverse: (doc_id, written, original).  A cell meets only the written forms
    that it can hold.
    """
    out = restore.restored_parts(cells, inverse, ["sheet", "row", "col"], "doc_id", "search_text")
    return out.withColumn("search_text", tables.unneutralised(F.col("search_text")))


def consolidate(masked: DataFrame, inverse: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, map) in which every original has one label, its first; inverse: (doc, ord, written, original)."""
    first = staged(mapping.consolidated(inverse, doc), "consolidated")
    other = first.where("written <> canonical").select(doc, F.col("written").alias("original"), F.col("canonical").alias("written"))
    kept = first.where("written = canonical").select(doc, "written", "original")
    return spans.rewritten(masked, other, doc, text), kept
