"""Queries of readers, sinks, configuration and the model's seam, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave import config, model
from maskweave.operators import residual
from maskweave.plans import oracle as O
from maskweave.plans.queries import _CELLS, _ROSTER, _cells, docs, query
from maskweave.session import table
from maskweave.sources import files, sinks, xlsx

# tables as files and back


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CASE WHEN starts_with(search_text, '=') THEN chr(39) || search_text ELSE search_text END AS search_text FROM {_CELLS} WHERE search_text <> ''")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster written as CSV files, one for each sheet, and read again; formulas come back neutralised."""
    cells = _cells(spark, sf_dir)
    sheets = table(spark, sf_dir, "people").groupBy(F.col("sheet_id").alias("doc_id")).agg(F.count("*").cast("int").alias("max_row"))
    null = lambda kind: F.lit(None).cast(kind)
    sheets = sheets.select("doc_id", "max_row", F.lit(len(_ROSTER)).alias("max_column"), null("array<int>").alias("row_widths"), F.lit(",").alias("delimiter"), F.lit("\r\n").alias("line_end"), F.lit(False).alias("had_bom"))
    written = sinks.csv_files(cells, sheets).select(F.col("doc_id").cast("string").alias("path"), "content")
    return files.csv_tables(written)[0].select("doc_id", "row", "col", "search_text")


# files made of the sheets: the delimiter is the sheet's, encoding and line end go by its number
_ENCODINGS = ["utf-8", "utf-8-sig", "cp1252", "latin-1"]
_ENDS = ["\n", "\r\n", "\r"]


@query(
    f"SELECT CAST(sheet_id AS VARCHAR) AS doc_id, delimiter, [{', '.join(O.q(x) for x in _ENCODINGS)}][sheet_id % 4 + 1] AS encoding, sheet_id % 4 = 1 AS had_bom, ['LF', 'CRLF', 'CR'][sheet_id % 3 + 1] AS line_end, CAST(13 AS INT) AS max_row, CAST(4 AS INT) AS max_column, '3,3,3,3,3,3,3,3,3,3,3,0,4' AS row_widths FROM sheets WHERE delimiter IS NOT NULL"
)
def csv_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, dialect, line end and ragged widths as they are found out from bytes."""
    s = table(spark, sf_dir, "sheets").where("delimiter is not null").select(F.col("sheet_id").alias("i"), F.col("delimiter").alias("d"))
    end = F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("i") % 3 + 1).cast("int"))
    strange = F.when(F.col("i") % 4 == 3, "\x81").otherwise("\u00e9")
    lines = [F.concat_ws("", F.lit("name"), "d", F.lit("caf"), strange, "d", F.lit("town")), *[F.concat_ws("", F.lit(f"one{k}"), "d", F.lit(f"two{k}"), "d", F.lit(f"three{k}")) for k in range(10)], F.lit(""), F.concat_ws("", F.lit("1"), "d", F.lit("2"), "d", F.lit("3"), "d", F.lit("4"))]
    text = F.concat(*[x for line in lines for x in (line, end)])
    content = F.when(F.col("i") % 4 == 0, F.encode(text, "UTF-8")).when(F.col("i") % 4 == 1, F.encode(F.concat(F.lit("\ufeff"), text), "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    _, sheets = files.csv_tables(s.select(F.col("i").cast("string").alias("path"), content.alias("content")))
    names = F.when(F.col("line_end") == "\r\n", "CRLF").when(F.col("line_end") == "\r", "CR").otherwise("LF")
    return sheets.select("doc_id", "delimiter", "encoding", "had_bom", names.alias("line_end"), "max_row", "max_column", F.array_join("row_widths", ",").alias("row_widths"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, 'X' || search_text AS search_text FROM {_CELLS} WHERE search_text <> '' AND NOT starts_with(search_text, '=')")
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster as workbooks, read, every text changed, written and read again; formulas without cached values are blank."""
    rows = _cells(spark, sf_dir).groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "search_text"))), lambda x: x["search_text"]).alias("values"))  # one row's cells
    books = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "values"))), lambda x: x["values"]).alias("rows"))  # a sheet's rows, at most MAX_TABLE_CELLS cells

    @F.pandas_udf("binary")
    def book(sheets: pd.Series) -> pd.Series:
        return sheets.map(lambda r: xlsx.workbook({"Sheet1": [list(x) for x in r]}))

    made = books.select(F.col("doc_id").cast("string").alias("path"), book("rows").alias("content"))
    cells, _ = files.xlsx_tables(made)
    changed = cells.withColumn("search_text", F.concat(F.lit("X"), "search_text"))
    again, _ = files.xlsx_tables(sinks.xlsx_files(changed, made).select(F.col("doc_id").alias("path"), "content"))
    return again.select("doc_id", "row", "col", "search_text")


@query("SELECT o_orderkey, CASE WHEN x = floor(x) AND abs(x) < 1e15 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE format('{:g}', x) END AS shown FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN o_totalprice * 1e-9 ELSE floor(o_totalprice) * 1e14 END AS x FROM orders)")
def cell_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as cells show them for the search."""

    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        return x.map(lambda v: xlsx.shown(float(v))[0])

    p = F.col("o_totalprice")
    x = F.when(F.col("o_orderkey") % 4 == 0, p).when(F.col("o_orderkey") % 4 == 1, F.floor(p).cast("double")).when(F.col("o_orderkey") % 4 == 2, p * 1e-9).otherwise(F.floor(p).cast("double") * 1e14)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown(x).alias("shown"))


# a model's hits, by the deterministic client

_NAME = "[A-Z][a-z]+ [A-Z][a-z]+"
_CLIENT = model.PatternClient(_NAME, failing=4)  # two of five prompts are refused on their first try
_NAMED = f"SELECT doc_id, CAST(k AS INT) AS match_idx, x AS text FROM (SELECT doc_id, unnest(g) AS x, unnest(range(len(g))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{_NAME}') AS g FROM documents WHERE text IS NOT NULL))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("text is not null").select("doc_id", F.lit(0).alias("chunk_idx"), "text")


@query(f"SELECT doc_id, match_idx, text, 'PERSON' AS type FROM ({_NAMED})")
def model_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a client that refuses some prompts at first."""
    hits, _ = model.model_hits(_asked(spark, sf_dir), _CLIENT, retries=2, base_delay=0)
    return hits.select("doc_id", "match_idx", "text", "type")


@query(f"WITH cached AS (SELECT DISTINCT text AS t FROM documents WHERE lang = 'en' AND text IS NOT NULL) SELECT n.doc_id, match_idx, n.text, CASE WHEN cached.t IS NOT NULL THEN 'CACHED' ELSE 'PERSON' END AS type FROM ({_NAMED}) n JOIN documents d USING (doc_id) LEFT JOIN cached ON cached.t = d.text")
def model_hits_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of English texts are answered by a cache, the others by the client."""
    asked = _asked(spark, sf_dir)
    english = asked.join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id")
    _, answers = model.model_hits(english, model.PatternClient(_NAME, "CACHED"))
    hits, _ = model.model_hits(asked, _CLIENT, retries=2, base_delay=0, cache=answers)
    return hits.select("doc_id", "match_idx", "text", "type")


@query(f"SELECT DISTINCT doc_id, text, 'PERSON' AS type FROM ({_NAMED})")
def residual_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model still finds in texts."""
    return residual.model_leftovers(docs(spark, sf_dir), model.PatternClient(_NAME)).select("doc_id", "text", "type")


@query("SELECT doc_id, 'm:' || md5(replace(" + O.q(model.PROMPTS["simple"]) + ", '{text}', text)) AS key FROM documents WHERE text IS NOT NULL")
def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys under which answers are kept."""
    return docs(spark, sf_dir).where("text is not null").select("doc_id", model.prompt_key_column("m", model.PROMPTS["simple"], F.col("text")).alias("key"))


_SAID = "CASE o_orderkey % 7 WHEN 0 THEN 'HTTP 429 slow down' WHEN 1 THEN 'status 503' WHEN 2 THEN 'Connection reset' WHEN 3 THEN 'bad API key' WHEN 4 THEN 'rate limit and 500' WHEN 5 THEN '401 after timeout' ELSE 'odd' END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'RATE_LIMIT_ERROR' WHEN 1 THEN 'SERVER_ERROR' WHEN 2 THEN 'CONNECTION_ERROR' WHEN 3 THEN 'AUTHENTICATION_ERROR' WHEN 4 THEN 'RATE_LIMIT_ERROR' WHEN 5 THEN 'CONNECTION_ERROR' ELSE 'GENERIC_ERROR' END AS class, o_orderkey % 7 <> 3 AS again FROM orders")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of errors by the words of their messages, and whether another try is worth it."""

    @F.pandas_udf("again boolean, class string")
    def classes(said: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.classify(RuntimeError(x)) for x in said], columns=["again", "class"])

    return table(spark, sf_dir, "orders").select("o_orderkey", classes(F.expr(_SAID)).alias("c")).select("o_orderkey", "c.class", "c.again")


# configuration, for every configuration of the tables

_PROFILE_OF = "CASE WHEN NOT use_llm THEN 'regex-only' WHEN max_retries > 4 THEN 'best-quality' WHEN chunk_size > 40000 THEN 'best-cost' ELSE 'best-speed' END"
_PROFILES = O.values([("best-quality", 15000, 2000, 5, 1), ("best-speed", 30000, 1000, 3, 1), ("best-cost", 60000, 3000, 3, 1), ("regex-only", 200000, 0, 1, 0)], "p(name, size, overlap, retries, asks)")


@query(f"SELECT config_id, name AS profile, chunk_size, CAST(overlap AS INT) AS chunk_overlap, CAST(retries AS INT) AS max_retries, asks = 1 AS use_model FROM app_configs a JOIN {_PROFILES} ON name = {_PROFILE_OF.replace('use_llm', 'a.use_llm').replace('max_retries', 'a.max_retries')}")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile nearest to each configuration, with the configuration's own chunk size."""
    rows = table(spark, sf_dir, "app_configs").select("config_id", "chunk_size", F.expr(_PROFILE_OF).alias("name")).collect()  # a table of parameters
    made = [(r.config_id, r.name, config.profile(r.name, chunk_size=r.chunk_size)) for r in rows]
    return spark.createDataFrame([(i, n, c.chunk_size, c.chunk_overlap, c.max_retries, c.use_model) for i, n, c in made], "config_id int, profile string, chunk_size int, chunk_overlap int, max_retries int, use_model boolean")


@query("SELECT config_id, 'ollama' AS provider, model_name AS model FROM app_configs WHERE model_name <> 'none' UNION ALL SELECT config_id, 'openrouter', 'openai/gpt-4o' FROM app_configs WHERE model_name = 'none'")
def model_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider of each configuration's model; local models are named with it, none stands for an alias."""
    rows = table(spark, sf_dir, "app_configs").select("config_id", "model_name").collect()  # a table of parameters
    found = [(r.config_id, *config.resolve_model("openai/gpt-4o" if r.model_name == "none" else f"ollama/{r.model_name}")) for r in rows]
    return spark.createDataFrame(found, "config_id int, provider string, model string")
