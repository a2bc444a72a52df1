"""Writing masked texts, tables, maps and reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.operators.tables import masked_cells, neutralised
from maskweave.sources import xlsx


def write_private(path: str, data: bytes) -> None:
    """A file that only its owner reads, in a folder only its owner enters; it appears whole or not at all."""
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True, mode=0o700)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(part, 0o600)
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def write_private_json(path: str, value: object) -> None:
    write_private(path, json.dumps(value, ensure_ascii=False, indent=2).encode())


def save_map(folder: str, stem: str, originals: dict[str, str], passphrase: str | None = None, source_sha256: str = "", keep: bool = True) -> str:
    """Write a map of written form to original, encrypted if there is a passphrase; the path, or "" if it isn't kept."""
    from maskweave import crypto

    if not keep:
        return ""
    if passphrase:
        path = f"{folder}/{stem}.mapping.json.enc"
        write_private_json(path, crypto.encrypt(originals, passphrase, source_sha256))
    else:
        path = f"{folder}/{stem}.mapping.json"
        write_private_json(path, originals)
    return path


def csv_files(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, content): each table as the bytes of a CSV file in its own dialect.

    Rows keep their widths; the text is UTF-8, with a byte order mark if the
    source had one; formulas are neutralised by an apostrophe.  Fields and lines
    are expressions: a field is quoted where it holds the delimiter, the quote
    or a line end.  Only a table's lines meet in one row, to make one file.
    """
    shape = sheets.select(
        F.col("doc_id").alias("_d"), "max_row", "max_column", "row_widths", F.coalesce("delimiter", F.lit(",")).alias("_c"), (F.coalesce("quote", F.lit('"')) if "quote" in sheets.columns else F.lit('"')).alias("_q"),
        F.coalesce("line_end", F.lit("\r\n")).alias("_e"), F.coalesce("had_bom", F.lit(False)).alias("_b"),
    )
    text = neutralised(F.col("search_text"), F.col("kind"))
    at = F.struct("col", text.alias("text"))
    held = cells.where("search_text <> ''").groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(at)).alias("by_col"))  # one row's cells
    rows = shape.where("max_row > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("max_row"))).alias("row"))
    width = F.coalesce(F.get("row_widths", F.col("row") - 1), F.col("max_column"))
    whole = rows.withColumn("_w", width).drop("row_widths").join(held.withColumnRenamed("doc_id", "_hd").withColumnRenamed("row", "_hr"), (F.col("_d") == F.col("_hd")) & (F.col("row") == F.col("_hr")), "left")
    special = lambda v: v.contains(F.col("_c")) | v.contains(F.col("_q")) | v.contains("\n") | v.contains("\r")
    quoted = lambda v: F.when(special(v), F.concat("_q", F.replace(v, F.col("_q"), F.concat("_q", "_q")), "_q")).otherwise(v)
    fields = F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: quoted(F.coalesce(F.try_element_at("by_col", i), F.lit(""))))
    lone = F.concat("_q", "_q")  # a record of one empty field would be read as none
    line = F.when(F.col("_w") < 1, F.lit("")).when((F.col("_w") == 1) & (F.coalesce(F.try_element_at("by_col", F.lit(1)), F.lit("")) == ""), lone).otherwise(F.concat_ws("", F.transform(fields, lambda x, i: F.when(i == 0, x).otherwise(F.concat("_c", x)))))
    lines = whole.select("_d", "row", F.concat(line, F.col("_e")).alias("line"))
    body = lines.groupBy("_d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "").alias("body"))
    out = shape.select("_d", "_b").join(body, "_d", "left")
    content = F.encode(F.concat(F.when(F.col("_b"), "\ufeff").otherwise(""), F.coalesce("body", F.lit(""))), "UTF-8")
    return out.select(F.col("_d").alias("doc_id"), content.alias("content"))


def xlsx_files(cells: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, content): workbooks (path, content) with their cells as they are in ``cells``; formulas become their values.

    A workbook is rewritten from its source, so what isn't a changed cell stays.
    """
    changed = cells.where(F.col("search_text") != F.coalesce("shown", "search_text")) if "shown" in cells.columns else cells.where(F.col("kind").isin("text", "formula"))
    side = changed.groupBy("doc_id").agg(F.collect_list(F.struct("sheet", "row", "col", "search_text")).alias("_m"))  # at most MAX_TABLE_CELLS, see files

    @F.pandas_udf("binary")
    def run(contents: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for content, m in zip(contents, texts, strict=True):
            by_sheet: dict[str, dict[tuple[int, int], str]] = {}
            for x in m if m is not None else []:
                by_sheet.setdefault(x["sheet"], {})[x["row"], x["col"]] = x["search_text"]
            out.append(xlsx.rewritten(bytes(content), by_sheet))
        return pd.Series(out)

    joined = files.join(side, files["path"] == side["doc_id"], "left")
    return joined.select(files["path"].alias("doc_id"), run("content", "_m").alias("content"))


def merged_answers(cache: DataFrame | None, new: DataFrame) -> DataFrame:
    """The answers of a cache and new ones (key, entities), one for each key."""
    new = new.select("key", "entities")
    return new if cache is None else cache.select("key", "entities").unionByName(new.join(cache.select("key"), "key", "left_anti"))


def save_answers(new: DataFrame, folder: str) -> None:
    """Append a model's new answers to a parquet cache, which ``files.read_answers`` reads."""
    new.select("key", "entities").write.mode("append").parquet(folder)


def save_documents(masked: DataFrame, folder: str) -> None:
    """Masked texts as a parquet table (doc_id, text)."""
    masked.select("doc_id", "text").write.mode("overwrite").parquet(f"{folder}/anonymized")


def save_reports(report: DataFrame, folder: str, name: str) -> None:
    """One JSON object a line for each text."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/stats/{name}")


def guarded_rewrite(cells: DataFrame, entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells of a table rewritten from its source; ValueError without entities, or if the map knows none of them."""
    if not entities.limit(1).count():
        raise ValueError("a table is rewritten by the entities found in it; there are none")
    known = entities.join(mapping.select(F.col("doc_id").alias("_d"), F.col("original").alias("_o")), (F.col("doc_id") == F.col("_d")) & (F.col("text") == F.col("_o")), "left_semi")
    if not known.limit(1).count():
        raise ValueError("the map holds none of the entities")
    found = entities.select(F.col("doc_id").alias("_d"), F.col("text").alias("_o")).distinct()
    return masked_cells(cells, mapping.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("original") == F.col("_o")), "left_semi"))
