"""Tables as cells: (doc_id, sheet, row, col, search_text, original, kind, formula)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.operators.chunking import packed, split_text
from maskweave.operators.spans import boundary_pattern, holders, rewritten_parts
from maskweave.session import ranked

#: Fixed value: kinds of cells that patterns are looked for in.
SEARCHED = ("text", "formula")


def field_kind(c: Column) -> Column:
    """empty, formula (a leading =; a leading + is a phone number) or text."""
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").when(c.startswith("="), "formula").otherwise("text")


def column_letter(n: Column) -> Column:
    """A for 1, AA for 27; up to four letters."""
    digit = lambda x: F.char((x - 1) % 26 + 65)
    up = lambda x: F.floor((x - 1) / 26).cast("int")
    steps = [n]
    for _ in range(3):
        steps.append(up(steps[-1]))
    return F.concat(*[F.when(s > 0, digit(s)).otherwise(F.lit("")) for s in reversed(steps)])


def header_labels(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, sheet, col, label): the first row if all of it is text and unique but for case, else Col A, Col B, …

    sheets: (doc_id, sheet, max_row, max_column).
    """
    cols = sheets.where("max_column > 0").select("doc_id", "sheet", "max_column", F.explode(F.sequence(F.lit(1), F.col("max_column"))).alias("col"))
    first = cells.where((F.col("row") == 1) & (F.col("kind") == "text") & (F.trim("search_text") != "")).select("doc_id", "sheet", "col", F.trim("search_text").alias("head"))
    joined = cols.join(first, ["doc_id", "sheet", "col"], "left")
    per = joined.groupBy("doc_id", "sheet").agg((F.count("head") == F.max("max_column")).alias("full"), (F.countDistinct(F.lower("head")) == F.count("head")).alias("unique"))
    return joined.join(per, ["doc_id", "sheet"]).select("doc_id", "sheet", "col", F.when(F.col("full") & F.col("unique"), F.col("head")).otherwise(F.concat(F.lit("Col "), column_letter(F.col("col")))).alias("label"))


def masked_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells rewritten one by one, so that nothing is replaced across cells."""
    return rewritten_parts(cells, mapping, ["sheet", "row", "col"], "doc_id", "search_text")


def neutralised(text: Column, kind: Column) -> Column:
    """What a CSV field holds: formulas get a leading apostrophe so that no program runs them."""
    return F.when((kind == "formula") & ~text.startswith("'"), F.concat(F.lit("'"), text)).otherwise(text)


def unneutralised(text: Column) -> Column:
    return F.when(text.startswith("'="), F.substr(text, F.lit(2))).otherwise(text)


def flattened(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, text): each table as text, a line a row with `` | `` between cells, an empty line after each.

    Empty and bool cells are blank; sheets come in the order of ``sheet_no``.
    Rows become lines first, so that what meets in one place is a sheet's lines.
    """
    shown = cells.where(~F.col("kind").isin("empty", "bool")).select("doc_id", "sheet", "row", F.struct("col", "search_text").alias("c"))
    lines = shown.groupBy("doc_id", "sheet", "row").agg(F.map_from_entries(F.collect_list("c")).alias("by_col"))
    rows = sheets.where("max_row > 0").select("doc_id", "sheet", "max_column", F.explode(F.sequence(F.lit(1), F.col("max_row"))).alias("row"))
    whole = rows.join(lines, ["doc_id", "sheet", "row"], "left")
    values = F.transform(F.when(F.col("max_column") > 0, F.sequence(F.lit(1), F.col("max_column"))).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.try_element_at("by_col", i), F.lit("")))
    line = whole.select("doc_id", "sheet", "row", F.array_join(values, " | ").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: F.concat(x["line"], F.lit("\n\n"))), "")
    per_sheet = sheets.join(line.groupBy("doc_id", "sheet").agg(text.alias("body")), ["doc_id", "sheet"], "left")
    part = F.concat(F.lit("# Sheet: "), F.col("sheet"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return per_sheet.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", part.alias("part")))), lambda x: x["part"]), "").alias("text"))


def model_batches(cells: DataFrame, labels: DataFrame, sheets: DataFrame, size: int) -> DataFrame:
    """(doc_id, sheet, batch_no, text): rows of a sheet as addressed lines, packed into batches for a model.

    A row that is too long is split into its cells, a cell that is too long into
    parts; nothing overlaps.  Lines and units are expressions over rows.  Only
    the packing is sequential: a sheet's units meet in one row, in order; a
    sheet read from a file has at most MAX_TABLE_CELLS cells.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, max(size, 1), 0) or [t])

    @F.pandas_udf("array<string>")
    def pack(units: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([list(packed(list(u), h, size)) for u, h in zip(units, heads, strict=True)])

    named = cells.where("search_text <> ''").join(labels, ["doc_id", "sheet", "col"], "left")
    letters = column_letter(F.col("col"))
    at = F.concat(F.lit("["), F.col("sheet"), F.lit("!"), letters, F.col("row").cast("string"), F.lit("] "), F.coalesce("label", F.concat(F.lit("Col "), letters)))
    head = F.concat(F.lit("## Row "), F.col("row").cast("string"), F.lit("\n"))
    lines = named.select("doc_id", "sheet", "row", "col", at.alias("at"), "search_text", F.concat(at, F.lit(": "), F.col("search_text")).alias("line"))
    rows = lines.groupBy("doc_id", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "line", "at", "search_text"))).alias("cells"))  # one row's cells
    rows = rows.withColumn("block", F.concat(head, F.array_join(F.transform("cells", lambda c: c["line"]), "\n")))
    short = rows.where(F.length("block") <= size).select("doc_id", "sheet", "row", F.lit(0).alias("col"), F.lit(1).alias("part"), F.col("block").alias("unit"))
    single = rows.where(F.length("block") > size).select("doc_id", "sheet", "row", F.explode("cells").alias("c")).select("doc_id", "sheet", "row", "c.*")
    fits = single.where(F.length("line") <= size).select("doc_id", "sheet", "row", "col", F.lit(1).alias("part"), F.concat(head, F.col("line")).alias("unit"))
    parts = single.where(F.length("line") > size).withColumn("parts", cut("search_text"))
    of = F.concat(F.lit(" (part "), F.col("k").cast("string"), F.lit("/"), F.size("parts").cast("string"), F.lit("): "))
    long = parts.select("*", F.posexplode("parts").alias("k0", "text")).withColumn("k", F.col("k0") + 1)
    long = long.select("doc_id", "sheet", "row", "col", F.col("k").alias("part"), F.concat(head, F.col("at"), of, F.col("text")).alias("unit"))
    units = short.unionByName(fits).unionByName(long).groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "col", "part", "unit"))).alias("u"))
    batches = pack(F.transform("u", lambda x: x["unit"]), F.concat(F.lit("# Sheet: "), F.col("sheet")))
    return units.select("doc_id", "sheet", F.posexplode(batches).alias("batch_no", "text"))


def in_some_cell(found: DataFrame, cells: DataFrame) -> DataFrame:
    """The model's entities (doc_id, text, …) that stand in a cell of their table, by words' ends."""
    forms = found.select("doc_id", F.col("text").alias("form"), F.lit(0).alias("payload")).distinct()
    texts = cells.where("search_text <> ''").select("doc_id", "search_text").distinct()
    may = holders(texts, forms, ["search_text"], "doc_id", "search_text")
    sure = may.where(F.rlike("search_text", boundary_pattern(F.col("form")))).select("_d", F.col("form").alias("_f"))
    return found.join(sure, (found["doc_id"] == F.col("_d")) & (found["text"] == F.col("_f")), "left_semi")


def roster_cells(rows: DataFrame, id_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Any table as cells: one row for each value, with ``doc_id`` from the first id column.

    Rows are numbered in the order of the other id columns, in ranges of keys,
    so a table may hold a large share of all rows.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("v")) for i, c in enumerate(value_cols, 1)]))
    numbered = ranked(rows.select(*id_cols, *value_cols), id_cols[:1], id_cols[1:], "row", "roster-rows")
    out = numbered.select(F.col(id_cols[0]).alias("doc_id"), F.lit("Sheet1").alias("sheet"), "row", entries.alias("e")).select("doc_id", "sheet", "row", "e.col", F.coalesce("e.v", F.lit("")).alias("search_text"))
    return out.withColumn("kind", field_kind(F.col("search_text"))).withColumn("original", F.col("search_text")).withColumn("formula", F.when(F.col("kind") == "formula", F.col("search_text")))
