"""How much the placeholders of one passage tell together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Types that are clues, those of them at the core of an identity, sizes of passages.
QUASI = ("PERSON", "JOB_TITLE", "ORGANIZATION", "LOCATION", "ADDRESS", "DATE", "DATE_ISO", "AGE", "INDIRECT")
CORE = ("PERSON", "JOB_TITLE", "ORGANIZATION", "LOCATION", "ADDRESS", "INDIRECT")
LONGEST, STRIDE, EXCERPT = 800, 600, 280
LABEL = r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9_]*_[0-9]+(?:\.v_[0-9]+)?(?![\p{L}\p{N}_])"
LEVELS = ("low", "medium", "high")
#: Sets of clues that give a passage away, in the order they are tried.
TELLING = (("INDIRECT",), ("JOB_TITLE", "ORGANIZATION", "LOCATION"), ("PERSON", "ORGANIZATION", "LOCATION"), ("PERSON", "JOB_TITLE", "ORGANIZATION"))


def reason(clues: tuple[str, ...] | None = None, count: str = "") -> str:
    """What a level rests on, said from the clues or their number."""
    return f"together: {', '.join(c.lower() for c in clues)}" if clues else f"clues together: {count}"


def label_type(label: Column) -> Column:
    """PERSON of PERSON_1.v_2."""
    return F.regexp_replace(F.substring_index(label, ".v_", 1), r"_[0-9]+$", "")


def passages(text: Column) -> Column:
    """Paragraphs, trimmed; one longer than LONGEST is cut into overlapping parts every STRIDE characters."""
    trim = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), trim), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(STRIDE)), lambda i: trim(F.substr(p, i + 1, F.lit(LONGEST))))
    return F.filter(F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= LONGEST, F.array(p)).otherwise(cut(p)))), lambda p: p != "")


def score(types: Column) -> Column:
    """(level, reason) of the types of one passage."""
    has = lambda *names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(types, n))
    core = F.size(F.array_intersect(types, F.array(*[F.lit(c) for c in CORE])))
    quasi = F.arrays_overlap(types, F.array(*[F.lit(q) for q in QUASI]))
    timed = has("PERSON") & F.arrays_overlap(types, F.array(F.lit("DATE"), F.lit("DATE_ISO"), F.lit("AGE")))
    result = lambda level, why: F.struct(F.lit(level).alias("level"), F.lit(why).alias("reason"))
    out = F.when(F.lit(False), result("low", ""))
    for clues in TELLING:
        out = out.when(has(*clues), result("high", reason(clues)))
    return (
        out.when(core >= 3, result("high", reason(count="three or more")))
        .when((core >= 2) | timed, result("medium", reason(count="two")))
        .when(quasi, result("low", reason(count="one")))
        .otherwise(result("low", reason(count="none")))
    )


def risk_windows(masked: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, window_no, level, types, placeholders, excerpt, reason) of every passage that holds a clue.

    A set of placeholders that stands in one passage of its document only, with
    two or more kinds of clue, is at least medium.
    """
    w = masked.where(F.col(text).isNotNull()).select(F.col(doc).alias("_d"), F.posexplode(passages(F.col(text))).alias("window_no", "passage"))
    labels = F.array_sort(F.array_distinct(F.regexp_extract_all("passage", F.lit(LABEL), F.lit(0))))
    w = w.withColumn("placeholders", labels).withColumn("all_types", F.array_distinct(F.transform("placeholders", label_type)))
    w = w.withColumn("types", F.array_sort(F.array_intersect("all_types", F.array(*[F.lit(q) for q in QUASI])))).where(F.size("types") > 0)
    w = w.withColumn("s", score(F.col("all_types")))
    alone = (F.count("*").over(W.partitionBy("_d", "placeholders")) == 1) & (F.size("types") >= 2) & (F.col("s.level") == "low")
    excerpt = F.when(F.length("passage") <= EXCERPT, F.col("passage")).otherwise(F.concat(F.substr("passage", F.lit(1), F.lit(EXCERPT - 3)), F.lit("...")))
    return w.select(
        F.col("_d").alias(doc), "window_no", F.when(alone, F.lit("medium")).otherwise(F.col("s.level")).alias("level"), "types", "placeholders", excerpt.alias("excerpt"),
        F.when(alone, F.lit(f"{reason(count='several')}, in this passage only")).otherwise(F.col("s.reason")).alias("reason"),
    )


def risk_summary(windows: DataFrame, masked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, overall, window_count, high_count, medium_count, low_count): one row for each text, low without windows."""
    count = lambda level: F.count_if(F.col("level") == level).alias(f"{level}_count")
    per = windows.groupBy(F.col(doc).alias("_d")).agg(F.count("*").alias("window_count"), *[count(x) for x in reversed(LEVELS)])
    out = masked.select(doc).distinct().join(per, F.col(doc) == F.col("_d"), "left").drop("_d").fillna(0)
    overall = F.when(F.col("high_count") > 0, "high").when(F.col("medium_count") > 0, "medium").otherwise("low")
    return out.select(doc, overall.alias("overall"), "window_count", "high_count", "medium_count", "low_count")


def entity_list_risk(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, overall, types, excerpt, reason): all entities of a document as one passage."""
    grouped = entities.where("type <> ''").groupBy(doc).agg(F.collect_set(F.upper("type")).alias("all_types"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "; ").alias("joined"))
    s = score(F.col("all_types"))
    quasi = F.array_sort(F.array_intersect("all_types", F.array(*[F.lit(q) for q in QUASI])))
    return grouped.select(doc, s["level"].alias("overall"), quasi.alias("types"), F.substr("joined", F.lit(1), F.lit(EXCERPT)).alias("excerpt"), s["reason"].alias("reason"))
