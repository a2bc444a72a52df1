"""Precision, recall and F1 of predicted mentions against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that identify directly and those that do together.
DIRECT = "PERSON EMAIL PHONE FAX SSN SSN_US CREDIT_CARD CREDIT_CARD_LIKE IBAN IBAN_LIKE ID ACCOUNT MEDICAL_RECORD HEALTH_PLAN_ID".split()
QUASI = "LOCATION ADDRESS DATE DATE_ISO ORGANIZATION JOB_TITLE AGE INDIRECT".split()


def kind_of(type_: Column, kind: Column | None = None) -> Column:
    """direct, quasi or other; a kind that is given counts."""
    upper = F.upper(F.coalesce(type_, F.lit("")))
    own = F.when(upper.isin(DIRECT) | upper.startswith("SSN"), "direct").when(upper.isin(QUASI), "quasi").otherwise("other")
    return own if kind is None else F.when(kind.isin("direct", "quasi"), kind).otherwise(own)


def _keyed(m: DataFrame, doc: str) -> DataFrame:
    """Mentions with their kind, mention key (place and text, else text) and entity key; types don't count in keys."""
    lower = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    base = F.lower(F.trim(F.coalesce(F.when(F.col("base_form") != "", F.col("base_form")), F.col("text"), F.lit(""))))
    placed = F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()
    mention = F.struct(F.when(placed, F.col("start_pos")).alias("s"), F.when(placed, F.col("end_pos")).alias("e"), lower.alias("t"))
    return m.select(F.col(doc).alias("_d"), kind_of(F.col("type"), F.col("kind")).alias("kind"), F.to_json(mention).alias("mention"), base.alias("entity"))


def scores(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id", per_doc: bool = False) -> DataFrame:
    """(kind, level, true_positives, predicted, gold, precision, recall, f1) for all, direct and quasi mentions.

    Mentions: (doc, text, type, kind, start_pos, end_pos, base_form).  At level
    mention every prediction counts, so one made twice costs precision; at level
    entity the distinct base forms of a kind are compared.  Kinds without any
    mention have no row.
    """
    sides = _keyed(gold, doc).withColumn("is_gold", F.lit(1)).unionByName(_keyed(predicted, doc).withColumn("is_gold", F.lit(0)))
    by = ["_d"] if per_doc else []
    spread = sides.withColumn("group", F.explode(F.array(F.lit("all"), F.col("kind")))).where("`group` <> 'other'")
    n_gold, n_pred = F.sum("is_gold"), F.sum(1 - F.col("is_gold"))
    mention = spread.groupBy("_d", "group", "mention").agg(n_gold.alias("g"), n_pred.alias("p"))
    entity = spread.groupBy("_d", "group", "kind", "entity").agg(F.max("is_gold").alias("g"), F.max(1 - F.col("is_gold")).alias("p"))
    out = None
    for name, keys in (("mention", mention), ("entity", entity)):
        one = keys.groupBy(*by, "group").agg(F.sum(((F.col("g") > 0) & (F.col("p") > 0)).cast("int")).alias("true_positives"), F.sum("p").alias("predicted"), F.sum("g").alias("gold"))
        one = one.select(*by, F.col("group").alias("kind"), F.lit(name).alias("level"), "true_positives", "predicted", "gold")
        out = one if out is None else out.unionByName(one)
    p = F.when(F.col("predicted") > 0, F.col("true_positives") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("gold") > 0, F.col("true_positives") / F.col("gold")).otherwise(F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    out = out.withColumn("f1", f1)
    return out.withColumnRenamed("_d", doc) if per_doc else out
