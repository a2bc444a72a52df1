"""From hits to the entities of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave import patterns as P
from maskweave.operators.detect import denied, kept_out, type_allowed
from maskweave.session import ranked, shuffled, staged

ORDER = ("chunk_idx", "stage", "pattern_idx", "match_idx")


def priority(type_: Column) -> Column:
    """Rank of a type; an unlisted one has 0, a look-alike one less than its parent."""
    table = F.create_map(*[F.lit(x) for pair in P.PRIORITY.items() for x in pair])
    upper = F.upper(type_)
    like = upper.endswith(P.LIKE)
    base = F.when(like & (F.length(upper) > len(P.LIKE)), F.substr(upper, F.lit(1), F.length(upper) - len(P.LIKE))).otherwise(upper)
    return F.coalesce(F.try_element_at(table, base), F.lit(0)) - F.when(like, 1).otherwise(0)


def distinct_entities(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, first, text, type, base_form): one row for each text of a document.

    The type of highest priority wins, the earliest of equals; ``first`` is the
    place in reading order of the first hit of that text.  One aggregation with
    partial results before the shuffle, so a text repeated without end arrives
    once per map task.
    """
    place = F.struct(*ORDER)
    earliest_best = F.min(F.struct((-priority(F.col("type"))).alias("p"), place.alias("o"), F.upper("type").alias("type"), "base_form"))
    out = hits.groupBy(doc, "text").agg(F.min(place).alias("first"), earliest_best.alias("best"))
    return out.select(doc, "first", "text", F.col("best.type").alias("type"), F.col("best.base_form").alias("base_form"))


#: Documents with more entities than this are merged by a join of grams instead of inside one row.
ROW_ENTITIES = 1_000
GRAM = 4
#: Of a form that seeds may contain, about so many grams are looked up among those of the seeds.
LOOKED_UP = 4


def merged_bases(entities: DataFrame, doc: str = "doc_id", seeds: DataFrame | None = None) -> DataFrame:
    """(doc, ord, text, type, base_form): each base form replaced by the longest other one of the document that contains it.

    Ties of length go to the smaller text.  ``seeds`` is an earlier map whose
    originals (``original``) are base forms for every document; it is joined.
    The entities of a document with at most ROW_ENTITIES meet in one row and are
    unfolded again; those of larger ones (whole tables) are joined.  Both ways
    give the same.  The entities are written to the shared folder for that, so it
    must be as private as the texts.
    """
    kept = staged(entities, "entities")  # read several times, found once
    large = kept.groupBy(F.col(doc).alias("_large")).count().where(F.col("count") > ROW_ENTITIES).select("_large")
    of_large = F.col(doc).eqNullSafe(F.col("_large"))
    e = kept if seeds is None else kept.withColumn("_was", F.col("base_form"))
    merged = _merged_in_rows(e.join(large, of_large, "left_anti"), doc).unionByName(_merged_by_grams(e.join(large, of_large, "left_semi"), doc))
    if seeds is None:
        return merged
    n, of_doc = F.length("_old"), F.length("base_form")
    better = (n > of_doc) | (n == of_doc) & (F.col("_old") < F.col("base_form"))
    joined = shuffled(merged, _held_by_seeds(kept, seeds), F.col("_was") == F.col("_b"), "left")
    return staged(joined.select(doc, "ord", "text", "type", F.when(better, F.col("_old")).otherwise(F.col("base_form")).alias("base_form")), "merged")


def _merged_in_rows(entities: DataFrame, doc: str) -> DataFrame:
    one = entities.groupBy(doc).agg(F.collect_list(F.struct(*[c for c in entities.columns if c != doc])).alias("_e"))
    forms = F.filter(F.array_distinct(F.transform("_e", lambda e: e["base_form"])), lambda f: f != "")
    by_length = F.transform(F.array_sort(F.transform(forms, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))), lambda x: x["f"])
    one = one.withColumn("_forms", by_length)

    def merged(e: Column) -> Column:
        b = e["base_form"]
        longer = F.try_element_at(F.filter("_forms", lambda f: (F.length(f) > F.length(b)) & f.contains(b)), F.lit(1))
        return e.withField("base_form", F.when(F.coalesce(b, F.lit("")) != "", F.coalesce(longer, b)).otherwise(b))

    return one.select(doc, F.inline(F.transform("_e", merged)))


def _grams(c: str, n: int, step: Column | None = None) -> Column:
    """The grams of n characters of a column, one at each ``step`` (1); none of a shorter value."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1), F.lit(1) if step is None else step)
    return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _every_gram(c: str) -> Column:
    """Unfolds the distinct grams of up to GRAM characters."""
    return F.explode(F.array_distinct(F.concat(*[_grams(c, n) for n in range(1, GRAM + 1)]))).alias("_g")


def _merged_by_grams(entities: DataFrame, doc: str) -> DataFrame:
    """The same by a join: what contains a form holds the form's rarest gram too.

    Grams are many times the forms, which the planner doesn't see, so nothing is broadcast.
    """
    forms = entities.where("base_form <> ''").select(F.col(doc).alias("_d"), F.col("base_form").alias("_f")).distinct()
    grams = forms.select("_d", "_f", _every_gram("_f"))
    own = grams.where(F.length("_g") == F.least(F.length("_f"), F.lit(GRAM)))  # a form's longest grams
    counts = grams.groupBy("_d", "_g").agg(F.count("*").alias("_c"))
    rarest = shuffled(own, counts, ["_d", "_g"]).groupBy("_d", "_f").agg(F.min(F.struct("_c", "_g"))["_g"].alias("_g"))
    pairs = shuffled(rarest.withColumnRenamed("_f", "_b"), grams, ["_d", "_g"])
    pairs = pairs.where((F.length("_f") > F.length("_b")) & F.col("_f").contains(F.col("_b")))
    best = pairs.groupBy("_d", "_b").agg(F.min(F.struct((-F.length("_f")).alias("n"), "_f"))["_f"].alias("_longer"))
    joined = shuffled(entities, best, (F.col(doc) == F.col("_d")) & (F.col("base_form") == F.col("_b")), "left")
    return joined.select(*[F.coalesce("_longer", "base_form").alias(c) if c == "base_form" else c for c in entities.columns])


def _held_by_seeds(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(_b, _old): base forms, whatever their document, with the longest other original of the seeds that contains them.

    What contains a form holds each of its grams, so any of them can be looked
    up: a few, at even distances, of which the seeds must hold all, and then the
    originals that hold the rarest one are compared.
    """
    forms = entities.where("base_form <> ''").select(F.col("base_form").alias("_b")).distinct()
    few = lambda n: _grams("_b", n, F.greatest(F.lit(1), F.floor((F.length("_b") - n) / (LOOKED_UP - 1)).cast("int")))
    looked_up = F.array_distinct(F.when(F.length("_b") >= GRAM, few(GRAM)).otherwise(F.array("_b")))
    own = forms.select("_b", F.size(looked_up).alias("_all"), F.explode(looked_up).alias("_g"))
    grams = seeds.where("original <> ''").select(F.col("original").alias("_f")).distinct().select("_f", _every_gram("_f"))
    counts = grams.groupBy("_g").agg(F.count("*").alias("_c"))
    rarest = shuffled(own, counts, "_g").groupBy("_b").agg(F.min(F.struct("_c", "_g"))["_g"].alias("_g"), F.count("*").alias("_held"), F.first("_all").alias("_all"))
    pairs = shuffled(rarest.where("_held = _all").select("_b", "_g"), grams, "_g")
    pairs = pairs.where((F.length("_f") > F.length("_b")) & F.col("_f").contains(F.col("_b")))
    return pairs.groupBy("_b").agg(F.min(F.struct((-F.length("_f")).alias("n"), "_f"))["_f"].alias("_old"))


def finalised(hits: DataFrame, docs: DataFrame | None = None, doc: str = "doc_id", text: str = "text", types: list[str] | None = None, deny: list[str] | None = None, keep: list[str] | None = None, seeds: DataFrame | None = None, hot: bool = False) -> DataFrame:
    """(doc, ord, text, type, base_form): the entities of each document, numbered from 1 in order.

    distinct texts, then the type filter, denied phrases, the keep-list and the
    merge of base forms.  Denied phrases come after the filter, so CUSTOM always
    survives it.  hot: a document may hold a large share of all entities.
    """
    e = distinct_entities(hits, doc)
    if types:
        e = e.where(type_allowed(F.col("type"), types))
    e = e.select(doc, F.lit(0).alias("late"), "first", "text", "type", "base_form")
    if deny and docs is not None:
        extra = denied(docs, e, deny, doc, text)
        none = F.struct(F.lit(0).cast("long").alias(ORDER[0]), *[F.lit(0).alias(c) for c in ORDER[1:-1]], F.col("phrase_idx").alias(ORDER[-1]))
        e = e.unionByName(extra.select(doc, F.lit(1).alias("late"), none.alias("first"), "text", "type", "base_form"))
    if keep:
        e = kept_out(e, keep)
    if hot:
        e = ranked(e, [doc], ["late", "first", "text"], "ord", "entity-order")
    else:
        e = e.withColumn("ord", F.row_number().over(W.partitionBy(doc).orderBy("late", "first", "text")))
    return merged_bases(e.select(doc, "ord", "text", "type", "base_form"), doc, seeds)
