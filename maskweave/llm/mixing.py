"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer.  The total size of a mix is that of all
documents of its listed sources once.  ``budgets`` splits it by the target
shares; what a source cannot give within ``max_repeats`` goes to the others in
proportion to their targets, so that the total is kept and the shares stay as
near as the caps allow.

Efraimidis-Spirakis sampling: a document of quality weight w gets the key
``-ln(u) / w`` with u from a hash of its identifier, and the smallest keys win.
A source's budget is used up in complete epochs first; the rest takes the
documents in the order of their keys up to the budget, which is met to within
half a document.

The sum of sizes in key order is distributed: every source is cut into key
ranges of bounded size, so that a source that holds a third of all documents is
spread over as many tasks as its share of the rows asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm import tokens
from maskweave.session import staged

#: Targets are parameters; more rows than this are refused.
MOST_TARGETS = 10_000
#: Documents per key range, on average.
RANGE_ROWS = 20_000
SEED = 42


def quality(text: Column) -> Column:
    """Weight from 0.3 to 1 of a text: the share of letters and spaces in it, damped for short texts; 0.3 for null."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(0.3) + 0.7 * letters * F.least(F.length(text) / 200, F.lit(1.0)), F.lit(0.3))


def budgets(targets: list[tuple[str, float, int]], sizes: dict[str, int]) -> dict[str, float]:
    """Tokens for each source of one mix, from (source, target share, most repeats) and the sources' sizes.

    Shares that don't sum to 1 are scaled; negative and null shares count as 0.
    """
    cap = {s: float(sizes.get(s, 0)) * max(0, r or 0) for s, _, r in targets}
    share = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    left = float(sum(sizes.get(s, 0) for s in share))
    out = dict.fromkeys(share, 0.0)
    open_ = {s for s in share if share[s] > 0 and cap[s] > 0}
    while open_ and left > 1e-9:
        whole = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / whole >= cap[s]}
        if not full:
            for s in open_:
                out[s] = left * share[s] / whole
            break
        for s in full:
            out[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def _sized(docs: DataFrame, id_col: str, source: str, text: str, path: str, weight: Column | None) -> DataFrame:
    key = F.struct(F.col(id_col).alias("id"), F.col(source).alias("source"), (quality(F.col(text)) if weight is None else weight).cast("double").alias("weight"))
    counted = tokens.token_counts(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", path)
    return staged(counted.select("key.id", "key.source", "key.weight", "n_tokens"), "mixing")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", path: str = tokens.BYTE_BPE, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """(mix_name, source, id, n_tokens, repeats, target_share, reached_share): one row for each document a mix uses.

    ``repeats`` is at most the source's ``max_repeats``.  Documents of a null or
    unlisted source and those without tokens are not used.  A listed source
    without documents has no rows.  With equal keys the smaller identifier wins.
    """
    spark = docs.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).select("mix_name", "source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    listed = F.broadcast(spark.createDataFrame([(s,) for s in sorted({r.source for r in wanted})], "source string"))  # at most MOST_TARGETS rows
    sized = _sized(docs.join(listed, docs[source] == listed["source"], "left_semi"), id_col, source, text, path, weight).where("n_tokens > 0")
    # one row per listed source
    totals = {r.source: (r.size, r.rows) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("rows")).collect()}
    sizes = {s: n for s, (n, _) in totals.items()}

    plan = []
    for name in sorted({r.mix_name for r in wanted}):
        mine = [(r.source, r.target_share, r.max_repeats) for r in wanted if r.mix_name == name]
        for s, budget in budgets(mine, sizes).items():
            if sizes.get(s):
                most = next(r for x, _, r in mine if x == s) or 0
                epochs = min(int(budget // sizes[s]), most)
                rest = budget - epochs * sizes[s] if epochs < most else 0.0
                plan.append((name, s, next(w for x, w, _ in mine if x == s), epochs, float(rest)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "mix_name string, source string, target_share double, epochs int, rest double"))  # as many rows as targets

    ranges = max(1, -(-max([0, *(n for _, n in totals.values())]) // RANGE_ROWS))
    u = (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = sized.withColumn("es_key", -F.log(u) / F.col("weight"))
    # a key's expected share of its source lies below it; so ranges hold about equally many documents whatever the weights are
    step = F.pow(F.lit(2.0), F.round(F.log2("weight") * 2) / 2).alias("w")
    steps = sized.groupBy("source", step).agg(F.count("*").alias("c"))
    whole = W.partitionBy("source")
    shape = steps.withColumn("p", F.col("c") / F.sum("c").over(whole)).groupBy("source").agg(F.collect_list(F.struct("w", "p")).alias("shape"))
    keyed = keyed.join(F.broadcast(shape), "source")  # one row for each listed source, of one entry for each half power of two
    below = F.aggregate("shape", F.lit(0.0), lambda acc, x: acc + x["p"] * (1 - F.exp(-x["w"] * F.col("es_key"))))
    keyed = keyed.withColumn("key_range", F.least(F.floor(below * ranges), F.lit(ranges - 1)).cast("int")).drop("shape")
    per_range = keyed.groupBy("source", "key_range").agg(F.sum("n_tokens").alias("in_range"))
    before = per_range.select("source", "key_range", (F.sum("in_range").over(W.partitionBy("source").orderBy("key_range")) - F.col("in_range")).alias("before_range"))
    within = F.sum("n_tokens").over(W.partitionBy("source", "key_range").orderBy("es_key", "id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = keyed.withColumn("before_row", within).join(before, ["source", "key_range"]).withColumn("before", F.col("before_range") + F.col("before_row"))

    used = placed.join(plan_df, "source").withColumn("repeats", F.col("epochs") + (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).where("repeats > 0")
    used = staged(used.select("mix_name", "source", "id", "n_tokens", "repeats", "target_share"), "mixed")
    reached = used.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("size"))
    reached = reached.select("mix_name", "source", (F.col("size") / F.sum("size").over(W.partitionBy("mix_name"))).alias("reached_share"))
    return used.join(F.broadcast(reached), ["mix_name", "source"]).select("mix_name", "source", F.col("id").alias(id_col), "n_tokens", "repeats", "target_share", "reached_share")  # reached: at most MOST_TARGETS rows


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, reached_share, n_docs, n_tokens) for every target; 0 for a source without documents."""
    got = mixed.groupBy("mix_name", "source").agg(F.max("reached_share").alias("reached_share"), F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    joined = targets.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left")
    return joined.select("mix_name", "source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reached_share", "n_docs", "n_tokens")])
