"""Queries p1_ to p10_ of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm import addresses, formdup, mixing, names, pieces, sanitise, skeleton, spam, tokens
from maskweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = (("entity_models", "entity_id"), ("fixtures", "fixture_id"))
    values = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).alias("row_id"), "text") for t, k in keys]
    return skeleton.inconsistent(values[0].unionByName(values[1])).select("tbl", "row_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "entity_models").select("text").unionByName(table(spark, sf_dir, "fixtures").select("text"))
    return skeleton.groups(values)


def _free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("people", "person_id", "notes"), ("fixtures", "fixture_id", "text"), ("entity_models", "entity_id", "type"))
    out = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).alias("row_id"), F.col(c).alias("text")) for t, k, c in fields]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "entity_models").where("upper(type) LIKE 'ALIAS%'").select(F.col("text").alias("name"))
    return table(spark, sf_dir, "people").select("name").unionByName(aliases)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.personal_items(_free_text(spark, sf_dir), _protected(spark, sf_dir), ["tbl", "row_id"])


def p2_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitised(_free_text(spark, sf_dir), _protected(spark, sf_dir), ["tbl", "row_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formdup.copies(table(spark, sf_dir, "entity_dicts"), "hit_id")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formdup.records(table(spark, sf_dir, "entity_dicts"), "hit_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_building(table(spark, sf_dir, "sample_maps"))


def p5_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.building_classes(table(spark, sf_dir, "sample_maps"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_name(table(spark, sf_dir, "entity_models"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_groups(table(spark, sf_dir, "entity_models"))


def _configs(spark: SparkSession, sf_dir: str) -> list[pieces.Size]:
    return pieces.configurations(table(spark, sf_dir, "app_configs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.piece_spans(table(spark, sf_dir, "documents"), _configs(spark, sf_dir))
    return cut.where("piece_no = 1").select("doc_id", "config_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "documents"), _configs(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_groups, p2_found, p2_sanitised, p3_found, p3_records, p5_found, p5_buildings, p6_found, p6_classes, p7_found, p7_pieces, p8_ids, p9_mix, p9_shares, p10_found)
    }


_RECORD_KEYS = r"""
WITH k AS (
  SELECT hit_id,
         regexp_replace(lower(upper(type)), '[\s\pZ\pC\pP$+<=>^`|~]+', '', 'g') AS kind, text, type
  FROM entity_dicts WHERE text IS NOT NULL),
r AS (
  SELECT hit_id, coalesce(kind, '?') AS kind,
         CASE WHEN kind = 'custom'
              THEN array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(text, '[;|]'),
                     lambda x: regexp_replace(lower(replace(upper(x), 'ß', 'SS')), '[\s\pZ\pC\pP$+<=>^`|~]+', '', 'g')), lambda x: x <> '')), '|')
              ELSE regexp_replace(lower(replace(upper(text), 'ß', 'SS')), '[\s\pZ\pC\pP$+<=>^`|~]+', '', 'g') END AS body
  FROM k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": "SELECT doc_id, config_id FROM documents, app_configs WHERE length(text) > chunk_size",
        "p3_found": _RECORD_KEYS + "SELECT first_id, hit_id AS copy_id FROM (SELECT hit_id, min(hit_id) OVER (PARTITION BY kind, body) AS first_id FROM r) WHERE hit_id <> first_id",
        "p3_records": _RECORD_KEYS + "SELECT min(hit_id) AS first_id, count(*) AS copies FROM r GROUP BY kind, body",
    }
