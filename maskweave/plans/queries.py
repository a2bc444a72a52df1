"""Queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave import patterns as P
from maskweave.functions import checksums, writing
from maskweave.operators import chunking, detect, entities, evaluate, mapping, rejects, residual, restore, risk, spans, tables
from maskweave.plans import oracle as O
from maskweave.plans import pipeline
from maskweave.session import spread, staged, table
from maskweave.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


# rejected rows (problem 4)


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "people_raw"), table(spark, sf_dir, "sheets")).select("record_id")


@query()
def p4_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "people_raw"), table(spark, sf_dir, "sheets"))


@query()
def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.load_valid(table(spark, sf_dir, "people_raw"), table(spark, sf_dir, "sheets"))


# detection

_COLUMNS = ["doc_id", "pattern_idx", "match_idx", "text", "type"]


def _hits_of(types: list[str], name: str) -> None:
    library = {t: P.PATTERNS[t] for t in types}

    @query("SELECT * FROM (" + O.hits(library=library, checked=False) + ")", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.hits(docs(spark, sf_dir), patterns=library, checked=False).select(*_COLUMNS)


_hits_of(["EMAIL"], "hits_email")
_hits_of(["PHONE"], "hits_phone")

_NETWORK = {t: P.PATTERNS[t] for t in ("IPV4_ADDRESS", "IPV6_ADDRESS", "MAC_ADDRESS")}


@query("SELECT * FROM (" + O.hits("entity_dicts", "hit_id", library=_NETWORK, checked=False) + ")")
def hits_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the values of hits, since documents hold no network addresses."""
    values = spread(table(spark, sf_dir, "entity_dicts").select(F.col("hit_id").alias("doc_id"), "text"), "doc_id")
    return detect.hits(values, patterns=_NETWORK, checked=False).select(*_COLUMNS)


_hits_of(["CREDIT_CARD", "CURRENCY_AMOUNT", "IBAN", "BIC_SWIFT"], "hits_finance")
_hits_of(["URL", "DATE_ISO", "VIN", "CRYPTO_BTC", "CRYPTO_ETH"], "hits_other")


@query("SELECT * FROM (" + O.hits(library=P.select(["US", "GB"]), checked=False) + ")")
def hits_country_us_gb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.hits(docs(spark, sf_dir), countries=["US", "GB"], checked=False).select(*_COLUMNS)


@query(O.hits())
def hits_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.hits(docs(spark, sf_dir)).select(*_COLUMNS)


@query(f"SELECT type, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT text) AS BIGINT) AS texts FROM ({O.hits('people', 'person_id', 'notes')}) GROUP BY type")
def hits_in_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = spread(table(spark, sf_dir, "people").select(F.col("person_id").alias("doc_id"), F.col("notes").alias("text")), "doc_id")
    return detect.hits(notes).groupBy("type").agg(F.count("*").alias("hits"), F.countDistinct("text").alias("texts"))


@query(f"SELECT lang, type, CAST(count(*) AS BIGINT) AS hits FROM ({O.hits(library={t: P.PATTERNS[t] for t in ('EMAIL', 'PHONE', 'SSN_US')})}) JOIN documents USING (doc_id) GROUP BY lang, type")
def hits_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.hits(docs(spark, sf_dir), patterns={t: P.PATTERNS[t] for t in ("EMAIL", "PHONE", "SSN_US")})
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "type").agg(F.count("*").alias("hits"))


@query(O.places())
def hits_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.located_hits(docs(spark, sf_dir))


@query("SELECT type, country, CAST(priority AS INT) AS priority FROM " + O.values([(t, P.country_of(t), P.priority(t)) for t in P.PATTERNS], "v(type, country, priority)"))
def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([(t,) for t in P.PATTERNS], "type string")
    last = F.element_at(F.split("type", "_"), -1)
    country = F.when(F.col("type") == "SSN", "US").when(last.isin(*P.COUNTRIES), last)
    return types.select("type", country.alias("country"), entities.priority(F.col("type")).cast("int").alias("priority"))


# check digits, over numbers made of keys and over the hits that the tables hold

_KEYS: dict[str, tuple[Callable[[Column], Column], str, str, Callable[[Column], Column], Callable[[str], str]]] = {}


def _keyed(name: str, check: Callable[[Column], Column], sql_check: Callable[[str], str], spark_value: str, sql_value: str | None = None) -> None:
    """The check over a number made of o_orderkey; the same expression is SQL in both engines unless one is given."""
    sql_value = sql_value or spark_value

    @query(f"SELECT o_orderkey, v AS value, {sql_check('v')} AS ok FROM (SELECT o_orderkey, {sql_value} AS v FROM orders)", f"check_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(spark_value).alias("value"))
        return made.select("o_orderkey", "value", check(F.col("value")).alias("ok"))


_S = "CAST(o_orderkey AS STRING)"
_keyed("luhn", checksums.luhn, O.luhn, f"concat('4', lpad({_S}, 15, '7'))", "'4' || lpad(CAST(o_orderkey AS VARCHAR), 15, '7')")
_keyed("verhoeff", checksums.verhoeff, O.verhoeff, f"lpad({_S}, 12, '3')", "lpad(CAST(o_orderkey AS VARCHAR), 12, '3')")
_keyed("card", checksums.credit_card, O.CHECKS["CREDIT_CARD"], f"concat('4111 1111 1', lpad({_S}, 7, '0'))", "'4111 1111 1' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')")
_keyed("npi", checksums.npi, O.CHECKS["MEDICAL_NPI_US"], f"lpad({_S}, 10, '1')", "lpad(CAST(o_orderkey AS VARCHAR), 10, '1')")
_keyed("sin", checksums.sin_ca, O.CHECKS["SIN_CA"], f"lpad({_S}, 9, '0')", "lpad(CAST(o_orderkey AS VARCHAR), 9, '0')")
_keyed("iban", checksums.iban, O.iban, f"concat('DE', lpad(CAST(o_orderkey % 98 AS STRING), 2, '0'), lpad({_S}, 18, '5'))", "'DE' || lpad(CAST(o_orderkey % 98 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey AS VARCHAR), 18, '5')")
_keyed("vin", checksums.vin, O.vin, f"concat('1HGCM826', CAST(o_orderkey % 10 AS STRING), 'A', lpad({_S}, 7, '0'))", "'1HGCM826' || CAST(o_orderkey % 10 AS VARCHAR) || 'A' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')")
_keyed("dni", checksums.dni_es, O.dni, f"concat(lpad({_S}, 8, '0'), char(65 + o_orderkey % 26))", "lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || chr(CAST(65 + o_orderkey % 26 AS INT))")
_keyed("nie", checksums.nie_es, O.nie, f"concat(char(88 + o_orderkey % 3), lpad({_S}, 7, '0'), char(65 + o_orderkey % 26))", "chr(CAST(88 + o_orderkey % 3 AS INT)) || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || chr(CAST(65 + o_orderkey % 26 AS INT))")
_keyed("cn_id", checksums.resident_id_cn, O.cn, f"concat('1101051990', lpad({_S}, 7, '0'), if(o_orderkey % 11 = 10, 'X', CAST(o_orderkey % 11 AS STRING)))", "'1101051990' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE CAST(o_orderkey % 11 AS VARCHAR) END")
_keyed("aadhaar", checksums.aadhaar_in, O.aadhaar, f"concat('2341', lpad({_S}, 8, '0'))", "'2341' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')")
_keyed("cpf", checksums.cpf_br, O.cpf, f"lpad({_S}, 11, '1')", "lpad(CAST(o_orderkey AS VARCHAR), 11, '1')")
_keyed("codice", checksums.codice_fiscale_it, O.codice, f"concat('RSSMRA', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), 'M01H', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), char(65 + o_orderkey % 26))", "'RSSMRA' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || 'M01H' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || chr(CAST(65 + o_orderkey % 26 AS INT))")
_keyed("pesel", checksums.pesel_pl, O.pesel, f"lpad({_S}, 11, '4')", "lpad(CAST(o_orderkey AS VARCHAR), 11, '4')")


@query(f"SELECT hit_id, text, CASE WHEN type = 'IBAN' THEN {O.iban('text')} ELSE {O.CHECKS['CREDIT_CARD']('text')} END AS ok FROM entity_dicts WHERE type IN ('IBAN', 'CREDIT_CARD') AND text IS NOT NULL")
def checked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "entity_dicts").where("type IN ('IBAN', 'CREDIT_CARD') AND text IS NOT NULL")
    return t.select("hit_id", "text", checksums.passes(F.col("type"), F.col("text"), ["IBAN", "CREDIT_CARD"]).alias("ok"))


# entities


def _entities(spark: SparkSession, sf_dir: str, **kw: object) -> DataFrame:
    d = docs(spark, sf_dir)
    return entities.finalised(detect.hits(d), d, **kw)


@query(O.with_hits(O.ENTITIES + "SELECT doc_id, ord, text, type FROM e0"))
def entities_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("doc_id", "ord", "text", "type")


_FILTER = ["DRIVERS_LICENSE", "DATE", "EMAIL", "IBAN", "PASSPORT"]
_FILTER_SQL = " OR ".join(f"t = '{x}' OR starts_with(t, '{x}_') OR ends_with(t, '_{x}') OR p = '{x}' OR starts_with(p, '{x}_') OR ends_with(p, '_{x}')" for x in _FILTER)


@query(O.with_hits(O.ENTITIES + f"SELECT doc_id, text, type FROM (SELECT *, type AS t, CASE WHEN ends_with(type, '_LIKE') THEN left(type, length(type) - 5) ELSE type END AS p FROM d) WHERE {_FILTER_SQL}"))
def entities_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, types=_FILTER).select("doc_id", "text", "type")


_DENY = ["consent form", "VOICE MEMO", "Größholm", "no such phrase"]


@query(
    O.with_hits(
        O.ENTITIES
        + "SELECT p.doc_id, p.text, 'CUSTOM' AS type FROM (SELECT doc_id, substr(text, strpos(lower(text), lower(w)), length(w)) AS text FROM documents, "
        + O.values([(w,) for w in _DENY], "v(w)")
        + " WHERE strpos(lower(text), lower(w)) > 0) p ANTI JOIN d ON d.doc_id = p.doc_id AND lower(d.text) = lower(p.text)"
    )
)
def deny_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return detect.denied(d, entities.distinct_entities(detect.hits(d)), _DENY).select("doc_id", "text", "type")


_KEEP = ["ok", "23125", "example", "1989-05-26"]


@query(O.with_hits(O.ENTITIES + f"SELECT doc_id, text, type FROM d WHERE lower(text) NOT IN ({', '.join(O.q(k.lower()) for k in _KEEP)})"))
def keep_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return detect.kept_out(entities.distinct_entities(detect.hits(d)), _KEEP).select("doc_id", "text", "type")


@query(O.with_hits(O.ENTITIES + "SELECT doc_id, ord, text, base_form FROM e"))
def base_form_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("doc_id", "ord", "text", "base_form")


# maps


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.numbered(_entities(spark, sf_dir))


_M = O.ENTITIES + "," + O.MAPPING


@query(O.with_hits(_M + "SELECT doc_id, ord, original, written, type, base_form FROM m"))
def mapping_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping(spark, sf_dir).drop("seen")


@query(O.with_hits(_M + "SELECT doc_id, ord, original, written, type, base_form FROM m"))
def mapping_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering in ranges of keys, as tables get it, gives the same."""
    return mapping.numbered(_entities(spark, sf_dir), hot=True, free=True).drop("seen")


@query(O.with_hits(_M + "SELECT doc_id, written, arg_max(original, ord) AS original FROM m GROUP BY doc_id, written"))
def mapping_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.inverted(_mapping(spark, sf_dir))


_H = "'H_' || left(sha256(original), 16)"


@query(O.with_hits(_M + "SELECT doc_id, type, CAST(max(CAST(regexp_extract(written, '^[A-Z][A-Z0-9_]*_([0-9]+)', 1) AS INT)) AS INT) AS n FROM (SELECT doc_id, written, regexp_extract(written, '^([A-Z][A-Z0-9_]*)_[0-9]+', 1) AS type FROM m) GROUP BY doc_id, type"))
def mapping_seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.seed_counts(_mapping(spark, sf_dir))


# a map given from placeholder to original, made of the roster
_PAIRS = "(SELECT sheet_id AS doc_id, person_id AS ord, 'PERSON_' || row_no AS key, name AS value FROM people WHERE name IS NOT NULL)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "people").where("name is not null")
    return p.select(F.col("sheet_id").alias("doc_id"), F.col("person_id").alias("ord"), F.concat(F.lit("PERSON_"), "row_no").alias("key"), F.col("name").alias("value"))


@query(f"SELECT doc_id, value AS original, arg_min(key, ord) AS written FROM {_PAIRS} GROUP BY doc_id, value")
def mapping_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.oriented(_pairs(spark, sf_dir))


@query(f"SELECT doc_id, key AS written, first_value(key) OVER (PARTITION BY doc_id, value ORDER BY ord) AS canonical, value AS original FROM {_PAIRS}")
def mapping_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.consolidated(_pairs(spark, sf_dir).select("doc_id", "ord", F.col("key").alias("written"), F.col("value").alias("original")))


@query(O.with_hits(_M + f"SELECT doc_id, ord, original, {_H} AS written FROM m"))
def mapping_hash_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = {t: "hash" for t in P.PATTERNS}
    return mapping.written_by_operator(_mapping(spark, sf_dir), every).select("doc_id", "ord", "original", "written")


# a map of the fixtures, which the documents go on from
_FIXTURE_MAP = f"sm AS MATERIALIZED (WITH h0 AS ({O.hits('fixtures', 'fixture_id')}), {O.ENTITIES}, {O.CORPUS} SELECT original, written FROM c)"
_SEED_PARTS = f"""{_FIXTURE_MAP},
sp AS (SELECT *, regexp_extract(written, '^([A-Z][A-Z0-9_]*)_[0-9]+', 1) AS stype, CAST(regexp_extract(written, '_([0-9]+)(?:\\.v_[0-9]+)?$', 1) AS INT) AS n,
       regexp_replace(written, '\\.v_[0-9]+$', '') AS label, coalesce(TRY_CAST(regexp_extract(written, '\\.v_([0-9]+)$', 1) AS INT), 0) AS v FROM sm)"""
_SEEDED = f"""{O.entities(seeds='sm')},
f AS (SELECT e.*, g.label AS given FROM e ANTI JOIN sp ON sp.original = e.text LEFT JOIN (SELECT original, label FROM sp WHERE v = 0) g ON g.original = e.base_form),
g2 AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, base_form) AS group_ord, first_value(type) OVER (PARTITION BY doc_id, base_form ORDER BY ord) AS group_type FROM f),
n2 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, group_type, given IS NULL ORDER BY group_ord) AS n, sum(CASE WHEN text <> base_form THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, base_form ORDER BY ord) AS v FROM g2),
m2 AS (SELECT doc_id, CASE WHEN text = base_form THEN group_ord ELSE ord END AS ord, text AS original, coalesce(given, group_type || '_' || (n + coalesce(hi, 0))) || CASE WHEN text <> base_form THEN '.v_' || (v + coalesce(most, 0)) ELSE '' END AS written, type, base_form
       FROM n2 LEFT JOIN (SELECT stype, max(n) AS hi FROM sp GROUP BY stype) x ON x.stype = group_type LEFT JOIN (SELECT label, max(v) AS most FROM sp WHERE v > 0 GROUP BY label) y ON y.label = given)"""


def _fixture_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fixtures").select(F.col("fixture_id").alias("doc_id"), "text")
    return staged(mapping.corpus_numbered(entities.finalised(detect.hits(f), f)).select("original", "written"), "fixture-map")


@query(f"WITH h0 AS ({O.hits()}), {_SEED_PARTS}, {_SEEDED} SELECT doc_id, ord, original, written, type, base_form FROM m2")
def mapping_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = _fixture_map(spark, sf_dir)
    return mapping.numbered(_entities(spark, sf_dir, seeds=seed), seed=seed).drop("seen")


@query(O.with_hits(O.ENTITIES + "," + O.CORPUS + "SELECT original, written, type, base_form FROM c"))
def mapping_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.corpus_numbered(_entities(spark, sf_dir))


# write operators, over the hits and dates that the tables hold

_HITS = "(SELECT hit_id, text, type FROM entity_dicts WHERE text IS NOT NULL)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entity_dicts").where("text is not null").select("hit_id", "text", "type")


@query(f"SELECT hit_id, 'H_' || left(sha256(text), 16) AS written FROM {_HITS}")
def op_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("hit_id", writing.hashed(F.col("text")).alias("written"))


def _keep_last_sql(c: str) -> str:
    n = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    left = f"length(regexp_replace(substr({c}, i), '[^0-9]', '', 'g'))"
    ch = f"substr({c}, i, 1)"
    return f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN regexp_full_match({ch}, '\\pL') THEN '*' WHEN {ch} BETWEEN '0' AND '9' AND ({n} <= 4 OR {left} > 4) THEN '*' ELSE {ch} END), '')"


_MASK_KIND = O.mask_kind("type")
_DOMAIN = "substr(text, strpos(text, '@') + 1)"
_MASK_EMAIL = f"CASE WHEN NOT contains(text, '@') THEN repeat('*', greatest(length(text), 4)) ELSE left(text, strpos(text, '@') - 1)[1:1] || '***@' || CASE WHEN contains({_DOMAIN}, '.') THEN regexp_extract({_DOMAIN}, '(?s)^(.*)\\.[^.]*$', 1)[1:1] || '***.' || string_split({_DOMAIN}, '.')[-1] ELSE {_DOMAIN}[1:1] || '***' END END"
_MASK_SQL = f"""CASE WHEN {_MASK_KIND} IN ('CREDIT_CARD', 'SIN_CA', 'MEDICAL_NPI_US', 'PHONE') OR starts_with({_MASK_KIND}, 'SSN') OR ends_with({_MASK_KIND}, 'IBAN') THEN {_keep_last_sql('text')}
  WHEN {_MASK_KIND} = 'EMAIL' THEN {_MASK_EMAIL} WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 THEN {_keep_last_sql('text')}
  WHEN text = '' THEN '****' ELSE regexp_replace(text, '[\\pL\\pN]', '*', 'g') END"""


@query(f"SELECT hit_id, {_MASK_SQL} AS written FROM {_HITS}")
def op_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("hit_id", writing.mask(F.col("text"), F.col("type")).alias("written"))


_DOM = "substr(text, strpos(text, '@') + 1)"


@query(
    f"SELECT hit_id, left(text, strpos(text, '@') - 1)[1:1] || '***@' || CASE WHEN contains({_DOM}, '.') THEN regexp_extract({_DOM}, '(?s)^(.*)\\.[^.]*$', 1)[1:1] || '***.' || string_split({_DOM}, '.')[-1] ELSE {_DOM}[1:1] || '***' END AS written FROM {_HITS} WHERE type = 'EMAIL' AND contains(text, '@')"
)
def op_mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where("type = 'EMAIL' AND contains(text, '@')").select("hit_id", writing.mask_email(F.col("text")).alias("written"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS written FROM orders")
def op_generalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", writing.generalize(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("DATE_ISO")).alias("written"))


@query("SELECT p_partkey, CASE WHEN p_size > 89 THEN '90+' ELSE (p_size // 10 * 10) || '-' || (p_size // 10 * 10 + 9) END AS written FROM part")
def op_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", writing.generalize(F.col("p_size").cast("string"), F.lit("AGE")).alias("written"))


@query("SELECT o_orderkey, left(lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0'), 3) || '**' AS written FROM orders")
def op_generalize_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", writing.generalize(F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit("ADDRESS")).alias("written"))


_ZIP_ONCE = "regexp_replace({}, '(^|[^\\pL\\pN_])([0-9]{{3}})[0-9]{{2}}(?:-[0-9]{{4}})?($|[^\\pL\\pN_])', '\\1\\2**\\3', 'g')"
_ZIPS = _ZIP_ONCE.format(_ZIP_ONCE.format("address_1"))


@query(f"SELECT sample_id, CASE WHEN regexp_full_match(trim(address_1), '[0-9]{{5}}(-[0-9]{{4}})?') THEN left(trim(address_1), 3) || '**' ELSE {_ZIPS} END AS written FROM sample_maps WHERE address_1 IS NOT NULL")
def op_generalize_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "sample_maps").where("address_1 is not null")
    return t.select("sample_id", writing.generalize(F.col("address_1"), F.lit("ADDRESS")).alias("written"))


_SPECS = ["date=shift", "IBAN = mask", "EMAIL=hash", "SSN_US=fake", "PHONE=generalize"]
_SPEC_SQL = "CASE {0} WHEN 'DATE' THEN 'shift' WHEN 'IBAN' THEN 'mask' WHEN 'EMAIL' THEN 'hash' WHEN 'SSN_US' THEN 'fake' WHEN 'PHONE' THEN 'generalize' END"


@query(f"SELECT hit_id, coalesce({_SPEC_SQL.format('upper(type)')}, {_SPEC_SQL.format(O.mask_kind('type'))}, CASE WHEN starts_with({O.mask_kind('type')}, 'DATE') THEN 'shift' END, 'replace') AS operator FROM {_HITS}")
def op_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of every hit's type, from TYPE=operator texts."""
    return _values(spark, sf_dir).select("hit_id", writing.chosen_operator(F.col("type"), writing.parse_specs(_SPECS)).alias("operator"))


_SHA = f"sha256('{writing.SHIFT_SALT}:' || o_custkey)"
_HEX = lambda s, n: " + ".join(f"(strpos('0123456789abcdef', substr({s}, {i}, 1)) - 1) * {16 ** (n - i)}" for i in range(1, n + 1))


@query(f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST((({_HEX(_SHA, 4)}) % 365 - 182) AS INT), '%Y-%m-%d') AS written FROM orders")
def op_shift_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", writing.shift(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string")).alias("written"))


def _fakes() -> dict[str, tuple[str, str]]:
    """Name of a column -> (type, SQL) of each shape of fakes, made of the blocks of a hash."""
    word = lambda words, n: "[" + ", ".join(O.q(w) for w in words) + f"][CAST({n} % {len(words)} AS INT) + 1]"
    made = {}
    for column, kind in [(k.lower(), k) for k in ("PERSON", "EMAIL", "PHONE", "FAX", "LOCATION", "ADDRESS", "ORGANIZATION", "JOB_TITLE", "DATE", "AGE", "CREDIT_CARD", "SSN", "SIN_CA", "IBAN", "IP_ADDRESS", "URL", "VIN", "OTHER")]:
        sha = f"sha256('{writing.FAKE_SECRET}:{kind}:' || o_orderkey)"
        b = [O.block(sha, i) for i in range(3)]
        pad = lambda i, n, b=b: f"lpad(CAST({b[i]} % {10**n} AS VARCHAR), {n}, '0')"
        cap = lambda w: f"(upper({w}[1]) || {w}[2:])"
        sql = {
            "PERSON": f"{word(writing._FIRST, b[0])} || ' ' || {word(writing._LAST, b[1])}", "EMAIL": f"lower({word(writing._FIRST, b[0])}) || '.' || lower({word(writing._LAST, b[1])}) || '@example.org'",
            "PHONE": f"'555-010' || {pad(0, 1)}", "FAX": f"'555-010' || {pad(0, 1)}", "LOCATION": word(writing._CITY, b[0]), "ADDRESS": f"({b[0]} % 997 + 1) || ' ' || {word(writing._STREET, b[1])} || ' Street'",
            "ORGANIZATION": f"{word(writing._LAST, b[0])} || ' Ltd'", "JOB_TITLE": f"'Officer ' || {cap(word(writing._WORDS, b[0]))}",
            "DATE": f"strftime(make_date(CAST(1980 + {b[0]} % 41 AS BIGINT), 1, 1) + CAST({b[1]} % 362 AS INT), '%Y-%m-%d')", "AGE": f"CAST({b[0]} % 60 + 21 AS VARCHAR)", "CREDIT_CARD": f"'4111 ' || {pad(0, 4)} || ' ' || {pad(1, 4)} || ' ' || {pad(2, 4)}",
            "SSN": f"'000-00-' || {pad(0, 4)}", "SIN_CA": f"'000-00-' || {pad(0, 4)}", "IBAN": f"'GB00FAKE' || {pad(0, 5)} || {pad(1, 5)}", "IP_ADDRESS": f"'203.0.113.' || ({b[0]} % 254 + 1)",
            "URL": f"'https://example.test/' || {word(writing._WORDS, b[0])} || '-' || {word(writing._WORDS, b[1])}", "VIN": f"'1HGCM8263' || {pad(0, 1)} || 'A' || {pad(1, 6)}", "OTHER": cap(word(writing._WORDS, b[0])),
        }[kind]
        made[column] = (kind, sql)
    return made


_FAKES = _fakes()


@query("SELECT o_orderkey, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in _FAKES.items()) + " FROM orders")
def op_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of fakes."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return t.select("o_orderkey", *[writing.fake(F.col("k"), F.lit(kind), F.col("k")).alias(c) for c, (kind, _) in _FAKES.items()])


# rewriting and restoring


def _masked(spark: SparkSession, sf_dir: str, **kw: object) -> pipeline.Masked:
    return pipeline.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), **kw)


_MASKED = _M + "," + O.masked(O.DOCUMENT_PARTS)


@query(O.with_hits(_MASKED + " SELECT doc_id, text FROM masked"))
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).docs


@query(O.with_hits(O.ENTITIES + "," + O.chosen(O.DOCUMENT_PARTS) + " SELECT doc_id, s AS start_pos, e AS end_pos, entity FROM chosen"))
def chosen_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return spans.chosen_spans(d, entities.distinct_entities(detect.hits(d)))


_EDGE = lambda c: f"CASE WHEN regexp_full_match({c}, {O.WORDY}) THEN"


@query(
    f"SELECT hit_id, regexp_matches(d.text, {_EDGE('x.text[1]')} '(?:^|[^\\pL\\pN_])' ELSE '' END || regexp_escape(x.text) || {_EDGE('x.text[-1]')} '(?:$|[^\\pL\\pN_])' ELSE '' END) AS found FROM entity_dicts x JOIN documents d USING (doc_id) WHERE x.text <> '' AND d.text IS NOT NULL"
)
def boundary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each hit's text stands between words' ends in its document, by a pattern made of the text."""
    x = table(spark, sf_dir, "entity_dicts").where("text <> ''").select("hit_id", "doc_id", F.col("text").alias("entity"))
    return x.join(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "doc_id").select("hit_id", F.rlike("text", spans.boundary_pattern(F.col("entity"))).alias("found"))


@query(f"WITH h0 AS ({O.hits()}), {_SEED_PARTS}, {_SEEDED}, both_maps AS (SELECT doc_id, original, written FROM m2 UNION ALL SELECT e0.doc_id, sm.original, sm.written FROM e0 JOIN sm ON sm.original = e0.text), {O.masked(O.DOCUMENT_PARTS, 'both_maps')} SELECT doc_id, text FROM masked")
def masked_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents masked after the fixtures, whose map they go on from."""
    return _masked(spark, sf_dir, seed=_fixture_map(spark, sf_dir)).docs


@query("SELECT doc_id, text FROM documents")
def restored_equals_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking by labels and restoring gives every text back; labels that a text holds already are masked first."""
    m = _masked(spark, sf_dir)
    out, _, _ = pipeline.deanonymize(m.docs, mapping.inverted(m.mapping))
    return out


@query("SELECT sheet_id AS doc_id, 'see ' || string_agg('PERSON_' || first_no, ', ' ORDER BY person_id) AS text FROM (SELECT sheet_id, person_id, first_value(row_no) OVER (PARTITION BY sheet_id, name ORDER BY person_id) AS first_no FROM people WHERE name IS NOT NULL) GROUP BY sheet_id")
def consolidated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name each label of the roster's map once, after consolidation."""
    pairs = _pairs(spark, sf_dir)
    labels = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"])
    texts = pairs.groupBy("doc_id").agg(F.concat(F.lit("see "), F.array_join(labels, ", ")).alias("text"))
    inverse = pairs.select("doc_id", "ord", F.col("key").alias("written"), F.col("value").alias("original"))
    return pipeline.consolidate(texts, inverse)[0]


_BASE = lambda c: f"regexp_replace({c}, '\\.v_[0-9]+$', '')"


@query(O.with_hits(_MASKED + f" SELECT DISTINCT doc_id, written AS label FROM m WHERE (doc_id, written) NOT IN (SELECT (key, {_BASE('written')}) FROM written)"))
def unused_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _masked(spark, sf_dir)
    inverse = mapping.inverted(m.mapping)
    return restore.unused_labels(inverse, restore.restored(m.docs, inverse))


@query(O.with_hits(_MASKED + f" SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {O.LABELS}))) AS label FROM masked"))
def unknown_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an empty map, everything in the masked texts that looks like a placeholder is unknown."""
    none = spark.createDataFrame([], "doc_id long, used array<string>")
    return restore.unknown_labels(_masked(spark, sf_dir).docs, none)


@query(O.with_hits("x AS (SELECT 1) SELECT DISTINCT doc_id, trim(text) AS text, type FROM h0 WHERE NOT regexp_full_match(trim(text), '[A-Z_]+_[0-9]+(\\.v_[0-9]+)?')"))
def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.leftovers(docs(spark, sf_dir)).select("doc_id", "text", "type").distinct()


_LEFT = f"SELECT DISTINCT doc_id, trim(text) AS text, type FROM ({O.hits('masked')}) WHERE NOT regexp_full_match(trim(text), {O.LABELS})"


@query(O.with_hits(_MASKED + f", hits_left AS ({_LEFT}) SELECT d.doc_id, CAST(count(l.type) AS INT) AS residual_count FROM documents d LEFT JOIN hits_left l ON l.doc_id = d.doc_id GROUP BY d.doc_id"))
def residual_after_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = staged(_masked(spark, sf_dir).docs, "masked")
    return residual.leftover_report(masked, residual.leftovers(masked)).select("doc_id", "residual_count")


# risk, over texts of placeholders made of keys

_RISK_SPARK = """concat('PERSON_', o_custkey % 7 + 1, if(o_orderkey % 2 = 0, ' of ORGANIZATION_1', ''), if(o_orderkey % 3 = 0, ' in LOCATION_2', ''), '\\n\\n',
  if(o_orderkey % 5 = 0, 'INDIRECT_1 was here\\n \\n', ''), 'On DATE_', o_orderkey % 3 + 1, if(o_orderkey % 4 = 0, ' PERSON_1.v_2', ''), ' EMAIL_1', '\\n\\n', 'JOB_TITLE_1 and AGE_', o_orderkey % 2 + 1)"""
_RISK_SQL = """'PERSON_' || (o_custkey % 7 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN ' of ORGANIZATION_1' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' in LOCATION_2' ELSE '' END || E'\\n\\n' ||
  CASE WHEN o_orderkey % 5 = 0 THEN E'INDIRECT_1 was here\\n \\n' ELSE '' END || 'On DATE_' || (o_orderkey % 3 + 1) || CASE WHEN o_orderkey % 4 = 0 THEN ' PERSON_1.v_2' ELSE '' END || ' EMAIL_1' || E'\\n\\n' || 'JOB_TITLE_1 and AGE_' || (o_orderkey % 2 + 1)"""
_QUASI = "[" + ", ".join(O.q(x) for x in risk.QUASI) + "]"
_CORE = "[" + ", ".join(O.q(x) for x in risk.CORE) + "]"
_RISK = f"""WITH t AS (SELECT o_orderkey AS doc_id, {_RISK_SQL} AS text FROM orders),
w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '')) AS passage FROM t),
l AS (SELECT doc_id, passage, list_sort(list_distinct(regexp_extract_all(passage, '\\b[A-Z][A-Z0-9_]*_[0-9]+(?:\\.v_[0-9]+)?'))) AS placeholders FROM w),
y AS (SELECT *, list_distinct(list_transform(placeholders, lambda p: regexp_replace(regexp_replace(p, '\\.v_[0-9]+$', ''), '_[0-9]+$', ''))) AS all_types FROM l),
z AS (SELECT *, list_sort(list_intersect(all_types, {_QUASI})) AS types, len(list_intersect(all_types, {_CORE})) AS core FROM y),
s AS (SELECT *, CASE WHEN list_contains(all_types, 'INDIRECT') OR list_has_all(all_types, ['JOB_TITLE', 'ORGANIZATION', 'LOCATION']) OR list_has_all(all_types, ['PERSON', 'ORGANIZATION', 'LOCATION'])
       OR list_has_all(all_types, ['PERSON', 'JOB_TITLE', 'ORGANIZATION']) OR core >= 3 THEN 'high'
       WHEN core >= 2 OR (list_contains(all_types, 'PERSON') AND list_has_any(all_types, ['DATE', 'DATE_ISO', 'AGE'])) THEN 'medium' ELSE 'low' END AS level0 FROM z WHERE len(types) > 0),
r AS (SELECT doc_id, types, placeholders, CASE WHEN level0 = 'low' AND len(types) >= 2 AND count(*) OVER (PARTITION BY doc_id, placeholders) = 1 THEN 'medium' ELSE level0 END AS level FROM s)
"""


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_RISK_SPARK).alias("text"))


@query(_RISK + "SELECT doc_id, level, array_to_string(types, ',') AS types, array_to_string(placeholders, ',') AS placeholders FROM r")
def risk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = risk.risk_windows(_risky(spark, sf_dir))
    return w.select("doc_id", "level", F.array_join("types", ",").alias("types"), F.array_join("placeholders", ",").alias("placeholders"))


@query(
    _RISK
    + "SELECT doc_id, CASE WHEN bool_or(level = 'high') THEN 'high' WHEN bool_or(level = 'medium') THEN 'medium' ELSE 'low' END AS overall, count(*) AS window_count, count(*) FILTER (level = 'high') AS high_count, count(*) FILTER (level = 'medium') AS medium_count, count(*) FILTER (level = 'low') AS low_count FROM r GROUP BY doc_id"
)
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _risky(spark, sf_dir)
    return risk.risk_summary(risk.risk_windows(t), t)


_TRIM = lambda c: f"regexp_replace({c}, '^[\\s\\x0b\\pZ]+|[\\s\\x0b\\pZ]+$', '', 'g')"
_PASSAGES = f"""WITH p AS (SELECT doc_id, k AS part, {_TRIM('x')} AS passage FROM (SELECT doc_id, unnest(g) AS x, unnest(range(len(g))) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[\\s\\x0b]*\\n') AS g FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, part, i, CASE WHEN length(passage) <= 800 THEN passage ELSE {_TRIM("substr(passage, CAST(i * 600 + 1 AS INT), 800)")} END AS passage FROM (SELECT *, unnest(range(CASE WHEN length(passage) <= 800 THEN 1 ELSE (length(passage) - 1) // 600 + 1 END)) AS i FROM p WHERE passage <> ''))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, i) - 1 AS INT) AS window_no, passage FROM w WHERE passage <> ''"""


@query(_PASSAGES)
def risk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents; a text without any has no row."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(risk.passages(F.col("text"))).alias("window_no", "passage"))


_LIST_TYPES = "CASE upper(type) WHEN 'EMAIL' THEN 'PERSON' WHEN 'PHONE' THEN 'JOB_TITLE' WHEN 'IBAN' THEN 'ORGANIZATION' WHEN 'URL' THEN 'LOCATION' WHEN 'SSN_US' THEN 'AGE' WHEN 'CUSTOM' THEN '' ELSE upper(type) END"
_LIST_RISK = f"""WITH l AS (SELECT doc_id, list_distinct(list(t)) AS all_types, string_agg(text, '; ' ORDER BY hit_id) AS joined FROM (SELECT *, {_LIST_TYPES} AS t FROM entity_dicts WHERE text IS NOT NULL AND type IS NOT NULL) WHERE t <> '' GROUP BY doc_id),
c AS (SELECT *, len(list_intersect(all_types, {_CORE})) AS core, list_sort(list_intersect(all_types, {_QUASI})) AS types FROM l)
SELECT doc_id, CASE WHEN list_contains(all_types, 'INDIRECT') OR list_has_all(all_types, ['JOB_TITLE', 'ORGANIZATION', 'LOCATION']) OR list_has_all(all_types, ['PERSON', 'ORGANIZATION', 'LOCATION'])
  OR list_has_all(all_types, ['PERSON', 'JOB_TITLE', 'ORGANIZATION']) OR core >= 3 THEN 'high' WHEN core >= 2 OR (list_contains(all_types, 'PERSON') AND list_has_any(all_types, ['DATE', 'DATE_ISO', 'AGE'])) THEN 'medium' ELSE 'low' END AS overall,
  array_to_string(types, ',') AS types, left(joined, 280) AS excerpt FROM c"""


@query(_LIST_RISK)
def entity_list_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each document as one passage, under types that can be clues."""
    t = table(spark, sf_dir, "entity_dicts").where("text is not null and type is not null").select("doc_id", F.col("hit_id").alias("ord"), "text", F.expr(_LIST_TYPES).alias("type"))
    return risk.entity_list_risk(t).select("doc_id", "overall", F.array_join("types", ",").alias("types"), "excerpt")


# evaluation

_DIRECT = ", ".join(O.q(x) for x in evaluate.DIRECT)
_QUASI_T = ", ".join(O.q(x) for x in evaluate.QUASI)
_EVAL = f"""WITH a AS (SELECT doc_id, upper(type) AS type, start_pos, end_pos, lower(trim(text, ' ')) AS lt, base_form IS NOT NULL AS is_g, chunk_idx = 0 AS is_p FROM entity_dicts WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN type IN ({_DIRECT}) OR starts_with(type, 'SSN') THEN 'direct' WHEN type IN ({_QUASI_T}) THEN 'quasi' ELSE 'other' END AS kind FROM a),
s AS (SELECT *, 1 AS is_gold FROM k WHERE is_g UNION ALL SELECT *, 0 FROM k WHERE is_p),
x AS (SELECT *, unnest(['all', kind]) AS grp FROM s),
mk AS (SELECT grp, doc_id, start_pos, end_pos, lt, sum(is_gold) AS g, sum(1 - is_gold) AS p FROM x WHERE grp <> 'other' GROUP BY ALL),
ek AS (SELECT grp, doc_id, kind, lt, max(is_gold) AS g, max(1 - is_gold) AS p FROM x WHERE grp <> 'other' GROUP BY ALL),
u AS (SELECT grp AS kind, 'mention' AS level, sum(CASE WHEN g > 0 AND p > 0 THEN 1 ELSE 0 END) AS tp, sum(p) AS pred, sum(g) AS gold FROM mk GROUP BY grp
      UNION ALL SELECT grp, 'entity', sum(CASE WHEN g > 0 AND p > 0 THEN 1 ELSE 0 END), sum(p), sum(g) FROM ek GROUP BY grp)
SELECT kind, level, CAST(tp AS BIGINT) AS true_positives, CAST(pred AS BIGINT) AS predicted, CAST(gold AS BIGINT) AS gold, tp / pred AS precision, tp / gold AS recall, 2 * (tp / pred) * (tp / gold) / (tp / pred + tp / gold) AS f1 FROM u"""


@query(_EVAL)
def eval_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a base form as gold, hits of first chunks as predictions."""
    t = table(spark, sf_dir, "entity_dicts").where("text is not null")
    m = t.select("doc_id", "text", "type", F.lit(None).cast("string").alias("kind"), "start_pos", "end_pos", F.lit(None).cast("string").alias("base_form"), F.col("base_form").alias("given"), "chunk_idx")
    return evaluate.scores(m.where("given is not null"), m.where("chunk_idx = 0"))


# tables: the roster as cells

_ROSTER = ["name", "email", "ssn", "phone", "notes", "city", "id", "formula", "concat", "empty_col"]
_CELLS = (
    "(SELECT sheet_id AS doc_id, row, col, coalesce(v, '') AS search_text FROM (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY person_id) AS row, "
    + f"unnest([{', '.join(_ROSTER)}]) AS v, unnest(range(1, 11)) AS col FROM people))"
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.roster_cells(table(spark, sf_dir, "people"), ["sheet_id", "person_id"], _ROSTER)


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "people").groupBy(F.col("sheet_id").alias("doc_id")).agg(F.lit("Sheet1").alias("sheet"), F.lit(1).alias("sheet_no"), F.count("*").cast("int").alias("max_row"), F.lit(len(_ROSTER)).alias("max_column"))


@query(f"SELECT doc_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CASE WHEN search_text = '' THEN 'empty' WHEN starts_with(search_text, '=') THEN 'formula' ELSE 'text' END AS kind FROM {_CELLS}")
def cells_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("doc_id", "row", "col", "kind")


_LABELS = (
    f"WITH c AS (SELECT doc_id, col, CASE WHEN search_text <> '' AND NOT starts_with(search_text, '=') AND trim(search_text) <> '' THEN trim(search_text) END AS head FROM {_CELLS} WHERE row = 1), "
    "f AS (SELECT doc_id, count(head) = 10 AND count(DISTINCT lower(head)) = 10 AS whole FROM c GROUP BY doc_id) SELECT doc_id, CAST(col AS INT) AS col, CASE WHEN whole THEN head ELSE 'Col ' || chr(CAST(64 + col AS INT)) END AS label FROM c JOIN f USING (doc_id)"
)


@query(_LABELS)
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_labels(_cells(spark, sf_dir), _sheets(spark, sf_dir)).select("doc_id", "col", "label")


@query(
    f"WITH l AS (SELECT doc_id, row, string_agg(search_text, ' | ' ORDER BY col) AS line FROM {_CELLS} GROUP BY doc_id, row) SELECT doc_id, E'# Sheet: Sheet1\\n\\n' || string_agg(line || E'\\n\\n', '' ORDER BY row) AS text FROM l GROUP BY doc_id"
)
def cells_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.flattened(_cells(spark, sf_dir), _sheets(spark, sf_dir))


@query("SELECT n, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters FROM (SELECT CAST(p_partkey AS INT) AS n FROM part WHERE p_partkey BETWEEN 1 AND 16384)")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 16384").select(F.col("p_partkey").cast("int").alias("n")).select("n", tables.column_letter(F.col("n")).alias("letters"))


# a cell's key holds its sheet and its place
_KEYED_CELLS = f"(SELECT doc_id * 1099511627776 + row * 256 + col AS key, doc_id, row, col, search_text FROM {_CELLS})"
_CELL_HITS = f"SELECT doc_id // 1099511627776 AS doc_id, doc_id % 1099511627776 AS place, pattern_idx, match_idx, text, type FROM ({O.hits(_KEYED_CELLS, 'key', 'search_text')})"
_CELL_PARTS = f"SELECT key, doc_id, search_text AS body FROM {_KEYED_CELLS}"
_CELL_MASKED = f"WITH h0 AS MATERIALIZED ({_CELL_HITS}), {O.entities(('place', 'pattern_idx', 'match_idx'))}, {O.MAPPING}, {O.masked(_CELL_PARTS)}"
_CELL_OUT = "SELECT doc_id, CAST(key % 1099511627776 // 256 AS INT) AS row, CAST(key % 256 AS INT) AS col, text AS search_text FROM masked"


@query(f"{_CELL_MASKED} {_CELL_OUT}")
def masked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.anonymize_tables(_cells(spark, sf_dir)).docs.select("doc_id", "row", "col", "search_text")


@query(f"{_CELL_MASKED} {_CELL_OUT}")
def rewritten_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables rewritten from their source by a map and the entities found, as a sink does it."""
    cells = _cells(spark, sf_dir)
    m = pipeline.anonymize_tables(cells)
    return sinks.guarded_rewrite(cells, m.entities, m.mapping).select("doc_id", "row", "col", "search_text")


@query(f"SELECT doc_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, search_text FROM {_CELLS}")
def restored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking the roster and restoring it gives every cell back, formulas too."""
    m = pipeline.anonymize_tables(_cells(spark, sf_dir))
    return pipeline.deanonymize_tables(m.docs, mapping.inverted(m.mapping)).select("doc_id", "row", "col", "search_text")


def _batches_sql(size: int) -> str:
    """Greedy packing of row blocks, or of single cells where a row is too long, as a fold over a sheet's units."""
    return f"""WITH b AS (SELECT doc_id, row, col, '[Sheet1!' || chr(CAST(64 + col AS INT)) || row || '] ' || l.label || ': ' || search_text AS line FROM {_CELLS} JOIN ({_LABELS}) l USING (doc_id, col) WHERE search_text <> ''),
r AS (SELECT doc_id, row, '## Row ' || row || E'\n' || string_agg(line, E'\n' ORDER BY col) AS block FROM b GROUP BY doc_id, row),
u AS (SELECT doc_id, row, 0 AS col, block AS unit FROM r WHERE length(block) <= {size} UNION ALL SELECT doc_id, row, col, '## Row ' || row || E'\n' || line FROM b JOIN r USING (doc_id, row) WHERE length(block) > {size}),
g AS (SELECT doc_id, list_reduce(list(unit ORDER BY row, col), lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) + length('# Sheet: Sheet1') + 1 <= {size} THEN a || E'\n' || x ELSE a || chr(1) || x END) AS packed FROM u GROUP BY doc_id)
SELECT doc_id, 'Sheet1' AS sheet, CAST(k AS INT) AS batch_no, E'# Sheet: Sheet1\n' || x AS text FROM (SELECT doc_id, unnest(string_split(packed, chr(1))) AS x, unnest(range(len(string_split(packed, chr(1))))) AS k FROM g)"""


def _batched(size: int, name: str) -> None:
    @query(_batches_sql(size), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells, sheets = _cells(spark, sf_dir), _sheets(spark, sf_dir)
        return tables.model_batches(cells, tables.header_labels(cells, sheets), sheets, size)


_batched(4000, "table_batches")
_batched(300, "table_batches_of_cells")  # most rows are longer, no cell is


@query(f"WITH f AS (SELECT DISTINCT doc_id, unnest([split_part(name, ' ', 1), reverse(name), left(name, 3), city]) AS text FROM (SELECT sheet_id AS doc_id, name, city FROM people) WHERE name <> '') , held AS MATERIALIZED (SELECT f.doc_id, f.text, c.search_text FROM f JOIN {_CELLS} c ON c.doc_id = f.doc_id AND contains(c.search_text, f.text) WHERE f.text <> '') SELECT DISTINCT doc_id, text FROM held WHERE regexp_matches(search_text, {_EDGE('text[1]')} '(?:^|[^\\pL\\pN_])' ELSE '' END || regexp_escape(text) || {_EDGE('text[-1]')} '(?:$|[^\\pL\\pN_])' ELSE '' END)")
def entities_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of true and false names, those that stand in a cell of their sheet."""
    names = F.array(F.split_part("name", F.lit(" "), F.lit(1)), F.reverse("name"), F.substr("name", F.lit(1), F.lit(3)), F.col("city"))
    found = table(spark, sf_dir, "people").where("name <> ''").select(F.col("sheet_id").alias("doc_id"), F.explode(names).alias("text")).where("text <> ''").distinct()
    return tables.in_some_cell(found, _cells(spark, sf_dir))


# chunks


@query("SELECT doc_id, CAST(i AS INT) AS chunk_idx, substr(text, CAST(i * 600 + 1 AS INT), 800) AS text FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 600 + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.fixed(F.col("text"), 800, 600)).alias("chunk_idx", "text"))


_CHUNK, _OVERLAP = 900, 120


@query()
def chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(docs(spark, sf_dir), _CHUNK, _OVERLAP)


_LETTERS = "regexp_replace(text, '[^0-9A-Za-z]', '', 'g')"


def _covering(name: str, markdown: bool) -> None:
    @query(f"SELECT doc_id, md5({_LETTERS}) AS letters, CAST(0 AS BIGINT) AS too_long FROM documents WHERE regexp_matches(text, '[^\\s\\x0b]')", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Chunks without overlap hold every letter of a text in its order, and none is too long."""
        c = chunking.chunks(docs(spark, sf_dir), _CHUNK, 0, markdown=markdown)
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "")
        return c.groupBy("doc_id").agg(F.md5(F.regexp_replace(whole, "[^0-9A-Za-z]", "")).alias("letters"), F.count_if(F.length("text") > _CHUNK).alias("too_long"))


_covering("chunks_recursive_cover", False)
_covering("chunks_markdown_cover", True)

# texts of single words, where packing is a fold: every name of a part three times over
_WORDS = "concat_ws(' ', p_name, p_type, p_name, p_brand, p_name)"
_FOLD = "list_reduce(string_split(t, ' '), lambda a, w: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 24 THEN a || ' ' || w ELSE a || chr(10) || ' ' || w END)"


@query(f"SELECT doc_id, CAST(k AS INT) AS chunk_idx, trim(x) AS text FROM (SELECT doc_id, unnest(g) AS x, unnest(range(len(g))) AS k FROM (SELECT p_partkey AS doc_id, string_split({_FOLD}, chr(10)) AS g FROM (SELECT p_partkey, {_WORDS} AS t FROM part)))")
def chunks_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_WORDS).alias("text"))
    return chunking.chunks(t, 24)


def queries() -> dict[str, Query]:
    from maskweave.plans import queries_io  # noqa: F401  registers more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from maskweave.plans import queries_io  # noqa: F401

    return dict(_SQL)
