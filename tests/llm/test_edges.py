"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from maskweave.llm import addresses, formdup, mixing, names, pieces, sanitise, skeleton, spam, tokens

LONG = "lorem ipsum " * 60_000
CLASH = "key string, form string, n long, block long, word string, text string, doc_id long, rec_key string, source string, skeleton string, count long"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(df):
    """The frame with columns whose names the operators use inside."""
    for c in ("key", "form", "n", "block", "word", "rec_key", "skeleton", "count", "roles", "vector", "sig", "good", "_key", "unnatural", "piece_no"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


EDGE = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (5, LONG), (6, "é" * 5), (7, "\x00\x01")]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_token_ids(spark, rows):
    out = {}
    for r in tokens.encode_corpus(clashing(docs(spark, rows))).collect():
        out.setdefault(r.doc_id, []).append(r.ids)
    assert {k: len(v) for k, v in out.items()} == {k: sum(1 for i, _ in rows if i == k) for k, _ in rows}
    if rows:
        assert out[1] == [[]] and out[2] == [[]] and out[4][0] == out[4][1] and len(out[5][0]) > 100_000
        counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, rows)).collect()}
        assert counts == {k: len(v[0]) for k, v in out.items()}


@pytest.mark.parametrize("rows", [EDGE, []])
def test_spam(spark, rows):
    got = spam.spam_scores(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    assert all(r.unnatural == 0 for r in got if r.doc_id != 5)


@pytest.mark.parametrize("rows", [EDGE, []])
def test_pieces(spark, rows):
    sizes = [pieces.Size(1, 1000, 100), pieces.Size(2, 10**7, 0)]
    got = pieces.pieces(clashing(docs(spark, rows)), sizes).collect()
    assert {(r.doc_id, r.config_id) for r in got} == ({(5, 1)} if rows else set())
    assert all(len(r.text) <= 1000 and r.text == LONG[r.start_pos : r.end_pos] for r in got)
    assert pieces.piece_spans(docs(spark, rows), []).count() == 0


@pytest.mark.parametrize("rows", [EDGE, []])
def test_skeletons(spark, rows):
    got = skeleton.forms(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    assert all(r.form is None for r in got if r.text is None) and all(r.form == "" for r in got if r.text == "")
    assert skeleton.groups(docs(spark, rows)).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0] == sum(t is not None for _, t in rows)


@pytest.mark.parametrize("rows", [EDGE, []])
def test_personal_items(spark, rows):
    people = spark.createDataFrame([("Ada Zebulvers",), (None,), ("",)], "name string")
    assert sanitise.personal_items(clashing(docs(spark, rows)), people, ["doc_id"]).count() == 0
    kept = sanitise.sanitised(clashing(docs(spark, rows)), people, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((i, t or "") for i, t in rows)
    assert sanitise.personal_items(docs(spark, rows), people.limit(0), ["doc_id"]).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "hit_id long, text string, type string")


def test_records(spark):
    rows = [(1, None, "A"), (2, "", "A"), (3, " - ", "A"), (4, "x", None), (5, "X.", None), (5, "x", None), (6, "x", "A"), (7, LONG, "A"), (8, LONG.upper(), "a"), (9, "p|q", "CUSTOM"), (10, "Q ; p;", "custom")]
    df = clashing(hits(spark, rows))
    got = sorted((r.first_id, r.copy_id) for r in formdup.copies(df, "hit_id").collect())
    assert got == [(2, 3), (4, 5), (4, 5), (7, 8), (9, 10)]
    assert formdup.copies(df.limit(0), "hit_id").count() == 0
    assert formdup.records(df, "hit_id").agg(F.sum("copies")).first()[0] == 10


def test_hot_records(spark):
    """A third of all rows under one key takes the salted way and gives the same."""
    df = spark.range(3000).select(F.col("id").alias("hit_id"), F.when(F.col("id") % 3 == 0, "Same One").otherwise(F.col("id").cast("string")).alias("text"), F.lit("T").alias("type"))
    cold, hot = (sorted(map(tuple, formdup.copies(df, "hit_id", hot_rows=n).collect())) for n in (10**9, 100))
    assert cold == hot and len(hot) == 999
    assert sorted(map(tuple, formdup.records(df, "hit_id", hot_rows=100).collect())) == sorted(map(tuple, formdup.records(df, "hit_id").collect()))


def test_addresses(spark):
    rows = [(1, None), (2, ""), (3, "unknown"), (4, "no number Street, Ulmton"), (5, "12 Orchard Street, Ulmton"), (6, "Orchard St. 12; Ulmton"), (6, "Orchard St. 12; Ulmton"), (7, LONG), (8, "12"), (9, "!!! ???")]
    df = clashing(spark.createDataFrame(rows, "sample_id long, address_1 string"))
    assert sorted(map(tuple, addresses.same_building(df).collect())) == [(5, 6), (5, 6)]
    assert addresses.same_building(df.limit(0)).count() == 0


def entities(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, doc_id long, text string, type string, base_form string")


def test_names(spark):
    rows = [
        (1, 1, None, None, None), (2, None, "Ada Quill", "PERSON", None), (3, 1, "", "PERSON", None), (4, 1, "Ada Quill", "PERSON", None), (5, 1, "Quill, Ada", None, None), (5, 1, "Quill, Ada", None, None),
        (6, 2, "QUILL Ada", "PERSON", ""), (7, 1, "...", "PERSON", "..."), (8, 1, LONG, "PERSON", None), (9, 1, "12 + 3", "ID", None),
    ]
    df = clashing(entities(spark, rows))
    assert sorted(map(tuple, names.same_name(df).collect())) == [(4, 5), (4, 5)]
    assert names.same_name(df.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(1, "a", "one two three"), (2, "a", None), (3, "b", "four five six seven"), (4, None, "eight"), (5, "c", ""), (5, "b", "nine ten")]
    d = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    targets = spark.createDataFrame([("m", "a", 0.5, 3), ("m", "b", 0.5, 1), ("m", "nowhere", 0.0, 1), ("m", None, 0.1, 1), ("zero", "a", None, None)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.mix(d, targets).collect()
    assert {r.source for r in got} <= {"a", "b"} and all(1 <= r.repeats <= 3 for r in got)
    assert mixing.shares(mixing.mix(d, targets), targets).where("source is not null").count() == 4
    assert mixing.mix(d.limit(0), targets).count() == 0
