"""Entities, maps, rewriting, restoring, reports, against sequential brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskweave import patterns as P
from maskweave.operators import chunking, detect, entities, evaluate, mapping, residual, restore, risk, spans, tables
from maskweave.plans import pipeline, queries
from maskweave.session import ranked

TEXT = "Mail jane@acme.org or call +1 (555) 123-4567; card 4111 1111 1111 1111, again jane@acme.org. IP 10.0.0.1, SSN 123-45-6789, on 2019-06-20."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ord int, text string, type string, base_form string")


def sequential(rows):
    """The rule of numbering, one entity after the other."""
    written, bases, counts, variations = {}, {}, {}, {}
    for _, text, type_, base in rows:
        if text in written:
            continue
        if base not in bases:
            counts[type_] = counts.get(type_, 0) + 1
            bases[base] = f"{type_}_{counts[type_]}"
            written.setdefault(base, bases[base])
        label = bases[base]
        if text != base:
            variations[label] = variations.get(label, 0) + 1
            label += f".v_{variations[label]}"
        written[text] = label
    return written


def test_numbering_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(150):
        texts = list(dict.fromkeys("".join(rng.choices("ab1", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))))
        mine = []
        for i, t in enumerate(texts, 1):
            base = min([x for x in texts if x != t and t in x], key=lambda x: (-len(x), x), default=t)
            mine.append((i, t, rng.choice(["A", "B"]), base))
        want[d] = sequential(mine)
        rows += [(d, *m) for m in mine]
    for how in ({}, {"hot": True}, {"free": True}, {"free": True, "hot": True}):
        got = {}
        for r in mapping.numbered(frame(spark, rows), **how).collect():
            assert r.original not in got.setdefault(r.doc_id, {})
            got[r.doc_id][r.original] = r.written
        assert got == want


def test_merge_is_the_same_either_way(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(d, i, t, "A", t) for d in range(20) for i, t in enumerate(dict.fromkeys("".join(rng.choices("ab1é", k=rng.randint(1, 7))) for _ in range(25)), 1)]
    a = sorted(map(tuple, entities.merged_bases(frame(spark, rows)).collect()))
    monkeypatch.setattr(entities, "ROW_ENTITIES", 3)
    assert sorted(map(tuple, entities.merged_bases(frame(spark, rows)).collect())) == a
    by_doc = {}
    for d, _, t, *_ in rows:
        by_doc.setdefault(d, []).append(t)
    assert all(b == min([x for x in by_doc[d] if x != t and t in x], key=lambda x: (-len(x), x), default=t) for d, _, t, _, b in a)


def test_any_base_forms_equal_the_sequential_rule(spark):
    """A model's base forms may be texts of other entities, in chains and circles."""
    rng = random.Random(6)
    rows, want = [], {}
    for d in range(200):
        texts = list(dict.fromkeys("".join(rng.choices("abc", k=rng.randint(1, 2))) for _ in range(rng.randint(1, 9))))
        mine = [(i, t, rng.choice(["A", "B"]), rng.choice([t, rng.choice(texts), "outside"])) for i, t in enumerate(texts, 1)]
        want[d] = sequential(mine)
        rows += [(d, *m) for m in mine]
    for hot in (False, True):
        got = {}
        for r in mapping.numbered(frame(spark, rows), free=True, hot=hot).collect():
            assert r.original not in got.setdefault(r.doc_id, {})
            got[r.doc_id][r.original] = r.written
        assert got == want


def seed_table(spark, seed):
    return spark.createDataFrame(list(seed.items()), "original string, written string")


def test_seeds_go_on(spark):
    e = frame(spark, [(1, 1, "Jane Smith", "PERSON", "Jane Smith"), (1, 2, "Ada", "PERSON", "Ada Lovelace"), (1, 3, "Acme", "ORGANIZATION", "Acme"), (1, 4, "Old", "ORGANIZATION", "H"), (1, 5, "Old Corp", "ORGANIZATION", "Old Corp"), (1, 6, "L.", "PERSON", "A. Lovelace")])
    seed = {"Ada Lovelace": "PERSON_1", "A. Lovelace": "PERSON_1.v_4", "Old Corp": "ORGANIZATION_3", "H": "H_1f"}
    want = {"Jane Smith": "PERSON_2", "Ada": "PERSON_1.v_5", "Acme": "ORGANIZATION_4", "Old": "H_1f.v_1", "L.": "PERSON_3.v_1"}
    for how in ({}, {"hot": True}, {"free": True}):
        assert {r.original: r.written for r in mapping.numbered(e, seed=seed_table(spark, seed), **how).collect()} == want
    again = pipeline.anonymize(docs(spark, "a@b.org, c@d.org, (c@d.org)", "x@y.org"), seed={"c@d.org": "EMAIL_7"})
    assert [r.text for r in again.docs.orderBy("doc_id").collect()] == ["EMAIL_8, EMAIL_7, (EMAIL_7)", "EMAIL_8"]


def broadcast(spark, run):
    """The names of the steps that led to each broadcast of what ``run`` does."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = run()
    bus.waitUntilEmpty(30_000)
    led = []
    for x in (store.executionsList().apply(i).executionId() for i in range(before, store.executionsCount())):
        graph = store.planGraph(x)
        nodes, edges = ([each.apply(i) for i in range(each.size())] for each in (graph.allNodes().toList(), graph.edges().toList()))
        names, children = {n.id(): n.name() for n in nodes}, {}
        for e in edges:
            children.setdefault(e.toId(), []).append(e.fromId())
        for n in names:
            if "BroadcastExchange" in names[n]:
                below = list(children.get(n, []))
                for b in below:
                    below += children.get(b, [])
                led.append({names[b].split(" ")[0] for b in below})
    return out, led


def test_seeds_are_base_forms_without_broadcasts_of_grams(spark, monkeypatch):
    """The longest of the document's forms and the seed's originals counts; the grams are many times what the planner knows of."""
    rng = random.Random(11)
    word = lambda most: "".join(rng.choices("ab1é", k=rng.randint(1, most)))
    rows = [(d, i, t, "A", t) for d in range(20) for i, t in enumerate(dict.fromkeys(word(9) for _ in range(25)), 1)]
    old = {word(14): f"A_{i}" for i in range(60)} | {rows[0][2]: "A_90", "": "A_91"}
    by_doc = {}
    for d, _, t, *_ in rows:
        by_doc.setdefault(d, []).append(t)
    for most in (entities.ROW_ENTITIES, 3):
        monkeypatch.setattr(entities, "ROW_ENTITIES", most)
        got, led = broadcast(spark, lambda: entities.merged_bases(frame(spark, rows), seeds=seed_table(spark, old)).collect())
        assert len(got) == len(rows)
        assert all(r.base_form == min([x for x in [*by_doc[r.doc_id], *old] if x != r.text and r.text in x], key=lambda x: (-len(x), x), default=r.text) for r in got)
        assert not any("Generate" in x for x in led)


def test_masking_after_a_seed_broadcasts_no_maps(spark):
    """Maps of documents are read from staged tables, which look small to the planner; none is sent to the driver."""
    seed = seed_table(spark, {"c@d.org": "EMAIL_7", "xc@d.org": "EMAIL_8"})
    run = lambda: pipeline.anonymize(docs(spark, "a@b.org, c@d.org, (c@d.org)", "x@y.org", None, "none"), seed=seed).docs.orderBy("doc_id").collect()
    got, led = broadcast(spark, run)
    assert [r.text for r in got] == ["EMAIL_9, EMAIL_7, (EMAIL_7)", "EMAIL_9", None, "none"]
    assert not any({"Generate", "ObjectHashAggregate"} & x for x in led)


def test_a_hot_document_is_spread(spark):
    """Numbers of a document with a third of all rows, made in ranges of keys, are those of one window."""
    rows = [(1 if i % 3 == 0 else 2 + i % 40, i, f"t{i}", "AB"[i % 2], f"t{i - i % 5}") for i in range(3000)]
    rows = [(d, i, t, y, b if (int(b[1:]) % 3 == 0) == (d == 1) else t) for d, i, t, y, b in rows]
    a = sorted(map(tuple, mapping.numbered(frame(spark, rows)).collect()))
    assert a == sorted(map(tuple, mapping.numbered(frame(spark, rows), hot=True).collect()))
    many = ranked(frame(spark, rows), ["doc_id"], ["ord"], "n")
    per_range = [r[0] for r in many.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(per_range) < 2000 and many.where("doc_id = 1").agg(F.max("n")).first()[0] == 1000
    by_doc = {}
    for r in many.orderBy("doc_id", "ord").collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + 1
        assert r.n == by_doc[r.doc_id]


def test_dedup_priority_and_place(spark):
    e = entities.finalised(detect.hits(docs(spark, TEXT))).collect()
    by = {r.text: r for r in e}
    assert by["4111 1111 1111 1111"].type == "CREDIT_CARD" and by["10.0.0.1"].type == "IP_ADDRESS" and by["123-45-6789"].type == "SSN_US" and by["2019-06-20"].type == "DATE_ISO"
    assert sorted(r.ord for r in e) == list(range(1, len(e) + 1))


@pytest.mark.parametrize("type_, allowed, ok", [("IBAN_LIKE", ["IBAN"], True), ("DRIVERS_LICENSE_US", ["drivers_license"], True), ("DATE_ISO", ["DATE"], True), ("PERSON", ["PER"], False), ("MAC_ADDRESS", ["ADDRESS"], True), ("NIK_ID", ["ID"], True)])
def test_type_filter(spark, type_, allowed, ok):
    assert spark.createDataFrame([(type_,)], "t string").select(detect.type_allowed(F.col("t"), allowed)).first()[0] == ok


def test_deny_and_keep(spark):
    d = docs(spark, "ACME met acme near Acmeville; jane@acme.org", None, "")
    found = entities.finalised(detect.hits(d), d, deny=["Acme", "", "jane@ACME.org", "none"], keep=["JANE@acme.ORG"], types=["EMAIL"]).collect()
    assert [(r.doc_id, r.text, r.type) for r in found] == [(0, "ACME", "CUSTOM")]


# rewriting


@pytest.mark.parametrize(
    "text, names, want",
    [
        ("John Doe met John.", {"John Doe": "P_1", "John": "P_1.v_1"}, "P_1 met P_1.v_1."), ("Johnson saw John.", {"John": "P_1"}, "Johnson saw P_1."), ("(555) 1 (555)", {"(555)": "N"}, "N 1 N"),
        ("été étéx", {"été": "E"}, "E étéx"), ("aXa Xa", {"Xa": "B", "aXa": "A"}, "A B"), ("aa", {"a": "B"}, "aa"), ("", {"a": "B"}, ""), ("a.b", {"a": "1", "b": "2", ".": "-"}, "1-2"),
    ],
)
def test_rewrite(text, names, want):
    assert spans.rewrite(text, names, names) == want


def test_locate_equals_the_boundary_pattern(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("ab_é .-", k=12)), "".join(rng.choices("ab_é .-\\E", k=rng.randint(1, 3)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, e string")
    got = [r[0] for r in df.select(F.rlike("t", spans.boundary_pattern(F.col("e")))).collect()]
    assert got == [any(True for _ in spans.locate(t, e)) for t, e in rows]


def test_masking_and_back(spark):
    d = docs(spark, TEXT, None, "", "nothing here", TEXT + " \n\n " + TEXT)
    m = pipeline.anonymize(d)
    masked = {r.doc_id: r.text for r in m.docs.collect()}
    assert masked[1] is None and masked[2] == "" and masked[3] == "nothing here" and "jane" not in masked[0] and "EMAIL_1" in masked[0] and "CREDIT_CARD_1" in masked[0]
    back, unknown, unused = pipeline.deanonymize(m.docs, mapping.inverted(m.mapping))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in d.collect()}
    assert unknown.where("label not like '~_%' escape '~'").count() == 0
    assert pipeline.verify(m.docs).where("rewritten").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 1_.é\n", max_size=40), st.lists(st.text(alphabet="ab1é", min_size=1, max_size=4), max_size=6, unique=True))
def test_restoring_undoes_masking(text, names):
    written = {n: f"PERSON_{i}" for i, n in enumerate(names, 1)}
    assert restore.restore(spans.rewrite(text, names, written), {v: k for k, v in written.items()})[0] == text


def test_restore_falls_back_to_the_base():
    text, used = restore.restore("PERSON_1.v_2 and PERSON_12 and PERSON_3, H_ab", {"PERSON_1": "Jane", "PERSON_12": "Bo"})
    assert text == "Jane and Bo and PERSON_3, H_ab" and used == {"PERSON_1.v_2", "PERSON_12"}
    assert restore.restore("x H_ab x", {"H_ab": "secret", "PERSON_1": "J"})[0] == "x secret x"
    assert restore.restore("x", {})[0] == "x"
    # a label may be glued to a letter where its original may
    money = {"CURRENCY_AMOUNT_7": "$4", "PERSON_1": "Jane"}
    assert restore.restore("=$BCURRENCY_AMOUNT_7+1, XPERSON_1", money)[0] == "=$B$4+1, XPERSON_1"


def test_labels_of_restoring(spark):
    masked = docs(spark, "PERSON_1 met PERSON_9 at IPV4_ADDRESS_1, PERSON_2.v_1")
    inverse = spark.createDataFrame([(0, "PERSON_1", "Jane"), (0, "EMAIL_7", "x@y.z"), (0, "PERSON_2.v_1", "B")], "doc_id long, written string, original string")
    out, unknown, unused = pipeline.deanonymize(masked, inverse)
    assert out.first().text.startswith("Jane met PERSON_9")
    assert {r.label for r in unknown.collect()} == {"PERSON_9", "_ADDRESS_1"}
    assert {r.label for r in unused.collect()} == {"EMAIL_7", "PERSON_2.v_1"}
    used = restore.restored(masked, inverse)
    assert {r.label for r in restore.unused_labels(inverse, used, exact=True).collect()} == {"EMAIL_7"}


def test_map_direction_and_collisions(spark):
    pairs = [(1, 1, "PERSON_1", "Jane"), (1, 2, "PERSON_2", "Jane"), (2, 1, "Jane", "PERSON_1"), (2, 2, "Bo", "PERSON_2")]
    got = {(r.doc_id, r.original): r.written for r in mapping.oriented(spark.createDataFrame(pairs, "doc_id long, ord int, key string, value string")).collect()}
    assert got == {(1, "Jane"): "PERSON_1", (2, "Jane"): "PERSON_1", (2, "Bo"): "PERSON_2"}
    m = spark.createDataFrame([(1, 1, "a@b.c", "a***"), (1, 2, "a@d.e", "a***")], "doc_id long, ord int, original string, written string")
    assert mapping.inverted(m).first().original == "a@d.e" and mapping.collisions(m).first().n == 2


def test_operators_in_the_pipeline(spark):
    m = pipeline.anonymize(docs(spark, TEXT), operators={"EMAIL": "mask", "DATE": "generalize", "CREDIT_CARD": "hash"})
    text = m.docs.first().text
    assert "j***@a***.org" in text and "on 2019." in text and "H_" in text


def test_corpus_scope(spark):
    m = pipeline.anonymize(docs(spark, "a@b.org", "c@d.org and a@b.org", "a@b.org"), scope="corpus")
    assert [r.text for r in m.docs.orderBy("doc_id").collect()] == ["EMAIL_1", "EMAIL_2 and EMAIL_1", "EMAIL_1"]


# risk and evaluation


@pytest.mark.parametrize(
    "text, overall, windows",
    [
        ("JOB_TITLE_1 of ORGANIZATION_1 in LOCATION_1", "high", 1), ("INDIRECT_1 left", "high", 1), ("PERSON_1 in LOCATION_1", "medium", 1), ("PERSON_1", "low", 1), ("EMAIL_1", "low", 0), ("PERSON_1 on DATE_ISO_2", "medium", 1),
        ("AGE_1 and DATE_1", "medium", 1), ("AGE_1 and DATE_1\n\nAGE_1 and DATE_1", "low", 2), ("", "low", 0), (None, "low", 0), ("PERSON_1 " + "x " * 900 + "LOCATION_1", "low", 3),
    ],
)
def test_risk(spark, text, overall, windows):
    d = docs(spark, text)
    r = risk.risk_summary(risk.risk_windows(d), d).first()
    assert (r.overall, r.window_count) == (overall, windows)


def test_passages_of_all_documents(spark, tmp_path):
    """Against brute force: nulls, blank lines, trimming, short and long passages."""
    trimmed = lambda x: re.sub(r"^[ \t\n\v\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[ \t\n\v\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+$", "", x)

    def brute(text):
        parts = [trimmed(x) for x in re.split(r"\n[ \t\n\v\f\r]*\n", text or "")]
        cut = [[p] if len(p) <= 800 else [trimmed(p[i : i + 800]) for i in range(0, len(p), 600)] for p in parts]
        return [p for c in cut for p in c if p]

    rows = [(10**9 + i, t) for i, t in enumerate([None, "", " \n\n ", "a", "a\n\nb \n \t\n\u3000c\n", "one\ntwo", "x" * 800, "x" * 801, "é \U0001f600" * 400 + "\n\nend", " " * 900 + "y", "w " * 1000])]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(small).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(r.doc_id, k, p) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() for k, p in enumerate(brute(r.text))}
    got = queries.queries()["risk_passages"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_all_cells_come_back(spark):
    want = {(r.doc_id, r.row, r.col): r.search_text for r in queries._cells(spark, "/root/testdata/sf0.001").collect()}
    got = {(r.doc_id, r.row, r.col): r.search_text for r in queries.queries()["restored_tables"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(v.startswith("=") for v in want.values())


def test_entity_list_risk(spark):
    r = risk.entity_list_risk(frame(spark, [(1, 1, "CEO", "JOB_TITLE", ""), (1, 2, "Acme", "ORGANIZATION", ""), (1, 3, "Rome", "LOCATION", "")])).first()
    assert r.overall == "high" and r.excerpt == "CEO; Acme; Rome"


def test_scores(spark):
    schema = "doc_id long, text string, type string, kind string, start_pos int, end_pos int, base_form string"
    gold = spark.createDataFrame([(1, "Jane", "PERSON", None, 0, 4, None), (1, "Rome", "LOCATION", None, 9, 13, None), (1, "x", "OTHER", None, None, None, None)], schema)
    pred = spark.createDataFrame([(1, "jane ", "EMAIL", "direct", 0, 4, "JANE"), (1, "jane ", "EMAIL", "direct", 0, 4, "JANE"), (1, "Oslo", "LOCATION", None, 1, 5, None)], schema)
    got = {(r.kind, r.level): (r.true_positives, r.predicted, r.gold, round(r.f1, 3)) for r in evaluate.scores(gold, pred).collect()}
    assert got["all", "mention"] == (1, 3, 3, 0.333) and got["direct", "mention"] == (1, 2, 1, 0.667) and got["quasi", "mention"] == (0, 1, 1, 0) and got["direct", "entity"] == (1, 1, 1, 1)
    perfect = evaluate.scores(gold, gold)
    assert {r.f1 for r in perfect.collect()} == {1.0} and evaluate.scores(gold.limit(0), pred.limit(0)).count() == 0


# chunks and tables


def test_chunks(spark):
    text = "First part.\n\nSecond part is longer than the first.\nThird line here. " + "word " * 50
    got = chunking.split_text(text, 60, 15)
    assert all(len(c) <= 60 for c in got) and "".join(text.split()) != "" and got[0] == "First part.\n\nSecond part is longer than the first."[: len(got[0])]
    assert chunking.split_text("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4] or all(len(c) <= 10 for c in chunking.split_text("x" * 25, 10, 3))
    d = chunking.chunks(docs(spark, text, None, "", "  ", "short"), 60, 15)
    assert {r.doc_id for r in d.collect()} == {0, 4} and d.where("doc_id = 0").count() == len(got)
    assert len(chunking.split_text("# A\ntext\n# B\nmore", 10, 0, chunking.MARKDOWN)) == 2
    with pytest.raises(ValueError):
        chunking.split_text("x", 0, 0)


def cells(spark, rows):
    df = spark.createDataFrame([(1, "S", r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v], "doc_id long, sheet string, row int, col int, search_text string")
    return df.withColumn("kind", tables.field_kind(F.col("search_text"))).withColumn("sheet_no", F.lit(1))


def test_tables(spark):
    c = cells(spark, [["Name", "Mail"], ["Jane", "jane@acme.org"], [], ["", "=A1&jane@acme.org"]])
    sheets = spark.createDataFrame([(1, "S", 1, 4, 2)], "doc_id long, sheet string, sheet_no int, max_row int, max_column int")
    assert {r.label for r in tables.header_labels(c, sheets).collect()} == {"Name", "Mail"}
    assert {r.label for r in tables.header_labels(cells(spark, [["Name", "name"]]), sheets).collect()} == {"Col A", "Col B"}
    assert tables.flattened(c, sheets).first().text == "# Sheet: S\n\nName | Mail\n\nJane | jane@acme.org\n\n | \n\n | =A1&jane@acme.org\n\n"
    m = pipeline.anonymize_tables(c)
    got = {(r.row, r.col): r.search_text for r in m.docs.collect()}
    assert got[2, 2] == "EMAIL_1" and got[4, 2].endswith("EMAIL_1") and got[1, 1] == "Name"
    batches = [r.text for r in tables.model_batches(c, tables.header_labels(c, sheets), sheets, 60).collect()]
    assert all(b.startswith("# Sheet: S\n## Row") for b in batches) and any("[S!B2] Mail: jane@acme.org" in b for b in batches)
    found = spark.createDataFrame([(1, "Jane"), (1, "Jan"), (1, "acme")], "doc_id long, text string")
    assert {r.text for r in tables.in_some_cell(found, c).collect()} == {"Jane", "acme"}


def test_a_cells_entity_is_masked_in_every_cell(spark):
    c = cells(spark, [["x 10.0.0.1", "10.0.0.1"], ["a10.0.0.1", "10.0.0.1."]])
    got = {(r.row, r.col): r.search_text for r in pipeline.anonymize_tables(c).docs.collect()}
    assert got == {(1, 1): "x IP_ADDRESS_1", (1, 2): "IP_ADDRESS_1", (2, 1): "a10.0.0.1", (2, 2): "IP_ADDRESS_1."}


def test_residual(spark):
    left = residual.leftovers(docs(spark, "PERSON_1 wrote a@b.org, again a@b.org", None))
    assert {(r.text, r.type) for r in left.collect()} == {("a@b.org", "EMAIL")}


def test_empty_tables(spark):
    none = docs(spark).limit(0) if False else spark.createDataFrame([], "doc_id long, text string")
    assert pipeline.anonymize(none).docs.count() == 0 and pipeline.verify(none).count() == 0 and pipeline.report_risk(none).count() == 0
    assert detect.hits(none, patterns={}).count() == 0 and detect.located_hits(none).count() == 0
    assert detect.hits(docs(spark, "x"), patterns={"OWN": r"\bx\b"}).first().type == "OWN" and P.java(r"\bx\s", "OWN").count("(?") == 5
