"""Results against brute force, exact round trips and hand-made cases."""

import random
import re
import string

import pandas as pd
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from maskweave.llm import addresses, formdup, mixing, names, pieces, sanitise, skeleton, spam, tokens

SF = "/root/testdata/sf0.001"


# 1: look-alike characters


@pytest.mark.parametrize(
    "text, form",
    [
        ("Victοr Quill", "Victor Quill"), ("ＡＤＡ １２", "ADA 12"), ("Ju​rgen", "Jurgen"), ("Jörg", "Jörg"), ("936‐555‑0170", "936-555-0170"),
        ("a b　c", "a b c"), ("\U0001d5d4\U0001d5d5 Oﬃce", "AB Office"), ("В. Quill", "B. Quill"), ("ISTОHOLT", "ISTOHOLT"),
        # genuine foreign words, accents and emoji
        ("Захар Жилинский", None), ("Γιώργος", None), ("Åsa \U0001f468‍\U0001f469‍\U0001f467 \U0001f44d\U0001f3fd", None),
        ("张伟，北京", None), ("می‌خواهم", None), ("", None), ("plain text", None),
    ],
)
def test_form(text, form):
    assert skeleton.form(text) == (text if form is None else form)
    assert skeleton.form(skeleton.form(text)) == skeleton.form(text)


def test_offsets_point_into_the_text():
    text = "A​da Jörg ﬁn"
    plain, at = skeleton.form_with_offsets(text)
    assert plain == "Ada Jörg fin" and len(at) == len(plain) + 1 and at[-1] == len(text)
    assert [text[at[i]] for i in range(4)] == ["A", "d", "a", " "]


def test_equal_skeletons_meet(spark):
    df = spark.createDataFrame([("Ada",), ("Аdа",), ("A​da",), ("Ada",), ("Bob",), (None,)], "text string")
    got = {r.form: (r.originals, r.n_rows) for r in skeleton.groups(df).collect()}
    assert got == {"Ada": (3, 4), "Bob": (1, 1)}


def test_values_of_look_alikes_are_told_by_a_latin_one(spark):
    values = ["\u0420\u0410\u0421\u0415", "PACE", "\u0421\u043e\u0441\u043e", "\u0421\u0410", "Захар", "C\u043eco", "\u03a1\u0391", "P\u200bA", None, "", "12", "J\u00f6rg"]
    df = spark.createDataFrame(list(enumerate(values)), "i long, text string")
    got = {r.i: r.form for r in skeleton.inconsistent(df).collect()}
    # 0 by PACE, 2 by the mixed value 5, 6 by the value 7; no Latin value looks like 3
    assert got == {0: "PACE", 2: "Coco", 5: "Coco", 6: "PA", 7: "PA"}
    assert {r.i for r in skeleton.inconsistent(df.where("i in (0, 2, 3, 4)")).collect()} == set()
    repeated = df.union(df).where("i < 2")
    assert sorted(r.i for r in skeleton.inconsistent(repeated).collect()) == [0, 0]


def test_the_whole_table_of_look_alikes(spark):
    table = skeleton.prototypes(spark)
    same = [("rn", "m"), ("paypal", "paypa1"), ("A", "\u13aa"), ("A", "\ua4ee"), ("o", "\u2c9f"), ("A", "\U000102a0"), ("i", "\u0131"), ("PACE", "\u0420\u0410\u0421\u0415"), ("a b", "a\u00a0b"), ("\u00e9", "e\u0301")]
    assert len(table) > 5000
    for a, b in same:
        assert skeleton.skeleton(a, table) == skeleton.skeleton(b, table), (a, b)
    df = spark.createDataFrame([("paypal",), ("paypa1",), ("Ada",), ("\u13aada",), ("m~1|\"%",)], "text string")
    got = {r.text: (r.form, r.skeleton) for r in skeleton.forms(df).collect()}
    assert all(k == skeleton.skeleton(t, table) for t, (_, k) in got.items())  # expressions give what Python gives
    assert got["\u13aada"][0] == "Ada" and {r.text for r in skeleton.inconsistent(df).collect()} == {"\u13aada"}
    assert {(r.form, r.originals) for r in skeleton.groups(df).collect()} >= {("Ada", 2)}


@pytest.mark.parametrize("error", [TypeError("'JavaPackage' object is not callable"), Py4JError("no answer")])
def test_a_missing_table_of_look_alikes_is_an_error(spark, monkeypatch, error):
    def fails(jvm):
        raise error

    monkeypatch.setattr(skeleton, "_prototypes", fails)
    df = spark.createDataFrame([("\u13aada",), ("Ada",)], "text string")
    for f in (skeleton.prototypes, lambda _: skeleton.inconsistent(df), lambda _: skeleton.groups(df)):
        with pytest.raises(RuntimeError, match="look-alikes"):
            f(spark)


# 2: personal items


def test_items(spark):
    people = spark.createDataFrame([("Ada Quillmere",), ("Jörg Fenwold",), ("Ada Tarnby",)], "name string")
    rows = [
        (1, "rang Ada Quillmere re the move / mail: ada.q+x@post.example.test; cell +44 20 7946 0123"),
        (2, "near Jörg by the window"),
        (3, "emergency contact: Fenwold, Jörg, (555) 555-0142"),
        (4, "id QQ 12 34 56 C checked by Ada. Do not mail to Unit 5, 12 Orchard Street, 54321 Ulmton; use tarnby7 (at) x.test"),
        (5, "works for Quillmere & Fenwold GmbH since 2001-05-06, invoice INV-2020-1234 paid, USD 1,234.50"),
        (6, "A​da Quillmеre wrote"),
    ]
    got = {}
    text = dict(rows)
    for r in sanitise.personal_items(spark.createDataFrame(rows, "i long, text string"), people, ["i"]).collect():
        got.setdefault(r.i, []).append((text[r.i][r.start_pos : r.end_pos], r.pii_type))
    assert sorted(got[1]) == sorted([("Ada Quillmere", "PERSON"), ("ada.q+x@post.example.test", "EMAIL"), ("+44 20 7946 0123", "PHONE")])
    assert got[2] == [("Jörg", "PERSON")]
    assert sorted(got[3]) == sorted([("Fenwold, Jörg", "PERSON"), ("(555) 555-0142", "PHONE")])
    assert sorted(got[4]) == sorted([("QQ 12 34 56 C", "ID"), ("Ada", "PERSON"), ("Unit 5, 12 Orchard Street, 54321 Ulmton", "ADDRESS"), ("tarnby7 (at) x.test", "EMAIL")])
    assert 5 not in got
    assert got[6] == [("A​da Quillmеre", "PERSON")]


def test_placeholders(spark):
    people = spark.createDataFrame([("Ada Quillmere",)], "name string")
    plain = "The meeting began at ten and ended before noon, since nobody had brought the papers that were asked for."
    rows = spark.createDataFrame([(1, "Ada Quillmere met Ada Quillmere, not ada@x.test."), (2, plain)], "i long, text string")
    got = {r.i: r.text for r in sanitise.sanitised(rows, people, ["i"]).collect()}
    assert got == {1: "[PERSON_1] met [PERSON_1], not [EMAIL_1].", 2: plain}


# 3: format duplicates


def test_records_by_brute_force(spark):
    t = pd.read_parquet(f"{SF}/entity_dicts.parquet")
    strip = lambda s: re.sub(r"[\W_]+", "", s.upper().lower())
    first = {}
    want = set()
    for r in t.sort_values("hit_id").itertuples():
        if r.text is None:
            continue
        kind = strip(r.type)
        body = "|".join(sorted(filter(None, map(strip, re.split("[;|]", r.text))))) if kind == "custom" else strip(r.text)
        if (kind, body) in first:
            want.add((first[kind, body], r.hit_id))
        else:
            first[kind, body] = r.hit_id
    assert set(map(tuple, formdup.copies(spark.read.parquet(f"{SF}/entity_dicts.parquet"), "hit_id").collect())) == want


# 5: addresses


def test_buildings(spark):
    streets = [f"{w} Street" for w in ("Orchard", "Beacon", "Mulberry")]
    rows = [(i, f"{i % 40 + 1} {streets[i % 3]}, 5432{i % 3} {('Ulmton', 'Garwick', 'Pellford')[i % 3]}") for i in range(600, 720)]
    same = [(1, "7 Orchrad St., 54320"), (2, "ULMTON, ORCHARD STREET NO. 7, FLAT 3"), (3, "c/o Reception, #7 Orchard - Ulmton"), (4, "7B Orchard Street, Ulmton"), (5, "7 Orchard Lane, Ulmton"), (6, "7 Orchard Street, Garwick")]
    got = {r.sample_id: (r.locality, r.number, r.street, r.kind) for r in addresses.buildings(spark.createDataFrame(rows + same, "sample_id long, address_1 string")).collect()}
    assert got[1] == got[2] == ("ulmton", "7", "orchard", "street")
    assert len({got[4], got[5], got[6], got[1]}) == 4
    assert 3 not in got or got[3][:3] == ("ulmton", "7", "orchard")


def test_every_close_word_is_tried(spark):
    """A frequent word that is not close takes no variant from one that is; chains are followed to their end."""
    counts = spark.createDataFrame([("linden", 50), ("linens", 80), ("linten", 1), ("orchard", 400), ("orchrad", 20), ("orchrda", 2), ("abcdef", 9), ("abcdeg", 9), ("mill", 30), ("hill", 29)], "word string, n long")
    assert dict(map(tuple, addresses._better(counts, [], "word", "n", 4, 4).collect())) == {"linten": "linden", "orchrad": "orchard", "orchrda": "orchard"}
    tied = dict(map(tuple, addresses._better(counts.where("n in (9, 29, 30)"), [], "word", "n", 1, 4).collect()))
    assert tied == {"abcdeg": "abcdef", "hill": "mill"}
    rows = [(i, f"{i % 40 + 1} Linden Street, Ulmton") for i in range(600, 650)] + [(i, f"{i % 40 + 1} Linens Street, Ulmton") for i in range(700, 780)]
    rows += [(1, "90 Linten, Ulmton"), (2, "90 Linden, Ulmton")]  # without a type there is no second chance
    assert (1, 2) in set(map(tuple, addresses.same_building(spark.createDataFrame(rows, "sample_id long, address_1 string")).collect()))


def test_addresses_without_a_type_keep_their_rows(spark):
    """Two types of one street in the block leave an untyped address undecided, but with its equals."""
    rows = [(i, f"{i % 40 + 1} {('Orchard', 'Beacon')[i % 2]} Street, 5432{i % 2} {('Ulmton', 'Garwick')[i % 2]}") for i in range(600, 720)]
    rows += [(1, "7 Orchard Street, Ulmton"), (2, "7 Orchard Lane, Ulmton"), (3, "7 Orchard, Ulmton"), (4, "7 Orchard, Ulmton"), (5, "Ulmton, Orchard 7"), (6, "9 Orchard, Ulmton"), (7, "9 Orchard Street, Ulmton")]
    df = spark.createDataFrame(rows, "sample_id long, address_1 string")
    got = {r.sample_id: (r.locality, r.number, r.street, r.kind) for r in addresses.buildings(df).collect()}
    assert set(got) == {i for i, _ in rows}
    assert got[3] == got[4] == got[5] == ("ulmton", "7", "orchard", "") and got[6] == got[7]
    pairs = {(a, b) for a, b in addresses.same_building(df).collect() if b < 8}
    assert pairs == {(3, 4), (3, 5), (4, 5), (6, 7)}
    assert sorted(r.sample_id for r in addresses.building_classes(df).collect()) == sorted(i for i, _ in rows)


def test_neighbouring_localities_and_units(spark):
    rows = [(i, f"{i % 40 + 1} Orchard Street, 54320 Ulmton") for i in range(600, 680)] + [(i, f"{i % 40 + 1} Beacon Street, 54321 Garwick") for i in range(700, 720)]
    rows += [(1, "90 Orchard Street, 54320 Ulmton"), (2, "90 Orchard Street, 54320 Garwick"), (3, "90 Orchard Street, Garwick"), (4, "90 Orchard Street, 54321 Garwick"), (5, "91 Orchard Street, Ulmton"), (6, "91 Orchard Street, Garwick")]
    df = spark.createDataFrame(rows, "sample_id long, address_1 string")
    pairs = {tuple(p) for p in addresses.same_building(df).collect() if p[1] < 10}
    # 2 gives both; 1 has its postcode, 3 its town
    assert pairs == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    flats = spark.createDataFrame([*rows, (7, "95 Orchard Street, Flat 3, Ulmton"), (8, "Apt 3, 95 Orchard Street, Ulmton"), (9, "95 Orchard Street, Flat 4, Ulmton")], "sample_id long, address_1 string")
    of = lambda **kw: {r.sample_id: (r.locality, r.number, r.street) for r in addresses.buildings(flats, **kw).collect()}
    assert of()[7] == of()[8] == of()[9] and of(units=True)[7] == of(units=True)[8] != of(units=True)[9]


def test_recall_of_the_deletion_index(spark):
    """Against brute force: every pair of words that are one edit or one swap apart is compared."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(4, 7))) for _ in range(400)})
    counts = spark.createDataFrame([(w, 2 * i + 1) for i, w in enumerate(words)], "word string, n long")
    got = dict(map(tuple, addresses._better(counts, [], "word", "n", 1, 4).collect()))

    def close(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and sorted(a) == sorted(b)
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rank = {w: i for i, w in enumerate(words)}
    met = [w for w in words if any(close(w, o) and rank[o] > rank[w] and (len(w) != len(o) or sum(x != y for x, y in zip(w, o)) == 1 or abs([x != y for x, y in zip(w, o)].index(True) - len(w) + 1 + [x != y for x, y in zip(w, o)][::-1].index(True)) == 1) for o in words)]
    assert met and set(met) <= set(got)


def test_addresses_are_joined_without_broadcasts(spark):
    """What is sent to the driver doesn't grow with the input: an exploded deletion index looks small to the planner."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    before = store.executionsCount()
    rows = [(i, f"{i % 40 + 1} Orchard Street, 54320 Ulmton") for i in range(80)] + [(90, "7 Orchrad Street, Ulmton"), (91, "8 Orchard Street, 54320 Garwick")]
    df = spark.createDataFrame(rows, "sample_id long, address_1 string")
    assert addresses.same_building(df).count() > 40 and addresses.building_classes(df).count() == len(rows)
    bus.waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)


# 6: names


@pytest.mark.parametrize(
    "a, b, verdict",
    [
        ("Frederick Morin", "MORIN, Frederick", "full"), ("FrederickMorin", "Frederick Morin", "full"), ("Fred Morin", "Frederick Morin", "full"), ("Frederick Morni", "Frederick Morin", "full"),
        ("F. Morin", "Frederick Morin", "init"), ("F.K. Morin", "Frederick B. Morin", "no"), ("A. Morin", "Frederick Morin", "no"), ("Mr. Morin", "Frederick Morin", "single"), ("Morin's", "Frederick Morin", "single"),
        ("Andrew Morin", "Frederick Morin", "nick"), ("Halcyra Tech Inc.", "Halcyra Technologies Incorporated", "full"), ("The Halcyra Technologies", "Halcyra Technologies AG", "full"),
        ("Halcyra Technologies AG", "Halcyra Technologies GmbH", "no"), ("Halcyra Hospital", "Halcyra Technologies AG", "no"), ("HTA", "Halcyra Technologies AG", "single"), ("Halcyra, Mfg S A", "Halcyra Manufacturing S.A.", "full"),
    ],
)
def test_compare(a, b, verdict):
    assert names.compare(names.parse(a), names.parse(b), {})[0] == verdict


def test_relatives_stay_apart(spark):
    rows = [(i, 1, t, "PERSON", b) for i, (t, b) in enumerate([("Ada Quill", None), ("QUILL Ada", None), ("Bert Quill", None), ("B. Quill", None), ("Ms. Quill", "Ada Quill"), ("Mr. Quill", None), ("Quil, Bert", None)])]
    # other documents, so that the words of this one are as rare as in a corpus
    rng = random.Random(1)
    rows += [(1000 + i, 2 + i, f"{rng.choice(['Ada', 'Bert', 'Cleo', 'Dora'])} {''.join(rng.choices(string.ascii_lowercase, k=7)).title()}", "PERSON", None) for i in range(300)]
    df = spark.createDataFrame(rows, "entity_id long, doc_id long, text string, type string, base_form string")
    assert sorted(map(tuple, names.same_name(df).collect())) == [(0, 1), (0, 4), (1, 4), (2, 3), (2, 6), (3, 6)]


def test_joins_give_what_one_row_gives(spark, monkeypatch):
    rows = [(1, "J. Smith", None), (2, "Smith", None), (3, "Smith's", None), (4, "J.K. Smith", None), (5, "Morin", "Frederik Morin"), (6, "Frederick Morin", None), (7, "Andrew Morin", None), (8, "MORIN, Frederick", None), (9, "Fred Morin", None), (10, "Mr. Morin", None), (11, "HTA", None), (12, "H.T.A.", None), (13, "Ada Smithson", None)]
    df = spark.createDataFrame([(i, 1, t, "PERSON", b) for i, t, b in rows], "entity_id long, doc_id long, text string, type string, base_form string")
    t = spark.read.parquet("/root/testdata/sf0.001/entity_models.parquet")
    one_document = t.withColumn("doc_id", F.col("doc_id") % 3)  # many names in each, so that partial ones fit several
    for x in (df, t, one_document):
        monkeypatch.setattr(names, "ROW_VALUES", 10**6)
        whole = set(map(tuple, names.same_name(x).collect()))
        monkeypatch.setattr(names, "ROW_VALUES", 0)
        assert whole and set(map(tuple, names.same_name(x).collect())) == whole


def test_names_with_numbers_and_long_ones(spark):
    many = "Society of the Friends and Patrons of the Royal Botanical Gardens Library Museum and Theatre Foundation"
    rows = [(1, "Studio 54", "ORG"), (2, "Studio 54 Inc.", "ORGANIZATION"), (3, "Studio 55", "ORG"), (4, many, "ORG"), (5, many.upper(), "ORG"), (6, "12 Orchard Street", None), (7, "ORCHARD STREET 12", "ADDRESS"), (8, "a@studio54.test", "ORG"), (9, "A/S Holmgren", "ORG"), (10, "Holmgren A/S", "COMPANY")]
    df = spark.createDataFrame([(i, 1, t, y, None) for i, t, y in rows], "entity_id long, doc_id long, text string, type string, base_form string")
    assert sorted(map(tuple, names.same_name(df).collect())) == [(1, 2), (4, 5), (9, 10)]
    assert {(r.entity_id, r.class_id, r.n) for r in names.name_groups(df).collect()} >= {(2, 1, 2), (5, 4, 2), (3, 3, 1)}


def test_linkage_merges_the_nearest_first():
    """Average linkage of a component of any size against the plain way of it."""
    rng = random.Random(2)
    for n in (5, 30, 60, 450):
        full = [f"n{i:03}" for i in range(n)]
        sim = {a: {} for a in full}
        for a in full:
            for b in rng.sample(full, min(n, 6)):
                if a < b:
                    sim[a][b] = sim[b][a] = rng.choice([0.2, 0.5, 0.5, 0.7, rng.random()])
        parts = {a: {b: int(c * names.PARTS + 0.5) for b, c in r.items()} for a, r in sim.items()}
        groups = {a: [a] for a in full}
        while True:
            best = min(((-x / (len(groups[a]) * len(groups[b])), a, b) for a, r in parts.items() for b, x in r.items() if a < b), default=(0, "", ""))
            if -best[0] < names.LINKAGE * names.PARTS:
                break
            _, a, b = best
            groups[a] += groups.pop(b)
            for c, x in parts.pop(b).items():
                del parts[c][b]
                if c != a:
                    parts[a][c] = parts[c][a] = parts[a].get(c, 0) + x
        got = names.linkage(full, sim)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in groups.items()}


def test_similar_by_brute_force(spark):
    """Neither way loses a pair that reaches the cosine."""
    import math

    rng = random.Random(7)
    sigs = sorted({f"{''.join(rng.choices('abcd', k=4))} {''.join(rng.choices('abcd', k=5))}|||" for _ in range(80)})
    df = spark.createDataFrame([(1, s) for s in sigs], "doc long, sig string")
    assert {r.sig: sorted(r.g) for r in df.select("sig", names.grams_column(F.col("sig")).alias("g")).collect()} == {s: names.grams(s) for s in sigs}
    g = {s: names.grams(s) for s in sigs}
    count = {}
    for x in g.values():
        for y in x:
            count[y] = count.get(y, 0) + 1
    w = {y: math.log1p(len(sigs) / n) for y, n in count.items()}
    norm = {s: math.sqrt(sum(w[y] ** 2 for y in x)) for s, x in g.items()}
    cos = lambda a, b: sum(w[y] ** 2 for y in set(g[a]) & set(g[b])) / norm[a] / norm[b]
    want = {(a, b) for a in sigs for b in sigs if a < b and cos(a, b) >= 0.3}
    n, counts = names.gram_counts(df)
    assert {(r.a, r.b) for r in names.similar(df, n, counts, 0.3).collect()} == want
    assert {(a, b) for a, b, _ in names.pairs_of(sigs, lambda y: w[y], 0.3)} == want


# 7: pieces


def test_pieces_cover_the_text():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n\n", "x" * rng.randint(1, 60), "é", "👨‍👩‍👧", " "]) for _ in range(rng.randint(1, 400)))
        size = rng.randint(20, 300)
        s = pieces.Size(1, size, rng.randint(0, size // 2))
        got = pieces.spans(text, s)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert b - a <= size and a < c <= b < d
        if s.overlap == 0:
            assert "".join(text[a:b] for a, b in got) == text


def test_an_edit_alters_only_pieces_near_it():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(30_000))
    cut = lambda t: {t[a:b] for a, b in pieces.spans(t, pieces.Size(1, 900, 120))}
    edited = text[:90_000] + "a few words more " + text[90_000:]
    assert len(cut(edited) - cut(text)) <= 4


def test_bad_sizes():
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            pieces.Size(1, size, overlap)


# 8: tokens


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.BYTE_BPE)
    t.encode_special_tokens = True
    extra = [(10**9, "<|endoftext|>  two  \n\n spaces\t's don't 你好 👨‍👩‍👧 "), (10**9 + 1, "x" * 5000), (10**9 + 2, " \n ")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in tokens.encode_corpus(docs).collect()} == want


def test_ids_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


# 9: mixing


def test_budgets_keep_the_total():
    got = mixing.budgets([("a", 0.5, 1), ("b", 0.3, 10), ("c", 0.2, 10), ("none", 0.0, 5)], {"a": 100, "b": 600, "c": 300})
    assert got["a"] == 100 and round(got["b"] + got["c"]) == 900 and round(got["b"] / got["c"], 6) == 1.5


def test_mix_reaches_its_shares(spark):
    docs, targets = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/mix_targets.parquet")
    mixed = mixing.mix(docs, targets).toPandas()
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()}
    by_source = docs.select("doc_id", "source").toPandas().groupby("source").doc_id.apply(list).to_dict()
    for name, t in targets.toPandas().groupby("mix_name"):
        have = {s: sum(sizes[i] for i in by_source.get(s, [])) for s in t.source}
        want = mixing.budgets(list(zip(t.source, t.target_share, t.max_repeats)), have)
        one = mixed[mixed.mix_name == name]
        for s, most in zip(t.source, t.max_repeats):
            got = one[one.source == s]
            longest = max([sizes[i] for i in by_source.get(s, [])], default=0)
            assert abs((got.n_tokens * got.repeats).sum() - want[s]) <= longest / 2 + 1
            assert got.repeats.max() <= most if len(got) else True
            assert got.repeats.max() - got.repeats.min() <= 1 if len(got) else True


def test_ranges_don_t_change_the_mix(spark, monkeypatch):
    docs, targets = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/mix_targets.parquet")
    whole = sorted(map(tuple, mixing.mix(docs, targets).select("mix_name", "doc_id", "repeats").collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(docs, targets).select("mix_name", "doc_id", "repeats").collect())) == whole


# 10: spam


@pytest.mark.parametrize(
    "text, is_spam",
    [
        ("toner refill - label maker - toner refill - toner refill - label maker - toner refill - label maker", True),
        ("#LabelMaker #TonerRefill #VpnDeal #LabelMaker #FaxService #TonerRefill #VpnDeal #BadgeHolder", True),
        ("https://a.test/x\nhttp://b.test/y\nwww.c.test/z\nhttps://d.test/q\nhttps://e.test/r\nhttps://f.test/s", True),
        ("\n".join(f"- [label maker](http://x{i}.test/a)" for i in range(9)), True),
        ("\n".join(f"toner refill Town{c}" for c in "abcdefghij"), True),
        (" ".join(["Our label maker is the best label maker when you need a label maker. Why label maker? Because label maker means cheap label maker!"] * 1), True),
        ("\n".join(f"{10 + i}:1{i} INFO restored access request {3900 + i}, {i} hits" for i in range(9)), False),
        ("This notice explains how names in the intake form are replaced. The notice applies to the form and every copy. " * 4, False),
        ("Name | Phone | Office\n" + "\n".join(f"Person{c} Sur{c}name | +44 20 7946 01{i}2 | Town{c}" for i, c in enumerate("abcdefgh")), False),
        ("We met on Monday and agreed that the lease would be signed before the hearing; see https://a.test/x for the minutes of the meeting.", False),
        ("Glossary\n\nclaim folder: the late scan kept by the pharmacy before the hearing\nseed map: any older copy kept by legal after the audit", False),
    ],
)
def test_spam(text, is_spam):
    find = re.compile(spam._TOKEN, re.I).findall
    assert (spam.unnatural_share(text, find) >= spam.SPAM_SHARE) == is_spam


_TERMS = "toner label binder stapler fax vpn badge holder printer scanner folder ribbon lamp desk chair shelf cable router modem tablet charger battery envelope stamp marker eraser glue tape cutter ruler compass globe atlas poster frame canvas brush palette easel clay".split()
_ITALIAN = "Abbiamo trovato ieri sera alcune vecchie lettere. Mario voleva leggerle subito. Nessuno sapeva dove fossero nate. Forse qualcuno ricorda ancora questo posto. Domani torneremo insieme verso casa."


@pytest.mark.parametrize(
    "text, is_spam",
    [
        *[(sep.join(_TERMS), True) for sep in (" ", ", ", "\n", " | ", " - ", "; ")],
        (", ".join(f"{a}{b}" for a in _TERMS for b in _TERMS), True),  # long and without any word twice
        (", ".join(f"{a} {b}" for a, b in zip(_TERMS, reversed(_TERMS))), True),
        ("This is the list that we keep for you.\n" + ", ".join(_TERMS), True),
        ("\n".join(f"{a} | {b}" for a, b in zip(_TERMS[::2], _TERMS[1::2])), False),  # a table
        ("\n".join(f"{a}: {b}" for a, b in zip(_TERMS[::2], _TERMS[1::2])), False),  # fields
        (_ITALIAN, False),
        (" ".join(_TERMS[:12]), False),  # too short to tell
        ("We asked for a " + " and a ".join(_TERMS) + " in the letter.", False),
    ],
)
def test_lists_of_distinct_words(text, is_spam):
    find = re.compile(spam._TOKEN, re.I).findall
    assert (spam.unnatural_share(text, find) >= spam.SPAM_SHARE) == is_spam


_LINKS = "with our,in the,to all,for your,by any,at its,on no,from this".split(",")


@pytest.mark.parametrize(
    "text, is_spam",
    [
        # the keyword stands at every tenth place, too far for a short gap, and no sentence returns
        (" ".join(f"Cheap label maker refill {_LINKS[i]} {a} {_LINKS[i - 3][:3].strip()} {b} {c}." for i, (a, b, c) in enumerate(zip(_TERMS, _TERMS[10:], _TERMS[20:28]))), True),
        ("\n".join(f"{i}. {a.title()} {b.title()}: Page 285 is blank except for a stamp from Quarmere Foundation Corporation." for i, (a, b) in enumerate(zip(_TERMS[:9], _TERMS[9:]))), False),
        ("\n".join(f"Room {i} in the {a} wing is closed for cleaning on {b}." for i, (a, b) in enumerate(zip(_TERMS[:9], _TERMS[9:]))), False),
    ],
)
def test_words_at_regular_distances(text, is_spam):
    find = re.compile(spam._TOKEN, re.I).findall
    assert (spam.unnatural_share(text, find) >= spam.SPAM_SHARE) == is_spam


def test_queries_have_their_columns(spark):
    from maskweave.llm import queries

    want = {
        "p1_found": ["tbl", "row_id"], "p2_found": ["tbl", "row_id", "start_pos", "end_pos", "pii_type"], "p3_found": ["first_id", "copy_id"], "p5_found": ["sample_id_a", "sample_id_b"],
        "p6_found": ["entity_id_a", "entity_id_b"], "p7_found": ["doc_id", "config_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    q = queries.queries()
    for name, columns in want.items():
        df = q[name](spark, SF)
        assert df.columns == columns and df.agg(F.count("*")).first()[0] >= 0
    assert set(queries.oracle_sql()) <= set(q)
