"""Files, maps under a passphrase, the model's seam, streams, rejected rows, the command line."""

import json
import os
import stat

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from maskweave import config, crypto, model
from maskweave.operators import rejects
from maskweave.plans import pipeline
from maskweave.sources import files, sinks, xlsx
from maskweave.streaming import live

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the stub client
CSV = 'Name,Email,Note\r\nJane,jane@acme.org,"line one\nline two"\r\n\r\n,,=A1\r\nBo,"b,o@acme.org",+15551234567,extra\r\n'


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    cells, sheets = files.read_tables(spark, str(tmp_path / "a.csv"))
    one = sheets.first()
    assert (one.row_widths, one.had_bom, one.line_end, one.max_column) == ([3, 3, 0, 3, 4], True, "\r\n", 4)
    assert {r.kind for r in cells.where("search_text like '=%'").collect()} == {"formula"}
    out = bytes(sinks.csv_files(cells, sheets).first().content).decode("utf-8-sig")
    assert out == CSV.replace("=A1", "'=A1")
    masked = pipeline.anonymize_tables(cells)
    text = bytes(sinks.csv_files(masked.docs, sheets).first().content).decode("utf-8-sig")
    assert "jane@acme.org" not in text and "EMAIL_1" in text
    with pytest.raises(ValueError):
        sinks.guarded_rewrite(cells, masked.entities.limit(0), masked.mapping)


def raw_files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_dialects_and_encodings(spark):
    contents = [b"a;b\nc;d\n", "n,\u00e9\r\n".encode("cp1252"), b"n,\x81\r", "\ufeffa|b\nc|d".encode(), "\u20ac,x\n".encode("cp1252"), b"", b"  "]
    cells, sheets = files.csv_tables(raw_files(spark, *contents))
    got = {r.doc_id: (r.delimiter, r.encoding, r.had_bom, r.line_end, r.max_row) for r in sheets.collect()}
    assert [got[f"f{i}"] for i in range(7)] == [
        (";", "utf-8", False, "\n", 2), (",", "cp1252", False, "\r\n", 1), (",", "latin-1", False, "\r", 1), ("|", "utf-8-sig", True, "\n", 2), (",", "cp1252", False, "\n", 1), (",", "utf-8", False, "\n", 0), (",", "utf-8", False, "\n", 1),
    ]
    texts = {(r.doc_id, r.col): r.search_text for r in cells.where("row = 1").collect()}
    assert texts["f1", 2] == "\u00e9" and texts["f2", 2] == "\x81" and texts["f3", 1] == "a" and texts["f4", 1] == "\u20ac"
    for bad in ("a.xls", "b.XLSM", "c.ods", "d.xlsb"):
        with pytest.raises(ValueError):
            files.check_path(bad)


def test_size_limits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(CSV.encode())
    monkeypatch.setattr(files, "MAX_TABLE_CELLS", 3)
    with pytest.raises(ValueError):
        files.read_tables(spark, str(tmp_path / "a.csv"))
    monkeypatch.setattr(files, "MAX_TABLE_BYTES", 10)
    with pytest.raises(ValueError):
        files.read_tables(spark, str(tmp_path / "a.csv"))


def test_shown_values():
    from datetime import date, datetime, time

    values = [None, "", True, 3, 3.0, 2.5, 1e16, 1234567.25, "x", date(2020, 1, 2), datetime(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5, 6), time(3, 4)]
    assert [xlsx.shown(v) for v in values] == [
        ("", "empty"), ("", "empty"), ("", "bool"), ("3", "number"), ("3", "number"), ("2.5", "number"), ("1e+16", "number"), ("1.23457e+06", "number"), ("x", "text"),
        ("2020-01-02", "date"), ("2020-01-02", "date"), ("2020-01-02 03:04:05", "date"), ("03:04:00", "date"),
    ]


def test_workbooks(spark, tmp_path):
    book = xlsx.workbook({"A&B": [["Name", "=SUM(A1)", 3, 2.5, True, None], [None, "jane@acme.org"]], "T": [["jane@acme.org", "bo@acme.org"]]})
    (tmp_path / "b.xlsx").write_bytes(book)
    cells, sheets = files.read_tables(spark, str(tmp_path / "b.xlsx"))
    assert {(r.sheet, r.max_row, r.max_column, r.uncached, r.hidden) for r in sheets.collect()} == {("A&B", 2, 5, 1, False), ("T", 1, 2, 0, False)}
    m = pipeline.anonymize_tables(cells)
    source = spark.read.format("binaryFile").load(str(tmp_path / "b.xlsx")).select("path", "content")
    out = bytes(sinks.xlsx_files(m.docs, source).first().content)
    (tmp_path / "c.xlsx").write_bytes(out)
    got = {(r.sheet, r.row, r.col): (r.search_text, r.kind) for r in files.read_tables(spark, str(tmp_path / "c.xlsx"))[0].collect()}
    assert got == {("A&B", 1, 1): ("Name", "text"), ("A&B", 1, 3): ("3", "number"), ("A&B", 1, 4): ("2.5", "number"), ("A&B", 1, 5): ("", "bool"), ("A&B", 2, 2): ("EMAIL_1", "text"), ("T", 1, 1): ("EMAIL_1", "text"), ("T", 1, 2): ("EMAIL_2", "text")}
    assert xlsx.moment(43831.0, False).isoformat() == "2020-01-01T00:00:00" and xlsx.moment(0.5, False).isoformat() == "12:00:00" and xlsx.column_number("AA") == 27


def test_documents_and_phrases(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_bytes("# caf\xe9".encode("latin-1"))
    got = {os.path.basename(r.path): (r.kind, r.text) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "héllo"), "b.md": ("markdown", "# café")}
    (tmp_path / "list.txt").write_text(" Acme \n\n# note\nBo\n")
    assert files.read_phrases(str(tmp_path / "list.txt")) == ["Acme", "Bo"]
    with pytest.raises(ImportError):
        files.read_pdf(spark, str(tmp_path))


def test_private_files(tmp_path):
    sinks.write_private_json(f"{tmp_path}/deep/x.json", {"é": 1})
    assert stat.S_IMODE(os.stat(f"{tmp_path}/deep/x.json").st_mode) == 0o600 and stat.S_IMODE(os.stat(f"{tmp_path}/deep").st_mode) == 0o700
    assert json.loads(open(f"{tmp_path}/deep/x.json").read()) == {"é": 1} and os.listdir(f"{tmp_path}/deep") == ["x.json"]
    assert sinks.save_map(str(tmp_path), "a", {}, keep=False) == ""


def test_encrypted_maps(spark, tmp_path):
    sha = "a" * 64
    path = sinks.save_map(str(tmp_path), "a", {"PERSON_1": "Zoë"}, "secret", sha)
    assert path.endswith(".mapping.json.enc") and files.read_map(path, "secret", sha) == {"PERSON_1": "Zoë"}
    data = json.loads(open(path).read())
    for wrong in ({"passphrase": "other"}, {"source_sha256": "b" * 64}):
        with pytest.raises(ValueError):
            files.read_map(path, **({"passphrase": "secret"} | wrong))
    for change in ({"ciphertext": data["ciphertext"][:-8] + "AAAAAAA="}, {"v": 1}, {"kdf": "md5"}, {"cipher": "none"}, {"salt": ""}, {"kdf_params": {"n": 2**30, "r": 8, "p": 1}}, {"aad": {"source_sha256": "b" * 64, "schema_version": 1}}, {"aad": None}, {"nonce": "!"}):
        with pytest.raises(ValueError):
            crypto.decrypt(data | change, "secret")
    with pytest.raises(ValueError):
        crypto.decrypt(data, "")
    assert not crypto.is_envelope({"PERSON_1": "x"})


class Stub:
    """Finds capitalised words; fails on the first tries if told to."""

    def __init__(self, failures=0, error="503"):
        self.left, self.error, self.calls = failures, error, 0

    def complete(self, prompt):
        import re

        self.calls += 1
        if self.left:
            self.left -= 1
            raise RuntimeError(self.error)
        found = re.findall(r"\b(?:Jane|Doe)(?: Doe)?\b", prompt.split("Text:")[-1])
        return "```json\n" + json.dumps({"entities": [{"text": t, "type": "person", "base_form": "Jane Doe"} for t in found]}) + "\n```"


def test_asking(spark):
    waits = []
    assert model.ask(Stub(2), "Text:\nJane", 3, 1.0, 1.5, waits.append)[0]["type"] == "PERSON"
    assert len(waits) == 2 and 1.0 <= waits[0] <= 1.1 and 1.5 <= waits[1] <= 1.65
    denied = Stub(5, "401 unauthorized")
    assert model.ask(denied, "x", 3, sleep=waits.append) is None and denied.calls == 1
    assert model.ask(Stub(5), "x", 2, sleep=lambda s: None) is None
    for bad in ("no json", "[]", '{"entities": [{"text": 1, "type": "x"}]}'):
        with pytest.raises(ValueError):
            model.parse_answer(bad)
    assert [model.classify(RuntimeError(e))[1] for e in ("429", "502", "timeout", "api key", "?")] == ["RATE_LIMIT_ERROR", "SERVER_ERROR", "CONNECTION_ERROR", "AUTHENTICATION_ERROR", "GENERIC_ERROR"]


def test_model_hits_and_cache(spark):
    c = spark.createDataFrame([(1, 0, "Jane Doe met Jane {x}"), (2, 0, "Jane Doe met Jane {x}"), (3, 0, "nobody")], "doc_id long, chunk_idx int, text string")
    hits, new = model.model_hits(c, Stub())
    assert hits.where("doc_id = 1").count() == 2 and new.count() == 2
    known = spark.createDataFrame(new.collect(), new.schema)
    assert model.model_hits(c, Stub(), cache=known)[1].count() == 0
    # a failed prompt gives no cache row
    assert model.model_hits(c, Stub(9), retries=1)[1].count() == 0
    flaky = model.PatternClient("(Jane)(?: Doe)?", failing=9)
    assert model.model_hits(c, flaky, retries=2, base_delay=0)[0].where("doc_id = 1").count() == 2
    d = spark.createDataFrame([(1, "Jane Doe met Doe, jane@x.org")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pipeline.anonymize(d, config.profile("best-speed"))
    m = pipeline.anonymize(d, config.profile("best-speed"), client=Stub())
    assert m.docs.first().text == "PERSON_1 met PERSON_1.v_1, EMAIL_1"


def test_residual_model(spark):
    from maskweave.operators import residual

    d = spark.createDataFrame([(1, "PERSON_1 and Jane"), (2, None)], "doc_id long, text string")
    left = residual.model_leftovers(d, Stub())
    assert [(r.doc_id, r.text, r.type) for r in left.collect()] == [(1, "Jane", "PERSON")]
    assert {r.doc_id: r.residual_count for r in residual.leftover_report(d, residual.leftovers(d), model_found=left).collect()} == {1: 1, 2: 0}


def test_config():
    assert config.profile("regex-only").use_model is False and config.profile("best-cost", chunk_size=5).chunk_size == 5
    assert config.resolve_model("openai/gpt-4o") == ("openrouter", "openai/gpt-4o") and config.resolve_model("ollama/x:1") == ("ollama", "x:1")
    for bad in ("x", "nobody/x"):
        with pytest.raises(ValueError):
            config.resolve_model(bad)
    with pytest.raises(ValueError):
        config.profile("none")
    types, ops = config.entity_profile("hipaa-safe-harbor", {"DATE": "shift"})
    assert len(types) == 31 and ops["DATE"] == "shift" and ops["AGE"] == "generalize"


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a@b.org", "2020-01-01 10:10:00"), (2, "10.0.0.1 a@b.org", "2020-01-01 10:20:00"), (3, None, "2020-01-01 12:00:00")], "doc_id long, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("at")).write.parquet(src)
    stream = lambda: spark.readStream.schema("doc_id long, text string, at timestamp").parquet(src)
    live.mask_stream(stream().select("doc_id", "text"), out, f"{tmp_path}/ck", {"EMAIL": "mask"}).awaitTermination()
    got = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    assert got[1] == "a***@b***.org" and got[2].startswith("H_") and got[3] is None
    q = live.hit_counts_stream(stream(), "at").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.type, r.hits) for r in spark.sql("select type, hits from counts where type = 'EMAIL'").collect()} == {("EMAIL", 2)}


def raw(spark, rows):
    return spark.createDataFrame(rows, "record_id long, sheet_id long, row_no int, raw string")


def test_rejected_rows(spark):
    sheets = spark.createDataFrame([(1, ",", "x"), (2, ";", "x"), (2, ";", "x"), (3, None, "x")], "sheet_id long, delimiter string, raw string")
    good = 'Jane,j@x.org,123-45-6789,+1 (555) 123-4567,"two\nlines, ""quoted""",Rome,007,"=A1&""; x""",=SUM(A1:B2),'
    rows = [
        (1, 1, 1, "name,EMAIL,SSN,Phone,Notes,City,ID,Formula,Concat,Empty"), (2, 1, 2, good), (3, 1, 3, ""), (4, 1, 4, None), (5, 1, 5, ",,,,,,,,,"), (6, 2, 1, "Bo;;;;;;;;;"), (7, 3, 1, "Bo,,,,,,,,,"), (8, 9, 1, "Bo,,,,,,,,,"),
        (9, 1, 6, "a,b"), (10, 1, 7, '"Bo" x,,,,,,,,,'), (11, 1, 8, '"Bo,,,,,,,,,'), (12, 1, 9, "Bo,no mail,,,,,,,,"), (13, 1, 10, "Bo,,12-345-6789,,,,,,,"), (14, 1, 11, "Bo,,,12,,,,,,"), (15, 1, 12, "Bo,,,,,,0x7,,,"),
        (16, 1, 13, "Bo,,,,,,,=A0,,"), (17, 1, 14, "Bo,,,,,,,,A1,"), (18, 1, 15, "Bo,,,,,,,,,x"), (19, 1, 16, "Bo\nx,,,,,,,,,"), (2, 1, 2, good), (20, None, None, "Bo,,,,,,,,,"), (9, 1, 6, "a,b"),
        (21, 1, 17, "B" * 500_000 + ",,,,,,,,,"), (22, 2, 2, "Bo,,,,,,,,,"),
    ]
    df = raw(spark, rows).withColumn("_fields", F.lit("clash")).withColumn("delimiter", F.lit("|"))
    got = sorted((r.record_id, r.reason) for r in rejects.rejected(df, sheets).collect())
    assert got == [(9, "width"), (9, "width"), (10, "quoting"), (11, "quoting"), (12, "email"), (13, "ssn"), (14, "phone"), (15, "id"), (16, "formula"), (17, "concat"), (18, "empty_col"), (19, "quoting"), (22, "width")]
    loaded = {r.record_id: r for r in rejects.load_valid(df, sheets).collect()}
    assert set(loaded) == {2, 6, 7, 8, 20, 21} and loaded[2].notes == 'two\nlines, "quoted"' and loaded[2].formula == '=A1&"; x"' and loaded[2].id == "007"
    assert rejects.rejected(df.limit(0), sheets).count() == 0 and rejects.load_valid(df, sheets.limit(0)).count() > 0


def test_rejected_rows_by_the_csv_module(spark):
    import csv
    import io
    import re

    from maskweave.functions.formulas import expression_ok

    sf = "/root/testdata/sf0.01"
    r, s = spark.read.parquet(f"{sf}/people_raw.parquet"), spark.read.parquet(f"{sf}/sheets.parquet")
    delimiters = {x.sheet_id: x.delimiter for x in s.collect()}

    def valid(x):
        try:
            rows = list(csv.reader(io.StringIO(x.raw or "", newline=""), delimiter=delimiters.get(x.sheet_id) or ",", strict=True))
        except csv.Error:
            return False
        if not rows or not any(rows[0]) or rows[0][0] == "Name":
            return True
        f = rows[0]
        checks = ((1, r"[^@\s]+@[^@\s]+\.[A-Za-z]+"), (2, r"\d{3}-\d\d-\d{4}"), (3, r"(?=(?:\D*\d){7})[\d +().-]+"), (6, r"\d+"))
        return len(rows) == 1 and len(f) == 10 and all(not f[i] or re.fullmatch(p, f[i]) for i, p in checks) and not f[9] and all(not v or expression_ok(v) for v in f[7:9])

    want = {x.record_id for x in r.collect() if not valid(x)}
    assert {x.record_id for x in rejects.rejected(r, s).collect()} == want and want


def clients_convert(content):
    return content.decode()


def test_command_line(spark, tmp_path):
    from maskweave import cli

    (tmp_path / "note.txt").write_text("Mail jane@acme.org on 2019-06-20.")
    (tmp_path / "more.txt").write_text("bo@acme.org, not jane@acme.org")
    out = str(tmp_path / "out")
    assert cli.main(["run", str(tmp_path / "note.txt"), str(tmp_path / "more.txt"), "--out", out, "--operator", "DATE=generalize"]) == 0
    assert open(f"{out}/anonymized/note.anonymized.txt").read() == "Mail EMAIL_1 on 2019."
    assert open(f"{out}/anonymized/more.anonymized.txt").read() == "EMAIL_2, not EMAIL_1"  # numbers go on from file to file
    paths = [f"{out}/anonymized/{x}.anonymized.txt" for x in ("note", "more")]
    assert cli.main(["deanonymize", *paths, "--mapping", f"{out}/mappings/more.mapping.json", "--out", out]) == 0
    assert open(f"{out}/deanonymized/note.deanonymized.txt").read() == "Mail jane@acme.org on 2019-06-20."
    assert open(f"{out}/deanonymized/more.deanonymized.txt").read() == "bo@acme.org, not jane@acme.org"
    assert cli.main(["verify", paths[0], "--out", out]) == 0 and cli.main(["report", paths[0], "--out", out]) == 0
    assert json.load(open(f"{out}/stats/note.risk.json"))["overall"] == "low"
    assert cli.main(["run", str(tmp_path / "x.xls"), "--out", out]) == 1 and cli.main(["run", str(tmp_path / "note.txt"), "--operator", "A=b"]) == 1


def test_command_line_tables(spark, tmp_path):
    from maskweave import cli

    out = str(tmp_path / "out")
    (tmp_path / "t.csv").write_bytes(CSV.encode())
    assert cli.main(["run", str(tmp_path / "t.csv"), "--out", out, "--passphrase", "p"]) == 0
    assert cli.main(["deanonymize", f"{out}/anonymized/t.anonymized.csv", "--mapping", f"{out}/mappings/t.mapping.json.enc", "--out", out, "--passphrase", "p"]) == 0
    assert open(f"{out}/deanonymized/t.deanonymized.csv", newline="").read() == CSV
    (tmp_path / "b.xlsx").write_bytes(xlsx.workbook({"S": [["Mail"], ["jane@acme.org"], [7]]}))
    assert cli.main(["run", str(tmp_path / "b.xlsx"), "--out", out]) == 0
    assert cli.main(["deanonymize", f"{out}/anonymized/b.anonymized.xlsx", "--mapping", f"{out}/mappings/b.mapping.json", "--out", out]) == 0
    back = xlsx.sheets(open(f"{out}/deanonymized/b.deanonymized.xlsx", "rb").read())[0]
    assert [c[2] for c in back.cells] == ["Mail", "jane@acme.org", "7"]


def test_command_line_models_and_pdf(spark, tmp_path):
    from maskweave import cli

    out = str(tmp_path / "out")
    (tmp_path / "a.txt").write_text("Jane Doe met Jane.")
    assert cli.main(["run", str(tmp_path / "a.txt"), "--out", out, "--profile", "best-quality"]) == 1  # no client
    module = __name__
    assert cli.main(["run", str(tmp_path / "a.txt"), "--out", out, "--profile", "best-quality", "--client", f"{module}:Stub", "--answers", f"{out}/answers"]) == 0
    assert open(f"{out}/anonymized/a.anonymized.txt").read() == "PERSON_1 met PERSON_1.v_1."
    assert files.read_answers(spark, f"{out}/answers").count() == 1
    assert cli.main(["verify", str(tmp_path / "a.txt"), "--out", out, "--client", f"{module}:Stub"]) == 0
    assert json.load(open(f"{out}/stats/a.residual_pii.json"))["residual_count"] == 2
    (tmp_path / "p.pdf").write_bytes(b"by jane@acme.org")
    assert cli.main(["run", str(tmp_path / "p.pdf"), "--out", out]) == 1  # no converter
    assert cli.main(["run", str(tmp_path / "p.pdf"), "--out", out, "--pdf-converter", f"{module}:clients_convert"]) == 0
    assert open(f"{out}/anonymized/p.anonymized.md").read() == "by EMAIL_1"
