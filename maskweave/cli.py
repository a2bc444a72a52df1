"""Command line: run, deanonymize, verify, report.

Single files are written for people here, so each file's result comes to the
driver.  For collections, use ``maskweave.plans.pipeline`` on tables.
"""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave import config as C
from maskweave import crypto
from maskweave.functions.writing import parse_specs
from maskweave.operators import mapping
from maskweave.plans import pipeline
from maskweave.session import staged
from maskweave.sources import files, sinks


def _stem(path: str) -> str:
    name = Path(path).name
    return name.split(".anonymized")[0] if ".anonymized" in name else Path(path).stem


def _named(spec: str | None) -> object | None:
    """The object ``package.module:name`` (called, if it is a class)."""
    if not spec:
        return None
    module, colon, name = spec.partition(":")
    if not colon:
        raise ValueError(f"{spec!r} is not package.module:name")
    found = getattr(importlib.import_module(module), name, None)
    if found is None:
        raise ValueError(f"{module} has no {name}")
    return found() if isinstance(found, type) else found


def _seed(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The seed map as (original, written), whichever way round its file has it."""
    if not a.seed:
        return None
    pairs = [(0, i, k, v) for i, (k, v) in enumerate(files.read_map(a.seed, a.passphrase).items())]
    return mapping.oriented(spark.createDataFrame(pairs, "doc_id int, ord int, key string, value string")).select("original", "written")


def _grown(seed: DataFrame | None, mapped: DataFrame) -> DataFrame:
    """What the next file goes on from: the seed and this file's map."""
    new = mapped.select("original", "written")
    return staged(new if seed is None else seed.unionByName(new), "next-seed")


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    operators = parse_specs(a.operator)
    types, operators = C.entity_profile(a.entity_profile, operators)
    if a.types:
        types = files.read_phrases(a.types, comments=False)
    keep = files.read_phrases(a.keep_list) if a.keep_list else None
    deny = files.read_phrases(a.deny_list) if a.deny_list else None
    config, client, seed = C.profile(a.profile), _named(a.client), _seed(spark, a)
    if config.use_model and client is None:
        raise ValueError(f"the profile {a.profile} asks for a model: name a client with --client package.module:name, or choose --profile regex-only")
    common = {"config": config, "countries": a.country, "types": types, "operators": operators, "secret": a.secret, "keep": keep, "deny": deny, "client": client}
    for path in a.paths:
        files.check_path(path)
    for path in a.paths:
        cache = files.read_answers(spark, a.answers) if a.answers else None
        target = f"{a.out}/anonymized/{_stem(path)}.anonymized"
        if files.is_table(path):
            cells, sheets = files.read_tables(spark, path)
            done = pipeline.anonymize_tables(cells, seed=seed, sheets=sheets, cache=cache, **common)
            if files.suffix(path) == ".xlsx":
                source = spark.read.format("binaryFile").load(path).select("path", "content")
                written = sinks.xlsx_files(done.docs.withColumn("shown", F.lit(None).cast("string")), source)
            else:
                written = sinks.csv_files(done.docs, sheets)
            for row in written.collect():  # one file
                sinks.write_private(target + files.suffix(path), bytes(row.content))
            sha = sheets.select("source_sha256").first()[0]
        else:
            docs = files.read_any(spark, path, _named(a.pdf_converter))
            done = pipeline.anonymize(docs, seed=seed, cache=cache, **common)
            ending = ".md" if files.suffix(path) == ".pdf" else Path(path).suffix
            for row in done.docs.select("text").collect():  # one file
                sinks.write_private(target + ending, (row.text or "").encode())
            sha = docs.select("source_sha256").first()[0]
        if a.answers and done.answers is not None:
            sinks.save_answers(done.answers, a.answers)
        seed = _grown(seed, done.mapping)  # the next file goes on with these numbers
        back = {r.written: r.original for r in mapping.inverted(seed.withColumn("doc_id", F.lit(0)).withColumn("ord", F.monotonically_increasing_id())).collect()}  # the map of the files so far
        where = sinks.save_map(f"{a.out}/mappings", _stem(path), back, crypto.passphrase(a.passphrase), sha, keep=not a.ephemeral)
        print(json.dumps({"path": path, "entities": len(back), "mapping": where}))
    return 0


def deanonymize(spark: SparkSession, a: argparse.Namespace) -> int:
    back = files.read_map(a.mapping, a.passphrase, a.source_sha256)
    # a map of either direction serves; of several written forms of an original each is restored
    by_label = mapping.oriented(spark.createDataFrame([(0, i, k, v) for i, (k, v) in enumerate(back.items())], "doc_id int, ord int, key string, value string"))
    labels = {r.written for r in by_label.collect()}
    back = back if labels & set(back) or not back else {v: k for k, v in back.items()}
    for path in a.paths:
        stem, ending = _stem(path), Path(path).suffix
        text = files.read_review_text(spark, path)
        doc = text.select("doc_id").first()[0]
        inverse = spark.createDataFrame([(doc, k, v) for k, v in back.items()], "doc_id string, written string, original string")
        out, unknown, unused = pipeline.deanonymize(text, inverse)
        if files.is_table(path):
            cells, sheets = files.read_tables(spark, path)
            whole = pipeline.deanonymize_tables(cells, inverse)
            if files.suffix(path) == ".xlsx":
                written = sinks.xlsx_files(whole, spark.read.format("binaryFile").load(path).select("path", "content"))
            else:
                written = sinks.csv_files(whole.withColumn("kind", F.lit("text")), sheets)
            content = bytes(written.first().content)  # one file
        else:
            content = (out.first().text or "").encode()
        sinks.write_private(f"{a.out}/deanonymized/{stem}.deanonymized{ending}", content)
        sinks.write_private_json(f"{a.out}/stats/{stem}.deanonymization_stat.json", {"unused_mappings": sorted(r.label for r in unused.collect()), "not_found_mappings": sorted(r.label for r in unknown.collect())})
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    for path in a.paths:
        for r in pipeline.verify(files.read_review_text(spark, path), countries=a.country, client=_named(a.client)).collect():  # one file
            sinks.write_private_json(f"{a.out}/stats/{_stem(path)}.residual_pii.json", r.asDict(recursive=True))
            print(json.dumps({"path": path, "residual_count": r.residual_count}))
    return 0


def report(spark: SparkSession, a: argparse.Namespace) -> int:
    for path in a.paths:
        for r in pipeline.report_risk(files.read_review_text(spark, path)).collect():  # one file
            sinks.write_private_json(f"{a.out}/stats/{_stem(path)}.risk.json", r.asDict(recursive=True))
            print(json.dumps({"path": path, "overall": r.overall}))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="maskweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in (("run", run), ("deanonymize", deanonymize), ("verify", verify), ("report", report)):
        s = sub.add_parser(name)
        s.set_defaults(go=f)
        s.add_argument("paths", nargs="+")
        s.add_argument("--out", default="data")
        s.add_argument("--country", action="append")
        s.add_argument("--passphrase")
        if name in ("run", "verify"):
            s.add_argument("--client", help="package.module:name of a model's client")
        if name == "run":
            s.add_argument("--profile", default="regex-only", choices=list(C.PROFILES))
            s.add_argument("--entity-profile", choices=list(C.ENTITY_PROFILES))
            s.add_argument("--operator", action="append")
            for x in ("types", "keep-list", "deny-list", "seed"):
                s.add_argument(f"--{x}")
            s.add_argument("--answers", help="folder of a model's earlier answers")
            s.add_argument("--pdf-converter", help="package.module:name of a function from a PDF's bytes to Markdown")
            s.add_argument("--secret", default="")
            s.add_argument("--ephemeral", action="store_true")
        if name == "deanonymize":
            s.add_argument("--mapping", required=True)
            s.add_argument("--source-sha256")
    a = p.parse_args(argv)
    try:
        return a.go(SparkSession.builder.getOrCreate(), a)
    except (ValueError, ImportError, FileNotFoundError) as e:
        print(f"error: {e}")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
