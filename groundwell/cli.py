"""Command line: python -m groundwell <command>.

Everything lives under one data folder: raw/ (documents), manifest.yaml, chunks/, index/,
eval.yaml, calibration.json, users/ and history/.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from .config import Settings, write_calibration
from .functions.keys import iso_millis
from .operators import accounts, manifest
from .plans import answer, evaluate, index
from .plans.ingest import CorpusNotClean, ingest
from .schemas import TURN, USER
from .session import build_session, cut_lineage
from .sources import files
from .sources.digests import read_digests
from .sources.memo import Memory


def _show(rows) -> None:
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def _settings(data: Path) -> Settings:
    return Settings().calibrated(data / "calibration.json")


def _memory(spark, data: Path, settings: Settings) -> Memory:
    return Memory.at(spark, str(data / "memory"), settings)


def _index(spark, data: Path, providers) -> answer.Index:
    stored = spark.read.parquet(str(data / "index"))
    passages = stored.drop("vector")
    built = answer.build_index(passages, providers)
    return answer.Index(passages, built.corpus, stored)


def corpus(spark, args, data):
    if args.action == "scan":
        found = files.scan_folder(spark, str(data / "raw"))
        files.write_manifest(found, str(data / "manifest.yaml"))
        _show(found.select("doc_id", "title", "filename"))
        return 0
    listed = files.read_manifest(spark, str(data / "manifest.yaml"))
    statuses = manifest.diff(listed, read_digests(spark, str(data / "raw")))
    _show(statuses.orderBy("status", "filename"))
    return 0 if manifest.diff_summary(statuses).first()["clean"] else 1


def run_ingest(spark, args, data):
    listed = files.read_manifest(spark, str(data / "manifest.yaml"))
    texts = files.read_texts(spark, str(data / "raw"))
    lines = data / "lines"
    try:
        done = ingest(
            listed, texts, spark.read.parquet(str(lines)) if lines.exists() else None, strict=not args.no_strict
        )
    except CorpusNotClean as problem:
        print(problem, file=sys.stderr)
        return 1
    files.write_chunks(done.chunks, str(data / "chunks"))
    _show(done.report)
    _show(done.skipped)
    return 0


def run_index(spark, args, data):
    providers = answer.Providers()
    chunks = files.read_chunks(spark, str(data / "chunks")).drop("ord")
    settings = _settings(data)
    inserted = index.build(chunks, str(data / "index"), providers.embed, args.recreate, _memory(spark, data, settings).vectors, settings)
    listed = files.read_manifest(spark, str(data / "manifest.yaml"))
    record = files.write_index_record(str(data / "index.json"), listed, chunks, inserted, "hashing", 64)
    print(json.dumps(record["counts"]))
    return 0


def ask(spark, args, data):
    providers, settings = answer.Providers(), _settings(data)
    if args.no_blend:
        settings = replace(settings, blend_enabled=False)
    questions = spark.createDataFrame([(i, q) for i, q in enumerate(args.question)], "qid int, query string")
    out = answer.answer(
        questions, _index(spark, data, providers), providers, settings, screen=not args.no_screen,
        memory=None if args.no_cache else _memory(spark, data, settings),
    )
    if args.user:
        turns = accounts.as_turns(
            out.withColumn("user_id", F.lit(args.user)).withColumn("at", F.current_timestamp())
        )
        turns.write.mode("append").parquet(str(data / "history"))
    shown = out if args.trace else out.drop("trace")
    if args.json:
        _show(shown)
    else:
        for row in shown.toLocalIterator():
            print(f"{row['answer']}\n")
            for c in row["citations"]:
                print(f"  {c['marker']} {c['title']} - {c['section']} ({c['pages']})")
            if args.trace:
                print(json.dumps(row["trace"], indent=2, ensure_ascii=False))
    return 0


def run_eval(spark, args, data):
    path = data / "eval.yaml"
    if args.action == "init":
        files.write_starter_cases(str(path))
        return 0
    cases = files.read_eval_cases(spark, str(path))
    if args.bucket:
        cases = cases.where(F.col("bucket") == args.bucket)
    providers, settings = answer.Providers(), _settings(data)
    built = _index(spark, data, providers)
    if args.action == "calibrate":
        scores, grid, chosen = evaluate.calibrate(cases, built, providers, settings)
        _show(grid)
        threshold = chosen.first()["threshold"]
        print(f"threshold {threshold}")
        if args.write:
            lists = scores.groupBy("bucket").agg(F.sort_array(F.collect_list("score")).alias("s"))
            floor = min(settings.corrective_threshold, threshold)
            write_calibration(data / "calibration.json", threshold, floor, {r.bucket: r.s for r in lists.toLocalIterator()})
        return 0
    done = evaluate.run_eval(cases, built, providers, settings)
    _show(done.results.select("id", "bucket", "correct", "detail", "hit"))
    _show(done.metrics)
    if args.out:
        done.results.drop("note").write.mode("overwrite").json(args.out)
    safety = done.metrics.where("bucket = 'all'").first()
    return 0 if safety and safety["safety_compliance"] == 1.0 else 1


def users(spark, args, data):
    path = str(data / "users")
    have = spark.read.schema(USER).parquet(path) if index.exists(spark, path) else spark.createDataFrame([], USER)
    if args.action == "list":
        _show(accounts.users_by_age(have))
        return 0
    if args.action == "add":
        asked = spark.createDataFrame([(uuid.uuid4().hex, args.email)], "id string, email string").withColumn(
            "created_at", iso_millis(F.current_timestamp())
        )
        fresh = accounts.register(have, asked).join(have.select("id"), "id", "left_anti").select(*have.columns)
        added = fresh.count()
        fresh.write.mode("append").parquet(path)
        print("added" if added else "not added: the address is taken or not valid")
        return 0 if added else 1
    place = str(data / "history")
    turns = spark.read.schema(TURN).parquet(place) if index.exists(spark, place) else spark.createDataFrame([], TURN)
    left, kept = accounts.delete_users(have, turns, have.where(F.col("email") == args.email.strip().lower()))
    # Both tables are read by both plans, so the new states are written aside before either is replaced.
    for table, target in [(cut_lineage(left), path), (cut_lineage(kept), place)]:
        table.write.mode("overwrite").parquet(target)
    return 0


def store(spark, args, data):
    stored = spark.read.parquet(str(data / "index"))
    print(json.dumps({"rows": stored.count(), "columns": stored.columns, "embedding_dim": len((stored.select("vector").first() or [[]])[0])}))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groundwell")
    top.add_argument("--data", default="data", help="the data folder")
    top.add_argument("--master", default=None, help="Spark master, if not set by spark-submit")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("corpus"); p.add_argument("action", choices=["scan", "verify"]); p.set_defaults(run=corpus)
    p = sub.add_parser("ingest"); p.add_argument("--no-strict", action="store_true"); p.set_defaults(run=run_ingest)
    p = sub.add_parser("index"); p.add_argument("--recreate", action="store_true"); p.set_defaults(run=run_index)
    p = sub.add_parser("ask")
    p.add_argument("question", nargs="+")
    p.add_argument("--user", help="keep the turn in this user's history")
    for flag in ("--json", "--trace", "--no-screen", "--no-cache", "--no-blend"):
        p.add_argument(flag, action="store_true")
    p.set_defaults(run=ask)
    p = sub.add_parser("eval")
    p.add_argument("action", choices=["init", "run", "calibrate"])
    p.add_argument("--bucket"); p.add_argument("--out"); p.add_argument("--write", action="store_true")
    p.set_defaults(run=run_eval)
    p = sub.add_parser("users")
    p.add_argument("action", choices=["list", "add", "delete"]); p.add_argument("email", nargs="?", default="")
    p.set_defaults(run=users)
    p = sub.add_parser("store"); p.add_argument("action", choices=["info"]); p.set_defaults(run=store)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or build_session(master=args.master)
    return args.run(spark, args, Path(args.data))
