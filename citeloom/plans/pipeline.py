"""The whole update as a batch job, and the command line over it."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.taxonomy import Taxonomy
from citeloom.operators import papers as pp
from citeloom.operators import report, substrings, totals
from citeloom.operators.search import search
from citeloom.operators.substrings import Index, build
from citeloom.plans import answers, mail
from citeloom.sources import payloads, searches, store
from citeloom.sources.catalogue import CATALOGUE


def fetch(spark: SparkSession, catalogue: list[dict[str, str]]) -> DataFrame | None:
    """Different papers of a catalogue of {source, query, path}; unknown sources are skipped, None if nothing is left."""
    batches = [payloads.read(spark, c["source"], c["path"], c.get("query", "")) for c in catalogue]
    batches = [b for b in batches if b is not None]
    return pp.compacted(pp.fetch_union(batches)) if batches else None


def ask(spark: SparkSession, catalogue: list[dict[str, str]], folder: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """Ask the services for a catalogue's searches and keep their answers below folder: (papers, searches that failed).

    Failed ones (search, source, query, error) cost no others; the papers are what the rest found.
    """
    made = searches.keep(searches.asked(spark, catalogue, **options), f"{folder}/{uuid.uuid4().hex}")
    found = pp.compacted(pp.first_of_all(payloads.parsed(made.where("value is not null"))))
    return found, made.where("error is not null").select("search", "source", "query", "error")


def index_of(spark: SparkSession, path: str, name: str | None = None) -> Index | None:
    """The substring index of the current snapshot, or a named one; None if it was written without."""
    told = store.get(spark, f"{path}/index/{name or store.pointer(spark, path).name}.json")
    return None if told is None else Index(spark, json.loads(told)["folders"])


def _index(spark: SparkSession, path: str, name: str) -> None:
    """Index what a snapshot adds to the one before; all of it if that has no index, or was classified by another taxonomy."""
    made, old = store.manifest(spark, path, name), store.manifest(spark, path)
    before = index_of(spark, path)
    kept = before.folders if before is not None and old.mark == made.mark else []
    fresh = store.read_added(spark, path, name) if kept else store.read_snapshot(spark, path, name)
    if not fresh.isEmpty():
        kept = [*kept, build(fresh, f"{path}/index/{name}")]
    store.put(spark, f"{path}/index/{name}.json", json.dumps({"folders": kept}).encode())


def totals_of(spark: SparkSession, path: str, name: str | None = None) -> DataFrame | None:
    """The totals of the current snapshot, or a named one; None if it was written without."""
    at = f"{path}/totals/{name or store.pointer(spark, path).name}"
    return spark.read.schema(totals.SCHEMA).parquet(at) if store.exists(spark, at) else None


def _count(spark: SparkSession, path: str, name: str) -> None:
    """Add what a snapshot adds to the totals of the one before; count all where that has none, or another taxonomy's."""
    made, old = store.manifest(spark, path, name), store.manifest(spark, path)
    before = totals_of(spark, path) if old.mark == made.mark else None
    if before is None:
        now = totals.state(pp.annotate(store.read_snapshot(spark, path, name)))
    else:
        now = totals.combined(before, totals.state(pp.annotate(store.read_added(spark, path, name))))
    now.write.parquet(f"{path}/totals/{name}")


def run(spark: SparkSession, path: str, new: DataFrame | None, taxonomy: Taxonomy, readme: str | None = None, notify=None, index: bool = False, count: bool = False) -> dict:
    """Merge new papers, write them with their categories as a part of the store, then render.

    With `index` and `count` the store's substring index and totals are kept up. `notify` gets the number of
    new papers, the digest's text, and its HTML page as pieces of bytes.

    Papers that stand keep their categories while the taxonomy is the same; with another one
    all are classified again and written whole. What the run adds, its index and totals, stand before
    the pointer moves to the snapshot: after a crash either all of the run is there, or the next
    run finds the same papers new.
    """
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
    mark = hashlib.sha256(json.dumps(list(taxonomy.groups.items())).encode()).hexdigest()
    before = store.manifest(spark, path)
    out: dict = {"existing_count": before.rows, "fetched_count": 0 if new is None else new.count()}
    new = store.read_snapshot(spark, path).limit(0) if new is None else new

    def finish(name: str) -> None:
        if index:
            _index(spark, path, name)
        if count:
            _count(spark, path, name)

    if before.parts and before.mark == mark:
        name = store.add_papers(spark, path, new, lambda rows: pp.categorize(rows, taxonomy), finish=finish)
    else:
        added = pp.categorize(store.unseen(spark, path, new, before), taxonomy)
        part = store.write_part(added, path)
        everything = pp.categorize(store.read_snapshot(spark, path), taxonomy).unionByName(store.read_part(spark, path, part))
        name = store.write_snapshot(everything, path, finish=finish, mark=mark, added=part)
    current, delta = store.read_snapshot(spark, path, name), store.read_added(spark, path, name)
    out |= {"new_count": delta.count(), "total_count": store.manifest(spark, path, name).rows, "digest": report.digest_text(delta, current, taxonomy, now), "email_sent": False}
    if readme:
        store.write_lines(report.readme_lines(current, taxonomy, now[:10]), readme, *report.README_ORDER)
    if notify is not None and out["new_count"]:
        out["email_sent"] = posted(notify, out["new_count"], out["digest"], report.digest_page(delta, current, taxonomy, now), path)
    return out | {"success": True}


def posted(notify, new: int, digest: str, page: DataFrame, path: str) -> bool:
    """Give the digest out, its page in pieces of bytes: a paper is a row of it, so all tasks write it below the store, where it stays until it's sent."""
    spark, at = page.sparkSession, f"{path}/digest/{uuid.uuid4().hex}"
    try:
        store.write_folder(page, at, "part", F.desc("date"), "pos")
        return bool(notify(new, digest, store.pieces(spark, at)))
    finally:
        store.remove(spark, at)


def latest_delta(spark: SparkSession, path: str) -> DataFrame:
    """The papers that the last update added; none if there was none."""
    return store.read_added(spark, path)


def _show(rows: DataFrame, counts=pp) -> None:
    """The counts of papers, or with `totals` those read off totals, as tables, years with bars."""
    counts.total(rows).show(truncate=False)
    counts.by_year(rows).orderBy(F.desc("year")).withColumn("bar", pp.t.bar("n", 60)).show(1000, truncate=False)
    counts.by_source(rows).orderBy("rank").drop("rank").show(1000, truncate=False)
    counts.by_category(rows).orderBy("rank").drop("rank").show(1000, truncate=False)


def main(args: list[str] | None = None, transport=None) -> None:
    parser = argparse.ArgumentParser(prog="citeloom")
    parser.add_argument("command", choices=["fetch", "stats", "search", "export", "update-readme", "run-pipeline", "send-email", "analyze"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("--store", required=True)
    parser.add_argument("--taxonomy", help="a JSON file {category: {description, keywords}}, in order")
    parser.add_argument("--catalogue", help="a JSON file [{source, query, path}] of recorded answers")
    parser.add_argument("--answers", help="a shared folder: ask the services for the catalogue's searches (the built-in ones without --catalogue) and keep their answers there")
    parser.add_argument("--mirror", help="an address that takes the services' place, each below its name")
    parser.add_argument("--new", help="a JSON array of new papers")
    parser.add_argument("--index", action="store_true", help="keep a substring index of the store, which searches then use")
    parser.add_argument("--totals", action="store_true", help="keep the totals of the store, which stats and analyze then read")
    parser.add_argument("--format", default="json")
    parser.add_argument("--output", default="papers_export")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--to", nargs="*", default=[], help="recipients of the digest")
    a = parser.parse_intermixed_args(args)
    if a.taxonomy is None and a.command in ("fetch", "update-readme", "run-pipeline", "send-email"):
        parser.error(f"{a.command} needs --taxonomy")
    spark = SparkSession.builder.getOrCreate()
    taxonomy = Taxonomy.from_json(a.taxonomy) if a.taxonomy else Taxonomy({})
    now = datetime.now(timezone.utc)
    box = mail.Mailbox(a.to, *(os.environ.get(x, "") for x in ("SMTP_USER", "SMTP_PASSWORD", "EMAIL_FROM")), os.environ.get("SMTP_HOST", "localhost"), int(os.environ.get("SMTP_PORT", "587")))
    post = lambda n, plain, html: mail.send(n, plain, html, box, **({"transport": transport} if transport else {}))
    new = store.read_json(spark, a.new) if a.new else None
    if a.catalogue or a.answers:
        wanted = json.loads(Path(a.catalogue).read_text(encoding="utf-8")) if a.catalogue else CATALOGUE
        if a.answers:
            fetched, failed = ask(spark, wanted, a.answers, mirror=a.mirror, pause=0 if a.mirror else None)
            failed.orderBy("search").show(100, truncate=False)
        else:
            fetched = fetch(spark, wanted)
        new = fetched if new is None else new if fetched is None else pp.compacted(pp.fetch_union([new, fetched]))
    if a.command == "fetch":
        print(run(spark, a.store, new, taxonomy, index=a.index, count=a.totals))
        return
    if a.command == "run-pipeline":
        print(run(spark, a.store, new, taxonomy, a.output, post if a.to else None, a.index, a.totals))
        return
    papers = store.read_snapshot(spark, a.store)
    if papers.isEmpty():
        parser.exit(1, "No papers in the store.\n")
    known = totals_of(spark, a.store)
    if a.command == "stats":
        _show(papers) if known is None else _show(known, totals)
    elif a.command == "search":
        index = index_of(spark, a.store)
        found = search(papers, " ".join(a.words), a.limit) if index is None else substrings.search(papers, index, " ".join(a.words), a.limit)
        found.select("title", pp.t.authors_search("authors").alias("authors"), "journal", "year", "categories", "url").show(a.limit, truncate=False)
    elif a.command == "export":
        store.export(papers, a.format, f"{a.output}.{a.format}")
    elif a.command == "analyze":
        told = (report.analyze, papers) if known is None else (report.analysis, known)
        print(answers.as_json(told[0](told[1], now.year, now.isoformat())))
    elif a.command == "send-email":
        delta, made = latest_delta(spark, a.store), now.strftime("%Y-%m-%d %H:%M UTC")
        print("sent" if posted(post, delta.count(), report.digest_text(delta, papers, taxonomy, made), report.digest_page(delta, papers, taxonomy, made), a.store) else "not sent")
    else:
        store.write_lines(report.readme_lines(papers, taxonomy, now.strftime("%Y-%m-%d")), a.output, *report.README_ORDER)


if __name__ == "__main__":
    main()
