"""Searches of the bibliographic services as a Python data source: format "bibliography".

A read has one partition per search. Executors ask, each row holds an answer, and a search
that fails gives a row that says why, so that no failure takes other searches with it.

    spark.read.format("bibliography").option("source", "arxiv").option("query", "genome").load()

Options: `searches` (a JSON list of {source, query}) or `source` and `query`; `limit` (records
asked for); `start` and `end` (dates, for the service that filters by them; a year up to today);
`pause` (seconds between the requests to a service) and `tries`; `mirror`, an address that takes
the services' place, each below its name.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from urllib.error import HTTPError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from citeloom.sources import requests

SCHEMA = "search int, source string, query string, value string, error string"
#: Answers that say to ask again later, and how long to wait at first.
BUSY, BACKOFF, TRIES = (429, 500, 502, 503, 504), 1.0, 3


@dataclass
class Search(InputPartition):
    """A search, its place among all, and when (seconds since 1970) it may be sent at the earliest."""

    search: int
    source: str
    query: str
    earliest: float


def patiently(ask: Callable[[str], bytes], tries: int, wait: Callable[[float], None] = time.sleep) -> Callable[[str], bytes]:
    """ask, repeated with growing pauses while the service is busy."""

    def asked(url: str) -> bytes:
        for attempt in range(tries):
            try:
                return ask(url)
            except HTTPError as e:
                if e.code not in BUSY or attempt + 1 == tries:
                    raise
                wait(BACKOFF * 2**attempt)
        raise ValueError(f"asked no times: {tries}")

    return asked


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        given = options.get("searches")
        self.searches: list[dict[str, str]] = json.loads(given) if given else [{"source": options["source"], "query": options.get("query", "")}]
        self.limit, self.tries = int(options.get("limit", requests.LIMIT)), int(options.get("tries", TRIES))
        self.pause = float(options.get("pause", requests.PAUSE))
        self.end = date.fromisoformat(options["end"]) if "end" in options else date.today()
        self.start = date.fromisoformat(options["start"]) if "start" in options else requests.year_before(self.end)
        self.mirror = options.get("mirror")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities on what a search is known by choose the partitions; the rest is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("search",), ("source",), ("query",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Search]:
        """The wanted searches; the k-th of a service waits k pauses, in whatever order and number tasks run."""
        begun, before, out = time.time(), dict[str, int](), []
        for i, s in enumerate(self.searches):
            row = {"search": i, "source": s["source"], "query": s["query"]}
            if all(row[name] in values for name, values in self.wanted.items()):
                k = before[s["source"]] = before.get(s["source"], -1) + 1
                out.append(Search(i, s["source"], s["query"], begun + k * self.pause))
        return out

    def read(self, partition: Search) -> Iterator[tuple]:
        p, value, error = partition, None, None
        try:
            if p.source not in requests.SERVICES:
                raise ValueError(f"unknown source: {p.source}")
            time.sleep(max(0.0, p.earliest - time.time()))
            ask = patiently(requests.get, self.tries)
            found = requests.answer(p.source, p.query, self.start, self.end, self.limit, ask, self.mirror, self.pause)
            value = found and found.decode("utf-8")
        except (OSError, ValueError) as e:  # no answer, or none that can be read
            error = f"{type(e).__name__}: {e}"
        yield (p.search, p.source, p.query, value, error)


class Bibliography(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bibliography"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.dataSource.register(Bibliography)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def asked(spark: SparkSession, searches: list[dict[str, str]], **options: object) -> DataFrame:
    """A row per search: (search, source, query, value, error); value and error are null where a service finds nothing.

    Reading the frame twice asks twice: keep it first (`keep`).
    """
    register(spark)
    reader = spark.read.format("bibliography").option("searches", json.dumps(searches))
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()


def keep(answers: DataFrame, folder: str) -> DataFrame:
    """Let the executors write the answers to a shared folder, a part for each service; what is kept there."""
    answers.write.partitionBy("source").mode("append").parquet(folder)
    return answers.sparkSession.read.schema(SCHEMA).parquet(folder)
