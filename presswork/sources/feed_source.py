"""Feeds as a data source of Spark: `spark.read.format("feeds")` and `spark.readStream.format("feeds")`.

Options: `sources`, a JSON list of objects with id, name and url (or `path`, a file with that list, in any store that Arrow knows);
`timeout` in seconds, `retries`, `untitled` (true: items without a title are kept). The sources of one host
are one partition, so a host gets one request at a time. A row is an item with the place it has in its feed; a feed
without items, or with an error, is one row without an item, so that every source is accounted for.

As a stream, an offset counts the polls, and every trigger that is due polls all feeds once: what a poll gave is a
batch. `interval` is the least number of seconds between two polls. A batch that is run again polls again, so what comes
after it should tell stories apart by their ids, as upserts do.
"""

from __future__ import annotations

import json
import time
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import BACKOFF, Fetcher, parse_feed

ROWS = (
    "source_id string, source_name string, error string, responseMs long, place int, title string, link string, pubDate string, description string, image string"
)


class Host(InputPartition):
    """The sources of one host, of one poll."""

    def __init__(self, host: str, sources: list[dict], poll: int):
        super().__init__((host, poll))
        self.host, self.sources, self.poll = host, sources, poll


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.timeout, self.retries = float(options.get("timeout", 15)), int(options.get("retries", 1))
        self.untitled = options.get("untitled", "false").lower() == "true"
        told = options.get("sources")
        if told is None:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(options["path"])
            with files.open_input_stream(path) as f:
                told = f.read().decode()
        self.sources = [s for s in json.loads(told) if s.get("enabled", True)]

    def hosts(self, poll: int) -> list[Host]:
        by: dict[str, list[dict]] = {}
        for s in self.sources:
            by.setdefault(urllib.parse.urlsplit(s.get("url") or "").netloc.lower(), []).append(s)
        return [Host(h, some, poll) for h, some in sorted(by.items())]

    def partitions(self) -> list[Host]:
        return self.hosts(0)

    def read(self, partition: Host | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where there are no sources
            return
        fetcher = Fetcher(self.timeout, None, self.retries, BACKOFF, {"User-Agent": "presswork", "Accept": "*/*"}, 1)
        for s in partition.sources:
            body, _, error, _, _, _, millis = fetcher(s.get("url"))
            got = parse_feed(body, self.untitled) if error is None else {"items": [], "error": error}
            if error is None and self.retries and got["items"] and not any(i["title"] for i in got["items"]):
                # a feed without a single title has often been cut off: it is asked for once more
                body, _, error, _, _, _, more = fetcher(s.get("url"))
                got, millis = parse_feed(body, self.untitled) if error is None else {"items": [], "error": error}, millis + more
            head = (s.get("id"), s.get("name"), got["error"], millis)
            if not got["items"]:
                yield (*head, None, None, None, None, None, None)
            for place, i in enumerate(got["items"]):
                yield (*head, place, i["title"], i["link"], i["pubDate"], i["description"], i["image"])


class FeedStream(FeedReader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.interval, self.polled, self.polls = float(options.get("interval", 0)), None, 0

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        now = time.monotonic()
        if self.polled is None or now - self.polled >= self.interval:
            self.polled, self.polls = now, max(self.polls + 1, int(time.time() * 1000))
        return {"polls": self.polls}

    def partitions(self, start: dict, end: dict) -> list[Host]:
        return self.hosts(end["polls"]) if end["polls"] > start["polls"] else []

    def commit(self, end: dict) -> None:
        pass


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(dict(self.options))


def records(rows: DataFrame) -> DataFrame:
    """One record for each source, as `ingest` gives them: ok, status, errorType, itemCount, responseMs and the items in their order."""
    item = F.struct("place", "title", "link", "pubDate", "description", "image")
    per = rows.groupBy("source_id", "source_name").agg(
        F.max("error").alias("errorType"), F.max("responseMs").alias("responseMs"),
        F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), item))).alias("found"),
    )
    items = F.transform("found", lambda i: F.struct(*[i[c].alias(c) for c in ("title", "link", "pubDate", "description", "image")]))
    n = F.size("found")
    status = F.when(F.col("errorType").isNotNull(), "error").when(n == 0, "empty").otherwise("ok")
    return per.select(
        "source_id", "source_name", F.col("errorType").isNull().alias("ok"), status.alias("status"), "errorType", n.alias("itemCount"), "responseMs", items.alias("items")
    )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feeds)
