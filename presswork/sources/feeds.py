"""Feeds and source lists.

Documents come as rows with a text column, so that any Spark reader can bring
them; `fetch` does it over HTTP in executors. A bad feed becomes a row with an
error, never an exception.
"""

from __future__ import annotations

import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions import scalars as N

from .schemas import SOURCE, source_errors, with_defaults

ITEM = "array<struct<title:string,link:string,pubDate:string,description:string,image:string>>"
PARSED = f"struct<items:{ITEM},error:string>"


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON file ({"sources": [...]} or a list) with `errors`; a second row with an id has the error `duplicate`."""
    text = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.sources"), F.col("value"))
    rows = text.select(F.posexplode(F.from_json(body, f"array<struct<{_ddl(SOURCE)}>>"))).select("pos", "col.*")
    seen = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    errors = F.concat(source_errors(), F.when(seen > 1, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")))
    return with_defaults(rows.withColumn("errors", errors)).orderBy("priority", "name")


def _ddl(columns: str) -> str:
    return ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in columns.split(", "))


def valid(sources: DataFrame) -> DataFrame:
    return sources.where("size(errors) = 0")


def enabled(sources: DataFrame) -> DataFrame:
    return valid(sources).where("enabled")


_NAMES = {
    "http://purl.org/rss/1.0/modules/content/": "content",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://search.yahoo.com/mrss/": "media",
}


def _name(tag: str) -> str:
    if tag.startswith("{"):
        space, local = tag[1:].split("}", 1)
        return f"{_NAMES[space]}:{local}" if space in _NAMES else local
    return tag


def _text(node: ET.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def parse_feed(xml: str | None, untitled: bool = False) -> dict:
    """Items and error (null, or `parse`) of an RSS 2.0, Atom or RSS 1.0 document; items without a title count where `untitled` is set.

    A document that breaks off gives its complete items if it told its title, and an
    unclosed CDATA section is an error.
    """
    if not xml or not xml.strip():
        return {"items": [], "error": "parse"}
    parser = ET.XMLPullParser(["start", "end"])
    stack: list[ET.Element] = []
    entries, named, kind = [], False, None
    broken = False
    try:
        parser.feed(xml.strip())
        parser.close()
    except ET.ParseError:
        broken = True
    for event, node in _events(parser):
        name = _name(node.tag)
        if event == "start":
            kind = kind or {"rss": "rss", "feed": "atom", "RDF": "rdf"}.get(name, "other")
            stack.append(node)
            continue
        stack and stack.pop()
        if name in ("item", "entry"):
            entries.append(node)
        elif name in ("title", "link", "description") and not any(_name(s.tag) in ("item", "entry") for s in stack):
            named = named or bool(_text(node) or node.get("href"))
    if kind in (None, "other") or (broken and "<![CDATA[" in xml and xml.rfind("<![CDATA[") > xml.rfind("]]>")):
        return {"items": [], "error": "parse"}
    items = [i for i in map(_item, entries) if i["title"] or untitled]
    if not entries and not named:
        return {"items": [], "error": "parse"}
    return {"items": items, "error": None}


def _events(parser: ET.XMLPullParser) -> Iterator:
    try:
        yield from parser.read_events()
    except ET.ParseError:
        return


def _item(node: ET.Element) -> dict:
    have: dict[str, list[ET.Element]] = {}
    for child in node:
        have.setdefault(_name(child.tag), []).append(child)

    def pick(*names: str) -> str:
        # an element that has elements but no text of its own ends the search
        for node in (have[n][0] for n in names if n in have):
            if _text(node) or len(node):
                return (node.text or "").strip() if len(node) else _text(node)
        return ""

    # of several links the first one with a text counts, else the first address: feeds list alternates and enclosures beside it
    link = next((t for x in have.get("link", []) for t in [_text(x)] if t), "")
    link = link or next((x.get("href") for x in have.get("link", []) if x.get("href")), "")
    content = pick("content:encoded", "description", "summary")
    media = (x.get("url") for n in ("media:content", "media:thumbnail", "enclosure") for x in have.get(n, [])[:1])
    image = next((u for u in media if u and "logo" not in u), None)
    if not image and (m := re.search(r"""(?i)<img[^>]+src=["']([^"']+)["']""", content)):
        image = m[1]
    plain = re.sub(r"(?is)<(script|style).*?</\1>|<[^>]+>", " ", content)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        plain = plain.replace(entity, char)
    return {
        "title": pick("title", "dc:title"),
        "link": link,
        "pubDate": pick("pubDate", "published", "updated", "dc:date"),
        "description": " ".join(plain.split()),
        "image": image,
    }


#: Bytes of documents that a worker parses at once.
SLICE = 1 << 20


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    item = pa.struct([(name, pa.string()) for name in ("title", "link", "pubDate", "description", "image")])
    kind = pa.struct([("items", pa.list_(item)), ("error", pa.string())])
    for batch in batches:
        part, size = [], 0
        for xml in batch:
            part.append(xml.as_py())
            size += len(part[-1] or "")
            if size >= SLICE:
                yield pa.array(map(parse_feed, part), type=kind)
                part, size = [], 0
        yield pa.array(map(parse_feed, part), type=kind)


def parse_feeds(xml: Column) -> Column:
    """struct(items, error) of each document, some documents of an Arrow batch at a time."""
    return F.arrow_udf(_parsed, PARSED)(xml)


def parse_json_feed(body: Column) -> Column:
    """Items of a JSON rendering of a feed; those without title or link drop out."""
    items = F.from_json(F.get_json_object(body, "$.items"), ITEM)
    return F.filter(items, lambda i: (F.coalesce(i["title"], F.lit("")) != "") & (F.coalesce(i["link"], F.lit("")) != ""))


#: What a fetch adds to a row. `error` is timeout, http, network, empty or null, `message` says more.
FETCHED = "body string, status int, error string, message string, content_type string, requests int, millis long"
#: Seconds before each further try after status 429.
BACKOFF = (0.5, 1.0, 2.0)


class Fetcher:
    """GET requests of one Python worker: typed errors, a cap on bytes, further tries, and few requests at once to one host."""

    def __init__(self, timeout: float, max_bytes: int | None, retries: int, backoff: tuple[float, ...], headers: dict[str, str], per_host: int):
        self.timeout, self.max_bytes, self.retries, self.backoff, self.headers = timeout, max_bytes, retries, backoff, headers
        self.slots: dict[str, threading.Semaphore] = {}
        self.lock, self.per_host = threading.Lock(), per_host

    def _slot(self, url: str) -> threading.Semaphore:
        host = urllib.parse.urlsplit(url).netloc.lower()
        with self.lock:
            return self.slots.setdefault(host, threading.Semaphore(self.per_host))

    def once(self, url: str) -> tuple:
        """(body, status, error, message, content type)."""
        kind = None
        try:
            if urllib.parse.urlsplit(url or "").scheme.lower() not in ("http", "https"):
                return None, None, "network", "only http and https are fetched", None
            request = urllib.request.Request(url, headers=self.headers)
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                status, kind = answer.status, answer.headers.get("Content-Type")
                data = answer.read(-1 if self.max_bytes is None else self.max_bytes + 1)
            if self.max_bytes is not None and len(data) > self.max_bytes:
                return None, None, "http", f"more than {self.max_bytes} bytes", kind
            body = data.decode("utf-8", "replace")
            return (body, status, None, None, kind) if body.strip() else (body, status, "empty", "no content", kind)
        except urllib.error.HTTPError as e:
            return None, e.code, "http", f"status {e.code}", None
        except TimeoutError as e:
            return None, None, "timeout", str(e), None
        except (OSError, ValueError) as e:
            return None, None, "timeout" if "timed out" in str(e) else "network", str(e), None

    def __call__(self, url: str | None) -> tuple:
        began, tries = time.monotonic(), 0
        with self._slot(url or ""):
            while True:
                got, tries = self.once(url), tries + 1
                again = got[1] == 429 or got[2] == "empty" and tries == 1
                if not again or tries > self.retries:
                    break
                time.sleep(self.backoff[min(tries, len(self.backoff)) - 1])
        return *got, tries, int((time.monotonic() - began) * 1000)


def fetch(
    requests: DataFrame, url_col: str = "url", timeout: float = 15, max_bytes: int | None = None, retries: int = 0, backoff: tuple[float, ...] = BACKOFF,
    headers: dict[str, str] | None = None, pool: int = 4, per_host: int = 2,
) -> DataFrame:
    """Each row with the columns of `FETCHED`, over http and https only.

    Status 429 is tried again up to `retries` times, an empty answer once if there are any. A task has `pool` requests
    under way, `per_host` of them to one host; with rows partitioned by host that bounds a host as a whole.
    """
    more = T._parse_datatype_string(FETCHED)
    schema = T.StructType([*requests.schema.fields, *more.fields])
    said = {"User-Agent": "presswork", "Accept": "*/*", **(headers or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Fetcher(timeout, max_bytes, retries, backoff, said, per_host)
        with ThreadPoolExecutor(pool) as workers:
            for frame in frames:
                got = list(workers.map(one, frame[url_col]))
                made = {f.name: pd.Series([g[i] for g in got], dtype=object, index=frame.index) for i, f in enumerate(more.fields)}
                yield frame.assign(**made)

    return requests.mapInPandas(run, schema)


def ingest(sources: DataFrame, fetched: DataFrame | None = None, partitions: int = 8) -> DataFrame:
    """A record for each source: source_id, source_name, ok, status (ok, empty, error), errorType, itemCount, responseMs and its items.

    `fetched` has the answers, rows of `FETCHED` by source_id; without it the sources' urls are fetched, a few at once. One bad feed
    is a record like any other.
    """
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "url")
    if fetched is None:
        got = fetch(s.repartition(partitions, "url"), retries=1)
    else:
        got = s.join(fetched.select("source_id", "body", "error", "millis"), "source_id", "left")
    got = got.withColumn("p", F.when(F.col("error").isNull() & F.col("body").isNotNull(), parse_feeds(F.col("body"))))
    error = F.coalesce("error", F.when(F.col("body").isNull(), "network"), F.col("p.error"))
    items = F.when(error.isNull(), F.col("p.items")).otherwise(F.array().cast(ITEM))
    n = F.size("items")
    status = F.when(F.col("errorType").isNotNull(), "error").when(n == 0, "empty").otherwise("ok")
    made = got.select("source_id", "source_name", error.alias("errorType"), items.alias("items"), F.col("millis").alias("responseMs"))
    return made.select(
        "source_id", "source_name", F.col("errorType").isNull().alias("ok"), status.alias("status"), "errorType", n.alias("itemCount"), "responseMs", "items"
    )


def items_of(records: DataFrame) -> DataFrame:
    """The raw items of all sources with their place in the feed, as `normalize` takes them."""
    return records.select("source_id", F.posexplode("items").alias("place", "i")).select("source_id", "place", "i.*")


def normalize(raw: DataFrame, sources: DataFrame, as_of: Column, aliases: list[str] | None = None) -> DataFrame:
    """Raw items with a source_id into whole stories; sources are few and broadcast by Spark if small enough.

    Publishers at the end of a title are cut off, so that copies of an article have one identity. Fields that
    later stages fill are null or empty. Of an item, describedHref, tags and place are read if it has them.
    """
    have = lambda df, name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    s = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("reliability"), F.col("weight"), F.col("category").alias("source_type"),
        have(sources, "priority", "double").alias("source_priority"), have(sources, "color", "string").alias("source_color"),
    )
    from presswork.functions.lexicons import publisher_aliases
    from presswork.functions.stories import categorize

    given = F.coalesce(N.normalize_text(F.col("title")), F.lit("Untitled"))
    cleaned = N.clean_title(given, aliases if aliases is not None else publisher_aliases())["title"]
    rows = raw.withColumn("_title", F.coalesce(F.nullif(cleaned, F.lit("")), given)).withColumn("_url", F.coalesce(N.normalize_text(F.col("link")), F.lit("")))
    rows = rows.withColumn("_canonical", F.coalesce(N.canonical_url(F.col("_url")), F.col("_url"))).join(s, "source_id")
    title, url, none = F.col("_title"), F.col("_url"), F.array().cast("array<string>")
    description = N.normalize_text(F.col("description"))
    published = N.parse_timestamp(F.col("pubDate"))
    place = F.coalesce(have(raw, "place", "int"), F.lit(0))
    null = lambda kind: F.lit(None).cast(kind)
    lists = ("companies", "people", "models", "technologies", "countries", "relatedStoryIds")
    scores = ("importance", "impact", "novelty", "credibility", "relevance", "sourceConfidence")
    return rows.select(
        F.lit("1.0").alias("schemaVersion"),
        N.story_id(title, url).alias("id"),
        N.fingerprint(title, url).alias("fingerprint"),
        title.alias("title"),
        description.alias("description"),
        url.alias("originalUrl"),
        F.col("_canonical").alias("canonicalUrl"),
        N.publisher_url(have(raw, "describedHref", "string"), F.col("_canonical")).alias("publisherUrl"),
        F.struct(
            F.col("source_id").alias("id"), F.col("source_name").alias("name"), F.col("source_type").alias("type"), "reliability",
            F.col("source_priority").alias("priority"), "weight", F.col("source_color").alias("color"),
        ).alias("source"),
        published.alias("publishedAt"),
        as_of.alias("discoveredAt"),
        null("string").alias("author"),
        N.normalize_text(F.col("image")).alias("imageUrl"),
        categorize(F.concat_ws(" ", title, description)).alias("category"),
        null("string").alias("subcategory"),
        N.normalize_array(have(raw, "tags", "array<string>")).alias("tags"),
        *[none.alias(c) for c in lists],
        null("string").alias("content"),
        F.struct(null("string").alias("summary"), null("string").alias("whyItMatters"), none.alias("keyTakeaways"), null("string").alias("method")).alias("ai"),
        F.struct(*[null("int").alias(c) for c in scores]).alias("scores"),
        F.array().cast("array<struct<id:string,name:string>>").alias("sources"),
        as_of.alias("createdAt"),
        as_of.alias("updatedAt"),
        N.recency_score(F.col("weight"), published, place, as_of).alias("score"),
    )


def enrich(raw: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """The same as `normalize`, under the name that older callers use."""
    return normalize(raw, sources, as_of)


def ingest_summary(results: DataFrame) -> DataFrame:
    """ok, empty and failed feeds and their items, from rows (error, items)."""
    n = F.size("items")
    return results.agg(
        F.count_if(F.col("error").isNull() & (n > 0)).alias("ok"),
        F.count_if(F.col("error").isNull() & (n == 0)).alias("empty"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum(F.when(F.col("error").isNull(), n).otherwise(0)).alias("items"),
    )


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; broken ones and those without an id drop out."""
    rows = spark.read.schema(f"{schema}, _broken string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    return rows.where("id is not null").drop("_broken")
