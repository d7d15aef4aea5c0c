"""Scalar functions of the story model, as Column expressions.

All of them stay inside Catalyst: no Python runs per row. Null in gives null out
unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in browsers see it; Java's own class is ASCII only.
SPACE = r"[\s   -     　﻿]"
# Query parameters that only track clicks; so does every utm_ one.
TRACKING = (
    "fbclid", "gclid", "msclkid", "yclid", "dclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "igshid", "vero_id", "_hsenc", "_hsmi",
    "ref_src", "ref_url", "campaign", "ocid",
)
# Fixed value: the site whose links only wrap those of others.
AGGREGATOR_HOST = "news.google.com"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def js_round(x: Column) -> Column:
    """Half up, towards plus infinity, as a long."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    """Rounded half up to one decimal place."""
    return F.floor(x * 10 + 0.5).cast("double") / 10


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize_text(text: Column) -> Column:
    """Collapsed and trimmed; null if nothing is left."""
    return F.nullif(squeeze(text), F.lit(""))


def normalize_array(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def strip_html(html: Column) -> Column:
    """Text of markup: script and style blocks go, tags become blanks, six entities are decoded, null gives ""."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def first_image(html: Column) -> Column:
    """Source of the first image, or null."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))


def normalize_title(title: Column) -> Column:
    """Lower-cased a-z and 0-9 words with single blanks; null gives ""."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def url_host(url: Column) -> Column:
    """Lower-cased host without www., null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(ascii_host(F.lower(host)), r"^www\.", ""), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_url_key(url: Column) -> Column:
    """Host and the first two path segments, lower-cased; "" for what is no URL."""
    parts = F.filter(F.split(F.lower(without_dots(url_path(url))), "/"), lambda s: s != "")
    return F.coalesce(F.concat(url_host(url), F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/")), F.lit(""))


def fingerprint(title: Column, url: Column) -> Column:
    """Normalised title and URL key, 200 characters at most."""
    return F.substring(F.concat(normalize_title(title), F.lit("|"), canonical_url_key(url)), 1, 200)


def djb2(text: Column) -> Column:
    """32-bit h * 33 + c hash as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(total)), 8, "0")


def story_id(title: Column, url: Column) -> Column:
    return F.concat(F.lit("s"), djb2(fingerprint(title, url)))


# Characters that the parts of an address don't have as they are.
IN_PATH = r"[\x00-\x20\"#<>?`{}\x7F-\x{10FFFF}]"
IN_QUERY = r"[\x00-\x20\"#<>'\x7F-\x{10FFFF}]"
IN_FRAGMENT = r"[\x00-\x20\"<>`\x7F-\x{10FFFF}]"
DOT, DOTS = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def percent_encoded(text: Column, wrong: str) -> Column:
    """The text with the UTF-8 bytes of every wrong character as %XX; what is encoded already stays."""
    one = lambda c: F.when(c.rlike(wrong), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(text.rlike(wrong), F.array_join(F.transform(chars, one), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments, the latter with the segment before them; plain paths are not taken apart."""
    parts = F.split(F.substring(path, 2, 1 << 20), "/")
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x.rlike(DOTS), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.rlike(DOT), acc).otherwise(F.concat(acc, F.array(x)))
    last = F.element_at(parts, -1)
    ends = F.when(last.rlike(DOT) | last.rlike(DOTS), F.array(F.lit(""))).otherwise(none)
    made = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, none, step), ends), "/"))
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), made).otherwise(path)


def ascii_host(host: Column) -> Column:
    """A lower-cased host with its labels in Punycode where they need it; null where that can't be."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)).otherwise(host)


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and host, no default port or tracking parameters, "/" for an empty path; null unless http or https.

    As browsers do it: line ends and tabs go, backslashes before the query are slashes, hosts are in Punycode (ß as ss), paths lose
    . and .. segments, and characters that a part can't have are percent-encoded. User names, other parameters and fragments else stay as they are.
    """

    def made(trimmed: Column) -> Column:
        scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z]+)://", 1))
        user = F.regexp_extract(trimmed, r"^[A-Za-z]+://([^/?#@]*@)", 1)
        host = F.lower(F.regexp_extract(trimmed, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#@]+)", 1))
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
        path = F.regexp_extract(trimmed, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
        query = F.regexp_extract(trimmed, r"^[^?#]*\?([^#]*)", 1)
        fragment = F.regexp_extract(trimmed, r"(?s)(#.*)$", 1)
        noise = "^(?i)(utm_[^=]*|" + "|".join(TRACKING) + ")(=|$)"
        kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(noise)), "&")
        clean = percent_encoded(without_dots(F.when(path == "", "/").otherwise(path)), IN_PATH)
        whole = F.concat(
            scheme, F.lit("://"), user, ascii_host(host), clean,
            F.when(kept != "", F.concat(F.lit("?"), percent_encoded(kept, IN_QUERY))).otherwise(""), percent_encoded(fragment, IN_FRAGMENT),
        )
        return F.when(scheme.isin("http", "https") & (host != ""), whole)

    def usual(trimmed: Column) -> Column:
        plain = F.regexp_replace(trimmed, r"[\t\n\r]", "")
        head = F.regexp_extract(plain, r"(?s)^([^?#]*)", 1)
        return F.when(head.contains("\\"), F.concat(F.replace(head, F.lit("\\"), F.lit("/")), F.substring(plain, F.length(head) + 1, F.lit(1 << 30)))).otherwise(plain)

    return let(usual(F.trim(url)), made)


def publisher_url(described: Column, canonical: Column) -> Column:
    """The publisher's own address of an aggregator's item, where the item tells one."""
    own = canonical_url(described)
    wrapped = url_host(canonical) == AGGREGATOR_HOST
    other = (url_host(own) != AGGREGATOR_HOST) & (canonical_url_key(own) != canonical_url_key(canonical))
    return F.when(wrapped & other, own)


def cache_key(url: Column) -> Column:
    """Key under which fetches of one article are shared: host without www., clean lower-cased path, query."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url_path(url)), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(url_host(url), path, F.when(query == "?", "").otherwise(query))


def parse_timestamp(text: Column) -> Column:
    """ISO 8601 or RFC 822 dates, null for anything else; without an offset it is UTC."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    tries = [F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(bare)), *tries)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def word_count(text: Column) -> Column:
    """Words between white space; null counts as 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """Cut after . ! or ? before white space; trimmed, without empty ones."""
    cut = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def char_cap(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last blank, without one trailing . , ; or :"""

    def shortened(cut: Column) -> Column:
        back = F.locate(" ", F.reverse(cut))
        kept = F.when((back > 0) & (back < F.length(cut)), F.substring(cut, F.lit(1), F.length(cut) - back)).otherwise(cut)
        return F.regexp_replace(kept, "[.,;:]$", "")

    return F.when(F.length(text) <= limit, text).otherwise(let(F.substring(text, 1, limit), shortened))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def tokens(text: Column) -> Column:
    """Lower-case a-z and 0-9 tokens; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def band(score: Column, missing: str = "unknown") -> Column:
    """high from 70, medium from 40, else low."""
    return F.when(score.isNull(), missing).when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def percent(score: Column) -> Column:
    """Rounded and held to 0..100; null stays null."""
    return F.when(score.isNotNull(), F.least(F.greatest(js_round(score), F.lit(0)), F.lit(100)))


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def is_redundant(summary: Column, title: Column) -> Column:
    """True for an empty summary, or one that is nearly the title."""
    s, t = F.trim(F.coalesce(summary, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    near = (F.lower(s) == F.lower(t)) | (similarity_ratio(F.lower(s), F.lower(t)) > 0.85)
    return F.when(s == "", True).when(t == "", False).otherwise(near)


def shown_summary(summary: Column, description: Column, title: Column) -> Column:
    """The summary, else the description; null if what is chosen only repeats the title."""
    chosen = F.coalesce(F.nullif(summary, F.lit("")), description)
    return F.when(~is_redundant(chosen, title), chosen)


def reader_text(content: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), description, F.lit(""))


def score_value(signal: Column, legacy: Column) -> Column:
    """The signal, else twenty times the legacy score, rounded."""
    return js_round(F.coalesce(signal.cast("double"), legacy * 20))


def time_ago(ts: Column, as_of: Column) -> Column:
    """'5m ago' and the like; a date from a week on."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def recency_score(weight: Column, ts: Column, index: Column, as_of: Column) -> Column:
    """weight x e^(-hours/30); by position where there is no date."""
    hours = F.greatest((as_of.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 3600, F.lit(0.0))
    undated = F.greatest(F.lit(0.2) - index * 0.02, F.lit(0.0))
    return F.when(ts.isNotNull(), F.exp(-hours / 30)).otherwise(undated) * weight


def story_day(published: Column, discovered: Column) -> Column:
    """UTC day of publication, else of discovery."""
    return F.to_date(F.coalesce(published, discovered))


def strict_day(published: Column, discovered: Column) -> Column:
    """UTC day of a publication date given as text; of discovery only where none is given, null where it is no date."""
    given = F.coalesce(published, F.lit("")) != ""
    return F.when(given, F.to_date(parse_timestamp(published))).otherwise(F.to_date(discovered))


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """The calendar day of an instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def located(text: Column, pattern: str) -> Column:
    """array<struct<index, value>> of the matches of a pattern: places are code points. For few matches a text."""
    raw = F.lit(pattern)
    values = F.regexp_extract_all(text, raw, 0)
    gaps = F.transform(F.split(text, raw, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<index:int,value:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        one = F.struct(at.alias("index"), x["value"].alias("value"))
        return F.struct((at + F.length(x["value"])).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    each = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(each, start, step, lambda acc: acc["found"])


def body_for_reading(summary: Column, description: Column, content: Column) -> Column:
    """The first of summary, description and content that is not blank, trimmed; "" if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (summary, description, content)], F.lit(""))


def echoes_title(title: Column, body: Column) -> Column:
    """True if a body says hardly more than the title, whatever source stands behind either; an empty body does."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), SPACE + "+", " "), r"\s+[-–—]\s*[^-\s][^\s]*$", ""))

    def judged(x: Column) -> Column:
        t, b = x["t"], x["b"]
        near = (b.contains(t) & (F.length(b) - F.length(t) < 90)) | (t.contains(b) & (F.length(b) < 40))
        return F.when((t == "") | (b == ""), True).otherwise(near)

    told = let(F.struct(plain(title).alias("t"), plain(body).alias("b")), judged)
    return F.when(F.coalesce(body, F.lit("")) == "", True).when(F.coalesce(title, F.lit("")) == "", False).otherwise(told)


# Pairs of colours.
GRADIENTS = (("#0ea5e9", "#6366f1"), ("#10b981", "#0ea5e9"), ("#f59e0b", "#ef4444"), ("#8b5cf6", "#ec4899"))


def gradient(key: Column) -> Column:
    """One of the pairs of colours, by a 32-bit h * 31 + c hash of an ASCII key ("x" for none)."""
    text = F.coalesce(F.nullif(key, F.lit("")), F.lit("x"))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))
    signed = F.when(total >= 2147483648, total - 4294967296).otherwise(total)
    return F.get(F.array(*[F.array(*map(F.lit, g)) for g in GRADIENTS]), (F.abs(signed) % len(GRADIENTS)).cast("int"))


def day_shown(day: Column) -> Column:
    """MM/DD/YYYY of a date; "" for none."""
    return F.coalesce(F.date_format(day, "MM/dd/yyyy"), F.lit(""))


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` characters, an ellipsis last where some are lost."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def empty_message(search: Column, category: Column, n_sources: Column, period: Column) -> Column:
    """Why a list of stories is empty: search, category, sources, period or nothing yet, in this order."""
    return (
        F.when(F.coalesce(search, F.lit("")) != "", F.concat(F.lit("No stories match “"), search, F.lit("”. Try a different search or clear filters.")))
        .when(category != "all", "No stories in this category for the selected range. Try another category or range.")
        .when(n_sources > 0, "No stories from the selected sources for this range. Tap “All sources” to widen.")
        .when(period != "week", "No stories published yet for this range. Check back later or switch to “This week”.")
        .otherwise("Nothing here yet. New stories are added continuously throughout the day.")
    )


# Characters that set a publisher off, and what ends a title.
SEPARATORS = "–—|·:-"
TRAILING = rf"^(.+)[ \t]*[{SEPARATORS}][ \t{SEPARATORS}]*(.+?)[ \t]*$"


def clean_title(title: Column, aliases: list[str]) -> Column:
    """struct(title, publisher): known publishers at the end are cut off, three of them at most.

    `aliases` are normalised names; publisher is the first one that was cut off.
    """
    known = F.array(*map(F.lit, aliases))
    start = F.struct(F.trim(F.coalesce(title, F.lit(""))).alias("title"), F.lit(None).cast("string").alias("publisher"), F.lit(True).alias("go"))

    def once(s: Column) -> Column:
        tail = normalize_title(F.regexp_extract(s["title"], TRAILING, 2))
        head = F.trim(F.regexp_extract(s["title"], TRAILING, 1))
        head = F.trim(F.regexp_replace(head, rf"\s*[{SEPARATORS}]+\s*$", ""))

        def decided(x: Column) -> Column:
            ok = s["go"] & (F.length(x["tail"]) >= 2) & F.array_contains(known, x["tail"]) & (x["head"] != "")
            return F.struct(
                F.when(ok, x["head"]).otherwise(s["title"]).alias("title"),
                F.when(ok, F.coalesce(s["publisher"], x["tail"])).otherwise(s["publisher"]).alias("publisher"),
                ok.alias("go"),
            )

        return let(F.struct(head.alias("head"), tail.alias("tail")), decided)

    done = let(start, lambda a: let(once(a), lambda b: let(once(b), once)))
    return let(done, lambda s: F.struct(s["title"].alias("title"), s["publisher"].alias("publisher")))
