"""Article text from pages: an Arrow-batched UDF, as a tag scanner has no SQL form.

Script and style bodies and comments are raw text for the scanner, so a tag in a
script never closes an element of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORDS = 30
# Elements without article text, elements without an end, names of boilerplate, hosts and suffixes without articles.
BANNED = frozenset((
    "script", "style", "noscript", "nav", "header", "footer", "form", "head", "title", "meta", "link", "iframe", "embed", "object", "svg",
    "aside",
))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
BOILERPLATE = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adzone", "adslot", "bannerad", "sponsored", "sponsor", "cookie",
    "cookies", "cookiebanner", "consent", "gdpr", "privacynotice", "related", "recommended", "recommendations", "readmore", "morefrom",
    "youmayalso", "youmightalso", "popular", "trending", "mostread", "mustread", "outbrain", "taboola", "widget", "comment", "comments",
    "disqus", "commentcount", "social", "share", "sharing", "addthis", "sharethis", "sharebar", "sharebuttons", "sharelinks",
    "socialshare", "socialsharing", "sociallinks", "twitterwidget", "facebookwidget", "sidebar", "sidebox", "newsletter", "signup",
    "subscribe", "promo", "breadcrumb", "pagination", "authorbio", "skip",
)
SKIPPED_HOSTS = (
    "youtube.com", "youtu.be", "music.youtube.com", "twitter.com", "x.com", "t.co", "facebook.com", "instagram.com", "threads.net",
    "reddit.com", "tiktok.com", "snapchat.com", "pinterest.com", "linkedin.com", "twitch.tv", "vimeo.com", "dailymotion.com", "vk.com",
    "ok.ru", "tumblr.com", "mastodon.social",
)
SKIPPED_SUFFIXES = (
    "pdf", "mp3", "mp4", "m4a", "m4v", "mov", "avi", "zip", "tar", "gz", "rar", "7z", "png", "jpg", "jpeg", "gif", "webp", "avif", "svg",
    "ico", "css", "js", "json", "xml", "rss",
)
ENTITIES = (
    ("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"),
    ("copy", "©"), ("reg", "®"), ("trade", "™"), ("rsquo", "’"), ("lsquo", "‘"), ("ldquo", "“"), ("rdquo", "”"),
)

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attr = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_plain = set(BOILERPLATE)


def is_boilerplate(token: str) -> bool:
    """A known name, alone or before -, _ or a capital."""
    return token in _plain or any(token.startswith(b) and re.match("[-_A-Z]", token[len(b) :]) for b in _plain if len(b) < len(token))


def _marked(attributes: str) -> bool:
    return any(is_boilerplate(t) for m in _attr.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split())


def _raw_end(html: str, name: str, at: int) -> int:
    """Place behind the end tag of a raw-text element."""
    m = re.compile(rf"</{name}\s*>", re.I).search(html, at)
    return m.end() if m else len(html)


def events(html: str) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, element, start, end, attributes) of each tag; raw text elements and comments come as one `raw`."""
    at = 0
    while m := _token.search(html, at):
        at = m.end()
        if m[2] is None:
            yield "raw", "", m.start(), at, ""
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, m.start(), at, ""
        elif name in ("script", "style"):
            at = _raw_end(html, name, at)
            yield "raw", name, m.start(), at, ""
        else:
            single = name in VOID or m[3].rstrip().endswith("/")
            yield "single" if single else "open", name, m.start(), at, m[3]


def clean(html: str) -> str:
    """The page without banned and boilerplate elements."""
    out, at, stack, hidden = [], 0, [], None
    for kind, name, start, end, attributes in events(html):
        if hidden is None:
            out.append(html[at:start])
        drop = name in BANNED or (attributes and _marked(attributes))
        if kind == "open":
            stack.append(name)
            if hidden is None and drop:
                hidden = len(stack)
        elif kind == "close" and name in stack:
            while stack.pop() != name:
                pass
            if hidden is not None and len(stack) < hidden:
                hidden, at = None, end
                continue
        if hidden is None:
            out.append(" " if kind == "raw" or kind == "single" and drop else html[start:end])
        at = end
    if hidden is None:
        out.append(html[at:])
    return "".join(out)


def regions(html: str, wanted: str) -> list[str]:
    """Contents of the outermost elements of one name; one without an end reaches to the end of the page."""
    out, depth, begin = [], 0, 0
    for kind, name, start, end, _ in events(html):
        if name != wanted:
            continue
        if kind == "open":
            if not depth:
                begin = end
            elif wanted == "p":  # paragraphs do not nest
                out.append(html[begin:start])
                begin, depth = end, 0
            depth += 1
        elif kind == "close" and depth:
            depth -= 1
            if not depth:
                out.append(html[begin:start])
    if depth:
        out.append(html[begin:])
    return out


def decode(text: str) -> str:
    """Numbered entities first, then the named ones in order, so that &amp;lt; becomes <."""

    def char(code: int) -> str:
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""

    text = re.sub(r"(?i)&#x([0-9a-f]+);", lambda m: char(int(m[1], 16)), text)
    text = re.sub(r"&#(\d+);", lambda m: char(int(m[1])), text)
    for name, by in ENTITIES:
        text = re.sub(f"(?i)&{name};", lambda m, by=by: by, text)
    return text


def text_of(html: str) -> str:
    return " ".join(decode(re.sub(r"<[^>]*>", " ", html)).split())


def article(html: str | None, min_words: int = MIN_WORDS) -> str | None:
    """Text of the largest article, else main, else all paragraphs, else the page; null below `min_words` words."""
    if not html:
        return None
    page = clean(html)
    for element in ("article", "main"):
        found = [text_of(r) for r in regions(page, element)]
        best = max(found, key=lambda t: len(t.split()), default="")
        if len(best.split()) >= min_words:
            return best
    parts = [t for t in map(text_of, regions(page, "p")) if t]
    text = " ".join(parts) if parts else text_of(page)
    return text if len(text.split()) >= min_words else None


def _articles(html: pd.Series) -> pd.Series:
    return html.map(article, na_action="ignore")


def article_text(html: Column) -> Column:
    """`article` of each page, in Arrow batches."""
    return F.pandas_udf(_articles, "string")(html)


def skipped(url: Column) -> Column:
    """True for hosts and files that are no articles."""
    from .scalars import url_host, url_path

    hosts = "|".join(re.escape(h) for h in SKIPPED_HOSTS)
    host, path = url_host(url), url_path(url)
    return host.rlike(rf"(^|\.)({hosts})$") | path.rlike(rf"(?i)\.({'|'.join(SKIPPED_SUFFIXES)})$")


def accepts(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return (low == "") | low.contains("html") | low.startswith("text/")
