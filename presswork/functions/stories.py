"""Classification, scoring, summaries and scrubbing of stories, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lex
from .scalars import char_cap, js_round, let, located, sentences, tokens, word_count

EDGE, STOP = "(^|[^a-z0-9])", "($|[^a-z0-9])"


def haystack(*parts: Column) -> Column:
    """Non-empty parts joined and lower-cased."""
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " "))


def key_of(name: str) -> str:
    """The longest run of a-z and 0-9 in a name, by which it is looked up; the first of several."""
    return max(re.findall("[a-z0-9]+", name), key=len)


def words_in(text: Column, names: Sequence[str]) -> Column:
    """The keys of the names that are words of the lower-case text: one look-up for each word of it, whatever the number of names.

    A name that stands as a token has its key as a whole word of the text; so only names whose key is here need be looked for.
    """
    return F.array_intersect(F.split(text, "[^a-z0-9]+"), F.lit(sorted({key_of(n) for n in names})))


def every_name() -> list[str]:
    """All names and words that are looked for as tokens."""
    return sorted({*(n for names in lex.LEXICONS.values() for n in names), *(w for _, words in lex.TWELVE_CLASSES for w in words)})


def has_token(text: Column, words: Sequence[str], seen: Column) -> Column:
    """True if a word stands in the text with no a-z or 0-9 next to it; the pattern is only tried where a word's key is among `seen`."""
    some = F.arrays_overlap(seen, F.lit(sorted({key_of(w) for w in words})))
    return some & text.rlike(f"{EDGE}(?:{'|'.join(map(re.escape, words))}){STOP}")


def categorize(text: Column, rules=lex.FIVE_CLASSES) -> Column:
    """First of the five classes one of whose substrings is in the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in rules:
        hit = low.rlike("|".join(map(re.escape, words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("news")


def classify(text: Column, rules=lex.TWELVE_CLASSES, seen: Column | None = None) -> Column:
    """First of the twelve classes one of whose tokens is in the lower-case text; `seen` are its words that are keys, where known."""

    def first(known: Column) -> Column:
        out = None
        for name, words in rules:
            hit = has_token(text, words, known)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("other")

    return first(seen) if seen is not None else let(words_in(text, [w for _, words in rules for w in words]), first)


def bucket(subcategory: Column, buckets: dict[str, str] = lex.BUCKETS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])
    return F.coalesce(F.try_element_at(table, subcategory), F.lit("news"))


def word_case(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in name.split(" "))


def label_of(group: str, name: str) -> str:
    if group == "companies":
        return lex.COMPANY_LABELS.get(name) or word_case(name)
    if group == "countries":
        return word_case(lex.COUNTRY_LABELS.get(name, name))
    return lex.MODEL_LABELS.get(name) or word_case(name)


def entities(text: Column, group: str, names: Sequence[str] | None = None, seen: Column | None = None) -> Column:
    """Labels of the names that stand in the lower-case text, longest first.

    A name that stands as a token inside a longer one that was found is left out.
    The list is small, so which names contain which is settled here. The text's words are looked up once (`seen`, where
    known); a name's own pattern is tried only where its key is among them.
    """
    names = list(names if names is not None else lex.LEXICONS[group])
    names.sort(key=len, reverse=True)
    inside = lambda s, n: re.search(EDGE + re.escape(s) + STOP, n) is not None

    def found(known: Column) -> Column:
        hit = lambda n: F.array_contains(known, key_of(n)) & text.rlike(f"{EDGE}{re.escape(n)}{STOP}")
        labels = []
        for n in names:
            alone = hit(n)
            for wider in (o for o in names if len(o) > len(n) and inside(n, o)):
                alone = alone & ~hit(wider)
            labels.append(F.when(alone, F.lit(label_of(group, n))))
        some = F.array_compact(F.array(*labels))
        return F.when(F.size(known) > 0, some).otherwise(F.array().cast("array<string>"))

    return found(seen) if seen is not None else let(words_in(text, names), found)


def capitalised(words: Column) -> Column:
    """Each word of a name with a capital initial."""
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")


def tags(text: Column, models: Column, companies: Column, technologies: Column, people: Column, countries: Column) -> Column:
    """Up to six of the entities (each once, whatever its case) and topics."""
    every = F.concat(models, companies, technologies, people, countries)
    start = F.array().cast("array<string>")
    has = lambda acc, x: F.exists(acc, lambda y: F.lower(y) == x)
    once = F.aggregate(every, start, lambda acc, x: F.when(has(acc, F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    topics = F.array_compact(F.array(*[F.when(text.contains(t), F.lit(tag)) for t, tag in lex.TOPICS]))

    def added(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda y: (F.lower(y) == x) | (y == x))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(x)))

    return F.transform(F.slice(F.aggregate(topics, once, added), 1, 6), capitalised)


# The numbers of the five components of the signal.
IMPACT_UNKNOWN = 50
IMPACT_PER_SOURCE = 9
IMPACT_MOST_FOR_SOURCES = 18
NOVELTY_UNDATED = 55.0
NOVELTY_FLOOR = 20.0
NOVELTY_FLOORS = ((30, 8.0), (14, 14.0))  # beyond so many days
NOVELTY_DAYS = 2
RELIABILITY_UNKNOWN = 5.0
CREDIBILITY_WEIGHT = 0.92
CREDIBILITY_FOR_BODY = 6
RELEVANCE_BASE = 38
RELEVANCE_PER_TERM = 12
RELEVANCE_PER_ENTITY = 4
RELEVANCE_MOST_FOR_ENTITIES = 20
WEIGHT_UNKNOWN = 3.0
CONFIDENCE_WEIGHT = 0.9
CONFIDENCE_FOR_SOURCES = 8


def clamp(x: Column) -> Column:
    return F.least(F.greatest(js_round(x), F.lit(0)), F.lit(100)).cast("int")


def impact(subcategory: Column, n_sources: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in lex.IMPACT.items() for x in kv])
    more = F.least(F.lit(IMPACT_MOST_FOR_SOURCES), (n_sources - 1) * IMPACT_PER_SOURCE)
    known = F.coalesce(F.try_element_at(table, subcategory), F.lit(IMPACT_UNKNOWN))
    return clamp((known + F.when(n_sources > 1, more).otherwise(0)).cast("double"))


def novelty(published: Column, discovered: Column) -> Column:
    days = F.greatest((discovered.cast("timestamp").cast("double") - published.cast("timestamp").cast("double")) / 86400, F.lit(0.0))
    (old, oldest_floor), (stale, old_floor) = NOVELTY_FLOORS
    floor = F.when(days > old, oldest_floor).when(days > stale, old_floor).otherwise(NOVELTY_FLOOR)
    known = published.isNotNull() & discovered.isNotNull()
    return clamp(F.when(known, F.greatest(floor, F.exp(-days / NOVELTY_DAYS) * 100)).otherwise(NOVELTY_UNDATED))


def credibility(reliability: Column, has_body: Column) -> Column:
    share = F.coalesce(reliability.cast("double"), F.lit(RELIABILITY_UNKNOWN)) / 10 * 100
    return clamp(share * CREDIBILITY_WEIGHT + F.when(has_body, CREDIBILITY_FOR_BODY).otherwise(0))


def relevance(text: Column, n_entities: Column, terms: Sequence[str] = lex.RELEVANT) -> Column:
    hits = sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    of_terms = F.least(F.lit(100), RELEVANCE_BASE + hits * RELEVANCE_PER_TERM)
    return clamp((of_terms + F.least(F.lit(RELEVANCE_MOST_FOR_ENTITIES), n_entities * RELEVANCE_PER_ENTITY)).cast("double"))


def source_confidence(weight: Column, n_sources: Column) -> Column:
    share = (F.coalesce(weight.cast("double"), F.lit(WEIGHT_UNKNOWN)) - 1) / 4 * 100
    return clamp(share * CONFIDENCE_WEIGHT + F.when(n_sources > 1, CONFIDENCE_FOR_SOURCES).otherwise(0))


def signal(parts: dict[str, Column], weights: dict[str, float] = lex.WEIGHTS) -> Column:
    """The weighted sum of the components, rounded, 0 to 100."""
    total = None
    for name, w in weights.items():
        term = F.lit(w) * parts[name]
        total = term if total is None else total + term
    return js_round(total).cast("int")


def is_title_echo(title: Column, description: Column, from_aggregator: Column) -> Column:
    """True if an aggregator's description is the title and at most eight tokens more."""
    t, d = tokens(title), tokens(description)
    same = F.slice(d, 1, F.greatest(F.size(t), F.lit(1))) == t
    return from_aggregator & (F.size(t) > 0) & (F.size(d) > 0) & (F.size(d) <= F.size(t) + 8) & same


def body_text(content: Column, description: Column, echo: Column) -> Column:
    c, d = F.nullif(F.trim(content), F.lit("")), F.nullif(F.trim(description), F.lit(""))
    return F.coalesce(c, F.when(~F.coalesce(echo, F.lit(False)), d))


def extractive(
    body: Column, min_words: int = 6, max_chars: int = 280, max_sentences: int = 2, max_takeaways: int = 3, takeaway_chars: int = 140
) -> Column:
    """struct(summary, takeaways): the first sentences that fit, and the next ones that the summary has not used."""

    def made(parts: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("used"), F.lit(False).alias("done"))

        def take(acc: Column, s: Column) -> Column:
            longer = F.array_join(F.concat(acc["used"], F.array(s)), " ")
            full = acc["done"] | ((F.length(longer) > max_chars) & (F.size(acc["used"]) > 0)) | (F.size(acc["used"]) >= max_sentences)
            return F.struct(F.when(full, acc["used"]).otherwise(F.concat(acc["used"], F.array(s))).alias("used"), full.alias("done"))

        used = F.aggregate(parts, start, take, lambda acc: acc["used"])

        def finished(u: Column) -> Column:
            low = F.transform(u, F.lower)
            rest = F.slice(F.filter(parts, lambda s: ~F.array_contains(low, F.lower(s))), 1, max_takeaways)
            return F.struct(
                char_cap(F.nullif(F.array_join(u, " "), F.lit("")), max_chars).alias("summary"),
                F.transform(rest, lambda s: char_cap(s, takeaway_chars)).alias("takeaways"),
            )

        return let(used, finished)

    none = F.struct(F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("takeaways"))
    return F.when(body.isNull() | (word_count(body) < min_words), none).otherwise(let(sentences(body), made))


def is_grounded(answer: Column, source: Column) -> Column:
    """True if at least half of the answer's tokens of over three characters are substrings of the source."""
    long = F.filter(F.split(F.lower(answer), "[^a-z0-9]+"), lambda t: F.length(t) > 3)
    low = F.lower(source)
    hits = F.size(F.filter(long, lambda t: F.contains(low, t)))
    return F.coalesce((F.size(long) > 0) & (hits * 2 >= F.size(long)), F.lit(False))


# Shapes of credentials, and what stands in each of them. No word character may stand on either side.
CREDENTIALS = (
    ("github-classic-pat", "gh[opsu]_[0-9A-Za-z]{36}"),
    ("github-fine-grained-pat", "github_pat_[0-9A-Za-z_]{70,}"),
    ("huggingface-token", "hf_[0-9A-Za-z]{24,}"),
    ("openai-key", "sk-(?:proj-)?[0-9A-Za-z]{20,}"),
    ("aws-access-key-id", "(?:AKIA|ASIA)[0-9A-Z]{16}"),
)
MARKS = {
    "github-classic-pat": ("gho_", "ghp_", "ghs_", "ghu_"),
    "github-fine-grained-pat": ("github_pat_",),
    "huggingface-token": ("hf_",),
    "openai-key": ("sk-",),
    "aws-access-key-id": ("AKIA", "ASIA"),
}
PLACEHOLDER = "[redacted-credential]"


def credential_pattern(shape: str) -> str:
    return f"(?<![0-9A-Za-z_]){shape}(?![0-9A-Za-z_])"


def _may_hold(text: Column, name: str) -> Column:
    some = F.lit(False)
    for mark in MARKS[name]:
        some = some | text.contains(mark)
    return some


def scrub(text: Column) -> Column:
    """The text with each credential replaced; running it again changes nothing.

    A pattern is tried only where a text has the shape's mark.
    """

    def replaced(name: str, shape: str):
        return lambda t: F.when(_may_hold(t, name), F.regexp_replace(t, credential_pattern(shape), F.lit(PLACEHOLDER))).otherwise(t)

    for credential in CREDENTIALS:
        text = let(text, replaced(*credential))
    return text


def credentials(text: Column) -> Column:
    """array<struct<index, pattern, value>> of all credentials in a text, by place (code points) and pattern."""

    def of(t: Column, name: str, shape: str) -> Column:
        found = F.transform(
            located(t, credential_pattern(shape)), lambda m: F.struct(m["index"].alias("index"), F.lit(name).alias("pattern"), m["value"].alias("value"))
        )
        return F.when(_may_hold(t, name), found).otherwise(F.array().cast("array<struct<index:int,pattern:string,value:string>>"))

    return let(text, lambda t: F.array_sort(F.concat(*[of(t, *c) for c in CREDENTIALS])))


#: Text fields of a story that are scrubbed before it is stored.
SCRUBBED = ("title", "description", "author", "content")
SCRUBBED_AI = ("summary", "whyItMatters")


def scrub_stories(stories: DataFrame) -> DataFrame:
    """Stories with the credentials in their seven text fields replaced, and `scrubbed_fields`, how many of those changed.

    The fields are title, description, author, content, and summary, whyItMatters and keyTakeaways of `ai`; absent ones are left out.
    """
    changed, made = [], {}
    for name in (n for n in SCRUBBED if n in stories.columns):
        made[name] = scrub(F.col(name))
        changed.append(~made[name].eqNullSafe(F.col(name)))
    if "ai" in stories.columns:
        ai = F.col("ai")
        have = stories.schema["ai"].dataType.names
        for name in (n for n in SCRUBBED_AI if n in have):
            ai = ai.withField(name, scrub(F.col(f"ai.{name}")))
            changed.append(~scrub(F.col(f"ai.{name}")).eqNullSafe(F.col(f"ai.{name}")))
        if "keyTakeaways" in have:
            ai = ai.withField("keyTakeaways", F.transform("ai.keyTakeaways", scrub))
            changed.append(~F.transform("ai.keyTakeaways", scrub).eqNullSafe(F.col("ai.keyTakeaways")))
        made["ai"] = F.when(F.col("ai").isNotNull(), ai)
    total = sum((c.cast("int") for c in changed), F.lit(0))
    return stories.withColumn("scrubbed_fields", total).withColumns(made)


def scrub_statistics(scrubbed: DataFrame) -> DataFrame:
    """Stories that had a credential, and fields that changed."""
    n = F.col("scrubbed_fields")
    return scrubbed.agg(F.count_if(n > 0).alias("scrubbed_stories"), F.coalesce(F.sum(n), F.lit(0)).alias("changed_fields"))


ENTITY_GROUPS = ("companies", "people", "models", "technologies", "countries")


def classify_stories(stories: DataFrame) -> DataFrame:
    """Stories with subcategory, category (its bucket), the five entity lists and tags, from title, description and content."""
    parts = [F.col(c) for c in ("title", "description", "content") if c in stories.columns]
    low = stories.withColumn("_low", haystack(*parts)).withColumn("_seen", words_in(F.col("_low"), every_name()))
    known = F.col("_low"), F.col("_seen")
    got = low.withColumns({g: entities(known[0], g, seen=known[1]) for g in ENTITY_GROUPS}).withColumn("subcategory", classify(known[0], seen=known[1]))
    listed = [F.col(c) for c in ("models", "companies", "technologies", "people", "countries")]
    return got.withColumns({"category": bucket(F.col("subcategory")), "tags": tags(F.col("_low"), *listed)}).drop("_low", "_seen")


def score_stories(stories: DataFrame, n_sources: Column) -> DataFrame:
    """Stories with `scores`, the `signal` and the legacy `score` (signal / 20); those without a class are classified first.

    Read are title, description, content, published, discovered, reliability and weight.
    """
    if "subcategory" not in stories.columns:
        stories = classify_stories(stories)
    text = haystack(*[F.col(c) for c in ("title", "description", "content") if c in stories.columns])
    body = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("content", "description") if c in stories.columns])
    n = F.size("companies") + F.size("models") + F.size("technologies")
    parts = {
        "impact": impact(F.coalesce("subcategory", classify(text)), n_sources),
        "novelty": novelty(F.col("published"), F.col("discovered")),
        "credibility": credibility(F.col("reliability"), body.isNotNull()),
        "relevance": relevance(text, n),
        "source_confidence": source_confidence(F.col("weight"), n_sources),
    }
    got = stories.withColumn("scores", F.struct(*[c.alias(k) for k, c in parts.items()]))
    got = got.withColumn("signal", signal({k: F.col(f"scores.{k}") for k in parts}))
    return got.withColumn("score", F.col("signal") / 20)
