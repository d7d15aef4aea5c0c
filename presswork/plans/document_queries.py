"""Queries over stories that are projected from documents and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import lexicons as lex
from presswork.functions import scalars as N
from presswork.functions import stories as S
from presswork.operators import cluster

from .projections import DOCUMENT_SQL, PLANTED_SQL, document_stories, planted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DS = f"WITH ds AS ({DOCUMENT_SQL})"
PL = f"WITH pl AS (SELECT doc_id AS id, source, lower({PLANTED_SQL}) AS low, {PLANTED_SQL} AS x FROM documents)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
KEY = f"coalesce({HOST} || '/' || array_to_string(list_filter(string_split(lower({PATH}), '/'), lambda s: s <> '')[1:2], '/'), '')"
FP = f"substr({NORM.format('title')} || '|' || {KEY}, 1, 200)"
DJB2 = (
    "'s' || printf('%08x', list_reduce(list_prepend(5381::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), "
    "lambda h, c: (h * 33 + c) & 4294967295))"
)


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", N.url_host(F.col("url")).alias("host"))


@query(f"SELECT page_id, {KEY} AS key FROM pages")
def url_key(spark, d):
    return table(spark, d, "pages").select("page_id", N.canonical_url_key(F.col("url")).alias("key"))


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) ||
    CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END ||
    coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
       lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)(utm_[^=]*|fbclid|gclid|ref_src)(=|$)')), '&'), ''), '') || regexp_extract(url, '(#.*)$', 1) AS canonical FROM pages"""
)
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", N.canonical_url(F.col("url")).alias("canonical"))


@query(
    rf"""SELECT page_id, {HOST} || regexp_replace(regexp_replace(lower({PATH}), '/{{2,}}', '/', 'g'), '/$', '') ||
    CASE WHEN regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS key FROM pages"""
)
def cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", N.cache_key(F.col("url")).alias("key"))


@query(f"{DS} SELECT id, {NORM.format('title')} AS norm FROM ds")
def normalize_title(spark, d):
    return document_stories(spark, d).select("id", N.normalize_title(F.col("title")).alias("norm"))


@query(f"{DS}, k AS (SELECT id, {FP} AS fp FROM ds) SELECT id, fp AS fingerprint, {DJB2.format('fp')} AS story_id FROM k")
def story_ids(spark, d):
    ds = document_stories(spark, d)
    return ds.select("id", N.fingerprint(F.col("title"), F.col("url")).alias("fingerprint"), N.story_id(F.col("title"), F.col("url")).alias("story_id"))


ALIASES = lex.publisher_aliases()
SETS_OFF = "–—|·:-"


def clean_sql(source: str, column: str) -> str:
    """CTEs c0 to c3 over a table with id: three rounds that cut a known publisher off a title; c3 has id, t (clean) and publisher."""
    split = f"^(.+)[ \t]*[{SETS_OFF}][ \t{SETS_OFF}]*(.+?)[ \t]*$"
    out = [f"c0 AS (SELECT id, trim(coalesce({column}, '')) AS t, NULL::varchar AS publisher, true AS go FROM {source})"]
    for k in range(3):
        tail = NORM.format(f"regexp_extract(t, '{split}', 2)")
        head = f"trim(regexp_replace(trim(regexp_extract(t, '{split}', 1)), '\\s*[{SETS_OFF}]+\\s*$', ''))"
        out.append(
            f"""c{k + 1} AS (SELECT id, CASE WHEN ok THEN head ELSE t END AS t, CASE WHEN ok THEN coalesce(publisher, tail) ELSE publisher END AS publisher, ok AS go
            FROM (SELECT *, go AND length(tail) >= 2 AND list_contains({listed(ALIASES)}, tail) AND head <> '' AS ok
                  FROM (SELECT *, {tail} AS tail, {head} AS head FROM c{k})))"""
        )
    return ", ".join(out)


SUFFIXED = f"title || ' - ' || {listed(ALIASES)}[1 + id % {len(ALIASES)}] || CASE WHEN id % 7 = 0 THEN ' | Unknown Paper' WHEN id % 5 = 0 THEN ' - - Reuters' ELSE '' END"


@query(f"{DS}, s AS (SELECT id, {SUFFIXED} AS full_title FROM ds), {clean_sql('s', 'full_title')} SELECT id, publisher, t AS title FROM c3")
def strip_publisher_suffix(spark, d):
    """Every title, with each of the known names behind it in turn, some behind an unknown paper and some before another one."""
    ds = document_stories(spark, d)
    name = F.get(F.array(*map(F.lit, ALIASES)), (F.col("id") % len(ALIASES)).cast("int"))
    more = F.when(F.col("id") % 7 == 0, " | Unknown Paper").when(F.col("id") % 5 == 0, " - - Reuters").otherwise("")
    got = ds.select("id", N.clean_title(F.concat("title", F.lit(" - "), name, more), ALIASES).alias("c"))
    return got.select("id", "c.publisher", "c.title")


@query(
    f"""{DS}, k AS (SELECT id, {FP} AS fingerprint FROM ds)
    SELECT id, fingerprint FROM k WHERE fingerprint <> '|' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1"""
)
def exact_dedupe(spark, d):
    return cluster.exact_dedupe(document_stories(spark, d)).select("id", "fingerprint")


WORDS = f"list_filter(string_split({NORM.format('title')}, ' '), lambda w: w <> '')"
CORE = f"list_filter({WORDS}, lambda w: NOT list_contains({listed(sorted({*lex.STOPWORDS, *lex.LOW_INFO}))}, w))"
MEANINGFUL = f"list_filter({WORDS}, lambda w: NOT list_contains({listed(lex.STOPWORDS)}, w))"


@query(f"{DS} SELECT id, {MEANINGFUL} AS meaningful, {CORE} AS core FROM ds")
def core_tokens(spark, d):
    ds = document_stories(spark, d)
    return ds.select("id", cluster.meaningful(F.col("title")).alias("meaningful"), cluster.core(F.col("title")).alias("core"))


HEADS = f"""heads AS (SELECT id, published AS at, list_sort(list_distinct({CORE})) AS t FROM ds WHERE len({CORE}) >= 2 AND len({MEANINGFUL}) >= 2)"""
J = "len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t)))"


@query(
    f"""{DS}, {HEADS}, s AS (SELECT DISTINCT t, array_to_string(t, ' ') AS s FROM heads)
    SELECT a.s AS a, b.s AS b, {J} AS jaccard FROM s a JOIN s b ON a.s < b.s AND {J} >= 0.7"""
)
def similar_titles(spark, d):
    return cluster.similar_sets(cluster.headlines(document_stories(spark, d)))


CLUSTER_SQL = f"""WITH RECURSIVE ds0 AS ({DOCUMENT_SQL}),
    ds AS (SELECT * FROM (SELECT *, {FP} AS fingerprint FROM ds0) WHERE fingerprint <> '|' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1),
    {HEADS}, e AS (SELECT a.id AS u, b.id AS v FROM heads a JOIN heads b ON a.id <> b.id AND {J} >= 0.7
        AND coalesce(abs(epoch(a.at) - epoch(b.at)) <= 72 * 3600, true)),
    reach AS (SELECT id AS u, id AS v FROM ds UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v),
    c AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u),
    m AS (SELECT ds.*, root, row_number() OVER (PARTITION BY root ORDER BY reliability DESC NULLS LAST, published NULLS FIRST, length(title) DESC, id) AS k,
          count(*) OVER (PARTITION BY root) AS size FROM ds JOIN c USING (id)),
    n AS (SELECT root, count(DISTINCT source_id)::bigint AS n_sources FROM m GROUP BY root)"""


@query(f"{CLUSTER_SQL} SELECT id, root, k = 1 AS canonical, size::bigint AS size, n_sources FROM m JOIN n USING (root)")
def cluster_canonical(spark, d):
    return cluster.cluster(document_stories(spark, d).drop("description")).select("id", "root", "canonical", "size", "n_sources")


@query(
    f"""{CLUSTER_SQL} SELECT (SELECT count(*) FROM documents)::bigint AS input, sum(size)::bigint AS after_exact, count(*)::bigint AS clusters,
    count(*) FILTER (n_sources > 1)::bigint AS multi_source, max(size)::bigint AS largest FROM m JOIN n USING (root) WHERE k = 1"""
)
def cluster_stats(spark, d):
    ds = document_stories(spark, d).drop("description")  # whole texts, which would be sorted and written with each story
    return cluster.statistics(cluster.cluster(ds), table(spark, d, "documents").count())


def planted_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    text = planted(F.col("text"), F.col("doc_id"))
    return docs.select(F.col("doc_id").alias("id"), "source", text.alias("x"), F.lower(text).alias("low"))


def has(words) -> str:
    import re

    words = (words,) if isinstance(words, str) else words
    return f"regexp_matches(low, {quoted('(^|[^a-z0-9])(?:' + '|'.join(map(re.escape, words)) + ')($|[^a-z0-9])')})"


FIVE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(low, {quoted(w)})" for w in words) + f" THEN '{name}'" for name, words in lex.FIVE_CLASSES
) + " ELSE 'news' END"
TWELVE = "CASE " + " ".join(f"WHEN {has(words)} THEN '{name}'" for name, words in lex.TWELVE_CLASSES) + " ELSE 'other' END"
BUCKET = "CASE sub " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.BUCKETS.items()) + " ELSE 'news' END"


@query(f"{PL} SELECT id, {FIVE} AS category FROM pl")
def categorize_five(spark, d):
    return planted_docs(spark, d).select("id", S.categorize(F.col("x")).alias("category"))


@query(f"{PL}, c AS (SELECT id, {TWELVE} AS sub FROM pl) SELECT id, sub AS subcategory, {BUCKET} AS category FROM c")
def classify_twelve(spark, d):
    got = planted_docs(spark, d).select("id", S.classify(F.col("low")).alias("subcategory"))
    return got.withColumn("category", S.bucket(F.col("subcategory")))


def entity_sql(group: str) -> str:
    """Labels found, longest name first, without names inside longer ones that were found."""
    import re

    names = sorted(lex.LEXICONS[group], key=len, reverse=True)
    inside = lambda s, n: re.search(f"(^|[^a-z0-9]){re.escape(s)}($|[^a-z0-9])", n)
    parts = []
    for n in names:
        wider = [o for o in names if len(o) > len(n) and inside(n, o)]
        no = "".join(f" AND NOT {has(o)}" for o in wider)
        parts.append(f"CASE WHEN contains(low, {quoted(n)}) AND {has(n)}{no} THEN {quoted(S.label_of(group, n))} END")
    return f"list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL)"


ENT = {g: entity_sql(g) for g in lex.LEXICONS}


@query(f"{PL} SELECT id, {', '.join(f'{sql} AS {g}' for g, sql in ENT.items())} FROM pl")
def lexicon_entities(spark, d):
    docs = planted_docs(spark, d).withColumn("seen", S.words_in(F.col("low"), S.every_name()))
    return docs.select("id", *[S.entities(F.col("low"), g, seen=F.col("seen")).alias(g) for g in lex.LEXICONS])


def once_sql(items: str) -> str:
    """The first of each value of a list, whatever its case."""
    return f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda y: lower(y)), lower(x)) = i)"


TOPIC_TAGS = "list_filter([" + ", ".join(f"CASE WHEN contains(low, {quoted(t)}) THEN {quoted(tag)} END" for t, tag in lex.TOPICS) + "], lambda v: v IS NOT NULL)"
# a topic is new if no tag is the same, neither as it stands nor in lower case
NEW_TOPICS = "list_filter(topics, lambda x: NOT list_contains(ents, x) AND NOT list_contains(list_transform(ents, lambda y: lower(y)), x))"
TAGS_SQL = f"""SELECT id, list_transform(list_concat(ents, {NEW_TOPICS})[1:6],
    lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS tags
    FROM (SELECT *, {once_sql('every')} AS ents FROM (SELECT id, list_concat(list_concat(list_concat({ENT['models']}, {ENT['companies']}), list_concat({ENT['technologies']}, {ENT['people']})), {ENT['countries']}) AS every,
          {TOPIC_TAGS} AS topics FROM pl))"""


@query(f"{PL} {TAGS_SQL}")
def tags(spark, d):
    docs = planted_docs(spark, d).withColumn("seen", S.words_in(F.col("low"), S.every_name()))
    got = docs.select("id", "low", *[S.entities(F.col("low"), g, seen=F.col("seen")).alias(g) for g in lex.LEXICONS])
    c = [F.col(g) for g in ("models", "companies", "technologies", "people", "countries")]
    return got.select("id", S.tags(F.col("low"), *c).alias("tags"))


RELEVANT = " + ".join(f"(CASE WHEN contains(low, {quoted(t)}) THEN 1 ELSE 0 END)" for t in lex.RELEVANT)
IMPACT = "CASE sub " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lex.IMPACT.items()) + " ELSE 50 END"


@query(
    f"""{PL}, c AS (SELECT id, {TWELVE} AS sub, {RELEVANT} AS hits, len({ENT['companies']}) + len({ENT['models']}) + len({ENT['technologies']}) AS ents,
        1 + id % 3 AS n_sources, (1 + id % 9)::int AS reliability, (1 + id % 5)::int AS weight FROM pl),
    a AS (SELECT c.*, e.ts AS published, TIMESTAMP '2024-01-31 00:00:00' AS discovered FROM c LEFT JOIN events e ON e.event_id = c.id),
    p AS (SELECT id, least(100, {IMPACT} + CASE WHEN n_sources > 1 THEN least(18, (n_sources - 1) * 9) ELSE 0 END)::int AS impact,
        CASE WHEN published IS NULL THEN 55 ELSE least(100, floor(greatest(CASE WHEN age > 30 THEN 8.0::double WHEN age > 14 THEN 14.0::double ELSE 20.0::double END, exp(-age / 2) * 100) + 0.5))::int END AS novelty,
        least(100, floor(reliability::double / 10 * 100 * 0.92::double + 6 + 0.5))::int AS credibility,
        least(100, least(100, 38 + hits * 12) + least(20, ents * 4))::int AS relevance,
        least(100, floor((weight::double - 1) / 4 * 100 * 0.9::double + CASE WHEN n_sources > 1 THEN 8 ELSE 0 END + 0.5))::int AS source_confidence
      FROM (SELECT *, greatest((epoch(discovered) - epoch(published)) / 86400::double, 0) AS age FROM a))
    SELECT *, floor(0.3::double * impact + 0.25::double * novelty + 0.2::double * credibility + 0.15::double * relevance + 0.1::double * source_confidence + 0.5)::int AS signal FROM p"""
)
def score_components(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("published"))
    docs = planted_docs(spark, d).withColumn("seen", S.words_in(F.col("low"), S.every_name()))
    x = docs.join(events, "id", "left")
    low, seen, n = F.col("low"), F.col("seen"), 1 + F.col("id") % 3
    ents = sum((F.size(S.entities(low, g, seen=seen)) for g in ("companies", "models", "technologies")), F.lit(0))
    got = x.select(
        "id",
        S.impact(S.classify(low, seen=seen), n).alias("impact"),
        S.novelty(F.col("published"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("novelty"),
        S.credibility(1 + F.col("id") % 9, F.lit(True)).alias("credibility"),
        S.relevance(low, ents).alias("relevance"),
        S.source_confidence(1 + F.col("id") % 5, n).alias("source_confidence"),
    )
    return got.withColumn("signal", S.signal({k: F.col(k) for k in lex.WEIGHTS}))


SENT = r"list_filter(list_transform(string_split(regexp_replace(trim({0}), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s)), lambda s: s <> '')"


@query(rf"SELECT doc_id AS id, {SENT.format('text')} AS s, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::int AS n_words FROM documents")
def split_sentences(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), N.sentences(F.trim("text")).alias("s"), N.word_count(F.col("text")).alias("n_words"))


def cap_sql(x: str, n: int) -> str:
    """Cut at the last blank before the limit."""
    cut = f"substr({x}, 1, {n})"
    back = f"strpos(reverse({cut}), ' ')"
    shorter = f"CASE WHEN {back} > 0 AND {back} < {n} THEN substr({cut}, 1, {n} - {back}) ELSE {cut} END"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace({shorter}, '[.,;:]$', '') END"


@query(
    rf"""WITH s AS (SELECT doc_id AS id, {SENT.format('text')} AS s, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM documents),
    u AS (SELECT id, s, n, CASE WHEN n < 6 OR len(s) = 0 THEN [] WHEN len(s) > 1 AND length(s[1] || ' ' || s[2]) <= 280 THEN s[1:2] ELSE s[1:1] END AS used FROM s),
    t AS (SELECT id, array_to_string(used, ' ') AS x, used, CASE WHEN n < 6 THEN [] ELSE
        list_filter(s, lambda q: NOT list_contains(list_transform(used, lambda y: lower(y)), lower(q)))[1:3] END AS rest FROM u)
    SELECT id, CASE WHEN len(used) > 0 THEN {cap_sql('x', 280)} END AS summary, list_transform(rest, lambda q: {cap_sql('q', 140)}) AS takeaways FROM t"""
)
def extractive_summary(spark, d):
    docs = table(spark, d, "documents")
    body = S.body_text(F.lit(None).cast("string"), F.col("text"), F.lit(False))
    return docs.select(F.col("doc_id").alias("id"), S.extractive(body).alias("e")).select("id", "e.summary", "e.takeaways")


TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


@query(
    f"""{DS}, t AS (SELECT id, {TOK.format('title')} AS t, {TOK.format("title || CASE WHEN id % 2 = 0 THEN ' Some Publisher' ELSE ' and a lot more words than a publisher would ever have here' END")} AS d, id % 3 <> 0 AS agg FROM ds)
    SELECT id, agg AND len(t) > 0 AND len(d) > 0 AND len(d) <= len(t) + 8 AND d[1:len(t)] = t AS echo FROM t"""
)
def title_echo(spark, d):
    ds = document_stories(spark, d)
    more = F.when(F.col("id") % 2 == 0, " Some Publisher").otherwise(" and a lot more words than a publisher would ever have here")
    return ds.select("id", S.is_title_echo(F.col("title"), F.concat("title", more), F.col("id") % 3 != 0).alias("echo"))


@query(
    f"""{DS}, t AS (SELECT id, lower(coalesce(description, '')) AS src, list_filter(regexp_split_to_array(lower(title || ' unrelated words added here'), '[^a-z0-9]+'), lambda t: length(t) > 3) AS t FROM ds)
    SELECT id, len(t) > 0 AND 2 * len(list_filter(t, lambda w: contains(src, w))) >= len(t) AS grounded FROM t"""
)
def grounding_check(spark, d):
    ds = document_stories(spark, d)
    answer = F.concat("title", F.lit(" unrelated words added here"))
    return ds.select("id", S.is_grounded(answer, F.coalesce("description", F.lit(""))).alias("grounded"))


@query(
    # edit distance counts bytes in DuckDB, so both sides see ASCII only
    rf"""{DS}, t AS (SELECT id, trim(regexp_replace(title, '[^\x00-\x7F]', '_', 'g')) AS t, trim(regexp_replace(CASE id % 3 WHEN 0 THEN title WHEN 1 THEN title || '!' ELSE coalesce(substr(description, 1, 120), '') END, '[^\x00-\x7F]', '_', 'g')) AS s FROM ds)
    SELECT id, CASE WHEN s = '' THEN true WHEN t = '' THEN false
      ELSE lower(s) = lower(t) OR 1 - levenshtein(lower(s), lower(t))::double / greatest(length(s), length(t)) > 0.85 END AS redundant FROM t"""
)
def redundant_summary(spark, d):
    ds = document_stories(spark, d)
    s = F.when(F.col("id") % 3 == 0, F.col("title")).when(F.col("id") % 3 == 1, F.concat("title", F.lit("!")))
    s = s.otherwise(F.coalesce(F.substring("description", 1, 120), F.lit("")))
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "_")
    return ds.select("id", N.is_redundant(ascii_(s), ascii_(F.col("title"))).alias("redundant"))


# shapes are put together here, so that no credential-like literal is in the repository
SHAPES = [("hf" + "_", 30), ("sk" + "-", 24), ("AK" + "IA", 16), ("gh" + "p_", 36), ("github" + "_pat_", 75)]
KEYS = [f"key {p}{'A1B2C3D4E5' * 8}"[: 4 + len(p) + n] + "." for p, n in SHAPES]
EDGED = f"coalesce(text, '') || ' ' || {listed(KEYS)}[1 + doc_id % {len(KEYS)}]"
SCRUB = "coalesce(text, '') || ' key [redacted-credential].'"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = F.get(F.array(*map(F.lit, KEYS)), (F.col("doc_id") % len(KEYS)).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), key).alias("x"))


def scrub_sql(x: str) -> str:
    """RE2 has no lookaround: \\b is ASCII there, which is what is asked for."""
    for _, shape in S.CREDENTIALS:
        x = rf"regexp_replace({x}, '\b{shape}\b', '{S.PLACEHOLDER}', 'g')"
    return x


@query(f"SELECT doc_id AS id, {scrub_sql(EDGED)} AS x FROM documents")
def scrub_credentials(spark, d):
    return keyed(spark, d).select("id", S.scrub(F.col("x")).alias("x"))


@query(
    "WITH k AS (SELECT doc_id AS id, length(coalesce(text, '')) + 5 AS place, " + EDGED + " AS x FROM documents) "
    + " UNION ALL ".join(rf"SELECT id, place::int AS index, '{n}' AS pattern, unnest(regexp_extract_all(x, '\b{shape}\b')) AS value FROM k" for n, shape in S.CREDENTIALS)
)
def credential_matches(spark, d):
    return keyed(spark, d).select("id", F.inline(S.credentials(F.col("x"))))


STRIP = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    STRIP = f"replace({STRIP}, '{_e}', '{_c}')"
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


# pages have one article and nothing hidden in it; entities are decoded in the order of the list
ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"
for _e, _c in H.ENTITIES:
    ARTICLE = f"regexp_replace({ARTICLE}, '&{_e};', {quoted(_c)}, 'gi')"
ARTICLE = f"trim(regexp_replace({ARTICLE}, '{SPACES}', ' ', 'g'))"
ARTICLES = f"""SELECT page_id, url, CASE WHEN n >= {H.MIN_WORDS} THEN t END AS text, CASE WHEN n >= {H.MIN_WORDS} THEN n ELSE 0 END::int AS n_words
    FROM (SELECT *, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS n FROM (SELECT page_id, url, {ARTICLE} AS t FROM pages))"""
NO_HOST = r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in H.SKIPPED_HOSTS) + ")$"
NO_FILE = rf"(?i)\.({'|'.join(H.SKIPPED_SUFFIXES)})$"


@query(f"SELECT page_id, regexp_matches({HOST}, '{NO_HOST}') OR regexp_matches({PATH}, '{NO_FILE}') AS skipped, text, n_words FROM ({ARTICLES})")
def extract_article_text(spark, d):
    pages = table(spark, d, "pages")
    text = H.article_text(F.col("html"))
    return pages.select("page_id", H.skipped(F.col("url")).alias("skipped"), text.alias("text")).withColumn("n_words", N.word_count(F.col("text")))


@query(f"SELECT page_id, trim(regexp_replace({STRIP}, '{SPACES}', ' ', 'g')) AS text FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", N.strip_html(F.col("html")).alias("text"))


@query("""SELECT page_id, nullif(regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), '') AS image FROM pages""")
def first_image(spark, d):
    return table(spark, d, "pages").select("page_id", N.first_image(F.col("html")).alias("image"))
