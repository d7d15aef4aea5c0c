"""Queries over stories that are projected from events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.scalars import band, one_decimal
from presswork.operators import dashboard, entities, health, search, trends

from .projections import EVENT_SQL, event_stories, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-20 12:00:00"
EV = f"WITH ev AS ({EVENT_SQL}), d AS (SELECT *, published::date AS day FROM ev)"
BAND = "CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END"
AVG1 = "floor(avg(score) * 10 + 0.5)::double / 10"
PERIOD = "(SELECT max(day) FROM d)"


def query(sql: str | None = None, ev: bool = True):
    def add(fn):
        QUERIES[fn.__name__] = (lambda spark, d: fn(event_stories(spark, d))) if ev else fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(
    f"""{EV}, spine AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::date AS day),
    per AS (SELECT day, count(*) AS n, {AVG1} AS avg_score, {", ".join(f"count(*) FILTER ({BAND} = '{b}') AS {b}" for b in trends.BANDS)} FROM d GROUP BY day)
    SELECT spine.day, avg_score, coalesce(n, 0)::bigint AS n, {", ".join(f"coalesce({b}, 0)::bigint AS {b}" for b in trends.BANDS)}
    FROM spine LEFT JOIN per USING (day)"""
)
def daily_series_dense(ev):
    return trends.daily_series(ev)


for _p, _back in (("all", None), ("30d", 29), ("7d", 6)):
    _from = "min(day)" if _back is None else f"max(day) - {_back}"
    QUERIES[f"window_bounds_{_p}"] = lambda spark, d, p=_p: trends.window_bounds(event_stories(spark, d), p)
    SQL[f"window_bounds_{_p}"] = f"{EV} SELECT ({_from})::date AS from_day, max(day) AS to_day FROM d"


@query(f"{EV} SELECT id, day, score FROM d WHERE day BETWEEN {PERIOD} - 6 AND {PERIOD}")
def window_items_7d(ev):
    return trends.window_items(ev, "7d").select("id", "day", "score")


@query(f"{EV} SELECT {BAND} AS band, count(*)::bigint AS n FROM d GROUP BY 1")
def band_distribution(ev):
    return trends.band_distribution(ev)


@query(
    f"""{EV}, per AS (SELECT coalesce(category, 'other') AS category, count(*)::bigint AS n FROM d GROUP BY 1)
    SELECT category, n, floor(n * 1000 / sum(n) OVER () + 0.5)::double / 10 AS pct,
           (row_number() OVER (ORDER BY coalesce(list_position(['research', 'product', 'funding', 'policy', 'news'], category), 6), category))::int AS position
    FROM per"""
)
def category_mix(ev):
    return trends.category_mix(ev)


MENTIONS = "SELECT trim(unnest(companies)) AS name, * EXCLUDE (companies) FROM d"


@query(f"{EV} SELECT name, count(*)::bigint AS n FROM ({MENTIONS}) WHERE name <> '' GROUP BY name ORDER BY n DESC, name LIMIT 8")
def top_companies(ev):
    return trends.top(trends.count_by(ev, "companies"))


@query(f"{EV} SELECT source_id, count(*)::bigint AS n, arg_min(source_name, id) AS source_name FROM d GROUP BY 1")
def source_counts(ev):
    return trends.source_counts(ev)


@query(
    f"""{EV}, per AS (SELECT name, count(*) FILTER ({PERIOD} - day BETWEEN 0 AND 6)::bigint AS current,
                             count(*) FILTER ({PERIOD} - day BETWEEN 7 AND 13)::bigint AS prior FROM ({MENTIONS}) GROUP BY name),
    rated AS (SELECT *, CASE WHEN prior > 0 THEN floor((current - prior) * 1000.0::double / prior + 0.5)::double / 10 END AS pct,
                     CASE WHEN prior = 0 THEN 'new' WHEN current > prior THEN 'up' WHEN current < prior THEN 'down' ELSE 'flat' END AS direction
              FROM per WHERE current > 0 OR prior > 0)
    SELECT *, (row_number() OVER (ORDER BY CASE WHEN direction = 'new' THEN 1 ELSE pct END DESC, current DESC, name))::int AS rank FROM rated"""
)
def trending_companies(ev):
    return trends.trending(ev, "companies")


@query(f"{EV} SELECT day, count(*)::bigint AS n FROM d GROUP BY day ORDER BY n DESC, day LIMIT 1")
def peak_day(ev):
    return trends.peak_day(trends.daily_series(ev))


@query(f"{EV} SELECT count(DISTINCT day)::bigint AS active_days, (max(day) - min(day) + 1)::bigint AS days FROM d")
def active_days(ev):
    return trends.active_days(trends.daily_series(ev))


@query(
    f"""{EV}, b AS (SELECT {BAND} AS band, count(*)::bigint AS n FROM d GROUP BY 1)
    SELECT band, n FROM b ORDER BY n DESC, list_position(['high', 'medium', 'low', 'unknown'], band) LIMIT 1"""
)
def dominant_band(ev):
    return trends.dominant_band(ev)


@query(
    f"""{EV}, b AS (SELECT {BAND} AS band, count(*) AS n FROM d GROUP BY 1)
    SELECT 'stories' AS label, count(*)::varchar AS value FROM d
    UNION ALL SELECT 'average score', ({AVG1})::varchar FROM d
    UNION ALL (SELECT 'peak day', day::varchar FROM d GROUP BY day ORDER BY count(*) DESC, day LIMIT 1)
    UNION ALL SELECT 'active days', count(DISTINCT day)::varchar FROM d
    UNION ALL (SELECT 'dominant band', band FROM b ORDER BY n DESC, list_position(['high', 'medium', 'low', 'unknown'], band) LIMIT 1)
    UNION ALL (SELECT 'top category', category FROM d GROUP BY category ORDER BY count(*) DESC,
               list_position(['research', 'product', 'funding', 'policy', 'news'], category) LIMIT 1)
    UNION ALL (SELECT 'top company', name FROM ({MENTIONS}) GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)
    UNION ALL (SELECT 'top source', source_id FROM d GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 1)"""
)
def trend_facts(ev):
    return trends.facts(ev)


@query(
    f"""{EV}, w AS (SELECT * FROM d WHERE day BETWEEN {PERIOD} - 6 AND {PERIOD})
    SELECT name, count(*)::bigint AS n FROM (SELECT trim(unnest(companies)) AS name FROM w) GROUP BY name ORDER BY n DESC, name LIMIT 8"""
)
def report_7d_companies(ev):
    return trends.report(ev, "7d")["companies"]


@query(
    f"""{EV} SELECT 'category' AS facet, category AS value FROM d WHERE category <> '' GROUP BY category
    UNION ALL SELECT 'companies', v FROM (SELECT DISTINCT unnest(companies) AS v FROM d)
    UNION ALL SELECT 'models', v FROM (SELECT DISTINCT unnest(models) AS v FROM d)
    UNION ALL SELECT 'technologies', v FROM (SELECT DISTINCT unnest(technologies) AS v FROM d)
    UNION ALL SELECT 'source', v FROM (SELECT source_id AS v FROM d UNION SELECT source_name FROM d)
    UNION ALL SELECT 'first_day', min(day)::varchar FROM d UNION ALL SELECT 'last_day', max(day)::varchar FROM d"""
)
def search_facets(ev):
    return search.facets(ev)


REQUEST = search.Request(
    first_day=date(2024, 1, 5), last_day=date(2024, 1, 25), categories=("Research", "news"), importance=("high", "low"),
    companies=("C1", "c3", "c7"), sources=("src1", "source 3", "src7", "src10"), page=2, size=20,
)


@query(
    f"""{EV}, f AS (SELECT * FROM d WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND category IN ('research', 'news')
        AND CASE WHEN score IS NULL THEN 'low' ELSE {BAND} END IN ('high', 'low') AND list_has_any(companies, ['c1', 'c3', 'c7'])
        AND (source_id IN ('src1', 'src7', 'src10') OR lower(source_name) = 'source 3')),
    p AS (SELECT greatest(1, ceil(count(*) / 20.0))::bigint AS pages FROM f),
    r AS (SELECT *, row_number() OVER (ORDER BY coalesce(score, -1) DESC, published DESC NULLS LAST, id) AS k FROM f)
    SELECT id, score, day FROM r, p WHERE k > (least(2, pages) - 1) * 20 AND k <= least(2, pages) * 20"""
)
def search_filtered_page(ev):
    return search.search(ev, REQUEST).select("id", "score", F.to_date("published").alias("day"))


@query(f"{EV} SELECT id, title FROM d WHERE lower(title) LIKE '%click%' AND lower(title) LIKE '%1%'")
def search_freetext(ev):
    r = search.Request(q="Click 1", searched=("title",))
    return ev.where(search.condition(ev, r)).select("id", "title")


@query(f"{EV} SELECT id FROM d WHERE source_id IN ('src1', 'src2') AND category = 'product' AND lower(title) LIKE '%click 1%'")
def live_filter(ev):
    return search.live_filter(ev.withColumn("description", F.lit(None).cast("string")), ["src1", "src2"], "product", "Click 1").select("id")


for _r, _cond in (
    ("today", "day = DATE '2024-01-20'"),
    ("yesterday", "day = DATE '2024-01-19'"),
    ("week", f"published >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"),
):
    QUERIES[f"live_range_{_r}"] = lambda spark, d, r=_r: search.by_range(event_stories(spark, d), r, F.lit(AS_OF).cast("timestamp")).select("id")
    SQL[f"live_range_{_r}"] = f"{EV} SELECT id FROM d WHERE {_cond}"


@query(f"{EV} SELECT id FROM d WHERE published >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR")
def latest_48h(ev):
    return search.latest(ev, F.lit(AS_OF).cast("timestamp")).select("id")


@query(
    f"""{EV}, t AS (SELECT id FROM d WHERE day = DATE '2024-01-31')
    SELECT id, true AS from_today FROM t
    UNION ALL SELECT id, false FROM d WHERE published >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 48 HOUR AND NOT EXISTS (FROM t)"""
)
def range_today_fallback(ev):
    return search.today_or_latest(ev, F.lit("2024-01-31 12:00:00").cast("timestamp")).select("id", "from_today")


@query(f"{EV} SELECT id, published FROM d ORDER BY published DESC NULLS LAST, id LIMIT 100")
def recent_100(ev):
    return search.recent(ev).select("id", "published")


@query(f"{EV} SELECT id, (row_number() OVER (ORDER BY coalesce(score, 0) DESC, published DESC NULLS LAST, id))::int AS rank FROM d ORDER BY rank LIMIT 200")
def snapshot_top_200(ev):
    return search.ranked(ev, dashboard.snapshot_order(), 200).select("id", "rank")


ENTITY = """SELECT 'company' AS "group", unnest(companies) AS name, id, score, published FROM d
    UNION ALL SELECT 'model', unnest(models), id, score, published FROM d
    UNION ALL SELECT 'research', unnest(technologies), id, score, published FROM d"""
SLUG = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""{EV} SELECT name, {SLUG} AS slug, count(*)::bigint AS n FROM ({ENTITY}) WHERE "group" = 'research' GROUP BY 1, 2""")
def entity_names(ev):
    return entities.names(ev, "research")


@query(f"""{EV} SELECT name, count(*)::bigint AS n, count(DISTINCT id)::bigint AS stories, {AVG1} AS avg_score FROM ({ENTITY}) WHERE "group" = 'company' GROUP BY name""")
def entity_stats(ev):
    return entities.statistics(ev, "company")


@query(f"{EV} SELECT id, score, published FROM d WHERE list_contains(companies, 'c3')")
def entity_page(ev):
    return entities.page(ev, "company", " C3").select("id", "score", "published")


@query(
    f"""{EV} SELECT "group", name, count(*)::bigint AS n FROM ({ENTITY}) WHERE "group" <> 'company'
    AND id IN (SELECT id FROM d WHERE list_contains(companies, 'c3')) GROUP BY ALL ORDER BY n DESC, name, "group" LIMIT 12"""
)
def related_entities(ev):
    return entities.related(ev, "company", "c3")


@query(
    f"""{EV} SELECT lower(name) AS token, CASE min(list_position(['company', 'model', 'research'], "group"))
    WHEN 1 THEN 'company' WHEN 2 THEN 'model' ELSE 'research' END AS "group" FROM ({ENTITY}) GROUP BY 1"""
)
def token_group(ev):
    return entities.group_of(ev)


@query(f"""{EV} SELECT "group", count(DISTINCT name)::bigint AS names, count(*)::bigint AS mentions FROM ({ENTITY}) GROUP BY 1""")
def entity_overview(ev):
    return entities.overview(ev)


BEST = "coalesce(score, -1) DESC, published DESC NULLS LAST, id"


@query(f"{EV} SELECT id, score FROM d ORDER BY {BEST} LIMIT 1")
def top_signal(ev):
    return dashboard.top_signal(ev).select("id", "score")


@query(
    f"""{EV}, one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY title ORDER BY {BEST}) = 1),
    r AS (SELECT id, row_number() OVER (ORDER BY {BEST}) AS k FROM one)
    SELECT id, CASE WHEN k = 1 THEN 'lead' WHEN k <= 4 THEN 'side' ELSE 'feed' END AS section FROM r"""
)
def highlights_partition(ev):
    return dashboard.highlights(ev, "title").select("id", "section")


@query(
    f"""{EV}, per AS (SELECT coalesce(category, 'other') AS subcategory, count(*)::bigint AS n, min(id) AS first_id FROM d GROUP BY 1)
    SELECT *, (row_number() OVER (ORDER BY subcategory = 'other', n DESC, first_id))::int AS position FROM per"""
)
def group_by_subcategory(ev):
    return dashboard.by_subcategory(ev.withColumn("subcategory", F.col("category")))


@query(f"{EV} SELECT id, list_distinct(list_concat(companies, models, technologies)) AS chips FROM d")
def chips(ev):
    # order within the list differs between engines: sort both
    made = dashboard.chips(["companies", "models", "technologies"])
    return ev.select("id", F.array_sort(made).alias("chips"))


SQL["chips"] = f"{EV} SELECT id, list_sort(list_distinct(list_concat(companies, models, technologies))) AS chips FROM d"


@query(
    """WITH s AS (SELECT ts::date AS run_id, 'src' || (user_id % 13) AS source_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'empty'
                  WHEN event_type = 'view' THEN NULL ELSE 'ok' END AS status, floor(value)::bigint AS items FROM events),
    p AS (SELECT run_id, count(*) FILTER (status = 'error')::bigint AS errors, count(*) FILTER (status = 'empty')::bigint AS warnings,
                 count(*) FILTER (coalesce(status, 'ok') = 'ok')::bigint AS ok, count(*)::bigint AS sources, sum(items)::bigint AS items FROM s GROUP BY 1)
    SELECT *, CASE WHEN errors = sources THEN 'error' WHEN errors > 0 OR warnings > 0 THEN 'degraded' ELSE 'ok' END AS status FROM p""",
    ev=False,
)
def run_health(spark, d):
    return health.run_health(statuses(spark, d))


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """A source status for each event: its day is the run."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "empty")
    status = status.when(F.col("event_type") != "view", "ok")
    return table(spark, d, "events").select(
        F.to_date("ts").alias("run_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 13).cast("string")).alias("source_id"),
        status.alias("status"),
        F.floor("value").alias("items"),
        "event_id",
    )


STATUS_SQL = """SELECT ts::date AS run_id, 'src' || (user_id % 13) AS source_id, CASE WHEN event_type = 'error' THEN 'error'
    WHEN event_type = 'signup' THEN 'empty' WHEN event_type = 'view' THEN NULL ELSE 'ok' END AS status, floor(value)::bigint AS items, event_id FROM events"""


@query(
    f"""WITH s AS (SELECT *, CASE status WHEN 'ok' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'warning' END AS c FROM ({STATUS_SQL}))
    SELECT source_id, count(*) FILTER (c = 'ok')::bigint AS ok, count(*) FILTER (c = 'warning')::bigint AS warnings,
           count(*) FILTER (c = 'error')::bigint AS errors, sum(items)::bigint AS items, arg_max(c, event_id) AS last FROM s GROUP BY 1""",
    ev=False,
)
def source_health(spark, d):
    rows = statuses(spark, d).select(F.col("event_id").alias("run_id"), "source_id", "status", "items")
    return health.source_health(rows)


RUNS_SQL = f"SELECT run_id, count(*)::bigint AS n, sum(items)::bigint AS items FROM ({STATUS_SQL}) GROUP BY 1"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("items").alias("items"))


@query(f"SELECT * FROM ({RUNS_SQL}) ORDER BY run_id DESC LIMIT 1", ev=False)
def latest_run(spark, d):
    return health.latest_run(runs(spark, d))


@query(f"SELECT * FROM ({RUNS_SQL}) ORDER BY run_id DESC LIMIT 30", ev=False)
def run_history_30(spark, d):
    return health.history(runs(spark, d))


@query(f"SELECT *, (row_number() OVER (ORDER BY run_id DESC))::int AS place FROM ({RUNS_SQL}) ORDER BY run_id DESC LIMIT 12", ev=False)
def run_log_cap(spark, d):
    return health.capped(runs(spark, d), 12)


@query(f"{EV} SELECT count(*)::bigint AS n, min(score) AS lowest, max(score) AS highest, coalesce({AVG1}, 0) AS mean FROM d")
def score_stats(ev):
    mean = F.coalesce(one_decimal(F.avg("score")), F.lit(0.0))
    return ev.agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), mean.alias("mean"))


@query(f"{EV} SELECT category, {BAND} AS band, count(*)::bigint AS n FROM d GROUP BY GROUPING SETS ((category), ({BAND}))")
def class_counts(ev):
    return ev.withColumn("band", band(F.col("score"))).groupingSets([["category"], ["band"]], "category", "band").agg(F.count("*").alias("n"))


@query(f"{EV} SELECT count(DISTINCT source_id)::bigint AS sources, count(*)::bigint AS stories FROM d")
def active_sources(ev):
    return ev.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("stories"))
