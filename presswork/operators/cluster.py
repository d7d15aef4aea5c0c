"""Duplicate and near-duplicate headlines: exact keys, prefix-filtered token join, components, canonical members."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions.lexicons import LOW_INFO, STOPWORDS
from presswork.functions.scalars import fingerprint, normalize_title, url_host
from presswork.shared import shared_folder

THRESHOLD = 0.70
MIN_TOKENS = 2
MAX_HOURS = 72
HOST_BONUS = 0.08
MAX_ROUNDS = 40


def words_of(title: Column) -> Column:
    return F.filter(F.split(normalize_title(title), " "), lambda t: t != "")


def meaningful(title: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(words_of(title), lambda t: ~F.array_contains(stop, t))


def core(title: Column) -> Column:
    low = F.array(*map(F.lit, sorted({*STOPWORDS, *LOW_INFO})))
    return F.filter(words_of(title), lambda t: ~F.array_contains(low, t))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def exact_dedupe(df: DataFrame, order: str = "id") -> DataFrame:
    """The first row of each title and URL key; rows without either drop out."""
    keyed = df.withColumn("fingerprint", fingerprint(F.col("title"), F.col("url"))).where("fingerprint <> '|'")
    rest = [c for c in keyed.columns if c != "fingerprint"]
    one = keyed.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return one.select(*[F.col("_row")[c].alias(c) for c in rest], "fingerprint")


def headlines(df: DataFrame) -> DataFrame:
    """(id, tokens, at) of the rows with enough tokens, tokens distinct and in a fixed order."""
    made = df.select(
        "id", F.array_sort(F.array_distinct(core(F.col("title")))).alias("tokens"), F.size(core(F.col("title"))).alias("n_core"),
        F.size(meaningful(F.col("title"))).alias("n_all"), F.col("published").cast("timestamp").alias("at"),
    )
    return made.where((F.col("n_core") >= MIN_TOKENS) & (F.col("n_all") >= MIN_TOKENS)).select("id", "tokens", "at")


def similar_sets(heads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, jaccard) of distinct token sets that reach the threshold, a before b, each set by its joined tokens.

    Only the rarest len - ceil(threshold x len) + 1 tokens of a set are joined: two sets
    that reach the threshold share one of those. Equal sets count as one here.
    """
    sets = heads.select("tokens").distinct().withColumn("s", F.array_join("tokens", " "))
    each = sets.select("s", F.explode("tokens").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("s").orderBy("df", "t")
    size = F.count("*").over(Window.partitionBy("s"))
    ranked = each.join(often, "t").withColumn("r", F.row_number().over(rank)).withColumn("n", size)
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("s", "t", "n")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.t") == F.col("b.t")) & (F.col("a.s") < F.col("b.s"))
    near = near & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9)
    pairs = a.join(b, near).select(F.col("a.s").alias("a"), F.col("b.s").alias("b")).distinct()
    score = jaccard(F.split("a", " "), F.split("b", " "))
    return pairs.withColumn("jaccard", score).where(F.col("jaccard") >= threshold)


def spans(heads: DataFrame, hours: int = MAX_HOURS) -> DataFrame:
    """Each set's dated stories in pieces of `hours`: (s, piece), the smallest id, and id and time of the first and the last."""
    row = F.struct("at", "id")
    dated = heads.where("at is not null").withColumn("piece", F.floor(F.unix_micros("at") / (hours * 3_600_000_000)))
    per = dated.groupBy("s", "piece").agg(F.min("id").alias("id"), F.min(row).alias("first"), F.max(row).alias("last"))
    return per.select("s", "piece", "id", "first", "last")


def links(df: DataFrame, threshold: float = THRESHOLD, hours: int = MAX_HOURS) -> DataFrame:
    """Edges (u, v) of stories that report one event: similar titles, at most `hours` apart where both are dated.

    Time is cut into pieces of that length. All stories of a set of equal titles in one piece are close enough, so
    each is linked to the smallest id among them; sets and similar sets then meet by their pieces, one row each: all of one piece,
    and of pieces that follow each other the last of the one and the first of the other. That gives the same components as all
    pairs, with sums where windows would hold whole sets: a title repeated a million times is as many tasks as Spark likes.
    An undated story fits any time, so all are linked to the set's first undated one, and so are those of similar sets.
    Similar sets are found once: a set's rows on the one side say which piece of the other set they meet.
    """
    length = hours * 3_600_000_000
    heads = save(headlines(df).withColumn("s", F.array_join("tokens", " ")))
    pieces = save(spans(heads, hours))
    loose = save(heads.where("at is null").groupBy("s").agg(F.min("id").alias("id")))
    same = pieces.select("s").unionByName(loose.select("s")).distinct().select(F.col("s").alias("a"), F.col("s").alias("b"))
    sets = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both_ways = similar_sets(heads, threshold).select(sets.alias("x")).select("x.a", "x.b").unionByName(same)

    at_once = pieces.select(F.col("s").alias("a"), F.lit(True).alias("dated"), "piece", F.col("id").alias("u"), F.lit(None).cast("timestamp").alias("before"))
    then = pieces.select(F.col("s").alias("a"), F.lit(True).alias("dated"), F.col("piece") + 1, F.col("last.id"), F.col("last.at"))
    ever = loose.select(F.col("s").alias("a"), F.lit(False).alias("dated"), F.lit(0).cast("long").alias("piece"), F.col("id").alias("u"), F.lit(None).cast("timestamp").alias("before"))
    left = at_once.union(then).union(ever)
    found = pieces.select(F.col("s").alias("b"), F.lit(True).alias("dated"), "piece", F.col("id").alias("lo"), "first")
    any_time = pieces.select("s", "id").unionByName(loose.select("s", "id")).select("s", F.lit(False), F.lit(0).cast("long"), "id", F.lit(None).cast(found.schema["first"].dataType))
    met = both_ways.join(left, "a").where("not dated or before is not null or a < b").join(found.union(any_time), ["b", "dated", "piece"])
    gap = F.unix_micros("first.at") - F.unix_micros("before") <= length
    across = met.where(F.col("before").isNull() | gap).select("u", F.when(F.col("before").isNull(), F.col("lo")).otherwise(F.col("first.id")).alias("v"))

    piece = F.coalesce(F.floor(F.unix_micros("at") / length), F.lit(0).cast("long"))
    each = heads.select("s", F.col("at").isNotNull().alias("dated"), piece.alias("piece"), F.col("id").alias("u"))
    least = pieces.select("s", F.lit(True).alias("dated"), "piece", F.col("id").alias("v"))
    own = each.join(least.union(loose.select("s", F.lit(False), F.lit(0).cast("long"), "id")), ["s", "dated", "piece"]).select("u", "v")
    return own.unionByName(across).where("u <> v").distinct()


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that executors share; on one machine one below the warehouse will do where none is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = place or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(place)
    return df.checkpoint(eager=True)


class Steps:
    """Tables of an operator's steps in the folder that executors share, deleted when the block ends.

    A table has the size of its files. A checkpoint keeps the size that was estimated for its plan, a product for each join: over
    rounds of joins that number itself grows, to twice the digits with each, until the driver's memory holds no more of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/presswork-{uuid4().hex}", 0

    def __enter__(self) -> Steps:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(path := f"{self.root}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(path)

    def marked(self, df: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        """The table of edges, and their number and a hash of them all, taken while they are written."""
        seen = Observation()
        made = self(df.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")))
        return made, (seen.get["n"], seen.get["x"])

    def drop(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def keep_last(self, before: int) -> int:
        """Delete the tables from number `before` on, all but the last; its number."""
        for k in range(before, self.count):
            self.drop(f"{self.root}/{k}")
        return self.count

    def __exit__(self, *_) -> None:
        self.drop(self.root)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of every node, root being the smallest id that it reaches.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones (star contraction), so rounds are
    few however long a chain is and in whatever order its ids come.
    """
    with Steps(edges.sparkSession) as step:
        apart = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now, mark = step.marked(apart.distinct())
        kept = step.count
        for _ in range(MAX_ROUNDS):
            if not mark[0]:
                break
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = step(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            up = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
            was, (now, mark) = mark, step.marked(large.join(least, "u").select(up.alias("u"), F.col("m").alias("v")).distinct())
            kept = step.keep_last(kept)
            if was == mark:
                break
        else:
            raise RuntimeError("components did not settle")
        roots = now.groupBy("u").agg(F.min("v").alias("root"))
        found = nodes.join(roots, F.col("id") == F.col("u"), "left")
        return save(found.select("id", F.coalesce("root", "id").alias("root")))


def cluster(df: DataFrame) -> DataFrame:
    """Each exact-deduped story with its cluster, whether it is canonical, and the cluster's size and sources.

    Canonical is the member with the highest reliability, then the earliest date (none
    counts as earliest), then the longest title, then the smallest id.
    """
    stories = save(exact_dedupe(df))
    roots = components(stories, links(stories))
    every = stories.join(roots, "id")
    best = Window.partitionBy("root").orderBy(
        F.col("reliability").desc_nulls_last(), F.col("published").asc_nulls_first(), F.desc(F.length("title")), "id"
    )
    per = every.groupBy("root").agg(F.count("*").alias("size"), F.countDistinct("source_id").alias("n_sources"))
    out = every.withColumn("canonical", F.row_number().over(best) == 1).join(per, "root")
    return out


def similarity(a: dict[str, Column], b: dict[str, Column], threshold: float = THRESHOLD, hours: int = MAX_HOURS) -> Column:
    """The score of two stories, columns title, published and url of each: the Jaccard similarity of their core tokens, a little more
    if one site tells both; 0 for too few tokens, below the threshold, and further apart in time than `hours` where both are dated."""
    enough = F.lit(True)
    for x in (a, b):
        enough = enough & (F.size(meaningful(x["title"])) >= MIN_TOKENS) & (F.size(core(x["title"])) >= MIN_TOKENS)
    score = jaccard(F.array_distinct(core(a["title"])), F.array_distinct(core(b["title"])))
    gap = F.abs(a["published"].cast("timestamp").cast("double") - b["published"].cast("timestamp").cast("double"))
    near = F.coalesce(gap <= hours * 3600, F.lit(True))
    same = F.coalesce(url_host(a["url"]) == url_host(b["url"]), F.lit(False))
    return F.when(enough & (score >= threshold) & near, F.least(F.lit(1.0), score + F.when(same, HOST_BONUS).otherwise(0.0))).otherwise(0.0)


def with_sources(clustered: DataFrame) -> DataFrame:
    """The canonical stories of clusters of several, with `sources` (id and name, each once), `relatedStoryIds` and `reportedBy`.

    Both lists follow the order in which members would be canonical. They are part of the result, so a cluster is one row.
    """
    name = F.col("source_name") if "source_name" in clustered.columns else F.col("source_id")
    date = F.coalesce(F.unix_micros(F.col("published").cast("timestamp")), F.lit(0))
    rank = F.struct(-F.coalesce("reliability", F.lit(-1)), date, -F.length("title"), F.col("id"))
    member = F.struct(rank.alias("r"), F.col("id").alias("id"), F.col("source_id").alias("source_id"), F.coalesce(name, F.col("source_id")).alias("name"))
    lists = clustered.where("size > 1").groupBy("root").agg(F.sort_array(F.collect_list(member)).alias("m"))
    sources = F.transform(F.filter("m", lambda x: x["source_id"].isNotNull()), lambda x: F.struct(x["source_id"].alias("id"), x["name"].alias("name")))
    first = F.filter(sources, lambda s, i: F.array_position(F.transform(sources, lambda y: y["id"]), s["id"]) == i + 1)
    lists = lists.select("root", first.alias("sources"), F.transform("m", lambda x: x["id"]).alias("relatedStoryIds"))
    return clustered.where("canonical").join(lists, "root", "left").withColumn("reportedBy", F.when(F.col("sources").isNotNull(), F.size("sources")))


def statistics(clustered: DataFrame, n_input: int) -> DataFrame:
    one = clustered.where("canonical")
    return one.agg(
        F.lit(n_input).cast("long").alias("input"),
        F.sum("size").alias("after_exact"),
        F.count("*").alias("clusters"),
        F.count_if(F.col("n_sources") > 1).alias("multi_source"),
        F.max("size").alias("largest"),
    )
