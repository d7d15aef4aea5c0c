"""Summaries of stories: extractive by default, or by a summariser that the caller plugs in, checked against its source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions import scalars as N
from presswork.functions import stories as S

SUMMARY_CHARS = 280
TAKEAWAY_CHARS = 140
TAKEAWAYS = 3
AI = "struct<summary:string,whyItMatters:string,keyTakeaways:array<string>,method:string>"
ANSWER = "struct<summary:string,whyItMatters:string,keyTakeaways:array<string>>"


def resolved_mode(mode: str, summariser: Callable | None) -> str:
    """llm if it is asked for and a summariser is there, else extract."""
    return "llm" if mode == "llm" and summariser is not None else "extract"


def prompt(title: Column, body: Column) -> Column:
    return F.concat(F.lit("Title:\n"), F.coalesce(title, F.lit("")), F.lit("\n\nArticle text:\n"), F.coalesce(body, F.lit("")), F.lit("\n\nOutput the JSON summary object."))


#: Calls that a task has under way.
POOL = 8


def asked(df: DataFrame, prompt_col: str, answer_col: str, summariser: Callable[[str], str | dict | None], pool: int = POOL) -> DataFrame:
    """`df` with the summariser's answers as JSON, `pool` calls at once in a task; a call that fails, or a null prompt, gives null.

    Equal prompts of a batch are asked once. A summariser with a method `batch` (prompts to answers, in their order) gets whole batches;
    where that fails, each prompt is asked alone.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(answer_col, T.StringType())])

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            got = summariser(text)
        except Exception:  # whatever a plugged-in call does, the story gets an extract
            return None
        return got if got is None or isinstance(got, str) else json.dumps(got)

    def answers(prompts: list[str], workers: ThreadPoolExecutor) -> list[str | None]:
        if hasattr(summariser, "batch"):
            try:
                got = list(summariser.batch(prompts))
                if len(got) == len(prompts):
                    return [g if g is None or isinstance(g, str) else json.dumps(g) for g in got]
            except Exception:  # then one by one
                pass
        return list(workers.map(one, prompts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(pool) as workers:
            for frame in frames:
                prompts = list(dict.fromkeys(x for x in frame[prompt_col] if isinstance(x, str)))
                told = dict(zip(prompts, answers(prompts, workers) if prompts else []))
                yield frame.assign(**{answer_col: pd.Series([told.get(x) for x in frame[prompt_col]], dtype=object, index=frame.index)})

    return df.mapInPandas(run, schema)


def normalized(answer: Column, title: Column, body: Column) -> Column:
    """An answer trimmed and cut to length; null if it has no shape, or does not rest on the text."""

    def made(a: Column) -> Column:
        text = lambda c: F.nullif(F.trim(c), F.lit(""))
        points = F.filter(F.slice(F.coalesce(a["keyTakeaways"], F.array().cast("array<string>")), 1, TAKEAWAYS), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
        points = F.transform(points, lambda t: N.char_cap(F.trim(t), TAKEAWAY_CHARS))
        offered = F.coalesce(text(a["summary"]), text(a["whyItMatters"]), F.nullif(F.array_join(points, " "), F.lit("")))
        source = F.concat(F.coalesce(body, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))
        grounded = offered.isNull() | S.is_grounded(offered, source)
        whole = F.struct(
            N.char_cap(text(a["summary"]), SUMMARY_CHARS).alias("summary"), N.char_cap(text(a["whyItMatters"]), SUMMARY_CHARS).alias("whyItMatters"),
            points.alias("keyTakeaways"), F.lit("llm").alias("method"),
        )
        return F.when(a.isNotNull() & grounded, whole)

    return N.let(answer, made)


def summarise(stories: DataFrame, mode: str = "extract", summariser: Callable[[str], str | dict | None] | None = None, pool: int = POOL) -> DataFrame:
    """Stories with `ai` filled: by the summariser where its answer holds, else by an extract; method is llm, extractive or null.

    A story that has a summary and a method stays as it is, so a second run changes nothing. Without a body there is no call and
    no summary. Read are title, description, content, `ai` and from_aggregator, as far as they are there.
    """
    have = lambda name, kind: F.col(name) if name in stories.columns else F.lit(None).cast(kind)
    echo = S.is_title_echo(F.col("title"), have("description", "string"), F.coalesce(have("from_aggregator", "boolean"), F.lit(False)))
    rows = stories.withColumn("_body", S.body_text(have("content", "string"), have("description", "string"), echo))
    old = have("ai", AI)
    done = F.coalesce(old["summary"].isNotNull() & (F.coalesce(old["method"], F.lit("")) != ""), F.lit(False))
    rows = rows.withColumns({"_old": old, "_done": done})
    answer = F.lit(None).cast(ANSWER)
    if resolved_mode(mode, summariser) == "llm":
        wanted = ~F.col("_done") & F.col("_body").isNotNull()
        rows = asked(rows.withColumn("_prompt", F.when(wanted, prompt(F.col("title"), F.col("_body")))), "_prompt", "_answer", summariser, pool)
        parsed = F.from_json("_answer", ANSWER)
        answer = F.when(F.trim("_answer").rlike(r"^\{"), parsed)
    taken = N.let(
        S.extractive(F.col("_body")),
        lambda e: F.struct(
            e["summary"].alias("summary"), F.lit(None).cast("string").alias("whyItMatters"), e["takeaways"].alias("keyTakeaways"),
            F.when(e["summary"].isNotNull(), "extractive").alias("method"),
        ),
    )
    fresh = F.coalesce(normalized(answer, F.col("title"), F.col("_body")), taken)
    ai = F.when(F.col("_done"), F.col("_old")).otherwise(fresh).cast(AI)
    keep = [c for c in stories.columns if c != "ai"]
    return rows.select(*keep, ai.alias("ai"))


def statistics(summarised: DataFrame) -> DataFrame:
    """Stories with a summary, by how they got it, and without one."""
    some, method = F.col("ai.summary").isNotNull(), F.col("ai.method")
    of = lambda name: F.count_if(some & method.eqNullSafe(F.lit(name)))
    return summarised.agg(
        F.count_if(some & F.coalesce(method.isin("extractive", "llm"), F.lit(False))).alias("summarized"), of("extractive").alias("extractive"), of("llm").alias("llm"),
        F.count_if(~(some & F.coalesce(method.isin("extractive", "llm"), F.lit(False)))).alias("none"),
    )
