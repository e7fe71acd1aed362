"""Training-log and model-catalogue analytics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordering import carry_forward, rank_rows, with_one


def fill_steps(log: DataFrame, file: str, pos: str, step: str = "step") -> DataFrame:
    """Lines without a step (or step 0) take the last non-zero step of the same file, 0 before the first."""
    known = log.withColumn("_known", F.when(F.col(step) != 0, F.col(step)))
    return carry_forward(known, "_known", [file], pos, "_filled", 0).withColumn(step, F.col("_filled")).drop("_known", "_filled")


def metric_curve(log: DataFrame, key: str, evaluation: bool, by: Sequence[str] = ("file",), pos: str = "pos",
                 step: str = "step", name: str = "key", value: str = "value") -> DataFrame:
    """Curve of one metric: first value per step for evaluation metrics, every value otherwise."""
    rows = log.filter(F.col(name) == key)
    if not evaluation:
        return rows.select(*by, step, pos, value)
    first = F.min_by(F.struct(pos, value), pos).alias("f")
    return rows.groupBy(*by, step).agg(first).select(*by, step, f"f.{pos}", f"f.{value}")


def best_run(df: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Per run, the first epoch that reaches the run's best score; ``best`` marks the first best run."""
    top = df.groupBy(run).agg(F.max_by(F.struct(epoch, score), F.struct(F.col(score), -F.col(epoch))).alias("t"))
    per = top.select(run, f"t.{epoch}", f"t.{score}")
    winner = per.agg(F.max_by(run, F.struct(F.col(score), -F.col(run))).alias("_w"))
    return with_one(per, winner).withColumn("best", F.col(run) == F.col("_w")).drop("_w")


def fps_stats(df: DataFrame, run: str, order: str, seconds: str, warmup: int = 5) -> tuple[DataFrame, DataFrame]:
    """Iterations per second per run after the warm-up, and mean and population variance over runs."""
    it = rank_rows(df, [order], [run], name="_i").filter(F.col("_i") > warmup)
    per = it.groupBy(run).agg((F.count("*") / F.sum(seconds)).alias("fps"))
    return per, per.agg(F.avg("fps").alias("mean_fps"), F.var_pop("fps").alias("var_fps"), F.count("*").alias("runs"))


def zoo_entries(df: DataFrame, text: str, title_re: str, kind_re: str, url_re: str, keys: Sequence[str] = ()) -> DataFrame:
    """Title, kind tag and distinct lower-cased URLs of each document; documents without URLs are left out."""
    c = F.col(text)
    found = F.transform(F.regexp_extract_all(c, F.lit(url_re), 1), lambda u: F.lower(F.trim(u)))
    rows = df.select(*keys, F.trim(F.replace(F.regexp_extract(c, title_re, 1), F.lit("#"), F.lit(""))).alias("title"),
                     F.regexp_extract(c, kind_re, 1).alias("kind"), F.array_sort(F.array_distinct(found)).alias("urls"))
    return rows.filter(F.size("urls") > 0)


def zoo_stats(entries: DataFrame) -> DataFrame:
    """Distinct titles and checkpoints per kind and overall (kind NULL)."""
    papers = entries.select("kind", "title").distinct().rollup("kind").agg(
        F.count_distinct("title").alias("papers"), F.grouping("kind").alias("all_kinds"))
    urls = entries.select("kind", F.explode("urls").alias("url")).distinct().rollup("kind").agg(
        F.count_distinct("url").alias("checkpoints"), F.grouping("kind").alias("all_kinds"))
    on = (papers["kind"].eqNullSafe(urls["kind"])) & (papers["all_kinds"] == urls["all_kinds"])
    return papers.join(urls, on, "left").select(papers["kind"], papers["all_kinds"], "papers",
                                                F.coalesce("checkpoints", F.lit(0)).alias("checkpoints"))
