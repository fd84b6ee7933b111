"""Decisions over ranked candidate tables: keep all, the best of each source or destination, or a one-to-one assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.components import connected_components
from roadweave.plans.scratch import Scratch

#: Decimals of a metre to which scores are compared: equal lines in other places are equally far in spite of rounding errors.
PLACES = 9
#: Rounds before the rest is cut into components, and the most pairs of one that a task takes in order (three columns each).
ROUNDS, COMPONENT = 4, 1_000_000
STRATEGIES = ("all", "best_per_source", "best_per_dest", "one_to_one")


def one_to_one(rows: DataFrame, score: str) -> DataFrame:
    """Greedy assignment in the order (score, source_id, dest_id), in rounds.

    In each round every pair that is the first of both its source and its destination is taken; what shares an end with
    a taken pair goes. This equals taking pairs one by one in order. A chain of rising scores gives one pair a round, so
    what ROUNDS leave is cut into components that share no end, and each of at most COMPONENT pairs is taken in order by one
    task; only larger ones go on in rounds.
    """
    scratch = Scratch(rows.sparkSession, "assign")
    left, step, taken = scratch.table(rows, "open-0"), 0, []
    while not left.isEmpty():
        if step == ROUNDS:
            by_component, left = _in_order(left, score, scratch)
            taken.append(by_component)
            if left.isEmpty():
                break
        order = [F.round(score, PLACES), "source_id", "dest_id"]
        w = left.withColumn("_s", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
        w = w.withColumn("_d", F.row_number().over(Window.partitionBy("dest_id").orderBy(*order)))
        now = scratch.table(w.where("_s = 1 and _d = 1").drop("_s", "_d"), f"taken-{step}")
        taken.append(f"taken-{step}")
        rest = left.join(now.select("source_id"), "source_id", "left_anti").join(now.select("dest_id"), "dest_id", "left_anti")
        left = scratch.table(rest, f"open-{step + 1}")
        scratch.drop(f"open-{step}")
        step += 1
    return scratch.read(rows.schema, *taken) if taken else rows.limit(0)


def _in_order(left: DataFrame, score: str, scratch: Scratch) -> tuple[str, DataFrame]:
    """(name of the table of pairs taken, the rows of components that are too large for that)."""
    end = lambda side: F.concat_ws("/", F.lit(side), F.col(f"{side}_id").cast("string"))
    marked = left.withColumn("_u", end("source")).withColumn("_v", end("dest"))
    parts = connected_components(marked.select("_u", "_v"), "_u", "_v").withColumnRenamed("component", "_c")
    marked = scratch.table(marked.join(parts, F.col("_u") == F.col("node")).drop("_u", "_v", "node"), "marked")
    size = marked.groupBy("_c").agg((F.count("*") <= COMPONENT).alias("_fits"))
    marked = marked.join(size, "_c")
    kinds = dict(left.dtypes)

    def take(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.assign(_s=pairs["_s"].round(PLACES)).sort_values(["_s", "source_id", "dest_id"], kind="stable")
        sources, dests, kept = set(), set(), []
        for k, (s, d) in enumerate(zip(pairs["source_id"], pairs["dest_id"], strict=True)):
            if s not in sources and d not in dests:
                sources.add(s)
                dests.add(d)
                kept.append(k)
        return pairs.iloc[kept][["source_id", "dest_id"]]

    few = marked.where("_fits").select("_c", "source_id", "dest_id", F.col(score).alias("_s"))
    won = few.groupBy("_c").applyInPandas(take, f"source_id {kinds['source_id']}, dest_id {kinds['dest_id']}")
    scratch.table(marked.where("_fits").join(won, ["source_id", "dest_id"]).select(*left.columns).dropDuplicates(["source_id", "dest_id"]), "taken-in-order")
    return "taken-in-order", scratch.table(marked.where("not _fits").select(*left.columns), f"open-{ROUNDS}-large")


def resolve(results: DataFrame, strategy: str = "best_per_source") -> DataFrame:
    """Matches by a strategy; match_type and rank stay as they were, and sources left without any become NO_MATCH.

    Every strategy but one_to_one reads the results once, by windows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    score = "dtw_distance" if "dtw_distance" in results.columns else "distance_m"
    lost, source, by = F.col("dest_id").isNull(), Window.partitionBy("source_id"), F.round(score, PLACES)
    if strategy == "one_to_one":
        written = Scratch(results.sparkSession, "results").table(results, "results")
        kept = one_to_one(written.where(~lost), score)
        ids = written.select("source_id").distinct()
        out = ids.join(kept, "source_id", "left")
        return out.withColumn("match_type", F.when(lost, "NO_MATCH").otherwise(F.col("match_type"))).select(*results.columns)
    first = {"all": ~lost, "best_per_source": ~lost & (F.row_number().over(source.orderBy(lost, by, "dest_id")) == 1), "best_per_dest": ~lost & (F.row_number().over(Window.partitionBy("dest_id").orderBy(by, "source_id")) == 1)}
    rows = results.withColumn("_kept", first[strategy])
    rows = rows.withColumn("_any", F.max("_kept").over(source)).withColumn("_k", F.row_number().over(source.orderBy(F.desc("_kept"), by, "dest_id")))
    rows = rows.where(F.col("_kept") | (~F.col("_any") & (F.col("_k") == 1)))
    blank = {c: F.when(F.col("_kept"), F.col(c)) for c in results.columns if c not in ("source_id", "match_type")}
    return rows.select(*(blank.get(c, F.col(c)).alias(c) for c in results.columns if c != "match_type"), F.when(F.col("_kept"), F.col("match_type")).otherwise("NO_MATCH").alias("match_type")).select(*results.columns)
