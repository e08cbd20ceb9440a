"""Ranks of channels and weighted Reciprocal Rank Fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, WEIGHTS_2, WEIGHTS_3 = 60, {"text": 0.4, "vector": 0.6}, {"text": 0.3, "vector": 0.5, "summary": 0.2}


def ranked(channel: DataFrame, name: str, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, channel, score, rank): rank from 1 by score, ties by id. The channel is a top-k list, or has its ranks already."""
    if "rank" in channel.columns:
        return channel.select(*by, id_col, F.lit(name).alias("channel"), F.col("score").cast("double").alias("score"), "rank")
    over = Window.partitionBy(*by, F.lit(name)).orderBy(F.desc("score"), id_col)
    return channel.select(*by, id_col, F.lit(name).alias("channel"), F.col("score").cast("double").alias("score"), F.row_number().over(over).alias("rank"))


def fused(channels: dict[str, DataFrame], weights: dict[str, float], k: int = K, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, fused, NAME_score for each channel): sum of weight / (k + rank); channels of weight 0 are left out.

    One union and one aggregation whatever the number of channels, so full-outer joins aren't needed. Channels are lists
    of bounded length for each query; a longer one comes with its ranks (ranks.numbered), as ranking here takes one task.
    """
    parts = [ranked(df, name, id_col, by) for name, df in channels.items() if weights.get(name, 0) > 0]
    if not parts:
        first = next(iter(channels.values()))
        return first.select(*by, id_col, F.lit(0.0).alias("fused"), *[F.lit(None).cast("double").alias(f"{n}_score") for n in channels]).limit(0)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    weight = F.lit(0.0)
    for name in channels:
        weight = F.when(F.col("channel") == name, F.lit(float(weights.get(name, 0)))).otherwise(weight)
    scores = [F.max(F.when(F.col("channel") == n, F.col("score"))).alias(f"{n}_score") for n in channels]
    return rows.groupBy(*by, id_col).agg(F.round(F.sum(weight / (F.lit(k) + F.col("rank"))), 9).alias("fused"), *scores)


def best(fusion: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The n best, ties by id."""
    return fusion.orderBy(F.desc("fused"), id_col).limit(n)
