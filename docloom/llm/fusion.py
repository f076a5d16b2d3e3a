"""One ranking from several differently-scaled scores, by Borda count.

In each list a group's items get competition ranks with averaged ties; an item that a list doesn't score stands at
the middle of the places that the list leaves open. An item's points are the sum, over the lists, of the weighted
number of items below it. Points order the group, the smaller identifier first where they are equal. Only ranks
count, so no list weighs more because of its range.

Defined results
* Null and NaN are no scores; null groups and null items are left out. Double rows count once (the best score, if they differ).
* Columns of clashing names don't matter: only the named ones are read.
* An empty list leaves all places open and so moves no one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize


@dataclass(frozen=True)
class Scores:
    """One list: its rows, score column, whether a smaller score is better, and its weight."""

    rows: DataFrame
    score: str
    ascending: bool = True
    weight: float = 1.0


#: Parts into which a group's scores are cut for ranking, so that a large group is spread over tasks.
PARTS = 64


def _best(s: Scores, number: int, group: str, item: str) -> DataFrame:
    """One row for each item of a group: the score, made smaller-is-better."""
    value = F.col(s.score).cast("double")
    value = value if s.ascending else -value
    rows = s.rows.select(F.lit(number).alias("list"), F.col(group).alias("g"), F.col(item).alias("i"), (value + F.lit(0.0)).alias("v"))
    return rows.where("g is not null and i is not null and v is not null and not isnan(v)").groupBy("list", "g", "i").agg(F.min("v").alias("v"))


def ranked(lists: list[Scores], group: str, item: str) -> DataFrame:
    """(list, g, i, above, tied, n): how many of the list's items in the group are better, and how many equal.

    Equal scores are counted before they meet, and the distinct scores of a group are cut into parts at their
    quantiles, so no task sees a whole group.
    """
    best = None
    for k, s in enumerate(lists):
        one = _best(s, k, group, item)
        best = one if best is None else best.unionByName(one)
    best = materialize(best, "scores")
    counts = materialize(best.groupBy("list", "g", "v").agg(F.count("*").alias("tied")), "counts")
    steps = [k / PARTS for k in range(1, PARTS)]
    cuts = counts.groupBy("list", "g").agg(F.percentile_approx("v", steps, 1000).alias("cuts"))
    parted = counts.join(cuts, ["list", "g"]).withColumn("part", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("v")))).drop("cuts")
    parts = parted.groupBy("list", "g", "part").agg(F.sum("tied").alias("m"))
    by_list = Window.partitionBy("list", "g")
    parts = parts.select("list", "g", "part", (F.sum("m").over(by_list.orderBy("part")) - F.col("m")).alias("earlier"), F.sum("m").over(by_list).alias("n"))
    inside = Window.partitionBy("list", "g", "part").orderBy("v")
    ranks = parted.join(parts, ["list", "g", "part"]).select("list", "g", "v", (F.col("earlier") + F.sum("tied").over(inside) - F.col("tied")).alias("above"), "tied", "n")
    return best.join(ranks, ["list", "g", "v"]).select("list", "g", "i", "above", "tied", "n")


def borda(lists: list[Scores], group: str, item: str, top: int | None = None, among: int | None = None, least_lists: int = 2) -> DataFrame:
    """(group, item, points, good, place), best first; good is in how many lists fewer than `among` items are better.

    top keeps the first ones; among (with least_lists) then keeps, before that, items near the top of enough lists.
    """
    k = len(lists)
    marks = materialize(ranked(lists, group, item), "ranks")
    weight: Column = F.element_at(F.array(*[F.lit(float(s.weight)) for s in lists]), F.col("list") + 1)
    # With u items in all, rank r and n scored: u - r for a scored item, (u - n - 1) / 2 for one that isn't.
    rank = F.col("above") + (F.col("tied") + 1) / 2
    good = (F.col("above") < among).cast("int") if among else F.lit(0)
    items = marks.groupBy("g", "i").agg(
        F.sum(weight * rank).alias("ranks"), F.sum(weight).alias("scored"), F.sum(weight * F.col("n")).alias("own"), F.sum(good).alias("good")
    )
    sizes = marks.groupBy("g", "list").agg(F.max("n").alias("n")).groupBy("g").agg(F.sum(weight * F.col("n")).alias("all"))
    total = items.groupBy("g").agg(F.count("*").alias("u"))
    full = items.join(sizes.join(total, "g"), "g")
    w = float(sum(s.weight for s in lists))
    missing = ((w - F.col("scored")) * (F.col("u") - 1) - (F.col("all") - F.col("own"))) / 2
    points = F.round(F.col("scored") * F.col("u") - F.col("ranks") + missing, 9)
    out = full.select(F.col("g").alias(group), F.col("i").alias(item), points.alias("points"), F.col("good"))
    if among:
        out = out.where(F.col("good") >= min(least_lists, k))
    if top is None:
        return out
    order = Window.partitionBy(group).orderBy(F.desc("points"), item)
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
