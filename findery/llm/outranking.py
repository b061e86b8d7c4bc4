"""One ranking out of several scores on different scales: outranking net flow.

Within a group each score becomes a scale-free utility by its place in the list of that score: a percentile, or the
reciprocal of offset plus position. For a score, item a is preferred to item b by P(u_a - u_b): not at all up to the
``indifference`` threshold, wholly from the ``preference`` threshold on, and in proportion in between. The positive flow of a
is the sum of its preferences over all others, the negative flow the sum of theirs over it, and the weighted net flow over
all scores, divided by the number of others, ranks the items.

No pair is ever made: as P is linear in pieces, both flows come exactly from the count and the sum of the utilities up to
four bounds (u - preference, u - indifference, u + indifference, u + preference). The bounds are sorted together with the
utilities, and counts and sums are running totals of that list (``running_totals``, which also copes with a group that holds
a third of all rows).

An item that a list lacks has utility 0 there. Without indifference, and with a preference threshold that no difference
reaches, net flow is an increasing function of the weighted sum of utilities, hence ranks as that sum does; with others it
does not.

A null or NaN score is not in its list; an item in no list is not ranked. Repeated rows count once; of different scores of
one item in a group the largest counts. Ties within a list go to the smaller item; for percentiles tied items share the mean
of their places. Infinite scores are ordinary, first or last. Groups with one item have flow 0. Null groups are a group;
null items are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.operators.running import running_totals
from findery.sources.scratch import materialize

SCALES = ("percentile", "reciprocal")


def net_flow(
    hits: DataFrame, weights: dict[str, float], group: str = "query_id", item: str = "document_id", scale: str = "percentile", offset: int = 60, indifference: float = 0.05, preference: float = 0.5
) -> DataFrame:
    """``<group>, <item>, positive, negative, net, items, mean_utility`` of every item that is in some list.

    ``mean_utility`` is the mean weighted sum of utilities of the group's items.
    """
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {SCALES}")
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("there must be scores, and their weights must be positive")
    if not 0 <= indifference < preference:
        raise ValueError("indifference must not be negative, and preference must be above it")
    scored = hits.where(F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(*(F.max(F.when(~F.isnan(c), F.col(c))).alias(f"s{at}") for at, c in enumerate(weights)))
    entries = F.array(*(F.struct(F.lit(at).alias("list"), F.lit(float(w)).alias("weight"), F.col(f"s{at}").cast("double").alias("score")) for at, w in enumerate(weights.values())))
    long = scored.select("g", "i", F.explode(entries).alias("e")).select("g", "i", "e.*").where(F.col("score").isNotNull())
    placed = running_totals(long, ["g", "list"], [F.desc("score"), F.col("i")], {})
    if scale == "percentile":
        tied = placed.groupBy(F.col("g").alias("tg"), F.col("list").alias("tl"), F.col("score").alias("ts")).agg(F.min("position").alias("first"), F.max("position").alias("last"))
        match = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("g", "tg"), ("list", "tl"), ("score", "ts"))]
        utility: Column = 1.0 - ((F.col("first") + F.col("last")) / 2.0 - 0.5) / F.col("in_group")
        placed = placed.join(tied, match)
    else:
        utility = 1.0 / (F.lit(offset) + F.col("position"))
    used = materialize(placed.select("g", "i", "list", "weight", utility.alias("u")), "utilities")
    flows = _flows(used, indifference, preference)

    match = [F.col("g").eqNullSafe(F.col("fg")), F.col("list") == F.col("fl"), F.col("u") == F.col("fu")]
    both = used.join(flows.select(F.col("g").alias("fg"), F.col("list").alias("fl"), F.col("u").alias("fu"), "plus", "minus", "over", "in_list"), match)
    w = F.col("weight")
    per_item = both.groupBy("g", "i").agg(
        F.sum(w * F.col("u")).alias("utility"),
        F.sum(w * (F.col("plus") - F.col("in_list") * F.col("over"))).alias("plus"),
        F.sum(w * F.col("over")).alias("over"),
        F.sum(w * F.col("minus")).alias("minus"),
        F.collect_list(F.struct("list")).alias("lists"),
    )
    # of a list: by how much all its items together are preferred to one that it lacks
    lists = both.groupBy("g", "list").agg(F.sum(w * F.col("over")).alias("against")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("list", "against"))).alias("against"))
    groups = per_item.groupBy("g").agg(F.count("*").alias("items"), F.sum("utility").alias("all")).join(lists.withColumnRenamed("g", "lg"), F.col("g").eqNullSafe(F.col("lg"))).select(F.col("g").alias("of"), "items", "all", "against")
    whole = per_item.join(groups, F.col("g").eqNullSafe(F.col("of")))
    others = F.greatest(F.col("items") - 1, F.lit(1))
    lacking = F.aggregate(F.map_entries("against"), F.lit(0.0), lambda s, e: s + F.when(F.array_contains(F.transform("lists", lambda x: x["list"]), e["key"]), 0.0).otherwise(e["value"]))
    positive, negative = (F.col("plus") + F.col("items") * F.col("over")) / others, (F.col("minus") + lacking) / others
    return whole.select(
        F.col("g").alias(group), F.col("i").alias(item), positive.alias("positive"), negative.alias("negative"), (positive - negative).alias("net"), "items", (F.col("all") / F.col("items")).alias("mean_utility")
    )


def _flows(used: DataFrame, indifference: float, preference: float) -> DataFrame:
    """``g, list, u, plus, minus, over, in_list`` of every utility of every list: the summed preferences over the list's
    items and of these over it, the preference over an item of utility 0, and the number of items."""
    values = used.groupBy("g", "list", "u").agg(F.count("*").cast("double").alias("n"))
    shifts = {"full": -preference, "some": -indifference, "below": indifference, "beyond": preference}
    bounds = [F.struct(F.lit(name).alias("bound"), (F.col("u") + shift).alias("x"), F.lit(0.0).alias("n")) for name, shift in shifts.items()]
    own = F.struct(F.lit("").alias("bound"), F.col("u").alias("x"), F.col("n").alias("n"))  # sorts before the bounds
    events = values.select("g", "list", "u", F.explode(F.array(own, *bounds)).alias("e")).select("g", "list", "u", "e.*")
    met = running_totals(events, ["g", "list"], [F.col("x"), F.col("bound"), F.col("u")], {"count": lambda _: F.col("n"), "sum": lambda _: F.col("n") * F.col("u")})
    at = lambda name, of: F.max(F.when(F.col("bound") == name, F.col(of)))
    figures = [at(name, of).alias(f"{name}_{of}") for name in shifts for of in ("count", "sum")]
    wide = met.groupBy("g", "list", "u").agg(*figures, F.max("count_all").alias("in_list"))
    u, c = F.col("u"), F.col
    slope = preference - indifference
    plus = c("full_count") + ((u - indifference) * (c("some_count") - c("full_count")) - (c("some_sum") - c("full_sum"))) / slope
    minus = (c("in_list") - c("beyond_count")) + ((c("beyond_sum") - c("below_sum")) - (u + indifference) * (c("beyond_count") - c("below_count"))) / slope
    over = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (u - indifference) / slope))
    return wide.select("g", "list", "u", plus.alias("plus"), minus.alias("minus"), over.alias("over"), "in_list")
