"""Fraud scores, policy costs, threshold sweep and routing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .sampling import draw

#: Policy constants: dollars of a blocked legitimate click, of an allowed fraud and of a review.
@dataclass(frozen=True)
class Costs:
    block_legitimate: float = 0.30
    allow_fraud: float = 0.30
    review: float = 0.50


GRID = [round(i * 0.02, 2) for i in range(51)]
BLOCK, REVIEW, SAMPLE, ALLOW = "AUTO_BLOCK", "HUMAN_REVIEW", "QA_SAMPLE", "ALLOW"


def fraud_score(p: str | Column) -> Column:
    """1 - p: p is the probability of an attributed, that is legitimate, click."""
    return F.lit(1.0) - (F.col(p) if isinstance(p, str) else p)


def expected_cost(scored: DataFrame, block: float, review: float, costs: Costs = Costs()) -> DataFrame:
    """One row: counts, errors and dollars of a policy over (fraud_score, label)."""
    if review > block:
        raise ValueError(f"the review threshold {review} is over the block threshold {block}")
    f, legitimate = F.col("fraud_score"), F.col("label") == 1
    blocked, reviewed = f >= block, (f >= review) & (f < block)
    one = scored.agg(
        F.count_if(blocked).alias("n_blocked"), F.count_if(reviewed).alias("n_reviewed"), F.count_if(f < review).alias("n_allowed"),
        F.count_if(blocked & legitimate).alias("false_positives"), F.count_if((f < review) & (F.col("label") == 0)).alias("false_negatives"),
    )
    priced = one.withColumns({"fp_cost": F.col("false_positives") * costs.block_legitimate, "fn_cost": F.col("false_negatives") * costs.allow_fraud, "review_cost": F.col("n_reviewed") * costs.review})
    n = F.col("n_blocked") + F.col("n_reviewed") + F.col("n_allowed")
    total = F.col("fp_cost") + F.col("fn_cost") + F.col("review_cost")
    return priced.withColumn("total_cost", total).withColumn("cost_per_click", F.when(n > 0, F.col("total_cost") / n).otherwise(0.0))


def histogram(scored: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """(t, legit_from, fraud_from, legit, fraud): for each grid point, rows with a score from it up, and all rows. One scan; 51 rows."""
    below = F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= F.col("fraud_score")))
    counts = scored.groupBy(below.alias("k")).agg(F.count_if(F.col("label") == 1).alias("l"), F.count_if(F.col("label") == 0).alias("f"))
    points = scored.sparkSession.range(len(grid)).select((F.col("id") + 1).cast("int").alias("k"), F.element_at(F.array(*map(F.lit, grid)), (F.col("id") + 1).cast("int")).alias("t"))
    filled = points.join(counts, "k", "full").select("k", "t", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("f", F.lit(0)).alias("f"))
    up, every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    out = filled.withColumns({"legit_from": F.sum("l").over(up), "fraud_from": F.sum("f").over(up), "legit": F.sum("l").over(every), "fraud": F.sum("f").over(every)})
    return out.where(F.col("t").isNotNull()).select("t", "legit_from", "fraud_from", "legit", "fraud")


def sweep(scored: DataFrame, costs: Costs = Costs(), grid: list[float] = GRID) -> DataFrame:
    """(t_block, t_review, total_cost, n_reviewed, review_fraction) of every pair with t_review <= t_block."""
    h = histogram(scored, grid)
    b = h.select(F.col("t").alias("t_block"), F.col("legit_from").alias("bl"), F.col("fraud_from").alias("bf"))
    r = h.select(F.col("t").alias("t_review"), F.col("legit_from").alias("rl"), F.col("fraud_from").alias("rf"), "legit", "fraud")
    pairs = b.join(F.broadcast(r), F.col("t_review") <= F.col("t_block"))  # 51 rows each
    reviewed = F.col("rl") + F.col("rf") - F.col("bl") - F.col("bf")
    total = F.col("bl") * costs.block_legitimate + (F.col("fraud") - F.col("rf")) * costs.allow_fraud + reviewed * costs.review
    n = F.col("legit") + F.col("fraud")
    return pairs.select("t_block", "t_review", total.alias("total_cost"), reviewed.alias("n_reviewed"), F.when(n > 0, reviewed / n).otherwise(0.0).alias("review_fraction"))


def best(surface: DataFrame) -> DataFrame:
    """The cheapest policy; ties (to a millionth of a dollar) to the lowest block, then the lowest review threshold."""
    return surface.orderBy(F.round("total_cost", 6), "t_block", "t_review").limit(1)


def best_capped(surface: DataFrame, most: float) -> DataFrame:
    """The cheapest policy that reviews at most this share; none raises."""
    kept = surface.where(F.col("review_fraction") <= most)
    if kept.isEmpty():
        raise ValueError(f"no policy reviews at most {most}")
    return best(kept)


def allow_all(scored: DataFrame, costs: Costs = Costs()) -> DataFrame:
    return expected_cost(scored, 2.0, 2.0, costs)


#: The cost settings of the sensitivity table: the base, each cost halved or raised by half, and cheap review.
def scenarios(base: Costs = Costs()) -> dict[str, Costs]:
    out = {"base": base}
    for name in ("block_legitimate", "allow_fraud", "review"):
        for label, factor in (("-50%", 0.5), ("+50%", 1.5)):
            out[f"{name}{label}"] = replace(base, **{name: getattr(base, name) * factor})
    return out | {"cheap_review": replace(base, review=0.05)}


def sensitivity(scored: DataFrame, base: Costs = Costs()) -> DataFrame:
    """(scenario, t_block, t_review, total_cost, review_fraction): the best policy of each cost setting, from one histogram."""
    h = histogram(scored)
    b = h.select(F.col("t").alias("t_block"), F.col("legit_from").alias("bl"), F.col("fraud_from").alias("bf"))
    r = h.select(F.col("t").alias("t_review"), F.col("legit_from").alias("rl"), F.col("fraud_from").alias("rf"), "legit", "fraud")
    costs = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c.block_legitimate).alias("cb"), F.lit(c.allow_fraud).alias("ca"), F.lit(c.review).alias("cr")) for n, c in scenarios(base).items()])
    pairs = b.join(F.broadcast(r), F.col("t_review") <= F.col("t_block")).select("*", F.inline(costs))
    reviewed = F.col("rl") + F.col("rf") - F.col("bl") - F.col("bf")
    total = F.col("bl") * F.col("cb") + (F.col("fraud") - F.col("rf")) * F.col("ca") + reviewed * F.col("cr")
    priced = pairs.withColumns({"total_cost": total, "review_fraction": reviewed / (F.col("legit") + F.col("fraud"))})
    at = F.row_number().over(Window.partitionBy("scenario").orderBy(F.round("total_cost", 6), "t_block", "t_review"))
    return priced.withColumn("at", at).where("at = 1").select("scenario", "t_block", "t_review", "total_cost", "review_fraction")


def action(score: str | Column, block: float | Column, review: float | Column, rate: float, key: str | Column, seed: int = 42) -> Column:
    """Block and review thresholds are inclusive; a seeded share of what would be allowed goes to quality review."""
    if not 0 <= rate <= 1:
        raise ValueError(f"the sample rate must lie in [0, 1], got {rate}")
    if not isinstance(block, Column) and not isinstance(review, Column) and review > block:
        raise ValueError(f"the review threshold {review} is over the block threshold {block}")
    f = F.col(score) if isinstance(score, str) else score
    return F.when(f >= block, BLOCK).when(f >= review, REVIEW).when(draw(key, seed) < rate, SAMPLE).otherwise(ALLOW)


def route(scored: DataFrame, block: float, review: float, rate: float = 0.005, seed: int = 42, score: str = "fraud_score", key: str = "case_id") -> DataFrame:
    return scored.withColumn("action", action(score, block, review, rate, key, seed))


def quantile_thresholds(scored: DataFrame, block_share: float = 0.005, review_share: float = 0.02) -> DataFrame:
    """(t_block, t_review): for demonstrations, not a policy."""
    block, review = exact_quantiles(scored, "fraud_score", [1 - block_share, 1 - block_share - review_share])
    return scored.sparkSession.createDataFrame([(block, review)], "t_block double, t_review double")


def two_way(p: str = "p") -> Column:
    """The first pipeline's placeholder: p > 0.5 blocks, although p is the chance of being legitimate. Route with action() instead."""
    return F.when(F.col(p) > 0.5, BLOCK).otherwise(ALLOW)


def action_mix(routed: DataFrame) -> DataFrame:
    return routed.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
