"""Mixing of sources to target weights, in tokens, with a cap on repeats.

Method: subset-sum budget fitting. Documents are counted by source and exact token length. A source's budget pays for
whole passes over it first; what is left is spread over the lengths in proportion to their counts, and the last few
documents are chosen by a bounded-knapsack dynamic program over the lengths so that the budget is met as exactly as
it can be. Which documents of a length are drawn follows from a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, ship
from . import tokens

SEED = 20_260_610
# Documents of one length are ranked within so many hash buckets, so that a length that a third of all documents have is
# ranked by many tasks.
RANK_BUCKETS = 256
# Tokens that the table of the last step spans at most, five bytes each.
MOST_ROOM = 20_000_000


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is the greatest that is at most budget.

    Bounded subset sum over chunks of 1, 2, 4 and so on of a length. For every sum that becomes reachable the chunk
    that first reached it is kept, and the sum without it was reachable before: that leads back from the best sum.
    A budget above MOST_ROOM, which only documents of millions of tokens bring about, is first brought below it with the longest
    documents that fit.
    """
    longest = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        if budget <= MOST_ROOM or lengths[i] <= 0:
            break
        longest[i] = min(int(counts[i]), budget // int(lengths[i]), -(-(budget - MOST_ROOM) // int(lengths[i])))
        budget -= int(longest[i] * lengths[i])
    if longest.any():
        return longest + knapsack(lengths, counts - longest, min(budget, int((lengths * (counts - longest)).sum())))
    budget = min(budget, int((lengths * counts).sum()))
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)
    chunks: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if not 0 < length <= budget:
            continue
        left, size = min(count, budget // length), 1
        while left > 0 and not reached[budget]:
            size = min(size, left)
            weight = size * length
            new = np.zeros(budget + 1, bool)
            new[weight:] = reached[: budget + 1 - weight]
            new &= ~reached
            by[new] = len(chunks)
            reached |= new
            chunks.append((i, size))
            left -= size
            size *= 2
        if reached[budget]:
            break
    taken = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, size = chunks[by[at]]
        taken[i] += size
        at -= size * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, target: int, max_repeats: int, seed: int = SEED) -> tuple[int, np.ndarray]:
    """(passes over all documents, documents of each length to draw once more) for a target of tokens.

    Never more than max_repeats draws of a document. The sum is at most the target, and equal to it whenever the
    lengths left to the last step can make it up.
    """
    total = int((lengths * counts).sum())
    none = np.zeros(len(lengths), np.int64)
    if target <= 0 or max_repeats <= 0 or total == 0:
        return 0, none
    passes = min(max_repeats, target // total)
    rest = target - passes * total
    if passes == max_repeats or not rest:
        return int(passes), none
    share = counts.astype(np.float64) * (rest / total)
    extra = np.minimum(np.floor(share).astype(np.int64), counts)
    left = rest - int((extra * lengths).sum())
    while left < 0:  # rounding of a float near a whole number
        i = int(np.flatnonzero((extra > 0) & (lengths > 0))[0])
        extra[i] -= 1
        left += int(lengths[i])
    order = np.random.default_rng(seed).permutation(len(lengths))
    # The largest remainders get one more, up to what the last step shall decide: the room of two longest documents.
    largest = order[np.argsort(-(share - np.floor(share))[order], kind="stable")]
    largest = largest[(extra < counts)[largest] & (lengths[largest] > 0)]
    upto = int(np.searchsorted(np.cumsum(lengths[largest]), left - 2 * int(lengths.max()), side="right"))
    extra[largest[:upto]] += 1
    left -= int(lengths[largest[:upto]].sum())
    extra[order] += knapsack(lengths[order], (counts - extra)[order], left)
    extra[lengths == 0] = 0
    return int(passes), extra


def _plans(plans: DataFrame) -> DataFrame:
    """One row per plan and source: share of the plan's weights, cap, ratio. Rows without plan, source or a positive
    weight ask for nothing; of repeated rows the weights add up and the greatest cap and ratio count."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    return (
        plans.where("plan_id is not null and source is not null")
        .groupBy("plan_id", "source")
        .agg(F.sum(w).alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
        .withColumn("share", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("plan_id"))))
        .withColumn("budget_ratio", F.max("budget_ratio").over(Window.partitionBy("plan_id")))
        .select("plan_id", "source", F.coalesce("share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
                F.coalesce("budget_ratio", F.lit(0.0)).alias("budget_ratio"))
    )


class Mix:
    """A plan table applied to a corpus: ``drawn()`` and ``shares()``.

    Weights of a plan are shares of their sum; a source's target is that share of budget_ratio times the tokens of the
    whole corpus, null sources included. A source without documents, or one that the cap holds back, falls short, and
    shares() says by how much; its part isn't given to others, which would change their shares. Null and empty
    texts have no tokens: they are drawn with whole passes and never otherwise. Repeated rows are documents of their own.
    Empty tables give no rows. Counting the tokens is a job that runs when this is made; the counts are kept in the shared folder.

    No group of documents meets in one task: what is fitted per plan and source are the counts by length, as many rows
    as there are different lengths.
    """

    def __init__(self, documents: DataFrame, plans: DataFrame, seed: int = SEED, folder: str = tokens.TOKENIZER_DIR):
        spark = documents.sparkSession
        ship(spark)
        self.plans, self.seed = _plans(plans), seed
        self.counted = cut(tokens.count_corpus(documents, "doc_id", "source", folder=folder))
        ranked = self.counted.withColumn("hash", F.xxhash64("doc_id", F.lit(seed)))
        self.ranked = ranked.withColumn("bucket", F.pmod("hash", F.lit(RANK_BUCKETS)).cast("int"))
        buckets = self.ranked.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        self.lengths = buckets.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
        self.fitted = cut(self._fit())

    def _fit(self) -> DataFrame:
        corpus = self.counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus_tokens"))
        target = F.floor(F.col("target_share") * F.col("budget_ratio") * F.col("corpus_tokens") + 1e-6)
        asked = self.plans.crossJoin(F.broadcast(corpus)).withColumn("target", target)  # one row of totals
        seed = self.seed

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths, counts = pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
            by = np.argsort(lengths)
            one = pdf.iloc[0]
            passes, extra = fit(lengths[by], counts[by], int(one["target"]), int(one["max_repeats"]), seed)
            return pd.DataFrame({"plan_id": one["plan_id"], "source": one["source"], "n_tokens": lengths[by], "n": counts[by], "passes": passes, "extra": extra})

        return (
            asked.join(self.lengths, "source")
            .groupBy("plan_id", "source")
            .applyInPandas(run, "plan_id string, source string, n_tokens bigint, n bigint, passes int, extra bigint")
            .where("passes > 0 or extra > 0")
        )

    def drawn(self) -> DataFrame:
        """(plan_id, source, doc_id, n_tokens, repeats): one row per plan and drawn document."""
        of_bucket = self.fitted.drop("n").join(self.buckets, ["source", "n_tokens"])
        take = F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n"))
        of_bucket = of_bucket.select("plan_id", "source", "n_tokens", "bucket", "passes", take.alias("take")).where("passes > 0 or take > 0")
        group = ["source", "n_tokens", "bucket"]
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("hash", "doc_id"))
        return (
            self.ranked.where("source is not null").withColumn("rank", rank)
            .join(of_bucket, group)
            .withColumn("repeats", F.col("passes") + (F.col("rank") <= F.col("take")).cast("int"))
            .where("repeats > 0")
            .select("plan_id", "source", "doc_id", "n_tokens", "repeats")
        )

    def shares(self) -> DataFrame:
        """Target and actual tokens and shares of each plan and source. Actual shares are of what the plan drew."""
        got = self.fitted.groupBy("plan_id", "source").agg(
            F.sum(F.col("n_tokens") * (F.col("passes") * F.col("n") + F.col("extra"))).alias("actual_tokens"),
            F.sum(F.col("passes") * F.col("n") + F.col("extra")).alias("draws"),
            F.max(F.col("passes") + (F.col("extra") > 0).cast("int")).alias("most_repeats"),
        )
        corpus = self.counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus_tokens"))
        have = self.lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("source_tokens"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = self.plans.crossJoin(F.broadcast(corpus)).join(have, "source", "left").join(got, ["plan_id", "source"], "left")
        out = out.select(
            "plan_id", "source", "target_share", (F.col("target_share") * F.col("budget_ratio") * F.col("corpus_tokens")).alias("target_tokens"),
            zero("source_tokens"), zero("actual_tokens"), zero("draws"), zero("most_repeats"),
        )
        all_of_plan = F.sum("actual_tokens").over(Window.partitionBy("plan_id"))
        return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), all_of_plan), F.lit(0.0)))
