"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristdex.llm.encode import token_counts
from gristdex.session import shuffle_partitions, written

#: Ranges of the random key in each source for each task of a shuffle; one range is what a single sort holds.
RANGES_A_TASK = 4


def targets_of(mix_targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats) of the usable targets: source not null, weight above 0.

    Several rows of one source count as one with their weights' sum and the
    highest max_repeats; a null or negative max_repeats counts as 0.
    """
    rows = mix_targets.select("source", F.col("weight").cast("double").alias("weight"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats"))
    usable = rows.where("source IS NOT NULL AND weight > 0 AND NOT isnan(weight)")
    return usable.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


class Mix:
    """A mix of the sources in ``documents`` by the weights in ``targets``.

    ``size`` is the tokens of a source, ``whole`` the sum over all target
    sources, ``budget`` a source's weight share of the whole.  A source gives
    ``epochs`` whole copies of itself and, of one more, the records whose running
    token count stays within the rest of the budget; no record comes more than
    ``max_repeats`` times.  Where that caps a source, it stays below its budget.

    Documents of other sources or without a source aren't used; null and empty
    texts have 0 tokens and come with the copies they fall in, ``max_repeats``
    times where their source has no tokens at all; a target without documents has
    size 0.  Empty tables give an empty mix.

    Plan: tokens are counted in a narrow map, whose result (ids and numbers) is
    written to the shared folder, as every further step starts there and texts
    should be tokenized once.  Then one shuffle on (source, range of a random
    key): the key is a hash, so a source that holds a third of the rows is spread
    evenly over its ranges, of which there are ``RANGES_A_TASK`` for each task of
    a shuffle.  Totals by range give distributed prefix sums; only within a range
    are rows sorted.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, seed: int = 17):
        self.targets = targets_of(targets)
        docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
        docs = docs.join(self.targets.select("source"), "source", "left_semi")
        counted = token_counts(docs, "doc_id", "text", path, keep=("source",)).withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
        bits = max(1, math.ceil(math.log2(RANGES_A_TASK * shuffle_partitions(documents.sparkSession))))
        self.rows = written(counted.withColumn("range", F.shiftright("key", 64 - bits)))
        self.ranges = self.rows.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"))

    def plan(self) -> DataFrame:
        """One row a target source: weight, max_repeats, size, whole, budget, epochs, rest, and by their numbers ``capped``."""
        sizes = self.ranges.groupBy("source").agg(F.sum("tokens").alias("size"))
        sized = self.targets.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        # As many rows as targets, whatever the corpus: one window holds them.
        all_of = Window.partitionBy(F.lit(0))
        budget = F.sum("size").over(all_of) * F.col("weight") / F.sum("weight").over(all_of)
        full = F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats"))).otherwise(F.col("max_repeats")).cast("bigint")
        rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(F.lit(0.0))
        out = sized.withColumn("whole", F.sum("size").over(all_of)).withColumn("budget", budget).withColumn("epochs", full).withColumn("rest", rest)
        return out.withColumn("capped", F.col("size") * F.col("max_repeats") < F.col("budget"))

    def placed(self) -> DataFrame:
        """(doc_id, source, tokens, repeats, unused) of every record of the target sources, ``repeats`` at least 0 and ``unused`` how many more it might come."""
        order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        before = self.ranges.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
        cuts = before.join(self.plan().select("source", "max_repeats", "epochs", "rest"), "source").select("source", "range", "before", "max_repeats", "epochs", "rest")
        within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = self.rows.withColumn("running", F.sum("tokens").over(within)).join(cuts, ["source", "range"])
        # The rest of a capped source is 0, which records without tokens would still fit into.
        more = ((F.col("epochs") < F.col("max_repeats")) & (F.col("before") + F.col("running") <= F.col("rest"))).cast("bigint")
        repeats = F.col("epochs") + more
        return running.select("doc_id", "source", "tokens", repeats.alias("repeats"), (F.col("max_repeats") - repeats).alias("unused"))

    def records(self) -> DataFrame:
        """(doc_id, source, tokens, repeats) of every record in the mix, ``repeats`` at least 1."""
        return self.placed().where("repeats > 0").select("doc_id", "source", "tokens", "repeats")

    def report(self) -> DataFrame:
        """The plan with ``actual_tokens``, ``records``, ``target_share``, ``actual_share`` and ``capped`` of each source.

        ``capped`` is read off the mix here: no record might come more often, and yet
        the tokens stay below the budget.
        """
        used = F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens")
        got = self.placed().groupBy("source").agg(used, F.count_if(F.col("repeats") > 0).alias("records"), F.max("unused").alias("unused"))
        all_of = Window.partitionBy(F.lit(0))
        out = self.plan().join(got, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0))).withColumn("records", F.coalesce("records", F.lit(0)))
        out = out.withColumn("target_share", F.col("weight") / F.sum("weight").over(all_of))
        out = out.withColumn("capped", (F.coalesce("unused", F.lit(0)) == 0) & (F.col("actual_tokens") < F.col("budget")))
        total = F.sum("actual_tokens").over(all_of)
        return out.withColumn("actual_share", F.when(total > 0, F.col("actual_tokens") / total).otherwise(F.lit(0.0))).drop("rest", "whole", "unused")
