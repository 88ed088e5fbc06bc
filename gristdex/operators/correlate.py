"""CORRELATE QUERY: the keywords, and score ranges of keywords, that tell set A from set B."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristdex.model import Index
from gristdex.operators.evaluate import Evaluator
from gristdex.plans.nodes import CorrelateStatement, primary_keyword
from gristdex.session import written

#: Posterior odds a range must reach in either direction, and the gain a split must bring.
CUT_OFF, LEAST_GAIN = math.log(0.55 / 0.45), math.log(1.05)
KEY = ["table_seq", "keyword"]


def labels_of(index: Index, statement: CorrelateStatement) -> DataFrame:
    """(doc, cls, event): A is 1, B without A is -1; ``event`` is the document's lowest score."""
    evaluator = Evaluator(index)
    a = evaluator.result(statement.a, use_max=False).df.select("doc", F.col("score").alias("event"))
    b = evaluator.result(statement.b, use_max=False).df.select("doc", F.col("score").alias("event"))
    b = b.join(a.select("doc"), "doc", "left_anti")
    return a.withColumn("cls", F.lit(1)).unionByName(b.withColumn("cls", F.lit(-1)))


def correlate(index: Index, statement: CorrelateStatement, now: float | None = None) -> DataFrame:
    """Mines the discriminating ranges.

    Columns: ``keyword``, ``low`` and ``high`` (null where open), ``log_odds``,
    ``n_a``, ``n_b``, ``days_before`` (scores are days before the event of A).
    Each index table's list of a keyword is judged on its own (``table_seq``).

    Support is 5 % of A or of B, at least 1.  A keyword with a score other than 0
    is cut at the score where the posterior moves most, unless the gain is below
    ln 1.05 or the cut is at either end; ties go to the lowest cut.  Ranges within
    55 % to 45 % of the prior-corrected posterior are left out.  If A's leftmost
    keyword is timestamped, ephemeral keywords are left out and postings of
    timestamped keywords count as days before the document's event: only those
    before it; for documents outside A (and B, if B is timestamped too, else
    dropped) days before ``now``.  NaN scores count nowhere but for that test.  An
    empty A or B gives no row.

    Plan: labels, the postings of labelled documents, and those of them that count
    as days before, are each written once to the shared folder when the statement
    is compiled, as several branches read them.  Counts by (keyword, score) are combined map-side and running sums go by
    stretches of scores, see :func:`running_counts`; one row a keyword and document
    then counts for both ranges.
    """
    labels = written(labels_of(index, statement))
    postings = index.rows().select(*KEY, "doc", "seq", "score")
    stamped = index.rules.is_timestamped(primary_keyword(statement.a))
    is_timed = index.rules.timestamped_column(F.col("keyword"))
    kept = postings.where(~index.rules.ephemeral_column(F.col("keyword"))) if stamped else postings
    lists, held = _lists(kept), written(kept.join(labels, "doc"))
    matched = held
    if stamped:
        both = index.rules.is_timestamped(primary_keyword(statement.b))
        today = (F.lit(float(now)) if now is not None else F.expr("unix_micros(current_timestamp()) / 86400000000D")).cast("float")
        aged = written(_by_event(held.where(is_timed), both, today))
        matched = held.where(~is_timed).select(*aged.columns).unionByName(aged)
        ages = aged.select(*KEY, "score")
        if not both:
            outside = kept.where(is_timed).join(labels.select("doc"), "doc", "left_anti")
            ages = ages.unionByName(outside.select(*KEY, (today - F.col("score")).cast("float").alias("score")))
        lists = lists.where(~is_timed).unionByName(lists.where(is_timed).drop("cont").join(_lists(ages).drop("n_list"), KEY))
    lists = lists.withColumn("bound", bounds(labels)).select(*KEY, "n_list", "cont", "bound.*")
    lists = lists.where((F.col("n_list") >= F.col("limit_a")) | (F.col("n_list") >= F.col("limit_b")))
    matched = matched.where(~F.isnan("score"))
    ranges = split_ranges(matched, lists)
    return score_ranges(matched, ranges).withColumn("days_before", F.lit(stamped) & is_timed)


def bounds(labels: DataFrame) -> Column:
    """The prior log odds and the support limits as one scalar struct; null if A or B is empty."""
    a, b = F.count_if(F.col("cls") == 1), F.count_if(F.col("cls") == -1)
    sizes = labels.agg(a.alias("a"), b.alias("b")).where("a > 0 AND b > 0")
    limit = lambda c: F.greatest(F.floor(F.col(c) / 20), F.lit(1))
    return sizes.select(F.struct(F.log((F.col("a") + 1) / (F.col("b") + 1)).alias("prior"), limit("a").alias("limit_a"), limit("b").alias("limit_b")).alias("bound")).scalar()


def _lists(rows: DataFrame) -> DataFrame:
    """Size of each list and whether any of its scores isn't 0."""
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_list"), F.max(F.isnan("score") | (F.col("score") != 0)).alias("cont"))


def _by_event(held: DataFrame, both: bool, today: Column) -> DataFrame:
    """(key, doc, score, cls) of timestamped postings of labelled documents, scores turned into days before the event of their document.

    Of a document with an event, the first posting counts if it lies before.
    """
    dated = held if both else held.where("cls = 1")
    firsts = dated.groupBy(*KEY, "doc").agg(F.min(F.struct("seq", "score")).alias("first"), F.max("event").alias("event"), F.max("cls").alias("cls"))
    before = firsts.select(*KEY, "doc", F.col("first.score").alias("score"), "event", "cls").where(~F.isnan("score") & ~F.isnan("event") & (F.col("score") < F.col("event")))
    out = before.select(*KEY, "doc", (F.col("event") - F.col("score")).cast("float").alias("score"), "cls")
    if both:
        return out
    return out.unionByName(held.where("cls = -1").select(*KEY, "doc", (today - F.col("score")).cast("float").alias("score"), "cls"))


def stretch(score: Column) -> Column:
    """A number for the stretch of scores that a score lies in; higher stretches have higher numbers.

    A 256th of an octave is one stretch, so it has at most 46,000 different 32-bit
    scores, whatever their distribution, and there are at most 142,000; zero and
    the infinities have their own.
    """
    size = F.abs(score.cast("double"))
    octave = F.floor(F.log2(size) * 256).cast("int") + 40_000  # the smallest score is above 2^-150
    number = F.when(size == 0, 0).when(size == float("inf"), 80_000).otherwise(octave) * F.signum(score.cast("double")).cast("int")
    return F.coalesce(number, F.lit(0))


def running_counts(matched: DataFrame, lists: DataFrame) -> DataFrame:
    """Counts of A and B up to each distinct score of a keyword, of the whole keyword, and the next score.

    Columns: those of ``lists``, ``score``, ``a_low``, ``b_low``, ``a_all``,
    ``b_all``, ``pos`` (from 1), ``cuts`` (distinct scores), ``next``.  Only
    keywords with enough matches.

    Counts by (keyword, score) are combined map-side.  Sums run within a stretch
    of scores; totals of the stretches give what lies before each.  So no task
    holds a whole keyword, only the scores of a stretch or the stretches of one.
    """
    by_score = matched.groupBy(*KEY, "score").agg(F.count_if(F.col("cls") == 1).alias("a"), F.count_if(F.col("cls") == -1).alias("b"))
    part = [*KEY, "stretch"]
    up = Window.partitionBy(*part).orderBy("score")
    upto, whole = up.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*part)
    run = by_score.withColumn("stretch", stretch(F.col("score"))).select("*", F.sum("a").over(upto).alias("a_up"), F.sum("b").over(upto).alias("b_up"), F.row_number().over(up).alias("nth"), F.lead("score").over(up).alias("after"))
    totals = run.withColumn("a_in", F.sum("a").over(whole)).withColumn("b_in", F.sum("b").over(whole)).withColumn("n_in", F.count(F.lit(1)).over(whole)).where("nth = 1")
    ahead = Window.partitionBy(*KEY).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    line, keyword = Window.partitionBy(*KEY).orderBy("stretch"), Window.partitionBy(*KEY)

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(ahead), F.lit(0))

    placed = totals.select(
        *part,
        *(before(c).alias(name) for c, name in (("a_in", "a_before"), ("b_in", "b_before"), ("n_in", "n_before"))),
        *(F.sum(c).over(keyword).alias(name) for c, name in (("a_in", "a_all"), ("b_in", "b_all"), ("n_in", "cuts"))),
        F.lead("score").over(line).alias("then"),
    )
    enough = placed.join(lists, KEY).where(F.col("a_all") + F.col("b_all") >= F.least("limit_a", "limit_b"))
    return run.join(enough, part).select(
        *lists.columns,
        "score",
        (F.col("a_before") + F.col("a_up")).alias("a_low"),
        (F.col("b_before") + F.col("b_up")).alias("b_low"),
        "a_all",
        "b_all",
        (F.col("n_before") + F.col("nth")).alias("pos"),
        "cuts",
        F.coalesce("after", "then").alias("next"),
    )


def split_ranges(matched: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, cut, next, prior, limits): one row a keyword with enough matches; ``cut`` is null where the range stays whole."""
    run = running_counts(matched, lists)

    def gain(a: Column, b: Column) -> Column:
        p = (a + 1.0) / (a + b + 2.0)
        return F.when((a >= F.col("limit_a")) | (b >= F.col("limit_b")), F.abs(F.log(p / (1 - p)) - F.col("prior"))).otherwise(F.lit(0.0))

    low = gain(F.col("a_low"), F.col("b_low"))
    high = gain(F.col("a_all") - F.col("a_low"), F.col("b_all") - F.col("b_low"))
    kept = ["pos", "score", "next", "cuts", "cont", "prior", "limit_a", "limit_b"]
    best = run.withColumn("loss", -F.greatest(low, high)).groupBy(*KEY).agg(F.min(F.struct("loss", *kept)).alias("best")).select(*KEY, "best.*")
    split = F.col("cont") & (F.col("pos") > 1) & (F.col("pos") < F.col("cuts")) & (F.col("loss") <= -LEAST_GAIN)
    return best.select(*KEY, F.when(split, F.col("score")).alias("cut"), F.when(split, F.col("next")).alias("next"), "prior", "limit_a", "limit_b")


def score_ranges(matched: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct documents of A and B in each range, its log odds, and the cut-offs.

    A document has a posting up to the cut if its lowest score is, and one from
    the next score on if its highest is, so one row a keyword and document counts
    for both ranges.
    """
    docs = matched.groupBy(*KEY, "doc").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.max("cls").alias("cls"))
    placed = docs.join(ranges, KEY)
    none = F.lit(None).cast("float")
    part = lambda low, high, test: F.struct(low.alias("low"), high.alias("high"), test.alias("inside"))
    halves = F.array(part(none, F.col("cut"), F.col("lowest") <= F.col("cut")), part(F.col("next"), none, F.col("highest") >= F.col("next")))
    parts = F.when(F.col("cut").isNotNull(), halves).otherwise(F.array(part(none, none, F.lit(True))))
    rows = placed.select(*KEY, "cls", "prior", "limit_a", "limit_b", F.explode(parts).alias("r")).where("r.inside")
    counts = rows.groupBy(*KEY, "r.low", "r.high", "prior", "limit_a", "limit_b").agg(F.count_if(F.col("cls") == 1).alias("n_a"), F.count_if(F.col("cls") == -1).alias("n_b"))
    odds = F.log((F.col("n_a") + 1.0) / (F.col("n_b") + 1.0)) - F.col("prior")
    kept = counts.where((F.col("n_a") >= F.col("limit_a")) | (F.col("n_b") >= F.col("limit_b"))).withColumn("log_odds", odds).where(F.abs("log_odds") >= CUT_OFF)
    return kept.select(*KEY, "low", "high", "log_odds", "n_a", "n_b")
