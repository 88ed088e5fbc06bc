"""How distinctive a term is per record: log-entropy weights (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_frequencies(df: DataFrame, term: str, record: str, occurrence: str) -> DataFrame:
    """(term, rec, tf): distinct occurrences of each term in each record.

    Occurrence numbers are gathered as bits of 64-number words, so repeated rows
    vanish map-side and one term in one record with very many occurrences is
    spread over its words.  A null number counts as one occurrence.
    """
    rows = df.select(
        F.col(term).cast("string").alias("term"),
        F.col(record).alias("rec"),
        F.shiftright(F.col(occurrence).cast("bigint"), 6).alias("word"),
        F.expr(f"shiftleft(1L, CAST(CAST(`{occurrence}` AS BIGINT) & 63 AS INT))").alias("bit"),
    ).where("term IS NOT NULL AND rec IS NOT NULL")
    words = rows.groupBy("term", "rec", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("term", "rec").agg(F.sum(F.coalesce(F.bit_count("bits"), F.lit(1))).cast("bigint").alias("tf"))


def log_entropy(df: DataFrame, term: str, record: str, occurrence: str) -> DataFrame:
    """Weight of each term in each record: ln(1 + tf) * (1 - H / ln N).

    H is the entropy of the term's spread over its records and N the number of
    records with any term; a term in one record only keeps the factor 1, one
    spread evenly over all has 0.  With a single record the factor is 1.

    Columns: ``rec``, ``term``, ``tf``, ``rec_total`` (occurrences in the record),
    ``docs`` (records of the term), ``n_docs`` (N), ``global_weight``, ``weight``.
    Rows with null term or record are left out; repeated (term, record,
    occurrence) count once; an empty table gives no row; other columns aren't read.

    Plan: rows are read once.  Two aggregations, (term, rec) -> tf and term ->
    entropy, with map-side combining; the record totals are a third small one,
    whose shuffle N is read off too, as it uses the same columns.  Joins are
    equi-joins on the record, then the term; the adaptive skew join splits hot ones.
    """
    tf = local_frequencies(df, term, record, occurrence)
    totals = tf.groupBy("rec").agg(F.sum("tf").alias("rec_total"))
    whole = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("rec_total").alias("occurrences")).select(F.struct("n", "occurrences").alias("whole")).scalar()
    spread = tf.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log(F.col("tf").cast("double"))).alias("s"))
    entropy = F.log(F.col("gf").cast("double")) - F.col("s") / F.col("gf")
    rest = F.when(F.col("n_docs") > 1, 1 - entropy / F.log(F.col("n_docs").cast("double"))).otherwise(F.lit(1.0))
    # No term occurs more often than all terms do, here and in a record; that keeps the sums, without which N would be read off another shuffle.
    sized = spread.withColumn("whole", whole).where("gf <= whole.occurrences").withColumn("n_docs", F.col("whole.n"))
    terms = sized.select("term", "docs", "n_docs", F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0)).alias("global_weight"))
    joined = tf.join(totals, "rec").where("tf <= rec_total").join(terms, "term")
    return joined.select("rec", "term", "tf", "rec_total", "docs", "n_docs", "global_weight", (F.log1p(F.col("tf").cast("double")) * F.col("global_weight")).alias("weight"))


def distinctive_terms(weights: DataFrame, local_share: float = 0.2, rare: int = 3, rare_share: float = 0.005) -> DataFrame:
    """The rows of :func:`log_entropy` whose term marks its record.

    A term rare enough has a global weight of at least
    1 - ln(max(rare, rare_share * N)) / ln N, as entropy is at most ln docs; that
    bound on the weight picks the candidates and loses none.  The exact
    conditions follow: share of the record's occurrences, and records of the term.
    """
    most = F.greatest(F.lit(float(rare)), F.lit(rare_share) * F.col("n_docs"))
    bound = F.when(F.col("n_docs") > 1, 1 - F.log(most) / F.log(F.col("n_docs").cast("double"))).otherwise(F.lit(0.0))
    candidates = weights.where(F.col("tf") / F.col("rec_total") >= F.lit(local_share)).where(F.col("global_weight") >= bound - F.lit(1e-9))
    return candidates.where((F.col("docs") <= rare) | (F.col("docs") / F.col("n_docs") < F.lit(rare_share)))
