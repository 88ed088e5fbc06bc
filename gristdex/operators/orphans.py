"""References to records that do not exist (problem 7).

Parents and references meet in one range-partitioned shuffle on the key.  In
each range the parents' validity intervals become sorted arrays, and the
references, streamed in Arrow batches, are probed by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristdex.operators.skew import marked, weighed
from gristdex.session import shuffle_partitions

#: ``NEVER`` lies before the start of every interval, ``ALWAYS`` is the start of those without one.
NEVER, ALWAYS, FOREVER = -(1 << 63), 1 - (1 << 63), (1 << 63) - 1


class Keys:
    """The distinct keys of one range in order, and the places of others among them."""

    def __init__(self, keys: pa.Array):
        self.text = pa.types.is_string(keys.type)
        distinct = keys.unique()
        self.sorted = distinct.take(pc.sort_indices(distinct)) if self.text else np.sort(distinct.to_numpy(zero_copy_only=False))

    def places(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key is there) of each key; text is looked up by Arrow, bytewise."""
        if self.text:
            found = pc.fill_null(pc.index_in(keys, value_set=self.sorted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            return found, found >= 0
        wanted = keys.to_numpy(zero_copy_only=False)
        found = np.searchsorted(self.sorted, wanted)
        known = found < len(self.sorted)
        known[known] = self.sorted[found[known]] == wanted[known]
        return found, known


class ParentRange:
    """Validity intervals ``[start, end)`` of the parents of one key range, as sorted arrays.

    A key is alive at ``t`` if any of its intervals holds ``t``: the largest end
    among its intervals starting at or before ``t`` must lie after ``t``.
    """

    def __init__(self, keys: pa.Array, starts: np.ndarray, ends: np.ndarray):
        self.keys = Keys(keys)
        code = self.keys.places(keys)[0]
        self.starts, rank = np.unique(starts, return_inverse=True)
        self.width = len(self.starts) + 1
        place = code * self.width + rank + 1
        order = np.argsort(place, kind="stable")
        self.place, self.code = place[order], code[order]
        self.ends = _running_max(ends[order], self.code)

    def alive(self, keys: pa.Array, at: np.ndarray) -> np.ndarray:
        """For each reference whether its key is held by a parent at that instant."""
        code, known = self.keys.places(keys)
        at_rank = np.searchsorted(self.starts, at, side="right")
        i = np.searchsorted(self.place, code * self.width + at_rank, side="right") - 1
        ok = known & (i >= 0)
        j = i[ok]
        ok[ok] = (self.code[j] == code[ok]) & (self.ends[j] > at[ok])
        return ok


def _running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running maximum that starts anew in every group; groups are contiguous and ascending."""
    if not len(values):
        return values
    distinct, rank = np.unique(values, return_inverse=True)
    lifted = np.maximum.accumulate(group * len(distinct) + rank)
    return distinct[lifted - group * len(distinct)]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads a partition, parents first, and yields the references that miss."""
    held: list[pa.RecordBatch] = []
    parents: ParentRange | None = None
    for batch in batches:
        is_ref = batch.column("is_ref")
        if not is_ref.false_count:
            refs = batch
        else:
            held.append(batch.filter(pc.invert(is_ref)))
            refs = batch.filter(is_ref)
        if not refs.num_rows:
            continue
        if parents is None:
            olds = pa.Table.from_batches(held, batch.schema).combine_chunks()
            column = lambda name: pa.concat_arrays(olds.column(name).chunks) if olds.num_rows else pa.array([], batch.schema.field(name).type)
            parents, held = ParentRange(column("k"), *(column(c).to_numpy(zero_copy_only=False) for c in ("at", "x"))), []
        miss = ~parents.alive(refs.column("k"), refs.column("at").to_numpy(zero_copy_only=False))
        if miss.any():
            yield refs.filter(pa.array(miss)).select(["k", "at", "x"])


def ranged(references: DataFrame, ref: str, at: str, parents: DataFrame, parent_key: str, added: str, removed: str, partitions: int) -> DataFrame:
    """References (counted per key and time) and parents in ranges of the key, parents first: ``k``, ``at``, ``x``, ``is_ref``.

    ``x`` is the number of a reference's rows, or the end of a parent's interval
    that starts at ``at``.  A key with more times than a range should hold is
    split into as many pieces as there are ranges, by the hash of the time; its
    parents are copied into each.
    """
    key_type = "string" if dict(references.dtypes)[ref] == "string" else "bigint"

    def micros(column: str, missing: int, name: str) -> Column:
        return F.coalesce(F.unix_micros(F.col(column).cast("timestamp")), F.lit(missing)).alias(name)

    refs = references.select(F.col(ref).cast(key_type).alias("k"), micros(at, NEVER, "at")).where("k IS NOT NULL").groupBy("k", "at").agg(F.count(F.lit(1)).alias("n_rows"))
    # With the rows summed too, the sketch is taken of the same shuffle.
    seen = weighed(refs, "k", 1 / partitions, F.sum("n_rows").alias("rows"))
    heavy = marked(refs, "k", seen).withColumn("piece", F.when(F.col("heavy"), F.pmod(F.xxhash64("at"), F.lit(partitions))).otherwise(F.lit(0)))
    refs = heavy.select("k", "piece", "at", F.col("n_rows").alias("x"), F.lit(True).alias("is_ref"))
    olds = parents.select(F.col(parent_key).cast(key_type).alias("k"), micros(added, ALWAYS, "at"), micros(removed, FOREVER, "x")).where("k IS NOT NULL").distinct()
    pieces = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(partitions - 1))).otherwise(F.array(F.lit(0)))
    olds = marked(olds, "k", seen).select("k", F.explode(pieces).alias("piece"), "at", "x", F.lit(False).alias("is_ref"))
    both = olds.unionByName(refs.select("k", F.col("piece").cast("int").alias("piece"), "at", "x", "is_ref"))
    return both.repartitionByRange(partitions, "k", "piece").drop("piece").sortWithinPartitions("is_ref")


def orphans(references: DataFrame, ref: str, at: str, parents: DataFrame, parent_key: str, added: str, removed: str, ref_table: str, partitions: int | None = None) -> DataFrame:
    """References that no parent row holds at their time.

    A parent row holds from ``added`` (included; null: always) to ``removed``
    (excluded; null: for ever); rows with a null key hold nothing, repeated and
    overlapping rows are harmless.  References with a null ``ref`` are none.  A
    reference with a null time is an orphan (it is held at no instant), with a
    null ``at``.

    Keys are BIGINT or STRING (compared bytewise), as ``ref`` is typed.  Columns:
    ``ref_table``, ``ref`` STRING, ``at`` TIMESTAMP, ``n_rows`` (repeated rows
    count).  An empty table of parents makes every reference an orphan.

    Plan: both tables are read once.  References are first counted per (ref,
    time), which removes the repetitions of hot keys map-side; then one range
    shuffle, in which hot keys are split.  A task holds the parents of its range
    only, never all of them.
    """
    key_type = "string" if dict(references.dtypes)[ref] == "string" else "bigint"
    sides = ranged(references, ref, at, parents, parent_key, added, removed, partitions or shuffle_partitions(references.sparkSession))
    missed = sides.mapInArrow(_probe, f"k {key_type}, at bigint, x bigint")
    when = F.when(F.col("at") > NEVER, F.timestamp_micros("at"))
    return missed.select(F.lit(ref_table).alias("ref_table"), F.col("k").cast("string").alias("ref"), when.alias("at"), F.col("x").alias("n_rows"))


def orphan_report(missed: DataFrame) -> DataFrame:
    """Misses per table and month: ``ref_table``, ``period`` (``YYYY-MM``), ``n_refs`` (distinct references), ``n_rows``."""
    month = F.date_format("at", "yyyy-MM").alias("period")
    per_ref = missed.groupBy("ref_table", month, "ref").agg(F.sum("n_rows").alias("n_rows"))
    return per_ref.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("n_rows").alias("n_rows"))
