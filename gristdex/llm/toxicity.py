"""Abusive, hateful or sexual content: a factorization machine over hashed terms (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristdex.llm.encode import portions
from gristdex.llm.textforms import Sentences, TermHasher, spans

#: Labelled documents that a model is fitted on, at most; a larger table is sampled by the hash of the id.
MAX_LABELLED = 20_000
#: Characters of a labelled document that it may have at most to be fitted on; longer ones aren't.
LONGEST = 20_000
#: Judged documents that a term must be in to be learned, whatever their number.
LEAST = 2
#: Code points that are hashed at once; a longer text is on its own.
PORTION = 1 << 19
#: Share of judgements taken to be wrong.
WRONG = 0.07


class Bags:
    """Sentences as one flat array of slots with offsets, and the document of each sentence, ascending."""

    def __init__(self, slots: np.ndarray, offsets: np.ndarray, doc: np.ndarray, documents: int):
        self.slots, self.offsets, self.doc, self.documents = slots, offsets, doc, documents

    @classmethod
    def of(cls, s: Sentences) -> Bags:
        """The terms of all distinct words of each sentence."""
        counts = np.diff(s.cuts)[s.words]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return cls(s.slots[spans(s.cuts[s.words], counts)], ends[s.offsets], s.doc, s.documents)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _chance(scores: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


class FactorizationMachine:
    """score(x) = b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2) over the terms of a sentence.

    The factors give each pair of terms a weight of its own, as insult with group
    mention, which adding single weights can't; there are no ready-made pairs
    among the terms.  A document's score is that of its highest sentence.
    """

    def __init__(self, size: int, factors: int = 4, seed: int = 7, spread: float = 0.2):
        self.w, self.b = np.zeros(size, np.float32), np.float32(0)
        self.v = np.random.default_rng(seed).normal(0, spread, (size, factors)).astype(np.float32)

    def _raw(self, slots: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of sentences, the factors of their terms and the sums of these."""
        v = self.v[slots]
        total = _sums(v, starts)
        return self.b + _sums(self.w[slots], starts) + 0.5 * ((total**2).sum(1) - _sums((v**2).sum(1), starts)), v, total

    def document_scores(self, s: Sentences) -> np.ndarray:
        """Highest sentence score of each document; -inf for one without sentences.

        Weights and factors are summed once a distinct word, then by sentence.
        """
        out = np.full(s.documents, -np.inf, np.float32)
        if len(s.words):
            v = self.v[s.slots]
            w, total, own = _sums(self.w[s.slots], s.cuts[:-1]), _sums(v, s.cuts[:-1]), _sums((v**2).sum(1), s.cuts[:-1])
            of = _sums(np.column_stack([w - 0.5 * own, total])[s.words], s.offsets[:-1])
            np.maximum.at(out, s.doc, self.b + of[:, 0] + 0.5 * (of[:, 1:] ** 2).sum(1))
        return out

    def fit(self, bags: Bags, y: np.ndarray, rounds: int = 12, rate: float = 0.05, factor_rate: float = 0.1, decay: float = 0.01, factor_decay: float = 0.03, batch: int = 32, seed: int = 7, least: int = LEAST, wrong: float = WRONG, prior: float = 1.0) -> FactorizationMachine:
        """Learns from documents with labels in [0, 1].

        A document is abusive if any of its sentences is (noisy-or), and a label
        is wrong with chance ``wrong``; each step takes the chance of every
        sentence to be the abusive one, given the label, as what to learn.  Terms
        in fewer than ``least`` documents are left at 0.  Weights start at shrunken
        log odds (``prior`` is the prior count), are drawn back to them by
        ``decay``, and move by adaptive gradient steps together with the factors.
        """
        rng = np.random.default_rng(seed)
        has = np.unique(bags.doc)
        if not len(has) or not (y[has] > 0.5).any() or not (y[has] <= 0.5).any():
            self.b = np.float32(-4 if not len(has) or not (y[has] > 0.5).any() else 4)
            self.v[:] = 0
            return self
        size, lengths, y = len(self.w), np.diff(bags.offsets), y[has].astype(np.float64)
        first = np.searchsorted(bags.doc, has)
        count = np.diff(np.append(first, len(bags.doc)))
        pair = np.unique(np.repeat(np.repeat(np.arange(len(has)), count), lengths) * size + bags.slots)
        pair_doc, pair_slot = pair // size, pair % size
        in_pos, in_any = np.bincount(pair_slot, y[pair_doc], size), np.bincount(pair_slot, minlength=size)
        used = in_any >= least
        odds = np.log((in_pos + 0.5) / (y.sum() + 1)) - np.log((in_any - in_pos + 2.0) / (len(has) - y.sum() + 4))
        start = np.where(used, 0.9 * np.clip(odds, -1.5, 2.5) * in_any / (in_any + prior), 0).astype(np.float32)
        self.w[:], self.b = start, np.float32(-2.5)
        self.v[~used] = 0
        moved_w, moved_v, moved_b = np.full(size, 0.1, np.float32), np.full(size, 0.1, np.float32), 1.0
        for turn in range(rounds):
            doubt = wrong if turn >= 2 else 0.0
            for part in np.array_split(rng.permutation(len(has)), max(1, len(has) // batch)):
                sentences = spans(first[part], count[part])
                n = lengths[sentences]
                slots = bags.slots[spans(bags.offsets[sentences], n)]
                score, v, total = self._raw(slots, np.cumsum(n) - n)
                p = _chance(score.astype(np.float64))
                whole = 1 - np.exp(_sums(np.log1p(-np.minimum(p, 1 - 1e-9)), np.cumsum(count[part]) - count[part]))
                whole = np.clip(whole, 1e-6, 1 - 1e-6)
                told = whole * (1 - doubt) / (whole * (1 - doubt) + (1 - whole) * doubt)
                untold = whole * doubt / (whole * doubt + (1 - whole) * (1 - doubt))
                toxic = y[part] * told + (1 - y[part]) * untold
                err = (p - np.minimum(np.repeat(toxic / whole, count[part]) * p, 1)).astype(np.float32)
                each = np.repeat(err, n) * used[slots]
                pull = each[:, None] * (np.repeat(total, n, axis=0) - v)
                touched, at = np.unique(slots, return_inverse=True)
                dw = np.bincount(at, each, len(touched)).astype(np.float32) * (16 / len(part)) + decay * (self.w[touched] - start[touched])
                dv = np.column_stack([np.bincount(at, pull[:, f], len(touched)) for f in range(v.shape[1])]).astype(np.float32) * (16 / len(part)) if v.shape[1] else np.zeros((len(touched), 0), np.float32)
                dv += factor_decay * self.v[touched]
                db = float(err.sum()) / len(part)
                moved_w[touched] += dw**2
                moved_v[touched] += (dv**2).mean(1) if v.shape[1] else 0
                moved_b += db**2
                self.w[touched] -= rate * dw / np.sqrt(moved_w[touched])
                self.v[touched] -= factor_rate * dv / np.sqrt(moved_v[touched])[:, None]
                self.b = np.float32(self.b - rate * db / np.sqrt(moved_b))
        return self


class ToxicityModel:
    """A fitted machine that scores documents on the executors."""

    def __init__(self, machine: FactorizationMachine, bits: int):
        self.machine, self.bits = machine, bits

    def score(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, score, flagged, kept columns) of every document.

        ``score`` is the probability of the document's highest sentence, 0 for a
        null, empty or blank text; ``flagged`` is a score above one half.  Texts
        of any length are read whole, every row comes out once, repeated ones
        too; columns not named aren't read.  Narrow map, no shuffle; the model,
        of fixed size, is broadcast.
        """
        extra = [f"keep_{i}" for i in range(len(keep))]
        slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(x) for c, x in zip(keep, extra)))
        kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
        schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{x} {kinds[x]}" for x in extra), "score double"])
        shared, bits = documents.sparkSession.sparkContext.broadcast(self.machine), self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, machine = TermHasher(bits), shared.value
            for part, texts in (x for b in batches for x in portions(b, PORTION)):
                logits = machine.document_scores(hasher.batch(texts)).astype(np.float64)
                scores = np.where(np.isinf(logits), 0.0, _chance(logits))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(x) for x in extra), pa.array(scores)], ["doc_id", *extra, "score"])

        out = slim.mapInArrow(run, schema)
        return out.select("doc_id", "score", (F.col("score") > 0.5).alias("flagged"), *(F.col(x).alias(c) for c, x in zip(keep, extra)))


def labelled_bags(documents: DataFrame, labels: DataFrame, bits: int, most: int, longest: int) -> tuple[Bags, np.ndarray]:
    """Hashed sentences and mean judgements of at most ``most`` labelled documents of at most ``longest`` characters.

    Of the first 2 ``most`` judged ids in the order of their hash, the first
    ``most`` with such a text are taken; ids whose text is missing, null or too
    long make room for others.
    """
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg((F.col("toxic") > 0).cast("double")).alias("y"))
    fit = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    order = F.xxhash64("doc_id")
    # Twice ``most`` rows of two numbers, so texts needn't be shuffled; which of them have a text is seen then.
    few = votes.orderBy(order, "doc_id").limit(2 * most)
    texts = fit.join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher(bits)
        for batch, some in (x for b in batches for x in portions(b, PORTION)):
            bags = Bags.of(hasher.batch(some))
            sentences = pa.ListArray.from_arrays(pa.array(bags.offsets, pa.int32()), pa.array(bags.slots))
            cuts = np.searchsorted(bags.doc, np.arange(bags.documents + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), sentences)], ["doc_id", "y", "terms"])

    chosen = texts.mapInArrow(run, "doc_id bigint, y double, terms array<array<int>>").orderBy(order, "doc_id").limit(most)
    found = chosen.toArrow().combine_chunks()
    column = found.column("terms")
    terms = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    inner = terms.flatten()
    slots, sizes = inner.flatten().to_numpy(zero_copy_only=False), inner.value_lengths().to_numpy(zero_copy_only=False)
    counts = terms.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return Bags(slots.astype(np.int32), offsets, np.repeat(np.arange(len(counts)), counts), len(counts)), found.column("y").to_numpy()


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, longest: int = LONGEST, bits: int = 18, seed: int = 7) -> ToxicityModel:
    """Fits a model on judged documents (``doc_id``, ``toxic``), joined to ``documents`` (``doc_id``, ``text``).

    At most ``most`` judged documents of at most ``longest`` characters are
    gathered as numbers, a bound on the driver's memory whatever the corpus;
    judgements that are null or of missing documents don't count, repeated ones
    are averaged.  No word is known beforehand.  Without judgements of both kinds
    the model calls every document clean (or, with abusive ones only, every
    document abusive).
    """
    bags, y = labelled_bags(documents, labels, bits, most, longest)
    return ToxicityModel(FactorizationMachine(1 << bits, seed=seed).fit(bags, y), bits)


def rates(scored: DataFrame, group: str = "source") -> DataFrame:
    """(group, n_docs, n_flagged, rate, mean_score) of scored documents; the null group has its own row."""
    n, flagged = F.count(F.lit(1)), F.sum(F.col("flagged").cast("bigint"))
    return scored.groupBy(F.col(group).alias(group)).agg(n.alias("n_docs"), flagged.alias("n_flagged"), (flagged / n).alias("rate"), F.avg("score").alias("mean_score"))
