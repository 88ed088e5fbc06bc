"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristdex.llm.pretokenize import slices

#: Entries of the cache of merged slices and the longest slice kept in it, in bytes.
CACHE_ENTRIES, CACHE_BYTES = 1 << 17, 48
#: Code points put through one scan, and through one output batch; a longer text goes alone.
SCAN_POINTS, BATCH_POINTS = 1 << 19, 1 << 22
_SHORT = 64


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Place of a rank file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class BytePairEncoder:
    """Merges the bytes of pre-tokenised slices by a rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str):
        self.path = path
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= _SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list, for slices of any length: O(n log n)."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != j:
                continue
            end[i], end[mid] = j, 0
            if j < n:
                before[j] = i
                if (r := ranks.get(piece[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
                heapq.heappush(heap, (r, p, j))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """(ids, byte offset in the text where each slice starts) of each text; see :func:`slices` for surrogates."""
        out: list[tuple[list[int], list[int]]] = []
        i = 0
        while i < len(texts):
            j, points = i, 0
            while j < len(texts) and (j == i or points + len(texts[j]) <= SCAN_POINTS):
                points += len(texts[j])
                j += 1
            out += self._encode_scan(texts[i:j])
            i = j
        return out

    def _encode_scan(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        data, offsets, before = slices(texts)
        cache, get, merge = self.cache, self.cache.get, self.merge
        places, bounds, out = offsets.tolist(), before.tolist(), []
        for k in range(len(texts)):
            ids: list[int] = []
            lo, hi = bounds[k], bounds[k + 1]
            for t in range(lo, hi):
                piece = data[places[t] : places[t + 1]]
                found = get(piece)
                if found is None:
                    found = merge(piece)
                    if len(piece) <= CACHE_BYTES:
                        if len(cache) >= CACHE_ENTRIES:
                            cache.clear()
                        cache[piece] = found
                ids += found
            base = places[lo] if lo < hi else 0
            out.append((ids, [p - base for p in places[lo:hi]]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        names = getattr(self, "_names", None)
        if names is None:
            names = self._names = {r: b for b, r in self.ranks.items()}
        return b"".join(names[i] for i in ids)


_encoders: dict[str, BytePairEncoder] = {}


def portions(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts a batch so that the texts of a portion stay within ``most`` (BATCH_POINTS) code points, null texts read as empty."""
    texts, lo, points = [t or "" for t in batch.column("text").to_pylist()], 0, 0
    for i, t in enumerate(texts):
        if i > lo and points + len(t) > (most or BATCH_POINTS):
            yield batch.slice(lo, i - lo), texts[lo:i]
            lo, points = i, 0
        points += len(t)
    yield batch.slice(lo), texts[lo:]


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a rank file, one a process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_corpus(df: DataFrame, doc_id: str, text: str, path: str | None = None, offsets: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of every text: ``doc_id``, ``ids`` ARRAY<INT>; with ``offsets`` also ``starts``.

    ``starts`` has the byte offset of each pre-tokenised slice in the UTF-8 text.
    Strings of special tokens in a text are ordinary text.  Null and empty texts
    have the empty list.  Every row is encoded, repeated ones too, texts of any
    length whole.  ``keep`` names columns to carry along; others aren't read.

    Plan: a narrow map in Arrow batches, no shuffle.
    """
    carried = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    extra = [f"keep_{i}" for i in range(len(keep))]
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} {kinds[c]}" for c in extra), "ids array<int>", *(["starts array<bigint>"] if offsets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())  # looked up where the task runs
        for batch, texts in (x for b in batches for x in portions(b)):
            coded = coder.encode(texts)
            columns = [batch.column("doc_id"), *(batch.column(c) for c in extra), pa.array([c[0] for c in coded], pa.list_(pa.int32()))]
            names = ["doc_id", *extra, "ids"]
            if offsets:
                columns, names = [*columns, pa.array([c[1] for c in coded], pa.list_(pa.int64()))], [*names, "starts"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = slim.mapInArrow(run, schema)
    return out.select("doc_id", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "ids", *(["starts"] if offsets else []))


def token_counts(df: DataFrame, doc_id: str, text: str, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of tokens of every text: ``doc_id``, ``tokens`` BIGINT and the kept columns; null and empty texts have 0."""
    extra = [f"keep_{i}" for i in range(len(keep))]
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(x) for c, x in zip(keep, extra)))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} {kinds[c]}" for c in extra), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())  # looked up where the task runs
        for batch, texts in (x for b in batches for x in portions(b)):
            sizes = [len(ids) for ids, _ in coder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in extra), pa.array(sizes, pa.int64())], ["doc_id", *extra, "tokens"])

    out = slim.mapInArrow(run, schema)
    return out.select("doc_id", *(F.col(x).alias(c) for c, x in zip(keep, extra)), "tokens")
