"""What both searches for repeated passages share: minimisers of word windows, and the merging of windows to passages.

A window is ``WINDOW`` consecutive words. Its minimiser is the leftmost of its ``WINDOW - K + 1`` runs
of K words with the least hash; equal windows have equal minimisers at equal places in them. So a
window that occurs in two documents has a minimiser that occurs in two: those of one document only
are left out before any text travels (``repeated``).

A minimiser with more than ``hot`` occurrences (a passage that many documents have) isn't gathered in its bucket: its windows
are rows of their own, which are counted by distinct pairs of window and document, with partial sums, and joined with
the counts (``hot_windows``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text as T

WINDOW = 50
K = 10
SPAN = WINDOW - K + 1
#: bits of the table of repeated minimisers: 16 MB, whatever the input; a bit that is set wrongly only lets more travel
TABLE_BITS = 27
#: occurrences of a minimiser from which on its windows are rows of their own; a bucket has at most ``HOT_SHARE`` of these
HOT, HOT_SHARE = 1 << 16, 64
_POSITION = np.uint64((1 << 24) - 1)
_FLUSH = 1 << 19


def ids_and_text(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")


def of_windows(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start words of all windows, the words their minimisers begin at, and the minimisers' keys (evenly spread hashes) by word."""
    grams = T.ngrams(w.hashes, K)
    if len(grams) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A batch has fewer than 2^24 words but for a single huge text, which goes in overlapping blocks.
    block, at, chosen = 1 << 23, 0, []
    while at < len(grams) - SPAN + 1:
        part = grams[at : at + block + SPAN - 1]
        chosen.append((T.sliding_min((part & ~_POSITION) | np.arange(len(part), dtype=np.uint64), SPAN) & _POSITION).astype(np.int64) + at)
        at += block
    chosen = np.concatenate(chosen)
    starts = np.flatnonzero(np.arange(len(chosen)) + WINDOW <= w.limit()[: len(chosen)])
    return starts, chosen[starts], T.mix(grams ^ np.uint64(0x5851F42D4C957F2D))


def bucket_bits(df: DataFrame) -> int:
    return max(8, (4 * scratch.shuffle_partitions(df.sparkSession) - 1).bit_length())


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: what numbers have in common compresses well in this order."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(t: pa.Table, name: str, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).ravel() for x in t.column(name)])


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray], to_bytes: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> pa.RecordBatch:
    """One row for each bucket; in it, each column's values as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    spans = list(zip(cut, np.append(cut[1:], len(bucket))))
    arrays = [pa.array([to_bytes(v[a:b]) for a, b in spans], pa.binary()) for v in (c[order] for c in columns.values())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *arrays], ["bucket", *columns])


def unpack(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(name)])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(values))


def count_docs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, how many documents its key occurs in and the smallest of them."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    begin, end = runs(k)
    fresh = np.ones(len(k), np.int64)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    n = np.add.reduceat(fresh, begin) if len(begin) else fresh
    docs, first = np.empty(len(k), np.int64), np.empty(len(k), doc.dtype)
    docs[order], first[order] = np.repeat(n, end - begin), np.repeat(d[begin], end - begin)
    return docs, first, order


def _positions(bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for batch in T.batches(rows):
            w = T.words(batch.column("text"))
            starts, chosen, key = of_windows(w)
            if len(starts):
                at = np.unique(chosen)
                keys.append(key[at])
                docs.append(batch.column("doc_id").to_numpy()[np.searchsorted(w.ptr, at, "right") - 1])
                held += len(at)
            if held > _FLUSH:
                yield _packed(keys, docs, bits)
                keys, docs, held = [], [], 0
        if keys:
            yield _packed(keys, docs, bits)

    return run


def _packed(keys: list, docs: list, bits: int) -> pa.RecordBatch:
    """Of each key its least and its greatest document, and how often it occurs: two rows at most, however many there are."""
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    begin, end = runs(key)
    other = doc[begin] != doc[end - 1]
    key, doc = np.concatenate([key[begin], key[begin[other]]]), np.concatenate([doc[begin], doc[end[other] - 1]])
    n = np.concatenate([end - begin, np.zeros(other.sum(), np.int64)]).astype(np.uint32)
    return pack((key >> np.uint64(64 - bits)).astype(np.int64), {"key": key, "doc": doc, "n": n})


def _bits(bits: int, hot: int):
    def run(t: pa.Table) -> pa.Table:
        key, n = unpack(t, "key", np.uint64), unpack(t, "n", np.uint32).astype(np.int64)
        docs, _, order = count_docs(key, unpack(t, "doc", np.int64))
        table = np.zeros(max(8, 1 << (TABLE_BITS - bits)), np.uint8)
        table[((key[docs > 1] >> np.uint64(64 - TABLE_BITS)) & np.uint64(len(table) - 1)).astype(np.int64)] = 1
        begin, _ = runs(key[order])
        often = np.add.reduceat(n[order], begin) > max(hot, n.sum() // HOT_SHARE) if len(begin) else np.zeros(0, bool)
        return pa.table({"bucket": t.column("bucket")[:1], "bits": pa.array([np.packbits(table).tobytes()], pa.binary()), "hot": pa.array([key[order][begin[often]].tobytes()], pa.binary())})

    return run


def repeated(docs: DataFrame, hot: int = HOT) -> tuple[Broadcast, Broadcast]:
    """The table of minimisers that occur in two documents or more; the hot ones, sorted."""
    bits = min(bucket_bits(docs), TABLE_BITS - 3)
    packed = docs.mapInArrow(_positions(bits), "bucket int, key binary, doc binary, n binary")
    rows = packed.groupBy("bucket").applyInArrow(_bits(bits, hot), "bucket int, bits binary, hot binary").collect()
    table = bytearray(1 << (TABLE_BITS - 3))
    size = len(table) >> bits
    for r in rows:
        table[r["bucket"] * size : (r["bucket"] + 1) * size] = r["bits"]
    often = np.sort(np.frombuffer(b"".join(bytes(r["hot"]) for r in rows), np.uint64))
    return tuple(docs.sparkSession.sparkContext.broadcast(x) for x in (bytes(table), often))


def is_hot(hot: Broadcast, key: np.ndarray) -> np.ndarray:
    if not len(hot.value):
        return np.zeros(len(key), bool)
    return hot.value[np.minimum(np.searchsorted(hot.value, key), len(hot.value) - 1)] == key


def with_hot_windows(found: DataFrame, docs: DataFrame, hot: Broadcast) -> DataFrame:
    """``found`` and the repeated windows of hot minimisers: (doc_id, first, last, first_copy, n_docs)."""
    if not len(hot.value):
        return found

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(rows):
            w = T.words(batch.column("text"))
            starts, chosen, key = of_windows(w)
            at = starts[is_hot(hot, key[chosen])]
            of = np.searchsorted(w.ptr, at, "right") - 1
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(at - w.ptr[of]), pa.array(T.ngrams(w.hashes, WINDOW)[at].view(np.int64))], ["doc_id", "first", "window"])

    rows = scratch.materialise(docs.mapInArrow(run, "doc_id bigint, first bigint, window bigint"), "hot")
    counts = rows.select("window", "doc_id").distinct().groupBy("window").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("least")).filter("n_docs > 1")
    hits = rows.join(counts, "window").select("doc_id", "first", F.col("first").alias("last"), (F.col("least") == F.col("doc_id")).alias("first_copy"), "n_docs")
    return found.unionByName(hits)


def is_repeated(table: Broadcast, key: np.ndarray) -> np.ndarray:
    at = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (np.frombuffer(table.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def passages(found: DataFrame) -> DataFrame:
    """Unite runs of repeated windows (doc_id, first, last, first_copy, n_docs) that overlap or touch to passages."""
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") > before + WINDOW, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = found.select("*", island.alias("island")).groupBy("doc_id", "island")
    n_words = F.max("last") + WINDOW - F.min("first")
    return spans.agg(F.min("first").alias("start_word"), n_words.alias("n_words"), F.min("first_copy").alias("first_copy"), F.max("n_docs").alias("n_docs")).drop("island")


SQL = f"""
WITH w AS (SELECT doc_id, {T.WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, unnest(range(0, len(w) - {WINDOW} + 1)) AS p,
      unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: md5(array_to_string(w[i:i + {WINDOW} - 1], ' ')))) AS k FROM w WHERE len(w) >= {WINDOW}),
r AS (SELECT k, count(DISTINCT doc_id) AS n, min(doc_id) AS f FROM x GROUP BY k HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT DISTINCT doc_id, p, n, f FROM x JOIN r USING (k)),
i AS (SELECT *, CASE WHEN p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {WINDOW} THEN 1 ELSE 0 END AS begins FROM h),
j AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT doc_id, min(p) AS start_word, max(p) + {WINDOW} - min(p) AS n_words, bool_and(f = doc_id) AS first_copy, max(n) AS n_docs FROM j GROUP BY doc_id, island
"""
