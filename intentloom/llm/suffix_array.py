"""Suffix-array dedup with sparse suffix arrays.

Finds every passage of ``WINDOW`` (50) words or more that occurs in two documents or more. Of all
suffixes only those that begin at minimisers are retained (about one in 21), and of these only
those whose minimiser occurs in two documents. Each travels to its minimiser's bucket with its
next 50 words and the 40 words before it, as word hashes. There:

1. suffixes are sorted; the words that neighbours have in common bound how far any match reaches to
   the right, and the same over the reversed words before them how far to the left; a suffix
   whose two bounds together are below 50 words is in no passage and is dropped;
2. matches are extended: for each number o of words to the left within the bound, suffixes with
   the same o words before and 50 - o words after are one passage's occurrences.

A passage of 50 words has its minimiser at some o from 0 to 40, so nothing is missed; longer
matches are chains of these. Words are compared by 32-bit hashes, 50 at a time, in one bucket
with the same 64-bit minimiser.

Suffixes at minimisers that very many documents have aren't gathered in a bucket; their windows are counted by
``minimisers.with_hot_windows``.

The result and the defined results for null, empty, repeated and clashing input are those of
``super_kmers``; n_docs is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minimisers as M, text as T

LEFT, RIGHT = M.SPAN - 1, M.WINDOW
_FLUSH = 1 << 14


def _suffixes(table, hot, bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, doc, at, context = (np.concatenate([h[i] for h in held]) for i in range(4))
            return M.pack((key >> np.uint64(64 - bits)).astype(np.int64), {"key": key, "doc": doc, "at": at, "context": context})

        for batch in T.batches(rows):
            w = T.words(batch.column("text"))
            _, chosen, key = M.of_windows(w)
            at = np.unique(chosen)
            at = at[M.is_repeated(table, key[at]) & ~M.is_hot(hot, key[at])]
            short = (w.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # 0: no word
            ids = batch.column("doc_id").to_numpy()
            for i in range(0, len(at), _FLUSH):
                p = at[i : i + _FLUSH]
                text = np.searchsorted(w.ptr, p, "right") - 1
                place = p[:, None] + np.arange(-LEFT, RIGHT)
                inside = (place >= w.ptr[text][:, None]) & (place < w.ptr[text + 1][:, None])
                held.append((key[p], ids[text], p - w.ptr[text], np.where(inside, short[np.clip(place, 0, len(short) - 1)], 0).astype(np.uint32)))
                size += len(p)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _reach(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each suffix, the most words that it shares with another one of the same key, by sorted neighbours."""
    rows = np.ascontiguousarray(np.concatenate([key[:, None].view(np.uint32), side], axis=1))
    order = np.argsort(rows.view(f"S{rows.shape[1] * 4}").ravel(), kind="stable")
    k, s = key[order], side[order]
    differs = (s[1:] != s[:-1]) | (s[1:] == 0)
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), side.shape[1])
    common[k[1:] != k[:-1]] = 0
    out = np.empty(len(key), np.int64)
    out[order] = np.maximum(np.append(common, 0), np.insert(common, 0, 0))
    return out


def _match(t: pa.Table) -> pa.Table:
    key, doc, at = M.unpack(t, "key", np.uint64), M.unpack(t, "doc", np.int64), M.unpack(t, "at", np.int64)
    context = M.unpack(t, "context", np.uint32).reshape(len(key), LEFT + RIGHT)
    docs, _, _ = M.count_docs(key, doc)
    keep = docs > 1
    key, doc, at, context = key[keep], doc[keep], at[keep], context[keep]
    right, left = _reach(key, context[:, LEFT:]), _reach(key, context[:, LEFT - 1 :: -1] if LEFT else context[:, :0])
    keep = right + left >= M.WINDOW
    key, doc, at, context, right, left = (x[keep] for x in (key, doc, at, context, right, left))
    power = T._powers(np.uint64(T._Q), LEFT + RIGHT)
    sums = np.zeros((len(key), LEFT + RIGHT + 1), np.uint64)
    np.cumsum(context.astype(np.uint64) * power, axis=1, out=sums[:, 1:])
    hit, own = np.zeros((len(key), LEFT + 1), bool), np.zeros((len(key), LEFT + 1), bool)
    for o in range(LEFT + 1):
        i = np.flatnonzero((left >= o) & (right >= M.WINDOW - o))
        if len(i):
            same = T.mix(T.mix(sums[i, LEFT - o + M.WINDOW] - sums[i, LEFT - o]) ^ key[i])
            docs, least, _ = M.count_docs(same, doc[i])
            hit[i, LEFT - o], own[i, LEFT - o] = docs > 1, least == doc[i]
    row, column = np.nonzero(hit)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row))
    word = at[row] - LEFT + column
    mine = own[row, column]
    return pa.table({"doc_id": doc[row[begin]], "first": word[begin], "last": word[end - 1] if len(begin) else word, "first_copy": np.logical_and.reduceat(mine, begin) if len(begin) else mine})


def suffix_array_repeats(documents: DataFrame, hot: int = M.HOT) -> DataFrame:
    docs = M.ids_and_text(documents)
    bits = M.bucket_bits(docs)
    table, often = M.repeated(docs, hot)
    suffixes = docs.mapInArrow(_suffixes(table, often, bits), "bucket int, key binary, doc binary, at binary, context binary")
    found = suffixes.groupBy("bucket").applyInArrow(_match, "doc_id bigint, first bigint, last bigint, first_copy boolean")
    return M.passages(M.with_hot_windows(found.withColumn("n_docs", F.lit(None).cast("bigint")), docs, often)).drop("n_docs")


SQL = f"SELECT doc_id, start_word, n_words, first_copy FROM ({M.SQL})"
