"""Substring dedup by super-k-mers: windows that share a minimiser travel as one packed string.

Finds every passage of ``WINDOW`` (50) words or more that occurs in two documents or more. Consecutive
windows with the same minimiser form a super-k-mer: one stretch of text, sent once to the
minimiser's bucket instead of once for each of its windows. All occurrences of a window have the same
minimiser, hence meet in one bucket, where sorting the windows' hashes counts them exactly.
Super-k-mers whose minimiser occurs in a single document stay at home (``minimisers.repeated``); windows of minimisers that very many
documents have are counted by the engine's own aggregation (``minimisers.with_hot_windows``).

Result: (doc_id, start_word, n_words, first_copy, n_docs), a row for each maximal stretch of words
that repeated windows cover. first_copy: no document with a smaller id has any of its
windows, so a deduplication that keeps one copy keeps this one. n_docs: the most documents that
one of its windows occurs in. Words are those of ``text.WORDS_SQL``, counted from 0.

Defined results: a null, empty or short text (fewer than 50 words) has no windows; rows without
doc_id are left out; rows that share a doc_id are one document, so a repetition among them is none;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import minimisers as M, text as T

_FLUSH = 8 << 20


def _strings(table, hot, bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            bucket, doc, start, length = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.argsort(bucket, kind="stable")
            texts = [s for h in held for s in h[4]]
            cut, end = M.runs(bucket[order])
            payload = pa.array([b"".join([texts[i] for i in order[a:b]]) for a, b in zip(cut, end)], pa.binary())
            packed = M.pack(bucket, {"doc": doc, "start": start, "length": length})
            return pa.RecordBatch.from_arrays([*packed.columns, payload], ["bucket", "doc", "start", "length", "payload"])

        for batch in T.batches(rows):
            w = T.words(batch.column("text"))
            starts, chosen, key = M.of_windows(w)
            begin, end = M.runs(chosen)  # no minimiser is in two texts, so no run is
            keep = M.is_repeated(table, key[chosen[begin]]) & ~M.is_hot(hot, key[chosen[begin]])
            first, last = starts[begin[keep]], starts[end[keep] - 1]
            if not len(first):
                continue
            a, b = w.starts[first], w.ends[last + M.WINDOW - 1]
            text = np.searchsorted(w.ptr, first, "right") - 1
            held.append(((key[chosen[begin[keep]]] >> np.uint64(64 - bits)).astype(np.int64), batch.column("doc_id").to_numpy()[text], first - w.ptr[text], (b - a).astype(np.int32), [w.raw[i:j].tobytes() for i, j in zip(a, b)]))
            size += int((b - a).sum())
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _count(t: pa.Table) -> pa.Table:
    doc, start, length = M.unpack(t, "doc", np.int64), M.unpack(t, "start", np.int64), M.unpack(t, "length", np.int32)
    payload = b"".join(x.as_py() for x in t.column("payload"))
    offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    strings = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(payload)])
    w = T.words(strings)
    hashes = T.ngrams(w.hashes, M.WINDOW)
    at = np.flatnonzero(np.arange(len(hashes)) + M.WINDOW <= w.limit()[: len(hashes)])
    of = np.searchsorted(w.ptr, at, "right") - 1
    docs, least, _ = M.count_docs(hashes[at], doc[of])
    hit = docs > 1
    at, of, docs, least = at[hit], of[hit], docs[hit], least[hit]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))
    word = at - w.ptr[of] + start[of]
    reduced = lambda f, x: f.reduceat(x, begin) if len(begin) else x
    return pa.table({"doc_id": doc[of[begin]], "first": word[begin], "last": word[end - 1] if len(begin) else word, "first_copy": reduced(np.logical_and, least == doc[of]), "n_docs": reduced(np.maximum, docs)})


def super_kmer_repeats(documents: DataFrame, hot: int = M.HOT) -> DataFrame:
    docs = M.ids_and_text(documents)
    bits = M.bucket_bits(docs)
    table, often = M.repeated(docs, hot)
    strings = docs.mapInArrow(_strings(table, often, bits), "bucket int, doc binary, start binary, length binary, payload binary")
    found = strings.groupBy("bucket").applyInArrow(_count, "doc_id bigint, first bigint, last bigint, first_copy boolean, n_docs bigint")
    return M.passages(M.with_hot_windows(found, docs, often))


SQL = M.SQL
