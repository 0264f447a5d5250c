"""Benchmark decontamination by latent semantic retrieval.

Which documents contain a benchmark item, word for word or paraphrased?

1. *Encode.* One scan turns each document into the sequence of its words' numbers in the benchmark's
   vocabulary (0: not in it, so in no match either), and counts documents by term. The encoded
   corpus is written to the shared folder; no later step reads the texts.
2. *Factorise.* Passages of ``PASSAGE`` words, each ``STRIDE`` after the last, are TF-IDF vectors (term frequency times idf) over the
   informative terms. A distributed randomised SVD finds their ``RANK`` leading right singular
   vectors: every partition adds up its part of (A'A) W for a random W; QR; once more for
   (A'A) Q; eigenvectors of Q'A'AQ. Only terms x (RANK + 10) numbers leave a partition, as fixed-point integers, so
   their sum doesn't depend on the order in which partitions are added.
3. *Search.* Passages and items are projected; each pair with a cosine of ``COSINE`` or more is a candidate. All
   passages are compared with all items.
4. *Check.* The longest common subsequence of an item's informative words with the passage and its
   surroundings, over the item's informative words. From ``SURE`` on it is a leak; from ``LIKELY`` on it is
   one if also ``ANSWER_SHARE`` of the informative words of the item's answer (its last sentence) are there.

A term is informative if at most ``MAX_SHARE`` of the documents (10 at least) contain it, or if it belongs to an
item that would else have fewer than ``LEAST_TERMS`` such terms. Vocabulary, basis and document frequencies are those of the whole
benchmark. Beyond ``MAX_COLUMNS`` informative terms several share a column of the matrix (the check goes by the terms themselves), so the basis that
is broadcast has 53 MB at most. Items are searched for ``BLOCK`` at a time, one scan of the encoded corpus for each; what is found
doesn't depend on ``BLOCK``. The vocabulary (8 bytes a term) grows with the benchmark alone.

Result: (doc_id, item_id, cosine, lcs_share), a row for each leak with the best values found.

Defined results: null and empty texts, of documents or items, match nothing; rows without doc_id
or item_id are left out; rows that share an id are alternatives and the best one counts;
repeated rows change nothing; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text as T
from .minimisers import ids_and_text

PASSAGE, STRIDE = 64, 32
RANK, OVERSAMPLING, SEED, NOISE = 192, 10, 20, 1e-5
COSINE = 0.25
SURE, LIKELY, ANSWER_SHARE = 0.6, 0.4, 0.8
MAX_SHARE, LEAST_TERMS = 0.1, 4
MAX_COLUMNS = 1 << 16
#: columns up to which a task multiplies by way of A'A (144 MB); beyond, row by row, which gives the same
GRAM_COLUMNS = 6000
#: items searched for in one scan, and compared at once
BLOCK, _ITEMS = 16_384, 256
_ROWS, _PAIRS = 1 << 14, 1 << 20
#: fixed point of the partial sums
_ONE = float(1 << 16)


class Items:
    """The benchmark: vocabulary, word sequences and answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        w = T.words(pa.array([t for _, t in rows], pa.string()))
        self.terms, number = np.unique(w.hashes, return_inverse=True)
        self.words = [number[a:b] for a, b in zip(w.ptr, w.ptr[1:])]
        self.answers = []
        for (_, text), own in zip(rows, self.words):
            sentences = [s for s in re.split(r"[.!?\n]+", text or "") if len(T.words(pa.array([s])).hashes)]
            n = len(T.words(pa.array([sentences[-1]])).hashes) if sentences else 0
            self.answers.append(own[len(own) - n :])

    def kind(self) -> type:
        return np.uint16 if len(self.terms) < 65535 else np.uint32

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Choose the informative terms: ``column`` by term (-1: none), ``idf`` by term and the number of columns; words and answers keep only these."""
        common = df > max(10, MAX_SHARE * n_docs)
        for own in self.words:
            if len(own) and len(np.unique(own[~common[own]])) < LEAST_TERMS:
                common[own] = False
        n = int((~common).sum())
        self.n_columns = min(n, MAX_COLUMNS)
        self.column = np.where(common, -1, (np.cumsum(~common) - 1) % MAX_COLUMNS).astype(np.int32)
        of_term = np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))).astype(np.float32) + np.float32(0.01)
        self.idf = np.zeros(self.n_columns, np.float32)
        np.maximum.at(self.idf, self.column[~common], of_term[~common])
        keep = lambda own: own[self.column[own] >= 0]
        self.lengths = [len(own) for own in self.words]
        self.words, self.answers = [keep(x) for x in self.words], [set(keep(x).tolist()) for x in self.answers]

    def block(self, at: int) -> "Items":
        """The items from ``at`` on, without vocabulary."""
        out = object.__new__(Items)
        for name in ("ids", "words", "answers", "lengths"):
            setattr(out, name, getattr(self, name)[at : at + BLOCK])
        return out


def _encode(terms, kind: type):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = terms.value
        df, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in T.batches(rows):
            w = T.words(batch.column("text"))
            at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
            number = np.where(vocabulary[at] == w.hashes, at + 1, 0)
            once = np.unique(w.text_of() * (len(vocabulary) + 1) + number)
            df += np.bincount(once % (len(vocabulary) + 1), minlength=len(df))
            n += batch.num_rows
            offsets = (w.ptr * np.dtype(kind).itemsize).astype(np.int32)
            encoded = pa.Array.from_buffers(pa.binary(), w.n_texts, [None, pa.py_buffer(offsets), pa.py_buffer(number.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), encoded, pa.nulls(w.n_texts, pa.binary())], ["doc_id", "words", "df"])
        if n:
            df[0] = n
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], ["doc_id", "words", "df"])

    return run


def _sum(kind: type):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            for x in batch.column("part"):
                part = np.frombuffer(x.as_buffer(), kind)
                total = part.copy() if total is None else np.add(total, part, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def _total(parts: DataFrame, kind: type) -> np.ndarray | None:
    """Sum of equally long arrays, one a row, in two levels; a task holds one array at a time, the driver gets one."""
    once = parts.repartition(max(2, math.isqrt(scratch.shuffle_partitions(parts.sparkSession)))).mapInArrow(_sum(kind), "part binary")
    row = once.repartition(1).mapInArrow(_sum(kind), "part binary").first()
    return None if row is None else np.frombuffer(row["part"], kind)


class Passages:
    """The TF-IDF rows of a batch of encoded documents.

    A text is cut into strides of ``STRIDE`` words; a passage is a stride that holds an informative word and the next
    one. A term's frequency in a passage is the number of its strides that hold it (so repetition is damped), hence a
    passage's row is the sum of its strides' rows and each word is worked on once, though passages overlap.
    """

    def __init__(self, batch: pa.RecordBatch, column: np.ndarray, kind: type):
        raw, offsets = T.string_bytes(batch.column("words"))
        self.ptr = offsets // np.dtype(kind).itemsize
        numbers = np.frombuffer(raw.tobytes(), kind)
        all_columns = np.append(np.int32(-1), column)[numbers]
        self.at = np.flatnonzero(all_columns >= 0)  # informative words, in order
        self.sequence = numbers[self.at].astype(np.int64) - 1  # their terms
        columns = all_columns[self.at]
        doc = np.searchsorted(self.ptr, self.at, "right") - 1
        self.base = np.concatenate([[0], np.cumsum(-(-np.diff(self.ptr) // STRIDE))])
        stride, d = self.base[doc] + (self.at - self.ptr[doc]) // STRIDE, len(column) + 1
        key = np.unique(stride * d + columns)
        stride, self.col = key // d, key % d
        self.begin = np.flatnonzero(np.diff(stride, prepend=-1))
        self.end = np.append(self.begin[1:], len(self.col))
        #: strides that hold an informative word; whether the next of these is the next of the same text
        self.held = stride[self.begin]
        self.doc = np.searchsorted(self.base, self.held, "right") - 1
        self.joined = np.append((self.held[1:] == self.held[:-1] + 1) & (self.doc[1:] == self.doc[:-1]), False)

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        """Slices of held strides, and of these with the one that the last is joined to."""
        i = 0
        while i < len(self.begin):
            j = min(len(self.begin), max(i + 1, int(np.searchsorted(self.end, self.begin[i] + _ROWS))))
            yield slice(i, j), slice(i, j + int(self.joined[j - 1]))
            i = j

    def project(self, own: slice, reach: slice, basis: np.ndarray) -> np.ndarray:
        """The passages that begin at strides ``own``, in the space of ``basis`` (rows scaled by idf)."""
        begin, size = self.begin[reach], (self.end - self.begin)[reach]
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], -size[order]
        z = np.zeros((len(begin), basis.shape[1]), np.float32)
        for k in range(-size[0]):
            n = int(np.searchsorted(size, -k))
            z[:n] += basis[self.col[begin[:n] + k]]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        z = z[back]
        follows = np.flatnonzero(self.joined[own])
        z[follows] = z[follows] + z[follows + 1]
        return z[: own.stop - own.start]

    def add_pairs(self, gram: np.ndarray) -> None:
        """Add each passage's product of its row, but for idf, with itself to ``gram``."""
        last = np.where(self.joined, np.append(self.end[1:], 0), self.end)
        size = last - self.begin
        for m in np.unique(size).tolist():
            first = self.begin[size == m]
            for i in range(0, len(first), max(1, _PAIRS // (m * m))):
                cols = self.col[first[i : i + max(1, _PAIRS // (m * m)), None] + np.arange(m)]
                np.add.at(gram.reshape(-1), (cols[:, :, None] * gram.shape[1] + cols[:, None, :]).ravel(), np.float32(1))

    def add_products(self, total: np.ndarray, basis: np.ndarray) -> None:
        """Add A'(A basis) of these passages' rows to ``total``, row by row."""
        for own, reach in self.blocks():
            z = self.project(own, reach, basis)
            for k in range(own.start, own.stop):
                to = self.end[k + 1] if self.joined[k] else self.end[k]
                np.add.at(total, self.col[self.begin[k] : to], z[k - own.start])


def _gram_times(column, basis, kind: type):
    """This partition's part of A'(A B) = (A'A) B, but for the scaling of its rows by idf."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        small, any_ = len(b) <= GRAM_COLUMNS, False
        total = np.zeros((len(b), len(b)) if small else b.shape, np.float32)
        for batch in T.batches(rows, "words"):
            p = Passages(batch, column.value, kind)
            p.add_pairs(total) if small else p.add_products(total, b)
            any_ |= len(p.begin) > 0
        if any_:
            part = np.rint((total @ b if small else total).astype(np.float64) * _ONE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], ["part"])

    return run


def lcs(masks: dict[int, int], n: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: masks has the places of each word in the one of n words."""
    full = (1 << n) - 1
    v = full
    for x in sequence:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def place_masks(own: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(own.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _search(items, column, basis, latent, kind: type):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = items.value
        b, queries = basis.value, latent.value
        masks: dict[int, dict[int, int]] = {}
        n_terms = len(column.value)
        member = np.unique(np.concatenate([np.unique(own) + i * n_terms for i, own in enumerate(it.words)]))
        lengths, informative = np.array(it.lengths), np.array([len(own) for own in it.words])
        for batch in T.batches(rows, "words"):
            p = Passages(batch, column.value, kind)
            ids = batch.column("doc_id").to_numpy()
            out = []
            for own, reach in p.blocks():
                z = p.project(own, reach, b)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                for q in range(0, len(queries), _ITEMS):
                    cosine = z @ queries[q : q + _ITEMS].T
                    row, item = np.nonzero(cosine >= COSINE)
                    near, item = cosine[row, item], item + q
                    doc = p.doc[own][row]
                    start = p.ptr[doc] + (p.held[own][row] - p.base[doc]) * STRIDE
                    x = np.searchsorted(p.at, np.maximum(p.ptr[doc], start - lengths[item]))
                    y = np.searchsorted(p.at, np.minimum(p.ptr[doc + 1], start + PASSAGE + lengths[item]))
                    # the common subsequence is no longer than the number of the surroundings' words that the item has
                    size, need = y - x, LIKELY * informative[item]
                    can = np.flatnonzero((size >= need) & (size > 0))
                    near, item, doc, x, y, size, need = (v[can] for v in (near, item, doc, x, y, size, need))
                    if not len(near):
                        continue
                    first = np.cumsum(size) - size
                    at = np.repeat(x - first, size) + np.arange(size.sum())
                    wanted = p.sequence[at] + np.repeat(item, size) * n_terms
                    has = member[np.minimum(np.searchsorted(member, wanted), len(member) - 1)] == wanted
                    can = np.flatnonzero(np.add.reduceat(has.astype(np.int64), first) >= need)
                    for c, i, d, u, v in zip(near[can].tolist(), item[can].tolist(), doc[can].tolist(), x[can].tolist(), y[can].tolist()):
                        n, region = len(it.words[i]), p.sequence[u:v].tolist()
                        if i not in masks:
                            masks[i] = place_masks(it.words[i])
                        share = lcs(masks[i], n, region) / n
                        if share >= SURE or share >= LIKELY and len(it.answers[i].intersection(region)) >= ANSWER_SHARE * len(it.answers[i]):
                            out.append((int(ids[d]), int(it.ids[i]), c, share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["doc_id", "item_id", "cosine", "lcs_share"])

    return run


_LEAKS = "doc_id bigint, item_id bigint, cosine double, lcs_share double"


def _leaks(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame | None:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    items = Items(rows)
    if not len(items.terms):
        return None
    kind = items.kind()
    encoded = scratch.materialise(docs.mapInArrow(_encode(share(items.terms), kind), "doc_id bigint, words binary, df binary"), "encoded")
    counted = _total(encoded.filter("df IS NOT NULL").select(F.col("df").alias("part")), np.int64)
    if counted is None:
        return None
    items.weigh(counted[1:], int(counted[0]))
    column = share(items.column)
    corpus = encoded.filter("words IS NOT NULL").select("doc_id", "words")
    basis = np.random.default_rng(SEED).standard_normal((items.n_columns, min(items.n_columns, RANK + OVERSAMPLING))).astype(np.float32)
    for last in (False, True):
        product = _total(corpus.select("words").mapInArrow(_gram_times(column, share(basis * items.idf[:, None]), kind), "part binary"), np.int64)
        if product is None:
            return None
        product = product.reshape(basis.shape) / _ONE * items.idf[:, None]
        if last:
            values, vectors = np.linalg.eigh((basis.T.astype(np.float64) @ product + product.T @ basis) / 2)
            best = np.argsort(-values)[:RANK]
            # directions that the passages don't have are rounding errors
            basis = (basis @ vectors[:, best[values[best] > NOISE * values.max()]]).astype(np.float32)
        else:
            basis = np.linalg.qr(product)[0].astype(np.float32)
    queries = np.zeros((len(rows), basis.shape[1]), np.float32)
    for i, own in enumerate(items.words):
        if len(own):
            cols = np.unique(items.column[own])
            q = items.idf[cols] @ basis[cols]
            queries[i] = q / max(np.linalg.norm(q), 1e-12)
    scaled = share(basis * items.idf[:, None])
    return reduce(DataFrame.unionByName, [corpus.mapInArrow(_search(share(items.block(i)), column, scaled, share(queries[i : i + BLOCK]), kind), _LEAKS) for i in range(0, len(rows), BLOCK)])


def latent_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    docs = ids_and_text(documents)
    wanted = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    found = _leaks(docs, [tuple(row) for row in wanted.toLocalIterator()])
    if found is None:
        return documents.sparkSession.createDataFrame([], _LEAKS)
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("cosine"), 4).alias("cosine"), F.round(F.max("lcs_share"), 4).alias("lcs_share"))
