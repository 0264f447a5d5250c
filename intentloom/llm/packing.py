"""Packing: concatenate all documents' tokens and cut the stream into windows of equal length.

1. Documents are ordered by (doc_id, text) through a range partitioning, tokenised once, and written to the
   shared folder with each one's offset in its partition. ``SEPARATOR`` follows each document.
2. The partitions' token totals are summed up in order: each partition learns its first global offset.
3. Each partition cuts its own part of the stream. Windows that lie in it are finished there and go straight to the
   result; a second scan sends on the two at its ends as boundary records (window, place in it,
   tokens), and only these are shuffled and joined.

The result does not depend on how the table is partitioned: (window_id, n_tokens, tokens, doc_ids,
starts), where document doc_ids[i] begins or goes on at tokens[starts[i]]. Every window has ``WINDOW`` tokens but
the last, which has what is left.

Defined results: a null text counts as empty; an empty text gives its separator alone; null doc_ids come first and
stay null in doc_ids; rows that share a doc_id come in the order of their texts, repeated rows one after
another; a text of any length is cut like any other; other columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text as T

#: a vocabulary in tiktoken's format and the pattern that it was made with
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SEPARATOR = 50256
WINDOW = 2048
#: distinct chunks that a task remembers
_CACHE = 1 << 20
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15


class Encoder:
    """Byte-pair encoding of whole batches: each distinct chunk is encoded once.

    A chunk begins at a single space or line break between two other characters. The pattern never
    matches across such a place, so the tokens of a text are those of its chunks. Chunks that are new are encoded
    in one call, one after another; but for those at a text's ends, where the pattern may go on.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode_text = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.n_bytes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.n_bytes[list(ranks.values())] = [len(t) for t in ranks]
        self._forget()
        self._grow(T.PIECE_BYTES)

    def _forget(self) -> None:
        self.known, self.first, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _grow(self, n: int) -> None:
        """Powers of the hash's base and of its inverse, for texts of up to ``n`` bytes."""
        self.power, self.inverse = T._powers(np.uint64(_BASE), n + 1), T._powers(np.uint64(pow(_BASE, -1, 1 << 64)), n + 1)

    def _chunks(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and hashes of all chunks."""
        blank = _BLANK[raw]
        begin = np.zeros(len(raw), bool)
        begin[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & ~blank[:-2] & ~blank[2:]
        begin[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(raw))
        if len(raw) >= len(self.power):
            self._grow(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.power[: len(raw)] * (raw.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        return starts, ends, T.mix((sums[ends] - sums[starts]) * self.inverse[starts])

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode chunks that are not known yet; hashes are sorted."""
        inner = np.isin(raw[starts], (10, 32)) & ~_BLANK[raw[np.minimum(starts + 1, len(raw) - 1)]] & (ends - starts > 1) & ~_BLANK[raw[ends - 1]]
        size, parts = np.zeros(len(starts), np.int64), []
        order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
        at, n = starts[inner], (ends - starts)[inner]
        if len(at):
            joined = raw[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
            tokens = np.array(self.encode_text(joined.decode()), np.uint32)
            stop = np.searchsorted(np.cumsum(self.n_bytes[tokens]), np.cumsum(n)) + 1
            size[inner] = np.diff(stop, prepend=0)
            parts.append(tokens)
        for i in np.flatnonzero(~inner).tolist():
            tokens = np.array(self.encode_text(raw[starts[i] : ends[i]].tobytes().decode()), np.uint32)
            size[i] = len(tokens)
            parts.append(tokens)
        first = np.empty(len(starts), np.int64)
        first[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.pool = np.concatenate([self.pool, *parts])
        place = np.searchsorted(self.known, hashes)
        self.known, self.first, self.size = (np.insert(old, place, new) for old, new in ((self.known, hashes), (self.first, first), (self.size, size)))

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, one after another, and where each text's begin (len + 1)."""
        raw, offsets = T.string_bytes(col)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, hashes = self._chunks(raw, offsets)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > _CACHE:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(np.append(self.known, np.uint64(0))[place] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            self._learn(raw, distinct[new], starts[at[new]], ends[at[new]])
            place = np.searchsorted(self.known, distinct)
        n = self.size[place][which]
        ends_out = np.cumsum(n)
        out = self.pool[np.repeat(self.first[place][which] - (ends_out - n), n) + np.arange(ends_out[-1])]
        return out, np.append(0, ends_out)[np.searchsorted(starts, offsets)]


def _tokenise(vocabulary, separator: int, kind: type):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, offset = TaskContext.get().partitionId(), Encoder(vocabulary.value), 0
        for batch in T.batches(rows):
            tokens, ptr = encoder.encode(batch.column("text"))
            tokens = np.insert(tokens, ptr[1:], separator).astype(kind)
            ptr = ptr + np.arange(len(ptr))
            texts = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ptr * tokens.itemsize).astype(np.int32)), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(offset + ptr[:-1]), batch.column("doc_id"), texts], ["part", "offset", "doc_id", "tokens"])
            offset += int(ptr[-1])

    return run


_WINDOWS = "window_id bigint, place int, tokens array<int>, doc_ids array<bigint>, starts array<int>"


def _cut(bases, window: int, whole: bool, kind: type):
    """The whole windows of each scanned part of the stream, or else the pieces at its ends."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(first: int, tokens: np.ndarray, begins: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
            """Windows of the stream's part from ``first`` on; documents begin at ``begins`` of it."""
            edge = np.arange(first // window + 1, (first + len(tokens) - 1) // window + 1) * window - first
            cut = np.concatenate([[0], edge, [len(tokens)]]).astype(np.int64)
            window_id = (first + cut[:-1]) // window
            # a document goes on in each window that begins within it
            start = np.union1d(begins, cut[:-1])
            owner = np.searchsorted(begins, start, "right") - 1
            of = np.searchsorted(cut, start, "right") - 1
            ptr = np.searchsorted(start, cut).astype(np.int32)
            size = np.diff(cut)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(window_id),
                    pa.array(((first + cut[:-1]) % window).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(tokens.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ptr), ids.take(pa.array(owner))),
                    pa.ListArray.from_arrays(pa.array(ptr), pa.array((start - cut[of]).astype(np.int32))),
                ],
                ["window_id", "place", "tokens", "doc_ids", "starts"],
            )
            keep = (size == window) == whole
            return batch if keep.all() else batch.filter(pa.array(keep))

        base = bases.value
        rest: tuple[int, np.ndarray, np.ndarray, pa.Array] | None = None
        for batch in T.batches(rows, "tokens", 4 << 20):
            raw, offsets = T.string_bytes(batch.column("tokens"))
            tokens, ptr = np.frombuffer(raw.tobytes(), kind), offsets // np.dtype(kind).itemsize
            at = np.array([base[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("offset").to_numpy()
            follows = np.concatenate([[False], at[1:] == at[:-1] + np.diff(ptr)[:-1]])
            breaks = np.append(np.flatnonzero(~follows), len(at))
            for i, j in zip(breaks[:-1], breaks[1:]):
                first, part, begins, ids = int(at[i]), tokens[ptr[i] : ptr[j]], ptr[i:j] - ptr[i], batch.column("doc_id").slice(i, j - i)
                if rest is not None:
                    if rest[0] + len(rest[1]) == first:
                        begins, ids = np.concatenate([rest[2], begins + len(rest[1])]), pa.concat_arrays([rest[3], ids])
                        first, part = rest[0], np.concatenate([rest[1], part])
                    else:
                        yield emit(*rest)
                    rest = None
                # hold back the unfinished window at the end
                done = (first + len(part)) // window * window - first
                if done <= 0:
                    rest = (first, part, begins, ids)
                    continue
                k = int(np.searchsorted(begins, done, "right")) - 1
                if done < len(part):
                    rest = (first + done, part[done:], np.append(0, begins[k + 1 :] - done), ids.slice(k))
                n = k + 1 if begins[k] < done else k
                yield emit(first, part[:done], begins[:n], ids.slice(0, n))
        if rest is not None:
            yield emit(*rest)

    return run


def _join(t: pa.Table) -> pa.Table:
    """The pieces of one window, in order."""
    pieces = sorted(t.to_pylist(), key=lambda r: r["place"])
    least = pieces[0]["place"]
    tokens, ids, starts = [], [], []
    for p in pieces:
        for i, s in zip(p["doc_ids"], p["starts"]):
            ids.append(i)
            starts.append(s + len(tokens))
        tokens += p["tokens"]
    return pa.table({"window_id": [pieces[0]["window_id"]], "place": pa.array([least], pa.int32()), "tokens": pa.array([tokens], pa.list_(pa.int32())), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int32()))})


def pack(documents: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(scratch.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    # two bytes a token where the vocabulary allows it
    kind = np.uint16 if max(separator, len(shared.value.split(b"\n"))) < 1 << 16 else np.uint32
    stream = scratch.materialise(ordered.mapInArrow(_tokenise(shared, separator, kind), "part int, offset bigint, doc_id bigint, tokens binary"), "tokens")
    totals = stream.groupBy("part").agg(F.max(F.col("offset") + F.octet_length("tokens") / np.dtype(kind).itemsize).cast("bigint").alias("n")).orderBy("part").collect()
    bases, base = {}, 0
    for r in totals:
        bases[r["part"]] = base
        base += r["n"]
    shared_bases = spark.sparkContext.broadcast(bases)
    # both read the same scan, hence the same parts
    whole, pieces = (stream.mapInArrow(_cut(shared_bases, window, w, kind), _WINDOWS) for w in (True, False))
    joined = pieces.groupBy("window_id").applyInArrow(_join, _WINDOWS)
    return whole.unionByName(joined).select("window_id", F.size("tokens").alias("n_tokens"), "tokens", "doc_ids", "starts")
