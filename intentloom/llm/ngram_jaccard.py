"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

Which documents have sets of word n-grams with a Jaccard similarity of ``threshold`` or more?

1. *Profile.* One scan hashes each document's n-grams into a sorted set, and counts documents by gram
   in a hashed table of fixed size (so what is broadcast does not grow with the data).
2. *Keys.* Two sets within the threshold share ``SHARED`` grams (or all that they need to share, if fewer) among the
   s - ceil(t s) + ``SHARED`` rarest of each, in the common order (count, hash) (extended prefix filter, exact).
   Each of these rare grams is a key, by 32 of its bits; what these bits confuse only adds candidates.
3. *Labels.* Sets that agree in one of ``TAGS`` tags (the least of their keys in as many hashed orders) and whose sketches look
   alike are given one label. A label is only a guess at who belongs together: pairs of one label are all compared
   in tiles (5), pairs of two labels are found by their keys (4), so none is lost whatever the labels.
4. *Candidates.* Keys travel packed, a row for each bucket of keys with arrays of thousands; in a bucket those of one
   label only are dropped, and sets of different labels (or without one) meet if their sizes are within the band [t s, s / t]. A meeting
   counts only where ``SHARED`` - 1 earlier grams and all later ones would be enough overlap, which holds at the first ``SHARED`` common
   grams of each pair within the threshold; pairs with fewer meetings than these are no candidates. A key that more than ``HOT`` documents may
   have is split: its sets go in blocks, and each pair of blocks is a group of its own.
5. *Tiles.* The sets of a label are split into size bands, a band into blocks of bounded number and size; a tile is two
   blocks of the same or neighbouring bands. Candidates of different labels are put into tiles by cluster, band and block. In a tile, the
   parity bitmaps of two sets differ in no more bits than the sets differ in grams, so
   (|A| + |B| - popcount(a ^ b)) / 2 bounds the overlap from above; pairs that pass are
   intersected exactly, as sorted arrays. A tile gives a row for each of its sets: how many documents it is linked with
   there, and the least set that it is connected with. Pairs leave no tile, so what travels grows with the sets.

``keep_one`` needs no number of links, only what is connected. For it the sets of a label are compared in blocks before (4), a pair that is connected
already isn't looked at, and what is connected then is the label for (4); see ``linked_sets``.

Result: (doc_id, class_id, n_links), a row for each document that is linked with another one. n_links: with how many
documents it is within the threshold, copies of the same set included; class_id: the least doc_id among those that it is
connected with, over any number of links. No partner, candidate or class is capped.

Defined results: a null text counts as empty; a text without words has no links; one of fewer than n
words has its whole word sequence as its only gram; rows without doc_id are left out (``keep_one`` has them); rows with the same doc_id
and the same set are one document; rows that share a doc_id but have different sets are a document each, with a row
each; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, text as T
from .minimisers import from_planes, pack, planes, runs, unpack

N = 2
THRESHOLD = 0.6
TABLE_BITS = 20
SIGNATURE_BITS = 2048
TAGS, SHARED, SKETCH, ALIKE = 6, 4, 32, 0.35
#: documents that may have a key, and multiples of the mean over the table, beyond which the key is split
HOT, HOT_MEANS = 1 << 16, 32
#: keys in a packed batch; pairs looked at at once
FLUSH, _PAIRS = 1 << 20, 1 << 20
#: sets and grams in a block of a label
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 20
#: candidate pairs in a tile before it is cut into blocks
TILE_PAIRS = 50_000
#: bits of the table of the ids that are looked for: 2 MB
SLOT_BITS = 24
_SLOT_CHUNK = 18
_SALTS = (T.mix(np.arange(1, TAGS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CHUNK = 1 << 16
_TABLE = (1 << TABLE_BITS) - 1


def sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    w = T.words(col)
    if not len(w.hashes):
        return [np.zeros(0, np.uint64)] * w.n_texts
    grams, out = T.ngrams(w.hashes, n), []
    for i in range(w.n_texts):
        a, b = int(w.ptr[i]), int(w.ptr[i + 1])
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        else:
            out.append(T.ngrams(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    """One number for a set; as a signed 64-bit integer."""
    return int(T.mix(T.mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def needed(size: int, threshold: float) -> int:
    """Least overlap with a partner of a set of this size."""
    return math.ceil(threshold * size - 1e-9)


def key_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


_PROFILE = "kind int, key bigint, doc_id bigint, set_hash bigint, size bigint, counts binary"


def _profile(n: int):
    names = [c.split()[0] for c in _PROFILE.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        for batch in T.batches(rows):
            found = sets(batch.column("text"), n)
            sizes = np.array([len(s) for s in found], np.int64)
            table += np.bincount(key_of(np.concatenate(found)) & np.uint32(_TABLE), minlength=1 << TABLE_BITS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), np.int32)), batch.column("key"), batch.column("doc_id"), pa.array([set_hash(s) for s in found], pa.int64()), pa.array(sizes), pa.nulls(len(found), pa.binary())], names)
        if table.any():
            chunks = [table[i : i + _CHUNK].tobytes() for i in range(0, len(table), _CHUNK)]
            k = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(np.arange(k)), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.array(chunks, pa.binary())], names)

    return run


def _add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum by chunk; a task holds one array for each of its chunks."""
    total: dict[int, np.ndarray] = {}
    for batch in rows:
        for i, x in zip(batch.column("key").to_pylist(), batch.column("counts")):
            part = np.frombuffer(x.as_buffer(), np.uint32)
            total[i] = np.add(total[i], part, out=total[i]) if i in total else part.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["key", "counts"])


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte of the least hash in each of ``SKETCH`` equal ranges of hashes; 0: none is in it."""
    shift = np.uint64(64 - SKETCH.bit_length() + 1)
    bins = np.arange(SKETCH, dtype=np.uint64)
    at = np.minimum(np.searchsorted(s, bins << shift), len(s) - 1)
    return np.where(s[at] >> shift == bins, (s[at] >> np.uint64(40)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == b) & (a > 0)).sum(axis=1) >= ALIKE * ((a > 0) | (b > 0)).sum(axis=1)


def link(tag: np.ndarray, owner: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between sets of one tag that look alike, each with the tag's first or with its neighbour; which ones stand for the tag further on."""
    order = np.lexsort((owner, tag))
    tag, own, seen = tag[order], owner[order], look[order]
    begin, end = runs(tag)
    first = np.repeat(begin, end - begin)
    at = np.flatnonzero(first != np.arange(len(tag)))
    with_first, with_last = _alike(seen[at], seen[first[at]]), _alike(seen[at], seen[at - 1])
    to = np.where(with_first, first[at], at - 1)
    linked = (with_first | with_last) & (own[at] != own[to])
    alone = np.ones(len(tag), bool)
    alone[at[with_first | with_last]] = False
    return own[at[linked]], own[to[linked]], order[alone]


_SETS = "kind int, owner bigint, size int, keys binary, bucket int, a binary, b binary, c binary"
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _encoded(n: int, threshold: float, buckets: int, table):
    """Distinct sets with their keys (kind 0), entries of tags in packed buckets (1), links of tags within the task (2)."""
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _SETS.split(", ")])

    def rows_of(**columns) -> pa.RecordBatch:
        k = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(table.value, np.uint32)
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            owner = np.array([h[0] for h in held], np.int64)
            yield rows_of(kind=pa.array(np.zeros(len(held), np.int32)), owner=pa.array(owner), size=pa.array([h[1] for h in held]), keys=pa.array([h[2].tobytes() for h in held], pa.binary()))
            tag = (np.stack([h[3] for h in held]).astype(np.uint64) << np.uint64(3) | np.arange(TAGS, dtype=np.uint64)).ravel()
            owners, looks = np.repeat(owner, TAGS), np.repeat(np.stack([h[4] for h in held]), TAGS, axis=0)
            u, v, alone = link(tag, owners, looks)
            if len(u):
                yield rows_of(kind=pa.array([2]), a=pa.array([u.tobytes()], pa.binary()), b=pa.array([v.tobytes()], pa.binary()))
            packed = pack((T.mix(tag[alone]) % np.uint64(buckets)).astype(np.int64), {"a": tag[alone], "b": owners[alone], "c": looks[alone]})
            yield rows_of(kind=pa.array(np.ones(packed.num_rows, np.int32)), **{c: packed.column(c) for c in ("bucket", "a", "b", "c")})

        for batch in T.batches(rows):
            for s in sets(batch.column("text"), n):
                if not len(s) or (h := set_hash(s)) in seen:
                    continue
                seen.add(h)
                rarity = counts[key_of(s) & np.uint32(_TABLE)]
                keys = key_of(s[np.argsort(rarity, kind="stable")[: len(s) - needed(len(s), threshold) + SHARED]])
                held.append((h, len(s), keys, keys[(keys[:, None] * _SALTS).argmin(axis=0)], sketch(s)))
                n_held += len(keys)
                if n_held >= FLUSH:
                    yield from flush()
                    held, n_held = [], 0
            if len(seen) > 1 << 20:
                seen.clear()
        if held:
            yield from flush()

    return run


def _links_of(t: pa.Table) -> pa.Table:
    u, v, _ = link(unpack(t, "a", np.uint64), unpack(t, "b", np.int64), unpack(t, "c", np.uint8).reshape(-1, SKETCH))
    return pa.table([pa.array(u), pa.array(v)], schema=_LINKS)


def _links_in(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for a, b in zip(batch.column("a"), batch.column("b")):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (a, b)], schema=_LINKS)


def _spread(buckets: int, table):
    """(bucket, id, label, size, key, place, side), packed: each set's keys to their buckets, split keys to all pairs of blocks that the set is in."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(table.value, np.uint32)
        hot = max(HOT, HOT_MEANS * int(counts.mean()))
        for batch in T.batches(rows, "keys", 4 * FLUSH):
            raw, offsets = T.string_bytes(batch.column("keys"))
            key, ptr = np.frombuffer(raw.tobytes(), np.uint32), offsets // 4
            n = np.diff(ptr)
            place = (np.arange(len(key)) - np.repeat(ptr[:-1], n)).astype(np.int32)
            ids, label, size = (np.repeat(batch.column(c).to_numpy().astype(kind), n) for c, kind in (("id", np.int64), ("label", np.uint64), ("size", np.int32)))
            blocks = -(-counts[key & np.uint32(_TABLE)].astype(np.int64) // hot)
            times = np.maximum(blocks, 1)
            at = np.repeat(np.arange(len(key)), times)
            key, place, ids, label, size, blocks = (x[at] for x in (key, place, ids, label, size, blocks))
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            own = (T.mix(ids.view(np.uint64)) % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64)
            low, high = np.minimum(own, other), np.maximum(own, other)
            side = np.where(own == other, 2, np.where(own < other, 0, 1)).astype(np.uint8)
            split = T.mix(T.mix(key.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)) + high.astype(np.uint64))
            key = np.where(blocks > 1, key_of(split), key).astype(np.uint32)
            yield pack((key % np.uint32(buckets)).astype(np.int64), {"id": ids, "label": label, "size": size, "own": key, "place": place, "side": side}, planes)

    return run


def _ranges(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each i and each j from begin[i] to end[i], in pieces of about ``_PAIRS``."""
    n = np.maximum(end - begin, 0)
    total, at = np.cumsum(n), 0
    while at < len(n):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + _PAIRS, "right")))
        i = np.repeat(np.arange(at, to), n[at:to])
        yield i, begin[i] + np.arange(len(i)) - np.repeat(total[at:to] - n[at:to] - done, n[at:to])
        at = to


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("larger", pa.int64()), ("need", pa.int64()), ("weight", pa.int64())])


def _meet(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        own, label, owner = from_planes(t, "own", np.uint32), from_planes(t, "label", np.uint64), from_planes(t, "id", np.int64)
        size, place, side = from_planes(t, "size", np.int32).astype(np.int64), from_planes(t, "place", np.int32), from_planes(t, "side", np.uint8)
        order = np.lexsort((size, label, own))
        own, label, owner, size, place, side = (x[order] for x in (own, label, owner, size, place, side))
        begin, end = runs(own)
        group_end = np.repeat(end, end - begin)
        begin, end = runs(np.cumsum(np.append(False, (own[1:] != own[:-1]) | (label[1:] != label[:-1]))))
        run_end, number = np.repeat(end, end - begin), np.repeat(np.arange(len(begin), dtype=np.int64), end - begin)
        # sets without label meet each other as far as the size band goes
        i = np.flatnonzero(label == 0)
        band = np.searchsorted(number << 32 | size, number[i] << 32 | (size[i] / threshold + 1e-6).astype(np.int64), "right")
        found = []
        for at, first, last in ((i, i + 1, band), (np.arange(len(own)), run_end, group_end)):
            for x, y in _ranges(first, last):
                x = at[x]
                near = ((side[x] == 2) | (side[x] != side[y])) & (owner[x] != owner[y])
                near &= np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
                x, y = x[near], y[near]
                least = np.ceil((size[x] + size[y]) * threshold / (1 + threshold) - 1e-9).astype(np.int64)
                take = SHARED - 1 + np.minimum(size[x] - place[x], size[y] - place[y]) >= least
                x, y, need = x[take], y[take], np.minimum(SHARED, least[take])
                if len(x):
                    found.append(np.stack([np.minimum(owner[x], owner[y]), np.maximum(owner[x], owner[y]), np.maximum(size[x], size[y]), need]))
        a, b, larger, need = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        order = np.lexsort((b, a))
        a, b, larger, need = (v[order] for v in (a, b, larger, need))
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return pa.table([pa.array(v) for v in (a[at], b[at], larger[at], need[at], np.diff(np.append(at, len(a))))], schema=_MET)

    return run


def _met_in_buckets(threshold: float, buckets: int):
    """What meets in a bucket of keys, packed by pair."""
    meet = _meet(threshold)

    def run(t: pa.Table) -> pa.Table:
        a, b, larger, need, weight = (c.to_numpy() for c in meet(t).columns)
        bucket = T.mix(T.mix(a.view(np.uint64)) + b.view(np.uint64)) % np.uint64(buckets)
        columns = {"a": a, "b": b, "larger": larger.astype(np.int32), "need": need.astype(np.uint8), "weight": weight.astype(np.int32)}
        return pa.Table.from_batches([pack(bucket.astype(np.int64), columns, planes)])

    return run


def _met_enough(t: pa.Table) -> pa.Table:
    """Pairs that met as often as they need to."""
    a, b, larger, need, weight = (from_planes(t, c, kind) for c, kind in (("a", np.int64), ("b", np.int64), ("larger", np.int32), ("need", np.uint8), ("weight", np.int32)))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    enough = np.add.reduceat(weight[order], at, dtype=np.int64) >= need[order][at]
    return pa.table({"a": a[at][enough], "b": b[at][enough], "larger": larger[order][at][enough].astype(np.int64)})


def _slots(t: pa.Table) -> pa.Table:
    slot = t.column("slot").to_numpy()
    bits = np.zeros(1 << _SLOT_CHUNK, np.uint8)
    bits[slot & ((1 << _SLOT_CHUNK) - 1)] = 1
    return pa.table({"chunk": pa.array(slot[:1] >> _SLOT_CHUNK), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _slot(ids: np.ndarray) -> np.ndarray:
    return (T.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _only(rows_: DataFrame, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Those of ``rows_`` whose key may be among ``keys``, or else those whose key certainly isn't: a table of fixed size in place of a shuffle of all texts; the join that follows is exact."""

    return _filtered(rows_, _slot_table(keys, key), key, inside)


def _to_slots(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        slot = np.unique(_slot(batch.column(0).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(slot >> _SLOT_CHUNK), pa.array(slot)], ["chunk", "slot"])


def _slot_table(keys: DataFrame, key: str):
    slots = keys.select(key).mapInArrow(_to_slots, "chunk bigint, slot bigint")
    chunks = slots.groupBy("chunk").applyInArrow(_slots, "chunk bigint, bits binary").collect()
    size = 1 << (_SLOT_CHUNK - 3)
    table = bytearray(1 << (SLOT_BITS - 3))
    for r in chunks:
        table[r["chunk"] * size : (r["chunk"] + 1) * size] = r["bits"]
    return slots.sparkSession.sparkContext.broadcast(bytes(table))


def _filtered(rows_: DataFrame, shared, key: str, inside: bool) -> DataFrame:
    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in rows:
            slot = _slot(batch.column(key).to_numpy())
            there = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(there == inside))

    return rows_.mapInArrow(keep, rows_.schema)


def _signature(s: np.ndarray) -> np.ndarray:
    """A bit for each slot that an odd number of the set's grams hashes to."""
    odd = np.bincount(((s >> np.uint64(40)) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Tile:
    """The sets of one tile: which of them are within the threshold of which; if not ``counted``, only which are connected, so a pair that is connected already isn't looked at."""

    def __init__(self, members: dict[int, tuple[int, int, np.ndarray]], threshold: float, counted: bool = True):
        self.owner = np.array(list(members), np.int64)
        self.copies = np.array([c for c, _, _ in members.values()], np.int64)
        self.side = np.array([s for _, s, _ in members.values()])
        self.sizes = np.array([len(s) for _, _, s in members.values()], np.int64)
        self.ptr = np.append(0, np.cumsum(self.sizes))
        arrays = [s for _, _, s in members.values()]
        self.signs = np.stack([_signature(s) for s in arrays])
        # each gram as its place among the tile's grams, so a set stays a sorted array
        grams, self.rank = np.unique(np.concatenate(arrays), return_inverse=True)
        self.mark = np.zeros(len(grams), bool)
        self.threshold, self.counted = threshold, counted
        self.links, self.root = np.zeros(len(arrays), np.int64), np.arange(len(arrays))

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.root[at]
        while len(r) and ((up := self.root[r]) != r).any():
            r = up
        self.root[at] = r
        return r

    def may(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs (x, y) that their bitmaps don't rule out, with the overlap that they need."""
        both = self.sizes[x] + self.sizes[y]
        differ = np.concatenate([np.bitwise_count(self.signs[x[k : k + 8192]] ^ self.signs[y[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 8192)]) if len(x) else both
        least = np.ceil(both * self.threshold / (1 + self.threshold) - 1e-9)
        may = (both - differ) // 2 >= least
        return x[may], y[may], least[may]

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Link the pairs (x, y), of which x is sorted, that are within the threshold."""
        if self.counted:
            x, y, least = self.may(x, y)
        for a, b in zip(*runs(x)):
            i, others = int(x[a]), y[a:b]
            if self.counted:
                need = least[a:b]
            else:
                others = others[self.roots(others) != self.roots(np.array([i]))]
                _, others, need = self.may(np.full(len(others), i), others)
                if not len(others):
                    continue
            own = self.rank[self.ptr[i] : self.ptr[i + 1]]
            self.mark[own] = True
            n = self.sizes[others]
            first = np.cumsum(n) - n
            at = np.repeat(self.ptr[others] - first, n) + np.arange(n.sum())
            overlap = np.add.reduceat(self.mark[self.rank[at]], first, dtype=np.int64)
            self.mark[own] = False
            near = others[overlap >= need]
            self.links[i] += self.copies[near].sum()
            self.links[near] += self.copies[i]
            joined = np.unique(self.roots(np.append(near, i)))
            self.root[joined] = joined[0]

    def compare_all(self) -> None:
        order = np.lexsort((self.sizes, self.side))
        size, side = self.sizes[order], self.side[order]
        i = np.flatnonzero(side != 1)
        other = np.where(side == 0, np.searchsorted(side, 1), np.arange(len(side)) + 1)[i]
        end = np.searchsorted(side << 32 | size, np.where(side == 0, 1, side)[i] << 32 | (size[i] / self.threshold + 1e-6).astype(np.int64), "right")
        begin = np.where(side[i] == 0, np.searchsorted(side << 32 | size, 1 << 32 | np.ceil(size[i] * self.threshold - 1e-6).astype(np.int64)), other)
        for x, y in _ranges(begin, end):
            self.compare(order[i[x]], order[y])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.links)
        least: dict[int, int] = {}
        roots = self.roots(at).tolist()
        for i, r in zip(at.tolist(), roots):
            least[r] = min(least.get(r, self.owner[i]), self.owner[i])
        return self.owner[at], self.links[at], np.array([least[r] for r in roots], np.int64)


_LINKED = pa.schema([("owner", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])
#: a tile's side for sets of given pairs
GIVEN = 3


def _verify(n: int, threshold: float, counted: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, pairs, out = None, {}, [], []

        def done() -> None:
            if len(members) > 1:
                tile = Tile(members, threshold, counted)
                if pairs:
                    index = {h: i for i, h in enumerate(members)}
                    ab = np.array([(index[a], index[b]) for a, b in pairs if a in index and b in index], np.int64).reshape(-1, 2)
                    ab = ab[np.argsort(ab[:, 0], kind="stable")]
                    for k in range(0, len(ab), _PAIRS):
                        tile.compare(ab[k : k + _PAIRS, 0], ab[k : k + _PAIRS, 1])
                else:
                    tile.compare_all()
                out.append(tile.rows())

        def taken() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], schema=_LINKED)
                out.clear()

        for batch in T.batches(rows):
            found = sets(batch.column("text"), n)
            for t, kind, a, b, side, s in zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "a", "b", "side")), found):
                if t != now:
                    done()
                    now, members, pairs = t, {}, []
                if kind:
                    pairs.append((a, b))
                elif set_hash(s) == a:
                    members[a] = (b, side, s)
            yield from taken()
        done()
        yield from taken()

    return run


def _row_key() -> Column:
    """The same for rows with the same doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def rows_with_keys(documents: DataFrame) -> DataFrame:
    return documents.select(_row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _label_tiles(labelled: DataFrame, threshold: float) -> DataFrame:
    """(tile, side, set_hash) of (owner, label, size): the tiles that each set is in."""
    # a little wider than the threshold needs, so that rounding puts no pair two bands apart
    band = F.floor(F.log("size") / (1.001 * math.log(1 / min(threshold, 0.99))))
    sized = labelled.withColumn("band", band)
    n = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_GRAMS))
    blocks = sized.groupBy("label", "band").agg(n.alias("n"))
    near = [blocks.select("label", (F.col("band") + by).alias("band"), F.col("n").alias(name)) for by, name in ((1, "before"), (-1, "after"))]
    for x in near:
        blocks = blocks.join(x, ["label", "band"], "left")
    own = sized.join(blocks, ["label", "band"]).withColumn("i", F.pmod(F.xxhash64("owner"), F.col("n")))

    def tiles(n: Column, low: Column, high: Column, of, side) -> Column:
        """One for each of n blocks j."""
        j = F.sequence(F.lit(0).cast("bigint"), F.coalesce(n, F.lit(0)).cast("bigint"))
        return F.transform(F.filter(j, lambda j: j < F.coalesce(n, F.lit(0))), lambda j: F.struct(F.xxhash64(F.lit("label"), "label", low, high, *of(j)).alias("tile"), side(j).cast("int").alias("side")))

    i, at = F.col("i"), F.col("band")
    same = tiles(F.col("n"), at, at, lambda j: (F.least(i, j), F.greatest(i, j)), lambda j: F.when(i == j, 2).when(i < j, 0).otherwise(1))
    up = tiles(F.col("after"), at, at + 1, lambda j: (i, j), lambda j: F.lit(0))
    down = tiles(F.col("before"), at - 1, at, lambda j: (j, i), lambda j: F.lit(1))
    return own.select(F.col("owner").alias("set_hash"), F.explode(F.concat(same, up, down)).alias("t")).select("t.tile", "t.side", "set_hash")


def _block_tiles(labelled: DataFrame) -> DataFrame:
    """(tile, side, set_hash) of (owner, label, size): blocks of each label, if there are several by two hashes, so that a set is in two tiles at most."""
    n = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_GRAMS))
    own = labelled.join(labelled.groupBy("label").agg(n.alias("n")), "label")
    by = [F.xxhash64(F.lit("block"), "label", F.lit(k), F.pmod(F.xxhash64(F.lit(k), "owner"), F.col("n"))) for k in (0, 1)]
    return own.select(F.explode(F.when(F.col("n") > 1, F.array(*by)).otherwise(F.array(by[0]))).alias("tile"), F.lit(2).alias("side"), F.col("owner").alias("set_hash"))


def _pair_tiles(candidates: DataFrame, threshold: float) -> DataFrame:
    """(tile, a, b): candidates by cluster, size band of the larger set and block."""
    label = candidates.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("label"))
    band = F.floor(F.log("larger") / math.log(1 / min(threshold, 0.99)))
    tiled = candidates.join(label, "a", "left").select("a", "b", F.coalesce("label", "a").alias("label"), band.alias("band"))
    many = tiled.groupBy("label", "band").count().filter(F.col("count") > TILE_PAIRS).select("label", "band", F.ceil(F.sqrt(F.col("count") / TILE_PAIRS)).alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    return tiled.join(many, ["label", "band"], "left").select(F.xxhash64(F.lit("pair"), "label", "band", F.pmod(F.xxhash64("a"), blocks), F.pmod(F.xxhash64("b"), blocks)).alias("tile"), "a", "b")


def _in_tiles(docs: DataFrame, known: DataFrame, members: DataFrame, pairs: DataFrame | None, n: int, threshold: float, counted: bool) -> DataFrame:
    """(owner, links, least) of the sets ``members`` in each tile; where it has ``pairs``, only these are compared."""
    sent = scratch.materialise(members.join(known.select("set_hash", "key", "copies"), "set_hash"), "members")
    text = _only(docs.select("key", "text"), sent, "key").dropDuplicates(["key"])
    rows = sent.join(text, "key").select("tile", F.lit(0).alias("kind"), F.col("set_hash").alias("a"), F.col("copies").alias("b"), "side", "text")
    if pairs is not None:
        rows = rows.unionByName(pairs.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(GIVEN).alias("side"), F.lit(None).cast("string").alias("text")))
    found = rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(_verify(n, threshold, counted), "owner bigint, links bigint, least bigint")
    found = scratch.materialise(found, "links")
    scratch.discard(sent)
    return found


def linked_sets(docs: DataFrame, n: int, threshold: float, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of (key, doc_id, text): the profile (key, doc_id, set_hash, size), and (owner, links, least) of the sets in each tile.

    If not ``counted``, they only say which sets are connected. Then the sets of a label are compared in blocks until all that
    are linked there are connected, so the work and what travels grow with the sets and not with their pairs; what is connected by then is
    the new label, and only pairs of different ones are looked for by their keys: all other links are within what is connected.
    """
    spark = docs.sparkSession
    profile = scratch.materialise(docs.mapInArrow(_profile(n), _PROFILE), "profile")
    chunks = {r["key"]: r["counts"] for r in profile.filter("kind = 1").select("key", "counts").repartition("key").mapInArrow(_add, "key bigint, counts binary").collect()}
    table = spark.sparkContext.broadcast(b"".join(chunks.get(i, bytes(4 * _CHUNK)) for i in range((1 << TABLE_BITS) // _CHUNK)))
    buckets = scratch.shuffle_partitions(spark)
    owners = profile.filter("kind = 0 AND size > 0").groupBy("key", "doc_id", "set_hash", "size").agg(F.count("*").alias("n_rows"))
    known = owners.groupBy("doc_id", "set_hash", "size").agg(F.min("key").alias("key")).groupBy("set_hash", "size").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    encoded = scratch.materialise(docs.select("text").mapInArrow(_encoded(n, threshold, buckets, table), _SETS), "sets")
    within = encoded.filter("kind = 2").select("a", "b").mapInArrow(_links_in, "u bigint, v bigint")
    across = encoded.filter("kind = 1").select("bucket", "a", "b", "c").groupBy("bucket").applyInArrow(_links_of, "u bigint, v bigint")
    labels = components(within.unionByName(across), "u", "v").select(F.col("doc_id").alias("owner"), F.col("group_id").alias("label"))
    sized = labels.join(known.select(F.col("set_hash").alias("owner"), "size"), "owner")
    if not counted:
        labels = components(_in_tiles(docs, known, _block_tiles(sized), None, n, threshold, False), "owner", "least").select(F.col("doc_id").alias("owner"), F.col("group_id").alias("label"))
    label = F.when(F.col("label") == 0, 1).otherwise(F.col("label"))
    distinct = encoded.filter("kind = 0").select("owner", "size", "keys").dropDuplicates(["owner"]).join(labels.select("owner", label.alias("label")), "owner", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    # ids of sets that lie together differ in few bytes, their hashes in all
    distinct = scratch.materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    scratch.discard(encoded)
    spread = distinct.mapInArrow(_spread(4 * buckets, table), "bucket int, id binary, label binary, size binary, own binary, place binary, side binary")
    met = spread.groupBy("bucket").applyInArrow(_met_in_buckets(threshold, buckets), "bucket int, a binary, b binary, larger binary, need binary, weight binary")
    met = met.groupBy("bucket").applyInArrow(_met_enough, "a bigint, b bigint, larger bigint")
    for end in ("a", "b"):
        met = met.withColumnRenamed(end, "id").join(distinct.select("id", F.col("owner").alias(end)), "id").drop("id")
    candidates = scratch.materialise(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "larger"), "candidates")
    scratch.discard(distinct)
    pairs = scratch.materialise(_pair_tiles(candidates, threshold), "tiles")
    given = pairs.select("tile", F.lit(GIVEN).alias("side"), F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    found = _in_tiles(docs, known, _label_tiles(sized, threshold).unionByName(given) if counted else given, pairs, n, threshold, counted)
    scratch.discard(candidates, pairs)
    return owners, found if counted else found.unionByName(labels.select("owner", F.lit(1).cast("bigint").alias("links"), F.col("label").alias("least")))


def ngram_jaccard_join(documents: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links); see the module's docstring."""
    owners, linked = linked_sets(rows_with_keys(documents).filter("doc_id IS NOT NULL"), n, threshold)
    docs = owners.select("doc_id", "set_hash").distinct()
    copies = docs.groupBy("set_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    links = linked.groupBy(F.col("owner").alias("set_hash")).agg(F.sum("links").alias("links"))
    groups = components(linked, "owner", "least").select(F.col("doc_id").alias("set_hash"), "group_id")
    known = copies.join(links, "set_hash", "left").join(groups, "set_hash", "left").select("set_hash", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group_id", "set_hash").alias("group_id")).filter("n_links > 0")
    least = known.groupBy("group_id").agg(F.min("first").alias("class_id"))
    return docs.join(known.join(least, "group_id"), "set_hash").select("doc_id", "class_id", "n_links")


def components(pairs: DataFrame, left: str = "doc_a", right: str = "doc_b") -> DataFrame:
    """(doc_id, group_id): for each id in ``pairs``, the smallest id that it is connected with.

    Each round gives every id the least label among its own and its neighbours', then the label's
    label (pointer jumping), so the rounds grow with the logarithm of a chain's length. Labels are
    written to the shared folder after each round.
    """
    edges = scratch.materialise(pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).union(pairs.select(right, left)).distinct(), "edges")
    labels = scratch.materialise(edges.groupBy(F.col("u").alias("doc_id")).agg(F.least(F.col("u"), F.min("v")).alias("group_id")), "labels")
    old = labels
    while True:
        near = edges.join(labels, edges["v"] == labels["doc_id"]).groupBy(F.col("u").alias("doc_id")).agg(F.min("group_id").alias("near"))
        step = labels.join(near, "doc_id").select("doc_id", F.least("group_id", "near").alias("jump"), "group_id")
        to = labels.select(F.col("doc_id").alias("jump"), F.col("group_id").alias("further"))
        step = scratch.materialise(step.join(to, "jump", "left").select("doc_id", F.least("jump", F.coalesce("further", "jump")).alias("group_id"), F.col("group_id").alias("was")), "labels")
        scratch.discard(old)
        labels, old = step.select("doc_id", "group_id"), step
        if not step.filter("group_id <> was").limit(1).count():
            scratch.discard(edges)
            return labels


def keep_one(documents: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that of the smallest doc_id (rows without one come last), of several rows with that id the one whose key (a
    hash of id and text) is least, of rows with the same id and text the least in the order of their columns. Rows without words stay."""
    columns = documents.columns
    key, goes, row = (scratch.fresh(documents, name) for name in ("key__", "goes__", "row__"))
    owners, linked = linked_sets(rows_with_keys(documents), n, threshold, counted=False)
    groups = components(linked, "owner", "least").select(F.col("doc_id").alias("set_hash"), "group_id")
    grouped = owners.join(groups, "set_hash", "left").select("key", "doc_id", "n_rows", F.coalesce("group_id", "set_hash").alias("group_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key")))
    many = grouped.groupBy("group_id").agg(best.alias("best"), F.sum("n_rows").alias("n")).filter("n > 1").select("group_id", F.col("best.key").alias("best"))
    marked = grouped.join(many, "group_id").filter("key <> best OR n_rows > 1").select(F.col("key").alias(key), (F.col("key") != F.col("best")).alias(goes))
    marked = scratch.materialise(marked, "marked")
    keyed = documents.withColumn(key, _row_key())
    table = _slot_table(marked, key)
    maybe = _filtered(keyed, table, key, True).join(marked, key, "left")
    once = maybe.filter(~F.col(goes)).groupBy(key).agg(F.min(F.struct(*columns)).alias(row)).select(f"{row}.*")
    return _filtered(keyed, table, key, False).select(columns).unionByName(maybe.filter(F.col(goes).isNull()).select(columns)).unionByName(once)


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {T.WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END)) AS s FROM w WHERE len(w) > 0),
u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id), s) AS k, s, min(doc_id) AS least, count(*) AS copies FROM g GROUP BY s),
e AS (SELECT k, copies, len(s) AS n, unnest(s) AS gram FROM u),
p AS (SELECT a.k AS x, b.k AS y, any_value(a.copies) AS cx, any_value(b.copies) AS cy
      FROM e a JOIN e b ON a.gram = b.gram AND a.k < b.k AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
      GROUP BY a.k, b.k, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= {THRESHOLD} - 1e-9),
q AS MATERIALIZED (SELECT x, y, cy AS c FROM p UNION ALL SELECT y, x, cx FROM p),
r AS (SELECT k AS x, k AS root FROM u UNION SELECT q.y, r.root FROM r JOIN q ON q.x = r.x AND r.root < q.y),
c AS (SELECT x, min(root) AS root FROM r GROUP BY x),
l AS (SELECT x, sum(c) AS n FROM q GROUP BY x),
d AS (SELECT u.k, u.s, u.least, c.root, u.copies - 1 + coalesce(l.n, 0) AS n_links FROM u JOIN c ON u.k = c.x LEFT JOIN l ON u.k = l.x),
m AS (SELECT root, min(least) AS class_id FROM d GROUP BY root)
SELECT g.doc_id, m.class_id, CAST(d.n_links AS BIGINT) AS n_links FROM g JOIN d USING (s) JOIN m USING (root) WHERE d.n_links > 0
"""
