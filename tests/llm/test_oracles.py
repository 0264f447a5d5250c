"""Operators that SQL can express, against DuckDB over awkward tables."""

import pytest

from intentloom.llm import line_frequency, ngram_jaccard, sharding, suffix_array, super_kmers

from .common import CLASHING, SCHEMA, awkward, awkward_rows, collected, empty, oracle

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CASES = {
    "sharding": (sharding.shard, sharding.SQL), "line_frequency": (line_frequency.line_frequency_rules, line_frequency.SQL), "ngram_jaccard": (ngram_jaccard.ngram_jaccard_join, ngram_jaccard.SQL),
    "suffix_array": (suffix_array.suffix_array_repeats, suffix_array.SQL), "super_kmers": (super_kmers.super_kmer_repeats, super_kmers.SQL),
}


@pytest.mark.parametrize("name", CASES)
def test_awkward_rows(spark, name):
    operator, sql = CASES[name]
    out = operator(awkward(spark))
    if set(CLASHING) <= set(out.columns):
        assert out.filter(" OR ".join(f"`{c}` <> '{c}'" for c in CLASHING)).count() == 0
        out = out.select(COLUMNS)
    found = collected(out)
    assert found == oracle(sql, awkward_rows())
    assert found


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    assert CASES[name][0](empty(spark)).count() == 0


def test_line_frequency_rejects_depleted(spark):
    out = {r["doc_id"]: r["text"] for r in line_frequency.line_frequency_rules(awkward(spark, False)).collect()}
    assert 201 not in out and 200 not in out and "menu home" not in out[100]


def test_line_frequency_without_broadcast(spark, monkeypatch):
    """Salted hosts: the rows are the same."""
    for k, v in {"BROADCAST_HASHES": -1, "SALTED": 3}.items():
        monkeypatch.setattr(line_frequency, k, v)
    out = line_frequency.line_frequency_rules(awkward(spark)).select(COLUMNS)
    assert collected(out) == oracle(line_frequency.SQL, awkward_rows())


@pytest.mark.parametrize("operator,sql", [(suffix_array.suffix_array_repeats, suffix_array.SQL), (super_kmers.super_kmer_repeats, super_kmers.SQL)])
def test_passage_in_all_documents(spark, operator, sql):
    """One passage in each of 400 documents, as hot minimisers (counted as rows) and not: the same rows."""
    from .common import prose

    shared = prose(5, 75)
    rows = [(i // 2 if i > 390 else i, f"{prose(1000 + i, i % 60)} {shared} {prose(2000 + i, 30)} {shared if i % 50 == 0 else ''}", None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = oracle(sql, rows)
    assert collected(operator(df, 20)) == want and collected(operator(df)) == want and len(want) >= 395


def test_first_pass_sends_two_rows_a_key():
    import numpy as np

    from intentloom.llm import minimisers as M

    key, doc = np.repeat(np.arange(1, 4, dtype=np.uint64) << np.uint64(40), 1000), np.tile(np.arange(1000), 3)
    packed = M._packed([key], [doc], 8)
    assert sum(len(x.as_py()) for x in packed.column("key")) == 2 * 3 * 8
    assert sum(int(np.frombuffer(x.as_py(), np.uint32).sum()) for x in packed.column("n")) == 3000


def test_components_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300)], "doc_a bigint, doc_b bigint")
    got = dict(ngram_jaccard.components(pairs).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and got[300] == 100
    assert ngram_jaccard.components(pairs.limit(0)).count() == 0


def kept(rows):
    """keep_one by brute force: all pairs of rows."""
    import re

    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return frozenset(zip(w, w[1:])) or frozenset((x,) for x in w)

    found = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(found):
        for j in range(i):
            if a and len(a & found[j]) >= ngram_jaccard.THRESHOLD * len(a | found[j]) and group[i] != group[j]:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(group[i], []).append((r[0] is None, r[0] or 0, r))
    return [min((x[:2] for x in v)) for v in best.values()], group


def test_keep_one_of_each_class(spark):
    from .common import prose

    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (4, b.upper()), (5, c), (5, c), (5, c), (None, c), (None, prose(4, 60)), (None, prose(4, 60)), (7, ""), (7, ""), (8, None), (9, prose(5, 70))]
    rows = [(i, t, "en", "s", None) for i, t in rows]
    got = ngram_jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    want, _ = kept(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(want)
    assert {r["text"] for r in got if r["doc_id"] == 2} == {b} and sum(r["text"] == c for r in got) == 1


def test_keep_one_awkward(spark):
    df = awkward(spark)
    got = ngram_jaccard.keep_one(df)
    assert got.columns == df.columns and ngram_jaccard.keep_one(empty(spark)).count() == 0
    want, _ = kept(awkward_rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted(want)


def near_texts():
    import random

    from .common import prose

    rng, texts = random.Random(9), []
    for g in range(4):
        base = prose(70 + g, 60).split()
        for _ in range(15):
            w = base[: 30 + rng.randint(0, 30)]
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 9)}"
            texts.append(" ".join(w))
    return texts


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_jaccard, "TILE_PAIRS", 3)
    rows = [(i, t, None, None, None) for i, t in enumerate(near_texts())]
    found = collected(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)))
    assert found == oracle(ngram_jaccard.SQL, rows) and len(found) > 30


@pytest.mark.parametrize("hot,pairs,labels", [(1 << 16, 1 << 20, 1), (1 << 16, 7, 3), (2, 1 << 20, 3), (2, 7, 1), (3, 50, 60)])
def test_no_pair_is_lost_whatever_the_labels(hot, pairs, labels, monkeypatch):
    """Within the process, as workers don't see patched settings: pairs of different labels, or of none (0), are candidates."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    J = ngram_jaccard
    for k, v in {"HOT": hot, "HOT_MEANS": 0, "_PAIRS": pairs}.items():
        monkeypatch.setattr(J, k, v)
    found = {J.set_hash(s): s for s in J.sets(pa.array(near_texts()), J.N)}
    counts = np.bincount(J.key_of(np.concatenate(list(found.values()))) & np.uint32(J._TABLE), minlength=1 << J.TABLE_BITS).astype(np.uint32)
    table = SimpleNamespace(value=counts.tobytes())
    encoded = [r for b in J._encoded(J.N, J.THRESHOLD, 3, table)(iter([pa.record_batch({"text": near_texts()})])) for r in b.to_pylist() if r["kind"] == 0]
    assert {r["owner"] for r in encoded} == set(found)
    label = {r["owner"]: i % labels for i, r in enumerate(encoded)}
    batch = pa.record_batch({"id": pa.array([r["owner"] for r in encoded]), "size": pa.array([r["size"] for r in encoded]), "label": pa.array([label[r["owner"]] for r in encoded]), "keys": pa.array([r["keys"] for r in encoded], pa.binary())})
    buckets, weight = {}, {}
    for b in J._spread(5, table)(iter([batch])):
        for r in b.to_pylist():
            buckets.setdefault(r["bucket"], []).append(r)
    for rows in buckets.values():
        for r in J._meet(J.THRESHOLD)(pa.Table.from_pylist(rows)).to_pylist():
            n, _ = weight.get((r["a"], r["b"]), (0, 0))
            weight[r["a"], r["b"]] = (n + r["weight"], r["need"])
    met = {k for k, (n, need) in weight.items() if n >= need}
    near = [(min(a, b), max(a, b)) for a in found for b in found if a < b and len(np.intersect1d(found[a], found[b])) >= J.THRESHOLD * len(np.union1d(found[a], found[b]))]
    assert len(near) > 50 and {p for p in near if label[p[0]] != label[p[1]] or not label[p[0]]} <= met
    assert all(label[a] != label[b] or not label[a] for a, b in met)
    tile = J.Tile({h: (1, 2, s) for h, s in found.items()}, J.THRESHOLD)
    tile.compare_all()
    assert tile.links.sum() == 2 * len(near)
    tile = J.Tile({h: (1, i % 2, s) for i, (h, s) in enumerate(found.items())}, J.THRESHOLD)
    tile.compare_all()
    side = {h: i % 2 for i, h in enumerate(found)}
    assert tile.links.sum() == 2 * sum(side[a] != side[b] for a, b in near)


def test_keep_one_work_grows_with_the_sets(spark, monkeypatch):
    """Of a class of many blocks, each set goes to two tiles, not to one for each other block; whatever the blocks leave apart is found by its keys."""
    from .common import prose

    base = prose(51, 120).split()
    texts = [" ".join(base[: 100 + i % 20]) + f" tail{i}" for i in range(120)] + near_texts() + [prose(900 + i, 60) for i in range(5)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sent, materialise = [], ngram_jaccard.scratch.materialise

    def counted(df, name):
        out = materialise(df, name)
        if name == "members":
            sent.append(out.filter("side <> 3").groupBy("set_hash").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_jaccard.scratch, "materialise", counted)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 4)
    got = {r["doc_id"] for r in ngram_jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i for _, i in kept(rows)[0]}
    assert max(sent) == 2


def test_connected_pairs_are_not_compared():
    """A tile that isn't counted connects the same sets by fewer links; packed meetings are the same pairs."""
    import numpy as np
    import pyarrow as pa

    J = ngram_jaccard
    base = " ".join(f"w{i}" for i in range(100))
    found = {J.set_hash(s): s for s in J.sets(pa.array([f"{base} x{i}" for i in range(200)] + near_texts()), J.N)}
    tiles = [J.Tile({h: (1, 2, s) for h, s in found.items()}, J.THRESHOLD, counted) for counted in (True, False)]
    for t in tiles:
        t.compare_all()
    (owner, _, least), (owner_, _, least_) = (t.rows() for t in tiles)
    assert dict(zip(owner, least)) == dict(zip(owner_, least_)) and len(owner) > 200
    assert tiles[1].links.sum() < 4 * len(found) < tiles[0].links.sum() / 10
    n = np.repeat(np.arange(30, dtype=np.int32), 2)
    keys = {"own": np.repeat(np.arange(5, dtype=np.uint32), 60), "label": np.zeros(300, np.uint64), "id": np.tile(n // 2, 5).astype(np.int64), "size": np.tile(10 + n // 9, 5).astype(np.int32), "place": np.repeat(np.arange(5, dtype=np.int32), 60), "side": np.full(300, 2, np.uint8)}
    t = pa.table({k: [J.planes(v)] for k, v in keys.items()})
    met = J._meet(J.THRESHOLD)(t).to_pylist()
    packed = J._met_in_buckets(J.THRESHOLD, 3)(t)
    got = [tuple(r.values()) for b in set(packed.column("bucket").to_pylist()) for r in J._met_enough(packed.filter(pa.array([x == b for x in packed.column("bucket").to_pylist()]))).to_pylist()]
    assert sorted(got) == sorted((r["a"], r["b"], r["larger"]) for r in met if r["weight"] >= r["need"]) and len(got) > 100


def test_many_near_copies(spark):
    from .common import prose

    base = prose(50, 120).split()
    rows = [(i, " ".join(base[: 100 + i % 20]) + f" tail{i}", None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(ngram_jaccard.ngram_jaccard_join(df)) == oracle(ngram_jaccard.SQL, rows)


def test_contained_texts(spark):
    """The rarest grams of a text that holds another are those that they don't share."""
    from .common import prose

    rows = []
    for i in range(40):
        base, more = prose(10_000 + i, 100), prose(20_000 + i, 40 + i % 28)
        rows += [(2 * i, base, None, None, None), (2 * i + 1, f"{base} {more}", None, None, None)]
    found = collected(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)))
    assert found == oracle(ngram_jaccard.SQL, rows) and len(found) > 30
