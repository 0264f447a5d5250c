import base64

import pytest
import tiktoken

import corpus_pipeline
from intentloom.llm import packing, queries, secrets

from .common import awkward, awkward_rows, empty, prose

ENCODING = None


def encode(text):
    global ENCODING
    if ENCODING is None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.VOCABULARY, "rb"))}
        ENCODING = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ENCODING.encode_ordinary(text or "")


def brute(rows, window):
    """(window_id, n_tokens, tokens, doc_ids, starts) by one list."""
    stream, begins = [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        begins.append((len(stream), doc))
        stream += [*encode(text), packing.SEPARATOR]
    out = []
    for i, a in enumerate(range(0, len(stream), window)):
        inside = [(max(p, a), d) for (p, d), (q, _) in zip(begins, [*begins[1:], (len(stream), None)]) if p < a + window and q > a]
        out.append((i, len(stream[a : a + window]), stream[a : a + window], [d for _, d in inside], [p - a for p, _ in inside]))
    return out


@pytest.mark.parametrize("window", [7, 64, 2048, 10**6])
def test_windows_against_brute_force(spark, window):
    df = awkward(spark).repartition(3)
    got = sorted(tuple(r) for r in packing.pack(df, window).collect())
    assert got == brute([(r[0], r[1]) for r in awkward_rows()], window)


def test_many_row_groups(spark):
    rows = [(i, prose(i, 5 + i % 50), None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(tuple(r) for r in packing.pack(df, 100).collect()) == brute([r[:2] for r in rows], 100)
    assert packing.pack(empty(spark)).count() == 0


def test_encoder_on_blanks():
    from random import Random

    import pyarrow as pa

    rng = Random(1)
    texts = ["", None, " ", "a ", "  b", "it's  I'll\n\nfoo\n bar ", "x" * 7000] + ["".join(rng.choices(["a", "é", " ", "\n", "1", ".", "'s", "\t", "你", "　", "\r\n"], k=rng.randint(1, 40))) for _ in range(500)]
    e = packing.Encoder(open(packing.VOCABULARY, "rb").read())
    for _ in range(2):
        tokens, ptr = e.encode(pa.array(texts, pa.string()))
        assert [tokens[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [encode(t) for t in texts]


def test_pipeline_against_its_stages(spark, tmp_path):
    key = "0123456789abcdef0123456789abcdef01234567"
    base = prose(60, 200)
    rows = [(i, f"{prose(i, 90)}\n{prose(i + 300, 40)}", "en", "s1", 1) for i in range(20)]
    rows += [(100, base, "en", "s1", 1), (101, base, "en", "s2", 1), (102, base + " end", "en", "s2", 1)]
    item = prose(77, 40) + ". " + prose(78, 5)
    rows += [(200, f"{prose(61, 60)} {item} {prose(62, 60)}", "en", "s1", 1), (201, f'{prose(63, 60)} token = "{key}" {prose(64, 30)}', "en", "s1", 1)]
    rows += [(300 + i, f"menu home about us\n{prose(400 + i, 50)}", "en", "hot", 1) for i in range(8)] + [(400, "menu home about us\nx", "en", "hot", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(79, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = []
    for r in rows:
        if r[0] in (101, 102, 200, 400):
            continue
        want.append((r[0], r[1].replace("menu home about us\n", "").replace(key, secrets.MASK)))
    assert got == brute(want, packing.WINDOW)


def test_pipeline_over_awkward_rows(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows, null ids, clashing extra columns; an empty table."""
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [*awkward_rows(), (300, f"token={key} {prose(9, 12)}", None, None, None), (None, f"pwd: {key} {prose(10, 12)}", None, None, None)]
    df = awkward(spark)
    more = spark.createDataFrame(rows[-2:], df.select("doc_id", "text", "lang", "source", "n_chars").schema)
    df.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(500, 30)), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("window_id").collect()
    ids = [i for w in windows for i in w["doc_ids"]]
    kept = list(dict.fromkeys(ids))
    by_id = {r[0]: r[1] for r in rows}
    # one of the two long copies, one of the near ones; rows without words all stay; 200 and 201 are depleted
    assert 4 in kept and 5 not in kept and 8 in kept and 9 not in kept and {0, 1, 2, 3, 300} <= set(kept) and not {200, 201} & set(kept)
    names = decoder()
    stream = [t for w in windows for t in w["tokens"]]
    assert all(w["n_tokens"] == packing.WINDOW for w in windows[:-1]) and not {200, 201, 5, 9} & set(kept) and None in kept
    text = b"".join(names[t] if t != packing.SEPARATOR else b"\0" for t in stream).decode()
    assert key not in text and text.count(secrets.MASK) == 2 and by_id[4] in text
    where = tmp_path / "none"
    empty(spark).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(where)).count() == 0


def decoder():
    return {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(packing.VOCABULARY, "rb"))}


def test_registry():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
