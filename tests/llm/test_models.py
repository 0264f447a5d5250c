"""The trained operators and the latent search: held-out accuracy and brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from intentloom.llm import latent_search, secrets, toxicity

from .common import SCHEMA, awkward, awkward_rows, empty, prose


@pytest.fixture(scope="module")
def net():
    return secrets.train()


def test_secret_model_held_out(net):
    assert net[1]["recall"] >= 0.95 and net[1]["precision"] >= 0.85 and net[1]["false_alarms"] <= 0.2


def test_gradients():
    rng = np.random.default_rng(0)
    n = secrets.Network()
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    codes, y = rng.integers(0, secrets.CODES, (6, secrets.LENGTH)), rng.integers(0, 2, 6).astype(np.float64)
    loss = lambda: float(np.mean(np.logaddexp(0, (z := n.forward(codes)[0])) - y * z))
    g = n.gradients(codes, y)
    for k in n.p:
        i = tuple(rng.integers(0, s) for s in n.p[k].shape)
        if k == "e" and i[0] == 0:
            i = (5, i[1])
        keep, h = n.p[k][i], 1e-5
        n.p[k][i] = keep + h
        up = loss()
        n.p[k][i] = keep - h
        down = loss()
        n.p[k][i] = keep
        assert abs((up - down) / (2 * h) - g[k][i]) < 1e-4


def found_candidates(texts):
    raw, offsets, rows, starts, ends = secrets.candidates(pa.array(texts, pa.string()))
    return [(r, raw[a:b].tobytes().decode()) for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist())]


def test_candidates_against_regex():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcXYZ0189 +/_-.é\n", k=rng.randint(0, 120))) for _ in range(300)] + [None, "", "a1" * 3000]
    want = []
    for r, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]{12,}", t or ""):
            c = m[0]
            letters, capitals = re.search("[a-zA-Z]", c), re.search("[A-Z]", c)
            if re.search("[0-9]", c) and letters or len(c) >= secrets.LONG and re.search("[a-z]", c) and capitals or len(c) >= secrets.SHOUTED and capitals and not re.search("[a-z0-9]", c):
                want.append((r, c))
    assert found_candidates(texts) == want


VALUES = {
    'password = "hunter2!xY"': ["hunter2!xY"], "password: correcthorsebatterystaple": ["correcthorsebatterystaple"], 'api_key = "p@ss.w0rd!Long#12"': ["p@ss.w0rd!Long#12"], "pin=493028174650": ["493028174650"],
    "db_pwd := 'a b c', user=x": ["a b c", "x"], "https://bob:s3!t@example.com/x": ["s3!t"], "my password is Tr0ub4dor&3, ok": ["Tr0ub4dor&3"], '{"token":"ab","n":1}': ["ab", "1"], "a == b": ["b"], "x=1&token=abc&y=2": ["1", "abc", "2"],
    "nothing here is one": [], "see https://example.com": [], "| token | = | \"zz\"": ["zz"], "pässwort: größe": ["größe"], "=": [], "key=": [], "a::b": [], "x = ": [], ":": [],
}


def test_values_are_candidates_whatever_their_form():
    texts = list(VALUES)
    got = found_candidates(texts)
    assert {t: [c for r, c in got if r == i] for i, t in enumerate(texts)} == VALUES
    assert found_candidates([f"{'x' * 9000} token={'p@' * 5000} {'y' * 9000}", None, "pwd=a"]) == [(0, "p@" * 5000), (2, "a")]


def test_short_and_wordy_secrets_are_found(spark, net):
    bad = ['password = "hunter2!xY"', 'passphrase: "correct horse battery staple"', 'api_key = "p@ss.w0rd!Long#12"', "db_password=Tr0ub4dor&3", "postgres://bob:s3cr3t!@db.example.com/x"]
    good = [f"sha256: {hashlib.sha256(b'z').hexdigest()}", f"commit {hashlib.sha1(b'z').hexdigest()} fixes", "note: this is fine", "password: required", 'name = "hunter2!xY"', "Zieh: das ist gut; Ort: Bonn"]
    found = {r["doc_id"] for r in secrets.secret_scan(docs(spark, list(enumerate(bad + good))), net[0]).collect()}
    assert set(range(len(bad))) <= found and len(found) <= len(bad) + 1


def test_awkward_rows_with_secrets(spark, net):
    """Null ids, repeated rows, clashing columns, overlapping and neighbouring findings, a tie at the threshold."""
    key, other = hashlib.sha1(b"x").hexdigest(), hashlib.sha1(b"y").hexdigest()
    rows = [(None, f"token={key}"), (1, f"é token={key}"), (1, f"é token={key}"), (2, f'password="a {key} b" token={other}'), (3, None), (4, "")]
    df = docs(spark, rows).selectExpr("*", "'c' AS score", "'d' AS fingerprint", "1 AS start")
    found = [(r["doc_id"], r["start"], r["n_chars"]) for r in secrets.secret_scan(df, net[0]).collect()]
    assert sorted(found, key=str) == sorted([(None, 6, 40), (1, 8, 40), (1, 8, 40), (2, 10, 44), (2, 62, 40)], key=str)
    clean = [(r["doc_id"], r["text"], r["score"]) for r in secrets.redact(df, net[0]).collect()]
    m = secrets.MASK
    want = [(None, f"token={m}", "c"), (1, f"é token={m}", "c"), (1, f"é token={m}", "c"), (2, f'password="{m}" token={m}', "c"), (3, None, "c"), (4, "", "c")]
    assert sorted(clean, key=str) == sorted(want, key=str)
    tied = secrets.Network()
    tied.p, tied.scale, tied.shift = net[0].p, net[0].scale, net[0].shift
    _, _, rows, _, _, score = secrets.secrets_of(net[0], pa.array([f"token={key}"]))
    tied.threshold = float(score[0])
    assert len(secrets.secrets_of(tied, pa.array([f"token={key}"] * 2))[2]) == 2


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], SCHEMA)


def test_scan_and_redact(spark, net):
    key = hashlib.sha1(b"x").hexdigest()
    texts = [f'été token = "{key}" and {prose(1, 5)}', prose(2, 300), f"{prose(3, 40000)} api_key={hashlib.sha256(b'y').hexdigest()} {prose(4, 10)}", "", None]
    texts += [f"commit {hashlib.sha1(bytes([i])).hexdigest()} fixes it" for i in range(30)]
    df = docs(spark, list(enumerate(texts)))
    found = {r["doc_id"]: r for r in secrets.secret_scan(df, net[0]).collect()}
    assert {0, 2} <= set(found) and len(found) <= 2 + 5
    assert texts[0][found[0]["start"] :][: found[0]["n_chars"]] == key and found[0]["fingerprint"] == hashlib.sha256(key.encode()).hexdigest()
    clean = {r["doc_id"]: r for r in secrets.redact(df, net[0]).collect()}
    assert clean[0]["text"] == texts[0].replace(key, secrets.MASK) and clean[0]["n_chars"] == len(clean[0]["text"])
    assert [clean[i]["text"] for i in (1, 3, 4)] == [texts[i] for i in (1, 3, 4)] and clean[1]["n_chars"] == len(texts[1])


def test_secrets_awkward(spark, net):
    out = secrets.redact(awkward(spark), net[0])
    assert out.columns == awkward(spark).columns and sorted(map(str, (r["text"] for r in out.collect()))) == sorted(str(r[1]) for r in awkward_rows())
    assert secrets.secret_scan(awkward(spark), net[0]).count() == 0 and secrets.secret_scan(empty(spark), net[0]).count() == 0 and secrets.redact(empty(spark), net[0]).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["vilescum", "hateful", "stupidfool", "disgusting"]
    text = lambda i, toxic: " ".join(prose(i, 60).split()[:30] + (rng.sample(bad, 2) if toxic else []) + prose(i + 5000, 20).split())
    rows = [(i, text(i, i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(1, None, None), (None, 1, 1), (9999, 1, 0)], "doc_id bigint, toxic int, quality int")
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs(spark, rows), labels).collect()}
    truth = {i for i in range(200, 400) if i % 4 == 0}
    assert len(found & truth) >= 0.95 * len(truth) and len({i for i in found if i >= 200} - truth) <= 3


def test_toxicity_ratios_and_scores_from_dictionaries():
    """Features, log-count ratios and scores recomputed without arrays."""
    import math

    texts = ["Ein BÄR, der brummt!", "zwei bären", "", "ab", "hateful Words 99", "words of love", "hateful bear", "ein wort"]
    y = [0, 0, 0, 0, 1, 0, 1, 0]

    def grams(t):
        raw = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in t.lower().encode())
        return {raw[i : i + n] for n in toxicity.SIZES for i in range(len(raw) - n + 1)}

    found = list(toxicity.Features().of(pa.array(texts)))
    slots = {}
    for t in texts:
        for g in grams(t):
            (slots[g],) = set(np.concatenate([f for f in toxicity.Features().of(pa.array([g.decode("latin-1")])) if len(f)]).tolist()) if len(g) == 3 and g.isascii() else (None,)
    assert [len(f) for f in found] == [len(grams(t)) for t in texts]
    assert all({slots[g] for g in grams(t) if slots[g] is not None} <= set(f.tolist()) for t, f in zip(texts, found))
    model = toxicity.Model().fit(found, np.array(y, np.float32))
    for f in set(np.concatenate(found).tolist()):
        p, q = (sum(f in set(x.tolist()) for x, label in zip(found, y) if label == k) for k in (1, 0))
        want = math.log((p + toxicity.SMOOTHING) / (sum(y) + 2 * toxicity.SMOOTHING)) - math.log((q + toxicity.SMOOTHING) / (len(y) - sum(y) + 2 * toxicity.SMOOTHING))
        assert abs(model.ratio[f] - want) < 1e-5
    for x in found:
        assert abs(model.score(x) - (sum(float(model.weight[f]) for f in x.tolist()) + model.bias)) < 1e-4
    assert min(model.score(x) for x, label in zip(found, y) if label) > max(model.score(x) for x, label in zip(found, y) if not label)


def test_toxicity_ties_and_shared_ids(spark):
    bad, good = "hateful stupidfool disgusting", prose(3, 30)
    rows = [(i, f"{prose(i, 25)} {bad if i % 2 else good}") for i in range(40)]
    rows += [(100, f"{good}"), (100, f"{prose(9, 9)} {bad}"), (101, bad), (102, bad), (103, None), (None, bad)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    got = [(r["doc_id"], r["score"]) for r in toxicity.toxic_documents(docs(spark, rows), labels).collect()]
    found = dict(got)
    assert len(found) == len(got) and found[101] == found[102] and 100 in found and 103 not in found and None not in found


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(i, int(i in (6, 7))) for i in range(14)], "doc_id bigint, toxic int")
    out = toxicity.toxic_documents(awkward(spark), labels)
    assert out.columns == ["doc_id", "score"] and {0, 1, None}.isdisjoint(r["doc_id"] for r in out.collect())
    none = labels.filter("toxic > 1")
    for d, l in ((awkward(spark), none), (empty(spark), labels), (awkward(spark), labels.filter("toxic = 0"))):
        assert toxicity.toxic_documents(d, l).count() == 0


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_bits():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 20))] for _ in range(2))
        assert latent_search.lcs(latent_search.place_masks(np.array(a)), len(a), b) == longest(a, b)


def test_planted_leaks(spark):
    rng = random.Random(7)
    items = [(i, prose(900 + i, 28) + ". " + prose(1900 + i, 4)) for i in range(40)]
    rows, truth = [(i, prose(i, 150)) for i in range(200)], set()
    for i, (k, t) in enumerate(items):
        w = t.split()
        exact = f"{prose(3000 + i, 70)} {t} {prose(4000 + i, 50)}"
        kept = [x for x in w[:-4] if rng.random() > 0.2] + w[-4:]
        rows += [(1000 + i, exact), (2000 + i, f"{prose(5000 + i, 33)} {' '.join(kept)} {prose(6000 + i, 90)}")]
        truth |= {(1000 + i, k), (2000 + i, k)}
    rows.append((5000, prose(8000, 20_000) + " " + items[3][1] + " " + prose(8001, 20_000)))
    truth.add((5000, 3))
    bench = spark.createDataFrame(items + [(None, "x"), (77, None), (78, ""), items[0]], "item_id bigint, text string").selectExpr("*", "'c' AS words", "1 AS doc_id")
    found = {(r["doc_id"], r["item_id"]): r for r in latent_search.latent_leaks(docs(spark, rows), bench).collect()}
    assert len(found.keys() & truth) >= 0.9 * len(truth) and (5000, 3) in found
    assert not found.keys() - truth and all(found[1000 + i, i]["lcs_share"] == 1 for i in range(40))


def exhaustive(rows, items):
    """All (doc_id, item_id) by the longest common subsequence around every stride, without any search."""
    L = latent_search
    it = L.Items(items)
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    number = {}
    for (_, t), own in zip(items, it.words):
        number |= dict(zip(split(t), own.tolist()))
    docs = [(d, [number.get(x, -1) for x in split(t)]) for d, t in rows]
    df = np.zeros(len(it.terms), np.int64)
    for _, w in docs:
        for x in set(w) - {-1}:
            df[x] += 1
    it.weigh(df, len(docs))
    out = set()
    for d, w in docs:
        for start in range(0, len(w), L.STRIDE):
            if not any(x >= 0 and it.column[x] >= 0 for x in w[start : start + L.STRIDE]):
                continue
            for i, own in enumerate(it.words):
                region = [x for x in w[max(0, start - it.lengths[i]) : start + L.PASSAGE + it.lengths[i]] if x >= 0 and it.column[x] >= 0]
                if (d, items[i][0]) in out or not len(own) or len(set(region) & set(own.tolist())) < L.LIKELY * len(set(own.tolist())) / 2:
                    continue
                share = longest(own.tolist(), region) / len(own)
                if share >= L.SURE or share >= L.LIKELY and len(it.answers[i] & set(region)) >= L.ANSWER_SHARE * len(it.answers[i]):
                    out.add((d, items[i][0]))
    return out


def test_leaks_against_exhaustive_search_and_in_any_blocks(spark, monkeypatch):
    rng = random.Random(17)
    common = prose(50, 40).split()
    items = [(i, " ".join(rng.sample(common, 6)) + " " + prose(700 + i, 20 + i) + ". " + prose(1700 + i, 4)) for i in range(24)]
    rows = [(i, " ".join(rng.choices(common, k=40)) + " " + prose(i, 60)) for i in range(60)]
    for i, (k, t) in enumerate(items):
        w = t.split()
        kept = [x for x in w if rng.random() > 0.1 * (i % 8)]
        rows.append((100 + i, f"{prose(2000 + i, 30 + i)} {' '.join(kept)} {prose(3000 + i, 40)}"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = exhaustive(rows, items)
    found = latent_search.latent_leaks(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and 10 < len(want) < 60
    monkeypatch.setattr(latent_search, "BLOCK", 5)
    mixed = latent_search.latent_leaks(docs(spark, rows[::-1]).repartition(3), bench.orderBy("text")).collect()
    key = lambda r: (r["doc_id"], r["item_id"], r["lcs_share"])
    assert sorted(map(key, mixed)) == sorted(map(key, found))
    cosines = {key(r): r["cosine"] for r in found}
    assert all(abs(cosines[key(r)] - r["cosine"]) < 1e-3 for r in mixed)


def test_products_row_by_row_and_by_gram_matrix():
    L = latent_search
    texts = [prose(i, 90 + i) for i in range(20)] + ["", prose(5, 30)]
    it = L.Items([(i, t) for i, t in enumerate(texts[:12])])
    encoded = list(L._encode(type("B", (), {"value": it.terms}), it.kind())(iter([pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts})])))
    it.weigh(np.frombuffer(encoded[-1].column("df")[0].as_py(), np.int64)[1:], len(texts))
    p = L.Passages(encoded[0], it.column, it.kind())
    basis = np.random.default_rng(1).standard_normal((it.n_columns, 7)).astype(np.float32)
    gram, rows = np.zeros((it.n_columns, it.n_columns), np.float32), np.zeros_like(basis)
    p.add_pairs(gram)
    p.add_products(rows, basis)
    assert np.allclose(gram @ basis, rows, atol=1e-2)


def test_latent_awkward(spark):
    bench = spark.createDataFrame([(1, prose(2, 80)), (2, "one"), (3, None)], "item_id bigint, text string")
    found = {(r[0], r[1]) for r in latent_search.latent_leaks(awkward(spark), bench).filter("item_id <> 2").select("doc_id", "item_id").collect()}
    assert {(6, 1), (7, 1), (12, 1), (13, 1)} <= found and not any(d in (0, 1, 2, 4) for d, _ in found)
    assert latent_search.latent_leaks(empty(spark), bench).count() == 0 and latent_search.latent_leaks(awkward(spark), bench.limit(0)).count() == 0
