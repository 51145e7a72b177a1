"""Quality by preference pairs, hard negatives and the divergence audit against
brute force, on rows with nulls, blanks, ties, copies and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cubewright.llm import divergence, hard_negatives, pair_quality
from cubewright.llm.common import documents
from cubewright.llm.queries import QUERIES

# ---------------------------------------------------------------- quality


def pairs_folder(tmp_path, docs, labels):
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()),
                             "score": pa.array(["clash"] * len(docs), pa.string()), "_k": pa.array([None] * len(docs), pa.string()),
                             "quality": pa.array([1] * len(docs), pa.int32())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()),
                             "toxic": pa.array([None] * len(labels), pa.int32()), "text": pa.array(["clash"] * len(labels), pa.string())}), tmp_path / "labels.parquet")
    return str(tmp_path)


def quality_rows():
    rng = random.Random(9)
    words = "the of and to in that was for with this have from river stone house letter".split()
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 300))]
        bad = i % 6 == 0
        kind = i // 6 % 3
        if bad and kind == 0:
            w = [x + rng.choice(["***", "$$$"]) if rng.random() < 0.6 else x for x in w]
        elif bad and kind == 1:
            w = [x for x in w for _ in range(12)]
        elif bad:
            w = [x for y in w for x in (y, "|")]
        docs.append((i, " ".join(w) + "."))
        labels.append((i, 0 if bad else 1))
    docs += [(900, None), (901, ""), (902, " \n\t "), (903, "x" * 3_000_000), (904, "日本語 é"), (None, "no id"), (5, docs[5][1]), (5, "another text of the id")]
    labels += [(900, 1), (7, 0), (8, None), (None, 0), (2000, 0), (9, 1)]  # 7 and 900: disagree, nothing to learn
    return docs, labels


def test_quality(spark, tmp_path):
    docs, labels = quality_rows()
    folder = pairs_folder(tmp_path, docs, labels)
    got = QUERIES["op11_pair_quality"](spark, folder).collect()
    assert len(got) == len(docs) and Counter(r["doc_id"] for r in got) == Counter(d[0] for d in docs)
    hit = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        out = zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0
        assert r["held_out"] == out
        if out and r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] != 5:
            hit.append(r["predicted"] == (r["doc_id"] % 6 != 0))
    assert len(hit) > 60 and np.mean(hit) >= 0.95
    same = defaultdict(set)
    for r in got:
        same[r["doc_id"]].add(r["score"])
    assert len(same[5]) == 2  # of three rows two are equal
    again = QUERIES["op11_pair_quality"](spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quality_without_labels_or_rows(spark, tmp_path):
    folder = pairs_folder(tmp_path, [(1, "a text"), (2, None)], [(3, 1), (4, 1)])
    assert sorted((r["doc_id"], r["score"], r["predicted"]) for r in QUERIES["op11_pair_quality"](spark, folder).collect()) == [(1, 0.5, 1), (2, 0.5, 1)]
    (tmp_path / "none").mkdir()
    assert QUERIES["op11_pair_quality"](spark, pairs_folder(tmp_path / "none", [], [])).collect() == []


def test_pairs_are_the_loss_of_differences():
    """The fit is the minimum of the pairs' logistic loss (by its gradient)."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + 0.8 * rng.normal(size=120) > 0).astype(int)
    m = pair_quality.fit(x, y, 0.4, pairs=5000)
    win, lose = pair_quality.preference_pairs(int(y.sum()), int((1 - y).sum()), 5000)
    phi = m.expand(x)
    d = phi[y == 1][win] - phi[y == 0][lose]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + pair_quality.RIDGE / 2 * w @ w
    for i in range(len(m.weight)):
        for e in (1e-3, -1e-3):
            moved = m.weight.copy()
            moved[i] += e
            assert loss(moved) >= loss(m.weight)
    assert np.ptp(np.bincount(win)) <= 1 and np.ptp(np.bincount(lose)) <= 1


def test_the_cut_is_the_quantile():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(1, 1, (300, 2))])
    y = np.repeat([0, 1], 300)
    s = pair_quality.fit(x, y, 0.25).score(x)
    # weighed as in a table of a quarter bad rows, a quarter lies below the cut
    below = s < 0.3
    assert abs(0.25 * below[:300].mean() + 0.75 * below[300:].mean() - 0.25) < 0.01


def test_the_model_is_of_every_pair_and_its_cut_of_every_row(spark, tmp_path, monkeypatch):
    """The fit of a table is the minimum of the loss over all pairs of its
    learning documents, in whatever buckets, and the cut their quantile."""
    docs, labels = quality_rows()
    folder = pairs_folder(tmp_path, docs, labels)
    d, told = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    monkeypatch.setattr(pair_quality, "BUCKET_ROWS", 60)
    monkeypatch.setattr(pair_quality, "FEW", 5)
    monkeypatch.setattr(pair_quality, "BINS", 16)
    m = pair_quality.train(d, told)
    kinds = defaultdict(set)
    for i, q in labels:
        kinds[i] |= {q} - {None}
    kinds = {i: q.pop() for i, q in kinds.items() if i is not None and len(q) == 1 and zlib.crc32(str(i).encode()) % 5}
    mine = [((t or "").encode(), kinds[i]) for i, t in docs if i in kinds]
    off = np.concatenate([[0], np.cumsum([len(t) for t, _ in mine])])
    x, y = pair_quality.features(np.frombuffer(b"".join(t for t, _ in mine), np.uint8), off), np.array([q for _, q in mine])
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.spread, np.where(x.std(axis=0) > 0, x.std(axis=0), 1))
    phi = m.expand(x)
    every = (phi[y == 1][:, None] - phi[y == 0][None]).reshape(-1, phi.shape[1])
    p = 1 / (1 + np.exp(every @ m.weight))
    assert np.abs(pair_quality.RIDGE * m.weight - (every * p[:, None]).mean(axis=0)).max() < 1e-9
    s = np.sort(phi @ m.weight)
    told_bad = sum(q == 0 for q in kinds.values())
    share = np.where(y[np.argsort(phi @ m.weight)] == 0, told_bad / len(kinds) / (y == 0).sum(), (1 - told_bad / len(kinds)) / (y == 1).sum())
    at = int(np.searchsorted(np.cumsum(share), told_bad / len(kinds) - 1e-12))
    assert abs(m.cut - s[at:at + 2].mean()) < 1e-9 and abs(m.scale - s.std() / 2) < 1e-9


def test_the_quantile_of_many_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(pair_quality, "FEW", 3)
    monkeypatch.setattr(pair_quality, "BINS", 16)
    rng = np.random.default_rng(5)
    for values in ([2.0] * 40, [1.0] * 10 + [2.0] * 30, list(rng.integers(0, 6, 200).astype(float)), list(rng.normal(size=300))):
        y = rng.permutation(np.arange(len(values)) % 4 > 0).astype(int)
        rows = spark.createDataFrame([(i % 3, int(q), [float(v)]) for i, (v, q) in enumerate(zip(values, y))], "bucket long, y int, x array<double>").repartition(2, "bucket").sortWithinPartitions("bucket")
        s = np.sort(values)
        at = int((y == 0).sum()) - 1
        got = pair_quality._quantile(rows, lambda x: x[:, 0], float(s[0]), float(s[-1]), np.full(2, 1 / len(y)), (y == 0).mean())
        assert got == s[at:at + 2].mean()


def test_features_of_rows_do_not_depend_on_their_neighbours():
    texts = [b"One two two. Three!\nOne two two. Three!\n", b"", b"\n\n", "é ü *** $$ 12".encode(), b"a" * 100]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = pair_quality.features(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        alone = pair_quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(whole[i], alone[0])
    assert not whole[1][3:8].any()


# ---------------------------------------------------------- hard negatives

def brute_negatives(rows):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or any(abs(x) > 1e9 for x in v):
            continue
        c = (int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        ok[i] = min(ok[i], c) if i in ok else c
    out = []
    for a, (label, v) in ok.items():
        if a % 50:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=True)), o, k) for o, (k, w) in ok.items() if o != a and len(w) == len(v)), key=lambda t: (-t[0], t[1]))
        for p, pid, _ in [t for t in scored if t[2] == label][:5]:
            found = [t for t in scored if t[2] != label and 50 * p <= 100 * t[0] <= 95 * p][:3]
            out += [(a, pid, r, n, p, s) for r, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def vector_rows():
    rng = random.Random(12)
    rows = []
    hot = [rng.uniform(-1, 1) for _ in range(12)]
    for i in range(260):
        v = [rng.uniform(-1, 1) for _ in range(12)] if i % 3 else [h + rng.uniform(-0.4, 0.4) for h in hot]
        rows.append((i, v, 1 if i % 3 == 0 else i % 9))
    rows += [(300, hot, 1), (301, hot, 1), (302, hot, 2), (303, hot, 3), (350, [0.0] * 12, 1), (351, [0.0] * 12, 1), (352, [0.0] * 12, 4)]
    rows += [(400, None, 1), (401, hot, None), (402, hot[:11] + [None], 1), (403, hot[:11] + [float("nan")], 1), (404, hot[:11] + [float("inf")], 1),
             (None, hot, 1), (450, hot[:5], 1), (451, [2 * x for x in hot[:5]], 1), (452, [1.8 * x for x in hot[:5]], 2), (453, [], 1),
             (500, hot, 1), (500, hot, 1), (501, hot, 1), (501, rows[4][1], 1), (550, [300 * x for x in hot], 5), (551, [x * 280 for x in hot], 5), (552, [200 * x for x in hot], 6),
             (600, [1e12] * 12, 1), (650, hot, 77), (653, [0.9 * x for x in hot], 77), (700, hot, -3)]
    return rows


def vectors_folder(tmp_path, rows, kind=pa.float64()):
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(kind)),
                             "label": pa.array([r[2] for r in rows], pa.int32()), "id": pa.array(["clash"] * len(rows)), "planes": pa.array(["clash"] * len(rows)),
                             "score": pa.array([1] * len(rows))}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, tmp_path, small):
    rows = vector_rows()
    folder = vectors_folder(tmp_path, rows)
    if small:  # many blocks of anchors and candidates
        got = hard_negatives.mine(spark.read.parquet(f"{folder}/embeddings.parquet"), anchor_rows=2, candidate_rows=16)
    else:
        got = QUERIES["op12_hard_negatives"](spark, folder)
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_hard_negatives_of_one_label_and_of_nothing(spark, tmp_path):
    rows = [(i, [1.0, 0.1 * (i % 3)], 2) for i in range(1, 120) if i % 7]
    assert QUERIES["op12_hard_negatives"](spark, vectors_folder(tmp_path, rows)).collect() == []
    assert QUERIES["op12_hard_negatives"](spark, vectors_folder(tmp_path, [])).collect() == []
    assert QUERIES["op12_hard_negatives"](spark, vectors_folder(tmp_path, [(None, None, None)])).collect() == []


@pytest.mark.parametrize("top", [1, 100, 20_000, 1 << 28])
def test_tables_give_inner_products(top):
    rng = np.random.default_rng(top)
    a, c = rng.integers(-top, top + 1, (9, 19)), rng.integers(-top, top + 1, (23, 19))
    planes = hard_negatives.bits(-top, top)
    pa_, pc = hard_negatives.pack(a, planes), hard_negatives.pack(c, planes)
    assert (hard_negatives.unpack(pa_)[:, :19] == a).all()
    assert (hard_negatives.score(hard_negatives.subset_sums(hard_negatives.unpack(pa_)), pc) == c @ a.T).all()


# ------------------------------------------------------------- divergence

def brute_audit(rows, min_docs=30, most=50):
    count, having, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source, text = r["lang"] or "", r["source"] or "", r["text"] or ""
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        langs[lang].add(source)
        count[lang, source].update(found)
        having[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in having[lang].items() if n >= min_docs]
        v = len(kept)

        def prices(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        of = {s: prices(count[lang, s]) for s in sources}
        q = prices(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, of[s][t] - q[t]) for t in kept if count[lang, s][t] > 0 and of[s][t] > q[t]]
            for part, items, top in (("pair", pair, None), ("term", term, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, val, r) for r, (i, val) in enumerate(items[:top], 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(2)
    vocabulary = [rng.choice("abcdefghij") + rng.choice("klmnopé日") + rng.choice(["", "Q", "z"]) for _ in range(120)]
    rows = []
    for i in range(330):
        lang = ("en", "en", "de", None)[i % 4]
        weight = rng.sample(vocabulary, 40)
        rows.append({"lang": lang, "source": ("hot" if i % 3 else f"s{i % 11}") if i % 17 else None, "text": " ".join(rng.choice(weight) for _ in range(rng.randint(0, 80)))})
    rows += [{"lang": "xx", "source": "a", "text": "few"}, {"lang": "xx", "source": "b", "text": None}, {"lang": "xx", "source": None, "text": ""},
             {"lang": "lonely", "source": "a", "text": "one"}, {"lang": "en", "source": "blank", "text": " \x00\x7f12 [] "},
             {"lang": "de", "source": "long", "text": "akQ, " * 40000 + " ".join(f"w{i}x" for i in range(3000))}, {"lang": "en", "source": "same", "text": "tie"}, {"lang": "en", "source": "same2", "text": "tie"}]
    return rows + [dict(rows[0])] * 3


def audit_folder(tmp_path, rows):
    cols = {k: pa.array([r[k] for r in rows], pa.string()) for k in ("lang", "source", "text")}
    pq.write_table(pa.table({"doc_id": pa.array([None] * len(rows), pa.int64()), **cols, **{k: pa.array(["clash"] * len(rows), pa.string()) for k in ("term", "n", "d", "total", "kept", "place")}}),
                   tmp_path / "documents.parquet")
    return str(tmp_path)


def test_audit(spark, tmp_path):
    rows = audit_rows()
    want = brute_audit(rows)
    got = sorted(map(tuple, QUERIES["op13_divergence"](spark, audit_folder(tmp_path, rows)).collect()))
    assert got == want and {r[2] for r in want} == {"pair", "term"}
    assert ("xx", "", "pair", "a", 0, 1) in got and ("lonely", "a") not in {r[:2] for r in got}


def test_audit_in_small_chunks_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "LONG", 3000)
    rows = audit_rows()
    got = divergence.audit(documents(spark, audit_folder(tmp_path, rows)), min_docs=2, most=7, chunk=10, side=3)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 2, 7)


def test_audit_of_nothing(spark, tmp_path):
    assert QUERIES["op13_divergence"](spark, audit_folder(tmp_path, [])).collect() == []


def test_galloping():
    rng = np.random.default_rng(1)
    for _ in range(300):
        span = int(rng.integers(1, 400))
        large = np.sort(rng.choice(span, int(rng.integers(0, span + 1)), replace=False))
        if rng.random() < 0.3:  # uneven: all ids at one end
            large = large[:len(large) // 3]
        small = np.sort(rng.choice(span, int(rng.integers(0, span + 1)), replace=False))
        assert (divergence.gallop(large, small, span) == (np.searchsorted(large, small) if len(large) else 0)).all()


def test_prices_are_exact():
    for c, n, v in [(0, 0, 1), (7, 7, 1), (10**15, 9 * 10**15, 1000), (3, 10, 4), (999_999_937, 10**12 + 39, 12345)]:
        assert int(divergence.price(np.array([c]), n, v)[0]) == 1 + 10**9 * (c + 5) // (n + 5 * v)
