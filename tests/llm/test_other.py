"""Chat formatting, vectors and WARC records against brute force and round trips."""

import base64
import gzip
import hashlib
import html
import json
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cubewright.llm import chat, embed_dedup, warc
from cubewright.llm.queries import ORACLES, QUERIES


def turns():
    rng = random.Random(3)
    out = []
    for c in range(40):
        n = rng.randint(1, 9) if c else 120
        for i in range(n):
            role = "system" if i == 0 and c % 3 == 0 else ("user", "assistant")[i % 2]
            text = "".join(rng.choice(["word ", "é ", "\\", "<|end|>", "</s>", "[INST]", "<<SYS>>", "<|tur", "n|>", "\n", "<", "日"]) for _ in range(rng.choice([0, 5, 300, 900])))
            out.append((c, i, role, text))
    out += [(50, 0, "assistant", None), (51, None, None, "no turn"), (51, 3, "assistant", "x" * 9000), (52, 0, "system", "alone"),
            (53, 0, "assistant", "same"), (53, 0, "assistant", "same"), (None, 0, "assistant", "no id")]
    return out


def digests(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, g in groups.items():
        g.sort()
        said = "".join(x for *_, r, x in g if r == "assistant")
        out[c] = (len(g), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in g).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_query(spark, tmp_path):
    rows = turns()
    cols = list(zip(*rows, strict=True))
    table = pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()),
                      "text": pa.array(cols[3], pa.string()), "window": pa.array(["clash"] * len(rows)), "c": pa.array([1] * len(rows))})
    pq.write_table(table, f"{tmp_path}/conversations.parquet")
    got = QUERIES["op5_chat"](spark, str(tmp_path)).collect()
    text = "</s>[INST] ok [/INST]"
    want = digests([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)])
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    oracle = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op5_chat']})").fetchall()
    assert sorted(oracle, key=str) == sorted((tuple(r[n] for n in names) for r in got), key=str)


def test_chat_windows(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string")
    control = re.compile("|".join(map(re.escape, chat.CONTROL)))
    rows = chat.windows(df, budget=600, system_tokens=60, history_tokens=60, history=3).collect()
    assert len(rows) > 2 * len({r["conv_id"] for r in rows})
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
        f = r["formatted"]
        parts = f.split("<|end|>")
        assert parts[-1] == "" and all(p.startswith("<|turn|>") and p.count("<|text|>") == 1 for p in parts[:-1])
        for p in parts[:-1]:
            for x in p[len("<|turn|>"):].split("<|text|>"):
                assert not control.search(x)
        masked = [f[s["start"]:s["start"] + s["length"]] for s in r["loss"]]
        assert masked == [p.split("<|text|>")[1] for p in parts[r["context"]:-1] if p.startswith("<|turn|>assistant<|text|>")]
        assert r["over_budget"] == (r["tokens"] > 600)
        new = len(parts) - 1 - r["context"]
        assert new >= 1 and (not r["over_budget"] or new == 1 or parts[0].startswith("<|turn|>system"))
    assert any(r["context"] > 1 for r in rows)
    for ws in by.values():
        assert [w["window"] for w in sorted(ws, key=lambda w: w["window"])] == list(range(1, len(ws) + 1))
        first = [w["formatted"].split("<|end|>")[0] for w in ws]
        if first[0].startswith("<|turn|>system"):
            assert len(set(first)) == 1     # the system turn is kept in every window


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["\\", "\\\\", "<", "[", "|", *chat.CONTROL, "a"]) for _ in range(8)) for _ in range(300)] + ["", "\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape("t").alias("e")).select("*", chat.unescape("e").alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(df)).collect() == []


def vectors():
    rng = np.random.default_rng(0)
    out = []
    for _ in range(150):
        out.append(rng.normal(size=32))
    for i in range(60):      # at the threshold's either side
        a = out[i] / np.linalg.norm(out[i])
        b = rng.normal(size=32)
        b -= (b @ a) * a
        c = rng.uniform(0.88, 0.99)
        out.append(3 * (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)))
    hot = rng.normal(size=32)
    out += [hot] * 12 + [hot + rng.normal(size=32) * 0.05 for _ in range(90)] + [hot * 2.5]
    return [v.tolist() for v in out]


def brute(vs, cosine=0.9):
    ok = [i for i, v in enumerate(vs) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(vs))}
    for d in {len(vs[i]) for i in ok}:
        own = [i for i in ok if len(vs[i]) == d]
        a = np.array([vs[i] for i in own])
        a = a / np.abs(a).max(1, keepdims=True)
        a /= np.linalg.norm(a, axis=1)[:, None]
        for x, y in zip(*np.nonzero(a @ a.T >= cosine), strict=True):
            if x != y:
                links[own[x]].add(own[y])
    return links


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    vs = [*vectors(), None, [], [0.0] * 32, [1.0, None] * 16, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0], [1e-200] * 32, [1e200] * 32]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, id string, m int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    links = brute(vs)
    assert len(got) == len(vs)
    found, total = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert 0.97 * total <= found <= total
    assert all(r["n_links"] <= len(links[i]) for i, r in got.items())
    seen = {}
    for i in links:             # components of all links, each by its least
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for j in links[todo.pop()] - part:
                    part.add(j)
                    todo.append(j)
            seen |= {j: min(part) for j in part}
    assert sum(got[i]["component_id"] == seen[i] for i in links) >= 0.97 * len(links)
    assert all(got[i]["component_id"] >= seen[i] and got[i]["kept"] == (got[i]["component_id"] == i) for i in links)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    for d, k in ((64, 2), (64, 3), (128, 2), (128, 4), (1024, 4)):
        a = embed_dedup.unit(rng.normal(size=(1000 if d < 1000 else 200, d)))
        b = rng.normal(size=a.shape)
        b = embed_dedup.unit(b - (a * b).sum(1)[:, None] * a)
        b = 0.9 * a + math.sqrt(1 - 0.81) * b
        x, y = (embed_dedup.codes(v, embed_dedup.REACH[k][0], k, embed_dedup.REACH[k][1]) for v in (a, b))
        assert max(x.max(), y.max()) <= np.iinfo(embed_dedup.code_kind(d, k)).max
        # a probed bucket of both counts, as in the join
        met = np.any([embed_dedup.shared(x[:, t], y[:, t]) < np.iinfo(np.int64).max for t in range(x.shape[1])], axis=0)
        assert met.mean() >= 0.9, (d, k, met.mean())


def test_recall_does_not_fall_with_the_table():
    rng = np.random.default_rng(6)
    for d in (8, 64, 128, 256, 512):
        for k in (1, 2, 3, 4):
            a = embed_dedup.unit(rng.normal(size=(400, d)))
            b = rng.normal(size=a.shape)
            b = embed_dedup.unit(b - (a * b).sum(1)[:, None] * a)
            b = 0.9 * a + math.sqrt(1 - 0.81) * b
            x, y = (embed_dedup.codes(v, embed_dedup.REACH[k][0], k, embed_dedup.REACH[k][1]) for v in (a, b))
            met = np.zeros(len(a), bool)
            for t in range(x.shape[1]):
                met |= embed_dedup.shared(x[:, t], y[:, t]) < np.iinfo(np.int64).max
            assert met.mean() >= 0.9, (d, k, met.mean())
    assert {embed_dedup.hashes(n, d) for n in (2, 10**5, 10**7, 10**13) for d in (1, 64, 256)} == set(embed_dedup.REACH)


@pytest.mark.parametrize("k", [3, 4])
def test_vectors_by_more_hashes(spark, k):
    vs = vectors()
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, k=k).collect()}
    links = brute(vs)
    assert 0.97 * sum(map(len, links.values())) <= sum(got.values()) and all(got[i] <= len(x) for i, x in links.items())


def test_vectors_with_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v), (1, v), (None, v), (4, v)], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False), (None, 0, None, True)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(none).collect() == []


PAGE = ("<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- <a href='no'>x</a> --><script>var t='</p>';</script>"
        "<p>Fish &lt;chips&gt;<br>caf&eacute;</p><ul><li><a href=\"/x?a=1&amp;b=2\">one</a><li><a class=y href='/y'>two</a></ul></body></html>")


def parse(text):
    head, _, block = text.partition("\r\n\r\n")
    first, *lines = head.split("\r\n")
    assert first == "WARC/1.0"
    h = dict(x.split(": ", 1) for x in lines)
    assert int(h["Content-Length"]) == len(block.encode())
    assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block.encode()).digest()).decode()
    return h, block


def test_warc_derivatives(spark, tmp_path):
    rows = [(1, "http://e.org/1", PAGE), (2, None, None), (3, "http://e.org/3", ""), (None, "u", "plain"), (1, "http://e.org/1", PAGE),
            (5, "http://e.org/\r\nX: y", "<p>" + "long " * 50000)]
    df = spark.createDataFrame([(*r, "clash", b"x") for r in rows], "page_id long, url string, html string, text string, record binary")
    got = warc.derive(warc.responses(df), ("page_id",)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    by = {r["page_id"]: r for r in got}
    one = by[1]
    assert one["text"] == "A & B\nFish <chips>\ncafé\none\ntwo" and one["title"] == "A & B" and one["links"] == ["/x?a=1&b=2", "/y"]
    assert one["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode() and one["digest_agrees"]
    assert by[2]["text"] == "" and by[2]["target"] == ""
    ids = set()
    for r in got:
        for kind in ("metadata", "conversion"):
            h, block = parse(r[kind])
            assert h["WARC-Type"] == kind and h["WARC-Refers-To"] == r["source_id"] and h["WARC-Record-ID"] == r[f"{kind}_id"] and h["WARC-Date"] == warc.DATE
            ids.add(r[f"{kind}_id"])
            if kind == "conversion":
                assert block == r["text"]
            else:
                about = json.loads(block)
                assert about["payload-digest"] == r["payload_digest"] and ["WARC-Record-ID", r["source_id"]] in about["warc-headers"]
                assert ["Content-Type", "text/html; charset=utf-8"] in about["http-headers"]
    assert len(ids) == 2 * (len(rows) - 1)
    out = f"{tmp_path}/warc"
    warc.write(warc.derive(warc.responses(df)), out)
    back = [bytes(r["record"]).decode() for r in warc.read(spark, f"{out}/*.gz").collect()]
    assert Counter(back) == Counter(r[k] for r in got for k in ("metadata", "conversion"))
    for r in back:
        parse(r)
    # the derivatives are no responses
    assert warc.derive(warc.read(spark, f"{out}/*.gz")).count() == 0
    assert warc.derive(warc.responses(df.limit(0)), ("page_id",)).collect() == []


def test_warc_bodies():
    body = gzip.compress(b"<p>caf\xe9")
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX: a\r\n b\r\n\r\n" + chunked
    source = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Payload-Digest", "sha1:given")], block)
    about, meta, conv = warc.derivatives(source)
    assert about["text"] == "café" and about["payload-digest"] == "sha1:given" and ("X", "a b") in about["http-headers"]
    two = [*warc.records_of([gzip.compress(source + b"\r\n\r\n") + gzip.compress(meta + b"\r\n\r\n")])]
    assert two == [source, meta]
    assert warc.derivatives(meta) is None and warc.derivatives(b"") is None


def test_oracles_are_sql_of_registered_queries():
    assert set(ORACLES) <= set(QUERIES) and all(isinstance(x, str) for x in ORACLES.values())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))


# the markup rules as backtracking patterns, which hostile pages make quadratic
DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)


def test_markup_against_patterns():
    rng = random.Random(1)
    parts = ["<!--", "-->", "<script>", "</script>", "<SCRIPT a=b", "</script  >", "<style>", "</style>", "<a ", "<a href=x>", "<a href='y z'>", '<a href="q>r">', "</a>", ">", "<",
             "text", "<p>", "<title>", "</title>", "<title a>", "&amp;", "\n", " ", "href=1", '"', "'", "<br/>", "<template>", "</template>", "<abbr href=n>", "<div"]
    for _ in range(20000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        seen, title = DROP.sub(" ", page), TITLE.search(page)
        assert warc.shown(page) == seen
        assert warc.links_of(seen) == [html.unescape(a or b or c) for a, b, c in LINK.findall(seen)]
        assert warc.title_of(page) == (title[1] if title else "")
        assert warc.sub_tags(warc.TAG, "", seen) == warc.TAG.sub("", seen)


@pytest.mark.parametrize("mark", ["<!--", "<script>", "<", "<p", "<title>", "<title", "<a ", "<a href='", "</script", "<style></style"])
def test_hostile_pages_take_linear_time(mark):
    def seconds(n):
        page = mark * (n // len(mark))
        begin = time.perf_counter()
        warc.plain_text(page), warc.title_of(page), warc.links_of(warc.shown(page))
        return time.perf_counter() - begin

    seconds(10_000)
    assert seconds(2_000_000) < 20 * max(seconds(400_000), 0.02)


def test_records_as_a_stream(spark, tmp_path):
    """Files of many gzip members or none, in blocks of a few bytes."""
    pages = [warc.response(str(i), f"http://x/{i}", f"<p>{i}</p>" * (i * 50 % 997)) for i in range(200)]
    plain = b"".join(p + b"\r\n\r\n" for p in pages)
    members = b"".join(gzip.compress(p + b"\r\n\r\n") for p in pages)
    for data in (plain, members, gzip.compress(plain)):
        for step in (1000, 7777, len(data)):
            assert list(warc.records_of(data[i:i + step] for i in range(0, len(data), step))) == pages
    assert list(warc.records_of([])) == [] and list(warc.records_of([b"no record"])) == []
    assert list(warc.records_of([plain[:len(pages[0]) // 2]])) in ([], [plain[:len(pages[0]) // 2]])
    for name, data in (("a.warc", plain), ("b.warc.gz", members), ("c.warc", members), ("d.warc", b"")):
        (tmp_path / name).write_bytes(data)
    got = [bytes(r["record"]) for r in warc.read(spark, f"{tmp_path}/*").collect()]
    assert Counter(got) == Counter(pages * 3)
