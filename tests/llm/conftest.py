import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every oddity: nulls, blanks, a long text, copies, near
    copies, a shared passage, runs of a character, control strings."""
    rng = random.Random(5)
    tongues = {"en": "the of and to in that was for with this have from".split(), "fr": "le la les des que pour dans une est avec sur pas".split(),
               "de": "der die und nicht ein das mit auch sich auf für ist".split()}
    words = {k: v * 6 + [rng.choice(v) + rng.choice(v) + rng.choice("abcdefgh") for _ in range(150)] for k, v in tongues.items()}
    out = []

    def add(text, lang="en", source="a", key=None):
        out.append({"doc_id": len(out) if key is None else key, "text": text, "lang": lang, "source": source, "n_chars": len(text or "")})

    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        add(prose(rng, rng.randint(3, 160), words[lang]), lang, "src" + str(i % 4))
    passage = prose(rng, 110, words["en"])
    for i in range(4):
        add(prose(rng, 60, words["en"]) + " " + passage + "\n" + prose(rng, 40, words["en"]), source="p")
    base = prose(rng, 300, words["fr"]).split()
    for i in range(14):  # a chain of near copies
        base = base[:]
        for _ in range(4):
            base[rng.randrange(300)] = "x" + str(rng.randrange(10**6))
        add(" ".join(base), "fr", "near")
    copy = prose(rng, 90, words["de"])
    for i in range(6):
        add(copy, "de", "copies")
    add(copy.upper() + "  ", "de", "copies")
    for text in (None, "", "  \t\n ", "one", "two words", "A a\x0bA a", "a" * 1500, "ab" * 700, "é" * 600, "12 34 !! %%", "日本語の文章です", "x <|endoftext|> y </s>[INST]"):
        add(text, None if text == "one" else "en", None if text in ("one", "") else "odd")
    add(prose(rng, 30000, words["en"]), "en", "long")
    add(prose(rng, 50, words["en"]), "en", "twice", key=7)  # an id again
    out.append(dict(out[10]))  # a row again
    return out


def save(folder, rows, extra=True):
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    cols = {k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()}
    if extra:  # names that the operators use themselves
        for k in ("id", "_key", "_row", "h", "n", "component_id", "size", "copies", "_cid", "_id", "cid", "score", "key", "part"):
            cols[k] = pa.array(["clash"] * len(rows), pa.string())
    pq.write_table(pa.table(cols), f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def folder(rows, tmp_path_factory):
    return save(tmp_path_factory.mktemp("docs"), rows)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return save(tmp_path_factory.mktemp("none"), [])
