"""Language identification by rank-order profiles.

A profile is a language's ``PROFILE`` most frequent letter n-grams (1 to 3
letters, words padded), in order.  A document's own most frequent ``PROFILE``
n-grams are held against each: the out-of-place distance adds, for each, how
far its rank is from the profile's, or the most it can be where the profile
lacks it.  The nearest language wins, ties by name; the score is
1 - nearest / second nearest (against the greatest distance where one language
is known), from 0 to 1.

Profiles are learned from at most about ``TRAIN_DOCS`` documents a language,
chosen by a hash of the key; every document is predicted from its whole text.
Nulls: a null text, or one without letters, is ``und`` with score 0, as is
every text when nothing was learned; a null key hashes as the empty text; a
null language teaches nothing.  Repeated rows are predicted each."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

PROFILE, TRAIN_DOCS = 400, 4000


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@cache
def spaces() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def letter_share(text: str) -> float:
    """Letters as a share of the characters that are no white space."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return float(letters()[raw].sum() / max(1, len(raw) - int(spaces()[raw].sum())))


def grams(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of the text's letters, lower-cased.
    Anything else stands as one pad, and no gram has a pad inside."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c = np.zeros(len(raw) + 2, dtype=np.int64)
    c[1:-1] = np.where(letters()[raw], raw, 0)
    is_letter = c > 0
    a, b, d = c[:-2], c[1:-1], c[2:]
    pair = is_letter[:-1] | is_letter[1:]
    return np.concatenate([c[is_letter], ((c[:-1] << 21) | c[1:])[pair] | np.int64(-2**63), ((a << 42) | (b << 21) | d)[is_letter[1:-1]]])


def top_grams(text: str, most: int = PROFILE) -> np.ndarray:
    """Most frequent grams in order; ties by code."""
    u, n = np.unique(grams(text), return_counts=True)
    if len(u) > most:
        keep = n >= np.partition(n, len(n) - most)[len(n) - most]
        u, n = u[keep], n[keep]
    return u[np.lexsort((u, -n))][:most]


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             per_lang: int = TRAIN_DOCS, most: int = PROFILE) -> dict[str, np.ndarray]:
    """{language: gram codes in order of rank}.  The driver gets ``most`` rows
    a language."""
    train = docs.where(~held_out(key) & F.col(lang).isNotNull())
    n = {r[0]: r[1] for r in train.groupBy(F.col(lang).alias("l")).agg(F.count("*")).collect()}
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, per_lang / v))])
    chosen = train.where(F.pmod(F.xxhash64(F.lit("profile"), F.col(key)), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20))

    def count(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(grams(t or ""))
            for x, gs in by.items():
                u, c = np.unique(np.concatenate(gs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(u), pa.string()), pa.array(u), pa.array(c)], names=["l", "g", "n"])

    counted = (chosen.select(F.col(lang).alias("l"), text).mapInArrow(count, "l string, g long, n long")
               .groupBy("l", "g").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    out: dict[str, list] = {x: [] for x in n}
    for r in counted.withColumn("r", place).where(F.col("r") <= most).orderBy("l", "r").collect():
        out[r["l"]].append(r["g"])
    return {x: np.array(out[x], dtype=np.int64) for x in sorted(out)}


def distance(mine: np.ndarray, profile_sorted: np.ndarray, rank: np.ndarray, most: int) -> float:
    """Out-of-place distance as a share of the greatest it can be."""
    if not len(profile_sorted):
        return 1.0
    i = np.minimum(np.searchsorted(profile_sorted, mine), len(profile_sorted) - 1)
    known = profile_sorted[i] == mine
    gap = np.where(known, np.abs(rank[i] - np.arange(len(mine))), most)
    return float(gap.sum() / (most * len(mine)))


def predict(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", most: int = PROFILE,
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, ``lang_pred``, ``score``, ``distance`` (the
    nearest language's, as a share of the greatest; 1 for ``und``), ``n_grams``
    (those held against the profiles) and ``letters`` (their share of the
    characters that are no white space)."""
    small_batches(docs.sparkSession, 500)
    order = {x: np.argsort(g, kind="stable") for x, g in learned.items()}
    table = {x: (g[order[x]], order[x]) for x, g in learned.items()}

    def one(t: str | None) -> tuple[str, float, float, int, float]:
        mine = top_grams(t, most) if t else ()
        share = letter_share(t) if t else 0.0
        if not len(mine) or not table:
            return "und", 0.0, 1.0, len(mine), share
        d = sorted((distance(mine, *table[x], most), x) for x in table)
        second = d[1][0] if len(d) > 1 else 1.0
        return d[0][1], max(0.0, min(1.0, 1 - d[0][0] / second)) if second > 0 else 0.0, d[0][0], len(mine), share

    def run(batches):
        for b in batches:
            got = [one(t) for t in b.column(b.num_columns - 1).to_pylist()]
            found = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], names=[*names, "lang_pred", "score", "distance", "n_grams", "letters"])

    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("_text"))
    shape = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{shape}, lang_pred string, score double, distance double, n_grams long, letters double").withColumnsRenamed(dict(zip(names, keep, strict=True)))
