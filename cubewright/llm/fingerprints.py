"""Document fingerprints from closed syncmers.

A k-mer of the text's UTF-8 bytes is a closed syncmer if the least of its
inner s-mers' hashes is its first or its last: a choice that depends on the
k-mer alone, so an edit moves no anchor outside it.  A fingerprint is the
``SIZE`` syncmers of least hash with the byte position of their first
occurrence, as text ``hash:position`` in order of hash.  Two fingerprints are
compared over the least hashes of both together: anchors in both that keep
their order (longest increasing run of positions) count as shared, and the
share j becomes the likeness 2j / (1 + j).

Nulls: a null text is empty; its fingerprint is the empty string.  A text too
short for a k-mer has its whole hash as its only anchor.  Two empty
fingerprints are alike (1.0), an empty and another are not (0.0).  Equal texts
have equal fingerprints.  Repeated rows are fingerprinted each."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_prefix, n_parts, small_batches, span_hashes, string_slices

K, S, SIZE = 24, 8, 64


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of a byte string."""
    if len(data) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = gram_prefix(data)
    at = np.arange(len(data) - s + 1)
    h = span_hashes(prefix, at, at + s)
    w = k - s + 1
    low = sliding_min(h, w)
    chosen = np.flatnonzero((h[:len(low)] == low) | (h[w - 1:] == low))
    return chosen, span_hashes(prefix, chosen, chosen + k)


def fingerprint_arrays(texts: list[str], size: int = SIZE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text's fingerprint, hashes ascending."""
    out = []
    for _, data, off in string_slices(pa.array(texts, pa.large_string()), 1 << 18):
        # rows of a slice at once; syncmers that cross rows are left out
        pos, h = syncmers(data)
        row = np.searchsorted(off, pos, "right") - 1
        inside = pos + K <= off[row + 1]
        pos, h, row = pos[inside] - off[row[inside]], h[inside] >> np.uint64(32), row[inside]
        ends = np.searchsorted(row, np.arange(len(off)))
        for i in range(len(off) - 1):
            n = off[i + 1] - off[i]
            a, b = h[ends[i]:ends[i + 1]], pos[ends[i]:ends[i + 1]]
            if n and not len(a):
                piece = data[off[i]:off[i + 1]]
                a = span_hashes(gram_prefix(piece), np.array([0]), np.array([n])) >> np.uint64(32)
                b = np.array([0])
            if len(a) > 4 * size:  # the rest can't be among the least
                near = a <= np.partition(a, 4 * size)[4 * size]
                if len(np.unique(a[near])) >= size:
                    a, b = a[near], b[near]
            u, first = np.unique(a, return_index=True)
            out.append((u[:size], b[first][:size]))
    return out


def written(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join(f"{h:08x}:{p}" for h, p in zip(fp[0].tolist(), fp[1].tolist(), strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) == len(b[0]) and (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    union = np.union1d(a[0], b[0])[:size]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    ok = shared <= union[-1]
    run: list[int] = []  # longest increasing run of positions in b, by those in a
    for p in b[1][j[ok]][np.argsort(a[1][i[ok]], kind="stable")].tolist():
        k = bisect_left(run, p)
        run[k:k + 1] = [p]
    s = len(run) / len(union)
    return 2 * s / (1 + s)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every row."""
    small_batches(docs.sparkSession, 500)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            fps = fingerprint_arrays(texts) if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(written, fps), pa.string())],
                                             names=["_key", "n_chars", "fingerprint"])

    return docs.select(F.col(key).alias("_key"), text).mapInArrow(
        run, f"_key {kind}, n_chars long, fingerprint string").withColumnRenamed("_key", key)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (part, ahead, key, text) dealt so that a task has a run of keys in
    order, and after it, as rows with ahead = true, those that begin the next
    run (after the last, the first).  Runs are cut at approximate quantiles of
    the key, a list as long as the shuffle has partitions."""
    parts = n_parts(docs.sparkSession)
    ids = docs.select(F.col(key).cast("double").alias("k"))
    found = ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = np.unique(np.array(found, dtype=float))

    def deal(first: dict[int, list[int]], none_at: int | None):
        def run(batches):
            for b in batches:
                keys = b.column(0).to_pylist()
                part = np.searchsorted(edges, [np.nan_to_num(-np.inf) if k is None else float(k) for k in keys], "right")
                more = [(i, p) for i, k in enumerate(keys) for p in (first.get(k, ()) if k is not None else () if none_at is None else (none_at,))]
                take = pa.array([*range(len(keys)), *[i for i, _ in more]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*part.tolist(), *[p for _, p in more]], pa.int32()), pa.array([False] * len(keys) + [True] * len(more)),
                     b.column(0).take(take), b.column(1).take(take)], names=["part", "ahead", "key", "text"])
        return run

    kind = docs.schema[key].dataType.simpleString()
    shape = f"part int, ahead boolean, key {kind}, text string"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # one row a part: where each begins
    starts = (rows.select("key", F.lit(None).cast("string").alias("text")).mapInArrow(deal({}, None), shape)
              .groupBy("part").agg(F.min("key").alias("key"), F.max(F.col("key").isNull()).alias("none")).orderBy("part").collect())
    first: dict[int, list[int]] = {}
    none_at = None
    for i, r in enumerate(starts):
        before = starts[i - 1]["part"]  # of the first: the last
        if r["none"]:
            none_at = before
        else:
            first.setdefault(r["key"], []).append(before)
    return (rows.mapInArrow(deal(first, none_at), shape).repartitionById(parts, "part")
            .sortWithinPartitions("part", "ahead", F.col("key").asc_nulls_first(), "text"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its fingerprint, that of its text whose last half is
    replaced by the start of the next row's (ascending key, then text; after
    the last the first), and the likeness to that and to the next row's."""
    small_batches(docs.sparkSession, 500)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def made(held: list[tuple]) -> pa.RecordBatch:
            """Rows held, all but the last of which come out."""
            texts = [r[3] or "" for r in held]
            edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
            fps = fingerprint_arrays(texts + edited)
            own, new = fps[:len(texts)], fps[len(texts):]
            out = [i for i in range(len(edited)) if not held[i][1] and held[i][0] == held[i + 1][0]]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[i][2] for i in out], b_type), pa.array([len(texts[i]) for i in out], pa.int64()),
                 pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in out], pa.string()),
                 pa.array([written(own[i]) for i in out], pa.string()), pa.array([written(new[i]) for i in out], pa.string()),
                 pa.array([likeness(own[i], new[i]) for i in out], pa.float64()),
                 pa.array([likeness(own[i], own[i + 1]) for i in out], pa.float64())],
                names=["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        b_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
        held: list[tuple] = []
        chars = 0
        for r in rows():
            held.append(r)
            chars += len(r[3] or "")
            if len(held) > 500 or chars > 1 << 21:
                yield made(held)
                held, chars = held[-1:], len(held[-1][3] or "")
        if len(held) > 1:
            yield made(held)

    return with_next(docs, key, text).mapInArrow(
        run, f"_key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double").withColumnRenamed("_key", key)
