"""Near-duplicate vectors by cross-polytope hashing.

Vectors are scaled to length one, and each hash rotates them by three rounds
of random signs and a fast Hadamard transform; the hash is the axis, with its
sign, that the rotated vector is nearest to.  A table joins ``k`` hashes;
every vector is in its home bucket and in its ``probes`` next nearest ones.
Tables and probes grow with ``k`` (``REACH``), so that links are found as often
in a large table as in a small one.  Vectors that meet in a bucket are compared in blocks by a
matrix product in double precision, and linked from ``cosine`` on.

Equal vectors are hashed once and counted as often as they occur.  Buckets of
one vector go no further.  What moves is the vector as it is given (floats as
floats) and its codes in as few bytes as hold them.  A bucket of more than ``BLOCK`` vectors is split
into blocks, each pair of blocks being a group of its own, so no pair is left
out and no task holds a bucket.  A pair that meets in many buckets is counted
in the first; groups return counts and a spanning star, never all pairs.

Nulls: vectors that are null, empty, zero or hold null or non-finite parts
link with nothing and are their own component, as rows of null id are with a
null component.  Repeated rows are vectors like others.  Vectors of different
length never link.  Columns beyond id and vector are ignored."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, n_parts, roots, stage, whole_groups

BLOCK = 1024
#: Pairs whose buckets are compared at a time.
PAIRS = 1 << 16
#: {hashes a table: (tables, probes)}.
REACH = {1: (6, 6), 2: (6, 6), 3: (10, 8), 4: (16, 12)}


def hashes(n: int, d: int) -> int:
    """As many hashes a table as make buckets outnumber ``n`` vectors, as far
    as ``REACH`` goes; beyond, buckets grow."""
    return min(max(REACH), max(1, round(math.log(max(n, 2)) / math.log(2 * max(2, d)) + 0.2)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest part first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, tables: int, k: int, probes: int, seed: int = 11) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes: the home bucket first, then
    the probed ones from the nearest."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, size])
    near = min(4, size)
    combos = np.array(list(itertools.product(range(near), repeat=k)))
    many = min(1 + probes, len(combos))
    out = np.empty((n, tables, many), dtype=np.int64)
    for t in range(tables):
        cost = np.zeros((n, len(combos)))
        code = np.full((n, len(combos)), size, dtype=np.int64)
        for j in range(k):
            r = padded
            for _ in range(3):
                r = hadamard(r * rng.choice([-1.0, 1.0], size))
            a = np.abs(r)
            o = np.argsort(-a, axis=1, kind="stable")[:, :near]
            v = np.take_along_axis(a, o, 1)
            c = 2 * o + (np.take_along_axis(r, o, 1) < 0)
            cost += ((v[:, :1] - v) ** 2)[:, combos[:, j]]
            code = code * (2 * size) + c[:, combos[:, j]]
        out[:, t] = np.take_along_axis(code, np.argsort(cost, axis=1, kind="stable")[:, :many], 1)
    return out


def code_kind(d: int, k: int) -> type:
    """The least type that holds the codes of k hashes of d dimensions."""
    size = 1 << max(0, (d - 1).bit_length())
    return np.int32 if (size + 1) * (2 * size) ** k < 1 << 31 else np.int64


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least code that rows of both have, or the greatest integer."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for w in range(a.shape[1]):
        out = np.where((a[:, w, None] == b).any(axis=1), np.minimum(out, a[:, w]), out)
    return out


def linked(x: np.ndarray, codes: np.ndarray, block: np.ndarray, table: int, code: int, cosine: float) -> np.ndarray:
    """(row, row) pairs of a group that link and that no earlier bucket has:
    neither an earlier table, nor a lesser code of this one."""
    sim = x @ x.T
    i, j = np.nonzero(np.triu(sim >= cosine, 1))
    if len(np.unique(block)) > 1:
        other = block[i] != block[j]
        i, j = i[other], j[other]
    out = []
    for lo in range(0, len(i), PAIRS):
        p, q = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
        first = shared(codes[p, table], codes[q, table]) == code
        p, q = p[first], q[first]
        for t in range(table):
            fresh = shared(codes[p, t], codes[q, t]) == np.iinfo(np.int64).max
            p, q = p[fresh], q[fresh]
        out.append(np.stack([p, q], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9,
                    tables: int | None = None, probes: int | None = None, k: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.  Without ``k``, a table
    joins as many hashes as make buckets outnumber vectors; without ``tables``
    or ``probes``, they are those of ``k``."""
    v = F.col(vector).cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = stage(vectors.select(F.col(key).cast("long").alias("id"), F.when(good, v).alias("v")), "vec-rows")
    spark = rows.sparkSession
    classes = stage(rows.where("v is not null and id is not null").groupBy("v")
                    .agg(F.min("id").alias("id"), F.count("*").alias("m")), "vec-classes")
    at = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if k is None:
        k = hashes(at[0], at[1] or 2)
    reach = REACH[min(k, max(REACH))]
    tables, probes = reach[0] if tables is None else tables, reach[1] if probes is None else probes
    held = np.float32 if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) else np.float64

    def hashed(batches):
        for b in batches:
            col = b.column(1)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy()
            for d in np.unique(sizes):
                take = np.flatnonzero(sizes == d)
                begin = np.cumsum(sizes) - sizes
                x = flat[(begin[take][:, None] + np.arange(d)).ravel()].reshape(len(take), d)
                c = codes(unit(x), tables, k, probes)
                t = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(t), b.column(2).take(t), pa.array([r.tobytes() for r in x.astype(held)], pa.binary()),
                     pa.array([r.tobytes() for r in c.astype(code_kind(int(d), k))], pa.binary()),
                     pa.array(list(c.reshape(len(take), -1)), pa.list_(pa.int64()))],
                    names=["id", "m", "x", "all", "codes"])

    h = stage(classes.select("id", "v", "m").mapInArrow(
        hashed, "id long, m long, x binary, all binary, codes array<long>"), "vec-codes")
    # of each class: its buckets, by table
    spots = (h.select("id", F.posexplode("codes").alias("p", "code"), (F.size("codes") / tables).cast("int").alias("w"))
             .select("id", (F.col("p") / F.col("w")).cast("int").alias("t"), "code"))
    full = (spots.groupBy("t", "code").agg(F.count("*").alias("n"))
            .where("n > 1").select("t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")))
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    placed = (spots.join(full, ["t", "code"]).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("id", "t", "code", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")))
    met = (placed.join(h.select("id", "m", "x", "all"), "id")
           .repartition(n_parts(spark), "t", "code", "bi", "bj").sortWithinPartitions("t", "code", "bi", "bj", "id"))

    def compare(batches):
        for b, cuts in whole_groups(batches, ["t", "code", "bi", "bj"], 4000):
            ids, m = b.column("id").to_numpy(), b.column("m").to_numpy()
            t, code, block = (b.column(c).to_numpy() for c in ("t", "code", "own"))
            raw = [b.column(c).to_pylist() for c in ("x", "all")]
            out: list[tuple] = []
            for lo, hi in itertools.pairwise(cuts.tolist()):
                if hi - lo < 2:
                    continue
                sizes = [len(r) for r in raw[0][lo:hi]]
                if min(sizes) != max(sizes):
                    continue  # codes hold the length: never met
                x = np.frombuffer(b"".join(raw[0][lo:hi]), held).reshape(hi - lo, -1).astype(np.float64)
                every = np.frombuffer(b"".join(raw[1][lo:hi]), code_kind(x.shape[1], k)).reshape(hi - lo, tables, -1).astype(np.int64)
                x = unit(x)
                pairs = linked(x, every, block[lo:hi], int(t[lo]), int(code[lo]), cosine)
                if not len(pairs):
                    continue
                links = np.zeros(hi - lo, np.int64)
                np.add.at(links, pairs[:, 0], m[lo:hi][pairs[:, 1]])
                np.add.at(links, pairs[:, 1], m[lo:hi][pairs[:, 0]])
                some = np.flatnonzero(links)
                root = roots(pairs, hi - lo)
                out.append((ids[lo:hi][some], ids[lo:hi][root[some]], links[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "links"])

    found = stage(met.select("t", "code", "bi", "bj", "own", "id", "m", "x", "all")
                  .mapInArrow(compare, "a long, b long, links long"), "vec-links")
    labels = components(found.select("a", "b"), "vec-cc")
    of_class = (classes.join(found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links")), "id", "left")
                .join(labels, "id", "left")
                .select("v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c")))
    with_v = rows.where("v is not null and id is not null").join(of_class, "v").select("id", "n_links", "c")
    rest = rows.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    return with_v.unionByName(rest).select(F.col("id").alias(key), "n_links", F.col("c").alias("component_id"),
                                           F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
