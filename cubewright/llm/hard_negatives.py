"""Hard negatives by the Four Russians' tables.

Vectors become whole numbers, ``floor(256 x)``.  A row's numbers are kept as
two's complement bit planes: for each plane and each group of eight dimensions
one packed byte.  For an anchor, the sums of all 256 subsets of a group's eight
parts are computed once; a candidate's plane byte picks the subset that the
plane has, and the look-ups of all groups, shifted by the plane and added (the
sign plane taken off), give the exact inner product.

Two passes, each in blocks of anchors against blocks of candidates: rows of an
anchor's label give its positives, then all rows give, for each positive, the
best of another label whose scores lie within the limits.  Blocks return their
best rows per anchor, of which a window keeps the best; a label or table of any
size is so many blocks.

Scores are exact integers.  Rows with a null id, label or vector, with a part
that is null or not finite, or with a part so large that a score might pass 64
bits (about 2**31 / sqrt(dimensions) after the scaling) take no part.  Rows that
share an id count as one, that of least label, then vector.  Only vectors of
one length are compared.  Ties go to the smaller id; the remainder of a
negative label is SQL's.  An anchor without
positives, or a positive without negatives, has no rows.  Other columns are
ignored; an empty table gives no rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, stage, whole_groups

SCALE, EVERY, RELABEL, CLASSES = 256, 50, 7, 10
POSITIVES, NEGATIVES, LEAST, GREATEST = 5, 3, 50, 95
#: Rows of a block of candidates and of anchors.
CANDIDATES, ANCHORS = 8192, 2048
#: Anchors whose tables are held, and candidates that are looked up, at a time.
TABLES, ROWS = 128, 2048


def bits(low: int, high: int) -> int:
    """Planes that hold low..high in two's complement."""
    return 1 + max(int(high).bit_length() if high >= 0 else 0, int(-low - 1).bit_length() if low < 0 else 0)


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of whole numbers (rows, dimensions)."""
    n, d = x.shape
    x = np.concatenate([x, np.zeros((n, -d % 8), x.dtype)], axis=1)
    on = (x[:, None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(on.astype(np.uint8), axis=2, bitorder="little")


def unpack(p: np.ndarray) -> np.ndarray:
    """(rows, dimensions, made up to eights) whole numbers of packed planes."""
    on = np.unpackbits(p, axis=2, bitorder="little").astype(np.int64)
    weight = np.int64(1) << np.arange(p.shape[1], dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("npd,p->nd", on, weight)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of all subsets of each eight parts, in the
    least type that holds the sum of all."""
    n, d = anchors.shape
    most = int(np.abs(anchors).max(initial=0)) * d
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    out = np.zeros((d // 8, 256, n), dtype=kind)
    parts = anchors.T.reshape(d // 8, 8, n).astype(kind)
    for i in range(8):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + parts[:, i, None]
    return out


def score(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: look-ups of all groups added by plane,
    planes from the sign down by shift and add."""
    n, planes, groups = packed.shape
    out = np.zeros((n, tables.shape[2]), dtype=np.int64)
    for p in range(planes - 1, -1, -1):
        found = np.zeros((n, tables.shape[2]), dtype=tables.dtype)
        for g in range(groups):
            found += tables[g].take(packed[:, p, g], axis=0)
        if p == planes - 1:
            out -= found
        else:
            out <<= 1
            out += found
    return out


def _planes(b: pa.RecordBatch, take: slice, planes: int) -> np.ndarray:
    raw = b.column("planes").slice(take.start, take.stop - take.start).to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), planes, -1)


def _blocks(rows: DataFrame, anchors: DataFrame, by: list[str], planes: int, each, shape: str, anchor_rows: int, candidate_rows: int) -> DataFrame:
    """``each(batch, anchors, candidates)`` over every block of anchors with
    every block of candidates that have the columns of ``by`` in common."""
    spark = rows.sparkSession
    sizes = (rows.groupBy(*by).agg(F.count("*").alias("n")).join(anchors.groupBy(*by).agg(F.count("*").alias("m")), by)
             .select(*by, F.ceil(F.col("n") / candidate_rows).cast("int").alias("cb"), F.ceil(F.col("m") / anchor_rows).cast("int").alias("ab")))
    sizes = stage(sizes, "neg-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= 200_000 else sizes
    at = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = [c for c in anchors.columns if c not in rows.columns]
    a = anchors.join(sizes, by).select(*rows.columns, *told, F.lit(0).alias("kind"), at("ab").alias("i"), every("cb").alias("j"))
    c = rows.join(sizes, by).select(*rows.columns, *[F.lit(None).cast(anchors.schema[t].dataType).alias(t) for t in told],
                                    F.lit(1).alias("kind"), at("cb").alias("j"), every("ab").alias("i"))
    keys = [*by, "i", "j"]
    met = a.unionByName(c).repartition(n_parts(spark), *keys).sortWithinPartitions(*keys, "kind", "id")

    def run(batches):
        for b, cuts in whole_groups(batches, keys, 4096):
            kind = b.column("kind").to_numpy()
            for lo, hi in itertools.pairwise(cuts.tolist()):
                mid = lo + int((kind[lo:hi] == 0).sum())
                if lo < mid < hi:
                    yield from each(b, slice(lo, mid), slice(mid, hi))

    return met.mapInArrow(run, shape)


def _scored(b: pa.RecordBatch, anchors: slice, candidates: slice, planes: int):
    """(first anchor, (anchors, candidates) scores) of a few anchors at a time."""
    numbers, packed = unpack(_planes(b, anchors, planes)), _planes(b, candidates, planes)
    for at in range(0, len(numbers), TABLES):
        tables = subset_sums(numbers[at:at + TABLES])
        yield anchors.start + at, np.concatenate([score(tables, packed[s:s + ROWS]) for s in range(0, len(packed), ROWS)]).T


def quantised(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that take part, labels changed, v whole numbers."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda x: F.abs(x) * SCALE <= F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1)))) - 1)
    ok = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & fits, F.lit(False))
    kind = F.col(label).cast("long")
    rows = vectors.select(F.col(key).cast("long").alias("id"), kind.alias("label"), v.alias("v"), ok.alias("ok")).where("ok and id is not null and label is not null")
    changed = F.when(F.col("id") % RELABEL == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return (rows.select("id", F.struct(changed.alias("label"), F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")).alias("r"))
            .groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v"))


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES,
         negatives: int = NEGATIVES, anchor_rows: int = ANCHORS, candidate_rows: int = CANDIDATES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    numbers = stage(quantised(vectors, key, vector, label), "neg-rows")
    ends = numbers.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    planes = bits(ends[0] or 0, ends[1] or 0)

    def packing(batches):
        for b in batches:
            col = b.column(2)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                take = np.flatnonzero(sizes == d)
                p = pack(flat[(begin[take][:, None] + np.arange(d)).ravel()].reshape(len(take), d), planes)
                t = pa.array(take)
                yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), pa.array(np.full(len(take), d, np.int32)),
                                                  pa.array([r.tobytes() for r in p], pa.binary())], names=["id", "label", "d", "planes"])

    rows = stage(numbers.select("id", "label", "v").mapInArrow(packing, "id long, label long, d int, planes binary"), "neg-planes")
    anchors = rows.where(F.col("id") % every == 0)

    def nearest(b, a, c):
        ids = b.column("id").to_numpy()
        out = []
        for at, s in _scored(b, a, c, planes):
            who = np.arange(at, at + len(s))
            lowest = np.iinfo(np.int64).min
            s[ids[who][:, None] == ids[c][None, :]] = lowest
            for _ in range(min(positives, s.shape[1])):
                best = s.argmax(axis=1)  # the first of equal ones: the least id
                value = s[np.arange(len(s)), best]
                some = value > lowest
                out.append((ids[who[some]], ids[c][best[some]], value[some]))
                s[np.arange(len(s)), best] = lowest
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "other", "score"])

    found = _blocks(rows, anchors, ["d", "label"], planes, nearest, "anchor long, other long, score long", anchor_rows, candidate_rows)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    best = (found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
            .groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("other", "score")).alias("pos")))
    asking = stage(anchors.join(best, "id"), "neg-positives")

    def hardest(b, a, c):
        ids, labels, pos = b.column("id").to_numpy(), b.column("label").to_numpy(), b.column("pos")
        for at, s in _scored(b, a, c, planes):
            asked = [[(p["other"], p["score"]) for p in pos[at + i].as_py()] for i in range(len(s))]
            width = max(map(len, asked))
            score_of = np.array([[x for _, x in p] + [-1] * (width - len(p)) for p in asked], dtype=np.int64)
            id_of = np.array([[x for x, _ in p] + [-1] * (width - len(p)) for p in asked], dtype=np.int64)
            # 50 p <= 100 n <= 95 p, in whole numbers; never for p < 0
            lo = np.where(score_of >= 0, score_of // 100 * LEAST - (-(score_of % 100) * LEAST // 100), 1)
            hi = np.where(score_of >= 0, score_of // 100 * GREATEST + score_of % 100 * GREATEST // 100, 0)
            least = np.where(score_of >= 0, lo, np.iinfo(np.int64).max).min(axis=1)
            most = np.where(score_of >= 0, hi, -1).max(axis=1)
            i, j = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (labels[at:at + len(s), None] != labels[c][None, :]))
            value = s[i, j]
            order = np.lexsort((j, -value, i))
            i, j, value = i[order], j[order], value[order]
            for k in range(width):
                fit = np.flatnonzero((value >= lo[i, k]) & (value <= hi[i, k]))
                if not len(fit):
                    continue
                start = np.searchsorted(i[fit], i[fit])
                fit = fit[np.arange(len(fit)) - start < negatives]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at + i[fit]], id_of[i[fit], k], score_of[i[fit], k], ids[c][j[fit]], value[fit])],
                                                 names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    hard = _blocks(rows, asking, ["d"], planes, hardest, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", anchor_rows, candidate_rows)
    last = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (hard.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
