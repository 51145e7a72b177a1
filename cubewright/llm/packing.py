"""Packing documents into fixed-length token sequences along a Hilbert curve.

Documents become token ids; a document's hashed token counts are projected to
three dimensions, whose place on a Hilbert curve is the sort key.  Documents
are range-sorted by (key, row), prefix sums of their lengths (within a range,
then over ranges) give every document its place in one gapless stream, and the
stream is cut every ``length`` tokens.  What remains at the end is cut into
powers of two, which need no padding.  Only lengths are sorted; the ids move
once, to meet their places.

Nulls: a null text is empty and packs as the end id alone; null keys are kept.
Repeated rows are packed each.  An empty table gives no piece.  Other columns
are ignored."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, small_batches, stage

DIMS, BITS, HASHED = 3, 16, 1024
_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file.  Its vocabulary and its
    pre-tokeniser's pattern run in tiktoken, which gives the same ids faster;
    special tokens in a text are taken as such, as the file's own library
    does."""
    if path not in _ENCODERS:
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level files write bytes as printable characters: those that
        # print stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = (tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special),
                           frozenset(special))
    return _ENCODERS[path]


def encode(path: str, text: str) -> np.ndarray:
    enc, special = encoder(path)
    return enc.encode_to_numpy(text, allowed_special=special, disallowed_special=())


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of whole-number points (rows, dims), every
    coordinate of ``bits`` bits: the axes-to-transpose steps, for all rows at
    once, then the bits interleaved."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((HASHED, DIMS))


def document_point(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Unit vector of hashed token counts, projected and put on the grid."""
    v = np.bincount((ids.astype(np.int64) * 2654435761 >> 7) % HASHED, minlength=HASHED).astype(float)
    p = (v / np.sqrt(v @ v)) @ matrix if len(ids) else np.zeros(DIMS)
    return ((np.tanh(p) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def tokenized(docs: DataFrame, key: str, text: str, path: str, end_id: int) -> DataFrame:
    """(_row, key, n, curve, ids): every document's ids with the end id, as
    little-endian unsigned 32-bit numbers, and its key on the curve."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        matrix = projection()
        for b in batches:
            ids = [np.append(encode(path, t) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                   for t in b.column(1).to_pylist()]
            if not ids:
                continue
            curve = hilbert_key(np.stack([document_point(x[:-1], matrix) for x in ids]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve, pa.int64()),
                 pa.array([pack_ids(x) for x in ids], pa.binary())], names=["_key", "n", "curve", "ids"])

    got = docs.select(F.col(key).alias("_key"), text).mapInArrow(run, f"_key {kind}, n long, curve long, ids binary")
    return stage(got.withColumn("_row", F.monotonically_increasing_id()), "pack-ids")


def pack_ids(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four; the first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\4" + ids.tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def places(rows: DataFrame) -> DataFrame:
    """(_row, place): tokens before each row of (_row, curve, n) in the order
    of the curve; no task sees more than its range, and the ranges' totals."""
    parts = n_parts(rows.sparkSession)
    dealt = stage(rows.repartitionByRange(parts, "curve", "_row").withColumn("_range", F.spark_partition_id()), "pack-order")
    totals = dealt.groupBy("_range").agg(F.sum("n").alias("_sum"))
    before = totals.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    own = F.sum("n").over(Window.partitionBy("_range").orderBy("curve", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (dealt.withColumn("_own", own - F.col("n")).join(before, "_range")
            .select("_row", (F.col("_before") + F.col("_own")).alias("place")))


def cuts(total: int, length: int) -> np.ndarray:
    """Starts of the last sequences: what is beyond the full ones falls into
    powers of two."""
    at = [total - total % length]
    for b in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> b & 1:
            at.append(at[-1] + (1 << b))
    return np.array(at, dtype=np.int64)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset); ids
    are little-endian unsigned 32-bit numbers."""
    small_batches(docs.sparkSession, 500)
    rows = tokenized(docs, key, text, path, end_id)
    order = places(rows.select("_row", "curve", "n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    tail = cuts(total, length)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            own, start, many, ids, of, seq, off = [], [], [], [], [], [], []
            for i, (g, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                x = unpack_ids(data)
                at = np.arange(g // length * length, g + len(x), length)
                at = np.unique(np.concatenate([at[at <= tail[0]], tail[(tail > g) & (tail < g + len(x))], tail[tail <= g][-1:]]))
                for lo, hi in zip(at, [*at[1:], g + len(x)], strict=True):
                    a, e = max(lo, g), min(hi, g + len(x))
                    if e > a:
                        own.append(i)
                        start.append(a - g)
                        many.append(e - a)
                        ids.append(x[a - g:e - g].tobytes())
                        of.append(len(x))
                        seq.append(lo // length if lo <= tail[0] else tail[0] // length + int(np.searchsorted(tail, lo)))
                        off.append(a - lo)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own, pa.int64())), *[pa.array(np.array(v, np.int64)) for v in (start, many)], pa.array(ids, pa.binary()),
                 *[pa.array(np.array(v, np.int64)) for v in (of, seq, off)]],
                names=["_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    met = rows.select("_row", "_key", "ids").join(order.hint("shuffle_hash"), "_row")
    out = met.select("_key", "place", "ids").mapInArrow(
        run, f"_key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_key", key)
