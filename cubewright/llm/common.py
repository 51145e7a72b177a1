"""Shared pieces of the text operators: scratch tables, word hashing,
connected components.  All state between steps goes through tables in the
shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multiplier of the word hash, and the bytes' random values (from a seed).
BASE = 0x9E3779B97F4A7C15 | 5
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and bytes of an Arrow batch, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write a step's table to the shared folder and read it back: lineage is
    cut, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_slices(col: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of a string or binary
    column, each run up to max_bytes or one longer row.  Null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = col.type in (pa.large_string(), pa.large_binary())
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64 if big else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield at, data[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, i < size (kept for small sizes)."""
    size = 1 << max(16, (n - 1).bit_length() if n > 1 else 0)
    if size not in _POWERS:
        def row(b: int) -> np.ndarray:
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            return np.multiply.accumulate(a)
        got = row(BASE), row(pow(BASE, -1, 2**64))
        if size > 1 << 21:
            return got
        _POWERS[size] = got
    return _POWERS[size]


def gram_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte string data[a:b] follows as
    ``(p[b] - p[a]) * inverse_power[a]``."""
    pw, _ = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * pw[:len(data)], out=p[1:])
    return p


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of rows, A-Z lower-cased: (lower-cased
    bytes, starts, ends, words per row).  Words never cross rows."""
    low = data.copy()
    up = (data >= 65) & (data <= 90)
    low[up] += 32
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
    inside[-1] = False
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    per_row = np.diff(np.searchsorted(starts, off))
    return low, starts, ends, per_row


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words per row."""
    low, starts, ends, per_row = words_of(data, off)
    return span_hashes(gram_prefix(low), starts, ends), per_row


def shingle_hashes(words: np.ndarray, per_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles of rows; a row with fewer words has
    its whole sequence as one shingle, a row without words none."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    first = np.cumsum(per_row) - per_row
    h = np.full(len(words), 0, dtype=np.uint64)
    pos = np.arange(len(words)) - first[row]
    left = per_row[row] - pos
    for i in range(k):
        nxt = np.zeros(len(words), dtype=np.uint64)
        nxt[:max(0, len(words) - i)] = words[i:]
        # places beyond the row's end take a fixed value of their own
        nxt = np.where(left > i, nxt, np.uint64(0x5851F42D4C957F2D) + np.uint64(i))
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + nxt)
    keep = (left >= k) | (pos == 0)
    return h[keep], row[keep]


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (id, component) for every
    vertex of an edge, component being the smallest vertex reachable.

    Large-star and small-star rounds in turn until nothing changes; a round is
    two aggregates and joins, and its edges are a table in the shared folder.
    Ids are whole numbers."""
    spark = edges.sparkSession
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .where("u > v").distinct(), tag)
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select("v", "m").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small, tag)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole groups of rows sorted by whole-number keys: (batch, start
    of every group and the end).  A run has about ``rows`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    n = 0

    def merged() -> pa.RecordBatch:
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(len(b), dtype=bool)
        new[:1] = True
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not len(b):
            continue
        held.append(b)
        n += len(b)
        if n >= rows:
            whole = merged()
            at = starts(whole)
            if len(at) > 1:
                yield whole.slice(0, at[-1]), at
                held = [whole.slice(at[-1])]
            else:
                held = [whole]
            # a large group is looked at again only once it has doubled
            n = len(held[0]) if len(held[0]) < rows else 0 if len(at) > 1 else rows - len(held[0])
    if held:
        whole = merged()
        yield whole, np.append(starts(whole), len(whole))


def roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Least row reachable by pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], label[pairs[:, 0]])
        new = new[new]
        if (new == label).all():
            return label
        label = new
