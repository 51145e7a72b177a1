"""Zip archives on any file system that Spark reads.

* The directory of an archive is read through Hadoop's file system on the
  driver: names, places and check sums, no data.
* The archive's bytes are read by Spark's text source, which splits a file
  among tasks at line feeds and hands on raw bytes.  Blocks of them are staged
  once; their places in the archive are prefix sums of their lengths, so no
  task needs a seek and no node needs a mount.
* A member's blocks meet in one task, in order, and are inflated as a stream
  (a deflate stream has one start): memory holds a block and a chunk of rows.
  Check sum and size are held against the directory.

``write_archives`` is the way back: every archive is written by one task,
through Spark's text sink, as a stream.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir

BLOCK = 1 << 18
MAX_TASKS = 4096
#: Lines handed to a compressor at once.
PACK_LINES = 1000
MEMBER = T.StructType([T.StructField(n, t) for n, t in [
    ("archive", T.StringType()), ("member", T.StringType()), ("base", T.StringType()), ("first", T.LongType()), ("end", T.LongType()),
    ("method", T.IntegerType()), ("packed", T.LongType()), ("size", T.LongType()), ("crc", T.LongType())]])


class _HadoopFile(io.RawIOBase):
    """A file of Hadoop's file system that can be sought and read."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        self._size, self._at = int(fs.getFileStatus(p).getLen()), 0
        self._stream = fs.open(p)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self._size)[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, out) -> int:
        n = max(0, min(len(out), self._size - self._at))
        if n:
            self._stream.seek(self._at)
            out[:n] = self._stream.readNBytes(n)
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def list_members(spark: SparkSession, archives: Sequence[str]) -> list[tuple]:
    """Rows of ``MEMBER`` of all members, by archive and name."""
    rows = []
    for a in archives:
        with zipfile.ZipFile(io.BufferedReader(_HadoopFile(spark, a), 1 << 16)) as z:
            infos = sorted(z.infolist(), key=lambda i: i.header_offset)
            ends = [i.header_offset for i in infos[1:]] + [z.start_dir]
            here = [(a, i.filename, i.filename.rsplit("/", 1)[-1], i.header_offset, e, i.compress_type, i.compress_size, i.file_size, i.CRC)
                    for i, e in zip(infos, ends, strict=True) if not i.is_dir()]
        for r in here:
            if r[5] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{a}: {r[1]} is packed by method {r[5]}")
        rows += sorted(here, key=lambda r: r[1])
    return rows


def path_key(path: str) -> str:
    """One spelling of a path: schemes are followed by one or more slashes."""
    return re.sub(r"^([A-Za-z][\w+.-]*):/*", r"\1:/", unquote(path))


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path_key(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def file_blocks(spark: SparkSession, archives: Sequence[str]) -> DataFrame:
    """(file, place, data): the bytes of files in blocks, and where in the file
    they are.  A file that does not end in a line feed gets one."""
    raw = spark.read.option("lineSep", "\n").text(list(archives)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, number = None, [], 0, 0

        def out():
            data = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([number], pa.int64()),
                                               pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["file", "start", "number", "n", "data"])

        for b in batches:
            for file, start, line in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (file, start) != key:
                    if held:
                        yield out()
                    key, held, size, number = (file, start), [], 0, 0
                held += (line, b"\n")
                size += len(line) + 1
                if size >= BLOCK:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    path = scratch_dir(spark, "archive-blocks")
    raw.mapInArrow(join, "file string, start long, number long, n long, data binary").write.parquet(path)
    staged = spark.read.parquet(path)
    before = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)
    places = staged.select("file", "start", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"))
    return staged.join(places, ["file", "start", "number"]).select("file", "place", "data")


def _inflated(parts: Iterator[bytes], name: str, method: int, packed: int, size: int, crc: int) -> Iterator[bytes]:
    """Bytes of a member from its local header on."""
    head = b""
    parts = iter(parts)
    while len(head) < 30 or len(head) < 30 + (skip := int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")):
        got = next(parts, None)
        if got is None:
            raise ValueError(f"{name}: the archive ends in the member's header")
        head += got
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{name}: no member header where the directory says")
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    left, seen, check = packed, 0, 0
    for part in itertools.chain([head[30 + skip:]], parts):
        part = part[:left]
        left -= len(part)
        while part:
            data = inflate.decompress(part, BLOCK) if inflate else part
            part = inflate.unconsumed_tail if inflate else b""
            seen, check = seen + len(data), zlib.crc32(data, check)
            if data:
                yield data
        if not left:
            break
    if inflate and (data := inflate.flush()):
        seen, check = seen + len(data), zlib.crc32(data, check)
        yield data
    if left or seen != size or check != crc:
        raise ValueError(f"{name}: the member is damaged")


class _Pipe(io.RawIOBase):
    """A stream to read of an iterator of bytes."""

    def __init__(self, parts: Iterator[bytes]):
        self._parts, self._rest = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not len(self._rest):
            got = next(self._parts, None)
            if got is None:
                return 0
            self._rest = memoryview(got)
        n = min(len(out), len(self._rest))
        out[:n] = self._rest[:n]
        self._rest = self._rest[n:]
        return n


def map_members(members: DataFrame, each: Callable, schema: T.StructType | str) -> DataFrame:
    """``each(archive, member, stream of bytes)`` yields pandas frames, in one
    task per member; ``members`` has the columns of ``MEMBER``."""
    spark = members.sparkSession
    rows = [tuple(r) for r in members.select(*MEMBER.names).sort("archive", "member").collect()]  # names and places only
    if not rows:
        return spark.createDataFrame([], schema)
    tasks = min(len(rows), MAX_TASKS)
    archives = sorted({r[0] for r in rows})
    spots: dict[str, list[tuple[int, int, int]]] = {}
    for i, r in enumerate(rows):
        spots.setdefault(_qualified(spark, r[0]), []).append((r[3], r[4], i))
    for v in spots.values():
        v.sort()

    def cut(batches):
        for b in batches:
            out = []
            for file, place, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                here = spots[path_key(file)]
                at = max(0, bisect_right(here, (place, 1 << 62, 0)) - 1)
                while at < len(here) and here[at][0] < place + len(data):
                    lo, hi, i = here[at]
                    piece = data[max(0, lo - place):max(0, hi - place)]
                    if piece:
                        out.append((i % tasks, i, max(place, lo), piece))
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                                 names=["task", "i", "place", "data"])

    def run(batches):
        flat = (r for b in batches for r in zip(b["i"].tolist(), b["data"].tolist(), strict=True))
        for i, group in itertools.groupby(flat, key=lambda r: r[0]):
            archive, member, _, _, _, method, packed, size, crc = rows[i]
            yield from each(archive, member, io.BufferedReader(_Pipe(_inflated((bytes(d) for _, d in group), f"{archive}: {member}", method, packed, size, crc)), BLOCK))

    return (file_blocks(spark, archives).mapInArrow(cut, "task int, i int, place long, data binary")
            .repartitionById(tasks, "task").sortWithinPartitions("i", "place").mapInPandas(run, schema))


# ---------------------------------------------------------------------------
# writing
# ---------------------------------------------------------------------------

class _Sink(io.RawIOBase):
    """Collects what is written; cannot be sought, so sizes follow the data."""

    def __init__(self):
        self.held: list[bytes] = []
        self.size = 0

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        if len(b):  # a compressor mostly has nothing to hand on yet
            self.held.append(bytes(b))
            self.size += len(b)
        return len(b)

    def take(self) -> bytes:
        data = b"".join(self.held)
        self.held.clear()
        self.size = 0
        return data


def write_archives(lines: DataFrame, path: str, archives: int, order: Sequence[str] = ("place",),
                   derive: Callable[[DataFrame], DataFrame] | None = None, head: str = "") -> list[str]:
    """Write (archive int, member, place, line) as the zip archives 0 to
    ``archives`` - 1, lines by their place in a member; returns the archives'
    paths.  The text sink ends a file in a line feed: it is the archive's
    comment.

    Rows of other columns are dealt and sorted (by ``order`` in a member) as they
    are, and ``derive`` makes (member, line) of them; ``head`` is the first line
    of every CSV member."""
    def pack(batches):
        sink = _Sink()
        rest = b""

        def rows(data: bytes):
            *whole, left = data.split(b"\n")
            return left, pa.RecordBatch.from_arrays([pa.array(whole, pa.binary())], names=["value"])

        def runs():
            for b in batches:
                for at in range(0, len(b), PACK_LINES):
                    part = b.slice(at, PACK_LINES)
                    lines = zip(part.column("member").to_pylist(), part.column("line").to_pylist(), strict=True)
                    for member, group in itertools.groupby(lines, key=lambda r: r[0]):
                        yield member, "".join([f"{line}\n" for _, line in group]).encode()

        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            z.comment = b"\n"
            for member, group in itertools.groupby(runs(), key=lambda r: r[0]):
                with z.open(member, "w", force_zip64=True) as out:
                    if head and member.endswith(".csv"):
                        out.write(f"{head}\n".encode())
                    for _, data in group:
                        out.write(data)
                        if sink.size > BLOCK:
                            rest, done = rows(rest + sink.take())
                            yield done
        rest, done = rows(rest + sink.take())
        yield done

    dealt = lines.repartitionById(archives, "archive").sortWithinPartitions("member", *order)
    made = derive(dealt) if derive else dealt
    packed = made.select("member", "line").mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)
    return sorted(lines.sparkSession.read.text(path).inputFiles())
