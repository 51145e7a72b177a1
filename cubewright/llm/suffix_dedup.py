"""Suffix dedup: the bytes of texts that lie in a string of ``length`` bytes
which also starts anywhere else, in the same text or another.

Suffixes are sorted blockwise, one suffix bucket at a time:

1. A cover of samples gives any two equal strings of ``length`` bytes a sample
   at the same distance from their starts.  An arithmetic difference cover has
   one in about every 13 bytes; the one used here is made by content: the
   sample of a string is the leftmost of its ``gram``-byte grams of least hash,
   so equal strings agree, with one sample in about 120 bytes (400 and 160).
   Strings next to each other share theirs: a sample comes with a run of
   strings.
2. Samples whose gram occurs once are dropped: no string there can repeat.
3. The others' gram is the suffix bucket.  A bucket gets the bytes around its
   samples, lined up at the sample, equal ones once.  From right to left in
   steps of ``STEP`` bytes, the places at steps are ranked by a step's bytes
   and the rank of the next such place, so that a long tie costs one look at a
   rank; the same to the left.  These ranks are made within the bucket, not
   beforehand for all samples.  Their order and the common lengths of
   neighbours in it say, for each place before the sample, which rows agree to
   the left and to the right of it, and so which strings occur twice, with no
   comparison of their own.
4. A bucket of more than ``BIG`` rows is not sorted, which one task would have
   to do: its strings are counted by two 64-bit hashes, by a shuffle.

With ``also``, a shorter length, the bytes in repeated strings of that length
are counted too: samples are those of the shorter strings, which the longer
ones begin with, and the same order answers for both lengths.

Repeated spans meet their text again by content.  Texts that occur more than
once are removed whole (from ``length`` bytes on) and sorted once.

Nulls: a null text is empty; null and repeated ids are rows like others, since
all steps go by content.  A text shorter than ``length`` keeps all.  Other
columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_prefix, mix64, n_parts, small_batches, span_hashes, stage, string_slices, whole_groups
from .fingerprints import sliding_min

GRAM, STEP, BIG = 160, 40, 20000
#: A list of contents goes to all executors up to this length, else by a shuffle.
BROADCAST_IDS = 1_000_000
PIECE = 1 << 23


def samples(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(row, first string, strings, sample, hash) of each sample of rows;
    places count from the row's start."""
    at = np.arange(max(0, len(data) - gram + 1))
    if not len(at) or len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    h = span_hashes(gram_prefix(data), at, at + gram)
    low = sliding_min((h & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), length - gram + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(low)]
    ok = np.arange(len(low)) + length <= off[row + 1]
    first = np.flatnonzero(ok)
    pick = (low[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (first[1:] != first[:-1] + 1)
    s = np.flatnonzero(new)
    many = np.diff(np.append(s, len(first)))
    r = row[first[s]]
    return r, first[s] - off[r], many, pick[s] - off[r], h[pick[s]]


def row_samples(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """samples(), with a long row taken in overlapping pieces."""
    if len(off) > 2 or len(data) <= PIECE:
        return samples(data, off, length, gram)
    out = []
    for s in range(0, len(data) - length + 1, PIECE):
        piece = data[s:s + PIECE + length - 1]
        r, a, n, p, h = samples(piece, np.array([0, len(piece)]), length, gram)
        out.append((r, a + s, n, p + s, h))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, cid, first, many, at) of the samples of (cid, text); a task passes
    over texts that it has had."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            new = []
            for i, c in enumerate(b.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            if len(seen) > 500_000:
                seen.clear()
            b = b.take(pa.array(new, pa.int64()))
            for at, data, off in string_slices(b.column(1)):
                r, a, n, p, h = row_samples(data, off, length, gram)
                if len(r):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), b.column(0).take(pa.array(r + at)), *[pa.array(x.astype(np.int32)) for x in (a, n, p)]],
                        names=["h", "cid", "first", "many", "at"])

    return docs.mapInArrow(run, "h long, cid long, first int, many int, at int")


def ranks(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-length rows within groups, and the length each has in
    common with the one before it (-1 at a group's first).  Steps of bytes go
    from right to left; ties of a step are settled by the rank after it."""
    n, width = rows.shape
    rank = np.zeros(n, dtype=np.int64)
    for s in range((width - 1) // STEP * STEP, -1, -STEP):
        step = rows[:, s:s + STEP]
        key = np.zeros((n, step.shape[1] + 9), dtype=np.uint8)
        key[:, :step.shape[1]] = step
        key[:, step.shape[1]:-1] = rank.astype(">i8").view(np.uint8).reshape(n, 8)
        key[:, -1] = 1  # keeps trailing zero bytes in comparisons
        _, rank = np.unique(key.view(f"S{key.shape[1]}").ravel(), return_inverse=True)
        rank = rank.ravel()
    order = np.lexsort((rank, group))
    common = np.full(n, -1, dtype=np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], first, -1)
    return order, common


def repeated(lines: np.ndarray, group: np.ndarray, before: np.ndarray, many: np.ndarray, twice: np.ndarray, have: np.ndarray,
             lengths: tuple[int, ...], left: int) -> list[np.ndarray]:
    """For each length, (rows, left + 1): whether the string that starts x bytes
    before the sample occurs twice.  ``lines`` holds ``left`` bytes before the
    sample and the greatest length from it on, of which ``have`` are the text's
    from the row's first string on; a row has strings from x = before down to
    before - many + 1, and occurs at two places itself where ``twice``."""
    n = len(lines)
    ro, rc = ranks(lines[:, left:], group)
    lo, lc = ranks(np.ascontiguousarray(lines[:, :left][:, ::-1]), group) if left else (np.arange(n), np.zeros(n, np.int64))
    out = [np.zeros((n, left + 1), dtype=bool) for _ in lengths]
    rcls, lcls = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(left + 1):
        here = (x <= before) & (x > before - many)
        if not here.any():
            continue
        lcls[lo] = np.cumsum(lc < x)
        for flags, length in zip(out, lengths, strict=True):
            some = np.flatnonzero(here & (before - x + length <= have))
            if not len(some):
                continue
            rcls[ro] = np.cumsum(rc < length - x)
            key = rcls[some] * (n + 1) + lcls[some]
            o = np.argsort(key, kind="stable")
            k = key[o]
            same = np.zeros(len(k) + 1, dtype=bool)
            same[1:-1] = k[1:] == k[:-1]
            # a row at two places makes its strings repeat, for all that equal them too
            flags[some[o], x] = same[1:] | same[:-1] | twice[some[o]]
    return out


def spans_of(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of flagged places; start and end count
    from the sample."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = flags
    d = np.diff(padded, axis=1)
    row, lo = np.nonzero(d == 1)
    _, hi = np.nonzero(d == -1)
    return row, -(hi - 1), -lo + length


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...], gram: int, big_rows: int) -> tuple[DataFrame, DataFrame]:
    """((cid, which, start, end), (cid, text)): spans of (cid, text) in strings
    of the which-th of ``lengths`` that repeat, and the texts, each once, that
    have samples in common with another."""
    spark = docs.sparkSession
    parts = n_parts(spark)
    length, wide = min(lengths), max(lengths)
    left = length - gram
    all_ = stage(sampled(docs, length, gram), "suffix-samples")
    shared = all_.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > big_rows).alias("big"))
    mine = stage(all_.join(shared, "h").groupBy("cid").agg(F.collect_set(F.struct("first", "many", "at", "h", "big")).alias("s")), "suffix-shared")
    some = mine.count()
    ids = mine.select("cid")
    side = F.broadcast(ids) if some <= BROADCAST_IDS else ids
    texts = stage(docs.join(side, "cid", "left_semi").groupBy("cid").agg(F.first("text").alias("text")), "suffix-texts")

    def around(s: dict, data: bytes) -> tuple[bytes, int, int]:
        """Bytes around a sample, the place of the sample in them, their hash
        (with that of the strings, which the text's end may keep from following)."""
        x = s["at"] - s["first"]
        seg = data[s["first"]:s["first"] + s["many"] - 1 + wide]
        sid = int.from_bytes(hashlib.blake2b(seg + x.to_bytes(4, "little") + s["many"].to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
        return seg, x, sid

    def cut(batches):
        sent: set[tuple] = set()
        for b in batches:
            out: list[tuple] = []
            for cid, text, ss in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = text.encode()
                for s in ss:
                    if s["big"]:
                        continue
                    seg, x, sid = around(s, data)
                    if len(sent) > 100_000:
                        sent.clear()
                    known = (s["h"], sid) in sent  # this task has sent its bytes
                    sent.add((s["h"], sid))
                    out.append((s["h"], sid, known, cid, s["at"], x, s["many"], len(seg), None if known else seg))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["h", "sid", "known", "cid", "at", "x", "many", "have", "seg"])

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    work = texts.join(mine, "cid").select("cid", "text", "s")
    pieces = (work.mapInArrow(cut, "h long, sid long, known boolean, cid long, at int, x int, many int, have int, seg binary")
              .repartition(parts, "h").sortWithinPartitions("h", "sid", "known"))

    def bucket(batches):
        again: list[tuple] = []
        for b, _ in whole_groups(distinct(batches, again), ["h"], 6000):
            h, x, many, have, seg = *(b.column(c).to_numpy() for c in ("h", "x", "many", "have")), b.column("seg").to_pylist()
            cid, at, twice = b.column("cid").to_numpy(), b.column("at").to_numpy().astype(np.int64), b.column("twice").to_numpy(zero_copy_only=False)
            lines = np.zeros((len(h), left + wide), dtype=np.uint8)
            for i, s in enumerate(seg):
                lines[i, left - x[i]:left - x[i] + len(s)] = np.frombuffer(s, np.uint8)
            group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
            for which, flags in enumerate(repeated(lines, group, x, many, twice, have, lengths, left)):
                row, lo, hi = spans_of(flags, lengths[which])
                yield spans(cid[row], np.full(len(row), which), at[row] + lo, at[row] + hi)
            if again:
                yield spans(*map(np.array, zip(*again, strict=True)))
                again.clear()
        if again:
            yield spans(*map(np.array, zip(*again, strict=True)))

    def spans(cid, which, start, end):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cid, which, start, end)], names=["cid", "which", "start", "end"])

    def told(cid, first, many, have):
        """Spans of a row whose strings all repeat."""
        for which, n in enumerate(lengths):
            last = min(many - 1, have - n)
            if last >= 0:
                yield cid, which, first, first + last + n

    def distinct(batches, again):
        """Rows of equal (h, sid) as one; all strings of the others repeat, so
        their spans go to ``again``."""
        held = None  # the open row
        for b in batches:
            out = []
            for h, sid, _, cid, at, x, many, have, seg in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0] == h and held[1] == sid:
                    held[8] = True
                    again.extend(told(cid, at - x, many, have))
                    continue
                if held:
                    out.append(held)
                held = [h, sid, cid, at, x, many, have, seg, False]
            if out:
                yield rows_of(out)
        if held:
            yield rows_of([held])

    def rows_of(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                          names=["h", "sid", "cid", "at", "x", "many", "have", "seg", "twice"])

    found = pieces.mapInArrow(bucket, "cid long, which long, start long, end long")
    if shared.where("big").isEmpty():
        return found, texts

    # large buckets: equal surroundings first, then the strings of one of each
    def surroundings(batches):
        for b in batches:
            out = []
            for cid, text, ss in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = text.encode()
                for s in ss:
                    if s["big"]:
                        seg, _, sid = around(s, data)
                        out.append((s["h"], sid, cid, s["first"], s["many"], len(seg)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["h", "sid", "cid", "first", "many", "have"])

    def strings(batches):
        for b in batches:
            for cid, text, ss in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                prefix = gram_prefix(data)
                at = np.concatenate([np.arange(s["first"], s["first"] + s["many"]) for s in ss])
                twice = np.repeat([s["twice"] for s in ss], [s["many"] for s in ss])
                for which, n in enumerate(lengths):
                    fits = at + n <= len(data)
                    a = span_hashes(prefix, at[fits], at[fits] + n)
                    mid = mix64(span_hashes(prefix, at[fits], at[fits] + n // 2) + np.uint64(7))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(mid.view(np.int64)), pa.array(np.full(len(a), cid)), pa.array(np.full(len(a), which)), pa.array(at[fits]), pa.array(twice[fits])],
                        names=["a", "b", "cid", "which", "start", "twice"])

    near = stage(work.where(F.exists("s", lambda s: s["big"])).mapInArrow(surroundings, "h long, sid long, cid long, first long, many long, have long"), "suffix-around")
    one = stage(near.groupBy("h", "sid").agg((F.count("*") > 1).alias("twice"), F.min(F.struct("cid", "first", "many")).alias("r")), "suffix-one")
    length_of = F.element_at(F.array(*[F.lit(n) for n in lengths]), (F.col("which") + 1).cast("int"))
    last = F.least(F.col("many") - 1, F.col("have") - length_of)
    whole = (near.join(one.where("twice"), ["h", "sid"]).select("cid", "first", "many", "have", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(lengths) - 1).cast("long"))).alias("which"))
             .where(last >= 0).select("cid", "which", F.col("first").alias("start"), (F.col("first") + last + length_of).alias("end")))
    of_cid = one.groupBy(F.col("r.cid").alias("cid")).agg(F.collect_list(F.struct("r.first", "r.many", "twice")).alias("s"))
    big = texts.join(of_cid, "cid").select("cid", "text", "s").mapInArrow(strings, "a long, b long, cid long, which long, start long, twice boolean")
    counted = big.groupBy("which", "a", "b").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("which", "a", "b")
    of_big = big.join(counted, ["which", "a", "b"]).select("cid", "which", "start", (F.col("start") + length_of).alias("end"))
    return found.unionByName(whole).unionByName(of_big), texts


def union_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) covered by intervals; those that touch are one."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return np.stack([s[first], e[np.append(first[1:], len(s)) - 1]], axis=1)


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    at, out = 0, []
    for s, e in runs.tolist():
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def kept_text(data: bytes, runs: np.ndarray) -> str:
    """Like kept_bytes, but no character is cut: a run loses its broken ends."""
    at, out = 0, []
    for s, e in runs.tolist():
        while s < e and s < len(data) and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]]).decode()


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = 400, gram: int = GRAM,
          texts: bool = False, big_rows: int = BIG, also: int | None = None) -> DataFrame:
    """The columns of ``keep`` of every row, n_bytes, n_removed, n_spans and
    kept_sha256, and with ``texts`` kept_text, what is left in whole
    characters; with ``also``, n_repeated and n_repeats: the bytes and runs in
    repeated strings of that shorter length, which stay."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    t = F.coalesce(F.col(text), F.lit(""))
    of_text = docs.select(F.xxhash64(t).alias("cid"), t.alias("text"))
    lengths = (length,) if also is None else (length, also)
    if also is not None and also >= length:
        raise ValueError("also is a shorter length")
    spans, some = repeated_spans(of_text, lengths, min(gram, *lengths), big_rows)
    runs = spans.groupBy("cid").agg(F.collect_list(F.struct("which", "start", "end")).alias("runs"))

    def finish(batches):
        for b in batches:
            out = []
            for cid, x, r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                of = [union_of(np.array([i["start"] for i in r if i["which"] == w], np.int64), np.array([i["end"] for i in r if i["which"] == w], np.int64))
                      for w in range(2)]
                got = of[0]
                data = x.encode()
                out.append((cid, int((got[:, 1] - got[:, 0]).sum()), len(got), hashlib.sha256(kept_bytes(data, got)).hexdigest(),
                            kept_text(data, got) if texts else None, int((of[1][:, 1] - of[1][:, 0]).sum()), len(of[1])))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2, strict=True)],
                    names=["cid", "n_removed", "n_spans", "kept", "left", "n_repeated", "n_repeats"])

    changed = stage(some.join(runs, "cid").select("cid", "text", "runs").mapInArrow(
        finish, "cid long, n_removed long, n_spans long, kept string, left string, n_repeated long, n_repeats long"), "suffix-changed")
    rows = docs.select(*keep, *([t.alias("_text")] if texts else []), F.xxhash64(t).alias("_cid"), F.octet_length(t).cast("long").alias("_bytes"), F.sha2(t, 256).alias("_sha"))
    if not texts:
        rows = stage(rows, "suffix-rows")
    copies = ((rows if not texts else stage(rows.select("_cid", "_bytes"), "suffix-ids")).where(F.col("_bytes") >= min(lengths))
              .groupBy("_cid").agg(F.count("*").alias("n")).where("n > 1"))
    gone = copies.select(F.col("_cid").alias("cid"), F.lit(True).alias("gone"))
    told = gone.join(changed, "cid", "full").select(F.col("cid").alias("_cid"), F.coalesce("gone", F.lit(False)).alias("_gone"),
                                                    *[F.col(c).alias(f"_{c}") for c in ("n_removed", "n_spans", "kept", "left", "n_repeated", "n_repeats")])
    told = stage(told, "suffix-told")
    ids = told.select("_cid")
    small = told.count() <= BROADCAST_IDS
    side = F.broadcast(ids) if small else ids
    # texts that keep all their bytes are not moved, while the others' list is short
    met = (rows.join(side, "_cid", "left_semi") if small else rows).join(told, "_cid", "inner" if small else "left")
    again = F.coalesce("_gone", F.lit(False))
    whole = again & (F.col("_bytes") >= length)
    zero = F.lit(0).cast("long")

    def number(name, copied, otherwise):
        return F.when(copied, otherwise).otherwise(F.coalesce(name, zero)).cast("long")

    def columns(removed, spans, sha, left, repeated, repeats):
        return [*keep, F.col("_bytes").alias("n_bytes"), removed.alias("n_removed"), spans.alias("n_spans"), sha.alias("kept_sha256"),
                *([left.alias("kept_text")] if texts else []), *([repeated.alias("n_repeated"), repeats.alias("n_repeats")] if also is not None else [])]

    out = met.select(*columns(
        number("_n_removed", whole, F.col("_bytes")), number("_n_spans", whole, F.lit(1)),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept", "_sha")),
        F.when(whole, F.lit("")).otherwise(F.coalesce("_left", "_text")) if texts else None,
        number("_n_repeated", again, F.col("_bytes")), number("_n_repeats", again, F.lit(1))))
    if not small:
        return out
    return out.unionByName(rows.join(side, "_cid", "left_anti").select(*columns(zero, zero, F.col("_sha"), F.col("_text") if texts else None, zero, zero)))
