"""Source divergence audit: how far the word use of every source of a language
is from each other source of it, and which terms it uses more than its language.

1. Tasks tally terms by (language, source) in bounded dictionaries; one partial
   aggregate gives every term's count and documents.
2. A language keeps the terms of at least ``min_docs`` of its documents.  They
   are dealt to chunks of about ``CHUNK`` by a hash and numbered within.
3. A group's terms in a chunk are one sorted array of (term id, count).  A pair
   task is one unordered pair of groups in one chunk: a galloping search finds
   the ids of the shorter array in the longer, and overlaps, terms of one side,
   terms of the other and terms of neither are each priced against the other
   group.  Pairs are dealt in blocks of ``SIDE`` groups a side, so that an array
   moves once per block and not once per pair.  Sums over chunks are exact
   integers, and hold for both directions.

Prices are ``1 + floor(SCALE * (count + 5) / (N + 5 V))`` by long division in
64 bits, exact while N + 5 V is below 9.2e15.

Nulls: null text, language and source are ''.  A group without terms, or in a
language that keeps none, has its rows all the same (counts of zero, or value
0 for V = 0).  Repeated rows are documents of their own; ids are not read.  A
language of one source has no ``pair`` rows.  Further columns are ignored; no
documents, no rows."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, small_batches, stage, whole_groups

MIN_DOCS, SCALE, MOST = 30, 1_000_000_000, 50
CHUNK, SIDE = 16384, 16
#: Distinct terms that a task holds; a longer text is tallied in rounds.
HELD, LONG = 400_000, 1 << 23
#: A table goes to all executors up to this many rows, else by a shuffle.
BROADCAST_ROWS = 200_000

#: A-Z lower-cased; bytes of no term are blanks.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _pieces(text: bytes):
    """A long text in runs of whole terms."""
    low, at = text.translate(_TERM), 0
    while at < len(low):
        end = low.find(b" ", at + LONG)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def tally(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of every term."""
    def run(batches):
        count: dict[tuple, Counter] = {}
        having: dict[tuple, Counter] = {}

        def flush():
            for (lang, source), c in count.items():
                d = having[lang, source]
                ts = list(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(ts), pa.string()), pa.array([source] * len(ts), pa.string()), pa.array(ts, pa.binary()).cast(pa.string()),
                     pa.array([c[t] for t in ts], pa.int64()), pa.array([d[t] for t in ts], pa.int64())], names=["lang", "source", "term", "n", "d"])
            count.clear()
            having.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                key = lang, source
                if len(text) <= LONG:
                    found = terms(text)
                    count.setdefault(key, Counter()).update(found)
                    having.setdefault(key, Counter()).update(set(found))
                else:
                    rounds = -(-len(text) // LONG)
                    for r in range(rounds):
                        yield from flush()
                        mine: Counter = Counter()
                        for piece in _pieces(text):
                            mine.update(t for t in piece if hash(t) % rounds == r)
                        count[key], having[key] = mine, Counter(mine.keys())
                    yield from flush()
            if sum(map(len, count.values())) > HELD:
                yield from flush()
        yield from flush()

    part = docs.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def price(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 kept)), exact."""
    den = total + 5 * kept
    rest, out = np.asarray(count, dtype=np.int64) + 5, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // den
        rest = rest % den
    return out + 1


def price_column(count: Column, total: Column, kept: Column) -> Column:
    """The same as an expression."""
    div = lambda a, b: F.call_function("div", a, b)
    den = (total + 5 * kept).cast("long")
    rest, out = (count + 5).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + div(rest, den)
        rest = rest % den
    return out + 1


def gallop(large: np.ndarray, small: np.ndarray, span: int) -> np.ndarray:
    """Place of the first value of sorted ``large`` that is not below each of
    ``small`` (values in 0..span-1).  Every search starts where the value would
    be if large were even, doubles its steps until it is past the value, and
    halves the bracket that is left."""
    n = len(large)
    if not n or not len(small):
        return np.zeros(len(small), dtype=np.int64)
    lo = np.minimum(small * n // span, n - 1)
    hi = lo.copy()
    step, open_ = 1, np.flatnonzero(large[lo] >= small)
    lo[open_] -= 1  # large[lo] < small at the end, or lo = -1
    while len(open_ := open_[(lo[open_] >= 0)]) and len(open_ := open_[large[lo[open_]] >= small[open_]]):
        hi[open_] = lo[open_]
        lo[open_] = np.maximum(lo[open_] - step, -1)
        step *= 2
    step, open_ = 1, np.flatnonzero(large[hi] < small)
    while len(open_):
        lo[open_] = hi[open_]
        hi[open_] = np.minimum(hi[open_] + step, n)
        step *= 2
        open_ = open_[hi[open_] < n]
        open_ = open_[large[hi[open_]] < small[open_]]
    while len(wide := np.flatnonzero(hi - lo > 1)):
        mid = (lo[wide] + hi[wide]) // 2
        below = large[mid] < small[wide]
        lo[wide[below]] = mid[below]
        hi[wide[~below]] = mid[~below]
    return hi


def merge(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], span: int) -> int:
    """Sum of |p - q| over the ``span`` terms of a chunk, of two groups' (sorted
    ids, prices, price of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = gallop(b[0], a[0], span)
    both = at < len(b[0])
    both[both] = b[0][at[both]] == a[0][both]
    hit = at[both]
    only = np.ones(len(b[0]), dtype=bool)
    only[hit] = False
    absent = span - len(a[0]) - len(b[0]) + len(hit)
    return int(np.abs(a[1][both] - b[1][hit]).sum() + np.abs(a[1][~both] - b[2]).sum()
               + np.abs(b[1][only] - a[2]).sum()) + absent * abs(a[2] - b[2])


def _sized(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def vocabulary(counted: DataFrame, min_docs: int, chunk: int = CHUNK) -> DataFrame:
    """(lang, term, chunk, id, total, lang_total, kept) of the kept terms."""
    some = stage(counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d"), "audit-some")
    sizes = some.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    dealt = some.join(_sized(sizes), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / chunk)).cast("int"))
    place = Window.partitionBy("lang", "chunk").orderBy("term")
    return stage(dealt.withColumn("id", F.row_number().over(place) - 1), "audit-kept")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, most: int = MOST,
          chunk: int = CHUNK, side: int = SIDE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = stage(tally(d), "audit-terms")
    kept = vocabulary(counted, min_docs, chunk)
    mine = stage(counted.select("lang", "source", "term", "n").join(_sized(kept), ["lang", "term"]), "audit-mine")

    of_lang = kept.groupBy("lang").agg(F.first("kept").alias("kept"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = stage(d.select("lang", "source").distinct()
                   .join(mine.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
                   .join(_sized(of_lang), "lang", "left")
                   .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
                           (F.row_number().over(order) - 1).alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("groups")), "audit-groups")

    # terms that a group uses more than its language
    p = price_column(F.col("n"), F.col("g.total"), F.col("g.kept"))
    q = price_column(F.col("m.total"), F.col("lang_total"), F.col("m.kept"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (mine.alias("m").join(_sized(groups.select("lang", "source", "total", "kept")).alias("g"), ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    # every group's sorted array in every chunk of its language
    arrays = (mine.groupBy("lang", "chunk", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("a"))
              .select("lang", "chunk", "source", F.col("a.id").alias("ids"), F.col("a.n").alias("counts")))
    spans = kept.groupBy("lang", "chunk").agg(F.count("*").alias("span"))
    blocks = F.ceil(F.col("groups") / side).cast("int")
    own = F.floor(F.col("place") / side).cast("int")
    spread = (groups.join(_sized(spans), "lang").join(arrays, ["lang", "chunk", "source"], "left")
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("lang", "chunk", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"), "place", "source", "total", "kept", "span", "ids", "counts")
              .repartition(n_parts(spark), "lang", "chunk", "lo", "hi").sortWithinPartitions("lang", "chunk", "lo", "hi", "place"))

    def pairs(batches):
        for b, cuts in whole_groups(batches, ["lang", "chunk", "lo", "hi"], 2 * side):
            out: list[tuple] = []
            col = {c: b.column(c).to_pylist() for c in ("lang", "source", "total", "kept", "span", "lo", "hi", "place")}
            ids, counts = b.column("ids"), b.column("counts")
            for begin, end in itertools.pairwise(cuts.tolist()):
                mine = []
                for i in range(begin, end):
                    x = np.array(ids[i].values if ids[i].is_valid else [], dtype=np.int64)
                    n = np.array(counts[i].values if counts[i].is_valid else [], dtype=np.int64)
                    mine.append((x, price(n, col["total"][i], col["kept"][i]), int(price(np.zeros(1, np.int64), col["total"][i], col["kept"][i])[0])))
                apart = col["lo"][begin] != col["hi"][begin]
                for i, j in itertools.combinations(range(begin, end), 2):
                    if apart and col["place"][i] // side == col["place"][j] // side:
                        continue
                    out.append((col["lang"][i], col["source"][i], col["source"][j], merge(mine[i - begin], mine[j - begin], col["span"][i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), [pa.string()] * 3 + [pa.int64()], strict=True)],
                                                 names=["lang", "a", "b", "value"])

    found = stage(spread.mapInArrow(pairs, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    none = groups.where("kept = 0").select("lang", "source")
    zero = none.alias("x").join(none.alias("y"), "lang").where("x.source <> y.source").select(
        "lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.lit(0).cast("long").alias("value"))
    both = (found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
            .select("lang", "s.source", "s.item", "value").unionByName(zero))
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked.unionByName(over)
