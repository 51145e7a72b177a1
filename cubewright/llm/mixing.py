"""Mixing sources to target weights by entropy balancing (DataFrame only).

Every source has a token target.  Document rates r = min(cap, exp(lam * x)),
x being the document's size over its source's token-weighted mean size, are
the entropy-closest rates to 1 that meet the target; lam solves the convex
dual, one Newton root per source, all sources at once.  The iterations run on
the histogram (source, size, documents), not on the documents, so a source
with a third of all rows is a few thousand rows.

Rates become whole copies: within a source, from the largest size down, the
cumulative rate is rounded; the words taken miss the target by half of the gaps
between neighbouring sizes at most, so by less than half the largest document.  Which of
the equal documents get the copy more is decided by a hash of the key, in
salted groups of about ``GROUP`` rows.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; null keys are rows like others.  Repeated rows each take their share.
Documents of size 0 take nothing and get rate 1.  An empty table gives an
empty result.  Columns beyond the named ones are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 8192
MILLION = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, factor: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): sources in
    order weigh ``weights`` in turn and share factor * all; a target stops at
    cap * its source, the excess is reshared by weight.  The common level is
    found by filling sources in the order of their cap over weight."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_i", F.row_number().over(by_code) - 1)
    turn = F.array(*[F.lit(float(x)) for x in weights])
    w = (w.withColumn("_w", F.element_at(turn, (F.col("_i") % len(weights) + 1).cast("int")))
         .withColumn("_cap", F.lit(cap) * F.col("source_size")))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = (w.withColumn("_total", F.lit(factor) * F.sum("source_size").over(everything))
         .withColumn("_full", F.sum("_cap").over(everything) - F.sum("_cap").over(rest))
         .withColumn("_level", (F.col("_total") - F.col("_full")) / F.sum("_w").over(rest))
         .withColumn("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))))
    level = F.max("_level").over(everything)  # it is highest where filling stops
    return w.select("source", "source_size",
                    F.least("_cap", F.coalesce(F.col("_w") * level, F.col("_cap"))).alias("target"))


def solve_dual(hist: DataFrame, targets: DataFrame, cap: float, rounds: int = 60, tol: float = 1e-10) -> DataFrame:
    """(source, lam, mean) from the histogram (source, size, m): safeguarded
    Newton steps on sum(m * x * min(cap, exp(lam * x))) = target / mean."""
    import math
    moments = hist.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("s1"),
                                         F.sum((F.col("m") * F.col("size")).cast("double") * F.col("size")).alias("s2"),
                                         F.min("size").alias("least"))
    start = (moments.join(targets, moments["source"].eqNullSafe(targets["source"])).drop(targets["source"])
             .withColumn("mean", F.col("s2") / F.col("s1"))
             .withColumn("t", F.col("target") / F.col("mean"))
             .withColumn("x0", F.col("least") / F.col("mean"))
             .withColumn("hi", F.lit(math.log(cap)) / F.col("x0"))
             .withColumn("lo", F.least(F.lit(0.0), F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("s1")) / F.col("x0")))
             .withColumn("done", F.col("target") >= cap * F.col("s1") * (1 - 1e-12))
             .withColumn("lam", F.when(F.col("done"), F.col("hi")).otherwise(F.lit(0.0)))
             .select("source", "mean", "t", "lo", "hi", "lam", "done"))
    state = stage(start, "mix-state")
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            break
        h, s = hist.alias("h"), state.where("not done").alias("s")
        x = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        got = (h.join(s, F.col("h.source").eqNullSafe(F.col("s.source")))
               .groupBy("s.source").agg(F.sum(F.col("m") * x * F.least(F.lit(cap), e)).alias("g"),
                                        F.sum(F.when(e < cap, F.col("m") * x * x * e).otherwise(0.0)).alias("d")))
        a, b = state.alias("a"), got.alias("b")
        gap = F.col("g") - F.col("t")
        step = F.col("lam") - gap / F.col("d")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        ok = (F.col("d") > 0) & (step > lo) & (step < hi)
        near = F.abs(gap) <= tol * F.col("t")
        new = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
            F.col("a.source").alias("source"), "mean", "t",
            F.coalesce(F.when(F.col("done"), F.col("lo")).otherwise(lo), F.col("lo")).alias("lo"),
            F.coalesce(F.when(F.col("done"), F.col("hi")).otherwise(hi), F.col("hi")).alias("hi"),
            F.when(F.col("done") | near, F.col("lam")).when(ok, step).otherwise((lo + hi) / 2).alias("lam"),
            (F.col("done") | F.coalesce(near | (hi - lo < 1e-13), F.lit(True))).alias("done"))
        state = stage(new, "mix-state")
    return state.select("source", "lam", "mean")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        factor: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """Rows (key, source, size, source_size, target, rate, copies, taken), one
    per document; copies is the number of times the mix repeats it."""
    d = stage(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"),
                          n_words(F.col(text)).alias("size")), "mix-sizes")
    hist = stage(d.groupBy("source", "size").agg(F.count("*").alias("m")), "mix-hist")
    targets = stage(source_targets(
        hist.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size")),
        factor, weights, cap), "mix-targets")
    lam = solve_dual(hist.where("size > 0"), targets.where("source_size > 0"), cap)
    t = targets.alias("t").join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select(
        F.col("t.source").alias("source"), "source_size", "target", "lam", "mean")
    rate = F.when(F.col("lam").isNull() | (F.col("size") == 0), F.lit(1.0)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    rates = stage(hist.alias("h").join(t.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select(
        F.col("h.source").alias("source"), "size", "m", "source_size", "target",
        F.round(rate * MILLION).cast("long").alias("ppm"),
        F.ceil(F.col("m") / GROUP).cast("int").alias("salts")), "mix-rates")
    a, b = d.alias("a"), rates.alias("b")
    h = F.xxhash64(F.lit("copies"), F.col("a._key"))
    rows = stage(a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select(
        "_key", F.col("a.source").alias("source"), F.col("a.size").alias("size"), "source_size", "target", "ppm",
        h.alias("_h"), F.pmod(F.shiftright(h, 20), F.col("salts")).alias("_salt")), "mix-rows")
    groups = rows.groupBy("source", "size", "_salt").agg(F.count("*").alias("m"), F.first("ppm").alias("ppm"))
    run = Window.partitionBy("source").orderBy(F.desc("size"), "_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("m") * (F.col("ppm") % MILLION)
    upto = F.sum(part).over(run)
    half = MILLION // 2
    more = groups.select("source", "size", "_salt", (F.floor((upto + half) / MILLION)
                                                    - F.floor((upto - part + half) / MILLION)).alias("_more"))
    place = F.row_number().over(Window.partitionBy("source", "size", "_salt").orderBy("_h", "_key"))
    r, g = rows.withColumn("_place", place).alias("r"), more.alias("g")
    copies = (F.floor(F.col("ppm") / MILLION) + (F.col("_place") <= F.col("_more")).cast("long")).cast("long")
    return r.join(g, F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.size") == F.col("g.size"))
                  & (F.col("r._salt") == F.col("g._salt"))).select(
        F.col("_key").alias(key), F.col("r.source").alias(source if source != key else "source"),
        F.col("r.size").alias("size"), "source_size", "target", (F.col("ppm") / MILLION).alias("rate"),
        copies.alias("copies"), (copies * F.col("r.size")).alias("taken"))
