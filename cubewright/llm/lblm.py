"""Language-model scoring with a log-bilinear neural model.

Every word belongs to a class: the ``TOP`` most frequent words and the end
have one each, other words one of ``RARE`` by their last two bytes.  The model
predicts a word's class from the two before it: the context's vector is the
sum of their vectors, each through a matrix of its place, and a class's score
is its product with the class's vector plus a bias.  It is trained in numpy by
noise-contrastive estimation against the classes' frequencies, on the counts
of all class triples of the training texts: partitions run their own steps
from the epoch's parameters, whose mean (weighted by tokens) begins the next
epoch.  Batched matrix products over all pairs of context classes give the
exact normaliser of each context, so class probabilities sum to one.  Within a
class, a known word has its share of the class's count; the one unknown event
of a class has the share of its words seen once (Good-Turing).

Word counts are joined by 64-bit word hash: those of the ``FREQUENT`` most
frequent words as an array of that fixed size, the others by a shuffle.

Nulls: a null text is empty, its only token is the end; a null key counts as
the empty text for the fold.  Repeated rows are scored (and learned) each.
Without training texts base and score follow from c = 0, V = 0 and N = 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gram_prefix, n_parts, small_batches, span_hashes, stage, string_slices, words_of

TOP, RARE, DIM, EPOCHS, FREQUENT = 511, 64, 32, 4, 1 << 18
#: Counts are given to a training step in parts of at most so many tokens.
STEP_WEIGHT, NOISE, BATCH, RATE = 64, 128, 4096, 0.15
CLASSES = TOP + RARE + 1
END = CLASSES - 1
FLUSH = 2_000_000


def fold(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, rare class, words per row) of the words of rows."""
    low, start, end, per_row = words_of(data, off)
    h = span_hashes(gram_prefix(low), start, end).view(np.int64)
    if not len(start):
        return h, np.zeros(0, np.int64), per_row
    last = low[end - 1].astype(np.int64)
    second = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return h, TOP + (last * 31 + second * 131) % RARE, per_row


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)


def tally(batches, of_slice):
    """Counts of the whole-number keys that of_slice gives, kept up to a bound."""
    parts, held = [], 0
    for b in batches:
        for at, data, off in string_slices(b.column(b.num_columns - 1)):
            got = of_slice(b, at, data, off)
            if len(got):
                u, n = np.unique(got, return_counts=True)
                parts.append((u, n))
                held += len(u)
            if held > FLUSH:
                u, n = merge_counts(parts)
                parts, held = [(u, n)], len(u)
                if held > FLUSH // 2:
                    yield u, n
                    parts, held = [], 0
    if parts:
        yield merge_counts(parts)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, rc, c): hash, rare class and count of every word of a text column."""
    def run(batches):
        rare: list[tuple[np.ndarray, np.ndarray]] = []

        def of_slice(b, at, data, off):
            h, rc, _ = hashed_words(data, off)
            if len(h):
                u, i = np.unique(h, return_index=True)
                rare.append((u, rc[i]))
            return h

        for u, n in tally(batches, of_slice):
            k, first = np.unique(np.concatenate([r[0] for r in rare]), return_index=True)
            rc = np.concatenate([r[1] for r in rare])[first][np.searchsorted(k, u)]
            rare = []
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(rc.astype(np.int32)), pa.array(n)], names=["h", "rc", "c"])

    return train.mapInArrow(run, "h long, rc int, c long").groupBy("h").agg(F.first("rc").alias("rc"), F.sum("c").alias("c"))


def classes_of(h: np.ndarray, rc: np.ndarray, top: np.ndarray, top_class: np.ndarray) -> np.ndarray:
    if not len(top):
        return rc
    i = np.minimum(np.searchsorted(top, h), len(top) - 1)
    return np.where(top[i] == h, top_class[i], rc)


def with_ends(cls: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of rows, each row's end added: (class before the last, last
    class, class, row); the end also stands before a text."""
    ends = np.cumsum(per_row + 1) - 1
    out = np.full(len(cls) + len(per_row), END, dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = cls
    one = np.concatenate([[END], out[:-1]])[:len(out)]
    two = np.concatenate([[END, END], out[:-2]])[:len(out)]
    two[ends + 1 - per_row - 1] = END  # what stands before a text is its neighbour's end alone
    row = np.repeat(np.arange(len(per_row)), per_row + 1)
    return two, one, out, row


def triples(train: DataFrame, top: np.ndarray, top_class: np.ndarray) -> DataFrame:
    """(code, n): counts of (class, class, class)."""
    def of_slice(b, at, data, off):
        h, rc, per_row = hashed_words(data, off)
        two, one, w, _ = with_ends(classes_of(h, rc, top, top_class), per_row)
        return (two * CLASSES + one) * CLASSES + w

    def run(batches):
        for u, n in tally(batches, of_slice):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["code", "n"])

    return train.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Model:
    """Parameters of the log-bilinear model and its noise-contrastive steps."""

    def __init__(self, frequency: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.noise = (frequency + 0.5) / (frequency + 0.5).sum()
        self.p = {"ctx": rng.normal(0, 0.1, (CLASSES, DIM)), "out": rng.normal(0, 0.1, (CLASSES, DIM)), "m1": np.eye(DIM) * 0.8,
                  "m2": np.eye(DIM) * 0.4, "bias": np.log(self.noise)}

    def blob(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.p.values()]).tobytes()

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).copy()
            at += v.size

    def context(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.p["ctx"][one] @ self.p["m1"] + self.p["ctx"][two] @ self.p["m2"]

    def step(self, two, one, w, weight, rng, state: dict, rate: float) -> None:
        """One step on a batch of weighted triples; its noise is shared."""
        p = self.p
        r1, r2 = p["ctx"][one], p["ctx"][two]
        q = r1 @ p["m1"] + r2 @ p["m2"]
        drawn = rng.choice(CLASSES, NOISE, p=self.noise)
        logk = np.log(NOISE)
        s = (q * p["out"][w]).sum(1) + p["bias"][w] - logk - np.log(self.noise[w])
        sn = q @ p["out"][drawn].T + p["bias"][drawn] - logk - np.log(self.noise[drawn])
        scale = weight / weight.sum()
        good = scale / (1 + np.exp(np.clip(s, -30, 30)))          # pulls the data up
        bad = -scale[:, None] / (1 + np.exp(np.clip(-sn, -30, 30)))  # pushes the noise down
        dq = good[:, None] * p["out"][w] + bad @ p["out"][drawn]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        for idx, val in ((w, good[:, None] * q), (drawn, bad.T @ q)):
            add_rows(grad["out"], idx, val)
        grad["bias"] += np.bincount(w, good, CLASSES) + np.bincount(drawn, bad.sum(0), CLASSES)
        grad["m1"] += r1.T @ dq
        grad["m2"] += r2.T @ dq
        add_rows(grad["ctx"], one, dq @ p["m1"].T)
        add_rows(grad["ctx"], two, dq @ p["m2"].T)
        for k, g in grad.items():
            state[k] = state.get(k, 1e-8) + g * g
            p[k] = p[k] + rate * g / np.sqrt(state[k])

    def normalisers(self) -> np.ndarray:
        """log of the sum over classes, of every (class before, last class)."""
        a, b = self.p["ctx"] @ self.p["m2"], self.p["ctx"] @ self.p["m1"]
        out = np.empty((CLASSES, CLASSES))
        for i in range(CLASSES):
            s = (a[i] + b) @ self.p["out"].T + self.p["bias"]
            top = s.max(axis=1)
            out[i] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out


def add_rows(to: np.ndarray, idx: np.ndarray, val: np.ndarray) -> None:
    """to[idx] += val with repeats, by sorted runs."""
    o = np.argsort(idx, kind="stable")
    u, first = np.unique(idx[o], return_index=True)
    to[u] += np.add.reduceat(val[o], first, axis=0)


def train_model(counts: DataFrame, frequency: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Epochs over all triples; between them, a mean of the partitions'
    parameters, first in groups of tasks, then over the groups."""
    model = Model(frequency)
    spark = counts.sparkSession
    parts = n_parts(spark)
    rows = stage(counts.repartition(parts, "code").sortWithinPartitions(F.xxhash64("code")), "lm-triples")
    size = len(model.blob()) // 8

    def mean(batches):
        total, weight = np.zeros(size), 0.0
        for b in batches:
            for w, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += w * np.frombuffer(blob)
                weight += w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).tobytes()], pa.binary())], names=["w", "p"])

    for epoch in range(epochs):
        begin, noise, rate = model.blob(), model.noise, RATE / (1 + epoch)

        def steps(batches, begin=begin, noise=noise, rate=rate, epoch=epoch):
            m = Model.__new__(Model)
            m.noise, m.p = noise, Model(noise).p
            m.load(np.frombuffer(begin))
            state, seen, rng = {}, 0.0, None
            for b in batches:
                code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                if not len(code):
                    continue
                if rng is None:
                    rng = np.random.default_rng([epoch, abs(int(code[0]))])
                times = -(-n // STEP_WEIGHT)
                code, n = np.repeat(code, times), np.repeat(n / times, times)
                o = rng.permutation(len(code))
                code, n = code[o], n[o]
                for i in range(0, len(code), BATCH):
                    c, w = code[i:i + BATCH], n[i:i + BATCH]
                    m.step(c // (CLASSES * CLASSES), c // CLASSES % CLASSES, c % CLASSES, w, rng, state, rate)
                seen += float(n.sum())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([m.blob()], pa.binary())], names=["w", "p"])

        done = rows.mapInArrow(steps, "w double, p binary").repartition(max(1, parts // 32)).mapInArrow(mean, "w double, p binary").collect()
        if not done:
            break
        done.sort(key=lambda r: bytes(r["p"]))
        model.load(sum(r["w"] * np.frombuffer(r["p"]) for r in done) / sum(r["w"] for r in done))
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    kind = docs.schema[key].dataType.simpleString()
    train = docs.where(fold(key) != 1).select(F.coalesce(text, F.lit("")).alias("text"))
    words = stage(word_counts(train), "lm-words")
    n_train = train.count()
    size = words.agg(F.count("*"), F.sum("c")).first()
    total, distinct = (size[1] or 0) + n_train, size[0] + (n_train > 0)
    # the least count of which no more than FREQUENT words have as many; the
    # table of counts grows with their root, and the driver gets those words only
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = words.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= FREQUENT).agg(F.min("c")).first()[0]
    best = words.where(F.col("c") >= (least or 2**62)).toPandas().sort_values("h")
    best_h, best_c = best.h.values.astype(np.int64), best.c.values.astype(np.int64)
    chosen = np.sort(np.lexsort((best_h, -best_c))[:TOP])  # by hash, as best is
    top, top_class = best_h[chosen], np.arange(len(chosen))
    is_top = F.col("h").isin([int(x) for x in top]) if len(top) else F.lit(False)
    rare = words.where(~is_top).groupBy("rc").agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    mass, once, frequency = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rare:
        mass[r["rc"]], once[r["rc"]] = r["n"], r["once"]
    frequency[:] = mass
    frequency[:len(top)] = best_c[chosen]
    frequency[END] = n_train
    unknown = np.where(mass > 0, (once + 0.5) / (mass + once + 1), 1.0)
    # of a word within its class: known ones count / mass * (1 - unknown)
    known_log = np.where(mass > 0, np.log10(np.maximum(1 - unknown, 1e-300)) - np.log10(np.maximum(mass, 1)), 0.0)
    unknown_log = np.log10(unknown)
    model = train_model(triples(train, top, top_class), frequency)
    logz = model.normalisers().astype(np.float32)
    params = model.blob()
    shared = spark.sparkContext.broadcast((best_h, best_c, top, top_class, logz, params, model.noise))

    def run(batches):
        fh, fc, top, top_class, logz, params, noise = shared.value
        m = Model(noise)
        m.load(np.frombuffer(params))
        a, b2, out, bias = m.p["ctx"] @ m.p["m2"], m.p["ctx"] @ m.p["m1"], m.p["out"], m.p["bias"]
        for b in batches:
            for at, data, off in string_slices(b.column(1), 1 << 20):
                h, rc, per_row = hashed_words(data, off)
                rows = len(per_row)
                cls = classes_of(h, rc, top, top_class)
                two, one, w, row = with_ends(cls, per_row)
                lp = (((a[two] + b2[one]) * out[w]).sum(1) + bias[w] - logz[two, one]) / np.log(10)
                of = np.repeat(np.arange(rows), per_row)
                i = np.minimum(np.searchsorted(fh, h), max(0, len(fh) - 1))
                hit = fh[i] == h if len(fh) else np.zeros(len(h), bool)
                c = fc[i] if len(fh) else np.zeros(len(h))
                inner = np.where(hit & (cls == rc), np.log10(np.maximum(c, 1)) + known_log[rc], 0.0)
                model_lp = np.bincount(row, lp, rows) + np.bincount(of[hit], inner[hit], rows)
                base = np.bincount(of[hit], np.log10(c[hit] + 0.5), rows) + np.log10(n_train + 0.5)
                known = np.bincount(of[hit], minlength=rows) + (n_train > 0)
                # words beyond the array: one entry for each in a text
                mo, mh, mr = of[~hit], h[~hit], rc[~hit]
                o = np.lexsort((mh, mo))
                mo, mh, mr = mo[o], mh[o], mr[o]
                new = np.ones(len(mo), dtype=bool)
                new[1:] = (mo[1:] != mo[:-1]) | (mh[1:] != mh[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(mo)))
                cuts = np.searchsorted(mo[first], np.arange(rows + 1))
                offs = pa.array(cuts.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(v)) for v in (mh[first], mr[first].astype(np.int32), tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, rows), pa.array(per_row.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model_lp), *lists],
                    names=["k", "n_tokens", "known", "base", "model", "h", "rc", "tf"])

    rows = stage(docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
        run, f"k {kind}, n_tokens long, known long, base double, model double, h array<long>, rc array<int>, tf array<int>")
        .withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    tail = rows.select("row", F.explode(F.arrays_zip("h", "rc", "tf")).alias("t")).select(
        "row", F.col("t.h").alias("h"), F.col("t.rc").alias("rc"), F.col("t.tf").alias("tf"))

    def of_class(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in values[TOP:TOP + RARE]]), F.col("rc") - TOP + 1)

    c = F.coalesce("c", F.lit(0))
    met = tail.join(words.select("h", "c"), "h", "left").select(
        "row", F.when(c > 0, F.col("tf")).otherwise(0).cast("long").alias("known"), (F.col("tf") * F.log10(c + 0.5)).alias("base"),
        (F.col("tf") * F.when(c > 0, F.log10(F.greatest(c, F.lit(1))) + of_class(known_log)).otherwise(of_class(unknown_log))).alias("model"))
    none = F.lit(None)
    whole = rows.select("row", "k", "n_tokens", "known", "base", "model").unionByName(
        met.select("row", none.cast(kind).alias("k"), none.cast("long").alias("n_tokens"), "known", "base", "model"))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    out = whole.groupBy("row").agg(F.max("k").alias("k"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
                                   F.sum("base").alias("b"), F.sum("model").alias("score"))
    return out.select(F.col("k").alias(key), (fold("k") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                      (F.col("b") - F.col("n_tokens") * norm).alias("base_score"), "score")
