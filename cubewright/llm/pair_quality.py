"""Quality classifier: a Bradley-Terry model of documents.

A document's score is a weighted sum of features of its text alone.  Of two
documents of which one is labelled good and the other bad, the good one wins
with probability ``1 / (1 + exp(-(s_good - s_bad)))``: logistic loss on the
difference of their features, fitted by Newton steps over all pairs of a good
and a bad learning document.

The cut is the quantile of the learning documents' scores at the share of bad
labels, and the model's scores are laid so that a document at the cut has
``CUT``; from there on it is predicted good.

No learning document and no pair is left out, yet pairs are never listed.  What
a document adds up over all documents of the other label is a smooth function
of its score alone.  Scores are laid in cells of ``CELL``, and in a cell such a
function is its interpolant in ``NODES`` Chebyshev points (to some 1e-13, as
near as the sums of doubles), so a step needs two passes over the documents:
features summed by point, then the curvature.  Numbers of features are staged,
in buckets of a fixed order; every bucket is summed in one task and buckets in
their order, so reruns agree.  The driver holds sums by point.

Every document is scored, whole, in its own task.

Nulls and ties: a null text is empty, an empty text has the features zero and a
score; null ids never match a label; labels of an id that disagree are left
out; repeated rows are scored alike.  Without labels of both kinds every
document has the score 0.5.  Further columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_prefix, n_parts, small_batches, span_hashes, stage, string_slices, whole_groups, words_of

PAIRS, CUT = 200_000, 0.3
RIDGE, STEPS, WIDEST = 1e-3, 30, 4.0
#: Learning documents of a bucket (about), and width and points of a cell.
BUCKET_ROWS, CELL, NODES = 10_000, 2.0, 16
#: Bins of a pass of the quantile, and the most scores that end its passes.
BINS, FEW = 1024, 20_000

_AT = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_TO_NODES = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES
_POINTS = (_AT + 1) * CELL / 2

_B = np.arange(256)
_UPPER, _LOWER = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122)
_DIGIT, _SPACE = (_B >= 48) & (_B <= 57), (_B == 32) | ((_B >= 9) & (_B <= 13))
_MARK = np.isin(_B, list(b".,;:!?'\"-()"))
_SYMBOL = (_B > 32) & (_B < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_MARK
_CONTROL = ((_B < 32) & ~_SPACE) | (_B == 127)
_HIGH, _LEAD = _B >= 128, _B >= 192
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _SYMBOL, _CONTROL, _HIGH, _LEAD], axis=1).astype(np.float64)
_STOP = np.isin(_B, list(b".!?"))


def _per_row(row: np.ndarray, flag: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row[flag], minlength=n).astype(np.float64)


def _runs(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different values, occurrences of the most frequent one) by row."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    at = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, at, size)
    return np.bincount(at, minlength=n).astype(np.float64), most


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, features) of UTF-8 texts; shares and logarithms only."""
    n = len(off) - 1
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(off[:-1], off[1:], strict=True)]) if n else np.zeros((0, 256))
    upper, lower, digit, space, mark, symbol, control, high, lead = (hist @ _CLASSES).T
    size = np.diff(off).astype(np.float64)
    solid = np.maximum(size - space, 1)
    letters = upper + lower + lead
    low, starts, ends, per_row = words_of(data, off)
    row = np.repeat(np.arange(n), per_row)
    words = np.maximum(per_row, 1).astype(np.float64)
    prefix = gram_prefix(low)
    h = span_hashes(prefix, starts, ends)
    last, first_byte = (low[ends - 1], data[starts]) if len(starts) else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    length = ends - starts
    same_row = np.zeros(len(h), dtype=bool)
    same_row[1:] = row[1:] == row[:-1]
    again = same_row.copy()
    again[1:] &= h[1:] == h[:-1]
    pair = np.zeros(len(h), dtype=np.uint64)
    pair[1:] = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    kinds, most = _runs(row, h, n)
    pairs, most_pair = _runs(row[same_row], pair[same_row], n)
    letter_sum = np.concatenate([[0], np.cumsum((_LOWER | _HIGH)[low])])
    wordless = letter_sum[ends] == letter_sum[starts]
    # lines: runs between line feeds and the ends of rows
    edge = np.unique(np.concatenate([off, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    ls, le = edge[:-1], edge[1:]
    keep = (data[ls] != 10) if len(ls) else np.zeros(0, dtype=bool)
    ls, le = ls[keep], le[keep]
    line_row = np.searchsorted(off, ls, "right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=n), 1).astype(np.float64)
    line_kinds, _ = _runs(line_row, span_hashes(prefix, ls, le), n)
    return np.stack([
        np.log1p(per_row), np.log1p(size / words), letters / solid, digit / solid, symbol / solid, mark / solid, control / solid, high / solid,
        upper / np.maximum(upper + lower, 1), space / np.maximum(size, 1), np.log1p(words / lines),
        kinds / words, np.log1p(kinds) / np.log1p(words), most / words, _per_row(row, again, n) / words,
        1 - pairs / np.maximum(words - 1, 1), most_pair / words, _per_row(row, wordless, n) / words,
        _per_row(row, _STOP[last], n) / words, _per_row(row, _SYMBOL[last], n) / words, _per_row(row, _UPPER[first_byte], n) / words,
        _per_row(row, length <= 3, n) / words, _per_row(row, length >= 16, n) / words,
        1 - line_kinds / lines, _per_row(line_row, _STOP[data[le - 1]] if len(le) else np.zeros(0, bool), n) / lines,
    ], axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    cut: float
    scale: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -WIDEST, WIDEST)
        return np.concatenate([z, z * z, np.maximum(z - 1, 0)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (self.expand(x) @ self.weight - self.cut) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -36, 36)))


def preference_pairs(good: int, bad: int, pairs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) rows: every row of the rarer label about as often as any,
    against rows of the other in a random order, round after round."""
    rng = np.random.default_rng(seed)
    total = min(pairs, good * bad)
    draw = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-total // n))])[:total]
    return draw(good), draw(bad)


def _descend(size: int, moments: Callable) -> np.ndarray:
    """Newton steps; ``moments(w)`` gives the mean gradient and curvature of
    the pairs' loss."""
    w = np.zeros(size)
    for _ in range(STEPS):
        grad, hess = moments(w)
        step = np.linalg.solve(hess + RIDGE * np.eye(size), grad + RIDGE * w)
        w = w - step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _blank(mean: np.ndarray, spread: np.ndarray) -> Model:
    return Model(mean, np.where(spread > 0, spread, 1), np.zeros(3 * len(mean)), 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, bad_share: float, pairs: int = PAIRS) -> Model:
    """The model of rows that one process holds, over drawn pairs: weights by
    Newton steps on the pairs' logistic loss; the cut by the quantile of the
    scores, labels weighed as in the whole table.  ``train`` fits tables."""
    blank = _blank(x.mean(axis=0), x.std(axis=0))
    phi = blank.expand(x)
    win, lose = preference_pairs(int((y == 1).sum()), int((y == 0).sum()), pairs)
    d = phi[y == 1][win] - phi[y == 0][lose]

    def moments(w):
        p = 1 / (1 + np.exp(np.clip(d @ w, -36, 36)))
        return -(d * p[:, None]).mean(axis=0), (d * (p * (1 - p))[:, None]).T @ d / len(d)

    w = _descend(d.shape[1], moments)
    s = phi @ w
    share = np.where(y == 0, bad_share / max(1, (y == 0).sum()), (1 - bad_share) / max(1, (y == 1).sum()))
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(share[order]), bad_share - 1e-12, "left"))
    cut = float(s[order][at:at + 2].mean())
    return Model(blank.mean, blank.spread, w, cut, max(1e-9, float(s.std()) / 2))


# ---------------------------------------------------------------------------
# the fit of a table
# ---------------------------------------------------------------------------

def _totals(rows: DataFrame, part: Callable[[int, np.ndarray, np.ndarray], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """{key: sum of vectors} of the (key, vector) that ``part(bucket, labels,
    features)`` gives for every bucket, buckets summed in their order."""
    def run(batches):
        for b, at in whole_groups(batches, ["bucket"], 1):
            y, x = b["y"].to_numpy(), b["x"].flatten().to_numpy().reshape(len(b), -1)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                bucket = b["bucket"][int(lo)].as_py()
                out = list(part(bucket, y[lo:hi], x[lo:hi]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int64()),
                                                      pa.array([np.asarray(v, np.float64) for _, v in out], pa.list_(pa.float64()))], names=["key", "bucket", "v"])

    def add(t):
        v = sorted(zip(t["bucket"].to_pylist(), t["v"].to_pylist(), strict=True))
        total = np.zeros(len(v[0][1]))
        for _, more in v:
            total += more
        return pa.table({"key": t["key"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

    got = rows.mapInArrow(run, "key long, bucket long, v array<double>").groupBy("key").applyInArrow(add, "key long, v array<double>")
    return {r["key"]: np.array(r["v"]) for r in got.collect()}


def _near(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every score, and the points' parts in it."""
    cell = np.floor(s / CELL).astype(np.int64)
    return cell, np.polynomial.chebyshev.chebvander((s - cell * CELL) * 2 / CELL - 1, NODES - 1) @ _TO_NODES


def _cells(cell: np.ndarray, y: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    """(cell and label in one number, its rows)."""
    key = cell * 2 + y
    for k in np.unique(key):
        yield int(k), np.flatnonzero(key == k)


def _all_pairs(rows: DataFrame, blank: Model) -> Callable:
    """Mean gradient and curvature of the loss over every pair."""
    d = len(blank.weight)

    def moments(w):
        def by_point(_, y, x):
            phi = blank.expand(x)
            cell, near = _near(phi @ w)
            for k, at in _cells(cell, y):
                yield k, (near[at].T @ np.concatenate([np.ones((len(at), 1)), phi[at]], axis=1)).ravel()

        sums = _totals(rows, by_point)
        keys = [sorted(k for k in sums if k % 2 == label) for label in (0, 1)]
        (t_bad, m_bad), (t_good, m_good) = [(np.concatenate([(k // 2) * CELL + _POINTS for k in ks]), np.concatenate([sums[k].reshape(NODES, d + 1) for k in ks])) for ks in keys]
        p = 1 / (1 + np.exp(np.clip(t_good[:, None] - t_bad, -700, 700)))
        curve = p * (1 - p)
        grad = (p @ m_bad[:, 0]) @ m_good[:, 1:] - (p.T @ m_good[:, 0]) @ m_bad[:, 1:]
        cross = m_good[:, 1:].T @ curve @ m_bad[:, 1:]
        bend = {k: v for ks, all_v in zip(keys, (curve.T @ m_good[:, 0], curve @ m_bad[:, 0]), strict=True) for k, v in zip(ks, all_v.reshape(-1, NODES), strict=True)}

        def curvature(bucket, y, x):
            phi = blank.expand(x)
            cell, near = _near(phi @ w)
            own = np.zeros(len(y))
            for k, at in _cells(cell, y):
                own[at] = near[at] @ bend[k]
            # sums of so many buckets meet in a task
            yield bucket % 32, ((phi * own[:, None]).T @ phi).ravel()

        square = _totals(rows, curvature)
        pairs = m_good[:, 0].sum() * m_bad[:, 0].sum()
        return -grad / pairs, (sum(square[k] for k in sorted(square)).reshape(d, d) - cross - cross.T) / pairs

    return moments


def _quantile(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], lo: float, hi: float, weight: np.ndarray, share: float) -> float:
    """Mean of the first score up to which rows of ``weight`` by label hold
    ``share``, and the one after it.  Passes narrow its place by counts."""
    below = np.zeros(2)
    while True:
        width = (hi - lo) / BINS
        edges = lo + width * np.arange(1, BINS)  # bin i: edges[i - 1] <= score < edges[i]

        def count(_, y, x, lo=lo, hi=hi, edges=edges):
            s = score(x)
            here = (s >= lo) & (s <= hi)
            n = np.zeros((BINS, 2))
            np.add.at(n, (np.searchsorted(edges, s[here], "right"), y[here]), 1)
            if here.any():
                yield 0, n.ravel()

        n = _totals(rows, count)[0].reshape(BINS, 2)
        full = (below + np.cumsum(n, axis=0)) @ weight >= share - 1e-12
        at = int(np.argmax(full)) if full.any() else int(np.flatnonzero(n.sum(axis=1))[-1])
        a, b = (lo if at == 0 else edges[at - 1]), (hi if at == BINS - 1 else np.nextafter(edges[at], -np.inf))
        below = below + n[:at].sum(axis=0)
        if n[at].sum() <= FEW or (a, b) == (lo, hi) or a >= b:
            break
        lo, hi = float(a), float(b)

    def different(bucket, y, x):
        s = score(x)
        here = (s >= a) & (s <= b)
        v, i = np.unique(s[here], return_inverse=True)
        n = np.zeros((len(v), 2))
        np.add.at(n, (i, y[here]), 1)
        above = s[s > b]
        yield bucket, np.concatenate([[above.min() if len(above) else np.inf], np.column_stack([v, n]).ravel()])

    got = _totals(rows, different)
    inside = np.concatenate([v[1:].reshape(-1, 3) for v in got.values()])
    inside = inside[np.argsort(inside[:, 0], kind="stable")]
    full = (below + np.cumsum(inside[:, 1:], axis=0)) @ weight >= share - 1e-12
    at = int(np.argmax(full)) if full.any() else len(inside) - 1
    first = inside[at, 0]
    # rows of equal scores stand one after the other
    but_last = (below + inside[:at + 1, 1:].sum(axis=0)) @ weight - weight[inside[at, 1:] > 0].max()
    if but_last >= share - 1e-12:
        return float(first)
    after = inside[at + 1, 0] if at + 1 < len(inside) else min(v[0] for v in got.values())
    return float((first + after) / 2) if np.isfinite(after) else float(first)


def held_out(key: str | Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learning_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(bucket, y, x) of every labelled document that is not held out, staged,
    and the number of labels of either kind."""
    small_batches(docs.sparkSession, 500)
    told = stage(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k"))
                 .agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_k", F.col("_y").cast("int").alias("_y")), "quality-labels")
    n = {r[0]: r[1] for r in told.groupBy("_y").count().collect()}

    def measure(batches):
        for b in batches:
            for at, data, off in string_slices(b.column(1)):
                f = features(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(f)), pa.array(list(f), pa.list_(pa.float64()))], names=["_k", "x"])

    # texts are measured where they lie, only numbers are joined
    mine = docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    buckets = max(1, -(-sum(n.values()) // BUCKET_ROWS))
    rows = (mine.mapInArrow(measure, f"_k {mine.schema['_k'].dataType.simpleString()}, x array<double>").join(told, "_k")
            .select(F.pmod(F.xxhash64("_k"), F.lit(buckets)).alias("bucket"), F.col("_y").alias("y"), "x")
            .repartition(min(buckets, n_parts(docs.sparkSession)), "bucket").sortWithinPartitions("bucket", "y", "x"))
    return stage(rows, "quality-rows"), n


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model of all labelled documents that are not held out; None without
    both labels."""
    rows, n = learning_rows(docs, labels, key, text, label)
    if len(n) < 2:
        return None
    sums = _totals(rows, lambda _, y, x: [(0, np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))])
    if not sums or not 0 < sums[0][1] < sums[0][0]:
        return None
    (size, good), mean = sums[0][:2], sums[0][2:] / sums[0][0]
    spread = np.sqrt(_totals(rows, lambda _, y, x: [(0, ((x - mean) ** 2).sum(axis=0))])[0] / size)
    blank = _blank(mean, spread)
    w = _descend(len(blank.weight), _all_pairs(rows, blank))
    score = lambda x: blank.expand(x) @ w

    def reach(bucket, _, x):
        s = score(x)
        yield bucket, np.array([s.min(), s.max(), s.sum()])

    span = np.array([v for _, v in sorted(_totals(rows, reach).items())])
    lo, hi, middle = span[:, 0].min(), span[:, 1].max(), span[:, 2].sum() / size
    deviation = np.sqrt(_totals(rows, lambda _, y, x: [(0, [((score(x) - middle) ** 2).sum()])])[0][0] / size)
    bad_share = n[0] / (n[0] + n[1])
    cut = _quantile(rows, score, float(lo), float(hi), np.array([bad_share / (size - good), (1 - bad_share) / good]), bad_share)
    return Model(mean, blank.spread, w, cut, max(1e-9, float(deviation) / 2))


def classify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, score and predicted of every row."""
    small_batches(docs.sparkSession, 500)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        for b in batches:
            for at, data, off in string_slices(b.column(b.num_columns - 1)):
                n = len(off) - 1
                s = model.score(features(data, off)) if model else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, n) for c in b.columns[:-1]], pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                                 names=[*names, "score", "predicted"])

    shape = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{shape}, score double, predicted int").withColumnsRenamed(dict(zip(names, keep, strict=True)))
