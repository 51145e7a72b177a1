"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard
similarity of at least ``percent`` / 100, and their connected components.

The document by n-gram incidence matrix is multiplied with its transpose in
blocks of n-grams, only where two documents can reach the bound:

1. Blocks of n-grams (ranges of their hash, one per shuffle partition) tell
   every document how many of its n-grams occur in another document at all.
   Tasks send a chunk of documents' n-grams once each, as packed numbers, so a
   common n-gram is one entry a chunk.  A document of n n-grams with fewer
   than ceil(p * n) shared ones links with nothing and is done.
2. Of the others, equal sets become one class (least id).  N-grams are ordered
   by the number of classes that hold them; two sets that reach the bound meet
   in the first n - ceil(p * n) + 1 n-grams of each (the prefix), so only
   these columns are multiplied.
3. Each class is first held against the neighbour, by size, in the columns it
   shares most with.  Columns whose classes are now all connected are done,
   which most groups of near copies are at the cost of their size.
4. Classes that the other columns connect form clusters.  A cluster is cut
   into blocks of classes, and each pair of blocks is a task's matter: it adds
   up the product of their incidence rows over blocks of n-grams and keeps the
   pairs that reach the bound that follows from both sizes.  It returns links
   that connect the same classes, never pairs.

Nulls: a null or empty text, or one without words, has the empty set and links
with nothing; a row of null id links with nothing and has a null component.
Rows that share an id count as one document: its links are those of all its
texts, and they connect what they link with.  Repeated rows are equal sets.  Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mix64, n_parts, roots, shingle_hashes, small_batches, stage, string_slices, whole_groups, word_hashes

CHUNK = 500_000
#: Classes of a block, n-grams of a block.
BLOCK, COLUMNS = 512, 8192
#: A list of ids goes to all executors up to this length, else by a shuffle.
BROADCAST_IDS = 1_000_000


def row_sets(col: pa.Array, k: int):
    """(first row, rows, hashes, row of each): distinct shingles by row, then
    hash, of runs of rows."""
    for at, data, off in string_slices(col):
        h, row = shingle_hashes(*word_hashes(data, off), k)
        o = np.lexsort((h, row))
        h, row = h[o], row[o]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield at, len(off) - 1, h[new], row[new]


def shared_counts(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, shared) of every row: distinct shingles, and those of them that
    another row holds too."""
    spark = docs.sparkSession
    parts = n_parts(spark)

    def send(batches):
        task, chunk = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        rows = size = 0

        def message():
            h = np.concatenate([x[0] for x in held])
            row = np.concatenate([x[1] for x in held])
            ids = pa.concat_arrays([x[2] for x in held])
            n = np.bincount(row, minlength=rows)
            o = np.argsort(h, kind="stable")
            h, row = h[o], row[o]
            first = np.ones(len(h), dtype=bool)
            first[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(first)
            many = np.diff(np.append(start, len(h)))
            here = np.repeat(many > 1, many)
            own = np.bincount(row[here], minlength=rows)
            h, row, many = h[start], row[start], many > 1
            name = (task << 24) | chunk
            bucket = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(parts + 1))
            out: dict[str, list] = {c: [] for c in ("chunk", "bucket", "kind", "a", "b")}

            def put(b, kind, x, y):
                for c, v in zip(out, (name, b, kind, x, y), strict=True):
                    out[c].append(v)

            for b in range(parts):
                s = slice(cut[b], cut[b + 1])
                low, one = h[s].astype(np.uint32), ~many[s]
                if len(low):
                    put(b, 0, low[one].tobytes(), row[s][one].astype(np.uint16).tobytes())
                    if not one.all():
                        put(b, 1, low[~one].tobytes(), b"")
            null = np.array(ids.is_null())
            put(name % parts, 2, np.stack([ids.fill_null(0).to_numpy(), null, n, own]).astype(np.int64).tobytes(), b"")
            return pa.RecordBatch.from_arrays(
                [pa.array(out["chunk"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["kind"], pa.int32()),
                 pa.array(out["a"], pa.binary()), pa.array(out["b"], pa.binary())], names=list(out))

        for b in batches:
            for at, many, h, row in row_sets(b.column(1), k):
                if rows and (rows + many > 60000 or size + len(h) > CHUNK):
                    yield message()
                    held, rows, size, chunk = [], 0, 0, chunk + 1
                held.append((h, row + rows, b.column(0).slice(at, many)))
                rows, size = rows + many, size + len(h)
        if rows:
            yield message()

    def meet(batches):
        name, low, row, multi = [], [], [], []
        for b in batches:
            for c, kind, a, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if kind == 2:
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([2], pa.int32()), pa.array([a], pa.binary())], names=["chunk", "kind", "a"])
                    continue
                x = np.frombuffer(a, np.uint32)
                if kind == 1:
                    multi.append(x)
                else:
                    name.append(c)
                    low.append(x)
                    row.append(np.frombuffer(r, np.uint16))
        if not low:
            return
        x = np.concatenate(low + multi)
        x.sort()
        dup = x[1:][x[1:] == x[:-1]]
        twice = np.unique(np.concatenate([dup, *multi]))
        for c, v, r in zip(name, low, row, strict=True):
            if len(twice) and len(v):
                i = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
                got = r[twice[i] == v]
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([0], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["chunk", "kind", "a"])

    def told(batches):
        for b, cuts in whole_groups(batches, ["chunk"], 2000):
            kind, data = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                ids, null, n, shared = np.frombuffer(data[lo + kind[lo:hi].index(2)], np.int64).reshape(4, -1).copy()
                for i in range(lo, hi):
                    if kind[i] == 0:
                        shared += np.bincount(np.frombuffer(data[i], np.uint16), minlength=len(shared))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(n), pa.array(shared)], names=["id", "n", "shared"])

    small_batches(spark, 1000)
    sent = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        send, "chunk long, bucket int, kind int, a binary, b binary")
    back = sent.repartitionById(parts, "bucket").mapInArrow(meet, "chunk long, kind int, a binary")
    return (back.repartition(parts, "chunk").sortWithinPartitions("chunk")
            .mapInArrow(told, "id long, n long, shared long"))


def sets_of(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, s1, s2, hashes): every row's set, and two sums that stand for it."""
    def run(batches):
        for b in batches:
            for at, rows, h, row in row_sets(b.column(1), k):
                n = np.bincount(row, minlength=rows)
                off = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (0x1234567, 0x7654321):
                    c = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append(pa.array((c[off[1:]] - c[off[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, rows), pa.array(n), *sums, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["id", "n", "s1", "s2", "hashes"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, s1 long, s2 long, hashes array<long>")


def reaches(common: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * common >= percent * (na + nb - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by their whole sets."""
    a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(reaches(common, F.size("ha"), F.size("hb"), percent)).select("a", "b")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, id, n, pos): the shared n-grams in each set's prefix, and their
    place in the order of all (n-grams of fewest sets first)."""
    inc = sets.select("id", "n", F.explode("hashes").alias("h"))
    often = inc.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    mine = inc.join(often, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("g"))
    least = F.floor((percent * F.col("n") + 99) / 100)
    alone = F.col("n") - F.size("g")
    keep = F.greatest(F.col("n") - least + 1 - alone, F.lit(0))
    return (mine.where(F.size("g") >= least).where(keep > 0)
            .select("id", "n", alone.alias("alone"), F.posexplode(F.slice("g", F.lit(1), keep.cast("int"))).alias("p", "t"))
            .select(F.col("t.h").alias("h"), "id", "n", (F.col("alone") + F.col("p")).alias("pos")))


def sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return (100 * na >= percent * nb) & (100 * nb >= percent * na)


def block_links(ids: np.ndarray, sets: list[np.ndarray], component: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """(id, id) links that connect what the links of a pair of blocks connect."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    u, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[col] > 1
    row, col = row[keep], (np.cumsum(df > 1) - 1)[col[keep]]
    o = np.argsort(col, kind="stable")
    row, col = row[o], col[o]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(col[-1]) + 1 - lo)), dtype=np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    linked &= component[:, None] != component[None, :]
    if len(np.unique(own)) > 1:
        linked &= own[:, None] != own[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    if not len(i):
        return np.zeros((0, 2), np.int64)
    # classes of a component count as one
    _, comp = np.unique(component, return_inverse=True)
    root = roots(np.stack([comp[i], comp[j]], axis=1), int(comp.max()) + 1)
    first = np.full(int(comp.max()) + 1, -1)
    first[comp[::-1]] = np.arange(len(comp))[::-1]
    some = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([ids[first[some]], ids[first[root[some]]]], axis=1)


def links(sets: DataFrame, percent: int, stars: bool = True) -> DataFrame:
    """Edges (a, b) between sets with distinct contents that connect all that
    links connect."""
    spark = sets.sparkSession
    cols = stage(prefixes(sets, percent), "ngram-prefix")
    marked, found = cols.withColumn("component", F.col("id")), None
    if stars:
        w = Window.partitionBy("h").orderBy("n", "id")
        near = cols.select("id", "n", *[F.lag(c).over(w).alias(f"{c}2") for c in ("id", "n")])
        pairs = (near.where(sizes_fit(F.col("n"), F.col("n2"), percent)).groupBy(F.col("id").alias("a"), F.col("id2").alias("b"))
                 .agg(F.count("*").alias("c")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")))
        found = stage(verified(pairs, sets, percent), "ngram-links")
        label = stage(components(found, "ngram-cc"), "ngram-label")
        marked = cols.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # columns that still hold unconnected sets, and what they connect
    columns = marked.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("b")).where("lo < hi")
    open_ = stage(marked.join(columns.select("h", "b"), "h").select("id", "component", "b").distinct(), "ngram-open")
    cluster = stage(components(open_.select(F.col("id").alias("a"), "b"), "ngram-clusters"), "ngram-cluster")
    blocks = cluster.groupBy(F.col("component").alias("cluster")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    rows = (cluster.select("id", F.col("component").alias("cluster")).join(blocks, "cluster")
            .join(open_.select("id", "component").distinct(), "id")
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("cluster", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", "component"))

    def multiply(batches):
        for b, cuts in whole_groups(batches, ["cluster", "bi", "bj"], 2000):
            own, ids, comp = (b.column(c).to_numpy() for c in ("own", "id", "component"))
            col = b.column("hashes")
            flat, off = col.flatten().to_numpy(), col.offsets.to_numpy()
            off = off - off[0]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                got = block_links(ids[lo:hi], [flat[off[i]:off[i + 1]] for i in range(lo, hi)], comp[lo:hi], own[lo:hi], percent)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    small_batches(spark, 500)
    dealt = (rows.join(sets.select("id", "hashes"), "id").select("cluster", "bi", "bj", "own", "id", "component", "hashes")
             .repartition(n_parts(spark), "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "id"))
    more = stage(dealt.mapInArrow(multiply, "a long, b long"), "ngram-blocks")
    return more if found is None else found.unionByName(more)


def class_labels(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(s1, s2, n, c) of every class of equal sets: the least id of its
    component.  A class goes by its least id, unless an id has several sets:
    then by a number of its own, and the classes of an id are linked."""
    content = ["s1", "s2", "n"]
    one = F.struct(*content)
    several = stage(sets.groupBy("id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("id"), "ngram-several")
    if several.isEmpty():
        own = sets.join(classes.select(F.col("rep").alias("id"), *content), ["id", *content]).select("id", "n", "hashes").dropDuplicates(["id"])
        of_rep = components(links(stage(own, "ngram-reps"), percent), "ngram-cc").select(F.col("id").alias("rep"), "component")
        return classes.join(of_rep, "rep", "left").select(*content, F.coalesce("component", "rep").alias("c"))
    numbered = stage(classes.withColumn("class", F.monotonically_increasing_id()), "ngram-numbered")
    own = sets.join(numbered.select(F.col("rep").alias("id"), *content, "class"), ["id", *content]).select(F.col("class").alias("id"), "n", "hashes").dropDuplicates(["id"])
    held = sets.join(several, "id", "left_semi").select("id", *content).distinct().join(numbered, content).select("id", "class")
    tied = held.join(held.groupBy("id").agg(F.min("class").alias("b")), "id").select(F.col("class").alias("a"), "b").where("a <> b")
    of_class = components(links(stage(own, "ngram-reps"), percent).unionByName(tied), "ngram-cc").select(F.col("id").alias("class"), "component")
    label = stage(numbered.join(of_class, "class", "left").withColumn("component", F.coalesce("component", "class")), "ngram-label")
    least = label.groupBy("component").agg(F.min("rep").alias("c"))
    return label.join(least, "component").select(*content, "c")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    counts = stage(shared_counts(docs, key, text, k), "ngram-counts")
    least = F.floor((percent * F.col("n") + 99) / 100)
    open_ids = counts.where("id is not null and n > 0").where(F.col("shared") >= least).select(F.col("id").alias("_id")).distinct()
    many = open_ids.count()
    side = F.broadcast(open_ids) if many <= BROADCAST_IDS else open_ids
    some = docs.join(side, docs[key].cast("long") == side["_id"], "left_semi")
    sets = stage(sets_of(some, key, text, k).where("n > 0"), "ngram-sets")
    classes = stage(sets.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "ngram-classes")
    label = class_labels(sets, classes, percent)
    of_id = sets.select("id", "s1", "s2", "n").join(label, ["s1", "s2", "n"]).groupBy("id").agg(F.min("c").alias("c"))
    return counts.join(of_id, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                                                   F.coalesce("c", "id").alias("component_id"))
