"""Similarity classes of word sets: MinHash bands, Bayesian pruning, exact Jaccard, components.

The join never lists the pairs of a group. Texts with one set of shingles become one node. Nodes that share a band
are compared inside a task, in blocks of bounded size, by their MinHash values in steps; a pair is dropped once the
posterior probability that its Jaccard similarity reaches the threshold falls below a tolerance. Buckets with equal
members are compared once. In a bucket beyond a block every node meets a block of pivots first, and only nodes outside
the largest component that this gives meet all others. A task emits a spanning forest of the pairs that survive.

Inside each component of those forests links are verified exactly. Jaccard distance is a metric: in a component beyond
a block each node's distance to one pivot is taken, pairs whose two distances add up to no more than the greatest
distance of a link are links without being looked at, and only the nodes of other pairs are compared, in blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .graph import components
from .store import bounded, removed, written


@dataclass(frozen=True)
class Similarity:
    """words: of a shingle. bands x rows MinHash values. A pair at the threshold meets in no band with probability (1 - threshold**rows) ** bands. tolerance: of the pruning. block: nodes of one side of a comparison. broadcast_rows: of about 100 bytes, up to which a side of a join is broadcast; beyond, it shuffles."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-4
    block: int = 512
    broadcast_rows: int = 250_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def far(self) -> int:
        """The greatest distance of a link, in thousandths."""
        return int((1 - self.threshold) * 1000 + 1e-6)


@lru_cache(maxsize=64)
def least_matches(p: Similarity) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest equal values that keep a pair), from a uniform prior: P(similarity >= threshold | m of n equal) is the upper tail of Beta(m+1, n-m+1), which is a sum of binomial terms."""
    out = []
    for n in range(p.step, p.hashes + 1, p.step):
        def tail(m: int) -> float:
            # 1 - I_t(m+1, n-m+1) = P(Binomial(n+1, t) <= m)
            return sum(math.comb(n + 1, k) * p.threshold**k * (1 - p.threshold) ** (n + 1 - k) for k in range(m + 1))

        out.append((n, next((m for m in range(n + 1) if tail(m) >= p.tolerance), n)))
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, p: Similarity, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of x and y that the pruning keeps; same: x is y, and a pair counts once."""
    i, j = np.triu_indices(len(x), 1) if same else (g.ravel() for g in np.indices((len(x), len(y))))
    equal, done = np.zeros(len(i), np.int16), 0
    for n, least in least_matches(p):
        for k in range(done, n):
            equal += x[i, k] == y[j, k]
        done = n
        keep = equal >= least
        if not keep.all():
            i, j, equal = i[keep], j[keep], equal[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, node) of the components of 0..n-1 under the given pairs."""
    root = np.arange(n)
    i, j = np.asarray(i), np.asarray(j)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    while (root != root[root]).any():
        root = root[root]
    return [(int(r), v) for v, r in enumerate(root) if r != v]


def signed(texts: DataFrame, p: Similarity) -> DataFrame:
    """Adds __fp (of the set of shingles; null without words) and __sig to every row; all columns stay."""
    schema = T.StructType([*texts.schema.fields, T.StructField("__fp", T.BinaryType()), T.StructField("__sig", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                sh, to = flat.shingles(*flat.words(b.column("text").to_pylist()), p.words)
                names, sizes = flat.fingerprints(sh, to)
                sig = flat.minhash(sh, to, p.hashes)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f if n else None for f, n in zip(names, sizes)], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=[*b.schema.names, "__fp", "__sig"])

    return texts.mapInArrow(run, schema)


def in_blocks(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks it takes part in; key, side: which of the two blocks is its own (2: both)."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    df = df.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return df.select("*", F.xxhash64(group, low, high).alias("key"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))


def to_pivots(df: DataFrame, group: str, size: str, block: int, pivot: Column) -> DataFrame:
    """Pivots once for every block of their group (side 0, and 2 in block 0, where they are at home), other rows once (side 1)."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.when(pivot, 0).otherwise(1 + F.pmod(F.xxhash64("fp"), n)).cast("int")
    df = df.select("*", F.explode(F.when(pivot, F.sequence(F.lit(0), n)).otherwise(F.array(own))).alias("own"), pivot.alias("pivot"))
    return df.select("*", F.xxhash64(group, "own").alias("key"), F.when(~F.col("pivot"), 1).when(F.col("own") == 0, 2).otherwise(0).alias("side"))


def _groups(table: pa.Table, columns: list[str]):
    """Per group of a table sorted by key, group: the rows' columns."""
    data = {c: table.column(c).combine_chunks() for c in columns}
    key = table.column("key").to_numpy()
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    for begin, end in zip([0, *cut], [*cut, len(key)]):
        yield {c: v.slice(begin, end - begin) for c, v in data.items()}


def _candidates(p: Similarity, known: bool = False):
    """a, b: a spanning forest of the pairs that the pruning keeps, rooted at the least pivot; known: of pairs with different labels only."""

    def run(batches):
        for table in flat.runs(batches, "key"):
            out_a, out_b = [], []
            for g in _groups(table, ["bucket", "fp", "sig", "side", *(["label"] if known else [])]):
                bucket = g["bucket"].to_numpy(zero_copy_only=False)
                for value in np.unique(bucket) if len(bucket) > 1 else ():  # two buckets may share a key's hash
                    at = np.flatnonzero(bucket == value)
                    # the least node or pivot is the root in every bucket and block, so forests of a group share edges
                    at = np.array(sorted(at, key=lambda k: (g["side"][int(k)].as_py() == 1, g["fp"][int(k)].as_py())))
                    fp = [g["fp"][int(k)].as_py() for k in at]
                    sig = np.frombuffer(b"".join(g["sig"][int(k)].as_py() for k in at), np.uint16).reshape(len(at), p.hashes)
                    side = g["side"].to_numpy(zero_copy_only=False)[at]
                    if side[0] == 2:
                        i, j = survivors(sig, sig, p, True)
                    else:
                        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                        i, j = survivors(sig[left], sig[right], p, False)
                        i, j = left[i], right[j]
                    if known:
                        label = g["label"].take(pa.array(at)).dictionary_encode().indices.to_numpy()
                        i, j = i[label[i] != label[j]], j[label[i] != label[j]]
                    for r, v in forest(len(at), i, j):
                        out_a.append(fp[r])
                        out_b.append(fp[v])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return run


_PAIRS = "a binary, b binary"


def _compared(parts: DataFrame, run, schema: str) -> DataFrame:
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def candidates(reps: DataFrame, p: Similarity, made: list[str]) -> DataFrame:
    """(a, b): forests that connect every two nodes of reps(fp, sig) that share a band and that the pruning keeps. Tables that can go afterwards are listed in made."""
    width = 2 * p.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(p.bands)])
    bands = reps.select("fp", F.explode(keys).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).where("n > 1")
    # buckets with equal members (equal number and two sums of 64 bits) would give equal pairs
    one = written(shared.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets", made)
    if one.count() <= p.broadcast_rows:
        meet = reps.select("fp", "sig", F.explode(keys).alias("bucket")).join(F.broadcast(one), "bucket")
    else:
        meet = bands.join(one, "bucket").join(reps.select("fp", "sig"), "fp")
    columns = ["key", "bucket", "fp", "sig", "side"]
    small = meet.where(F.col("n") <= p.block).select(F.col("bucket").alias("key"), "bucket", "fp", "sig", F.lit(2).alias("side"))
    edges = _compared(small.select(*columns), _candidates(p), _PAIRS)
    if one.where(F.col("n") > p.block).isEmpty():
        return edges
    big = written(meet.where(F.col("n") > p.block).select("bucket", "n", "fp", "sig"), "large", made)
    # the least nodes are pivots (fp is uniform), so the least one of a group is the root in all its buckets
    pivot = F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("double") * F.col("n") < float(p.block << 32)
    first = written(edges.unionByName(_compared(to_pivots(big, "bucket", "n", p.block, pivot).select(*columns), _candidates(p), _PAIRS)), "pivoted", made)
    # nodes that are in one component by now need not meet; those outside a bucket's largest one meet all
    label = components(first, made).withColumnRenamed("v", "fp")
    of = big.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    main = of.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("label", "k").alias("main"), (F.sum("k") - F.max("k")).cast("int").alias("m")).where("m > 0")
    of = of.join(F.broadcast(main) if one.count() <= p.broadcast_rows else main, "bucket")
    blocks = lambda c: F.ceil(F.col(c) / p.block).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("fp"), blocks(c)).cast("int")
    these = of.where("label <> main").select("bucket", "fp", "sig", "label", own("m").alias("i"), every("n").alias("j"), F.lit(0).alias("side"))
    those = of.select("bucket", "fp", "sig", "label", every("m").alias("i"), own("n").alias("j"), F.lit(1).alias("side"))
    again = these.unionByName(those).select("*", F.xxhash64("bucket", "i", "j").alias("key")).select(*columns, "label")
    return label.select(F.col("fp").alias("a"), F.col("label").alias("b")).unionByName(_compared(again, _candidates(p, True), _PAIRS))


def _sets(texts: list[str], p: Similarity) -> list[np.ndarray]:
    sh, to = flat.shingles(*flat.words(texts), p.words)
    return [np.unique(sh[to[i] : to[i + 1]]) for i in range(len(texts))]


def exact_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left x right (i < j where both hold the same) whose Jaccard similarity reaches the threshold, from one product of incidence matrices taken in bounded pieces."""
    size = np.array([len(s) for s in sets], np.float64)
    same = len(left) == len(right) and (left == right).all()
    ids, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(int))
    common = np.bincount(where, minlength=len(ids))[where] > 1
    where, owner = where[common], owner[common]
    dense = np.unique(where)
    where = np.searchsorted(dense, where)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    rank = np.full((2, len(sets)), -1)
    rank[0, left], rank[1, right] = np.arange(len(left)), np.arange(len(right))
    for begin in range(0, len(dense), 2048):
        a, b = np.searchsorted(where, [begin, begin + 2048])
        w, o = where[a:b] - begin, owner[a:b]
        x = np.zeros((len(left), 2048), np.float32)
        y = np.zeros((len(right), 2048), np.float32)
        l, r = rank[0, o] >= 0, rank[1, o] >= 0
        x[rank[0, o[l]], w[l]] = 1
        y[rank[1, o[r]], w[r]] = 1
        inter += x @ y.T
    union = size[left][:, None] + size[right][None, :] - inter
    i, j = np.nonzero((inter >= threshold * union - 1e-9) & (inter > 0))
    i, j = left[i], right[j]
    return (i[i < j], j[i < j]) if same else (i, j)


def _by_label(batches, columns: list[str]):
    """Per label of the groups of a key: the rows' columns in order of fp."""
    for table in flat.runs(batches, "key"):
        for g in _groups(table, ["label", "fp", "side", *columns]):
            label = g["label"].dictionary_encode().indices.to_numpy()
            for value in np.unique(label):  # two labels may share a key's hash
                at = np.flatnonzero(label == value)
                at = np.array(sorted(at, key=lambda k: g["fp"][int(k)].as_py()))
                yield {c: v.take(pa.array(at)) for c, v in g.items()}


def _verified(p: Similarity, known: bool = False):
    """fp, links, up: how many rows of a block each node is similar to, and its parent in a spanning forest; known: pairs whose distances q add up to no more than a link's are left out."""

    def run(batches):
        for g in _by_label(batches, ["copies", "text", *(["q"] if known else [])]):
            fp, copies, side = g["fp"].to_pylist(), g["copies"].to_numpy(zero_copy_only=False), g["side"].to_numpy(zero_copy_only=False)
            left, right = (np.arange(len(fp)),) * 2 if side[0] == 2 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if len(fp) < 2 or not len(left) or not len(right):
                continue
            i, j = exact_pairs(_sets(g["text"].to_pylist(), p), left, right, p.threshold)
            if known:
                q = g["q"].to_numpy(zero_copy_only=False)
                open_ = q[i] + q[j] > p.far
                i, j = i[open_], j[open_]
            links = np.bincount(i, copies[j], len(fp)) + np.bincount(j, copies[i], len(fp))
            parent = dict((v, r) for r, v in forest(len(fp), i, j))
            rows = [(fp[k], int(links[k]), fp[parent[k]] if k in parent else None) for k in np.flatnonzero(links)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=["fp", "links", "up"])

    return run


def _distances(p: Similarity):
    """label, fp, copies, text, q: the distance of each node to its label's pivot in thousandths, rounded up."""

    def run(batches):
        for g in _by_label(batches, ["copies", "text"]):
            side = g["side"].to_numpy(zero_copy_only=False)
            sets = _sets(g["text"].to_pylist(), p)
            pivot = sets[int(np.flatnonzero(side != 1)[0])]
            own = np.flatnonzero(side != 0)
            if not len(own):
                continue
            common = np.array([len(np.intersect1d(sets[k], pivot, assume_unique=True)) for k in own])
            whole = np.array([len(sets[k]) for k in own]) + len(pivot) - common
            q = np.ceil((1 - common / whole) * 1000 - 1e-6).astype(np.int64)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([g["label"].take(take), g["fp"].take(take), g["copies"].take(take), g["text"].take(take), pa.array(q)], names=["label", "fp", "copies", "text", "q"])

    return run


_LINKS = "fp binary, links bigint, up binary"


def verified(stand: DataFrame, p: Similarity, made: list[str]) -> DataFrame:
    """fp, links, up (rows add up by fp) of the nodes stand(label, n, fp, copies, text), label being the least fp of n nodes."""
    columns = ["key", "label", "fp", "copies", "text", "side"]
    small = stand.where(F.col("n") <= p.block).select("label", "fp", "copies", "text", F.xxhash64("label").alias("key"), F.lit(2).alias("side"))
    out = _compared(small.select(*columns), _verified(p), _LINKS)
    large = stand.where(F.col("n") > p.block)
    if large.isEmpty():
        return out
    parts = to_pivots(large, "label", "n", p.block, F.col("fp") == F.col("label")).select(*columns)
    far = written(_compared(parts, _distances(p), "label binary, fp binary, copies bigint, text string, q bigint"), "distances", made)
    hist = far.groupBy("label", "q").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    # at most a thousand rows a label: rows within each distance up to a link's
    within = F.transform(F.sequence(F.lit(0), F.lit(p.far)), lambda k: F.aggregate(F.filter("h", lambda x: x["q"] <= k), F.lit(0).cast("long"), lambda s, x: s + x["copies"]))
    hist = hist.groupBy("label").agg(F.max("q").alias("most"), F.collect_list(F.struct("q", "copies", "n")).alias("h"))
    open_ = F.aggregate(F.filter("h", lambda x: (x["q"] + F.col("most") > p.far) & (x["q"] > 0)), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    hist = written(hist.select("label", "most", within.alias("within"), open_.alias("n")), "labels", made)
    few = hist.count() <= p.broadcast_rows // 100
    salt = F.pmod(F.xxhash64("fp"), F.lit(16)).cast("int")
    each = far.select("*", salt.alias("salt")).join(F.broadcast(hist.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))) if few else hist.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["label", "salt"])
    near = each.where(F.col("q") <= p.far)
    sure = F.get("within", (p.far - F.col("q")).cast("int")) - F.when(2 * F.col("q") <= p.far, F.col("copies")).otherwise(0)
    out = out.unionByName(near.select("fp", sure.alias("links"), F.when(F.col("fp") != F.col("label"), F.col("label")).alias("up")))
    rest = each.where((F.col("q") + F.col("most") > p.far) & (F.col("q") > 0)).select("label", "n", "fp", "copies", "text", "q")
    if hist.where("n > 0").isEmpty():
        return out
    return out.unionByName(_compared(in_blocks(rest, "label", "n", p.block).select(*columns, "q"), _verified(p, True), _LINKS))


def by_set(rows: DataFrame, facts: DataFrame, p: Similarity) -> DataFrame:
    """rows left-joined with facts (one row of few bytes for some sets, by __fp): broadcast up to a number of rows; beyond, rows of one set are spread by salts, so that copies do not land in one task."""
    if facts.count() <= p.broadcast_rows:
        return rows.join(F.broadcast(facts), "__fp", "left")
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(16)).cast("int")).join(salted, ["__fp", "__salt"], "left").drop("__salt")


def classes(rows: DataFrame, p: Similarity, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Returns (rows, nodes), both written tables. rows: those given, with __row (a number of its own for each), __fp and __sig. nodes: fp, label, links, copies, least for every set of shingles; label is equal within a class, links counts the rows of other sets that are similar, least is the row that stands for the set (order, then __row).

    rows: a column text and the columns of `order`, by which the row that stands for its copies is the least, nulls last.
    """
    bounded(rows.sparkSession)
    made: list[str] = []
    t = written(signed(rows.withColumn("__row", F.monotonically_increasing_id()), p), "signed")
    copies = F.count(F.lit(1)).alias("copies")
    least = F.min(F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], F.col("__row").alias("row"))).alias("least")
    reps = written(t.where("__fp is not null").groupBy(F.col("__fp").alias("fp")).agg(copies, least, F.first("__sig").alias("sig")), "sets", made)
    label = components(candidates(reps, p, made), made)
    sized = label.join(label.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").withColumnRenamed("v", "fp")
    stand = written(reps.join(sized, "fp").select("fp", "copies", "label", "n", F.col("least.row").alias("__row")), "stand", made)
    few = stand.count() <= p.broadcast_rows
    texts = t.select("__row", "text").join(F.broadcast(stand) if few else stand, "__row").drop("__row")
    found = written(verified(written(texts, "texts", made), p, made), "links", made)
    label = components(found.where("up is not null").select(F.col("fp").alias("a"), F.col("up").alias("b")), made).withColumnRenamed("v", "fp")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    nodes = reps.join(label, "fp", "left").join(links, "fp", "left")
    nodes = written(nodes.select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "copies", "least"), "nodes")
    removed(rows.sparkSession, made)
    return t, nodes
