"""Language-model scores by prediction by partial matching (PPM) over bytes.

A context trie over the last `order` bytes gives each byte its probability: the longest known context predicts it, or
escapes (method C: as often as the context has different symbols) to the next shorter one, where symbols of the longer
context are excluded. All counts follow from those of the longest n-grams, which are gathered from every text. The
trie is dealt out by the last bytes of its contexts, so that a task has whole subtrees and works out the log
probability of each of its n-grams; the upper levels have a fixed number of nodes and are broadcast. A text's score is
then the sum over its n-grams: the most frequent ones, a fixed number, are looked up in place, the rest by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .flat import U
from .store import bounded, written

#: Never a byte of UTF-8: stands before a text, and once after it.
EDGE = 0xFF
#: Symbols of the order below all contexts.
SYMBOLS = 256
GRAM, WORD = 0, 1
#: The token after the last word.
END = 0


@dataclass(frozen=True)
class Trie:
    """order: bytes of the longest context, 3 to 5. head: most frequent n-grams and words, whose values are broadcast (24 bytes each); those of the others, which no text shares with many, are joined. held: n-grams that a task merges before it passes them on."""

    order: int = 5
    head: int = 2_000_000
    held: int = 1_000_000

    def __post_init__(self):
        if not 3 <= self.order <= 5:
            raise ValueError("order is 3 to 5")


def _parts(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z in lower case; a null text is empty."""
    return [(t or "").encode("utf-8", "replace").lower() for t in texts]


def grams(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every byte and every text's end: its context, the last byte first, then itself. And where each text's keys begin."""
    before, after = bytes([EDGE]) * order, bytes([EDGE])
    raw = np.frombuffer(b"".join(x for p in parts for x in (before, p, after)), np.uint8).astype(U)
    size = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    n = max(0, len(raw) - order)
    key = raw[order:].copy()
    for d in range(1, order + 1):
        key |= raw[order - d : order - d + n] << U(8 * (order + 1 - d))
    begin = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(n, bool)
    for d in range(order):  # the bytes before the next text predict nothing
        keep[begin[1:-1] + order * np.arange(len(parts) - 1) + d] = False
    return key[keep], begin


def _tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return flat.hashed(parts, flat.NOT_SPACE)


def _merged(key: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(x[order], first) if len(first) else x[:0] for x in n)


def _distinct(key: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, how often they stand where learn is set, and how often in all."""
    learnt, key = np.sort(key[learn]), np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    every = np.diff(np.append(first, len(key)))
    key = key[first]
    return key, np.searchsorted(learnt, key, "right") - np.searchsorted(learnt, key, "left"), every


def counts(docs: DataFrame, learn: Column, p: Trie = Trie()) -> DataFrame:
    """kind, key, n, m: every n-gram (GRAM) and word (WORD) of docs(text), how often rows with `learn` have it, and how often all have."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}

        def out(kind: int, least: int):
            if held[kind]:
                x = _merged(*(np.concatenate(c) for c in zip(*held[kind])))
                held[kind] = [x]
                if len(x[0]) > least:
                    held[kind] = []
                    for lo in range(0, len(x[0]), 1 << 18):
                        k, n, m = (c[lo : lo + (1 << 18)] for c in x)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n), pa.array(m)], names=["kind", "key", "n", "m"])

        for whole in batches:
            for b in flat.slices(whole, "text", 2 << 20):
                parts, flag = _parts(b.column("text").to_pylist()), b.column("learn").to_numpy(zero_copy_only=False).astype(bool)
                key, at = grams(parts, p.order)
                held[GRAM].append(_distinct(key, np.repeat(flag, np.diff(at))))
                key, at = _tokens(parts)
                held[WORD].append(_distinct(key, np.repeat(flag, np.diff(at))))
                held[WORD].append((np.array([END], U), np.array([flag.sum()], np.int64), np.array([len(flag)], np.int64)))
                for kind in held:
                    if sum(len(x[0]) for x in held[kind]) > 2 * p.held:
                        yield from out(kind, p.held)
        for kind in held:
            yield from out(kind, 0)

    rows = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(run, "kind int, key bigint, n bigint, m bigint")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Upper:
    """Counts of the contexts of fewer than `levels` bytes. At most 256 ** levels n-grams, whatever the corpus."""

    def __init__(self, key: np.ndarray, n: np.ndarray, levels: int):
        self.levels, self.gram, self.context = levels, {}, {}
        key, n = _merged(key, n)
        for j in range(levels - 1, -1, -1):
            self.gram[j] = key, n
            ctx, first = np.unique(key >> U(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            self.context[j] = ctx, total, np.diff(np.append(first, len(key)))
            key, n = _merged(((key >> U(16)) << U(8)) | (key & U(0xFF)), n) if j else (key, n)
        self.known = {}
        for j in range(1, levels):  # what the shorter context counts of the longer one's symbols
            key, _ = self.gram[j]
            less = self.count(j - 1, ((key >> U(16)) << U(8)) | (key & U(0xFF)))
            _, first = np.unique(key >> U(8), return_index=True)
            self.known[j] = np.add.reduceat(less, first) if len(first) else less

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, values[at], 0)

    def count(self, j: int, gram: np.ndarray) -> np.ndarray:
        return self._found(*self.gram[j], gram)

    def facts(self, j: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, symbols and (for j > 0) what the shorter context counts of these symbols."""
        keys, total, symbols = self.context[j]
        known = self.known[j] if j else np.zeros(len(keys), np.int64)
        return self._found(keys, total, ctx), self._found(keys, symbols, ctx), self._found(keys, known, ctx)


def log_probabilities(key: np.ndarray, n: np.ndarray, upper: Upper, order: int) -> np.ndarray:
    """log10 of the last symbol's probability after its context. key: sorted, each once, with all n-grams of the contexts that end alike (their last upper.levels bytes); n: how often each was learned."""
    symbol = key & U(0xFF)
    context = [key >> U(8 + 8 * (order - j)) for j in range(order + 1)]
    count, total, symbols, known, reps = [], [], [], [], []
    for j in range(order + 1):
        gram = (context[j] << U(8)) | symbol
        if j < upper.levels:
            count.append(upper.count(j, gram))
            t, d, a = upper.facts(j, context[j])
        else:
            _, row, of = np.unique(gram, return_index=True, return_inverse=True)
            count.append(np.bincount(of, n, len(row)).astype(np.int64)[of])
            row = row[count[j][row] > 0]
            own = np.cumsum(np.concatenate([[0], context[j][1:] != context[j][:-1]])) if len(key) else np.zeros(0, np.int64)
            size = int(own[-1]) + 1 if len(own) else 0
            t = np.bincount(own, n, size).astype(np.int64)[own]
            d = np.bincount(own[row], minlength=size)[own]
            a = np.bincount(own[row], count[j - 1][row], size).astype(np.int64)[own]
        total.append(t)
        symbols.append(d)
        known.append(a)
    out, going, longer = np.zeros(len(key)), np.ones(len(key), bool), np.zeros(len(key), bool)
    for j in range(order, -1, -1):
        more = known[j + 1] * longer if j < order else 0
        seen = symbols[j + 1] * longer if j < order else 0
        left, kinds = total[j] - more, symbols[j] - seen
        hit = going & (count[j] > 0)
        out[hit] += np.log10(count[j][hit] / (left[hit] + kinds[hit]))
        going &= ~hit
        escape = going & (left > 0)
        out[escape] += np.log10(kinds[escape] / (left[escape] + kinds[escape]))
        longer |= total[j] > 0
    out[going] -= np.log10(SYMBOLS - symbols[0][going])
    return out


def values(counted: DataFrame, p: Trie = Trie()) -> DataFrame:
    """kind, key, m, value: the log10 probability of each n-gram's last byte; of each word how often it was learned."""
    spark, levels = counted.sparkSession, p.order - 2
    found = counted.where(F.col("kind") == GRAM).select("key", "n", "m")
    top = F.shiftleft(F.shiftright("key", 8 * (p.order + 2 - levels)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFF)))
    # at most 2 ** 24 rows at order 5, one for each context of two bytes and its next byte
    rows = found.where("n > 0").groupBy(top.alias("key")).agg(F.sum("n").alias("n")).toPandas()
    upper = spark.sparkContext.broadcast(Upper(rows["key"].to_numpy(np.int64).view(U), rows["n"].to_numpy(np.int64), levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in flat.runs(batches, "root"):
            key, n, m = (t.column(c).combine_chunks().to_numpy() for c in ("key", "n", "m"))
            v = log_probabilities(key.view(U), n, upper.value, p.order)
            for lo in range(0, len(key), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 18)]) for x in (key, m, v)], names=["key", "m", "value"])

    # a root's subtree has two levels and its symbols: at most 2 ** 24 rows
    roots = found.withColumn("root", F.shiftright("key", 8 * (p.order + 1 - levels))).repartition("root").sortWithinPartitions("root", "key")
    out = roots.mapInArrow(run, "key bigint, m bigint, value double").select(F.lit(GRAM).alias("kind"), "key", "m", "value")
    return out.unionByName(counted.where(F.col("kind") == WORD).select("kind", "key", "m", F.col("n").cast("double").alias("value")))


class Lookup:
    """Values by key: open addressing in one array, filled and read by whole arrays."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(key)).bit_length())
        slot = self._slot(key)
        order = np.argsort(slot, kind="stable")
        at = np.arange(len(key)) + np.maximum.accumulate(slot[order] - np.arange(len(key))) if len(key) else np.zeros(0, np.int64)
        size = (1 << self.bits) + len(key) + 1
        self.key, self.value, self.full = np.zeros(size, U), np.zeros(size), np.zeros(size, bool)
        self.key[at], self.value[at], self.full[at] = key[order], value[order], True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 for unknown keys, and which are known."""
        at = self._slot(key)
        left = np.flatnonzero((self.key[at] != key) & self.full[at])
        while len(left):
            at[left] += 1
            left = left[(self.key[at[left]] != key[left]) & self.full[at[left]]]
        return self.value[at], self.full[at]


_made: dict[str, tuple[Lookup, Lookup]] = {}


_OUT = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}


def _least(counted: DataFrame, most: int) -> int:
    """The least m of which, with all above, there are at most `most` keys."""
    rows = counted.groupBy(F.least("m", F.lit(1 << 16)).alias("m")).count().collect()
    held = 0
    for m, n in sorted(((r["m"], r["count"]) for r in rows), reverse=True):
        if held + n > most:
            return m + 1
        held += n
    return 0


def _first_sums(docs: DataFrame, head: DataFrame, learned: int, different: int, p: Trie) -> DataFrame:
    """docs with a number for each row, the sums over what the head has, and the keys that it has not."""

    def packed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column("kind")[0].as_py()], pa.int32()), *(pa.array([b.column(c).to_numpy().tobytes()]) for c in ("key", "value"))], names=["kind", "key", "value"])

    spark, sent = docs.sparkSession, {}
    for kind in (GRAM, WORD):
        rows = head.where(F.col("kind") == kind).mapInArrow(packed, "kind int, key binary, value binary").collect()
        sent[kind] = np.frombuffer(b"".join(r.key for r in rows), np.int64).view(U), np.frombuffer(b"".join(r.value for r in rows), np.float64)
    known = spark.sparkContext.broadcast(sent)
    name = f"{spark.sparkContext.applicationId}-{known._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:  # once for each worker
            _made.clear()
            _made[name] = tuple(Lookup(*known.value[k]) for k in (GRAM, WORD))
        gram, word = _made[name]
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in flat.slices(whole, "text"):
                parts = _parts(b.column("text").to_pylist())
                key, at = grams(parts, p.order)
                value, have = gram.of(key)
                score = np.add.reduceat(value, at[:-1]) if len(parts) else np.zeros(0)
                rest = [_lists(key, have, at)]
                key, at = _tokens(parts)
                key, at = np.insert(key, at[1:], U(END)), at + np.arange(len(at))
                value, have = word.of(key)
                rest.append(_lists(key, have, at))
                of = np.repeat(np.arange(len(parts)), np.diff(at))
                base = np.bincount(of[have], np.log10((value[have] + 1) / (learned + (different + 1))), len(parts)).astype(np.float64)
                n_known = np.bincount(of[value > 0], minlength=len(parts))
                own = np.arange(row, row + len(parts))
                row += len(parts)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (own, np.diff(at), n_known, base, score)), *rest], names=[*b.schema.names, "__row", "n_tokens", "__known", "__base", "__score", "__grams", "__words"])

    added = {"__row": "bigint", "n_tokens": "bigint", "__known": "bigint", "__base": "double", "__score": "double", "__grams": "array<bigint>", "__words": "array<bigint>"}
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items())]))


def _lists(key: np.ndarray, have: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Each text's keys that are not known."""
    before = np.concatenate([[0], np.cumsum(~have)])
    return pa.ListArray.from_arrays(pa.array(before[at].astype(np.int32)), pa.array(key[~have].view(np.int64)))


def scored(docs: DataFrame, learn: Column | None = None, trained: DataFrame | None = None, p: Trie = Trie()) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score; columns of these names are replaced.

    learn: which rows of docs teach (none if it is missing); trained: counts() of another corpus, added to theirs.
    score is the log10 probability of the whole text, bytes and end, in lower case (A-Z), base_score that of its words
    and its end by add-one word counts. Null and empty texts have only an end. Where nothing was learned all bytes
    are equally likely. Repeated rows are learned as often as they stand there and get equal scores.
    """
    spark = docs.sparkSession
    bounded(spark)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _OUT])
    counted = counts(docs, F.lit(False) if learn is None else learn, p)
    if trained is not None:
        counted = counted.unionByName(trained.select("kind", "key", "n", F.lit(0).cast("long").alias("m"))).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    counted = written(counted, "counts")
    sums = counted.where((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    learned, different = sums[0], sums[1]
    table = written(values(counted, p), "values")
    least = _least(counted.where("m > 0"), p.head)
    known = written(_first_sums(docs, table.where(F.col("m") >= max(least, 1)), learned, different, p), "sums")
    out = known
    if least:
        # a key of the rest stands in fewer than `least` places, so none is hot
        rest = known.select("__row", F.lit(GRAM).alias("kind"), F.explode("__grams").alias("key")).unionByName(known.select("__row", F.lit(WORD).alias("kind"), F.explode("__words").alias("key")))
        rest = rest.join(table.where(F.col("m") < least).select("kind", "key", "value"), ["kind", "key"])
        word = F.col("kind") == WORD
        log = F.log10((F.col("value") + 1) / F.lit(float(learned + different + 1)))
        more = rest.groupBy("__row").agg(F.sum(F.when(~word, F.col("value"))).alias("__s"), F.sum(F.when(word, log)).alias("__b"), F.sum((word & (F.col("value") > 0)).cast("long")).alias("__k"))
        out = known.join(more, "__row", "left")
        more = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("__s", "__b", "__k")}
    else:
        more = {c: F.lit(0) for c in ("__s", "__b", "__k")}
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, "n_tokens", (F.col("__known") + more["__k"]).cast("long").alias("n_known"), F.lit(learned).cast("long").alias("train_tokens"), (F.col("__base") + more["__b"]).alias("base_score"), (F.col("__score") + more["__s"]).alias("score"))


def adaptive(text: str | None, order: int = 5) -> float:
    """log10 probability of one text and its end by a trie that starts empty and learns each byte after it is coded."""
    data = _parts([text])[0] + bytes([EDGE])
    held, trie = bytes([EDGE]) * order, {}
    out = 0.0
    for symbol in data:
        excluded: set[int] = set()
        path = [held[len(held) - j :] for j in range(order, -1, -1)]
        for ctx in path:
            seen = trie.get(ctx)
            if seen:
                left = sum(c for s, c in seen.items() if s not in excluded)
                kinds = sum(s not in excluded for s in seen)
                if symbol in seen:
                    out += np.log10(seen[symbol] / (left + kinds))
                    break
                if left:
                    out += np.log10(kinds / (left + kinds))
                excluded |= seen.keys()
        else:
            out -= np.log10(SYMBOLS - len(excluded))
        for ctx in path:
            own = trie.setdefault(ctx, {})
            own[symbol] = own.get(symbol, 0) + 1
        held = (held + bytes([symbol]))[-order:]
    return float(out)


def adaptively_scored(docs: DataFrame, p: Trie = Trie()) -> DataFrame:
    """docs with score: each text's log10 probability by a trie of its own (a bound on what it repeats within itself)."""
    bounded(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([adaptive(t, p.order) for t in b.column("text").to_pylist()], pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """The fold that teaches nothing: crc32 of the id as text, modulo 7, is 2. A null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = scored(docs, learn=~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
