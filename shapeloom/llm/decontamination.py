"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros is laid over the words from each position; the words under its ones are hashed, so a hit
survives substitutions under its zeros. Around hits the texts are compared word by word along the same diagonal, and
the run with the most equal words counts. A
benchmark of bounded bytes is indexed and broadcast; beyond, the hashes of both sides are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import flat
from .flat import U, mix
from .store import bounded, written


@dataclass(frozen=True)
class Seeds:
    """masks: fixed seeds of weight 8, for items of `short` words or more. short_masks: of weight 5, for shorter ones; items under 10 words are looked up whole, from 5 words on with any one word left out. min_words, min_share: an overlap counts if it has this many equal words, or all but a fifth of a shorter item, and this share of equal words. block_bytes: of benchmark texts up to which they are broadcast. bits: of the table by which the texts' hashes are sifted before a join (2 to that power). broadcast_keys: of leaked texts, up to which they are broadcast."""

    masks: tuple[str, ...] = ("11111111", "1101100110101", "10110101011001")
    short_masks: tuple[str, ...] = ("11111", "1100111", "1101101", "110010101", "1010011001")
    short: int = 40
    min_words: int = 12
    min_share: float = 0.8
    block_bytes: int = 16 << 20
    bits: int = 27
    broadcast_keys: int = 1_000_000

    def laid(self) -> list[tuple[str, int, int]]:
        """(mask, least, most): every mask with the sizes of the items it is for; a mask as long as these is laid over their first word only."""
        out = [(m, self.short, 1 << 40) for m in self.masks] + [(m, 10, self.short - 1) for m in self.short_masks]
        for n in range(1, 10):
            out += [("1" * n, n, n)] if n < 5 else [("1" * k + "0" + "1" * (n - k - 1), n, n) for k in range(n)]
        return out

    def need(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(self.min_words, np.ceil(0.8 * size).astype(np.int64))


def masked(word: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under the mask at all positions where it fits in its text, and these positions."""
    n = len(word) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                h = h * U(0xC2B2AE3D27D4EB4F) + word[k : k + n]
        h = mix(h + U(int(mask, 2) + (len(mask) << 20)))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return h[ok], ok


def item_seeds(word: np.ndarray, at: np.ndarray, seeds: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all items under the masks for their sizes, and their places."""
    size = np.diff(at)
    hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for mask, least, most in seeds.laid():
        if ((size >= least) & (size <= most)).any():
            h, ok = masked(word, at, mask)
            own = size[np.searchsorted(at, ok, "right") - 1]
            fits = (own >= least) & (own <= most)
            hashes.append(h[fits])
            places.append(ok[fits])
    return np.concatenate(hashes), np.concatenate(places)


def _starts(h: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Which hashes differ from that of the position before: of places in runs of one hash, the others lie on the same diagonals."""
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (ok[1:] != ok[:-1] + 1)
    return out


def overlap(word: np.ndarray, begin: int, end: int, item: np.ndarray, diagonal: int, seeds: Seeds) -> tuple[int, int, int] | None:
    """(equal words, words compared, first word in the text) on a diagonal (place in the text less place in the item): of all runs with min_share of equal words or more, one with the most of them; of these the shortest, then the first. None if it has fewer than the item needs."""
    low, high = max(begin, diagonal), min(end, diagonal + len(item))
    equal = word[low:high] == item[low - diagonal : high - diagonal]
    count = np.concatenate([[0], np.cumsum(equal)])
    if count[-1] < seeds.need(np.array([len(item)]))[0]:
        return None
    # a run from a to b has its share if surplus[b] >= surplus[a]; the first such a has the most equal words
    surplus = count * 1_000_000 - np.arange(len(count)) * round(seeds.min_share * 1_000_000)
    b = np.flatnonzero(equal) + 1
    a = np.searchsorted(-np.minimum.accumulate(surplus), -surplus[b])
    at = np.flatnonzero(equal)
    a = at[np.searchsorted(at, a)]  # to the next equal word
    n, m = count[b] - count[a], b - a
    k = np.lexsort((a, m, -n))[0]
    return (int(n[k]), int(m[k]), int(low + a[k] - begin)) if n[k] >= seeds.need(np.array([len(item)]))[0] else None


def best(word: np.ndarray, begin: int, end: int, item: np.ndarray, diagonals, seeds: Seeds) -> tuple[int, int, int] | None:
    """The best overlap of a text and an item on some diagonals; none better than the whole item is sought."""
    found = None
    for d in diagonals:
        got = overlap(word, begin, end, item, int(d), seeds)
        if got and (found is None or (got[0], -got[1], -got[2]) > (found[0], -found[1], -found[2])):
            found = got
            if got[0] == len(item):
                break
    return found


class Index:
    """Masked hashes of items, sorted, with a bit table before the search."""

    #: Pairs of places looked at together.
    PAIRS = 1 << 20

    def __init__(self, ids: list, texts: list[str], seeds: Seeds):
        self.ids, self.seeds = ids, seeds
        self.word, self.at = flat.words(texts)
        size = np.diff(self.at)
        self.laid = [x for x in seeds.laid() if ((size >= x[1]) & (size <= x[2])).any()]
        h, ok = item_seeds(self.word, self.at, seeds)
        order = np.lexsort((ok, h))
        self.hash, self.place = h[order], ok[order]
        first = _starts(self.hash, self.place)
        self.first_hash, self.first_place = self.hash[first], self.place[first]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> U(42)).astype(np.int64)] = True

    def _pairs(self, h: np.ndarray, ok: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        keep = hi > lo
        ok, lo, n = ok[keep], lo[keep], (hi - lo)[keep]
        for begin, end in self._portions(n):
            k = n[begin:end]
            yield np.repeat(ok[begin:end], k), places[np.repeat(lo[begin:end], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]

    def _portions(self, n: np.ndarray) -> Iterator[tuple[int, int]]:
        begin = 0
        while begin < len(n):
            end = max(begin + 1, int(np.searchsorted(np.cumsum(n[begin:]), self.PAIRS)) + begin)
            yield begin, end
            begin = end

    def _run_pairs(self, h: np.ndarray, ok: np.ndarray, first: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs for the later places of runs of one hash in a text. Where the whole item lies inside such a run of one word, all diagonals are equal, and the run's first place has them; so only those near its ends are looked at."""
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(h)))
        begin, size = begin[size > 1], size[size > 1]
        lo, hi = np.searchsorted(self.first_hash, h[begin], "left"), np.searchsorted(self.first_hash, h[begin], "right")
        for x, y in self._portions(hi - lo):
            k = (hi - lo)[x:y]
            place = self.first_place[np.repeat(lo[x:y], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            start, n = np.repeat(ok[begin[x:y]], k), np.repeat(size[x:y], k)
            item = np.searchsorted(self.at, place, "right") - 1
            inside = place - self.at[item]
            last = start + n - 1
            # from start + length - 1 to last all words are surely one, whatever stands under the mask's zeros
            near = np.minimum(last, start + inside + length)  # the item begins before them, or with them
            far = np.maximum(near + 1, last + 2 - (self.at[item + 1] - self.at[item]) + inside)  # it ends after them
            for one, other in ((start + 1, near + 1), (far, last + 1)):
                many = np.maximum(other - one, 0)
                for u, v in self._portions(many):
                    m = many[u:v]
                    yield np.repeat(one[u:v], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m), np.repeat(place[u:v], m)

    def candidates(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (text, item, diagonal within the text) on which a mask agrees and enough words are equal."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, _, _ in self.laid:
            h, ok = masked(word, at, mask)
            maybe = self.bits[(h >> U(42)).astype(np.int64)]
            h, ok = h[maybe], ok[maybe]
            first = _starts(h, ok)
            for pairs in (self._pairs(h[first], ok[first], self.hash, self.place), self._run_pairs(h, ok, first, len(mask))):
                for x, place in pairs:
                    doc, item = np.searchsorted(at, x, "right") - 1, np.searchsorted(self.at, place, "right") - 1
                    found.append(np.unique(np.stack([doc, item, (x - at[doc]) - (place - self.at[item])], 1), axis=0))
        rows = np.unique(np.concatenate(found), axis=0)
        size = (self.at[rows[:, 1] + 1] - self.at[rows[:, 1]]) if len(rows) else np.zeros(0, np.int64)
        keep = np.zeros(len(rows), bool)
        order = np.argsort(size, kind="stable")
        begin = 0
        while begin < len(order):
            end = min(len(order), begin + max(1, self.PAIRS // int(size[order[begin]])))
            some = order[begin:end]
            width = np.arange(int(size[some].max()))
            x = at[rows[some, 0]][:, None] + rows[some, 2][:, None] + width
            inside = (width < size[some][:, None]) & (x >= at[rows[some, 0]][:, None]) & (x < at[rows[some, 0] + 1][:, None])
            y = np.minimum(self.at[rows[some, 1]][:, None] + width, len(self.word) - 1)
            equal = (inside & (word[np.clip(x, 0, len(word) - 1)] == self.word[y])).sum(1)
            keep[some] = equal >= self.seeds.need(size[some])
            begin = end
        return rows[keep]

    def matches(self, word: np.ndarray, at: np.ndarray) -> list[tuple]:
        """(text, item, equal words, compared words, first word in the text, words of the item): the best overlap of each text and item."""
        out = []
        rows = self.candidates(word, at)
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        for begin, end in zip([0, *cut], [*cut, len(rows)]) if len(rows) else ():
            doc, item = int(rows[begin, 0]), int(rows[begin, 1])
            got = best(word, at[doc], at[doc + 1], self.word[self.at[item] : self.at[item + 1]], at[doc] + rows[begin:end, 2], self.seeds)
            if got:
                out.append((doc, item, *got, int(self.at[item + 1] - self.at[item])))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    bounded(benchmark.sparkSession)
    return benchmark.select("item_id", "text").where("text is not null")


def _index(benchmark: DataFrame, seeds: Seeds):
    """A broadcast index of the benchmark, or none where its texts are larger than a block."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > seeds.block_bytes:
        return None
    rows = items.orderBy("item_id", "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], seeds))


def _key() -> Column:
    """Rows of one id and text share their candidates; a collision only adds some that are not verified."""
    return F.xxhash64("doc_id", "text").alias("__key")


def _joined(docs: DataFrame, benchmark: DataFrame, seeds: Seeds) -> DataFrame:
    """__key, doc_id, item_id and the overlap, from hashes of both sides joined by shuffle. The texts' hashes are sifted by a table of bits of fixed size first."""
    items = written(_items(benchmark).withColumn("__item", F.monotonically_increasing_id()), "items")

    def of_items(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                word, at = flat.words(b.column("text").to_pylist())
                h, ok = item_seeds(word, at, seeds)
                item = np.searchsorted(at, ok, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("__item").take(pa.array(item)), pa.array(ok - at[item])], names=["h", "item", "place"])

    hashes = written(items.select("__item", "text").mapInArrow(of_items, "h bigint, item bigint, place bigint"), "seeds")
    slot = F.shiftrightunsigned("h", 64 - seeds.bits)
    words = hashes.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - seeds.bits}) & 31 as int))")).alias("b")).toPandas()
    table = np.zeros(1 << (seeds.bits - 5), np.uint32)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    sieve = docs.sparkSession.sparkContext.broadcast(table)

    def of_texts(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                word, at = flat.words(b.column("text").to_pylist())
                for mask, _, _ in seeds.laid():
                    h, ok = masked(word, at, mask)
                    k = h >> U(64 - seeds.bits)
                    hit = (sieve.value[(k >> U(5)).astype(np.int64)] >> (k & U(31)).astype(np.uint32)) & 1 == 1
                    h, ok = h[hit], ok[hit]
                    doc = np.searchsorted(at, ok, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("__key").take(pa.array(doc)), pa.array(ok - at[doc])], names=["h", "__key", "x"])

    keyed = docs.where("text is not null").select("doc_id", "text", _key())
    hits = keyed.select("__key", "text").mapInArrow(of_texts, "h bigint, __key bigint, x bigint").join(hashes, "h")
    pairs = hits.select("__key", "item", (F.col("x") - F.col("place")).alias("d")).distinct().groupBy("__key", "item").agg(F.collect_list("d").alias("diagonals"))
    rows = keyed.join(pairs, "__key").join(items.select(F.col("__item").alias("item"), "item_id", F.col("text").alias("item_text")), "item")
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("__key", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item_type), *(T.StructField(c, T.LongType()) for c in ("n_equal", "n_compared", "first_word", "item_words")), T.StructField("coverage", T.DoubleType())])

    def verify(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                found = []
                for i, (text, item, diagonals) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "item_text", "diagonals")))):
                    (word, at), (other, _) = flat.words([text]), flat.words([item])
                    got = best(word, 0, at[1], other, sorted(diagonals), seeds)
                    if got:
                        found.append((i, *got, len(other), got[0] / len(other)))
                if found:
                    i, *rest = zip(*found)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([b.column("__key").take(take), b.column("doc_id").take(take), b.column("item_id").take(take), *(pa.array(c, pa.int64()) for c in rest[:4]), pa.array(rest[4])], names=schema.names)

    return rows.select("__key", "doc_id", "text", "item_id", "item_text", "diagonals").mapInArrow(verify, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """doc_id, item_id, n_equal, n_compared, first_word, item_words, coverage: every document row and item that overlap.

    Words are compared in lower case without punctuation. Null and empty texts overlap with nothing, an empty
    benchmark or table gives no rows, repeated rows give repeated results, null ids are carried, ids may be of any type.
    Other columns are ignored.
    """
    index = _index(benchmark, seeds)
    if index is None:
        return _joined(docs, benchmark, seeds).drop("__key")
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item_type), *(T.StructField(c, T.LongType()) for c in ("n_equal", "n_compared", "first_word", "item_words")), T.StructField("coverage", T.DoubleType())])
    arrow = to_arrow_type(item_type)

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                x = index.value
                found = x.matches(*flat.words(b.column("text").to_pylist()))
                if found:
                    doc, item, n, m, first, size = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array([x.ids[i] for i in item], arrow), *[pa.array(c, pa.int64()) for c in (n, m, first, size)], pa.array([a / s for a, s in zip(n, size)])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """The rows of docs that overlap with no item, as they are."""
    index = _index(benchmark, seeds)
    if index is None:
        leaked = written(_joined(docs, benchmark, seeds).select("__key").distinct(), "leaked")
        return docs.join(F.broadcast(leaked) if leaked.count() <= seeds.broadcast_keys else leaked, F.xxhash64("doc_id", "text") == F.col("__key"), "left_anti")

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in index.value.matches(*flat.words(b.column("text").to_pylist()))]] = False
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
