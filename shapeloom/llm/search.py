"""Ranked lexical search: sort-based accumulation of impacts.

The items' terms are few and broadcast by blocks of items; each document becomes one posting row of its matched terms
and their frequencies. A task has a range of documents. It concatenates (item, document, impact) of all matches, sorts
them by packed keys with a radix sort, sums equal keys, and keeps each item's best documents on heaps. The tasks' best
are ranked once more by item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import flat
from .flat import U
from .store import bounded, removed, written


@dataclass(frozen=True)
class Impacts:
    """k: documents returned for an item. block_bytes: of item texts that are broadcast at once; more items are ranked block by block. block_items: of a block at most, so that an item's number has 16 bits. chunk: impacts that are sorted at once. salts: into which an item's best rows are dealt before they meet."""

    k: int = 10
    block_bytes: int = 8 << 20
    block_items: int = 1 << 16
    chunk: int = 2_000_000
    salts: int = 32


def _parts(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace").lower() for t in texts]


class Block:
    """Terms of some items, by hash: which items have each."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        word, at = flat.hashed(_parts(texts))
        owner = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.lexsort((owner, word))
        word, owner = word[order], owner[order]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])]) if len(word) else np.zeros(0, bool)
        word, owner = word[new], owner[new]
        self.term, first = np.unique(word, return_index=True)
        self.begin, self.item = np.append(first, len(word)).astype(np.int64), owner.astype(np.int64)

    def matched(self, word: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times), by text, then term."""
        if not len(self.term):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.term, word), len(self.term) - 1)
        hit = self.term[at] == word
        key, times = np.unique(owner[hit] * len(self.term) + at[hit], return_counts=True)
        return key // len(self.term), key % len(self.term), times


def _blocks(items: DataFrame, p: Impacts) -> Iterator[Block]:
    """All items, a block at a time on the driver."""
    ids, texts, held = [], [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        size = len((r.text or "").encode("utf-8", "replace"))
        if ids and (held + size > p.block_bytes or len(ids) == p.block_items):
            yield Block(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += size
    if ids:
        yield Block(ids, texts)


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms with repeats), term, times (arrays): a row for each document with a term. A null text has none; rows that repeat are documents of their own."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in flat.slices(whole, "text"):
                word, at = flat.hashed(_parts(b.column("text").to_pylist()))
                n = np.diff(at)
                text, term, times = sent.value.matched(word, np.repeat(np.arange(len(n)), n), len(n))
                offsets = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "term", "times"]).filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, term array<int>, times array<int>")


def _facts(posted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the documents of each term of the block."""

    def run(batches):
        n, total, df = 0, 0, np.zeros(terms, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + int(b.column("n").to_numpy().sum())
            df += np.bincount(b.column("term").flatten().to_numpy(), minlength=terms)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], k])), pa.array(np.concatenate([[n, total], df[k]]))], names=["term", "n"])

    df = np.zeros(terms, np.int64)
    got = {r.term: r.n for r in posted.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    for k, v in got.items():
        if k >= 0:
            df[k] = v
    return got.get(-1, 0), got.get(-2, 0), df


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit keys, by two passes over 16-bit digits (numpy sorts these by radix)."""
    order = np.argsort((key & U(0xFFFF)).astype(np.uint16), kind="stable")
    return order[np.argsort((key >> U(16)).astype(np.uint16)[order], kind="stable")]


def summed(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Impacts of equal (item, doc), both below 2 ** 16, summed; by item, then doc."""
    key = (item.astype(U) << U(16)) | doc.astype(U)
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    score = np.add.reduceat(impact[order], first) if len(first) else impact[:0]
    return (key[first] >> U(16)).astype(np.int64), (key[first] & U(0xFFFF)).astype(np.int64), score


class _Last:
    """An id in a heap, whose least is the worst: later ids are worse, null the worst."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other):
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id


def _best(posted: DataFrame, block: Block, n_docs: int, length: int, df: np.ndarray, p: Impacts) -> DataFrame:
    """item, doc_id, score: the best p.k documents of each item and task."""
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    sent = posted.sparkSession.sparkContext.broadcast((block.begin, block.item, weight))
    many, kind = len(block.ids), to_arrow_type(posted.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, items, w = sent.value
        heaps: list[list] = [[] for _ in range(many)]
        least = np.zeros(many, np.int64)  # a score must be above 0, and reach the worst of a full heap
        for b in batches:
            ids = b.column("doc_id")
            n = b.column("n").to_numpy()
            at = np.concatenate([[0], np.cumsum(b.column("term").value_lengths().to_numpy())])
            term, times = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "times"))
            # n * N alone may pass 64 bits where the quotient does not
            m = np.array([100 - 90 + (90 * int(x) * n_docs) // length for x in n], np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(at))
            impact = w[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
            size = begin[term + 1] - begin[term]
            ends = np.cumsum(size)[at[1:] - 1] if len(term) else np.zeros(len(n), np.int64)
            lo = 0
            while lo < len(n):
                hi = lo + 1  # whole documents, about p.chunk impacts and 2 ** 16 documents at most
                before = ends[lo - 1] if lo else 0
                hi = min(max(hi, int(np.searchsorted(ends, before + p.chunk, "right"))), lo + (1 << 16), len(n))
                s = slice(at[lo], at[hi])
                k = size[s]
                place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[term[s]], k)
                item, d, score = summed(items[place], np.repeat(doc[s] - lo, k), np.repeat(impact[s], k))
                for j in np.flatnonzero((score > 0) & (score >= least[item])):
                    i, entry = item[j], (int(score[j]), _Last(ids[int(d[j]) + lo].as_py()))
                    if len(heaps[i]) < p.k:
                        heapq.heappush(heaps[i], entry)
                    else:
                        heapq.heappushpop(heaps[i], entry)
                    if len(heaps[i]) == p.k:
                        least[i] = heaps[i][0][0]
                lo = hi
        rows = [(i, e[1].id, e[0]) for i, h in enumerate(heaps) for e in h]
        for lo in range(0, len(rows), 10_000):
            part = list(zip(*rows[lo : lo + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], kind), pa.array(part[2], pa.int64())], names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, f"item int, doc_id {posted.schema['doc_id'].dataType.simpleString()}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, p: Impacts = Impacts()) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's p.k best documents with a score above 0.

    docs: doc_id, text; items: item_id, text. Terms are runs of ASCII letters and digits and of characters above 0x7F,
    A-Z in lower case. Equal scores go by doc_id, null last. Items that repeat whole are one; of one id with several
    texts each text is ranked for itself. Null and empty texts match nothing; other columns are ignored. The result is
    a written table.
    """
    spark = docs.sparkSession
    bounded(spark)
    made: list[str] = []
    out = None
    for block in _blocks(items.select("item_id", "text").distinct(), p):
        posted = written(postings(docs, block), "postings", made)
        n, length, df = _facts(posted, len(block.term))
        found = _best(posted, block, n, length, df, p)
        # an item's rows meet in two steps, as there are k from every task
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(p.salts)))
        few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= p.k)
        best = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= p.k)
        names = spark.createDataFrame(list(enumerate(block.ids)), items.select(F.lit(0).alias("item"), "item_id").schema)
        best = written(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        removed(spark, made)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return docs.limit(0).join(items.select("item_id").limit(0)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM w WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
t AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
i AS MATERIALIZED (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term), s),
p AS MATERIALIZED (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))) AS impact FROM t JOIN d USING (r) JOIN f USING (term), s WHERE term IN (SELECT term FROM i)),
a AS (SELECT item_id, text, r, sum(impact)::BIGINT AS score FROM i JOIN p USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM a JOIN d USING (r)
QUALIFY rank <= 10"""
