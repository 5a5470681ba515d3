"""Exact repeats of windows of words that run across lines, wherever they begin.

Every window of a text (stride 1) has a seed: the least hash of the shorter runs of words in it. Equal windows have
equal seeds, and neighbours mostly share one, so windows travel in packed rows by seed, and only those whose seed
stands in two documents. Windows are equal if seed and window hash (64 bits each) are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .flat import U, mix
from .store import bounded, written

_STEP = 0xD6E8FEB86659FD93
#: Words as flat.words counts them, in a text as it stands.
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


@dataclass(frozen=True)
class Windows:
    """words: of a window, the shortest passage found. seed: words of a seed. broadcast_seeds: up to which the shared seeds are broadcast; beyond, the join shuffles. hot: rows of a seed beyond which its windows are aggregated and joined, so that no task holds them all."""

    words: int = 50
    seed: int = 25
    broadcast_seeds: int = 4_000_000
    hot: int = 4096


def _rolled(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from runs of powers of two."""
    out, done, part, size = None, 0, word, 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out = part if out is None else out[: max(0, len(word) - done - size + 1)] * U(pow(_STEP, size, 1 << 64)) + part[done:]
                done += size
            if done == n:
                return mix(out)
            part = part[: max(0, len(part) - size)] * U(pow(_STEP, size, 1 << 64)) + part[size:]
            size *= 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all n neighbours."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :])


def windows(word: np.ndarray, at: np.ndarray, p: Windows) -> tuple[np.ndarray, ...]:
    """(text, first window, seed, begin) of every run of windows with one seed, and the hashes of all windows, in which begin (one entry more at the end) points."""
    n = len(word) - p.words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    least = _least(_rolled(word, p.seed), p.words - p.seed + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(owner[:n] == owner[p.words - 1 :])
    least = least[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(ok) != 1)
    begin = np.flatnonzero(new)
    text = owner[ok[begin]]
    return text, ok[begin] - at[text], least[begin].view(np.int64), np.append(begin, len(ok)), _rolled(word, p.words)[ok].view(np.int64)


def _shared(keyed: DataFrame, p: Windows) -> DataFrame:
    """seed, n: seeds of two documents or more, and their rows."""

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                text, _, seed, _, _ = windows(*flat.words(b.column("text").to_pylist()), p)
                yield pa.RecordBatch.from_arrays([pa.array(seed), b.column("row").take(pa.array(text))], names=["seed", "row"])

    seeds = keyed.select("row", "text").mapInArrow(run, "seed bigint, row bigint")
    return written(seeds.groupBy("seed").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("seed", "n"), "seeds")


def _packed(shared: DataFrame) -> np.ndarray:
    """The seeds in order. They come to the driver as bytes, a row for each batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column("seed").to_numpy().tobytes()])], names=["seeds"])

    return np.sort(np.frombuffer(b"".join(r.seeds for r in shared.select("seed").mapInArrow(run, "seeds binary").toLocalIterator()), np.int64))


def _first(batches):
    """Of rows sorted by seed: runs of windows that another document has too, with the least document that has them."""
    for t in flat.runs(batches, "seed"):
        t = t.combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text_key", "ascending"), ("first", "ascending")], null_placement="at_end")).combine_chunks()
        doc = pc.fill_null(t.column("doc_id").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        text, pos, seed = (t.column(c).to_numpy() for c in ("text_key", "first", "seed"))
        number = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))])
        held = t.column("win").combine_chunks()
        size = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        w, row = held.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        at = pos[row] + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((w, seed[row]))  # stable: equal windows stay in the order of documents
        ws, rs = w[order], seed[row][order]
        begin = np.flatnonzero(np.concatenate([[True], (ws[1:] != ws[:-1]) | (rs[1:] != rs[:-1])]))
        end = np.append(begin[1:], len(ws))
        own = np.repeat(np.arange(len(begin)), end - begin)
        source, many = np.empty(len(w), np.int64), np.empty(len(w), bool)
        source[order] = order[begin][own]
        many[order] = (number[row[order[begin]]] != number[row[order[end - 1]]])[own]
        k = np.flatnonzero(many)
        if not len(k):
            continue
        r, s = row[k], row[source[k]]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (np.diff(k) != 1) | (number[s[1:]] != number[s[:-1]])])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(k)) - 1
        doc_id = t.column("doc_id").combine_chunks()
        for lo in range(0, len(a), 10_000):
            i, j = a[lo : lo + 10_000], b[lo : lo + 10_000]
            x, y = r[i], s[i]
            yield pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(x)), pa.array(text[x]), pa.array(at[k[i]]), pa.array(at[k[j]]), doc_id.take(pa.array(y)), pa.array(text[y]), pa.array(at[source[k[i]]]), pa.array(number[x] != number[y])],
                names=["doc_id", "text_key", "first", "last", "class_doc", "class_key", "class_word", "removed"],
            )


def repeated_passages(docs: DataFrame, p: Windows = Windows()) -> DataFrame:
    """Every passage of p.words words or more that stands in another document too.

    doc_id, text_key, first_word (from 0), n_words, class_doc, class_key, class_word (the least document that has the
    windows, by doc_id, then text: its passage stays), removed. Words are runs of letters and digits in lower case.
    Null and short texts have no passages; rows repeated with one doc_id and text are one document; a null doc_id
    sorts last. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded(spark)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64("doc_id", "text").alias("row"), "text").where("text is not null")
    shared = _shared(keyed, p)
    few = shared.count() <= p.broadcast_seeds
    known = spark.sparkContext.broadcast(_packed(shared) if few else None)

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                text, first, seed, begin, w = windows(*flat.words(b.column("text").to_pylist()), p)
                keep = np.ones(len(seed), bool)
                if known.value is not None:
                    at = np.searchsorted(known.value, seed)
                    keep = at < len(known.value)
                    keep[keep] = known.value[at[keep]] == seed[keep]
                size = np.diff(begin)
                win = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)), pa.array(w[np.repeat(keep, size)]))
                which = pa.array(text[keep])
                yield pa.RecordBatch.from_arrays([pa.array(seed[keep]), b.column("doc_id").take(which), b.column("text_key").take(which), pa.array(first[keep]), win], names=["seed", "doc_id", "text_key", "first", "win"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed.drop("row").mapInArrow(run, f"seed bigint, doc_id {kind}, text_key bigint, first bigint, win array<bigint>")
    rows = written(rows if few else rows.join(shared.select("seed"), "seed"), "windows")
    hot = shared.where(F.col("n") > p.hot).select("seed")
    any_hot = not hot.isEmpty()
    calm = rows.join(F.broadcast(hot), "seed", "left_anti") if any_hot else rows
    out = calm.repartition("seed").sortWithinPartitions("seed").mapInArrow(_first, f"doc_id {kind}, text_key bigint, first bigint, last bigint, class_doc {kind}, class_key bigint, class_word bigint, removed boolean")
    if any_hot:
        each = rows.join(F.broadcast(hot), "seed", "left_semi").select("seed", "doc_id", "text_key", "first", F.posexplode("win").alias("k", "w")).withColumn("first", F.col("first") + F.col("k"))
        who = [F.col("doc_id").isNull().alias("no_doc"), F.col("doc_id").alias("class_doc"), F.col("text_key").alias("class_key")]
        of = each.groupBy("seed", "w").agg(F.min(F.struct(*who, F.col("first").alias("class_word"))).alias("low"), F.max(F.struct(*who)).alias("high"))
        of = of.where(~F.struct("low.no_doc", "low.class_doc", "low.class_key").eqNullSafe(F.col("high"))).select("seed", "w", "low.*")
        removed = ~(F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("text_key") == F.col("class_key")))
        out = out.unionByName(each.join(of, ["seed", "w"]).select("doc_id", "text_key", "first", F.col("first").alias("last"), "class_doc", "class_key", "class_word", removed.alias("removed")))
    by = ["doc_id", "text_key", "removed", "class_doc", "class_key"]
    order = Window.partitionBy(*by).orderBy("first", "last")
    past = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("new", F.coalesce((F.col("first") > past + 1).cast("int"), F.lit(0))).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.groupBy(*by, "part").agg(F.min("first").alias("first_word"), (F.max("last") - F.min("first") + p.words).alias("n_words"), F.min_by("class_word", "first").alias("class_word"))
    return out.select("doc_id", "text_key", "first_word", "n_words", "class_doc", "class_key", "class_word", "removed")


def cut(text: str, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of the spans (first word, words) and what stands between them; None if no word is left."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done, left = [], 0, 0
    for first, n in sorted(spans):
        end = min(first + n, len(at))
        if end > left:
            out.append(text[done : max(done, at[first][0])])
            done, left = at[end - 1][1], end
    rest = "".join(out) + text[done:]
    return rest if _WORD.search(rest) else None


def with_cuts(docs: DataFrame, cuts: DataFrame, column: str, broadcast_places: int = 500_000) -> DataFrame:
    """docs left-joined with cuts(__doc, __key, column: an array of places), by id and hash of text; cuts are broadcast if they hold few places, else the join shuffles."""
    cuts = written(cuts, "cuts")
    on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    few = (cuts.agg(F.sum(F.size(column) + 4)).first()[0] or 0) <= broadcast_places
    return docs.join(F.broadcast(cuts) if few else cuts, on, "left").select(*[F.col(f"`{c}`") for c in docs.columns], column)


def without_passages(docs: DataFrame, p: Windows = Windows()) -> DataFrame:
    """docs with the removed passages cut from text; a document that loses all its words goes. Columns and other values stay."""
    spans = repeated_passages(docs, p).where("removed").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first_word", "n_words")).alias("__spans"))
    x = with_cuts(docs, spans.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "__spans"), "__spans")
    names = docs.columns

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                texts, keep = b.column("text").to_pylist(), np.ones(b.num_rows, bool)
                for i, s in enumerate(b.column("__spans").to_pylist()):
                    if s:
                        texts[i] = cut(texts[i], [(y["first_word"], y["n_words"]) for y in s])
                        keep[i] = texts[i] is not None
                columns = [pa.array(texts, b.schema.field(c).type) if c == "text" else b.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return x.mapInArrow(run, docs.schema)
