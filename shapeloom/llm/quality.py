"""Quality rules: simple counts, and hashed n-gram log-likelihood ratios of a trusted target against the raw corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .flat import U, mix
from .store import bounded

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """buckets: of the hashed one- and two-word counts. least: mean log-likelihood ratio a text must reach; at -0.15, of the labelled rows of sf0.1 that pass the base rules, 4 of 301 bad ones and all 3,302 good ones are kept. broadcast_bytes: of trusted ids, up to which they are broadcast; beyond, the join shuffles."""

    buckets: int = 1 << 16
    least: float = -0.15
    broadcast_bytes: int = 32 << 20


def _grams(texts: list, rules: Rules):
    """Buckets of the texts' n-grams, and which text each belongs to."""
    word, at = flat.words(texts, flat.NOT_SPACE, lower=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    with np.errstate(over="ignore"):
        pair = mix(word[:-1] * U(0xC2B2AE3D27D4EB4F) + word[1:])
    inside = owner[:-1] == owner[1:]
    both = np.concatenate([word, pair[inside]]) & U(rules.buckets - 1)
    return both.astype(np.int64), np.concatenate([owner, owner[:-1][inside]]), word, at


def ratios(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules()) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, both multinomials smoothed by one. raw: all of docs(doc_id, text); target: those whose id is in trusted(doc_id). The counts are of fixed size and come to the driver summed."""
    bounded(docs.sparkSession)
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("__id")).distinct().withColumn("__in", F.lit(True))
    # a row of a broadcast table takes some 32 bytes besides its key
    if (ids.agg(F.sum(F.octet_length(F.col("__id").cast("string")) + 32)).first()[0] or 0) <= rules.broadcast_bytes:
        ids = F.broadcast(ids)
    rows = docs.join(ids, docs["doc_id"] == F.col("__id"), "left").select("text", F.col("__in").isNotNull().alias("target"))

    def run(batches):
        raw, target = np.zeros(rules.buckets, np.int64), np.zeros(rules.buckets, np.int64)
        for whole in batches:
            for b in flat.slices(whole, "text"):
                bucket, owner, _, _ = _grams(b.column("text").to_pylist(), rules)
                raw += np.bincount(bucket, minlength=rules.buckets)
                target += np.bincount(bucket[b.column("target").to_numpy(zero_copy_only=False)[owner]], minlength=rules.buckets)
        k = np.flatnonzero(raw)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], names=["k", "raw", "target"])

    sums = rows.mapInArrow(run, "k bigint, raw bigint, target bigint").groupBy("k").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(rules.buckets), np.ones(rules.buckets)
    raw[sums.k], target[sums.k] = raw[sums.k] + sums.raw, target[sums.k] + sums.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _repeat_words(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each text: words in windows of n words that occur twice or more in it."""
    out = np.zeros(len(at) - 1, np.int64)
    size = len(word) - n + 1
    if size <= 0:
        return out
    h = np.zeros(size, U)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * U(0xD6E8FEB86659FD93) + word[k : k + size]
    for i in np.flatnonzero(np.diff(at) > n):
        a, b = at[i], at[i + 1]
        own = h[a : b - n + 1]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            often = np.zeros(len(own), bool)
            often[order[1:][same]] = often[order[:-1][same]] = True
            edge = np.zeros(b - a + 1, np.int64)
            np.add.at(edge, np.flatnonzero(often), 1)
            np.add.at(edge, np.flatnonzero(often) + n, -1)
            out[i] = (np.cumsum(edge) > 0).sum()
    return out


def judged(docs: DataFrame, log_ratio: np.ndarray, rules: Rules = Rules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Null texts have no words and fail the base rules; llr of a text without words is null. Existing columns of these
    names are replaced; rows are judged one by one, so repeated rows get equal verdicts.
    """
    names = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "llr": "double", "kept": "boolean"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    table = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def run(batches):
        for whole in batches:
            for b in flat.slices(whole, "text"):
                texts = [t or "" for t in b.column("text").to_pylist()]
                bucket, owner, word, at = _grams(texts, rules)
                n = np.diff(at)
                chars = np.array([len(t) - sum(map(t.count, _SPACE)) for t in texts], np.int64)
                symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
                dup = np.zeros(len(texts), np.int64)
                for i, t in enumerate(texts):
                    lines = [x for x in t.split("\n") if x.strip(_SPACE)]
                    dup[i] = len(lines) - len(set(lines))
                repeat = _repeat_words(word, at, 8)
                failed = (n < 20) | (100 * repeat > 30 * n)
                grams = np.bincount(owner, minlength=len(texts))
                llr = np.bincount(owner, table.value[bucket], len(texts)) / np.maximum(grams, 1)
                kept = ~failed & (llr >= rules.least)
                cols = [n, chars, symbols, dup, repeat, failed]
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols), pa.array(llr, mask=grams == 0), pa.array(kept)], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in names.items())]))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    out = judged(docs, ratios(docs, trusted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
