"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vectors of three letters in a row, permuted by their place, are
bound by products into the vector of the n-gram; a text's n-gram vectors are bundled by sums. A prototype is the
bundle of the learned texts of a language, and a text goes to the prototype with the largest cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .store import bounded


@dataclass(frozen=True)
class Profiles:
    """dim: of the vectors. sample: expected number of learned texts of a language, drawn by a hash of the text; prototypes change little beyond. cache: n-gram vectors that a task holds; others are bound anew. languages: that can be learned at most, as their vectors come to the driver; more are an error. deviations, grams: a text of `grams` different n-grams or more is of no learned language if no cosine exceeds this many standard deviations of the cosine of unrelated vectors, which is 1 / sqrt(dim)."""

    dim: int = 1024
    sample: int = 2000
    cache: int = 16_384
    languages: int = 5000
    deviations: float = 4.0
    grams: int = 30


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = True
    return table


class Space:
    """n-gram vectors, made on demand. Codes: three code points of 21 bits; other characters than letters are one space."""

    def __init__(self, p: Profiles):
        self.p, self.letters = p, _letters()
        self.vectors: dict[int, np.ndarray] = {}
        self.known = np.zeros(0, np.int64)
        self.slot = np.zeros(0, np.int64)
        self.table = np.zeros((1024, p.dim), np.float32)
        self.used = 0

    def letter(self, c: int) -> np.ndarray:
        v = self.vectors.get(c)
        if v is None:
            if len(self.vectors) > 20_000:
                self.vectors.clear()
            v = self.vectors[c] = np.random.default_rng(1_000_003 + c).integers(0, 2, self.p.dim).astype(np.float32) * 2 - 1
        return v

    def bind(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def codes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct n-grams and how often they occur; none without a letter."""
        x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        is_letter = self.letters[x]
        if not is_letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.concatenate([[32], np.where(is_letter, x, 32), [32]])
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        return np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:], return_counts=True)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, codes)
        hit = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == codes) if len(self.known) else np.zeros(len(codes), bool)
        out = counts[hit].astype(np.float32) @ self.table[self.slot[at[hit]]] if hit.any() else np.zeros(self.p.dim, np.float32)
        new = codes[~hit]
        fresh = []
        for code, n in zip(new.tolist(), counts[~hit]):
            v = self.bind(code)
            out = out + n * v
            if self.used < self.p.cache:
                if self.used == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[self.used] = v
                fresh.append((code, self.used))
                self.used += 1
        if fresh:
            known = np.concatenate([self.known, np.array([c for c, _ in fresh])])
            slot = np.concatenate([self.slot, np.array([s for _, s in fresh])])
            order = np.argsort(known)
            self.known, self.slot = known[order], slot[order]
        return out


_spaces: dict[Profiles, Space] = {}


def _space(p: Profiles) -> Space:
    if p not in _spaces:
        _spaces[p] = Space(p)
    return _spaces[p]


def prototypes(labelled: DataFrame, p: Profiles = Profiles()) -> pd.DataFrame:
    """lang and vector of every language of labelled(text, lang); rows with a null text or lang teach nothing. Languages are few (p.languages); their vectors come to the driver."""
    bounded(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null")
    n = rows.groupBy("lang").count().withColumnRenamed("count", "n_lang")
    if n.limit(p.languages + 1).count() > p.languages:
        raise ValueError(f"more than {p.languages} languages")
    draw = F.pmod(F.xxhash64(F.lit("profiles"), F.col("text")), F.lit(1 << 30)) * F.col("n_lang")
    taken = rows.join(F.broadcast(n), "lang").where(draw < F.lit(p.sample * (1 << 30))).select("lang", "text")

    def run(batches):
        space, sums = _space(p), {}
        for whole in batches:
            for b in flat.slices(whole, "text"):
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    codes, counts = space.codes(text)
                    if len(codes):
                        sums[lang] = sums.get(lang, 0) + space.bundle(codes, counts).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * p.dim), pa.array(range(p.dim), pa.int32()), pa.array(v)], names=["lang", "k", "x"])

    parts = taken.mapInArrow(run, "lang string, k int, x double")
    out = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).toPandas().sort_values(["lang", "k"])
    return pd.DataFrame([(lang, g.x.to_numpy()) for lang, g in out.groupby("lang")], columns=["lang", "vector"])


def identify(docs: DataFrame, learned: pd.DataFrame, p: Profiles = Profiles()) -> DataFrame:
    """docs with lang_pred and score. und and 0 if text is null or has no letter, or nothing was learned; ties go to the first language by code point; score is the cosine, 0 if negative."""
    names = list(learned["lang"])
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in learned["vector"]], np.float32).reshape(len(names), p.dim)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in fields])

    def run(batches):
        space = _space(p)
        for whole in batches:
            for b in flat.slices(whole, "text"):
                pred, score = [], []
                for text in b.column("text").to_pylist():
                    codes, counts = space.codes(text)
                    if not len(codes) or not names:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    v = space.bundle(codes, counts)
                    cos = unit @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(np.argmax(cos))
                    pred.append(names[best])
                    score.append(float(min(1.0, max(0.0, cos[best]))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, learned: pd.DataFrame, p: Profiles = Profiles(), wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose language is known, and one of `wanted` if that is given.

    Rejected are texts without a letter (null and empty ones too) and texts that are like no prototype. A text of few
    n-grams is too short to be unlike all and stays. Where nothing was learned, all texts with a letter stay.
    """
    names = list(learned["lang"])
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in learned["vector"]], np.float32).reshape(len(names), p.dim)

    def run(batches):
        space = _space(p)
        for whole in batches:
            for b in flat.slices(whole, "text"):
                keep = []
                for text in b.column("text").to_pylist():
                    codes, counts = space.codes(text)
                    good = len(codes) > 0
                    if good and names:
                        v = space.bundle(codes, counts)
                        cos = unit @ v / max(float(np.linalg.norm(v)), 1e-12)
                        k = int(np.argmax(cos))
                        good = (len(codes) < p.grams or float(cos[k]) > p.deviations / p.dim**0.5) and (wanted is None or names[k] in wanted)
                    keep.append(good)
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> Column:
    """The fold that teaches nothing: crc32 of the id as text, modulo 4, is 2. A null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = prototypes(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
