"""Product codes of vectors: integer codebooks by Lloyd rounds, nearest entries found through segment-mean bounds.

A part x and an entry c are cut into blocks of equal width w. With the blocks' means m and what is left of the norm
beside them, r (the residual norm), |x - c|^2 is at least w * |m(x) - m(c)|^2 + (r(x) - r(c))^2, by Cauchy-Schwarz.
Bounds go from one block to finer ones; entries whose bound lies above a distance that is already known are out, the
others get their exact distance in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facts import with_facts
from .store import bounded, written


@dataclass(frozen=True)
class Codes:
    """parts: of a vector. entries: of a part's codebook. rounds: of assignment and replacement. scale: of the integers. largest: magnitude of an integer component up to which distances fit 64 bits."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    largest: int = 1 << 28


def _whole(docs: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null and has only finite components."""
    x = F.col(f"`{column}`").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return docs.where(x.isNotNull() & F.coalesce(good, F.lit(False)))


def integers(vectors: DataFrame, p: Codes = Codes()) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component. Vectors with a null, NaN or infinite component are left out, as are those without components or of another length than the first kept one (least vec_id, nulls last)."""
    rows = _whole(vectors, "embedding").where(F.size("embedding") > 0)
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(p.scale))).cast("bigint"))
    return rows.select("vec_id", "label", v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(size, -1) if size else np.zeros((0, 0), np.int64)


def _levels(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, block means, residual norms) from one block to blocks of two components; the last axis holds components."""
    n, out = x.shape[-1], []
    blocks = 1
    while n % blocks == 0 and n // blocks >= 2:
        b = x.reshape(*x.shape[:-1], blocks, n // blocks).astype(np.float64)
        mean = b.mean(-1)
        out.append((n // blocks, mean, np.sqrt(((b - mean[..., None]) ** 2).sum((-1, -2)))))
        blocks *= 2
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row of x, ties to the lower entry, and how many exact distances were needed."""
    n, rows = len(x), np.arange(len(x))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    exact = lambda i, j: ((x[i] - book[j]) ** 2).sum(-1)
    mine, its = _levels(x), _levels(book)
    bound = lambda k, i, j: (mine[k][0] * ((mine[k][1][i] - its[k][1][j]) ** 2).sum(-1) + (mine[k][2][i] - its[k][2][j]) ** 2) * (1 - 1e-9) - 1e-3
    every, row, needed = np.tile(np.arange(len(book)), n), np.repeat(rows, len(book)), 0
    known = np.full(n, np.iinfo(np.int64).max)
    for k in range(len(mine)):
        low = bound(k, row, every)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.flatnonzero(low == np.minimum.reduceat(low, begin)[row])  # the likeliest entries give a distance to beat
        np.minimum.at(known, row[least], exact(row[least], every[least]))
        needed += len(least)
        keep = low <= known[row]
        row, every = row[keep], every[keep]
    d = exact(row, every)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    best = np.minimum.reduceat(d, begin)
    entry = np.minimum.reduceat(np.where(d == best[row], every, len(book)), begin)
    return entry, best, len(d) + needed


def _assigned(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances, a column for each part."""
    width = v.shape[1] // len(books)
    got = [nearest(v[:, k * width : (k + 1) * width], b)[:2] for k, b in enumerate(books)]
    return np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)


def _sums(rows: DataFrame, books: list[np.ndarray], dim: int) -> list:
    """part, entry, n, sums of the components, over all rows; at most parts * entries rows."""
    parts, width = len(books), dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [np.zeros(len(b), np.int64) for b in books], [np.zeros((len(b), width), np.int64) for b in books]
        for b in batches:
            v = _matrix(b.column("v"))
            if not len(v):
                continue
            entry, _ = _assigned(v, books)
            for k in range(parts):
                n[k] += np.bincount(entry[:, k], minlength=len(n[k]))
                np.add.at(total[k], entry[:, k], v[:, k * width : (k + 1) * width])
        for k in range(parts):
            used = np.flatnonzero(n[k])
            at = np.tile(np.arange(width), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(np.repeat(n[k][used], width)), pa.array(total[k][used].ravel())], names=["part", "entry", "at", "n", "x"])

    return rows.select("v").mapInArrow(run, "part int, entry int, at int, n bigint, x bigint").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()


def codebooks(rows: DataFrame, p: Codes = Codes()) -> list[np.ndarray]:
    """The parts' codebooks after all rounds, of rows(vec_id, v) with vectors of one length. They start as the parts of the first rows by vec_id (then vector; nulls last); each round all vectors choose entries, whose next value is the floor of their mean. Fewer vectors than entries give fewer entries; no vectors, none."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(p.entries).collect()
    if not first:
        return []
    dim = len(first[0].v)
    start = np.array([r.v for r in first], np.int64)
    width = dim // p.parts
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(p.parts)]
    for _ in range(p.rounds):
        after = [b.copy() for b in books]
        for r in _sums(rows, books, dim):
            after[r.part][r.entry, r["at"]] = int(r.x) // r.n
        same = all((a == b).all() for a, b in zip(after, books))
        books = after
        if same:  # further rounds would change nothing
            break
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, p: Codes = Codes()) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each kept vector, and the codebooks.

    code: two hex digits a part; error: squared distances to the entries, summed. Kept are vectors as in integers();
    rows that repeat get equal codes and count as often as they stand there. Other columns are ignored. A length that
    the parts do not divide, or a component beyond `largest`, is an error: distances would not fit.
    """
    spark = vectors.sparkSession
    bounded(spark)
    rows = written(integers(vectors, p), "vectors")
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(head[0].v) if head else p.parts
    if dim % p.parts:
        raise ValueError(f"{p.parts} parts do not divide {dim} components")
    rows = rows.where(F.size("v") == dim)
    if not rows.where(F.exists("v", lambda x: (x > p.largest) | (x < -p.largest))).isEmpty():
        raise ValueError(f"a component beyond {p.largest} after scaling")
    books = codebooks(rows, p)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            entry, far = _assigned(_matrix(b.column("v")), books)
            code = ["".join(f"{x:02x}" for x in e) for e in entry.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint"), books


def decoded(codes: DataFrame, books: list[np.ndarray], p: Codes = Codes()) -> DataFrame:
    """codes with v: the integer vectors that their codes stand for."""
    flat = [b.tolist() for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [[x for k in range(len(flat)) for x in flat[k][int(c[2 * k : 2 * k + 2], 16)]] for c in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.list_(pa.int64()))], names=[*b.schema.names, "v"])

    codes = codes.drop("v")
    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("v", T.ArrayType(T.LongType()))]))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = written(rows, "codes")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    out = with_facts(rows, sums, ["label"], "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(p: Codes = Codes(), dim: int = 64) -> str:
    """The rounds as one query: parts as rows, distances to all entries."""
    width = dim // p.parts
    div = "((s - ((s % c) + c) % c) // c)"
    sql = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({p.scale}::DOUBLE * x)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0))",
        f"x AS MATERIALIZED (SELECT id, part, v[part * {width} + 1 : part * {width} + {width}] AS a FROM k, range({p.parts}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, a AS e FROM (SELECT part, a, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry FROM x) WHERE entry < {p.entries})",
    ]
    near = "SELECT id, part, a, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM (SELECT x.*, b.entry, list_sum(list_transform(list_zip(x.a, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{0} b ON b.part = x.part) GROUP BY id, part, a"
    for r in range(p.rounds):
        sql.append(f"n{r} AS MATERIALIZED ({near.format(r)})")
        sql.append(f"m{r} AS (SELECT part, entry, pos, sum(a[pos])::HUGEINT AS s, count(*)::HUGEINT AS c FROM n{r}, range(1, {width + 1}) q(pos) GROUP BY part, entry, pos)")
        sql.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(z.e, b.e) AS e FROM b{r} b LEFT JOIN (SELECT part, entry, list({div}::BIGINT ORDER BY pos) AS e FROM m{r} GROUP BY part, entry) z ON z.part = b.part AND z.entry = b.entry)")
    sql.append(f"f AS MATERIALIZED ({near.format(p.rounds)})")
    sql.append("o AS (SELECT vec_id, label, code, error FROM k JOIN (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY id) USING (id))")
    sql.append(f"h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS sha FROM b{p.rounds})")
    return "WITH " + ",\n".join(sql) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM o, h"
