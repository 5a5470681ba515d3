"""Files of shapes: STL and NumPy clouds in, STL and VTU out.

Scans use Spark's binary file source, so listing, globs, remote paths and file splitting are Spark's own; decoding runs
in Arrow batches. A mesh is one row with packed coordinates (xyz: 3 a vertex, tri: 3 a face), so per-shape kernels need
no shuffle. A file that cannot be read gives a row with an error.
"""

from __future__ import annotations

import base64
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mesh import merged

_RECORD = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
_VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", re.IGNORECASE)


def decode_stl(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Mesh of a binary or ASCII STL file with equal corners merged; ValueError if it is neither."""
    if len(content) >= 84 and len(content) == 84 + 50 * int.from_bytes(content[80:84], "little"):
        return merged(np.frombuffer(content, _RECORD, offset=84)["corners"])
    if content.lstrip()[:5].lower() != b"solid":
        raise ValueError("neither a binary nor an ASCII STL file")
    corners = np.array(_VERTEX.findall(content)).astype(np.float64)
    if len(corners) % 3:
        raise ValueError("a facet without three corners")
    return merged(corners.astype(np.float32).reshape(-1, 3, 3))


def encode_stl(v: np.ndarray, f: np.ndarray) -> bytes:
    rows = np.zeros(len(f), _RECORD)
    t = np.asarray(v, np.float32)[f] if len(f) else np.zeros((0, 3, 3), np.float32)
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    rows["normal"], rows["corners"] = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-30), t
    return bytes(80) + len(f).to_bytes(4, "little") + rows.tobytes()


def encode_vtu(nodes: np.ndarray, tets: np.ndarray) -> bytes:
    """VTK's XML form of tetrahedra (cell type 10), arrays as base64 with a length of 64 bits."""

    def array(name: str, kind: str, data: np.ndarray, more: str = "") -> str:
        raw = data.tobytes()
        return f'<DataArray type="{kind}" Name="{name}"{more} format="binary">{base64.b64encode(len(raw).to_bytes(8, "little") + raw).decode()}</DataArray>'

    return "".join([
        '<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64"><UnstructuredGrid>',
        f'<Piece NumberOfPoints="{len(nodes)}" NumberOfCells="{len(tets)}"><Points>', array("points", "Float64", np.asarray(nodes, "<f8"), ' NumberOfComponents="3"'), "</Points><Cells>",
        array("connectivity", "Int64", np.asarray(tets, "<i8")), array("offsets", "Int64", np.arange(1, len(tets) + 1, dtype="<i8") * 4), array("types", "UInt8", np.full(len(tets), 10, "u1")),
        "</Cells></Piece></UnstructuredGrid></VTKFile>",
    ]).encode()


def listed(spark: SparkSession, root: str, suffix: str, limit: int = 0) -> DataFrame:
    """path, stem, folder (of the file below root, '.' at the top), sha1, content of every file below root whose name ends in suffix, in any case; with limit the first so many by folder and stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").endswith(suffix))
    bare = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/")
    below = F.substring(bare, F.length(F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-zA-Z0-9+.-]+:/*", "/")) + 2, F.length(bare))
    folder = F.regexp_extract(below, r"^(.*)/[^/]*$", 1)
    named = files.select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.when(folder == "", ".").otherwise(folder).alias("folder"), F.sha1("content").alias("sha1"), "content")
    # names alone are sorted; contents of the chosen files are read by the join
    return named.join(named.orderBy("folder", "stem", "path").limit(limit).select("path"), "path", "left_semi") if limit else named


def collisions(files: DataFrame) -> DataFrame:
    """All claimants of a stem that several files have; kept: the first path."""
    stems = files.select("stem", "path")
    first = stems.groupBy("stem").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stems.join(first, "stem").select("stem", "path", (F.col("path") == F.col("first")).alias("kept"))


def _decoded(files: DataFrame, schema: str, decode) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for content in b.pop("content"):
                try:
                    rows.append((*decode(bytes(content)), None))
                except (ValueError, EOFError, OSError) as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            names = [x.split()[0] for x in schema.split(",")]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return files.mapInPandas(run, f"path string, stem string, folder string, sha1 string, {schema}")


def read_stl(spark: SparkSession, root: str, limit: int = 0) -> DataFrame:
    """path, stem, folder, sha1, xyz, tri, error of every .stl file below root (the first `limit` by folder and stem, if given)."""
    return _decoded(listed(spark, root, ".stl", limit), "xyz array<double>, tri array<int>, error string", lambda c: [x.ravel() for x in decode_stl(c)])


def _cloud(content: bytes) -> tuple[np.ndarray, int]:
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.ndim != 2 or a.shape[1] < 3:
        raise ValueError(f"a cloud of shape {a.shape}")
    return np.ascontiguousarray(a[:, : 6 if a.shape[1] >= 6 else 3], np.float64).ravel(), 6 if a.shape[1] >= 6 else 3


def read_clouds(spark: SparkSession, root: str) -> DataFrame:
    """path, stem, folder, sha1, points (packed rows), width (3, or 6 with normals), error of every .npy file below root."""
    return _decoded(listed(spark, root, ".npy"), "points array<double>, width int, error string", _cloud)


def write_files(df: DataFrame, root: str, name: str, content: str) -> DataFrame:
    """Writes the binary column `content` of each row to root/<name> and returns path, n_bytes. A file appears whole, by a rename, so a repeated task does no harm. Run it by an action on the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for where, data in zip(b["name"], b["content"]):
                system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
                path, part = f"{path.rstrip('/')}/{where}", f"{path.rstrip('/')}/{where}.{uuid.uuid4().hex}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(part) as f:
                    f.write(bytes(data))
                system.move(part, path)
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "n_bytes"])

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, "path string, n_bytes long")


def as_stl(meshes: DataFrame) -> DataFrame:
    """Adds column stl: the file's bytes (single precision, a triangle soup)."""

    @F.pandas_udf("binary")
    def encoded(xyz: pd.Series, tri: pd.Series) -> pd.Series:
        return pd.Series([encode_stl(np.asarray(x).reshape(-1, 3), np.asarray(t, np.int64).reshape(-1, 3)) for x, t in zip(xyz, tri)])

    return meshes.withColumn("stl", encoded("xyz", "tri"))
