"""Shape files as Spark data sources: formats stl, npy and vtu.

    formats.register(spark)
    spark.read.format("stl").load(root)                                                  # whole meshes
    spark.read.format("stl").schema("folder string, stem string, n_faces long").load(root)   # headers only
    meshes.write.format("stl").mode("append").save(root)                                 # a file a row: folder/stem.stl

Files are listed once and planned into partitions by their bytes. Predicates on path, folder and stem drop files from the
plan, so these are never opened; those on counts are decided from the header, before a body is read. A body is read only
where the schema asks for one of its columns or for error; counts come from the header alone. A file that cannot be read
gives a row with an error.
"""

from __future__ import annotations

import base64
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from . import shapes

_PIECE = re.compile(rb'<Piece NumberOfPoints="(\d+)" NumberOfCells="(\d+)"')
#: Kept of a file's beginning while its header is looked at.
_HEAD = 1 << 16


def _stl_header(head: bytes, size: int, rest) -> dict:
    """Faces by the record count; an ASCII file has no count, so its facets are counted as they pass."""
    n = int.from_bytes(head[80:84], "little") if len(head) >= 84 else -1
    if size == 84 + 50 * n:
        return {"n_faces": n}
    if head.lstrip()[:5].lower() != b"solid":
        raise ValueError("neither a binary nor an ASCII STL file")
    word, found, part = b"endfacet", 0, head
    while part:
        found += part.lower().count(word)
        more = rest.read(1 << 20)
        # the end of a piece may hold the beginning of a word
        part = part[-(len(word) - 1) :] + more if more else b""
    return {"n_faces": found}


def _stl(content: bytes) -> dict:
    v, f = shapes.decode_stl(content)
    return {"xyz": v.ravel().tolist(), "tri": f.ravel().tolist()}


def _npy_header(head: bytes, size: int, rest) -> dict:
    stream = io.BytesIO(head)
    version = np.lib.format.read_magic(stream)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) != 2 or shape[1] < 3 or kind.hasobject:
        raise ValueError(f"a cloud of shape {shape}")
    return {"n_points": shape[0], "width": 6 if shape[1] >= 6 else 3}


def _npy(content: bytes) -> dict:
    return {"points": shapes._cloud(content)[0].tolist()}


def _vtu_header(head: bytes, size: int, rest) -> dict:
    m = _PIECE.search(head)
    if m is None:
        raise ValueError("no piece of an unstructured grid at its beginning")
    return {"n_points": int(m[1]), "n_cells": int(m[2])}


def _vtu(content: bytes) -> dict:
    """Points and tetrahedra of files with base64 arrays whose length takes 64 bits."""
    if b'header_type="UInt64"' not in content or b"compressor" in content[:_HEAD]:
        raise ValueError("arrays that are not plain base64 with 64-bit lengths")

    def array(name: str, kind: str) -> np.ndarray:
        m = re.search(rb'<DataArray type="(\w+)" Name="%s"[^>]*format="binary"[^>]*>\s*([A-Za-z0-9+/=]*)\s*</DataArray>' % name.encode(), content)
        if m is None:
            raise ValueError(f"no binary array {name}")
        return np.frombuffer(base64.b64decode(m[2])[8:], np.dtype(m[1].decode().lower())).astype(kind)

    points, cells, ends, kinds = array("points", "f8"), array("connectivity", "i8"), array("offsets", "i8"), array("types", "u1")
    if (kinds != 10).any() or (np.diff(ends, prepend=0) != 4).any():
        raise ValueError("cells other than tetrahedra")
    return {"xyz": points.tolist(), "tet": cells.tolist()}


@dataclass(frozen=True)
class Kind:
    name: str
    header: object
    body: object
    encode: object
    counts: str
    packed: str

    @property
    def columns(self) -> str:
        return f"path string, folder string, stem string, n_bytes long, {self.counts}, {self.packed}, error string"

    def names(self, part: str) -> list[str]:
        return [c.split()[0] for c in getattr(self, part).split(", ")]


def _encoded_npy(row) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(row["points"], np.float64).reshape(-1, row["width"]))
    return out.getvalue()


_grid = lambda row, c, n, kind: np.asarray(row[c], kind).reshape(-1, n)
KINDS = {
    "stl": Kind("stl", _stl_header, _stl, lambda r: shapes.encode_stl(_grid(r, "xyz", 3, np.float64), _grid(r, "tri", 3, np.int64)), "n_faces long", "xyz array<double>, tri array<int>"),
    "npy": Kind("npy", _npy_header, _npy, _encoded_npy, "n_points long, width int", "points array<double>"),
    "vtu": Kind("vtu", _vtu_header, _vtu, lambda r: shapes.encode_vtu(_grid(r, "xyz", 3, np.float64), _grid(r, "tet", 4, np.int64)), "n_points long, n_cells long", "xyz array<double>, tet array<long>"),
}


def _system(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    return system, path.rstrip("/")


def _names(path: str, root: str) -> dict:
    below = path[len(root) + 1 :]
    folder, _, name = below.rpartition("/")
    return {"path": path, "folder": folder or ".", "stem": name.rpartition(".")[0]}


#: What a predicate asks of a value that is not null.
_TESTS = {
    ds.EqualTo: lambda v, f: v == f.value, ds.In: lambda v, f: v in f.value, ds.GreaterThan: lambda v, f: v > f.value, ds.GreaterThanOrEqual: lambda v, f: v >= f.value,
    ds.LessThan: lambda v, f: v < f.value, ds.LessThanOrEqual: lambda v, f: v <= f.value, ds.StringStartsWith: lambda v, f: v.startswith(f.value), ds.IsNotNull: lambda v, f: True,
}


def _holds(filters: list, values: dict) -> bool:
    """Whether all predicates on columns that are known by now hold; one on null does not."""
    return all(values[f.attribute[0]] is not None and _TESTS[type(f)](values[f.attribute[0]], f) for f in filters if f.attribute[0] in values)


class Part(ds.InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


class ShapeReader(ds.DataSourceReader):
    def __init__(self, kind: str, options: dict, schema: StructType):
        self.kind, self.wanted, self.filters = kind, schema.names, []
        self.root, self.deep = options["path"], options.get("recursive", "true").lower() == "true"
        self.most = int(options.get("bytes_per_partition", 128 << 20))
        self.known = ["path", "folder", "stem", "n_bytes", *KINDS[kind].names("counts")]
        if unknown := set(self.wanted) - set(KINDS[kind].names("columns")):
            raise ValueError(f"format {kind} has no column {', '.join(sorted(unknown))}")

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, root = _system(self.root)
        found = [(x.path, x.size) for x in system.get_file_info(fs.FileSelector(root, recursive=self.deep)) if x.type == fs.FileType.File and x.path.lower().endswith(f".{self.kind}")]
        out, room = [[]], self.most
        for path, size in sorted(found):
            if _holds(self.filters, {**_names(path, root), "n_bytes": size}):
                if size > room and out[-1]:
                    out.append([])
                    room = self.most
                out[-1].append((path, size))
                room -= size
        return [Part(files) for files in out]

    def read(self, partition: Part) -> Iterator[tuple]:
        kind = KINDS[self.kind]
        system, root = _system(self.root)
        counts = set(kind.names("counts"))
        whole = bool({"error", *kind.names("packed")} & set(self.wanted))
        header = whole or bool(counts & {*self.wanted, *(f.attribute[0] for f in self.filters)})
        for path, size in partition.value:
            row = {**_names(path, root), "n_bytes": size}
            if header:
                self.opened(system, path, size, row, whole)
            if _holds(self.filters, row):
                yield tuple(row.get(c) for c in self.wanted)

    def opened(self, system: fs.FileSystem, path: str, size: int, row: dict, whole: bool) -> None:
        """Adds counts, the body's columns if wanted and the counts pass, and the error of either."""
        kind = KINDS[self.kind]
        row.update(dict.fromkeys(kind.names("counts")))
        try:
            with system.open_input_stream(path) as f:
                row.update(kind.header(f.read(min(size, _HEAD)), size, f))
            if whole and _holds(self.filters, row):
                with system.open_input_stream(path) as f:
                    row.update(kind.body(f.read()))
        except (ValueError, EOFError, OSError) as e:
            row["error"] = f"{type(e).__name__}: {e}"


class ShapeWriter(ds.DataSourceWriter):
    """A file a row, named folder/stem; it appears whole, by a rename, so a repeated task does no harm."""

    def __init__(self, kind: str, options: dict, schema: StructType):
        self.kind, self.root = kind, options["path"]
        needed = {"stem", *KINDS[kind].names("packed"), *(["width"] if kind == "npy" else [])}
        if missing := needed - set(schema.names):
            raise ValueError(f"format {kind} needs the columns {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator) -> ds.WriterCommitMessage:
        system, root = _system(self.root)
        for row in iterator:
            row = row.asDict()
            folder = row.get("folder") or "."
            path = f"{root}/{row['stem']}.{self.kind}" if folder == "." else f"{root}/{folder}/{row['stem']}.{self.kind}"
            part = f"{path}.{uuid.uuid4().hex}.part"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(part) as f:
                f.write(KINDS[self.kind].encode(row))
            system.move(part, path)
        return ds.WriterCommitMessage()


class _Shapes(ds.DataSource):
    """Options: path, recursive (true), bytes_per_partition (128 MB)."""

    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return KINDS[self.kind].columns

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(self.kind, dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShapeWriter:
        if overwrite:
            raise ValueError("append writes files or replaces those of the same names; a folder is not overwritten")
        return ShapeWriter(self.kind, dict(self.options), schema)


class Stl(_Shapes):
    kind = "stl"


class Npy(_Shapes):
    kind = "npy"


class Vtu(_Shapes):
    kind = "vtu"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and sets spark.sql.python.filterPushdown.enabled there, without which Spark refuses sources that take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Stl, Npy, Vtu):
        spark.dataSource.register(source)
