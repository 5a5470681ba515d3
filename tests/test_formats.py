"""Shape files as data sources: round trips, pushed predicates, headers."""

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapeloom.functions import mesh
from shapeloom.sources import formats
from shapeloom.sources.shapes import encode_stl
from tests.test_surfaces import sphere


@pytest.fixture
def spark_files(spark):
    formats.register(spark)
    return spark


def rows_of(spark, n=6):
    v, f = sphere(4, 5)
    rows = [(f"f{k % 2}" if k else None, f"s{k}", [float(x) for x in np.ravel(v * (k + 1))], [int(x) for x in np.ravel(f[: len(f) - k])]) for k in range(n)]
    return spark.createDataFrame(rows, "folder string, stem string, xyz array<double>, tri array<int>").repartition(3)


def test_meshes_come_back(spark_files, tmp_path):
    spark, root = spark_files, str(tmp_path)
    for _ in range(2):
        rows_of(spark).write.format("stl").mode("append").save(root)
    (tmp_path / "f1" / "bad.STL").write_bytes(b"?")
    (tmp_path / "f1" / "words.stl").write_text("solid x\n" + "facet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\n" * 3 + "endsolid")
    got = {r.stem: r for r in spark.read.format("stl").load(root).collect()}
    assert len(got) == 8 and got["s0"].folder == "." and got["s3"].folder == "f1" and "ValueError" in got["bad"].error and got["bad"].n_faces is None
    for k in range(6):
        r = got[f"s{k}"]
        v, f = np.reshape(r.xyz, (-1, 3)), np.reshape(r.tri, (-1, 3))
        assert r.n_faces == len(f) == 30 - k and r.error is None and r.n_bytes == 84 + 50 * len(f)
        assert np.abs(mesh.areas(v, f).sum() - mesh.areas(sphere(4, 5)[0] * (k + 1), sphere(4, 5)[1][: 30 - k]).sum()) < 1e-3
    assert got["words"].n_faces == 3 and len(got["words"].tri) == 9
    flat = spark.read.format("stl").option("recursive", "false").load(root)
    assert [r.stem for r in flat.collect()] == ["s0"]
    assert spark.read.format("stl").option("bytes_per_partition", "4000").load(root).rdd.getNumPartitions() >= 3
    with pytest.raises(Exception, match="not overwritten"):
        rows_of(spark).write.format("stl").mode("overwrite").save(root)


def test_pushed_predicates_give_the_rows_that_spark_finds(spark_files, tmp_path):
    spark, root = spark_files, str(tmp_path)
    rows_of(spark).write.format("stl").mode("append").save(root)
    asked = [F.col("stem").isin("s1", "s4"), F.col("folder") == "f1", (F.col("n_faces") > 27) & (F.col("folder") != "."), F.col("stem").startswith("s"), F.size("tri") > 80, F.col("n_bytes").between(1400, 1500)]
    source = spark.read.format("stl").load(root)
    # rows that Spark itself filters
    plain = spark.createDataFrame(source.collect(), source.schema)
    found = [[sorted(r.stem for r in d.where(p).collect()) for p in asked] for d in (source, plain)]
    assert found[0] == found[1] and found[0][:2] == [["s1", "s4"], ["s1", "s3", "s5"]]


def test_unwanted_files_are_never_opened_and_headers_do_not_read_bodies(tmp_path, monkeypatch):
    for k in range(4):
        (tmp_path / f"s{k}.stl").write_bytes(encode_stl(*sphere(4, 4 + k)))
    # a file of 1 GB that takes no room
    with open(tmp_path / "large.stl", "wb") as f:
        f.write(bytes(80) + (20_000_000).to_bytes(4, "little"))
        f.truncate(84 + 50 * 20_000_000)
    log, opened = [], formats.ShapeReader.opened
    monkeypatch.setattr(formats.ShapeReader, "opened", lambda self, system, path, size, row, whole: log.append((path.rsplit("/", 1)[1], whole)) or opened(self, system, path, size, row, whole))

    def read(columns, *filters):
        log.clear()
        r = formats.ShapeReader("stl", {"path": str(tmp_path)}, StructType.fromDDL(columns))
        assert not list(r.pushFilters(list(filters)))
        return sorted(x for p in r.partitions() for x in r.read(p))

    assert read("stem string, n_faces long", ds.EqualTo(("stem",), "s2"), ds.IsNotNull(("stem",))) == [("s2", 36)] and log == [("s2.stl", False)]
    assert len(read("stem string, n_bytes long")) == 5 and log == []
    assert dict(read("stem string, n_faces long"))["large"] == 20_000_000 and not any(whole for _, whole in log)
    # a count decides before the body is read
    decoded, body = [], formats._stl
    monkeypatch.setitem(formats.KINDS, "stl", formats.Kind(**{**formats.KINDS["stl"].__dict__, "body": lambda c: decoded.append(len(c)) or body(c)}))
    assert [x[0] for x in read("stem string, tri array<int>", ds.LessThan(("n_faces",), 30))] == ["s0"] and len(decoded) == 1
    r = formats.ShapeReader("stl", {"path": str(tmp_path)}, StructType.fromDDL("stem string"))
    left = [ds.EqualTo(("error",), "x"), ds.Not(ds.EqualTo(("stem",), "s1"))]
    assert list(r.pushFilters(left)) == left


def test_clouds_and_tetrahedra_come_back(spark_files, tmp_path):
    spark = spark_files
    r = np.random.default_rng(1)
    clouds = {"a": (r.random((7, 6)), 6), "b": (r.random((5, 3)), 3)}
    spark.createDataFrame([(k, c.ravel().tolist(), w) for k, (c, w) in clouds.items()], "stem string, points array<double>, width int").write.format("npy").mode("append").save(str(tmp_path))
    np.save(tmp_path / "line.npy", np.ones(4))
    np.save(tmp_path / "wide.npy", np.ones((4, 8), np.float32))
    got = {x.stem: x for x in spark.read.format("npy").load(str(tmp_path)).collect()}
    for k, (c, w) in clouds.items():
        assert (got[k].n_points, got[k].width) == (len(c), w) and got[k].points == c.ravel().tolist()
    assert got["line"].error and got["line"].points is None and got["wide"].width == 6 and len(got["wide"].points) == 24
    nodes, tets = r.random((5, 3)), [0, 1, 2, 3, 1, 2, 3, 4]
    spark.createDataFrame([("t", nodes.ravel().tolist(), tets), ("none", [], [])], "stem string, xyz array<double>, tet array<long>").write.format("vtu").mode("append").save(str(tmp_path))
    (tmp_path / "bad.vtu").write_text("<VTKFile/>")
    got = {x.stem: x for x in spark.read.format("vtu").load(str(tmp_path)).collect()}
    assert (got["t"].n_points, got["t"].n_cells, got["t"].xyz, got["t"].tet) == (5, 2, nodes.ravel().tolist(), tets) and got["none"].tet == [] and got["bad"].error
    with pytest.raises(Exception, match="needs the columns"):
        spark.range(1).write.format("vtu").mode("append").save(str(tmp_path))
    (tmp_path / "empty").mkdir()
    assert spark.read.format("npy").load(str(tmp_path / "empty")).count() == 0
