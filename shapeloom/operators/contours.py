"""Level surfaces of fields on a grid, by an aggregate over cells and a table of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levelset
from .surfaces import AXES

#: More faces than any case has: a cell's faces are numbered from this multiple of its own number.
_FACES = 16


def samples(fields: DataFrame, res: int, by: str = "shape_id") -> DataFrame:
    """by, ix, iy, iz, value of packed fields (field: res^3 values, the last axis fastest)."""
    x = fields.select(by, F.posexplode("field").alias("n", "value"))
    return x.select(by, *[(F.floor(F.col("n") / res**p) % res).cast("int").alias(f"i{a}") for a, p in zip(AXES, (2, 1, 0))], "value")


def level_surface(grid: DataFrame, res: int, low=(-1.0,) * 3, high=(1.0,) * 3, level: float = 0.0, by: str = "shape_id") -> DataFrame:
    """The triangle table (by, fid, i, j, k, x0 ... z2) of value = level on a regular grid of res^3 samples (by, ix, iy, iz, value) from low to high, faces outward of value > level.

    A cell gathers its eight corners in one aggregate over cells, so one field is spread over tasks; nothing else is
    shuffled, as a cell's faces and their corners follow from its own values. A vertex is named by the grid's edge it
    lies on (three times the lower end's place, plus the axis), so equal ones of neighbouring cells agree without a
    search, and a face by its cell. Unknown or infinite samples leave their cells out, and so does a null key; of repeated samples the
    largest counts. Corners inside on a side's diagonal are kept apart, in all cells alike.
    """
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(k >> 2 - n & 1).alias(a) for n, a in enumerate(AXES)]) for k in range(8)])).alias("c")
    x = grid.where(F.col(by).isNotNull() & (F.abs("value") < float("inf"))).select(by, F.col("value").cast("double").alias("value"), *[f"i{a}" for a in AXES], at)
    x = x.select(by, "value", F.col("c.k").alias("k"), *[(F.col(f"i{a}") - F.col(f"c.{a}")).alias(f"c{a}") for a in AXES])
    for a in AXES:
        x = x.where(F.col(f"c{a}").between(0, res - 2))
    cells = x.groupBy(by, *[f"c{a}" for a in AXES]).agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(8)]).dropna()
    case = sum(F.when(F.col(f"v{k}") > level, 1 << k).otherwise(0) for k in range(8))
    cells = cells.withColumn("case", case).where("case between 1 and 254")
    # 256 cases, some hundreds of faces in all, whatever the input
    table = [(n, t, *map(int, e)) for n, faces in enumerate(levelset.cases()) for t, e in enumerate(faces)]
    f = cells.join(F.broadcast(grid.sparkSession.createDataFrame(table, "case int, t int, e0 int, e1 int, e2 int")), "case")
    first, second = (F.array(*[F.lit(e[s]) for e in levelset.EDGES]) for s in (0, 1))
    along = F.array(*[F.lit({4: 0, 2: 1, 1: 2}[b - a]) for a, b in levelset.EDGES])
    values = F.array(*[f"v{k}" for k in range(8)])
    ends = [F.struct(F.get(first, F.col(f"e{n}")).alias("a"), F.get(along, F.col(f"e{n}")).alias("along"), F.get(values, F.get(first, F.col(f"e{n}"))).alias("va"), F.get(values, F.get(second, F.col(f"e{n}"))).alias("vb")).alias(f"p{n}") for n in range(3)]
    f = f.select(by, "t", *[F.col(f"c{a}").cast("long").alias(f"c{a}") for a in AXES], *ends)

    def place(n: int, axis: int) -> Column:
        return F.col(f"c{AXES[axis]}") + F.shiftright(F.col(f"p{n}.a"), 2 - axis).bitwiseAND(1)

    def corner(n: int, axis: int) -> Column:
        part = F.when(F.col(f"p{n}.along") == axis, (level - F.col(f"p{n}.va")) / (F.col(f"p{n}.vb") - F.col(f"p{n}.va"))).otherwise(0.0)
        return F.lit(float(low[axis])) + (place(n, axis) + part) * ((high[axis] - low[axis]) / (res - 1))

    number = lambda p: (p[0] * res + p[1]) * res + p[2]
    cell = number([F.col(f"c{a}") for a in AXES])
    ids = [(number([place(n, s) for s in range(3)]) * 3 + F.col(f"p{n}.along")).alias("ijk"[n]) for n in range(3)]
    return f.select(by, (cell * _FACES + F.col("t")).alias("fid"), *ids, *[corner(n, s).alias(f"{a}{n}") for n in range(3) for s, a in enumerate(AXES)])
