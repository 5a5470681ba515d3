"""Queries of the report operators on rows derived from the star schema; their oracles are plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import spark_query
from ..operators import reports
from . import proxy

#: Rows of built shapes, of shapes to be filled, of inference; nodes and tetrahedra of shells.
BUILT = "built as (select case when l_quantity = 50 then 'error' when l_quantity = 49 then 'reject' else 'ok' end as status, case when l_linenumber = 7 then cast(l_partkey % 100 as int) when l_linenumber = 6 then null else 0 end as n_topup from {lineitem})"
FILLED = "filled as (select p_partkey as shape_id, cast(p_partkey % 11 <> 0 as int) as surf_watertight, case when p_partkey % 23 = 0 then null else cast(p_partkey % 17 as int) end as n_tets, case when p_partkey % 19 = 0 then 'unreadable' end as error from {part})"
ASKED = """asked as (select o_orderkey as shape_id, case when o_orderkey % 41 = 0 then 'unreadable' end as error, case when o_custkey % 29 = 0 then 'no normals' end as reject, cast(990 + o_custkey % 11 as int) as n_given, cast(o_orderkey % 3 as int) as n_topup,
  case when o_custkey % 7 = 0 then null else cast(o_custkey % 5 - 2 as double) / 8 end as overflow, cast(o_orderkey % 13 as int) as found, case when o_custkey % 17 = 0 then 'decimate' end as failed_step, case when o_custkey % 34 = 0 then 'not watertight' end as reason, cast(o_orderkey % 37 = 0 as int) as broken from {orders})"""
NODES = "nodes as (select c_nationkey as shape_id, c_mktsegment as shell, c_custkey as node from {customer})"

SCANNED = "scanned as (select p_partkey as shape_id, case when p_partkey % 37 = 0 then null else cast(p_partkey % 11 <> 0 as int) end as is_watertight, case when p_partkey % 31 = 0 then null else cast(p_partkey % 29 = 0 as int) end as misfit, cast(p_size as double) / 50 as reach, cast(1 + p_partkey % 5 as double) / 5 as extent from {part})"

_scanned = spark_query(f"with {SCANNED} select * from scanned")
_built = spark_query(f"with {BUILT} select * from built")
_filled = spark_query(f"with {FILLED} select * from filled")
_asked = spark_query(f"with {ASKED} select * from asked")
_nodes = spark_query(f"with {NODES} select * from nodes")
_cloud = spark_query(f"with {proxy.CLOUDS} select * from cloud")
_eval = spark_query(f"with {proxy.EVAL} select * from eval")


def _shortfall(spark, sf_dir):
    d = reports.shortfall(_built(spark, sf_dir), 1000)
    return d.select("n_ok", "n_topped_up", F.round("share_topped_up", 9).alias("share_topped_up"), "topup_points", F.round("worst_share", 9).alias("worst_share"))


def _shells(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    tets = nodes.where("node % 4 = 0").select("shape_id", "shell", F.col("node").alias("tid"), *[(F.col("node") % k).alias(c) for c, k in zip("abcd", (2, 3, 5, 7))])
    return reports.joined_shells(tets, nodes).select("shape_id", "tid", *"abcd")


def _expanded(spark, sf_dir):
    counts = _nodes(spark, sf_dir).groupBy("shape_id", "shell").agg((F.count(F.lit(1)) % 5).alias("n"))
    return reports.expanded(counts, "shape_id", "shell").select("shape_id", "shell", "place")


def _runs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.nullif("event_type", F.lit("click")).alias("key"))
    return reports.runs(events, "key", ["event_id"], "user_id").select("user_id", "event_id", "starts", "run")


def _smallest(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.col("url").alias("path"), F.length("html").alias("length"))
    return reports.smallest(pages, "host")


def _cube(spark, sf_dir):
    d = reports.cube(_cloud(spark, sf_dir))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


def _sides(spark, sf_dir):
    """Two evaluations of the same shapes: one row a shape and side."""
    rows = _eval(spark, sf_dir).groupBy("stem", "l_linestatus").agg(F.avg("iou128").alias("iou"), F.max("euler_match").alias("euler_match")).withColumnRenamed("stem", "shape_id")
    return rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'")


def _changes(spark, sf_dir):
    d = reports.transitions(reports.compared(*_sides(spark, sf_dir)))
    return d.select("change", "n", F.round("share", 9).alias("share"))


def _histogram(spark, sf_dir):
    d = reports.histogram(_eval(spark, sf_dir), "iou128", 12)
    return d.select("bin", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n")


def _stops(spark, sf_dir):
    d = reports.stop_gates(_scanned(spark, sf_dir), 0.95, 0.05, 1.0, 0.5)
    return d.withColumns({c: F.round(c, 9) for c in ("watertight", "misfit", "reach", "spread")})


QUERIES = {
    "scan_stops": _stops,
    "topup_shortfall": _shortfall, "tetrahedra_status": lambda s, d: reports.tetrahedra_status(_filled(s, d)).select("shape_id", "status", "note"), "answer_status": lambda s, d: reports.answer_status(_asked(s, d), 1000).select("shape_id", "status", "why", "warnings"),
    "shell_offsets": _shells, "expanded_counts": _expanded, "sorted_runs": _runs, "smallest_file": _smallest, "shared_cube": _cube, "change_counts": _changes, "score_histogram": _histogram,
}

_SIDES = f"with {proxy.EVAL}, s as (select stem, l_linestatus, max(euler_match) as e from eval group by stem, l_linestatus), p as (select a.e as ea, b.e as eb from s a join s b on a.stem = b.stem and a.l_linestatus = 'O' and b.l_linestatus = 'F')"
ORACLES = {
    "scan_stops": f"with {SCANNED}, m as (select avg(is_watertight) as w, avg(misfit) as f, max(reach) as r, (max(extent) - min(extent)) / avg(extent) as s from scanned) select round(w, 9) as watertight, round(f, 9) as misfit, round(r, 9) as reach, round(s, 9) as spread, w < 0.95 as stop_watertight, f > 0.05 as stop_misfit, r > 1.0 as stop_reach, s > 0.5 as stop_spread, w < 0.95 or f > 0.05 or r > 1.0 or s > 0.5 as stops from m",
    "topup_shortfall": f"with {BUILT}, g as (select * from built where status = 'ok') select (select count(*) from g) as n_ok, count(*) as n_topped_up, round(count(*)::double / greatest(1, (select count(*) from g)), 9) as share_topped_up, coalesce(sum(n_topup), 0)::bigint as topup_points, round(coalesce(max(n_topup / 1000::double), 0), 9) as worst_share from g where n_topup > 0",
    "tetrahedra_status": f"with {FILLED} select shape_id, 'error' as status, error as note from filled where error is not null union all select shape_id, 'skip', 'open surface' from filled where error is null and surf_watertight = 0 union all select shape_id, 'fail', 'no tetrahedra' from filled where error is null and surf_watertight = 1 and (n_tets is null or n_tets = 0) union all select shape_id, 'ok', '' from filled where error is null and surf_watertight = 1 and n_tets > 0",
    "answer_status": f"""with {ASKED}, w as (select shape_id, 1 as k, n_topup || ' points topped up' as t from asked where n_topup > 0 union all select shape_id, 2, 'reaches out of the data''s box by ' || printf('%.4f', overflow) from asked where overflow > 0
  union all select shape_id, 3, n_given || ' points, not 1000' from asked where n_given <> 1000 union all select shape_id, 4, 'simplification reverted at ' || failed_step || ': ' || coalesce(reason, '?') from asked where failed_step is not null union all select shape_id, 5, 'the written surface is broken' from asked where broken = 1),
j as (select shape_id, string_agg(t, '; ' order by k) as t from w group by shape_id)
select a.shape_id, case when error is not null then 'error' when reject is not null then 'reject' when found = 0 then 'fail' else 'ok' end as status, coalesce(error, reject, case when found = 0 then 'no level set in the grid' else '' end) as why, coalesce(j.t, '') as warnings from asked a left join j on j.shape_id = a.shape_id""",
    "shell_offsets": f"with {NODES}, c as (select shape_id, shell, count(*) as n from nodes group by all), o as (select a.shape_id, a.shell, coalesce(sum(b.n), 0)::bigint as o from c a left join c b on b.shape_id = a.shape_id and b.shell < a.shell group by all) select shape_id, node as tid, node % 2 + o as a, node % 3 + o as b, node % 5 + o as c, node % 7 + o as d from nodes join o using (shape_id, shell) where node % 4 = 0",
    "expanded_counts": f"with {NODES}, c as (select shape_id, shell, count(*) % 5 as n from nodes group by all) select shape_id, shell, row_number() over (partition by shape_id order by shell, k) - 1 as place from (select shape_id, shell, unnest(range(n)) as k from c)",
    "sorted_runs": "with e as (select user_id, event_id, coalesce(nullif(event_type, 'click'), '-') as key from events), n as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, key order by event_id) as island from e), i as (select *, min(event_id) over (partition by user_id, key, island) as first from n) select user_id, event_id, event_id = first as starts, dense_rank() over (partition by user_id order by first) as run from i",
    "smallest_file": "with p as (select regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host, url as path, length(html) as length from pages where html is not null) select host, path, length from (select *, row_number() over (partition by host order by length, path) as r from p) where r = 1",
    "shared_cube": f"with {proxy.CLOUDS}, b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 from cloud), h as (select *, greatest(x1 - x0, y1 - y0, z1 - z0) / 2 * 1.05 as h from b) select round((x0+x1)/2-h, 9) as low_x, round((x0+x1)/2+h, 9) as high_x, round((y0+y1)/2-h, 9) as low_y, round((y0+y1)/2+h, 9) as high_y, round((z0+z1)/2-h, 9) as low_z, round((z0+z1)/2+h, 9) as high_z from h",
    "change_counts": f"{_SIDES}, k as (select * from (values ('right', 1, 1), ('wrong', 0, 0), ('fixed', 0, 1), ('broken', 1, 0)) as k(change, a, b)) select change, count(ea) as n, round(count(ea)::double / greatest(1, (select count(*) from p)), 9) as share from k left join p on ea = a and eb = b group by change",
    "score_histogram": f"with {proxy.EVAL}, k as (select unnest(range(12)) as b) select b::int as bin, round(b / 12::double, 9) as low, round((b + 1) / 12::double, 9) as high, (select count(*) from eval where not isnan(iou128) and (floor(iou128 * 12) = b or b = 11 and iou128 = 1)) as n from k",
}
