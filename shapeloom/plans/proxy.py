"""Shapes, clouds and fact tables derived from the star schema by arithmetic on its columns."""

from __future__ import annotations

from ..operators.rounds import dealt

#: One row a scored shape; a shape that failed has flags 0, IoU 0 and an unknown Chamfer distance.
EVAL = """
raw_eval as (select l_returnflag as folder, cast(l_orderkey % 9973 * 7 + l_linenumber as bigint) as stem, l_quantity = 50 as bad, l_linenumber, l_orderkey, l_partkey, l_discount, l_tax, l_extendedprice, l_linestatus from {lineitem}),
eval as (select folder, stem, case when bad then 'unreadable' else '' end as error,
  case when bad then 0 else cast(l_orderkey % 50 <> 0 as int) end as watertight, case when bad then 0 else cast(l_partkey % 40 <> 0 as int) end as winding_consistent,
  case when bad then 0 else cast(l_partkey % 90 <> 0 as int) end as self_intersection_free, case when bad then cast(0 as double) else 1 - l_discount end as iou128,
  case when bad or l_linenumber = 7 then cast('NaN' as double) else l_tax * 20 end as chamfer_l2_x1e3, case when bad then cast(0 as double) else 1 - l_tax end as normal_consistency,
  case when bad then 0 else cast(l_orderkey % 5 <> 0 as int) end as euler_match, case when bad then null else cast(1 + l_partkey % 3 as int) end as n_components,
  case when bad then null else cast(1 + l_orderkey % 2 as int) end as n_components_gt, case when bad then null else cast(4 * l_orderkey % 997 + 4 as int) end as pred_faces, l_extendedprice, l_tax, l_linestatus from raw_eval)"""
#: The gates.
GATES = """
spec as (select * from (values ('watertight', 0.98, 0.90, 'higher'), ('winding_consistent', 0.98, 0.90, 'higher'), ('self_intersection_free', 1.00, 0.90, 'higher'), ('iou128', 0.90, 0.80, 'higher'),
  ('chamfer_l2_x1e3', 1.00, 2.00, 'lower'), ('normal_consistency', 0.90, 0.80, 'higher'), ('euler_match', 0.85, 0.70, 'higher')) as s(gate, pass_at, partial_at, direction)),
long as (select folder, s.gate, s.pass_at, s.partial_at, s.direction, cast(case s.gate when 'watertight' then watertight when 'winding_consistent' then winding_consistent when 'self_intersection_free' then self_intersection_free
  when 'iou128' then iou128 when 'chamfer_l2_x1e3' then chamfer_l2_x1e3 when 'normal_consistency' then normal_consistency else euler_match end as double) as v from eval join spec s on true),
means as (select coalesce(folder, '*') as scope, gate, cast(max(pass_at) as double) as pass_at, cast(max(partial_at) as double) as partial_at, max(direction) as direction, avg(nullif(v, cast('NaN' as double))) as value,
  count(nullif(v, cast('NaN' as double))) as n, count(*) - count(nullif(v, cast('NaN' as double))) as n_missing from long group by grouping sets ((gate), (gate, folder))),
judged as (select scope, gate, value, n, n_missing, case when value is null or isnan(value) then 'FAIL' when direction = 'higher' and value >= pass_at or direction = 'lower' and value <= pass_at then 'PASS'
  when direction = 'higher' and value >= partial_at or direction = 'lower' and value <= partial_at then 'PARTIAL' else 'FAIL' end as verdict from means)"""
#: Closed boxes as triangle meshes; every 11th lacks a face and every 13th has one flipped.
BOXES = """
boxes as (select p_partkey as shape_id, p_brand as folder, cast(1 + p_size % 7 as double) as ex, cast(1 + p_partkey % 5 as double) as ey, cast(1 + p_partkey % 3 as double) as ez from {part}),
corner as (select * from (values (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)) as c(vid, cx, cy, cz)),
face as (select * from (values (0, 0, 2, 1), (1, 0, 3, 2), (2, 4, 5, 6), (3, 4, 6, 7), (4, 0, 1, 5), (5, 0, 5, 4), (6, 2, 3, 7), (7, 2, 7, 6), (8, 0, 4, 7), (9, 0, 7, 3), (10, 1, 2, 6), (11, 1, 6, 5)) as f(fid, i, j, k)),
faces as (select shape_id, folder, ex, ey, ez, fid, i, case when shape_id % 13 = 0 and fid = 0 then k else j end as j, case when shape_id % 13 = 0 and fid = 0 then j else k end as k from boxes join face on not (shape_id % 11 = 0 and fid = 11)),
tri as (select shape_id, folder, fid, i, j, k, a.cx * ex as ax, a.cy * ey as ay, a.cz * ez as az, b.cx * ex as bx, b.cy * ey as by_, b.cz * ez as bz, c.cx * ex as cx, c.cy * ey as cy, c.cz * ez as cz
  from faces join corner a on a.vid = i join corner b on b.vid = j join corner c on c.vid = k),
edge3 as (select shape_id, fid, i as u, j as v from faces union all select shape_id, fid, j, k from faces union all select shape_id, fid, k, i from faces),
edges as (select shape_id, least(u, v) as lo, greatest(u, v) as hi, count(*) as n, sum(case when u < v then 1 else -1 end) as sgn from edge3 group by shape_id, least(u, v), greatest(u, v))"""
CROSS = "(by_-ay)*(cz-az)-(bz-az)*(cy-ay) as nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) as ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) as nz"
#: Six tetrahedra of each box; every 17th box has one turned over.
TETS = """
boxes as (select p_partkey as shape_id, p_brand as folder, cast(1 + p_size % 7 as double) as ex, cast(1 + p_partkey % 5 as double) as ey, cast(1 + p_partkey % 3 as double) as ez from {part}),
corner as (select * from (values (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)) as c(vid, cx, cy, cz)),
tet as (select * from (values (0, 0, 1, 2, 6), (1, 0, 2, 3, 6), (2, 0, 3, 7, 6), (3, 0, 7, 4, 6), (4, 0, 4, 5, 6), (5, 0, 5, 1, 6)) as t(tid, a, b, c, d)),
tets as (select shape_id, folder, ex, ey, ez, tid, case when shape_id % 17 = 0 and tid = 0 then b else a end as a, case when shape_id % 17 = 0 and tid = 0 then a else b end as b, c, d from boxes join tet on true),
pos as (select shape_id, folder, ex * ey * ez as box_volume, tid, p.cx*ex as px, p.cy*ey as py, p.cz*ez as pz, q.cx*ex as qx, q.cy*ey as qy, q.cz*ez as qz, r.cx*ex as rx, r.cy*ey as ry, r.cz*ez as rz, s.cx*ex as sx, s.cy*ey as sy, s.cz*ez as sz
  from tets join corner p on p.vid = a join corner q on q.vid = b join corner r on r.vid = c join corner s on s.vid = d),
vol as (select *, ((qx-px)*((ry-py)*(sz-pz)-(rz-pz)*(sy-py)) + (qy-py)*((rz-pz)*(sx-px)-(rx-px)*(sz-pz)) + (qz-pz)*((rx-px)*(sy-py)-(ry-py)*(sx-px))) / 6 as v from pos)"""
CLOUDS = """
cloud as (select label as shape_id, vec_id as pid, cast(@AT[embedding; 1] as double) as x, cast(@AT[embedding; 2] as double) as y, cast(@AT[embedding; 3] as double) as z,
  cast(@AT[embedding; 4] as double) as nx, cast(@AT[embedding; 5] as double) as ny, cast(@AT[embedding; 6] as double) as nz from {embeddings})"""
CORPUS = "corpus as (select doc_id as stem, source as folder, n_chars, lang from {documents})"
LOG = "log as (select event_id as step, 0.3 + abs(value) / 1000 as val_bce from {events})"
#: What is made of tables before the SQL sees them: boxes become dozens of rows each, so their parts are dealt.
SPREAD = {"part": lambda part: dealt(part, "p_partkey")}
