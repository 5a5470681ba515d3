"""Topology, measures, metrics and tetrahedra of shapes."""

from ..plans.proxy import BOXES, CLOUDS, CROSS, TETS

_B, _T, _K = f"with {BOXES}", f"with {TETS}", f"with {CLOUDS}"
_N = f"{_B}, n as (select *, {CROSS} from tri)"
_HALF = f"{_K}, a as (select * from cloud where pid % 2 = 0), b as (select * from cloud where pid % 2 = 1), p as (select a.shape_id, a.pid as pa, b.pid as pb, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) as d2, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz) / nullif(sqrt(a.nx*a.nx+a.ny*a.ny+a.nz*a.nz) * sqrt(b.nx*b.nx+b.ny*b.ny+b.nz*b.nz), 0) as cosine from a join b on a.shape_id = b.shape_id)"
_GRID = "grid as (select cast(x.i as int) as ix, cast(y.i as int) as iy, cast(z.i as int) as iz from (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) x(i) join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) y(i) on true join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) z(i) on true), field as (select *, 4.5 - sqrt((ix-5.5)*(ix-5.5)+(iy-5.5)*(iy-5.5)+(iz-5.5)*(iz-5.5)) as logit from grid)"
#: Only sound shapes are labelled.
_W = f"""{_B}, sound as (select shape_id from edges group by shape_id having bool_and(n = 2 and sgn = 0)), q as (select b.shape_id, c.k as qid, ex * c.fx as qx, ey * c.fy as qy, ez * c.fz as qz from boxes b left semi join sound s on s.shape_id = b.shape_id join (values (0, 0.5, 0.5, 0.5), (1, 0.25, 0.7, 0.1), (2, 1.5, 0.5, 0.5), (3, -0.2, 0.3, 0.9)) as c(k, fx, fy, fz) on true),
r as (select q.shape_id, qid, ax-qx as ax, ay-qy as ay, az-qz as az, bx-qx as bx, by_-qy as by_, bz-qz as bz, cx-qx as cx, cy-qy as cy, cz-qz as cz from q join tri t on t.shape_id = q.shape_id),
l as (select *, sqrt(ax*ax+ay*ay+az*az) as la, sqrt(bx*bx+by_*by_+bz*bz) as lb, sqrt(cx*cx+cy*cy+cz*cz) as lc from r),
w as (select shape_id, qid, sum(atan2(ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx), la*lb*lc+(ax*bx+ay*by_+az*bz)*lc+(bx*cx+by_*cy+bz*cz)*la+(ax*cx+ay*cy+az*cz)*lb)) / (2 * pi()) as winding from l group by shape_id, qid)"""

SQL = {
    "edge_incidence": f"{_B} select shape_id, cast(n as bigint) as faces_on_edge, count(*) as n_edges from edges group by shape_id, n",
    "watertight": f"{_B} select shape_id, cast(bool_and(n = 2) as int) as is_watertight from edges group by shape_id",
    "winding_consistent": f"{_B} select shape_id, cast(bool_and(n <> 2 or sgn = 0) as int) as is_winding_consistent from edges group by shape_id",
    "euler_number": f"{_B}, v as (select shape_id, count(distinct u) as n from edge3 group by shape_id), e as (select shape_id, count(*) as n from edges group by shape_id), f as (select shape_id, count(*) as n from faces group by shape_id) select v.shape_id, v.n - e.n + f.n as euler from v join e on e.shape_id = v.shape_id join f on f.shape_id = v.shape_id",
    "mesh_volume": f"{_B} select shape_id, round(sum(ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx)) / 6, 6) as volume from tri group by shape_id",
    "face_area": f"{_N} select shape_id, round(sum(sqrt(nx*nx+ny*ny+nz*nz) / 2), 6) as area from n group by shape_id",
    "area_centroid": f"{_N}, w as (select *, sqrt(nx*nx+ny*ny+nz*nz) / 2 as area from n) select shape_id, round(sum(area*(ax+bx+cx)/3)/sum(area), 6) as x, round(sum(area*(ay+by_+cy)/3)/sum(area), 6) as y, round(sum(area*(az+bz+cz)/3)/sum(area), 6) as z from w group by shape_id",
    "normalize_frame": f"{_N}, w as (select *, sqrt(nx*nx+ny*ny+nz*nz) / 2 as area from n), c as (select shape_id, sum(area*(ax+bx+cx)/3)/sum(area) as x, sum(area*(ay+by_+cy)/3)/sum(area) as y, sum(area*(az+bz+cz)/3)/sum(area) as z, greatest(max(greatest(ax,bx,cx))-min(least(ax,bx,cx)), max(greatest(ay,by_,cy))-min(least(ay,by_,cy)), max(greatest(az,bz,cz))-min(least(az,bz,cz))) as ext from w group by shape_id) select t.shape_id, fid, round((ax-x)*case when ext > 0 then 1/ext else 1 end, 6) as ax, round((ay-y)*case when ext > 0 then 1/ext else 1 end, 6) as ay, round((az-z)*case when ext > 0 then 1/ext else 1 end, 6) as az from tri t join c on c.shape_id = t.shape_id",
    "shape_bounds": f"{_B} select shape_id, min(least(ax,bx,cx)) as min_x, min(least(ay,by_,cy)) as min_y, min(least(az,bz,cz)) as min_z, max(greatest(ax,bx,cx)) as max_x, max(greatest(ay,by_,cy)) as max_y, max(greatest(az,bz,cz)) as max_z from tri group by shape_id",
    "bbox_union": f"{_B} select min(least(ax,bx,cx)) as min_x, min(least(ay,by_,cy)) as min_y, min(least(az,bz,cz)) as min_z, max(greatest(ax,bx,cx)) as max_x, max(greatest(ay,by_,cy)) as max_y, max(greatest(az,bz,cz)) as max_z from tri",
    "padded_bounds": f"{_B}, u as (select min(least(ax,bx,cx)) as lo, max(greatest(ax,bx,cx)) as hi from tri) select round(lo - 0.05*(hi-lo), 9) as lo, round(hi + 0.05*(hi-lo), 9) as hi from u",
    "bbox_overflow": f"{_B}, u as (select cast(5 as double) as hx, cast(4 as double) as hy, cast(2.5 as double) as hz) select shape_id, round(greatest(ex-hx, ey-hy, ez-hz, 0-0), 9) as worst, greatest(ex-hx, ey-hy, ez-hz) <= 0 as inside from boxes join u on true",
    "scale_spread": f"{_B}, e as (select greatest(ex, ey, ez) as ext from boxes) select round((max(ext)-min(ext))/avg(ext), 9) as spread from e",
    "stop_gates": f"{_B}, e as (select avg(cast(shape_id % 11 <> 0 as int)) as watertight, (max(greatest(ex,ey,ez))-min(greatest(ex,ey,ez)))/avg(greatest(ex,ey,ez)) as spread from boxes) select watertight < 0.98 as stop_watertight, spread > 0.01 as stop_scale from e",
    "degenerate_faces": f"{_N} select shape_id, count_if(nx*nx+ny*ny+nz*nz > 1e-18) as good, count_if(nx*nx+ny*ny+nz*nz <= 1e-18) as degenerate from n group by shape_id",
    "corner_gather": f"{_B} select shape_id, fid, ax, ay, az, bx, by_ as b_y, bz, cx, cy, cz from tri",
    "reject_cascade": f"{_B}, t as (select shape_id, bool_and(n = 2) as wt, bool_and(n <> 2 or sgn = 0) as wc from edges group by shape_id) select shape_id, case when wt and wc then 'ok' else 'reject' end as status, case when not wt and not wc then 'not watertight; not winding-consistent' when not wt then 'not watertight' when not wc then 'not winding-consistent' else '' end as reason from t",
    "vertex_sharing_filter": f"{_B} select a.shape_id, count(*) as disjoint_pairs from faces a join faces b on a.shape_id = b.shape_id and a.fid < b.fid where a.i not in (b.i, b.j, b.k) and a.j not in (b.i, b.j, b.k) and a.k not in (b.i, b.j, b.k) group by a.shape_id",
    "aabb_candidates": f"{_B}, x as (select shape_id, fid, least(ax,bx,cx) as x0, greatest(ax,bx,cx) as x1, least(ay,by_,cy) as y0, greatest(ay,by_,cy) as y1, least(az,bz,cz) as z0, greatest(az,bz,cz) as z1 from tri) select a.shape_id, a.fid as fid_a, b.fid as fid_b from x a join x b on a.shape_id = b.shape_id and a.fid < b.fid and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1 and a.z0 <= b.z1 and b.z0 <= a.z1",
    "winding_occupancy": f"{_W} select shape_id, qid, winding > 0.5 as occ from w",
    "winding_number": f"{_W} select shape_id, qid, round(winding, 4) + 0.0 as winding from w",
    "occupancy_rates": f"{_W}, o as (select shape_id, qid < 2 as near, avg(case when winding > 0.5 then 1 else 0 end) as rate from w group by shape_id, qid < 2) select near, round(avg(rate), 9) as mean_rate, count(*) as n_shapes from o group by near",
    "nearest_neighbour": f"{_HALF} select shape_id, pa, min_by(pb, d2) as nearest, round(min(d2), 6) as d2 from p group by shape_id, pa",
    "chamfer_l2": f"{_HALF}, f as (select shape_id, pa, min(d2) as m from p group by shape_id, pa), g as (select shape_id, pb, min(d2) as m from p group by shape_id, pb), u as (select shape_id, avg(m) as m from f group by shape_id), v as (select shape_id, avg(m) as m from g group by shape_id) select u.shape_id, round(0.5 * (u.m + v.m) * 1000, 6) as chamfer_l2_x1e3 from u join v on v.shape_id = u.shape_id",
    "normal_consistency": f"{_HALF}, f as (select shape_id, pa, min_by(cosine, d2) as c from p group by shape_id, pa), g as (select shape_id, pb, min_by(cosine, d2) as c from p group by shape_id, pb), u as (select shape_id, avg(c) as c from f group by shape_id), v as (select shape_id, avg(c) as c from g group by shape_id) select u.shape_id, round((u.c + v.c) / 2, 6) as normal_consistency from u join v on v.shape_id = u.shape_id",
    "frame_p99": f"{_HALF}, f as (select shape_id, pa, sqrt(min(d2)) as d from p group by shape_id, pa) select shape_id, round(avg(d), 6) as mean_d, round(@PCT[d; 0.99], 6) as p99_d, round(max(d), 6) as max_d, @PCT[d; 0.99] > 0.25 as frame_flag from f group by shape_id",
    "point_count_hist": f"{_K}, c as (select shape_id, count(*) as n from cloud group by shape_id) select n, count(*) as shapes from c group by n",
    "point_count_summary": f"{_K}, c as (select shape_id, count(*) as n from cloud group by shape_id) select min(n) as least, max(n) as most, cast(median(n) as double) as mid, count(distinct n) = 1 as uniform from c",
    "zero_normals": f"{_K} select shape_id, count_if(sqrt(nx*nx+ny*ny+nz*nz) < 1e-6) as zero_normals, case when count_if(sqrt(nx*nx+ny*ny+nz*nz) < 1e-6) > 0 then 'reject' else 'ok' end as status from cloud group by shape_id",
    "unit_normals": f"{_K} select shape_id, pid, round(nx/l, 6) as nx, round(ny/l, 6) as ny, round(nz/l, 6) as nz from (select *, sqrt(nx*nx+ny*ny+nz*nz) as l from cloud) t where l >= 1e-6",
    "affine_points": f"{_K} select shape_id, pid, round(0.8*(1.1*x) - 0.6*y, 6) as x, round(0.6*(1.1*x) + 0.8*y, 6) as y, round(0.9*z, 6) as z from cloud",
    "affine_normals": f"{_K}, t as (select shape_id, pid, 0.8*(nx/1.1) - 0.6*ny as mx, 0.6*(nx/1.1) + 0.8*ny as my, nz/0.9 as mz from cloud) select shape_id, pid, round(mx/sqrt(mx*mx+my*my+mz*mz), 6) as nx, round(my/sqrt(mx*mx+my*my+mz*mz), 6) as ny, round(mz/sqrt(mx*mx+my*my+mz*mz), 6) as nz from t where mx*mx+my*my+mz*mz > 0",
    "fourier_features": f"{_K}, f as (select * from (values (0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0)) as q(k, freq)) select shape_id, pid, k, round(sin(2*pi()*freq*x), 6) as sin_x, round(cos(2*pi()*freq*x), 6) as cos_x from cloud join f on true",
    "channel_slice": f"{_K} select shape_id, pid, x, y, z from cloud",
    "frame_assertion": f"{_K} select shape_id, bool_and(abs(x) <= 1 + 1e-6 and abs(y) <= 1 + 1e-6 and abs(z) <= 1 + 1e-6) as in_frame from cloud group by shape_id",
    "grid_points": f"with {_GRID} select ix, iy, iz, (ix * 12 + iy) * 12 + iz as idx, round(-1 + 2 * ix / cast(11 as double), 9) as x, round(-1 + 2 * iy / cast(11 as double), 9) as y, round(-1 + 2 * iz / cast(11 as double), 9) as z from grid",
    "shell_clamp": f"with {_GRID} select ix, iy, iz, round(case when ix in (0, 11) or iy in (0, 11) or iz in (0, 11) then -10000 else logit end, 6) as logit from field",
    "empty_field": f"with {_GRID} select max(logit) <= 0 or min(logit) >= 0 as is_empty, count_if(logit > 0) as inside from field",
    "grid_iou": f"with {_GRID}, o as (select logit > 0 as a, logit + 0.1 * (ix - 5) > 0 as b from field) select count_if(a and b) as both_in, count_if(a or b) as either, round(count_if(a and b) / nullif(cast(count_if(a or b) as double), 0), 9) as iou from o",
    "bce_accuracy": f"with {_GRID}, o as (select logit as l, case when ix < 6 then 1 else 0 end as y from field) select round(avg(ln(1 + exp(-abs(l))) + greatest(l, 0) - l * y), 9) as bce, round(avg(case when (l > 0) = (y = 1) then 1 else 0 end), 9) as accuracy from o",
    "floater_filter": f"{_B}, c as (select shape_id, fid % 2 as comp, abs(sum(ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx)) / 6) as v from tri group by shape_id, fid % 2), m as (select *, max(v) over (partition by shape_id) as most from c) select shape_id, comp, round(v, 6) as volume from m where v >= 0.001 * most",
    "signed_tet_volume": f"{_T} select shape_id, tid, round(v, 6) as volume from vol",
    "tet_orientation": f"{_T}, c as (select shape_id, count_if(abs(v) <= 1e-12 * box_volume) as n_degenerate, count_if(v > 1e-12 * box_volume) as n_positive, count_if(v < -1e-12 * box_volume) as n_negative from vol group by shape_id) select shape_id, n_degenerate, n_positive, n_negative, case when n_positive >= n_negative then 'positive' else 'negative' end as orientation, least(n_positive, n_negative) + n_degenerate as n_inverted from c",
    "tet_rollup": f"{_T}, s as (select shape_id, max(folder) as folder, count(*) as n_tets, sum(abs(v)) as vt, max(box_volume) as vs from vol group by shape_id) select coalesce(folder, '*') as scope, count(*) as n, round(min(vt), 6) as least, round(@PCT[vt; 0.01], 6) as p01, round(median(vt), 6) as mid, round(avg(vt), 6) as mean_volume, round(sum(n_tets), 0) as total_tets, round(avg(case when abs(vt-vs)/greatest(vs, 1e-30) < 0.01 then 1 else 0 end), 9) as agree from s group by grouping sets ((), (folder))",
    "tet_status": f"{_T}, s as (select shape_id, count(*) as n_tets, sum(abs(v)) as vt, max(box_volume) as vs, count_if(v < 0) as n_negative from vol group by shape_id) select shape_id, case when shape_id % 19 = 0 then 'skip' when n_tets = 0 then 'fail' when n_negative > 0 then 'error' when abs(vt - vs) / greatest(vs, 1e-30) >= 0.01 then 'fail' else 'ok' end as status, case when shape_id % 19 = 0 then 'not watertight' when n_tets = 0 then 'no tetrahedra' when n_negative > 0 then 'inverted tetrahedra' when abs(vt - vs) / greatest(vs, 1e-30) >= 0.01 then 'volume differs' else '' end as reason from s",
    "shell_offsets": f"{_T}, n as (select folder, shape_id, count(*) as n_tets, count(*) + 2 as n_nodes from tets group by folder, shape_id) select folder, shape_id, n_tets, cast(coalesce(sum(n_nodes) over (partition by folder order by shape_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_node from n",
    "shared_cube": f"{_B}, u as (select folder, min(least(ax,bx,cx)) as x0, max(greatest(ax,bx,cx)) as x1, min(least(ay,by_,cy)) as y0, max(greatest(ay,by_,cy)) as y1, min(least(az,bz,cz)) as z0, max(greatest(az,bz,cz)) as z1 from tri group by folder) select folder, (x0+x1)/2 as x, (y0+y1)/2 as y, (z0+z1)/2 as z, round(1.05 * greatest(x1-x0, y1-y0, z1-z0) / 2, 9) as half from u",
    "single_precision": f"{_B} select shape_id, fid, cast(cast(ax / 3 as float) as double) as ax, cast(cast(ay / 7 as float) as double) as ay, cast(cast(az / 11 as float) as double) as az from tri",
    "volume_error": f"{_T} select shape_id, round(abs(sum(v) - max(box_volume)) / greatest(max(box_volume), 1e-30), 9) as rel_error, abs(sum(v) - max(box_volume)) / greatest(max(box_volume), 1e-30) < 0.01 as volume_ok from vol group by shape_id",
}


def _dihedral() -> str:
    """Smallest of the six angles between the outward faces of a tetrahedron, in degrees."""
    point = {"p": "p", "q": "q", "r": "r", "s": "s"}
    faces = {"p": "qrs", "q": "prs", "r": "pqs", "s": "pqr"}

    def normal(f: str) -> tuple[str, str, str]:
        a, b, c = faces[f]
        d = lambda u, k: f"({u}{k}-{a}{k})"
        n = (f"({d(b, 'y')}*{d(c, 'z')}-{d(b, 'z')}*{d(c, 'y')})", f"({d(b, 'z')}*{d(c, 'x')}-{d(b, 'x')}*{d(c, 'z')})", f"({d(b, 'x')}*{d(c, 'y')}-{d(b, 'y')}*{d(c, 'x')})")
        side = "+".join(f"{n[i]}*({point[f]}{k}-{a}{k})" for i, k in enumerate("xyz"))
        return n, side

    cols, angles = [], []
    for f in "pqrs":
        n, side = normal(f)
        cols += [f"{n[i]} * case when {side} > 0 then -1 else 1 end as n{f}{k}" for i, k in enumerate("xyz")]
    for f, g in ("pq", "pr", "ps", "qr", "qs", "rs"):
        dot = "+".join(f"n{f}{k}*n{g}{k}" for k in "xyz")
        size = f"sqrt({'+'.join(f'n{f}{k}*n{f}{k}' for k in 'xyz')})*sqrt({'+'.join(f'n{g}{k}*n{g}{k}' for k in 'xyz')})"
        angles.append(f"degrees(acos(greatest(-1, least(1, -({dot})/({size})))))")
    return f"{_T}, n as (select shape_id, tid, {', '.join(cols)} from vol), d as (select shape_id, tid, least({', '.join(angles)}) as dih from n)"


SQL["min_dihedral"] = f"{_dihedral()} select shape_id, tid, round(dih, 4) as min_dihedral from d"
SQL["dihedral_distribution"] = f"{_dihedral()} select shape_id, round(min(dih), 4) as least, round(@PCT[dih; 0.01], 4) as p01, round(@PCT[dih; 0.5], 4) as p50, count_if(dih < 10) as n_below_10deg from d group by shape_id"
