"""Gates, diagnostics and comparisons of evaluations."""

from ..plans.proxy import EVAL, GATES

_E, _G = f"with {EVAL}", f"with {EVAL}, {GATES}"
_PAIR = f"""{_E}, a as (select stem, max(folder) as folder, avg(iou128) as iou, max(euler_match) as euler from eval where error = '' group by stem),
b as (select stem, avg(iou128 + l_tax - 0.04) as iou, min(euler_match) as euler from eval where error = '' and l_linestatus = 'F' group by stem),
d as (select a.stem, a.folder, a.iou as iou_a, b.iou as iou_b, round(b.iou - a.iou, 9) + cast(0 as double) as delta, a.euler as euler_a, b.euler as euler_b from a join b on a.stem = b.stem)"""

SQL = {
    "gates_overall_and_folder": f"{_G} select scope, gate, round(value, 9) as value, n, n_missing, verdict from judged",
    "gate_verdict_counts": f"{_G} select verdict, count(*) as n_gates from judged where scope = '*' group by verdict",
    "diagnostics": f"{_E} select coalesce(folder, '*') as scope, round(avg(n_components), 9) as mean_components, round(avg(n_components_gt), 9) as mean_components_gt, round(avg(case when n_components = n_components_gt then 1 when n_components is null then null else 0 end), 9) as components_match, count(n_components) as n from eval group by grouping sets ((), (folder))",
    "domain_gap": f"{_E}, f as (select folder, avg(iou128) as folder_iou from eval group by folder), o as (select avg(iou128) as overall_iou from eval) select folder, round(folder_iou, 9) as folder_iou, round(overall_iou, 9) as overall_iou, round(overall_iou - folder_iou, 9) as gap, overall_iou - folder_iou > 0.001 as interferes from f join o on true",
    "folders_by_iou": f"{_E}, f as (select folder, round(avg(iou128), 9) as iou from eval group by folder) select folder, iou, row_number() over (order by iou, folder) as place from f",
    "mean_and_sum_faces": f"{_E} select folder, round(avg(pred_faces), 6) as mean_faces, cast(sum(pred_faces) as bigint) as total_faces from eval group by folder",
    "rates_of_ok_rows": f"{_E} select folder, round(avg(case when error = '' then watertight end), 9) as watertight_rate, count(case when error = '' then 1 end) as n_ok, count(*) as n from eval group by folder",
    "status_counts": f"{_E} select folder, count_if(error = '') as ok, count_if(error <> '') as failed from eval group by folder",
    "error_rows_dropped": f"{_E} select folder, count(*) as n_scored from eval where coalesce(error, '') = '' group by folder",
    "iou_histogram": f"{_E} select cast(least(floor(iou128 * 40), 39) as int) as bin, count(*) as n from eval where error = '' group by cast(least(floor(iou128 * 40), 39) as int)",
    "pearson_log_faces": f"{_E} select round(corr(log10(pred_faces), chamfer_l2_x1e3), 6) as r, count(*) as n from eval where pred_faces > 0 and not isnan(chamfer_l2_x1e3)",
    "spearman_faces_iou": f"{_E}, t as (select stem, max(pred_faces) as f, round(avg(iou128), 9) as q from eval where error = '' group by stem), r as (select (rank() over (order by f) + count(*) over (partition by f) / 2.0) as rf, (rank() over (order by q) + count(*) over (partition by q) / 2.0) as rq from t) select round(corr(cast(rf as double), cast(rq as double)), 6) as rho, count(*) as n from r",
    "evenly_spaced_rank": f"{_E}, t as (select stem, round(avg(iou128), 9) as iou from eval where error = '' group by stem), r as (select stem, iou, row_number() over (order by iou desc, stem) - 1 as rk, count(*) over () as n from t), w as (select * from (values (0), (1), (2), (3), (4), (5)) as p(i)) select i as pick, stem, iou from w join r on r.rk = cast(@BROUND[i * (n - 1) / cast(5 as double)] as bigint)",
    "paired_evaluations": f"{_PAIR} select stem, folder, round(iou_a, 9) as iou_a, round(iou_b, 9) as iou_b, delta from d",
    "euler_transitions": f"{_PAIR} select case when euler_a = 1 and euler_b = 1 then 'kept' when euler_a = 1 then 'lost' when euler_b = 1 then 'gained' else 'never' end as change, count(*) as n from d group by case when euler_a = 1 and euler_b = 1 then 'kept' when euler_a = 1 then 'lost' when euler_b = 1 then 'gained' else 'never' end",
    "paired_delta_counts": f"{_PAIR} select count_if(delta > 0) as up, count_if(delta < 0) as down, count_if(delta = 0) as equal, count_if(abs(delta) > 0.02) as large, count(*) as n from d",
    "top_movers": f"{_PAIR}, t as (select stem, delta from d order by abs(delta) desc, stem limit 4) select stem, delta from t where abs(delta) >= 0.0001",
    "interleave_groups": f"{_PAIR}, g as (select stem, case when euler_b > euler_a then 'gained' else 'lost' end as side from d where euler_a <> euler_b), r as (select stem, side, row_number() over (partition by side order by stem) as rn from g), t as (select * from r where rn <= 12 order by rn, side limit 12) select stem, side, row_number() over (order by rn, side) as place from t",
    "stems_in_both": f"{_PAIR} select a.stem from a left semi join b on a.stem = b.stem",
    "symmetric_difference": f"{_PAIR} select 'only_a' as side, stem from (select stem from a except select stem from b) x union all select 'only_b', stem from (select stem from b except select stem from a) y",
    "reject_crosstab": f"{_E} select watertight, winding_consistent, self_intersection_free, euler_match, count(*) as n from eval group by watertight, winding_consistent, self_intersection_free, euler_match",
    "reverts_by_step": f"{_E} select case when watertight = 0 then 'decimate' when winding_consistent = 0 then 'normals' else 'export' end as step, count(*) as n from eval where watertight = 0 or winding_consistent = 0 or euler_match = 0 group by case when watertight = 0 then 'decimate' when winding_consistent = 0 then 'normals' else 'export' end",
}
