"""Pairing, set membership, splits and inventories of a corpus."""

from ..plans.proxy import CORPUS, LOG

_C = f"with {CORPUS}"
_L = f"with {LOG}"

SQL = {
    "pair_full_outer": f"{_C} select coalesce(c.page_id, l.stem) as stem, c.page_id is not null as has_mesh, l.stem is not null as has_cloud from {{pages}} c full outer join corpus l on c.page_id = l.stem",
    "pair_unmatched": f"{_C} select 'mesh_without_pointcloud' as side, page_id as stem from {{pages}} m left anti join {{labels}} l on m.page_id = l.doc_id union all select 'pointcloud_without_mesh', doc_id from {{labels}} l left anti join {{pages}} m on m.page_id = l.doc_id",
    "stem_collisions": "with s as (select p_partkey, lower(trim(p_name)) as stem from {part}), n as (select *, count(*) over (partition by stem) as n, row_number() over (partition by stem order by p_partkey) as rn from s) select stem, p_partkey, rn = 1 as kept from n where n > 1",
    "first_by_path": "with s as (select url, regexp_extract(url, '//([^/]+)', 1) as stem from {pages}), r as (select *, row_number() over (partition by stem order by url) as rn from s) select stem, url from r where rn = 1",
    "stem_norm": "select c_custkey, trim(lower(@GSUB[c_name; @SPACE; ' '])) as stem from {customer}",
    "stable_seed": "select p_partkey, @SEED[cast(p_name as varchar(200)); 2147483648] as seed from {part}",
    "manifest_strict_join": f"{_C} select c.stem, c.folder, l.quality from corpus c join {{labels}} l on c.stem = l.doc_id",
    "folder_default_join": f"{_C} select l.stem, coalesce(c.folder, '?') as folder from corpus l left join (select page_id, max(regexp_extract(url, '//([^/]+)', 1)) as folder from {{pages}} group by page_id) c on c.page_id = l.stem",
    "stems_semi": f"{_C} select stem, folder from corpus left semi join {{labels}} l on stem = l.doc_id",
    "stems_anti": f"{_C} select stem, folder from corpus left anti join {{labels}} l on stem = l.doc_id",
    "skip_built_anti": f"{_C} select stem, folder from corpus left anti join (select doc_id from {{labels}} where quality = 1) b on stem = b.doc_id",
    "pinned_missing": "select l.doc_id as stem from (select doc_id from {labels} where toxic = 1) l left anti join {pages} c on c.page_id = l.doc_id",
    "split_within_folder": f"{_C}, r as (select stem, folder, count(*) over (partition by folder) as n, row_number() over (partition by folder order by sha1(cast(stem as varchar(20))), stem) as rn from corpus) select stem, folder, case when rn <= greatest(1, @BROUND[n * cast(0.1 as double)]) then 'val' else 'train' end as side from r",
    "split_pinned": f"{_C}, p as (select c.stem, c.folder, case when l.doc_id is null then 0 else 1 end as pinned from corpus c left join (select distinct doc_id from {{labels}} where toxic = 1) l on l.doc_id = c.stem), r as (select *, count(*) over (partition by folder) as n, row_number() over (partition by folder order by pinned desc, sha1(cast(stem as varchar(20))), stem) as rn from p) select stem, folder, case when pinned = 1 or rn <= greatest(1, @BROUND[n * cast(0.1 as double)]) then 'val' else 'train' end as side, pinned from r",
    "stratified_round_robin": f"{_C}, r as (select stem, folder, row_number() over (partition by folder order by stem) as rn from corpus), t as (select * from r where rn <= 30 order by rn, folder limit 30) select stem, folder, row_number() over (order by rn, folder) as place from t",
    "stems_by_folder": f"{_C} select folder, @SORTED[cast(stem as varchar(20))] as stems, count(*) as n from corpus group by folder",
    "folders": f"{_C} select distinct folder from corpus",
    "inventory": f"{_C} select folder, count(*) as n, count_if(n_chars > 5000) as oversize, min(n_chars) as least, max(n_chars) as most from corpus group by folder",
    "signature_dedup": "with s as (select p_partkey, p_brand, p_size % 7 as a, p_partkey % 5 as b, p_partkey % 3 as c from {part}), r as (select *, row_number() over (partition by p_brand, a, b, c order by p_partkey) as rn from s) select p_partkey, p_brand from r where rn = 1",
    "sorted_signature_duplicates": "with s as (select p_partkey, 1 + p_size % 7 as a, 1 + p_partkey % 5 as b, 1 + p_partkey % 3 as c from {part}), k as (select least(a, b, c) as lo, a + b + c - least(a, b, c) - greatest(a, b, c) as mid, greatest(a, b, c) as hi from s) select lo, mid, hi, count(*) as n from k group by lo, mid, hi having count(*) > 1",
    "folder_overlap": "with s as (select distinct p_brand as folder, concat(p_size % 7, '/', p_partkey % 5, '/', p_partkey % 3) as sig from {part}), n as (select folder, count(*) as n from s group by folder), j as (select x.folder as folder_a, y.folder as folder_b, count(*) as shared from s x join s y on x.sig = y.sig and x.folder < y.folder group by x.folder, y.folder) select folder_a, folder_b, shared, round(shared / cast(a.n as double), 9) as share_a, round(shared / cast(b.n as double), 9) as share_b from j join n a on a.folder = folder_a join n b on b.folder = folder_b",
    "internal_duplicates": "select p_brand as folder, count(*) as n, count(*) - count(distinct concat(p_size % 7, '/', p_partkey % 5, '/', p_partkey % 3)) as duplicates from {part} group by p_brand",
    "folder_cap": f"{_C}, r as (select stem, folder, row_number() over (partition by folder order by stem) as rn from corpus) select stem, folder from r where rn <= 20",
    "folder_pooling": f"{_C} select case when folder in ('src1', 'src2', 'src3') then 'pooled' else folder end as pool, count(*) as n from corpus group by case when folder in ('src1', 'src2', 'src3') then 'pooled' else folder end",
    "reconcile": f"{_C}, b as (select stem, folder from corpus left semi join {{labels}} l on stem = l.doc_id), r as (select doc_id as stem from {{labels}} where quality = 0), k as (select doc_id as stem from {{labels}} where quality = 1), v as (select stem from b where stem % 10 = 0), t as (select stem from b left anti join r on r.stem = b.stem) select (select count(*) from b) as selected, (select count(*) from r) as rejected, (select count(*) from k) as cached, (select count(*) from v left semi join k on k.stem = v.stem) as val, (select count(*) from t left anti join v on v.stem = t.stem) as train, (select count(*) from b) - (select count(*) from r) = (select count(*) from k) and (select count(*) from v left semi join k on k.stem = v.stem) + (select count(*) from t left anti join v on v.stem = t.stem) = (select count(*) from k) as holds",
    "shortfall": f"{_C}, s as (select folder, cast(stem % 7 as bigint) as n_topup, 100 - cast(stem % 7 as bigint) as n_even, stem % 13 <> 0 as ok from corpus) select cast(coalesce(sum(case when ok then n_topup end), 0) as bigint) as n_topup, round(coalesce(sum(case when ok then n_topup end), 0) / cast(greatest(1, 100 * count_if(ok)) as double), 9) as share, coalesce(max(case when ok then n_topup end), 0) as most, round(count_if(ok and n_topup > 0) / cast(greatest(1, count_if(ok)) as double), 9) as shapes_share from s",
    "smallest_file": f"{_C} select folder, min(stem) as stem, min(n_chars) as size from (select folder, stem, n_chars, min(n_chars) over (partition by folder) as least from corpus) t where n_chars = least group by folder",
    "written_order": f"{_C} select stem, folder, n_chars from corpus order by folder, stem limit 50",
    "given_before_default": "select l.doc_id as stem, coalesce(p.page_id * 2, l.quality + 4000, 4000) as budget, case when p.page_id is not null then 'flag' when l.quality is not null then 'network' else 'data' end as origin from {labels} l left join {pages} p on p.page_id = l.doc_id",
    "run_names": "select event_id, @STAMP[ts] as run from {events}",
    "run_boundaries": "with s as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as was from {events}), r as (select user_id, event_id, event_type, cast(sum(case when was is null or was <> event_type then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) as run from s) select user_id, run, min(event_id) as first_id, count(*) as n from r group by user_id, run",
    "exclusive_offsets": f"{_C} select folder, stem, n_chars, cast(coalesce(sum(n_chars) over (partition by folder order by stem rows between unbounded preceding and 1 preceding), 0) as bigint) as begin_at from corpus",
    "folder_counts_map": f"{_C}, c as (select folder, count(*) as n from corpus group by folder) select @SORTED[concat(folder, '=', cast(n as varchar(20)))] as counts, count(*) as n_folders from c",
    "status_reasons": f"{_C} select stem, concat('[', case when n_chars < 200 then 'reject' when stem % 17 = 0 then 'error' else 'ok' end, '] ', concat_ws('; ', case when n_chars < 200 then 'too short' end, case when stem % 17 = 0 then 'unreadable' end, case when lang <> 'en' then 'not english' end)) as reason from corpus",
    "union_with_side": f"{_C} select 'corpus' as side, stem from corpus union all select 'labels', doc_id from {{labels}}",
    "best_step": f"{_L} select min_by(step, val_bce) as best_step, round(min(val_bce), 9) as best_bce from (select min(step) as step, val_bce from log group by val_bce) t",
    "running_best": f"{_L}, b as (select cast(floor(step / 100) as bigint) as step, min(val_bce) as v from log group by cast(floor(step / 100) as bigint)) select step, round(v, 9) as v, round(min(v) over (order by step rows between unbounded preceding and current row), 9) as best from b",
    "steady_rate": f"{_L}, b as (select cast(floor(step / 1000) as bigint) as s, max(step) as last, avg(val_bce) as v from log group by cast(floor(step / 1000) as bigint)) select s, last, last - lag(last) over (order by s) as advance, round(v - lag(v) over (order by s), 9) as change from b",
    "lr_schedule": f"{_L} select step, round(case when step < 200 then 0.001 * (step + 1) / 200 when step < 600 then 0.001 else 0.00001 + 0.5 * (0.001 - 0.00001) * (1 + cos(pi() * least(1, (step - 600) / cast(400 as double)))) end, 12) as lr from log",
    "epoch_batches": f"{_L}, r as (select step, row_number() over (order by sha1(cast(step as varchar(20))), step) - 1 as rn, count(*) over () as n from log) select step, cast(floor(rn / 32) as bigint) as batch from r where rn < floor(n / 32) * 32",
}
