"""What the reference queries compute, in SQL for DuckDB."""

from __future__ import annotations

_E = "E as (select vec_id + 1 as i, unnest(range(1, len(embedding) + 1)) as j, unnest(embedding)::double as v, label from embeddings)"
_TRADE = """trade as (select c_nationkey + 1 as i, s_nationkey + 1 as j, sum(l_quantity) / 100 as v from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all),
    cells as (select a.i, b.j from range(1, 26) a(i), range(1, 26) b(j)),
    m as (select i, j, coalesce(v, 0) as v from cells left join trade using (i, j)),
    both_ways as (select a.i, a.j, a.v + b.v as v from m a join m b on a.i = b.j and a.j = b.i)"""
_CENTRES = f"{_E}, c0 as (select label + 1 as k, j, avg(v) as v from E group by all)"


def _assign(name: str, centres: str) -> str:
    return f"""{name}d as (select i, k, sum((E.v - c.v) ** 2) as d from E join {centres} c using (j) group by all),
        {name} as (select i, k as y from {name}d qualify row_number() over (partition by i order by d, k) = 1)"""


def _step(n: int) -> str:
    return f"{_assign(f'a{n}', f'c{n}')}, c{n + 1} as (select y as k, j, avg(v) as v from E join a{n} using (i) group by all)"


_CHAIN = ", ".join(f"s{n} as (select o_orderkey, (x * y / x + x - y * x) * 5 as x, y from s{n - 1})" for n in range(1, 6))
_ORDER = "start_nanos nulls first, logged_at nulls first, span_id nulls first, end_nanos nulls first, caller_id nulls first"
_GAPS = f"""ordered as (select run_id, thread_id, start_nanos as st, end_nanos as en,
            lead(start_nanos) over (partition by run_id, thread_id order by {_ORDER}) as next_st from compute_event_log
            where run_id is not null and thread_id is not null and start_nanos is not null),
        gaps as (select run_id, thread_id, en as start_ns, next_st - en as duration_ns from ordered where en > st and next_st > en)"""
_BUSY = """busy as (select run_id, thread_id, start_nanos as start_ns, end_nanos - start_nanos as duration_ns, caller_id as label from compute_event_log
        where run_id is not null and thread_id is not null and end_nanos > start_nanos)"""
_CONFS = """confs as (select p_partkey as id, 'part' as tbl, case p_partkey % 5 when 0 then 'java -Xmx' || p_size || 'g -jar' when 1 then p_size || 'MiB' when 2 then p_size || ' k'
            when 3 then 'cfg' || p_size else p_size || '.5t' end as conf from part
        union all select run_id, 'run_settings', conf from run_settings union all select record_id, 'results', conf from results)"""


def _bytes(c: str) -> str:
    """Word by word: a number with its unit in the same or the next word; the word behind the heap option comes first."""
    words = f"list_filter(string_split_regex(regexp_replace(replace(lower({c}), '-xmx', ' ^ '), '[^a-z0-9.^\\s]', ' | ', 'g'), '\\s+'), lambda w: w <> '')"
    power = "list_position(['', 'k', 'm', 'g', 't', 'p'], regexp_replace({0}, 'i?b$', '')) - 1"
    number, unit = "regexp_extract(w, '^[0-9]+([.][0-9]+)?')", "substr(w, len(regexp_extract(w, '^[0-9]+([.][0-9]+)?')) + 1)"
    own, after = power.format(unit), power.format("coalesce(ws[i + 1], '-')")
    scale = f"case when {unit} = '' then pow(1024, coalesce({after}, 0)) else pow(1024, {own}) end"
    amounts = f"list_transform({words}, lambda w, i: struct_pack(b := try_cast(nullif({number}, '') as double) * {scale.replace('ws[', words + '[')}, h := i > 1 and ({words})[i - 1] = '^'))"
    return f"(select coalesce(list_filter(f, lambda x: x.h)[1].b, f[1].b) from (select list_filter({amounts}, lambda x: x.b is not null) as f))"


def _dim(n: str) -> str:
    steps = " ".join(f"when {n} >= {size} and {n} % {size} = 0 then {n} // {size} || '{u}'" for size, u in ((10**9, "B"), (10**6, "M"), (10**3, "k")))
    return f"case {steps} else {n}::varchar end"


_NUMBER = r"([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"

ORACLE = {
    "ceil_mean": f"with {_E} select round(avg(ceil(v * 8)), 9) as mean_ceil from E",
    "transpose_add_ceil_mean": f"with {_TRADE} select round(avg(ceil(v)), 9) as mean_ceil from both_ways",
    "transpose_add": f"with {_TRADE} select i, j, round(v, 6) as v from both_ways",
    "sin_mul_chain": f"""with {_E}, b as (select a.i, 8 * a.v as x, 8 * b.v as y from E a join E b on a.i = b.i and b.j = 65 - a.j)
        select i, round(avg(sin(sin(sin(sin(x * y) * y) * y) * y)), 6) + 0.0::double as mean_sin from b group by i""",
    "right_index": f"with {_E} select count(*) as n_cells, max(i) - 100 as n_rows, round(avg(v), 9) as mean from E where i between 101 and 400 and j between 15 and 50",
    "contains_zero": "select coalesce(bool_or(l_discount = 0), false) as l_discount_has_zero, coalesce(bool_or(l_tax = 0), false) as l_tax_has_zero, coalesce(bool_or(l_quantity = 0), false) as l_quantity_has_zero from lineitem",
    "matrix_aggregates": """with m as (select l_partkey, l_suppkey, sum(l_discount) as v from lineitem group by all), shape as (select (max(l_partkey) + 1) * (max(l_suppkey) + 1) as n from lineitem)
        select round(sum(v), 4) as total, round(sum(v) / any_value(n), 9) as mean, round(case when count(*) < any_value(n) then least(min(v), 0) else min(v) end, 9) as least,
               bool_or(v = 0) or count(*) < any_value(n) as has_zero from m, shape""",
    "matvec_means": f"with {_E}, p as (select j, avg(v) as v from E group by j) select i, round(sum(E.v * p.v), 6) + 0.0::double as v from E join p using (j) group by i",
    "gram_matrix": f"with {_E} select a.j, b.j as k, round(sum(a.v * b.v), 6) + 0.0::double as v from E a join E b using (i) group by a.j, b.j",
    "xty": f"with {_E} select j, round(sum(v * label), 6) + 0.0::double as v from E group by j",
    "matmul": f"with {_CENTRES} select i, k as j, round(sum(E.v * c0.v), 6) + 0.0::double as v from E join c0 using (j) group by i, k",
    "onehot": "select vec_id + 1 as i, (label + 1)::bigint as j, 1.0::double as v from embeddings",
    "onehot_counts": "select label, count(*) as n from embeddings group by label",
    "cell_chain": f"with s0 as (select o_orderkey, o_totalprice / 1e5 as x, (o_custkey % 89 + 1) / 90 as y from orders), {_CHAIN} select o_orderkey, floor(x * 1e4 + 0.123)::bigint as x_e4 from s5",
    "cell_join": """with a as (select o_orderkey + 1 as i, o_totalprice / 1e5 as x from orders), b as (select l_orderkey + 1 as i, sum(l_quantity) as y from lineitem
            where l_orderkey <= (select max(o_orderkey) from orders) group by all),
        m as (select i, coalesce(x, 0) as x, coalesce(y, 0) as y from a full join b using (i)) select i, round(x * y / x + x - y * x, 9) as v from m""",
    "div_ieee": """with q as (select (l_linenumber - 4)::double / l_tax as q from lineitem)
        select case when isnan(q) then 'nan' when isinf(q) and q > 0 then 'inf' when isinf(q) then '-inf' else q::decimal(12, 2)::varchar end as quotient, count(*) as n from q group by 1""",
    "floor_vals": "select o_orderkey, floor(o_totalprice / 1e3)::double as v from orders",
    "indicator": "select o_orderkey, (o_totalprice / 1e5 <= 1)::int::double as v from orders",
    "clamp_ifelse": "select p_partkey, least(greatest(p_size, 10), 40)::double as v from part",
    "abs_chain": "select min(abs(c_acctbal)) as least from customer",
    "sqrt_chain": "select c_custkey, round(list_reduce(list_prepend(abs(c_acctbal), range(1, 21)::double[]), lambda a, i: sqrt(a)), 9) as v from customer",
    "seq_vec": "select row_number() over (order by x) as i, x::double as v from (select unnest(generate_series(1, 100000, 3)) as x)",
    "lloyd_assign": f"with {_CENTRES}, {_assign('a0', 'c0')} select i, y from a0",
    "lloyd_3": f"with {_CENTRES}, {_step(0)}, {_step(1)}, {_step(2)}, {_assign('a3', 'c3')} select i, y from a3",
    "pca_total_variance": f"with {_E} select round(sum(s), 6) as total_variance from (select var_samp(v) as s from E group by j)",
    "lm_cg": f"""with recursive {_E},
        cells as (select a.j, b.j as k, sum(a.v * b.v) as s from E a join E b using (i) group by a.j, b.j),
        lines as (select j, list(s order by k) as line from cells group by j),
        g as (select list(line order by j) as g from lines),
        t as (select list(s order by j) as b from (select j, sum(v * label) as s from E group by j)),
        cg as (
            select 0 as n, list_transform(b, lambda x: 0.0::double) as beta, list_transform(b, lambda x: -x) as r, b as p, list_dot_product(b, b) as rr, list_dot_product(b, b) as r0, g.g as g from g, t
            union all
            select n + 1, beta, r, list_transform(list_zip(r, p), lambda z: -z[1] + rr / old * z[2]), rr, r0, g from (
                select *, list_dot_product(r, r) as rr from (
                    select n, g, r0, p, rr as old, list_transform(list_zip(beta, p), lambda z: z[1] + rr / list_dot_product(p, q) * z[2]) as beta,
                           list_transform(list_zip(r, q), lambda z: z[1] + rr / list_dot_product(p, q) * z[2]) as r
                    from (select *, list_transform(list_zip(list_transform(g, lambda line: list_dot_product(line, p)), p), lambda z: z[1] + 1e-12 * z[2]) as q
                          from cg where rr > r0 * 1e-14 and n < 64))))
        select unnest(range(1, len(beta) + 1)) as j, round(unnest(beta), 5) + 0.0::double as beta from (select beta from cg order by n desc limit 1)""",
    "bounds": """with parts as (select run_id, min(start_nanos) as a, max(end_nanos) as b from compute_event_log group by 1
        union all select run_id, min(start_nanos), max(end_nanos) from disk_read_event_log group by 1 union all select run_id, min(start_nanos), max(end_nanos) from disk_write_event_log group by 1
        union all select run_id, min(timestamp_ns), max(timestamp_ns) from cache_size_event_log group by 1) select run_id, min(a) as min_ns, max(b) as max_ns from parts group by run_id""",
    "thread_count": "select run_id, count(distinct thread_id) as n_threads from compute_event_log group by run_id",
    "caller_totals": "select caller_id, sum(end_nanos - start_nanos)::bigint as total_ns from compute_event_log where end_nanos > start_nanos group by 1 having sum(end_nanos - start_nanos) >= 20000000",
    "idle_gaps": f"with {_GAPS} select * from gaps",
    "islands": f"""with {_BUSY}, told as (select *, start_ns + duration_ns as en, row_number() over w as nr, lag(label) over w as was, lag(start_ns + duration_ns) over w as till from busy
            window w as (partition by run_id, thread_id order by start_ns, duration_ns, label nulls first)),
        numbered as (select *, sum((nr = 1 or was is distinct from label or till <> start_ns)::int) over (partition by run_id, thread_id order by nr) as island from told)
        select run_id, thread_id, any_value(label) as label, min(start_ns) as start_ns, sum(duration_ns)::bigint as duration_ns, count(*) as n_segments from numbered group by run_id, thread_id, island""",
    "segment_totals": f"""with {_GAPS}, {_BUSY}, both_kinds as (select run_id, thread_id, duration_ns as busy, 0 as idle from busy union all select run_id, thread_id, 0, duration_ns from gaps)
        select run_id, thread_id, sum(busy)::bigint as busy_ns, sum(idle)::bigint as idle_ns, count(*) as n_segments from both_kinds group by all""",
    "rel_time": """with b as (select run_id, min(start_nanos) as a from compute_event_log where run_id is not null group by 1)
        select run_id, span_id, logged_at, round((start_nanos - a) / 1e6, 6) as start_ms, round((end_nanos - start_nanos) / 1e6, 6) as duration_ms
        from compute_event_log join b using (run_id) where end_nanos > start_nanos""",
    "caller_index": "select caller_id, dense_rank() over (order by caller_id) - 1 as idx, (dense_rank() over (order by caller_id) - 1) % 20 as colour from (select distinct caller_id from compute_event_log where caller_id is not null)",
    "ordered_unique": "select experiment, first_position, row_number() over (order by first_position, experiment) - 1 as place from (select experiment, min(record_id) as first_position from results where experiment is not null group by 1)",
    "cache_series": """with f as (select run_id, min(timestamp_ns) as a from cache_size_event_log where run_id is not null group by 1)
        select run_id, reading_id, timestamp_ns, round((timestamp_ns - a) / 1e9, 9) as seconds, coalesce(scheduled_eviction_size, 0) as scheduled_eviction_size, coalesce(cache_size, 0) as cache_size,
               coalesce(pinned_size, 0) as pinned_size, coalesce(read_reserved_size, 0) as read_reserved_size, s.cache_eviction_limit as soft_limit, s.cache_hard_limit as hard_limit
        from cache_size_event_log join f using (run_id) left join run_settings s using (run_id) where timestamp_ns is not null""",
    "limits": """select run_id, case when cache_hard_limit is not null then cache_eviction_limit end as soft, case when cache_eviction_limit is not null then cache_hard_limit end as hard from run_settings""",
    "conf_bytes": f"with {_CONFS} select tbl, id, {_bytes('conf')} as bytes from confs",
    "conf_order": f"""with f as (select conf, min(record_id) as pos from results where conf is not null group by 1), b as (select *, {_bytes('conf')} as bytes from f)
        select conf, bytes, row_number() over (order by bytes is null, bytes, pos, conf) - 1 as place from b""",
    "xmx_mb": rf"""with {_CONFS}, n as (select *, try_cast(nullif(regexp_extract(conf, '(?:^|\s)-Xmx([0-9]+)([gGmMkK])(?:\s|$)', 1), '') as bigint) as h, lower(regexp_extract(conf, '(?:^|\s)-Xmx([0-9]+)([gGmMkK])(?:\s|$)', 2)) as hu,
            try_cast(nullif(regexp_extract(conf, '^([0-9]+)([gGmMkK]?)$', 1), '') as bigint) as v, lower(regexp_extract(conf, '^([0-9]+)([gGmMkK]?)$', 2)) as vu from confs)
        select tbl, id, coalesce(case hu when 'g' then h * 1024 when 'm' then h when 'k' then h // 1024 end, 1024) as heap_mb, case vu when 'g' then v * 1024 when 'k' then v // 1024 else v end as value_mb from n""",
    "dim_format": """with n as (select p_partkey, p_partkey * p_size * 500 as n from part) select p_partkey, case when n >= 1000000000 and n % 1000000000 = 0 then n // 1000000000 || 'B'
        when n >= 1000000 and n % 1000000 = 0 then n // 1000000 || 'M' when n >= 1000 and n % 1000 = 0 then n // 1000 || 'k' else n::varchar end as label from n""",
    "setup_label": """with p as (select record_id, setup, list_filter(string_split(setup, '_'), lambda x: x <> '') as parts from scheduling_results),
        r as (select *, list_transform(list_filter(parts[2:], lambda x: x <> 'x'), lambda x: regexp_replace(x, 'x$', '')) as rest from p)
        select record_id, case when len(parts) = 0 then setup when len(rest) = 0 then upper(parts[1]) else upper(parts[1]) || chr(10) || array_to_string(rest, ' x ') end as label from r""",
    "exp_title": """with n as (select p_partkey as id, 'kmeans_warm_' || lower(p_type) as name from part union all select record_id, experiment from results),
        p as (select *, list_filter(string_split(name, '_'), lambda x: x <> '') as parts from n)
        select id, name, case when len(parts) = 0 then name else array_to_string(list_transform(parts, lambda x: case lower(x) when 'pca' then 'PCA' when 'lmcg' then 'LMCG' when 'kmeans' then 'K-MEANS' when 'warm' then 'Warm' else upper(x) end), ' ') end as title from p""",
    "last_metric": rf"select doc_id, try_cast(regexp_extract_all(text, '(?:took)\s*{_NUMBER}', 1)[-1] as double) as took from documents",
    "run_status": "select doc_id, case when text is null or regexp_matches(text, 'ERROR|stream closed') then 'failed' else 'ok' end as status from documents",
    "result_pivot": """with l as (select experiment, lower(trim(mode)) as mode, conf, arg_max(row(rep1), row(recorded_at, record_id))[1] as rep1 from results group by all),
        s as (select distinct experiment, mode from l where mode is not null and conf is not null), a as (select distinct experiment, conf from l where mode is not null and conf is not null)
        select s.experiment, s.mode, a.conf, case when rep1 is null or isnan(rep1) then 'nan' else round(rep1, 3)::decimal(20, 3)::varchar end as value
        from s join a on s.experiment = a.experiment left join l on l.experiment = s.experiment and l.mode = s.mode and l.conf = a.conf""",
    "mode_pivot": """with t as (select user_id, event_type, round(sum(value), 4) as v from events group by all)
        select user_id, max(v) filter (where event_type = 'click') as v_click, max(v) filter (where event_type = 'view') as v_view, max(v) filter (where event_type = 'purchase') as v_purchase,
            max(v) filter (where event_type = 'signup') as v_signup, max(v) filter (where event_type = 'error') as v_error from t group by user_id""",
    "sched_pivot": """with r as (select setup, lower(trim(exec_mode)) as mode, max(runtime_s) as value from scheduling_results where runtime_s is not null and not isnan(runtime_s) and exec_mode is not null group by all)
        select mode, setup, value from r where setup in (select setup from r group by setup having count(*) = (select count(distinct mode) from r))""",
    "result_axis": """with t as (select experiment, coalesce(max(rep1) filter (where not isnan(rep1) and not isinf(rep1)), 1.0) as top from results group by 1) select experiment, top, round(top * 1.18, 6) as axis_top from t""",
    "spans_load": """select thread_id, count(*) as n, min(start_nanos) as first_start, max(end_nanos) as last_end, count(distinct coalesce(caller_id, '')) as n_callers from compute_event_log group by thread_id""",
    "cache_load": """select timestamp_ns, scheduled_eviction_size, cache_size, coalesce(pinned_size, 0) as pinned_size, coalesce(read_reserved_size, 0) as read_reserved_size from cache_size_event_log
        """,
    "results_load": """select mode, conf, count(*) as n, count(*) filter (where rep1 is null or isnan(rep1)) as n_failed, round(sum(rep2) filter (where not isnan(rep2)), 3) as rep2 from results group by all""",
}
ORACLE["matrix_files"] = f"with {_E} select i, count(*) as n_cells, round(sum(v), 6) + 0.0::double as total, (select count(*) from embeddings) as n_rows from E group by i"
ORACLE["sched_load"] = "select setup, exec_mode, count(*) as n, round(sum(runtime_s) filter (where not isnan(runtime_s)), 3) as total_s from scheduling_results group by all"
ORACLE["results_sink"] = """select mode, conf, count(*) as n, count(*) filter (where rep1 is null or isnan(rep1)) as n_failed, round(sum(rep3) filter (where not isnan(rep3)), 3) as rep3 from results
    where mode is not null and conf is not null group by all"""
ORACLE["compare"] = """with c as (select o_orderkey, o_totalprice / 1e5 as a, o_custkey::double / 100 as b from orders)
    select o_orderkey, (a < b)::int::double as lt, (a > b)::int::double as gt, (a <= b)::int::double as le from c"""
ORACLE["rand_moments"] = "select kind, true as count_ok, true as range_ok, true as mean_ok, true as spread_ok, true as cells_once from (values ('uniform'), ('normal'), ('sparse')) t(kind)"
ORACLE["blobs_labels"] = "select label, true as all_near from range(1, 9) t(label)"
ORACLE["dataset_matrix"] = """select name, nrow::bigint as nrow, ncol::bigint as ncol, true as first, false as again from (values ('mat_10000x10000_1', 10, 10), ('mat_10000x10000_2', 10, 10), ('mat_10000x10000_3', 10, 10),
    ('mat_1000000x1000_1', 1000, 1000), ('mat_1000000x1000_2', 1000, 1000), ('mat_1000000x1_1', 1000, 1), ('mat_1000000x1_2', 1000, 1),
    ('blobs_4000000x256_1_X', 4000, 256), ('blobs_4000000x256_1_C', 32, 256), ('blobs_4000000x256_1_Y', 4000, 1)) t(name, nrow, ncol)"""
ORACLE["kmeans_given"] = ORACLE["lloyd_3"]
ORACLE["pca_norms"] = f"with {_E}, m as (select j, avg(v) as a from E group by j) select i, round(sum((v - a) ** 2), 6) + 0.0::double as norm from E join m using (j) group by i"
ORACLE["tile_transpose_add"] = f"""with {_E}, g as (select a.i, b.i as j, round(sum(a.v * b.v * j), 6) as v from E a join E b using (j) group by a.i, b.i)
    select sum(ceil(8 * (x.v + y.v) + 0.0301)) as total, count(*) as n_cells from g x join g y on x.i = y.j and x.j = y.i"""
ORACLE["limits_file"] = """select cache_eviction_limit as soft, cache_hard_limit as hard from run_settings where cache_hard_limit is not null and cache_eviction_limit is not null order by run_id limit 1"""
ORACLE["dim_extract"] = f"""with n as (select p_partkey, p_size * 1000 as a, p_partkey as b from part)
    select p_partkey, case when p_partkey % 7 > 1 then {_dim('a')} || ' x ' || {_dim('b')} end as dims from n"""
ORACLE["sched_axis"] = "select setup, max(runtime_s) as top, round(max(runtime_s) * 1.18, 6) as axis_top from scheduling_results where runtime_s is not null and not isnan(runtime_s) group by setup"
ORACLE["result_rows"] = f"""with l as (select experiment, lower(trim(mode)) as mode, conf, arg_max(row(rep1), row(recorded_at, record_id))[1] as rep1, arg_max(record_id, row(recorded_at, record_id)) as pos from results group by all),
    ok as (select *, {_bytes('conf')} as size from l where mode is not null and conf is not null),
    a as (select experiment, conf, any_value(size) as size, min(pos) as first from ok group by all), s as (select distinct experiment, mode from ok),
    full_ as (select s.experiment, s.mode, a.conf, a.size, a.first, case when ok.rep1 is null or isnan(ok.rep1) then 'nan' else round(ok.rep1, 3)::decimal(20, 3)::varchar end as cell
              from s join a on s.experiment = a.experiment left join ok on ok.experiment = s.experiment and ok.mode = s.mode and ok.conf = a.conf)
    select experiment, mode, string_agg(conf, ';' order by size is null, size, first, conf) as confs, string_agg(cell, ';' order by size is null, size, first, conf) as cells from full_ group by all"""
ORACLE["tile_gram"] = ORACLE["gram_matrix"]
