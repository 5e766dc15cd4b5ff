"""The text queries' answers in SQL, straight from the tables that the corpus was written from."""

from __future__ import annotations

from .oracle import GRAPH
from .oracle import SQL as GRAPH_SQL

TS = r"""
with ts as (
    select p_partkey as k, 'src/' || replace(p_brand, '#', '') || '/m' || (p_partkey // 40) || '.ts' as path, p_partkey // 40 as block from part
), placed as (
    select *, row_number() over (partition by path order by k) as i, coalesce(lead(k) over (partition by path order by k), min(k) over (partition by path)) as nxt from ts
)
"""
MD = r"""
with md as (select s_suppkey as k, s_name, s_nationkey as nation, 'docs/n' || s_nationkey || '/' || (s_suppkey // 20) || '.md' as path from supplier),
placed as (select *, row_number() over (partition by path order by k) as i, count(*) over (partition by path) as n from md)
"""
RS = r"""
with rs as (select s_suppkey as k, 'crate/src/n' || s_nationkey || '_' || (s_suppkey // 20) || '.rs' as path, 'n' || s_nationkey || '_' || (s_suppkey // 20) as module from supplier),
placed as (select *, row_number() over (partition by path order by k) as i, coalesce(lead(k) over (partition by path order by k), min(k) over (partition by path)) as nxt from rs)
"""
LINES = MD + r""", lines as (
    select distinct path, 1 as line, '# Nation ' || nation as text from placed
    union all select path, 7 * i - 5, '## ' || s_name from placed
    union all select path, 7 * i - 4, 'Calls `p' || k || '` in src/shared/util.ts.' from placed
    union all select path, 7 * i - 3, '```' from placed
    union all select path, 7 * i - 2, '$ npm run s' || (k % 7) from placed
    union all select path, 7 * i - 1, '```' from placed
    union all select path, 7 * i, 'GET /api/s/' || k from placed
    union all select path, 7 * i + 1, 'cargo test.' from placed
    union all select distinct path, 7 * n + 2, '' from placed
)
"""
SLUG = "replace(lower(s_name), '#', '-')"
UPSERTS = r"""
with first as (select '10:' || lpad(cast(c_custkey as varchar), 9, '0') as ord, cast(c_custkey as varchar) as id, 'function' as kind, c_name as name from customer)
"""
FOLDERS = r"""
with folders as (
    select 'src' as f union select 'src/shared' union select 'crate' union select 'crate/src' union select 'docs' union select 'pkg' union select 'tests'
    union select 'src/' || replace(p_brand, '#', '') from part union select 'docs/n' || s_nationkey from supplier union select 'pkg/r' || n_regionkey from nation
)
"""
LANE = """case when graph_domain = 'knowledge' then 'knowledge' when kind = 'external_package' then 'external' when file like 'tests/%' then 'tests' when kind = 'react_component' then 'frontend'
    when kind = 'framework_event' then 'bridge' when kind in ('repository', 'directory') then 'core' else 'other' end"""
LANGUAGE = "case when source_category is not null then source_category when graph_domain = 'knowledge' then 'knowledge' when language is not null then language when kind = 'framework_event' then 'framework' end"
EVENTS = r"""
with ev as (select event_type || case when user_id % 9 = 0 then '/node_modules/a.ts' else '/a.ts' end as path, ts, user_id from events)
"""
GRIDDED = f"""placed as (select id, qualified_name, {LANE} as lane from nodes where kind in ('file', 'external_package', 'framework_event')),
sized as (select *, count(*) over (partition by lane) as n, row_number() over (partition by lane order by qualified_name, id) - 1 as nth from placed),
shaped as (select *, cast(case when n <= 1 then 1 when lane = 'tests' then least(4, greatest(2, (n + 4) // 5)) when lane = 'external' then least(3, greatest(2, (n + 4) // 5)) when lane = 'bridge' then least(3, n) else least(3, greatest(1, cast(ceil(sqrt(n)) as bigint))) end as integer) as columns from sized)"""

RICH = """
with placed as (select c_custkey as k, 'src/model/c' || (c_custkey // 25) || '.ts' as path, 2 + 21 * (row_number() over (partition by c_custkey // 25 order by c_custkey) - 1) as l0 from customer)
"""

SQL: dict[str, str] = {
    "rust_modules": RS + "select count(distinct module) + 1 as modules from placed",
    "framework_files": RICH + f"""select distinct path, false as relevant from placed union all select 'src/shared/chain' || c || '.ts', false from range(31) as r(c) union all select 'src/view/v' || n_nationkey || '.tsx', true from nation""",
    "fallback_reasons": """select case when o_orderkey % 7 = 0 then 'graph schema changed' when o_orderkey % 5 = 0 then 'adapter version changed' when o_orderkey % 3 = 0 then 'configuration changed'
        else 'changed files have dependency, framework, or unresolved relationships requiring a full adapter rebuild' end as reason, count(*) as n from orders group by 1""",
    "index_states": "select case when o_orderkey % 2 <> 0 then 'missing' when o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 3 = 0 then 'stale' else 'fresh' end as state, count(*) as n from orders group by 1",
    "spliced_nodes": "select p_partkey as id, p_brand as file from part where p_brand not in ('Brand#12', 'Brand#34') union all select p_partkey + 1000000, p_brand from part where p_brand in ('Brand#12', 'Brand#34') and p_partkey % 2 = 0",
    "stored_neighborhood": GRAPH_SQL["neighborhood_edges"],
    "stored_affected": GRAPH_SQL["affected_transitive"],
    "token_kinds": RICH + "select path, v.kind, sum(v.n)::bigint + (case when v.kind = 'string' then 1 else 0 end) as n from placed, (values ('comment', 2), ('template', 2), ('string', 1), ('number', 1)) as v(kind, n) group by path, v.kind",
    "class_members": RICH + """select path, cast(l0 + v.a as integer) as line, cast(l0 + v.b as integer) as "end", v.kind, v.name || k as name, case when v.inside then 'Model' || k end as class, v.kind = 'method' and v.name = 'load' as async
        from placed, (values (4, 4, 'type_alias', 'Key', false), (5, 16, 'class', 'Model', false), (8, 14, 'method', 'load', true), (15, 15, 'method', 'name', true), (18, 18, 'method', 'run', false)) as v(a, b, kind, name, inside)""",
    "member_calls": RICH + """select path as source_file, v.s || k as source_name, case when v.t = 'base' then 'base' else v.t || k end as target_name, 'resolved' as confidence, cast(l0 + v.a as integer) as line
        from placed, (values ('load', 'name', 10), ('load', 'name', 11), ('load', 'base', 12), ('run', 'Model', 18)) as v(s, t, a)
        union all select 'src/view/v' || n_nationkey || '.tsx', 'View' || n_nationkey, 'call' || n_nationkey, 'resolved', 3 from nation""",
    "type_uses": RICH + """select path as source_file, v.s || k as source_name, 'Key' || k as target_name, 'resolved' as confidence, cast(l0 + v.a as integer) as line from placed, (values ('Model', 6), ('load', 8), ('load', 9)) as v(s, a)""",
    "jsx_renders": """select 'src/view/v' || n_nationkey || '.tsx' as source_file, 'View' || n_nationkey as source_name, 'View' || ((n_nationkey + 1) % 25) as target_name, 'probable' as confidence, 5 as line from nation
        union all select 'src/view/v' || n_nationkey || '.tsx', 'View' || n_nationkey, 'Panel' || n_nationkey, 'unresolved', 6 from nation""",
    "jsx_callbacks": "select 'src/view/v' || n_nationkey || '.tsx' as source_file, 'View' || n_nationkey as source_name, 'pick' || n_nationkey as target_name, 'probable' as confidence, 5 as line from nation",
    "call_cycles": TS + "select string_agg('p' || k, ',' order by i) as members, count(*) as length from placed group by path",
    "corpus_directories": FOLDERS + "select f as qualified_name, split_part(f, '/', -1) as name from folders",
    "corpus_directory_edges": FOLDERS + "select case when contains(f, '/') then split_part(f, '/', 1) else '' end as parent, f as child from folders",
    "text_lines": LINES + "select path, cast(line as integer) as line, text, cast(coalesce(sum(length(text) + 1) over (partition by path order by line rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from lines",
    "md_sections": MD + f"select distinct path, cast(1 as integer) as line, cast(1 as integer) as depth, 'Nation ' || nation as title, 'nation-' || nation as slug, cast(7 * n + 3 as integer) as \"end\" from placed union all select path, cast(7 * i - 5 as integer), 2, s_name, {SLUG}, cast(case when i = n then 7 * n + 3 else 7 * i + 2 end as integer) from placed",
    "md_commands": MD + f"select path, cast(7 * i - 2 as integer) as line, {SLUG} as section, 'npm run s' || (k % 7) as command, true as fenced from placed",
    "md_routes": MD + f"select path, cast(7 * i as integer) as line, {SLUG} as section, 'GET /api/s/' || k as route from placed",
    "package_facts": r"""
select 'pkg/r' || n_regionkey || '/package.json' as path, 'dependencies' as what, 'n' || n_nationkey as "key", '^' || n_nationkey as "value" from nation
union all select distinct 'pkg/r' || n_regionkey || '/package.json', 'script', 's' || i, 'run ' || i from nation, range(7) as r(i)
union all select distinct 'pkg/r' || n_regionkey || '/package.json', 'package', 'r' || n_regionkey, 'r' || n_regionkey from nation
""",
    "toml_entries": r"""
with n as (select *, row_number() over (partition by n_regionkey order by n_nationkey) as i, count(*) over (partition by n_regionkey) as c, 'pkg/r' || n_regionkey || '/Cargo.toml' as path from nation)
select path, cast(3 + i as integer) as line, 'dependencies' as section, 'n' || n_nationkey as "key", cast(n_nationkey as varchar) as "value" from n
union all select distinct path, cast(2 as integer), 'package', 'name', 'c' || n_regionkey from n
union all select distinct path, cast(5 + c as integer), 'features', 'all', '["a#b"]' from n
union all select distinct path, cast(7 + c as integer), 'bin:0', 'name', 'b' || n_regionkey from n
""",
    "ts_declarations": TS + "select path, cast(4 * i as integer) as line, cast(4 * i + 3 as integer) as \"end\", 'function' as kind, 'p' || k as name, true as exported from placed union all select 'src/shared/util.ts', 1, 1, 'function', 'helper', true",
    "ts_imports": TS + "select distinct path, 1 as line, '../shared/util' as specifier, 'src/shared/util.ts' as target from placed union all select distinct path, 2, './absent' || (block % 3), cast(null as varchar) from placed union all select distinct path, 3, '@scope' || (block % 4) || '/pkg/sub', cast(null as varchar) from placed union all select 'tests/n' || n_nationkey || '.test.ts', 1, '../src/shared/util', 'src/shared/util.ts' from nation",
    "ts_calls": TS + "select path as source_file, 'p' || k as source_name, 'p' || nxt as target_name, 'resolved' as confidence, cast(4 * i + 1 as integer) as line from placed union all select path, 'p' || k, 'helper', 'resolved', cast(4 * i + 2 as integer) from placed",
    "ts_unresolved_calls": TS + "select path as source_file, 'p' || k as source_name, 'lost' || (k % 5) as target_name, 'unresolved' as confidence, cast(4 * i + 2 as integer) as line from placed union all select 'tests/n' || n_nationkey || '.test.ts', 'n' || n_nationkey || '.test.ts', t.f, 'unresolved', t.l from nation, (values ('it', 2), ('test', 3)) as t(f, l)",
    "ts_diagnostics": TS + "select 'unresolved-import' as code, 'warning' as severity, count(distinct path) as n from placed union all select 'unresolved-function-call', 'info', (select count(*) from part) + 2 * (select count(*) from nation)",
    "range_owner": TS + "select path, cast(4 * i + o as integer) as line, 'p' || k as owner from placed, range(4) as r(o) union all select path, l, cast(null as varchar) from (select distinct path from placed), (values (1), (2), (3)) as h(l) union all select path, cast(4 * max(i) + 4 as integer), null from placed group by path",
    "rust_items": RS + "select path, cast(6 * i - 4 as integer) as line, cast(6 * i + 1 as integer) as \"end\", 'function' as kind, 's' || k as name, cast(null as varchar) as owner_type, module from placed union all select * from (values ('crate/src/base.rs', 1, 1, 'struct', 'Base', null, 'base'), ('crate/src/base.rs', 3, 3, 'method', 'make', 'Base', 'base'), ('crate/src/base.rs', 5, 5, 'function', 'start', null, 'base')) as v(a, b, c, d, e, f, g)",
    "rust_calls": RS + "select path as source_file, 's' || k as source_name, 's' || nxt as target_name, 'resolved' as confidence, cast(6 * i - 3 as integer) as line from placed union all select path, 's' || k, 'start', 'resolved', cast(6 * i - 2 as integer) from placed union all select path, 's' || k, 'make', 'resolved', cast(6 * i - 1 as integer) from placed",
    "rust_unresolved_calls": RS + "select path as source_file, 's' || k as source_name, 'gone' || (k % 3) as target_name, 'unresolved' as confidence, cast(6 * i as integer) as line from placed",
    "test_names": "select 'tests/n' || n_nationkey || '.test.ts' as path, t.nth, case when t.nth = 0 then 'p' || n_nationkey || ' works' else 'n ' || n_nationkey end as name, t.nth + 2 as line, 'test_call' as method from nation, (values (0), (1)) as t(nth)",
    "tested_files": "select 'tests/n' || n_nationkey || '.test.ts' as path, 'src/shared/util.ts' as target, 'test_import_match' as method from nation",
    "linked_symbols": MD + ", t as (select p_partkey as k, 'src/' || replace(p_brand, '#', '') || '/m' || (p_partkey // 40) || '.ts' as path from part) select s.section, 'p' || s.k as symbol, t.path as target_file from (select s_name as section, k from placed union all select 'Nation ' || nation, k from placed) as s join t on t.k = s.k where s.k >= 10",
    "linked_paths": MD + "select s_name as section, 'util.ts' as file, cast(7 * i - 4 as integer) as line from placed union all select 'Nation ' || nation, 'util.ts', cast(3 as integer) from (select path, nation from placed where i = 1) as x",
    "linked_scripts": MD + "select distinct path as source_file, 'npm run s' || (k % 7) as command, 'script s' || (k % 7) as script from placed union select 'pkg/r' || n_regionkey || '/package.json', 'npm run s' || i, 'script s' || i from nation, range(7) as r(i)",
    "binding_gaps": r"""
with d as (select p_partkey as k from part where p_partkey % 3 <> 0), i as (select s_suppkey as k from supplier), r as (select n_nationkey as k from nation), p as (select r_regionkey as k from region), q as (select distinct n_regionkey as k from nation where n_regionkey <> 2)
select * from (
select 'unmatched-tauri-invoke' as code, 'warning' as severity, count(*) as n from i where k not in (select k from d)
union all select 'unregistered-tauri-command', 'warning', count(*) from d where k not in (select k from r)
union all select 'unused-tauri-command', 'info', count(*) from d where k not in (select k from i)
union all select 'registered-tauri-command-missing-definition', 'warning', count(*) from r where k not in (select k from d)
union all select 'tauri-event-no-producer', 'info', count(*) from q where k not in (select k from p)
union all select 'tauri-event-no-consumer', 'info', count(*) from p where k not in (select k from q)
) as x where n > 0
""",
    "merged_upserts": UPSERTS + "select ord, id, case when cast(id as bigint) % 3 = 0 then 'react_component' else kind end as kind, case when cast(id as bigint) % 3 = 0 then upper(name) else name end as name from first",
    "duplicate_ids": UPSERTS + "select 'duplicate-node-id' as code, 'error' as severity, 'Duplicate node id: ' || id as message from first where cast(id as bigint) % 3 = 0",
    "delta_counts": "select count(*) filter (where p_partkey % 10 = 0 and p_partkey % 7 <> 0) as added, count(*) filter (where p_partkey % 10 <> 0 and p_partkey % 7 = 0) as removed from part",
    "crossing_edges": GRAPH + "select id from edges where (source in (select id from nodes where file = 'standard/Brand1.ts')) <> (target in (select id from nodes where file = 'standard/Brand1.ts'))",
    "event_bursts": EVENTS + r""", kept as (select ts from ev where not contains(path, '/node_modules/')), marked as (select ts, case when lag(ts) over (order by ts) is null or ts - lag(ts) over (order by ts) > interval 1 minute then 1 else 0 end as opens from kept),
numbered as (select ts, sum(opens) over (order by ts rows between unbounded preceding and current row) as burst from marked)
select min(ts) as "start", max(ts) + interval 1 minute as "end", count(*) as n from numbered group by burst
""",
    "fresh_errors": EVENTS.replace("with ", "with recursive ", 1) + r""", told as (select user_id, path, epoch_us(ts) as t, row_number() over (partition by user_id order by epoch_us(ts), path) as n from ev),
shown(user_id, n, path, t, lately, since) as (
    select user_id, n, path, t, path, t from told where n = 1
    union all
    select b.user_id, b.n, b.path, b.t, case when f then b.path else a.lately end, case when f then b.t else a.since end
    from (select a.*, b.path as new_path, b.t as new_t, b.n as new_n, b.path <> a.lately or b.t - a.since > 3600000000 as f from shown a join told b on b.user_id = a.user_id and b.n = a.n + 1) a join told b on b.user_id = a.user_id and b.n = a.new_n
)
select distinct user_id as session, path as operation, t as "at" from shown where t = since and path = lately
""",
    "nodes_standard": GRAPH + "select id, name, kind, file, start_line, qualified_name, language, 'tables' as adapter from nodes where kind = 'function'",
    "edges_compact": GRAPH + "select id, source, target, kind, confidence, 1 as pieces, 1 as line from edges where kind = 'imports'",
    "node_lanes": GRAPH + f"select id, {LANE} as lane, {LANGUAGE} as language, case when kind = 'external_package' then 'PKG' when file like '%.tsx' then 'TSX' when file like '%.ts' then 'TS' when language = 'typescript' then 'TS' else upper(substr(coalesce({LANGUAGE}, kind), 1, 4)) end as badge from nodes",
    "node_labels": GRAPH + "select id, case when kind = 'external_package' then 'Package' when kind = 'file' then 'Service' else kind end as label from nodes where graph_domain = 'code'",
    "lane_grid": GRAPH + f", {GRIDDED} select id, lane, columns, cast(nth % columns as integer) as col, cast(nth // columns as integer) as row from shaped",
    "lane_audit": GRAPH + f", {GRIDDED} select lane, count(*) as children, max(columns) as columns, cast(max(nth // columns) + 1 as integer) as rows, cast(max(nth % columns) as integer) as max_col from shaped group by lane",
    "focused_nodes": GRAPH + ", near as (select source as id from edges where kind = 'contains' and target = 'fn:p5') select id, id = 'fn:p5' as selected, id in (select id from near) as connected, id <> 'fn:p5' and id not in (select id from near) as dimmed from nodes where kind in ('file', 'function')",
    "focused_edges": GRAPH + "select id, target = 'file:standard/Brand1.ts' as incoming, source = 'file:standard/Brand1.ts' as outgoing, target <> 'file:standard/Brand1.ts' and source <> 'file:standard/Brand1.ts' and exists (select 1 from links where kind = 'contains' and source = 'file:standard/Brand1.ts') as dimmed from edges where kind = 'contains'",
    "visible_edges": GRAPH + f", kept as (select id from nodes where {LANE} in ('external', 'tests', 'other')) select id from edges where kind in ('imports', 'calls', 'renders', 'invokes', 'registers', 'emits', 'listens') and source in (select id from kept) and target in (select id from kept)",
    "relation_counts": GRAPH + r"""select count(*) filter (where target = 'fn:p5') as incoming, count(*) filter (where source = 'fn:p5') as outgoing, count(*) filter (where target = 'fn:p5' and kind in ('calls', 'invokes', 'renders', 'listens')) as callers,
count(*) filter (where source = 'fn:p5' and kind in ('calls', 'invokes', 'renders', 'emits', 'uses_type')) as callees, count(*) filter (where kind = 'imports') as dependencies, count(*) filter (where kind in ('invokes', 'registers', 'emits', 'listens')) as framework, count(*) filter (where graph_domain = 'knowledge') as knowledge
from edges where source = 'fn:p5' or target = 'fn:p5'""",
    "diagnostics_view": GRAPH + "select message from diagnostics where severity = 'warning' and code = 'order-O'",
    "files_like": GRAPH + "select file as path from nodes where kind = 'file' and contains(lower(file), 'brand1') order by file limit 13",
    "architecture_truncated": GRAPH + "select count(distinct file) > 60 as truncated from nodes where file is not null and graph_domain = 'code' and kind not in ('directory', 'repository')",
    "contained_symbols": GRAPH + "select file, string_agg(id, ',' order by coalesce(start_line, 0), name, ord) as symbols from nodes where file = 'standard/Brand1.ts' and kind not in ('directory', 'repository', 'file') group by file",
    "stored_symbol": GRAPH + "select id, kind, name, qualified_name, file from nodes where id = 'fn:p5'",
    "stored_edges_touching": GRAPH + "select id, source, target, kind, confidence from edges where source in ('fn:p5', 'pkg:s3') or target in ('fn:p5', 'pkg:s3')",
    "stored_files": GRAPH + "select file, id from nodes where kind = 'file'",
}
