"""The same questions in SQL over the tables, written on their own; a check of results, not a way to run them."""

from __future__ import annotations

GRAPH = r"""
with parts as (
    select *, case when p_type = 'PROMO' then 'tests/' || replace(p_brand, '#', '') || '.test.ts' else lower(p_type) || '/' || replace(p_brand, '#', '') || '.ts' end as path from part
), props as (select json_extract_string(props, '$.k') as k, event_type from events),
tested as (select doc_id, max(quality) as quality from labels group by doc_id),
turns as (select distinct conv_id, turn from conversations),
nodes as materialized (
    select '00:' as ord, 'repo' as id, 'repository' as kind, 'repo' as name, 'repo' as qualified_name, cast(null as varchar) as language, cast(null as varchar) as file, cast(null as integer) as start_line, 'code' as graph_domain, cast(null as varchar) as source_category, cast(null as varchar) as framework
    union all select '01:r' || lpad(cast(r_regionkey as varchar), 14, '0'), 'dir:r' || r_regionkey, 'directory', r_name, r_name, null, r_name, null, 'code', null, null from region
    union all select '01:s' || lpad(cast(n_nationkey as varchar), 14, '0'), 'dir:n' || n_nationkey, 'directory', n_name, r_name || '/' || n_name, null, r_name || '/' || n_name, null, 'code', null, null from nation join region on n_regionkey = r_regionkey
    union all select distinct '02:' || path, 'file:' || path, 'file', split_part(path, '/', -1), path, 'typescript', path, null, 'code', null, null from parts
    union all select '03:' || lpad(cast(p_partkey as varchar), 14, '0'), 'fn:p' || p_partkey, 'function', p_name, path || '::' || p_name || '#' || p_partkey, 'typescript', path, p_size, 'code', null, null from parts
    union all select '04:' || lpad(cast(c_custkey as varchar), 14, '0'), 'cmp:c' || c_custkey, 'react_component', c_name, 'ui/' || n_name || '.tsx::' || c_name, 'typescript', 'ui/' || n_name || '.tsx', null, 'code', null, null from customer join nation on c_nationkey = n_nationkey
    union all select '05:' || lpad(cast(s_suppkey as varchar), 14, '0'), 'pkg:s' || s_suppkey, 'external_package', s_name, s_name, null, null, null, 'code', null, null from supplier
    union all select distinct '06:' || event_type, 'evt:' || event_type, 'framework_event', event_type, 'events::' || event_type, null, null, null, 'code', null, 'events' from events
    union all select '07:' || lpad(cast(doc_id as varchar), 14, '0'), 'doc:' || doc_id, 'doc_section', 'doc ' || doc_id, 'docs/' || source || '.md#' || doc_id, null, 'docs/' || source || '.md', null, 'knowledge', 'docs', null from documents
    union all select '08:' || lpad(cast(item_id as varchar), 14, '0'), 'bench:' || item_id, 'concept', 'item ' || item_id, 'benchmark#' || item_id, null, null, null, 'knowledge', 'docs', null from benchmark
    union all select '09:' || lpad(cast(doc_id as varchar), 14, '0'), 'test:' || doc_id, 'test_artifact', 'test ' || doc_id, 'labels#' || doc_id, null, 'tests/quality' || quality || '.test.ts', null, 'knowledge', 'tests', null from tested
    union all select distinct '10:' || k, 'cfg:' || k, 'configuration', k, 'config/events.json#' || k, null, 'config/events.json', null, 'knowledge', 'config', null from props where k is not null
    union all select '11:' || lpad(cast(conv_id as varchar), 14, '0') || '.' || lpad(cast(turn as varchar), 6, '0'), 'wf:' || conv_id || ':' || turn, 'workflow', 'turn ' || turn, 'chat#' || conv_id || '.' || turn, null, null, null, 'knowledge', 'semantic', null from turns
    union all select '12:' || lpad(cast(x as varchar), 14, '0'), 'unres:' || x, 'unresolved_symbol', 'missing' || x, 'unresolved::' || x, null, null, null, 'code', null, null from range(50) as r(x)
), leads as (
    select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as b,
        case when l_returnflag = 'A' then 0 when l_returnflag = 'N' then 1 when l_linestatus = 'F' then 2 else 3 end as rank
    from lineitem
), calls as (
    select a, case when rank = 3 then a % 50 else b end as b, rank = 3 as lost, min(rank) as rank from leads where b is not null group by a, case when rank = 3 then a % 50 else b end, rank = 3
), links as (
    select '00:repo>r' || lpad(cast(r_regionkey as varchar), 14, '0') as ord, 'repo' as source, 'dir:r' || r_regionkey as target, 'contains' as kind, 'exact' as confidence, 'code' as graph_domain from region
    union all select '00:r' || lpad(cast(n_regionkey as varchar), 14, '0') || '>s' || lpad(cast(n_nationkey as varchar), 14, '0'), 'dir:r' || n_regionkey, 'dir:n' || n_nationkey, 'contains', 'exact', 'code' from nation
    union all select '00:' || path || '>p' || lpad(cast(p_partkey as varchar), 14, '0'), 'file:' || path, 'fn:p' || p_partkey, 'contains', 'exact', 'code' from parts
    union all select distinct '01:' || path || '>' || lpad(cast(l_suppkey as varchar), 14, '0'), 'file:' || path, 'pkg:s' || l_suppkey, 'imports', 'resolved', 'code' from lineitem join parts on l_partkey = p_partkey
    union all select '02:' || lpad(cast(a as varchar), 14, '0') || '>' || case when lost then 'u' else '' end || lpad(cast(b as varchar), 14, '0'), 'fn:p' || a, case when lost then 'unres:' || b else 'fn:p' || b end, 'calls', case when lost then 'unresolved' when rank = 0 then 'exact' when rank = 1 then 'resolved' else 'probable' end, 'code' from calls
    union all select '03:' || lpad(cast(o_custkey as varchar), 14, '0') || '>' || lpad(cast(l_partkey as varchar), 14, '0'), 'cmp:c' || o_custkey, 'fn:p' || l_partkey, 'renders', case when max(case when o_orderstatus = 'F' then 1 else 0 end) = 1 then 'resolved' else 'probable' end, 'code' from orders join lineitem on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT' group by o_custkey, l_partkey
    union all select distinct '04:' || lpad(cast(user_id as varchar), 14, '0') || '>' || event_type, 'cmp:c' || user_id, 'evt:' || event_type, 'emits', 'exact', 'code' from events where event_type in ('click', 'purchase', 'error')
    union all select distinct '05:' || event_type || '>' || lpad(cast(user_id as varchar), 14, '0'), 'evt:' || event_type, 'cmp:c' || user_id, 'listens', 'probable', 'code' from events where event_type not in ('click', 'purchase', 'error')
    union all select '06:' || lpad(cast(doc_id as varchar), 14, '0') || '>' || lpad(cast(item_id as varchar), 14, '0'), 'doc:' || doc_id, 'bench:' || item_id, 'mentions', 'exact', 'knowledge' from documents d join benchmark b on contains(d.text, b.text)
    union all select '07:' || lpad(cast(doc_id as varchar), 14, '0') || '>' || lpad(cast(doc_id as varchar), 14, '0'), 'test:' || doc_id, 'doc:' || doc_id, 'tests', case when quality = 1 then 'resolved' else 'probable' end, 'knowledge' from tested
    union all select distinct '08:' || k || '>' || event_type, 'cfg:' || k, 'evt:' || event_type, 'configures', 'exact', 'knowledge' from props where k is not null
    union all select '09:' || lpad(cast(conv_id as varchar), 14, '0') || '.' || lpad(cast(turn as varchar), 6, '0') || '>' || lpad(cast(conv_id as varchar), 14, '0') || '.' || lpad(cast(nxt as varchar), 6, '0'), 'wf:' || conv_id || ':' || turn, 'wf:' || conv_id || ':' || nxt, 'describes_workflow', 'exact', 'knowledge' from (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as nxt from turns) where nxt is not null
), edges as materialized (select *, kind || ':' || source || '->' || target as id from links),
diagnostics as (select lpad(cast(o_orderkey as varchar), 14, '0') as ord, 'order-' || o_orderstatus as code, case o_orderpriority when '1-URGENT' then 'error' when '2-HIGH' then 'warning' else 'info' end as severity, 'order ' || o_orderkey as message from orders)
"""
NODE_COLUMNS, EDGE_COLUMNS = "id, kind, name, qualified_name, file", "id, source, target, kind, confidence"
IN_SCOPE = {"code": "graph_domain <> 'knowledge'", "code+docs": "(graph_domain <> 'knowledge' or source_category = 'docs')", "code+config": "(graph_domain <> 'knowledge' or source_category in ('config', 'semantic'))", "code+tests": "(graph_domain <> 'knowledge' or source_category = 'tests')", "full": "true"}


def nodes(scope: str) -> str:
    return f"(select * from nodes where {IN_SCOPE[scope]})"


def edges(scope: str = "code", confidence: str = "'exact', 'resolved'", kinds: str | None = None) -> str:
    code = " and graph_domain <> 'knowledge'" if scope == "code" else ""
    only = f" and kind in ({kinds})" if kinds else ""
    return f"(select * from edges where confidence in ({confidence}){code}{only} and source in (select id from {nodes(scope)}) and target in (select id from {nodes(scope)}))"


PROBABLE, ALL = "'exact', 'resolved', 'probable'", "'exact', 'resolved', 'probable', 'unresolved'"
CALLERS, CALLEES, AFFECTED = "'calls', 'invokes', 'renders', 'listens'", "'calls', 'invokes', 'renders', 'emits', 'uses_type'", "'calls', 'imports', 'invokes', 'renders', 'listens', 'uses_type'"
FLOWS = "'imports', 'calls', 'renders', 'invokes', 'registers', 'emits', 'listens', 'tests'"
FILE = "standard/Brand1.ts"
WORDS = ("brand", "standard", "click", "customer", "doc")
UNITS = f"""
units as (
    select file, coalesce(max(id) filter (where kind = 'file'), 'file:' || file) as unit, max(id) filter (where kind = 'file') is null as synthesised, count(*) filter (where kind <> 'file') as symbol_count
    from {nodes('code')} where file is not null and kind not in ('directory', 'repository') group by file
), placed as (
    select n.id, u.unit from {nodes('code')} n join units u on n.file = u.file where n.kind <> 'external_package'
    union all select id, id from {nodes('code')} where kind = 'external_package'
), flows as (
    select a.unit as f, b.unit as t, e.* from {edges(kinds=FLOWS)} e join placed a on e.source = a.id join placed b on e.target = b.id where a.unit <> b.unit
), rolled as (
    select f as source, t as target, min(case kind when 'invokes' then 0 when 'emits' then 1 when 'listens' then 2 when 'registers' then 3 when 'renders' then 4 when 'calls' then 5 when 'imports' then 6 else 7 end) as k,
        min(case confidence when 'exact' then 0 when 'resolved' then 1 when 'probable' then 2 else 3 end) as c, count(*) as underlying_count, string_agg(distinct kind, '+' order by kind) as kinds
    from flows group by f, t
)"""
SCORE = " + ".join(f"case when not (contains(lower(name), '{w}') or contains(lower(qualified_name), '{w}') or contains(lower(coalesce(file, '')), '{w}')) then 0 when lower(name) = '{w}' then 20 when contains(lower(name), '{w}') then 10 when contains(lower(coalesce(file, '')), '{w}') then 6 else 4 end" for w in WORDS)
TERMS = "array_to_string(list_filter([" + ", ".join(f"case when contains(lower(name), '{w}') or contains(lower(qualified_name), '{w}') or contains(lower(coalesce(file, '')), '{w}') then '{w}' end" for w in WORDS) + "], lambda x: x is not null), ', ')"
DEGREES = "degrees as (select id, count(*) as degree from (select source as id from edges union all select target from edges where source <> target) group by id)"
RANKED = f"""
{DEGREES}, pool as (
    select n.*, coalesce(degree, 0) as degree from nodes n left join degrees using (id) where kind not in ('repository', 'directory', 'file', 'unresolved_symbol') order by degree desc, qualified_name, ord limit 2000
), scored as (
    select *, {SCORE} + least(degree, 20) / 10.0 as score, {TERMS} as terms from pool where {IN_SCOPE['code']}
), ranked as (select * from scored where score > 0 order by score desc, qualified_name, ord limit 50)"""
#: The same over all candidates instead of a pool of the first by degree.
RANKED_ALL = RANKED.replace(" order by degree desc, qualified_name, ord limit 2000", "")


def reached(start: str, kinds: str, depth: int, most: int) -> str:
    """CTEs of a capped reverse search, one level after the other."""
    out = [f"e as materialized {edges(kinds=kinds)}", f"v0 as (select '{start}' as node, '' as ord, 0 as level, '' as id, '' as target)"]
    for n in range(1, depth + 1):
        out.append(f"""v{n} as (select * from v{n - 1} union all select * from (
            select source, min(ord), {n} as level, arg_min(id, ord), arg_min(target, ord) from e where target in (select node from v{n - 1} where level = {n - 1}) and source not in (select node from v{n - 1}) group by source
            qualify row_number() over (order by min(ord)) <= {most} - (select count(*) - 1 from v{n - 1})))""")
    return ", ".join(out)


def around(start: str, depth: int, most: int, kinds: str | None = None) -> str:
    """CTEs of a capped undirected search."""
    out = [f"e as materialized {edges(kinds=kinds)}", f"v0 as (select '{start}' as node, 0 as level)"]
    for n in range(1, depth + 1):
        out.append(f"""c{n} as (select *, case when source in (select node from v{n - 1} where level = {n - 1}) then target else source end as other from e where source in (select node from v{n - 1} where level = {n - 1}) or target in (select node from v{n - 1} where level = {n - 1})),
        v{n} as (select * from v{n - 1} union all select * from (select other, {n} as level from c{n} where other not in (select node from v{n - 1}) group by other qualify row_number() over (order by min(ord)) <= {most} - (select count(*) from v{n - 1})))""")
    return ", ".join(out)


def _sql(body: str, more: str = "") -> str:
    return GRAPH + (", " + more if more else "") + body


SNAPSHOT = """
with now as (select 'docs/' || doc_id || '.md' as path, coalesce(text, '') as content, doc_id from documents),
old as (select path, case when doc_id % 7 = 0 then content || '!' else content end as content from now where doc_id % 10 <> 0 union all select 'old/' || path, content from now where doc_id % 50 = 0)
"""
TRADE = "select distinct s_nationkey as a, c_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey"
SQL: dict[str, str] = {
    "overview_counts": _sql(f" select (select count(*) from {nodes('code')} where kind = 'file') as files, (select count(*) from {nodes('code')}) as nodes, (select count(*) from {edges()}) as edges, (select count(*) from diagnostics) as diagnostics, (select count(*) from nodes where kind = 'file') as total_files, (select count(*) from nodes) as total_nodes, (select count(*) from edges) as total_edges"),
    "overview_report": _sql(f""", n as (select (select count(*) from {nodes('code')} where kind = 'file') as files, (select count(*) from {nodes('code')}) as nodes, (select count(*) from {edges()}) as edges, (select count(*) from diagnostics) as diagnostics,
            (select count(*) from nodes where kind = 'file' and file is not null) as tf, (select count(*) from nodes) as tn, (select count(*) from edges) as te)
        select 'request' as part, 'scope' as name, 'code' as value union all select 'repository', 'name', 'tables'
        union all select 'count', v.k, cast(v.c as varchar) from n, lateral (values ('files', files), ('nodes', nodes), ('edges', edges), ('diagnostics', diagnostics)) as v(k, c)
        union all select 'total', v.k, cast(v.c as varchar) from n, lateral (values ('files', tf), ('nodes', tn), ('edges', te)) as v(k, c)
        union all select 'adapter', 'tables', cast(tn as varchar) from n
        union all select 'nodes_by_kind', kind, cast(count(*) as varchar) from {nodes('code')} group by kind
        union all select 'edges_by_kind', kind, cast(count(*) as varchar) from {edges()} group by kind"""),
    "architecture_knowledge_truncated": _sql(f" select count(*) > 80 as truncated from {nodes('code+docs')}"),
    "overview_nodes_by_kind": _sql(f" select kind, count(*) as n from {nodes('code')} group by kind"),
    "overview_edges_by_kind": _sql(f" select kind, count(*) as n from {edges('full')} group by kind"),
    **{f"scoped_nodes_{k}": _sql(f" select {NODE_COLUMNS} from {nodes(s)}") for k, s in (("code", "code"), ("docs", "code+docs"), ("config", "code+config"), ("tests", "code+tests"), ("full", "full"))},
    "scoped_edges_trusted": _sql(f" select {EDGE_COLUMNS} from {edges()}"),
    "scoped_edges_probable": _sql(f" select {EDGE_COLUMNS} from {edges(confidence=PROBABLE)}"),
    "scoped_edges_unresolved": _sql(f" select {EDGE_COLUMNS} from {edges('full', ALL)}"),
    "adapters_runs": _sql(" select 'tables' as adapter, true as detected, (select count(distinct file) from nodes) as file_count, (select count(*) from nodes) as node_count, (select count(*) from edges) as edge_count, (select count(*) from diagnostics) as diagnostic_count"),
    "diagnostics_ranked": _sql(" select code, severity, message, cast(case severity when 'error' then 0 when 'warning' then 1 else 2 end as integer) as rank from diagnostics"),
    "diagnostics_facets": _sql(" select severity, code, count(*) as n from diagnostics group by severity, code"),
    "files_summary": _sql(f" select n.file as path, n.language, (select count(*) from {nodes('code')} m where m.file = n.file) as node_count, coalesce(o.n, 0) as outgoing_count, coalesce(i.n, 0) as incoming_count from {nodes('code')} n left join (select m.file, count(*) as n from {edges()} e join nodes m on e.source = m.id group by m.file) o on o.file = n.file left join (select m.file, count(*) as n from {edges()} e join nodes m on e.target = m.id group by m.file) i on i.file = n.file where n.kind = 'file'"),
    "file_details_nodes": _sql(f" select {NODE_COLUMNS} from {nodes('code')} where file = '{FILE}'"),
    "file_details_deps": _sql(f" select {EDGE_COLUMNS} from {edges()} where source in (select id from nodes where file = '{FILE}')"),
    "file_details_reverse": _sql(f" select {EDGE_COLUMNS} from {edges(confidence=PROBABLE)} where target in (select id from nodes where file = '{FILE}')"),
    "search_symbols": _sql(f" select {NODE_COLUMNS} from (select * from nodes where (name ilike '%brand1%' or qualified_name ilike '%brand1%') and kind <> 'unresolved_symbol' order by case when name = 'brand1' then 0 else 1 end, name, qualified_name, ord limit 200) where {IN_SCOPE['code']} order by case when name = 'brand1' then 0 else 1 end, name, qualified_name, ord limit 50"),
    "search_symbols_unresolved": _sql(f" select {NODE_COLUMNS} from (select * from nodes where name ilike '%missing%' or qualified_name ilike '%missing%' order by case when name = 'MISSING' then 0 when kind = 'unresolved_symbol' then 2 else 1 end, name, qualified_name, ord limit 80) where {IN_SCOPE['code']} order by case when name = 'MISSING' then 0 when kind = 'unresolved_symbol' then 2 else 1 end, name, qualified_name, ord limit 20"),
    "symbol_lookup": _sql(f" select {NODE_COLUMNS} from nodes where id = 'fn:p5'"),
    "callers": _sql(f" select {EDGE_COLUMNS} from {edges(kinds=CALLERS)} where target = 'fn:p5' order by ord limit 50"),
    "callees": _sql(f" select {EDGE_COLUMNS} from {edges(confidence=PROBABLE, kinds=CALLEES)} where source = 'fn:p5' order by ord limit 50"),
    "callers_full_scope": _sql(f" select {EDGE_COLUMNS} from {edges('full', PROBABLE)} where target = 'evt:click' order by ord limit 30"),
    "framework_bindings_nodes": _sql(f" select {NODE_COLUMNS} from nodes where framework = 'events' or id in (select source from t union all select target from t)", f"t as (select * from {edges(confidence=PROBABLE)} where source like 'evt:%' or target like 'evt:%')"),
    "framework_bindings_edges": _sql(f" select {EDGE_COLUMNS} from {edges(confidence=PROBABLE)} where source like 'evt:%' or target like 'evt:%'"),
    "architecture_edges": _sql(" select 'fileedge:' || source || '->' || target || ':' || kinds as id, source, target, ['invokes', 'emits', 'listens', 'registers', 'renders', 'calls', 'imports', 'tests'][k + 1] as kind, ['exact', 'resolved', 'probable', 'unresolved'][c + 1] as confidence, underlying_count from rolled", UNITS),
    "architecture_nodes": _sql(" select v.id, v.kind, v.name, v.symbol_count, v.synthesised, (select count(*) from rolled where target = v.id and source in (select id from visible)) as incoming_count, (select count(*) from rolled where source = v.id and target in (select id from visible)) as outgoing_count from visible v", UNITS + f", visible as (select * from (select unit as id, 'file' as kind, split_part(file, '/', -1) as name, file as qn, symbol_count, synthesised, 0 as g from units union all select id, kind, name, qualified_name, 0, false, 1 from {nodes('code')} where kind = 'external_package' and (id in (select source from rolled) or id in (select target from rolled))) order by g, qn, id limit 60)"),
    "architecture_knowledge": _sql(f" select {NODE_COLUMNS} from {nodes('code+docs')} order by case kind when 'repository' then 0 when 'directory' then 1 when 'framework_command' then 2 when 'framework_event' then 3 when 'file' then 4 else case when graph_domain = 'knowledge' then 6 else 5 end end, qualified_name, ord limit 80"),
    "degrees": _sql(" select * from degrees", DEGREES),
    "context_symbols": _sql(" select id, degree, round(cast(score as double), 6) as score, array_to_string(list_filter([case when terms <> '' then 'matched task terms: ' || terms end, case when degree > 0 then 'graph degree ' || degree end, case when kind like 'framework\\_%' escape '\\' then 'framework binding' end], lambda x: x is not null), '; ') as reasons from ranked", RANKED),
    "context_files": _sql(" select file, round(cast(sum(score) as double), 6) as score from ranked where file is not null group by file order by sum(score) desc, file limit 20", RANKED),
    "context_relationships": _sql(f" select {EDGE_COLUMNS} from {edges()} where source in (select id from ranked) and target in (select id from ranked) order by ord limit 150", RANKED_ALL),
    "context_related_tests": _sql(f" select distinct file from nodes where file is not null and (regexp_matches(file, '\\.(?:test|spec)\\.[^.]+$') or regexp_matches(file, '(?:^|/)__tests__(?:/|$)') or regexp_matches(file, '(?:^|/)tests?/[^/]+$')) and id in (select case when source in (select id from ranked) then target else source end from {edges()} where source in (select id from ranked) or target in (select id from ranked))", RANKED_ALL),
    "neighborhood_d2": _sql(f" select {NODE_COLUMNS} from nodes where id in (select node from v2)", around("fn:p5", 2, 50)),
    "neighborhood_edges": _sql(" select id, cast(min(level) as integer) as level from (select id, ord, 0 as level from c1 where other in (select node from v1) union all select id, ord, 1 from c2 where other in (select node from v2)) group by id order by min(level), min(ord) limit 200", around("fn:p5", 2, 50)),
    "neighborhood_kinds": _sql(f" select {NODE_COLUMNS} from nodes where id in (select node from v1)", around("pkg:s3", 1, 20, "'imports'")),
    "affected_direct": _sql(" select id, node as source, target, cast(level as integer) as level from v1 where level > 0", reached("fn:p5", AFFECTED, 1, 40)),
    "affected_transitive": _sql(" select id, node as source, target, cast(level as integer) as level from v2 where level > 0", reached("fn:p5", AFFECTED, 2, 60)),
    "affected_confidence": _sql(" select c as confidence, (select count(*) from v2 join edges using (id) where confidence = c and level > 0) as n from (values ('exact'), ('resolved'), ('probable'), ('unresolved')) as x(c)", reached("fn:p5", AFFECTED, 2, 60)),
    "affected_files": _sql(" select distinct file from nodes where file is not null and id in (select node from v2 where level > 0)", reached("fn:p5", AFFECTED, 2, 60)),
    "cycles_self_loops": f"select 'mod:n' || a as id from ({TRADE}) where a = b",
    "status_added": SNAPSHOT + " select path from now where path not in (select path from old)",
    "status_modified": SNAPSHOT + " select path from now join old using (path) where now.content <> old.content",
    "status_deleted": SNAPSHOT + " select path from old where path not in (select path from now)",
    "mentions": "select 'doc:' || doc_id as source, 'bench:' || item_id as target from documents d join benchmark b on contains(d.text, b.text)",
    "name_multiplicity": "select p_name as name, count(*) as n from part group by p_name",
}
