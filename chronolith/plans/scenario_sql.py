"""The same as DuckDB SQL over the tables themselves, without the form that the operators read."""

from __future__ import annotations

from .oracles import _CHANGES, _CONNECTED, _EDGES, _GATE, _PARTS, _PHASES, _weights_of

_ALL = f"{_weights_of(_PHASES)}{_EDGES}{_CONNECTED}"
_KIND = "CASE p_partkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"
_NAME = "replace(p_name, ' ', '_')"
_LINE = "'src/m' || l_partkey || '/f' || l_linenumber || '.py'"


def _kind(*values: object) -> str:
    return _KIND.format(*values)


_STRUCTURE = f"""
sources AS (
  SELECT p_partkey, {_kind("'python'", "'typescript'", "'java'", "'go'", "'rust'")} AS language, {_kind(9, 5, 4, 7, 4)} AS nloc, {_kind(1, 1, 0, 1, 1)} AS functions, {_kind(3, 2, 0, 1, 2)} AS ccn_max,
         {_kind(2, 1, 2, 0, 1)} AS classes, {_kind(1, 2, 0, 0, 1)} AS abstract_classes,
         {_kind("['abc', 'os.path', 'src/a/b/core']", f"['./' || {_NAME}, 'lib-' || p_partkey]", f"['java.util.' || {_NAME}, 'x.y.Z']", f"['fmt', 'm/' || {_NAME}, 'one/two']", f"[{_NAME} || '/deep']")} AS targets,
         p_name, p_partkey AS key
  FROM part)"""

ORACLES = {
    "rename_paths": """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'src/' || p_type || '/f' || p_partkey || '.py' WHEN 1 THEN p_type || '/f' || p_partkey || '.py' ELSE 'src/f' || p_partkey || '.py' END AS path,
       CASE p_partkey % 3 WHEN 0 THEN 'src/' || replace(p_brand, '#', '-') || '/f' || p_partkey || '.py' WHEN 1 THEN replace(p_brand, '#', '-') || '/f' || p_partkey || '.py' END AS old_path
FROM part""",
    "log_scan": f"""
SELECT o_orderkey::VARCHAR AS hash, epoch(o_orderdate)::BIGINT AS second, 'C' || o_custkey AS author, 'p' || o_orderkey || ',q' || o_orderkey AS parents, o_orderpriority AS subject,
       {_LINE} AS path, CASE WHEN l_linenumber % 4 = 0 THEN 'src/old/f' || l_linenumber || '.py' END AS old_path,
       CASE WHEN l_orderkey IS NULL THEN -1 WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_quantity::BIGINT END AS added, CASE WHEN l_orderkey IS NULL THEN -1 WHEN l_linenumber % 5 = 0 THEN 0 ELSE 1 END AS deleted,
       coalesce(l_linenumber % 5 = 0, FALSE) AS is_binary
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    "empty_commits": f"""
WITH {_CHANGES} SELECT hash, 0::BIGINT AS files, 0::BIGINT AS added, 0::BIGINT AS deleted, 0::BIGINT AS source_files, 0::BIGINT AS modules, TRUE AS is_noise FROM commits WHERE hash::BIGINT % 3 = 0""",
    "renames": f"""
SELECT DISTINCT 'src/old/f' || l_linenumber || '.py' AS old_path, {_LINE} AS path, l_orderkey::VARCHAR AS hash FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 4 = 0""",
    "diff_files": f"""
SELECT l_orderkey::VARCHAR AS diff_id, {_LINE} AS path, CASE WHEN l_linenumber = 5 THEN {_LINE} || '.old' END AS old_path, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_linenumber END AS added,
       CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS deleted, l_linenumber = 1 AS is_new, l_linenumber = 4 AS is_deleted
FROM lineitem""",
    "diff_modules": """
SELECT l_orderkey::VARCHAR AS diff_id, 'm' || l_partkey AS module, sum(l_linenumber)::BIGINT AS added, count(*) FILTER (l_linenumber <> 1) AS deleted, count(*) AS files
FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1, 2""",
    "diff_hashes": "SELECT doc_id, substr(sha1(text), 1, 12) AS diff_hash, sha1('blob ' || strlen(text) || chr(0) || text) AS blob FROM documents",
    "import_targets": f"""
WITH {_PARTS}, first AS (SELECT module, min(path) AS path FROM parts GROUP BY module)
SELECT DISTINCT a.path AS src_path, a.module AS src_module, b.module AS dst_module FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey + 1 WHERE a.module <> b.module""",
    "successor_modules": f"""
WITH {_ALL}, ph AS (SELECT s.module, coalesce(p.phase, 'no_data') AS phase, coalesce(p.level, 0) AS level FROM status s LEFT JOIN phases p ON p.module = s.module),
g AS (SELECT module, level FROM ph WHERE phase = 'growth' AND level > 0),
parent AS (SELECT module, regexp_extract(module, '^(.*)/[^/]*$', 1) AS dir FROM ph WHERE phase = 'decline'),
near AS (SELECT p.module, first(g.module ORDER BY g.level DESC, g.module) AS m FROM parent p JOIN g ON p.dir = '' OR starts_with(g.module, p.dir || '/') GROUP BY p.module),
by_pair AS (SELECT r.module, arg_min(r.partner, r.rank) AS m FROM pr r JOIN ph ON ph.module = r.partner AND ph.phase = 'growth' WHERE r.rank <= 5 GROUP BY r.module),
by_import AS (SELECT e.dst AS module, first(g.module ORDER BY g.level DESC, g.module) AS m FROM edges e JOIN g ON g.module = e.src GROUP BY e.dst)
SELECT p.module, coalesce(n.m, b.m, i.m) AS successor FROM parent p LEFT JOIN near n ON n.module = p.module LEFT JOIN by_pair b ON b.module = p.module LEFT JOIN by_import i ON i.module = p.module""",
    "gate_deck": f"""
WITH {_ALL}{_GATE}, s AS (SELECT *, CASE WHEN rule = 'SL-W01' THEN 'planned' ELSE '' END AS suppressed FROM found WHERE rule <> 'SL-I02')
SELECT rule, CASE WHEN suppressed <> '' OR rule LIKE 'SL-I%' OR rule = 'SL-W03' THEN 'info' ELSE 'warn' END AS severity, suppressed, count(*) AS findings, count(DISTINCT diff_id) AS diffs, max(deviation) AS deviation FROM s GROUP BY ALL""",
    "gate_authority": f"""
WITH {_ALL}{_GATE}, growing AS (SELECT module FROM phases WHERE phase = 'growth'), warned AS (SELECT DISTINCT diff_id, module FROM found WHERE rule LIKE 'SL-W%'),
free AS (SELECT diff_id, module FROM touched UNION SELECT w.diff_id, r.partner FROM warned w JOIN pr r ON r.module = w.module AND r.rank <= 5)
SELECT f.diff_id, f.module FROM free f JOIN growing g ON g.module = f.module LEFT JOIN warned w ON w.diff_id = f.diff_id AND w.module = f.module WHERE w.module IS NULL""",
    "gate_log": f"WITH {_ALL}{_GATE} SELECT module, rule, 'warn' AS verdict, count(*) AS warnings, max(deviation) AS deviation FROM found WHERE rule LIKE 'SL-W%' GROUP BY ALL",
    "open_warnings": """
WITH a AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id::VARCHAR AS module, event_type AS rule, count(*) AS open FROM events e LEFT JOIN a ON a.user_id = e.user_id
WHERE event_type <> 'purchase' AND e.ts >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOURS AND (a.t IS NULL OR a.t < e.ts) GROUP BY 1, 2""",
    "index_freshness": """
WITH h AS (SELECT arg_max(o_orderkey::VARCHAR, (o_orderdate, o_orderkey::VARCHAR)) AS head FROM orders), m AS (SELECT o_orderdate AS t FROM orders WHERE o_orderkey = 1),
n AS (SELECT count(*) AS n FROM orders, m WHERE o_orderdate > t OR (o_orderdate = t AND o_orderkey::VARCHAR > '1'))
SELECT head, '1' AS bookmark, n AS commits_behind, n > 0 AS stale, FALSE AS rewritten FROM h, n UNION ALL SELECT head, 'none', -1, TRUE, TRUE FROM h UNION ALL SELECT head, NULL, -1, TRUE, FALSE FROM h""",
    "gate_fail_safe": f"""
WITH {_CHANGES} SELECT hash AS diff_id, rule, '*' AS module, 1 AS deviation FROM commits, (VALUES ('SL-F01'), ('SL-F02'), ('SL-F00')) r(rule)""",
    "export_tables": f"""
WITH {_ALL}, c AS (SELECT module FROM mm UNION SELECT module FROM fans)
SELECT 'module_period' AS exported, count(*) AS rows FROM mp UNION ALL SELECT 'cochange', count(*) FROM co UNION ALL SELECT 'module_metrics', count(*) FROM mm UNION ALL SELECT 'package_metrics', count(*) FROM c
UNION ALL SELECT 'imports', count(*) FROM (SELECT DISTINCT a.path, a.module, b.module FROM (SELECT hash, module, path, row_number() OVER (PARTITION BY hash ORDER BY l_linenumber, module, path) AS r FROM changes) a
  JOIN (SELECT hash, module, row_number() OVER (PARTITION BY hash ORDER BY l_linenumber, module, path) AS r FROM changes) b ON a.hash = b.hash AND a.r = 1 AND b.r = 2 AND a.module <> b.module)
UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'phases', count(*) FROM status""",
    "file_state": f"""
WITH {_CHANGES} SELECT path, any_value(module) AS module, arg_max('b' || lpad(hash, 12, '0'), (ts, lpad(hash, 12, '0'))) AS blob FROM changes WHERE NOT is_doc GROUP BY path""",
    "source_structure": f"WITH {_STRUCTURE} SELECT p_partkey, language, nloc, functions, ccn_max, classes, abstract_classes, array_to_string(list_sort(targets), ';') AS imports FROM sources",
    "source_imports": f"WITH {_STRUCTURE} SELECT target, count(*) AS files FROM (SELECT unnest(targets) AS target FROM sources) GROUP BY target",
    "period_steps": """
WITH q AS (SELECT o_orderkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS i FROM orders)
SELECT o_orderkey, ((i + 1) // 4) || '-Q' || ((i + 1) % 4 + 1) AS next, ((i - 1) // 4) || '-Q' || ((i - 1) % 4 + 1) AS previous, 2001 * 4 + 2 - i AS between FROM q""",
    "churn_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, count(*) AS events FROM events GROUP BY 1, 2",
    "incremental_commits": f"WITH {_CHANGES}, f AS (SELECT hash, count(*) AS files FROM (SELECT DISTINCT hash, path, added, deleted FROM changes) GROUP BY hash) SELECT strftime(ts, '%Y-%m') AS period, count(*) AS commits, sum(f.files)::BIGINT AS files, count(*) FILTER (noise_reason IS NOT NULL) AS noise FROM commits JOIN f USING (hash) GROUP BY 1",
}
