"""The queries once more, as DuckDB SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from ..config import IGNORED_PATHS, LANGUAGES, SOURCE_EXTENSIONS, TEST_MODULES

_quoted = lambda values: ", ".join(f"'{v}'" for v in values)
_either = lambda patterns: "|".join(f"(?:{p})" for p in patterns)

CLOSED = 2001 * 12 + 6  # July 2001
_MONTH = "(i // 12) || '-' || lpad((i % 12 + 1)::VARCHAR, 2, '0')"


def _month(column: str) -> str:
    return _MONTH.replace("i ", f"{column} ")


_PARTS = """
parts AS (
  SELECT p_partkey, p_size, lower(p_type) || '/' || replace(p_name, ' ', '_') AS module, p_size % 10 = 0 AS is_doc,
         'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '/f' || p_partkey || CASE WHEN p_size % 10 = 0 THEN '.md' ELSE '.py' END AS path
  FROM part)"""

_CHANGES = (
    _PARTS
    + """,
changes AS (
  SELECT o.o_orderkey::VARCHAR AS hash, o.o_orderdate AS ts, o.o_custkey, o.o_orderpriority, l.l_linenumber, p.path, p.module, p.is_doc,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END AS added, CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END AS deleted
  FROM lineitem l JOIN parts p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey),
commits AS (
  SELECT hash, any_value(ts) AS ts, any_value(o_custkey) AS cust, count(*) AS files, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted,
         count(*) FILTER (NOT is_doc) AS source_files, count(DISTINCT module) FILTER (NOT is_doc) AS modules, any_value(o_orderpriority) AS prio,
         CASE WHEN any_value(o_custkey) % 10 = 0 THEN 'bot_author' WHEN any_value(o_orderpriority) = '5-LOW' THEN 'maintenance_subject'
              WHEN count(*) > 500 THEN 'bulk_changeset' WHEN count(*) FILTER (NOT is_doc) = 0 THEN 'no_source_files' END AS noise_reason
  FROM changes GROUP BY hash),
facts AS (
  SELECT c.hash, h.module, any_value(c.ts) AS ts, 'c' || any_value(c.cust) || '@example.com' AS author, any_value(year(c.ts) * 12 + month(c.ts) - 1) AS idx,
         count(*) AS files, sum(h.added)::BIGINT AS added, sum(h.deleted)::BIGINT AS deleted, any_value(c.modules) AS modules, 'feat: ' || any_value(c.prio) AS subject
  FROM changes h JOIN commits c ON c.hash = h.hash WHERE c.noise_reason IS NULL AND NOT h.is_doc GROUP BY c.hash, h.module),
mp AS (
  SELECT module, idx, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, sum(files)::BIGINT AS files, count(DISTINCT author) AS authors
  FROM facts GROUP BY module, idx)"""
)

_AXIS = (
    _CHANGES
    + f""",
axis AS (
  SELECT a.module, a.idx, coalesce(m.commits, 0) AS commits, coalesce(m.added, 0) AS added, coalesce(m.deleted, 0) AS deleted, coalesce(m.files, 0) AS files, coalesce(m.authors, 0) AS authors
  FROM (SELECT module, unnest(range(min(idx), {CLOSED} + 1)) AS idx FROM mp GROUP BY module) a LEFT JOIN mp m ON m.module = a.module AND m.idx = a.idx)"""
)

_FEATURES = (
    _AXIS
    + """,
sized AS (SELECT *, row_number() OVER w AS n, sum(added - deleted) OVER w AS size FROM axis WINDOW w AS (PARTITION BY module ORDER BY idx)),
feats AS (
  SELECT *, list(commits) OVER w8 AS cw, list(size::BIGINT) OVER w8 AS sw, sum(commits) OVER w4 / 4.0 AS level,
         n - coalesce(max(CASE WHEN commits > 1 THEN n END) OVER wu, 0) AS low_streak, max(authors) OVER w4 AS authors_recent, coalesce(max(authors) OVER wp, 0) AS authors_prior,
         coalesce(avg(commits) OVER we, 0) AS earlier_mean, (sum(added - deleted) OVER w4)::BIGINT AS net_recent, max(added - deleted) OVER w4 AS net_most
  FROM sized WINDOW
    wu AS (PARTITION BY module ORDER BY idx), w8 AS (PARTITION BY module ORDER BY idx ROWS 7 PRECEDING), w4 AS (PARTITION BY module ORDER BY idx ROWS 3 PRECEDING),
    wp AS (PARTITION BY module ORDER BY idx ROWS BETWEEN 28 PRECEDING AND 4 PRECEDING), we AS (PARTITION BY module ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING))"""
)


def _trend(values: str, prefix: str) -> str:
    """S, variance and z of a list column, as three expressions by nested selects."""
    n = f"len({values})"
    s = f"list_sum([list_sum([sign({values}[j] - {values}[i]) for j in range(i + 1, {n} + 1)]) for i in range(1, {n})])"
    ties = f"list_sum([(len([y for y in {values} if y = x]) - 1) * (2 * len([y for y in {values} if y = x]) + 5) for x in {values}])"
    return f"coalesce({s}, 0)::INT AS {prefix}s, ({n} * ({n} - 1) * (2 * {n} + 5) - {ties}) / 18.0 AS {prefix}var, {n} AS {prefix}n"


def _z(prefix: str) -> str:
    return f"CASE WHEN {prefix}n < 3 OR {prefix}var <= 0 OR {prefix}s = 0 THEN 0.0 ELSE ({prefix}s - sign({prefix}s)) / sqrt({prefix}var) END"


_LABELS = (
    _FEATURES
    + f""",
tests AS (SELECT *, {_trend("cw", "c_")}, {_trend("sw", "s_")} FROM feats),
zs AS (SELECT *, {_z("c_")} AS cz, {_z("s_")} AS sz FROM tests),
flags AS (
  SELECT *, cz >= 1.6448536269514722 AS churn_up, cz <= -1.6448536269514722 AS churn_down, sz >= 1.6448536269514722 AS size_up,
         sz <= -1.6448536269514722 OR (net_recent < 0 AND net_most <= 0 AND abs(net_recent) >= 0.05 * greatest(1, size - net_recent)) AS size_down,
         authors_recent < authors_prior AND authors_recent <= greatest(1, authors_prior // 2) AS leaving, greatest(abs(cz), abs(sz)) >= 1.959963984540054 AS strong
  FROM zs),
voted AS (SELECT *, churn_down::INT + size_down::INT + leaving::INT AS votes FROM flags),
labels AS (
  SELECT *, CASE WHEN n < 4 THEN 'no_data' WHEN earlier_mean > 1 AND level < earlier_mean AND votes >= 2 THEN 'decline' WHEN low_streak >= 4 AND NOT churn_up AND NOT size_down THEN 'stabilizing' ELSE 'growth' END AS phase,
         CASE WHEN n < 4 THEN NULL WHEN earlier_mean > 1 AND level < earlier_mean AND votes >= 2 THEN CASE WHEN strong AND votes = 3 THEN 'high' ELSE 'medium' END
              WHEN low_streak >= 4 AND NOT churn_up AND NOT size_down THEN CASE WHEN low_streak >= 6 THEN 'high' ELSE 'medium' END
              WHEN churn_up OR size_up OR level > 1 THEN CASE WHEN (churn_up OR size_up) AND strong THEN 'high' WHEN level > 2 THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence
  FROM voted)"""
)

# Going back from the last period, the run ends before the newest two neighbouring periods of another label.
_PHASES = (
    _LABELS
    + """,
ends AS (SELECT module, max(n) AS total, arg_max(phase, n) AS final FROM labels GROUP BY module),
marks AS (SELECT l.module, l.n, l.idx, l.phase = e.final AND l.n >= 4 AS same, e.total FROM labels l JOIN ends e USING (module)),
breaks AS (SELECT x.module, max(x.n) AS at FROM marks x JOIN marks y ON y.module = x.module AND y.n = x.n + 1 WHERE NOT x.same AND NOT y.same GROUP BY x.module),
runs AS (SELECT m.module, min(m.idx) FILTER (m.same AND m.n > coalesce(b.at, 0)) AS since FROM marks m LEFT JOIN breaks b USING (module) GROUP BY m.module),
phases AS (SELECT l.*, r.since FROM labels l JOIN ends e ON e.module = l.module AND e.total = l.n JOIN runs r ON r.module = l.module)"""
)

_DIRECTION = "CASE WHEN {z} >= 1.6448536269514722 THEN 'rising' WHEN {z} <= -1.6448536269514722 THEN 'falling' ELSE 'flat' END"


def _pairs_of(base: str) -> str:
    return (
        base
        + """,
co AS (
  SELECT a.module AS module_a, b.module AS module_b, a.idx, count(*) AS count, max(a.ts) AS last_ts, arg_max(a.hash, (a.ts, a.hash)) AS last_hash
  FROM facts a JOIN facts b ON a.hash = b.hash AND a.module < b.module WHERE a.modules BETWEEN 2 AND 30 GROUP BY ALL)"""
    )


def _weights_of(base: str) -> str:
    return (
        _pairs_of(base)
        + f""",
pw AS (
  SELECT module_a, module_b, sum(count * pow(0.5, greatest(0, {CLOSED} - idx) / 4.0)) AS weight, sum(count)::BIGINT AS lifetime, count(*) AS periods_active,
         max(last_ts) AS last_ts, arg_max(last_hash, (last_ts, last_hash)) AS last_hash, min(idx) AS first
  FROM co GROUP BY module_a, module_b),
sides AS (SELECT module_a AS module, module_b AS partner, weight, lifetime FROM pw UNION ALL SELECT module_b, module_a, weight, lifetime FROM pw),
shares AS (SELECT *, weight / sum(weight) OVER (PARTITION BY module) AS share FROM sides),
pr AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY weight DESC, partner) AS rank FROM shares WHERE weight >= 1)"""
    )


_PAIR_TREND = f""",
series AS (
  SELECT s.module_a, s.module_b, list(coalesce(c.count, 0) ORDER BY s.idx) AS v
  FROM (SELECT module_a, module_b, unnest(range(greatest(first, {CLOSED} - 7), {CLOSED} + 1)) AS idx FROM pw WHERE first <= {CLOSED} - 2) s
  LEFT JOIN co c ON c.module_a = s.module_a AND c.module_b = s.module_b AND c.idx = s.idx GROUP BY s.module_a, s.module_b),
st AS (SELECT module_a, module_b, {_trend("v", "v_")} FROM series),
tr AS (SELECT module_a, module_b, {_DIRECTION.format(z=_z("v_"))} AS trend FROM st)"""

_EDGES = """,
ordered AS (SELECT hash, module, row_number() OVER (PARTITION BY hash ORDER BY l_linenumber, module, path) AS r FROM changes),
edges AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM ordered a JOIN ordered b ON a.hash = b.hash WHERE a.r = 1 AND b.r = 2 AND a.module <> b.module),
fans AS (
  SELECT coalesce(i.m, o.m) AS module, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out
  FROM (SELECT dst AS m, count(*) AS n FROM edges GROUP BY dst) i FULL JOIN (SELECT src AS m, count(*) AS n FROM edges GROUP BY src) o ON i.m = o.m),
mm AS (SELECT module, count(*) AS files, sum(p_size)::BIGINT AS nloc, sum(p_size) / count(*) AS ccn_avg, count(*) FILTER (p_size > 10) AS classes, count(*) FILTER (p_size > 40) AS abstract FROM parts GROUP BY module)"""

_CONNECTED = """,
conn AS (
  SELECT m.module, coalesce(f.fan_in, 0) AS fan_in, coalesce(f.fan_out, 0) AS fan_out, coalesce(p.n, 0) AS partners
  FROM (SELECT DISTINCT module FROM mp) m LEFT JOIN fans f ON f.module = m.module LEFT JOIN (SELECT module, count(*) AS n FROM pr GROUP BY module) p ON p.module = m.module),
status AS (SELECT *, CASE WHEN fan_in >= 1 OR partners >= 2 THEN 'load-bearing' ELSE 'isolated' END AS status FROM conn)"""

_GATE = """,
touched AS (SELECT hash AS diff_id, module, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM changes WHERE NOT is_doc GROUP BY hash, module),
known AS (
  SELECT t.*, t.added - t.deleted AS net, CASE WHEN s.module IS NULL THEN NULL ELSE coalesce(p.phase, 'no_data') END AS phase, coalesce(s.status = 'load-bearing', FALSE) AS bearing
  FROM touched t LEFT JOIN status s ON s.module = t.module LEFT JOIN phases p ON p.module = t.module),
single AS (
  SELECT diff_id, module, CASE WHEN phase IS NULL THEN 'SL-I02' WHEN phase = 'no_data' THEN 'SL-I01' WHEN phase = 'stabilizing' AND (net > 10 OR (added > 5 AND added > 2 * deleted)) THEN 'SL-W01' WHEN phase = 'decline' AND net > 0 THEN 'SL-W02' END AS rule,
         CASE WHEN phase IS NULL THEN 0 WHEN phase = 'no_data' THEN bearing::INT ELSE least(4, 2 + bearing::INT + (net >= 100)::INT) END AS deviation
  FROM known),
coupled AS (
  SELECT a.diff_id, a.module AS am, b.module AS bm, a.phase AS ap, a.bearing OR b.bearing AS bearing, coalesce(w.lifetime, 0) AS lifetime, coalesce(w.weight, 0) AS weight
  FROM known a JOIN known b ON a.diff_id = b.diff_id AND a.module < b.module LEFT JOIN pw w ON w.module_a = a.module AND w.module_b = b.module
  WHERE a.phase IS NOT NULL AND b.phase IS NOT NULL AND (a.phase IN ('stabilizing', 'decline') OR b.phase IN ('stabilizing', 'decline') OR a.bearing OR b.bearing)),
found AS (
  SELECT diff_id, rule, module, deviation, NULL::VARCHAR AS other, NULL::BIGINT AS lifetime FROM single WHERE rule IS NOT NULL
  UNION ALL
  SELECT diff_id, CASE WHEN lifetime = 0 THEN 'SL-W03' ELSE 'SL-W04' END, CASE WHEN ap = 'stabilizing' THEN am ELSE bm END, CASE WHEN lifetime = 0 AND bearing THEN 3 ELSE 2 END,
         CASE WHEN ap = 'stabilizing' THEN bm ELSE am END, lifetime
  FROM coupled WHERE lifetime = 0 OR weight < 1)"""

_ESCALATION = """
e AS (SELECT event_id AS id, ts, user_id::VARCHAR AS module, event_type AS rule, event_type = 'purchase' AS resolves FROM events),
p AS (SELECT *, sum(resolves::INT) OVER (PARTITION BY module ORDER BY ts, id) AS epoch FROM e),
o AS (SELECT id, ts, module, rule, count(*) OVER (PARTITION BY module, rule, epoch ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1 AS open FROM p WHERE NOT resolves)"""

_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _tail(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + {x} / 2))"
    return f"least(1.0, {t} * exp(-{x} * {x} + " + " + ".join(f"{c} * pow({t}, {k})" for k, c in enumerate(_ERFC)) + "))"


_SLOPES = "list_sort(flatten([[(cw[j] - cw[i]) / (j - i) for j in range(i + 1, len(cw) + 1)] for i in range(1, len(cw))]))"
_PAGE_PATH = "regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g')"

ORACLES = {
    "period_keys": """
SELECT o_orderkey, (datediff('day', DATE '0001-01-01', date_trunc('week', o_orderdate)::DATE) // 7)::INT AS weekly_idx, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS monthly_idx,
       (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INT AS quarterly_idx, year(o_orderdate)::INT AS yearly_idx,
       strftime(o_orderdate, '%G-W%V') AS weekly_key, strftime(o_orderdate, '%Y-%m') AS monthly_key, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarterly_key, year(o_orderdate)::VARCHAR AS yearly_key,
       date_trunc('week', o_orderdate)::DATE::VARCHAR AS weekly_start, date_trunc('month', o_orderdate)::DATE::VARCHAR AS monthly_start, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS quarterly_start, date_trunc('year', o_orderdate)::DATE::VARCHAR AS yearly_start
FROM orders""",
    "scale_choice": """
WITH r AS (SELECT o_orderdate AS t FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-15' - INTERVAL 94672800 SECONDS),
s AS (
  SELECT 1 AS o, 'weekly' AS scale, count(DISTINCT date_trunc('week', t)) AS n, datediff('day', date_trunc('week', min(t)), date_trunc('week', max(t))) // 7 + 1 AS span FROM r
  UNION ALL SELECT 2, 'monthly', count(DISTINCT date_trunc('month', t)), datediff('month', min(t), max(t)) + 1 FROM r
  UNION ALL SELECT 3, 'quarterly', count(DISTINCT date_trunc('quarter', t)), datediff('quarter', min(t), max(t)) + 1 FROM r
  UNION ALL SELECT 4, 'yearly', count(DISTINCT year(t)), max(year(t)) - min(year(t)) + 1 FROM r)
SELECT coalesce((SELECT arg_min(scale, o) FROM s WHERE n >= 4 AND n = span), 'yearly') AS scale""",
    "closed_period": """
SELECT scale, idx::INT AS idx, period, count(*) FILTER (o_orderdate >= open) AS open_commits
FROM orders, (VALUES ('weekly', datediff('day', DATE '0001-01-01', DATE '2001-08-06') // 7, '2001-W32', DATE '2001-08-13'), ('monthly', 24018, '2001-07', DATE '2001-08-01'),
                     ('quarterly', 8005, '2001-Q2', DATE '2001-07-01'), ('yearly', 2000, '2000', DATE '2001-01-01')) v(scale, idx, period, open)
GROUP BY scale, idx, period""",
    "path_modules": f"""
WITH {_PARTS}, p AS (SELECT path FROM parts UNION SELECT {_PAGE_PATH} FROM pages),
d AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
m AS (SELECT path, CASE WHEN len(s) > 2 AND s[1] IN ('src', 'lib', 'app', 'pkg', 'packages') THEN s[2:len(s) - 1] ELSE s[1:len(s) - 1] END AS dirs, regexp_matches(path, '{_either(IGNORED_PATHS)}') AS ign FROM d),
x AS (SELECT path, ign, CASE WHEN ign THEN NULL WHEN len(dirs) = 0 THEN '(root)' ELSE array_to_string(dirs[1:2], '/') END AS module, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS extension FROM m)
SELECT path, module, extension, CASE extension {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())} END AS language,
       extension IN ({_quoted(SOURCE_EXTENSIONS)}) AS is_source, ign AS is_ignored, coalesce(regexp_matches(module, '{_either(TEST_MODULES)}'), FALSE) AS is_test
FROM x""",
    "noise_reasons": f"WITH {_CHANGES} SELECT coalesce(noise_reason, 'none') AS reason, count(*) AS commits, sum(files)::BIGINT AS files FROM commits GROUP BY 1",
    "commit_totals": f"WITH {_CHANGES} SELECT hash, ts, strftime(ts, '%Y-%m') AS period, files, added, deleted, source_files, modules, noise_reason IS NOT NULL AS is_noise, noise_reason FROM commits",
    "commit_modules": f"WITH {_CHANGES} SELECT hash, module, author, strftime(ts, '%Y-%m') AS period, files, added, deleted FROM facts",
    "module_period": f"WITH {_CHANGES} SELECT module, {_month('idx')} AS period, commits, added, deleted, files, authors FROM mp",
    "module_authors": f"WITH {_CHANGES} SELECT module, {_month('idx')} AS period, author, count(*) AS commits FROM facts GROUP BY ALL",
    "module_axis": f"WITH {_AXIS} SELECT module, {_month('idx')} AS period, commits, added, deleted, files, authors FROM axis",
    "phase_features": f"""
WITH {_FEATURES} SELECT module, {_month("idx")} AS period, n, size::BIGINT AS size, level, low_streak, authors_recent, authors_prior, round(earlier_mean, 6) AS earlier_mean, net_recent, net_most,
  array_to_string(cw, ',') AS churn_window, array_to_string(sw, ',') AS size_window FROM feats""",
    "mann_kendall": f"""
WITH {_LABELS}, s AS (SELECT *, {_SLOPES} AS sl FROM zs)
SELECT module, {_month("idx")} AS period, CASE WHEN cz >= 1.6448536269514722 THEN 'increasing' WHEN cz <= -1.6448536269514722 THEN 'decreasing' ELSE 'no_trend' END AS trend, c_n AS n, CASE WHEN c_n < 3 THEN 0 ELSE c_s END AS s,
       round(cz, 6) AS z, round(CASE WHEN c_n < 3 OR c_var <= 0 THEN 1.0 ELSE {_tail("cz")} END, 5) AS p,
       round(CASE WHEN c_n < 3 OR c_var <= 0 THEN 0.0 ELSE (sl[(len(sl) - 1) // 2 + 1] + sl[len(sl) // 2 + 1]) / 2 END, 6) AS slope, {_DIRECTION.format(z="cz")} AS direction
FROM s""",
    "phase_labels": f"WITH {_LABELS} SELECT module, {_month('idx')} AS period, phase, confidence FROM labels",
    "phase_since": f"""
WITH {_PHASES} SELECT m.module, coalesce(p.phase, 'no_data') AS phase, CASE WHEN p.phase <> 'no_data' THEN {_month("p.since")} END AS since, p.confidence,
  CASE WHEN p.n >= 4 THEN {_DIRECTION.format(z="cz")} ELSE 'flat' END AS churn_trend, CASE WHEN p.n >= 4 THEN {_DIRECTION.format(z="sz")} ELSE 'flat' END AS size_trend, coalesce(p.n, 0) AS periods, p.low_streak
FROM (SELECT DISTINCT module FROM mp) m LEFT JOIN phases p ON p.module = m.module""",
    "phase_histogram": f"WITH {_PHASES} SELECT coalesce(p.phase, 'no_data') AS phase, count(*) AS modules FROM (SELECT DISTINCT module FROM mp) m LEFT JOIN phases p ON p.module = m.module GROUP BY 1",
    "cochange_counts": f"WITH {_pairs_of(_CHANGES)} SELECT module_a, module_b, {_month('idx')} AS period, count, last_ts, last_hash FROM co",
    "cochange_decayed": f"WITH {_weights_of(_CHANGES)} SELECT module_a, module_b, round(weight, 6) AS weight FROM pw",
    "pair_lifetime": f"WITH {_weights_of(_CHANGES)}{_PAIR_TREND} SELECT p.module_a, p.module_b, lifetime, periods_active, last_ts, last_hash, coalesce(trend, 'flat') AS trend FROM pw p LEFT JOIN tr t ON t.module_a = p.module_a AND t.module_b = p.module_b",
    "partners_topk": f"WITH {_weights_of(_CHANGES)} SELECT module, partner, rank, round(weight, 6) AS weight, round(share, 6) AS share, lifetime FROM pr WHERE rank <= 5",
    "strongest_couplings": f"""
WITH {_weights_of(_CHANGES)}{_PAIR_TREND}, k AS (SELECT DISTINCT least(module, partner) AS module_a, greatest(module, partner) AS module_b FROM pr WHERE rank <= 3)
SELECT k.module_a, k.module_b, p.lifetime, coalesce(t.trend, 'flat') AS trend FROM k JOIN pw p ON p.module_a = k.module_a AND p.module_b = k.module_b LEFT JOIN tr t ON t.module_a = k.module_a AND t.module_b = k.module_b""",
    "fan_in_out": f"WITH {_CHANGES}{_EDGES} SELECT module, fan_in, fan_out FROM fans",
    "package_metrics": f"""
WITH {_CHANGES}{_EDGES}, c AS (SELECT coalesce(m.module, f.module) AS module, coalesce(fan_in, 0) AS ca, coalesce(fan_out, 0) AS ce, classes, abstract FROM mm m FULL JOIN fans f ON f.module = m.module),
v AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce / (ca + ce) END AS i, CASE WHEN classes > 0 THEN abstract / classes END AS a FROM c)
SELECT module, ca, ce, round(i, 6) AS instability, round(a, 6) AS abstractness, round(abs(a + i - 1), 6) AS distance FROM v""",
    "connectedness": f"WITH {_weights_of(_CHANGES)}{_EDGES}{_CONNECTED} SELECT module, status, fan_in, fan_out, partners FROM status",
    "hotspots": f"""
WITH {_CHANGES}{_EDGES}, h AS (SELECT module, sum(commits)::BIGINT AS commits, sum(added + deleted)::BIGINT AS lines FROM mp WHERE idx BETWEEN {CLOSED - 7} AND {CLOSED} GROUP BY module)
SELECT h.module, commits, lines, round(commits * coalesce(nullif(ccn_avg, 0), 1.0), 6) AS score FROM h LEFT JOIN mm ON mm.module = h.module""",
    "recent_commits": f"WITH {_CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY ts DESC, hash DESC) AS rank FROM facts) SELECT module, rank, hash, ts, subject, added, deleted FROM r WHERE rank <= 3",
    "module_content": """
SELECT source || '/' || lang AS module, count(*) AS files, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS nloc FROM documents GROUP BY 1""",
    "blob_dedupe": """
WITH d AS (SELECT md5(text) AS blob, min('src/' || source || '/' || lang || '/d' || doc_id || '.sql') AS path, count(*) AS files, any_value(text) AS text FROM documents GROUP BY 1),
n AS (SELECT blob, path, files, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS nloc FROM d)
SELECT blob, path, files, nloc, round(greatest(0.0, least(100.0, (171.0 - 0.23 - 16.2 * ln(greatest(1, nloc))) * 100.0 / 171.0)), 4) AS mi FROM n""",
    "link_extract": "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2",
    "gate_escalation": f"WITH {_ESCALATION} SELECT id, ts, module, rule, open, CASE WHEN open >= 2 THEN 'block' ELSE 'warn' END AS verdict FROM o",
    "gate_summary": """
SELECT user_id::VARCHAR AS module, event_type AS rule, count(*) AS count, max((floor(value)::BIGINT % 5 + 5) % 5)::INT AS max_deviation FROM events
WHERE event_type <> 'purchase' AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAYS GROUP BY 1, 2""",
    "gate_rules": f"WITH {_weights_of(_PHASES)}{_EDGES}{_CONNECTED}{_GATE} SELECT diff_id, rule, module, CASE WHEN rule LIKE 'SL-I%' THEN 'info' ELSE 'warn' END AS severity, deviation, other, coalesce(lifetime, -1) AS lifetime FROM found",
    "gate_verdicts": f"""
WITH {_weights_of(_PHASES)}{_EDGES}{_CONNECTED}{_GATE}, d AS (SELECT DISTINCT hash AS diff_id FROM changes)
SELECT d.diff_id, CASE WHEN count(*) FILTER (rule LIKE 'SL-W%') > 0 THEN 'warn' ELSE 'ok' END AS verdict, coalesce(max(deviation), 0) AS deviation,
       coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (rule LIKE 'SL-W%'), '') AS rules_fired
FROM d LEFT JOIN found f ON f.diff_id = d.diff_id GROUP BY d.diff_id""",
    "explain_modules": f"""
WITH {_weights_of(_PHASES)}{_EDGES}{_CONNECTED} SELECT s.module, coalesce(p.phase, 'no_data') AS phase, CASE WHEN p.phase <> 'no_data' THEN {_month("p.since")} END AS since, s.status, s.fan_in, s.partners, round(coalesce(p.level, 0), 2) AS churn_level, mm.nloc
FROM status s LEFT JOIN phases p ON p.module = s.module LEFT JOIN mm ON mm.module = s.module""",
    "context_packets": f"""
WITH {_weights_of(_PHASES)}{_EDGES}{_CONNECTED}, t AS (SELECT module, min_by(partner, rank) AS top, count(*) FILTER (rank <= 5) AS reported FROM pr GROUP BY module), c AS (SELECT module, sum(commits)::BIGINT AS n FROM mp GROUP BY module),
x AS (SELECT s.module, coalesce(p.phase, 'no_data') AS phase, CASE WHEN p.phase <> 'no_data' THEN {_month("p.since")} END AS since, s.status, c.n AS commits_analyzed, coalesce(t.reported, 0) AS reported, t.top
      FROM status s LEFT JOIN phases p ON p.module = s.module LEFT JOIN t ON t.module = s.module LEFT JOIN c ON c.module = s.module)
SELECT module, phase, since, status, commits_analyzed, reported, CASE
  WHEN phase = 'stabilizing' AND top IS NOT NULL THEN 'Prefer extending a caller (' || top || ') over adding code to ' || module || '; it has been stable and others depend on it.'
  WHEN phase = 'stabilizing' THEN 'Prefer extending a caller over adding code to ' || module || '; it has been stable.'
  WHEN phase = 'decline' THEN module || ' is being withdrawn from (shrinking, fewer authors). Route new behaviour to its successor; keep changes here to fixes and removals.'
  WHEN phase = 'no_data' THEN 'Too little history to judge ' || module || '; treat as new code and add tests with any change.'
  WHEN status = 'isolated' THEN module || ' is in active development; nothing in the repository imports it or changes with it, so it is an entry point or new code — new code belongs here, keep it decoupled.'
  ELSE module || ' is in active development; new code belongs here. Keep coupling to its usual partners only.' END AS advice
FROM x""",
    "repository_summary": f"""
WITH {_PHASES}, m AS (SELECT coalesce(p.phase, 'no_data') AS phase FROM (SELECT DISTINCT module FROM mp) m LEFT JOIN phases p ON p.module = m.module)
SELECT (SELECT count(*) FROM commits) AS commits, (SELECT count(*) FROM commits WHERE noise_reason IS NOT NULL) AS noise_commits, (SELECT min(ts)::DATE::VARCHAR FROM commits) AS first_commit, (SELECT max(ts)::DATE::VARCHAR FROM commits) AS last_commit,
       count(*) AS modules, count(*) FILTER (phase = 'growth') AS growth, count(*) FILTER (phase = 'stabilizing') AS stabilizing, count(*) FILTER (phase = 'decline') AS decline, count(*) FILTER (phase = 'no_data') AS no_data FROM m""",
    "step_sizes": f"""
WITH {_CHANGES}, s AS (SELECT CASE WHEN files <= 3 THEN '1-3' WHEN files <= 10 THEN '4-10' WHEN files <= 50 THEN '11-50' ELSE '51+' END AS size, (added + deleted)::DOUBLE AS t FROM commits),
g AS (SELECT size, count(*) AS n, median(t) AS m, list(t ORDER BY t) AS v FROM s GROUP BY size)
SELECT 'shared' AS mode, size, n, round(m, 1) AS median_total_ms, round(v[floor(0.95 * (n - 1))::INT + 1], 1) AS p95_total_ms FROM g""",
}
