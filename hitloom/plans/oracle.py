"""The queries of ``hitloom.plans.queries`` as SQL over the same tables.

Steps stand in ``STEPS`` in the order in which they build on each other; a query names the last
step it needs.
"""

from __future__ import annotations

from hitloom.operators.panels import DEFAULT_LIMIT, ROOT_METRIC
from hitloom.plans.dashboards import SECTIONS
from hitloom.sources import derived

SITE, FROM, TO = 1, "2024-01-11", "2024-01-20"
AGENTS = ", ".join("'" + a + "'" for a in derived.AGENTS)
REFERRERS = ", ".join("'" + (r or "-") + "'" for r in derived.REFERRERS)
# What the classification must say of the agent and the referrer of each remainder.
BROWSER = "'Edge', 'Firefox', 'Andere', 'Chrome', 'Chrome Mobile', 'Mobile Safari'"
BROWSER_VER = "'109.0.1518.61', '112.0', '', '108.0.5359.124', '99.0.4844.58', '15.6.1'"
SYSTEM = "'Windows', 'Android', 'Andere', 'Linux', 'Android', 'iOS'"
SYSTEM_VER = "'Windows (älter)', 'Android 12', 'Andere', 'Linux', 'Android 11', 'iOS 15.6.1'"
DEVICE = "'Desktop', 'Smartphone', 'Desktop', 'Desktop', 'Smartphone', 'Smartphone'"
MODEL = "'Desktop-PC', 'Smartphone (sonstige)', 'Desktop-PC', 'Desktop-PC', 'Google Pixel 4', 'Apple iPhone'"
REF_HOST = "'duckduckgo.com', '-', 'www.linkedin.com', 'old.example.net:8080', 'www.ecosia.org', 'x.com'"
REF_TYPE = "'search', 'direct', 'social', 'website', 'search', 'social'"
REF_NAME = "'DuckDuckGo', NULL, 'www.linkedin.com', 'old.example.net:8080', 'Ecosia', 'Twitter'"
DOWNLOADS = r"\.(pdf|zip|7z|gz|tgz|tar|rar|docx?|xlsx?|pptx?|od[tsp]|csv|rtf|ics|epub|mp[34])([?#]|$)"
ASSETS = r"\.(css|js|png|jpg|jpeg|gif|svg|woff2?|ico|map)$"

STEPS = {
    # Each event says all about its line, so nothing is parsed or matched here.
    "fields": rf"""SELECT CAST(v % 2 AS INTEGER) AS site_id, e AS rid, v, event_type AS kind, ts AS instant,
      CASE WHEN v % 7 = 6 THEN concat('2001:db8::', v % 1000) ELSE concat(8 + v % 3, '.8.', v % 256, '.', 1 + v % 200) END AS ip,
      strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') AS tsraw, CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
      CASE WHEN e % 11 = 0 THEN '{derived.STYLE_SHEET}'
        WHEN event_type = 'view' THEN concat('/p/', e % 13, '/', e % 4)
        WHEN event_type = 'click' THEN concat('/p/', e % 5)
        WHEN event_type = 'signup' THEN '/signup/?x=1'
        WHEN event_type = 'purchase' THEN concat('/docs/f', e % 9, '.pdf?dl=1')
        ELSE concat('/gone/', e % 3) END AS url,
      CASE WHEN event_type <> 'error' THEN '200' WHEN e % 2 = 0 THEN '404' ELSE '500' END AS status,
      CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS size,
      concat(([{REFERRERS}])[e % 6 + 1], CASE WHEN e % 6 = 0 THEN CAST(e % 10 AS VARCHAR) ELSE '' END) AS referrer,
      ([{AGENTS}])[v % 6 + 1] AS ua
    FROM (SELECT event_id AS e, user_id // 20 AS v, date_trunc('second', ts) AS ts, event_type, value FROM events)""",
    "timed": "SELECT * REPLACE (timezone('UTC', instant) AS instant), timezone('Europe/Berlin', timezone('UTC', instant)) AS wall FROM fields",
    "told": rf"""SELECT site_id, rid, v, ip, ua, method, url, referrer, instant, CAST(wall AS DATE) AS datum, CAST(hour(wall) AS INTEGER) AS stunde,
      CAST(status AS INTEGER) AS status, CAST(size AS BIGINT) AS bytes,
      CASE WHEN v % 7 <> 6 THEN (8 + v % 3) * 16777216 + 8 * 65536 + v % 256 * 256 + 1 + v % 200 END AS ipint,
      md5(concat_ws('|', ip, ua, 's')) AS vkey, v % 6 = 2 AS is_bot, kind = 'purchase' AND rid % 11 <> 0 AS is_download,
      ([{BROWSER}])[v % 6 + 1] AS browser, ([{BROWSER_VER}])[v % 6 + 1] AS browser_ver, ([{SYSTEM}])[v % 6 + 1] AS os, ([{SYSTEM_VER}])[v % 6 + 1] AS os_ver,
      ([{DEVICE}])[v % 6 + 1] AS device, ([{MODEL}])[v % 6 + 1] AS device_model,
      ([{REF_HOST}])[rid % 6 + 1] AS ref_host, ([{REF_TYPE}])[rid % 6 + 1] AS ref_type, ([{REF_NAME}])[rid % 6 + 1] AS ref_name,
      CASE WHEN rid % 6 = 0 THEN concat('garden hose ', rid % 10) END AS keyword,
      CASE WHEN v % 7 = 6 OR v % 3 = 0 AND v % 256 = 0 THEN 'DE' ELSE (['US', 'AU', 'FR'])[v % 3 + 1] END AS country
    FROM timed""",
    "hits_all": "SELECT * FROM told WHERE NOT is_bot AND rid % 11 <> 0",
    "hits": "SELECT * FROM hits_all WHERE status = 200",
    "marked": """SELECT *, CASE WHEN epoch(instant) - lag(epoch(instant)) OVER w <= 1800 THEN 0 ELSE 1 END AS new_session
    FROM hits WINDOW w AS (PARTITION BY site_id, vkey ORDER BY instant, rid)""",
    "sess": "SELECT *, CAST(sum(new_session) OVER (PARTITION BY site_id, vkey ORDER BY instant, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM marked",
    "ip4": "SELECT DISTINCT ipint, country AS cc FROM hits_all WHERE ipint IS NOT NULL",
    "ip6": "SELECT DISTINCT ip, country AS cc FROM hits_all WHERE ipint IS NULL",
    "visits": """SELECT * EXCLUDE (nth, keyword), word AS keyword, url AS entry_url, browser || ' ' || browser_ver AS browser_version, os_ver AS os_version FROM (
      SELECT *, row_number() OVER one AS nth, last_value(url) OVER one AS exit_url, first_value(keyword IGNORE NULLS) OVER one AS word, count(*) OVER one AS pageviews FROM sess
      WINDOW one AS (PARTITION BY site_id, vkey, seq ORDER BY instant, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE nth = 1""",
    "daily": """SELECT site_id, datum, CAST(sum(visit) AS BIGINT) AS visits, CAST(sum(1 - visit) AS BIGINT) AS pageviews,
      count(DISTINCT CASE visit WHEN 1 THEN vkey END) AS uniques, CAST(sum(visit * single) AS BIGINT) AS bounces, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM (SELECT site_id, datum, vkey, 0 AS visit, 0 AS single, bytes FROM sess
      UNION ALL SELECT site_id, datum, vkey, 1, CAST(pageviews = 1 AS INTEGER), 0 FROM visits) GROUP BY site_id, datum""",
    "hit_cells": """SELECT site_id, datum, dim, NULL::VARCHAR AS parent, dimkey, count(*) AS pv, count(DISTINCT (vkey, seq)) AS v FROM (
      SELECT *, unnest(['url', 'method', 'hour', 'download']) AS dim,
        unnest([url, method, lpad(CAST(stunde AS VARCHAR), 2, '0'), CASE WHEN is_download THEN url END]) AS dimkey FROM sess)
    WHERE dim <> 'download' OR is_download GROUP BY ALL""",
    "visit_cells": """SELECT site_id, datum, dim, parent, dimkey, CAST(sum(pageviews) AS BIGINT) AS pv, count(*) AS v FROM (
      SELECT site_id, datum, pageviews, unnest([
        {'dim': 'entry', 'parent': NULL, 'dimkey': entry_url, 'on': true}, {'dim': 'exit', 'parent': NULL, 'dimkey': exit_url, 'on': true},
        {'dim': 'referrer_type', 'parent': NULL, 'dimkey': ref_type, 'on': true},
        {'dim': 'referrer_name', 'parent': ref_type, 'dimkey': ref_name, 'on': ref_name IS NOT NULL},
        {'dim': 'referrer_url', 'parent': ref_name, 'dimkey': referrer, 'on': ref_name IS NOT NULL AND referrer NOT IN ('', '-')},
        {'dim': 'keyword', 'parent': NULL, 'dimkey': keyword, 'on': keyword IS NOT NULL},
        {'dim': 'country', 'parent': NULL, 'dimkey': country, 'on': true}, {'dim': 'browser', 'parent': NULL, 'dimkey': browser, 'on': true},
        {'dim': 'browser_version', 'parent': browser, 'dimkey': browser_version, 'on': true}, {'dim': 'os', 'parent': NULL, 'dimkey': os, 'on': true},
        {'dim': 'os_version', 'parent': os, 'dimkey': os_version, 'on': true}, {'dim': 'device', 'parent': NULL, 'dimkey': device, 'on': true},
        {'dim': 'device_model', 'parent': device, 'dimkey': device_model, 'on': true}], recursive := true) FROM visits)
    WHERE "on" GROUP BY ALL""",
    "status_cells": """SELECT site_id, datum, 'status' AS dim, NULL::VARCHAR AS parent, CAST(status AS VARCHAR) AS dimkey, count(*) AS pv, count(DISTINCT vkey) AS v
    FROM hits_all GROUP BY ALL""",
    "cube": "SELECT * FROM hit_cells UNION ALL SELECT * FROM visit_cells UNION ALL SELECT * FROM status_cells",
    "meta": """SELECT site_id, CASE site_id WHEN 0 THEN 'Site A' ELSE 'Site B' END AS site, CAST(min(datum) AS VARCHAR) AS von, CAST(max(datum) AS VARCHAR) AS bis,
      CAST(sum(visits) AS BIGINT) AS visits_total, CAST(sum(pageviews) AS BIGINT) AS pageviews_total, CAST(sum(uniques) AS BIGINT) AS uniques_total,
      CAST(sum(bounces) AS BIGINT) AS bounces_total, CAST(sum(bytes) AS BIGINT) AS bytes_total,
      '2024-02-01 00:00' AS erzeugt, CAST(2 AS INTEGER) AS schema_version, 'Europe/Berlin' AS tz FROM daily GROUP BY site_id""",
    "windows": """SELECT site_id, win, greatest(a, CAST(von AS DATE)) AS wfrom, least(b, CAST(bis AS DATE)) AS wto FROM (
      SELECT site_id, von, bis, unnest(['last30', 'last90', 'last365', 'thisyear', 'lastyear', 'all']) AS win,
        unnest([CAST(bis AS DATE) - 29, CAST(bis AS DATE) - 89, CAST(bis AS DATE) - 364, make_date(year(CAST(bis AS DATE)), 1, 1), make_date(year(CAST(bis AS DATE)) - 1, 1, 1), CAST(von AS DATE)]) AS a,
        unnest([CAST(bis AS DATE), CAST(bis AS DATE), CAST(bis AS DATE), make_date(year(CAST(bis AS DATE)), 12, 31), make_date(year(CAST(bis AS DATE)) - 1, 12, 31), CAST(bis AS DATE)]) AS b FROM meta)
    WHERE greatest(a, CAST(von AS DATE)) <= least(b, CAST(bis AS DATE))""",
    "week": f"SELECT cube.* FROM cube JOIN meta USING (site_id) WHERE site_id = {SITE} AND datum BETWEEN CAST(bis AS DATE) - 6 AND CAST(bis AS DATE)",
    "mine": f"SELECT * FROM cube WHERE site_id = {SITE} AND datum BETWEEN DATE '{FROM}' AND DATE '{TO}'",
    "days": f"SELECT * FROM daily WHERE site_id = {SITE} AND datum BETWEEN DATE '{FROM}' AND DATE '{TO}'",
    "before": f"SELECT * FROM daily WHERE site_id = {SITE} AND datum BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'",
}


def _with(last: str, query: str) -> str:
    names = list(STEPS)[: list(STEPS).index(last) + 1]
    return "WITH " + ",\n".join(f"{n} AS (\n    {STEPS[n]})" for n in names) + "\n" + query


def _top(dim: str, metric: str, limit: int, offset: int = 0, where: str = "true") -> str:
    return f"""SELECT dimkey, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v FROM mine WHERE dim = '{dim}' AND dimkey <> '' AND {where}
    GROUP BY dimkey ORDER BY {metric} DESC, dimkey LIMIT {limit} OFFSET {offset}"""


PARTIAL = ' – loaded subset only, see "+ N more" in the dashboard'


def _sections() -> str:
    return ", ".join(f"({i}, '{d}', '{t}', '{m}', {100 if d in ROOT_METRIC else 1 << 40})" for i, (d, t, m) in enumerate(SECTIONS))


TREE = "SELECT *, split_part(substr(dimkey, {n}), '/', 1) AS s0, substr(dimkey, {n} + length(split_part(substr(dimkey, {n}), '/', 1)) + 1) AS r0 FROM {rows} WHERE dim = 'url' AND starts_with(dimkey, '{p}/')"


def _levels(rows: str, first: int, last: int, below: int) -> str:
    """Two levels of the page tree, of which the upper one shows the ranks from first to last."""
    return f""", t AS (SELECT *, split_part(r0, '/', 1) AS s1, substr(r0, length(split_part(r0, '/', 1)) + 2) AS r1 FROM ({TREE.format(n=2, p="", rows=rows)}) WHERE s0 <> ''),
one AS (SELECT s0, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v, bool_or(r0 <> '') AS has_children, row_number() OVER (ORDER BY sum(pv) DESC, s0) AS rnk FROM t GROUP BY s0 QUALIFY rnk BETWEEN {first} AND {last}),
two AS (SELECT s0, s1, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v, bool_or(r1 <> '') AS has_children, row_number() OVER (PARTITION BY s0 ORDER BY sum(pv) DESC, s1) AS rnk
  FROM t WHERE s1 <> '' AND s0 IN (SELECT s0 FROM one) GROUP BY s0, s1 QUALIFY rnk <= {below})
SELECT 1 AS level, '/' || s0 AS path, '' AS parent_path, pv, v, has_children, CAST(rnk AS INTEGER) AS rnk, (SELECT count(DISTINCT s0) FROM t) AS n FROM one
UNION ALL SELECT 2, '/' || s0 || '/' || s1, '/' || s0, pv, v, has_children, CAST(rnk AS INTEGER), (SELECT count(DISTINCT s1) FROM t WHERE t.s0 = two.s0 AND s1 <> '') FROM two"""


# What the queries write out of the log and read back.
LINE = """SELECT concat(ip, ' - - [', tsraw, '] "', method, ' ', url, ' HTTP/1.1" ', status, ' ', size, ' "', referrer, '" "', ua, '"') AS line FROM fields"""
NETWORKS = "SELECT DISTINCT user_id // 20 AS v, (user_id // 20) * 256 + 16777216 AS start, (['US', 'AU', 'FR'])[(user_id // 20) % 3 + 1] AS cc FROM events"
RANGES = f'SELECT start, start + 255 AS "end", cc FROM ({NETWORKS})'
# Each line with the bytes before it in the file of its site, and the days that a stream imports.
PLACED = f"""SELECT site_id, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY site_id ORDER BY {{order}} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte
FROM ({LINE.replace("SELECT ", "SELECT site_id, rid, instant >= TIMESTAMP '" + FROM + "' AS late, ", 1)})"""
IMPORTED = f""", first AS (SELECT *, CASE WHEN epoch(instant) - lag(epoch(instant)) OVER w <= 1800 THEN 0 ELSE 1 END AS begins FROM hits WHERE datum < DATE '{TO}'
  WINDOW w AS (PARTITION BY site_id, ip, ua, datum ORDER BY instant, rid)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY site_id, ip, ua, datum ORDER BY instant, rid ROWS UNBOUNDED PRECEDING) AS nth FROM first),
single AS (SELECT site_id, datum, ip, ua, nth, count(*) AS pageviews, sum(bytes) AS bytes FROM numbered GROUP BY ALL)
SELECT site_id, datum, count(*) AS visits, CAST(sum(pageviews) AS BIGINT) AS pageviews, count(DISTINCT (ip, ua)) AS uniques,
  count(*) FILTER (pageviews = 1) AS bounces, CAST(sum(bytes) AS BIGINT) AS bytes FROM single GROUP BY site_id, datum"""
REPORTED = "'url', 'download', 'entry', 'exit', 'country', 'browser', 'os', 'device', 'referrer_type', 'keyword', 'hour'"
FIELDS = "site_id, rid, ip, tsraw, method, url, status, size, referrer, ua"
VISIT = "site_id, vkey, seq, datum, pageviews, entry_url, exit_url, browser, browser_version, os, os_version, device, device_model, referrer, ref_type, ref_name, keyword, country"
KPIS = """SELECT CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits, CAST(coalesce(sum(pageviews), 0) AS BIGINT) AS pageviews, CAST(coalesce(sum(uniques), 0) AS BIGINT) AS uniques,
    CAST(coalesce(sum(bounces), 0) AS BIGINT) AS bounces, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, 100.0::DOUBLE * sum(bounces) / nullif(sum(visits), 0) AS bounce_rate"""


def oracle_sql() -> dict[str, str]:
    listed = f"""SELECT DISTINCT ua, (['TestEdge', 'TestFox', NULL, 'TestChrome', 'TestChrome', NULL])[v % 6 + 1] AS browser,
      (['109', '112.0', '', 'v108', 'v99', ''])[v % 6 + 1] AS browser_ver,
      (['Windows', 'TestDroid', NULL, 'TestUnix', 'TestDroid', NULL])[v % 6 + 1] AS os,
      (['Windows 8.1', 'TestDroid 12', NULL, 'TestUnix', 'TestDroid 11', NULL])[v % 6 + 1] AS os_ver FROM hits_all"""
    deltas = """SELECT kpi, cur, prev, CASE WHEN prev <> 0 THEN 100.0 * (cur - prev) / prev END AS delta,
      CASE WHEN prev IS NULL THEN NULL WHEN prev = 0 THEN CASE WHEN cur > 0 THEN 'new' ELSE 'flat' END WHEN 100.0 * (cur - prev) / prev > 0.05 THEN 'up' WHEN 100.0 * (cur - prev) / prev < -0.05 THEN 'down' WHEN cur IS NOT NULL THEN 'flat' END AS trend"""
    out = {
        "src_combined": _with("fields", f"SELECT {FIELDS} FROM fields"),
        "src_combined_vhost": _with("fields", f"SELECT {FIELDS} FROM fields"),
        "src_common": _with("fields", f"SELECT {FIELDS.replace('referrer, ua', '')} '' AS referrer, '' AS ua FROM fields"),
        "src_custom": _with("fields", f"SELECT {FIELDS} FROM fields"),
        "src_json": _with(
            "fields",
            "SELECT site_id, rid, " + ", ".join(f"CASE WHEN rid % 11 <> 0 THEN {c} END AS {c}" for c in FIELDS.split(", ")[2:]) + " FROM fields WHERE rid % 7 <> 0",
        ),
        "prj_times": _with("timed", "SELECT rid, CAST(epoch(instant) AS BIGINT) AS seconds, CAST(wall AS DATE) AS datum, CAST(hour(wall) AS INTEGER) AS stunde FROM timed"),
        "prj_classified": _with("told", "SELECT rid, status, bytes, ipint, vkey, is_bot, is_download, browser, browser_ver, os, os_ver, device, device_model, ref_host, keyword FROM told"),
        "prj_referrers": _with(
            "told",
            "SELECT rid, ref_type, ref_name FROM told",
        ),
        "prj_privacy": _with(
            "fields",
            r"""SELECT rid, replace(replace(url, '?x=1', '?x=REMOVED'), '?dl=1', '?dl=REMOVED') AS url, CASE WHEN contains(ip, ':') THEN ip ELSE regexp_replace(ip, '[0-9]+$', '0') END AS ip FROM fields""",
        ),
        "prj_page_urls": rf"""SELECT page_id, regexp_replace(url, '^https?://([^/]+).*', '\1') AS ref_host,
    regexp_replace(url, '([?&])(page|utm_source)=[^&#\s"]*', '\1\2=REMOVED', 'g') AS masked,
    regexp_matches(lower(url), '{DOWNLOADS}') AS is_download, regexp_matches(url, '{ASSETS}') AS is_asset FROM pages""",
        "flt_clean_hits": _with("hits_all", "SELECT site_id, rid, status, url FROM hits_all"),
        "flt_bot_list": _with("hits_all", "SELECT site_id, count(*) AS n FROM hits_all GROUP BY site_id"),
        "flt_bots_kept": _with("told", f"SELECT site_id, count(*) AS n FROM told WHERE rid % 11 <> 0 GROUP BY site_id"),
        "flt_before_day": _with("hits_all", f"SELECT site_id, rid, datum FROM hits_all WHERE datum < DATE '{TO}'"),
        "flt_within_days": _with("hits_all", f"SELECT site_id, rid, datum FROM hits_all WHERE datum BETWEEN DATE '{FROM}' AND DATE '{TO}'"),
        "jn_ua_lookup": _with("hits_all", listed),
        "jn_ua_applied": _with(
            "hits_all",
            f"""SELECT coalesce(l.browser, h.browser) AS browser, l.browser_ver, coalesce(l.os, h.os) AS os, coalesce(l.os_ver, h.os_ver) AS os_ver, count(*) AS n
    FROM hits_all h JOIN ({listed}) l USING (ua) GROUP BY ALL""",
        ),
        "jn_ip_country": _with("ip4", "SELECT * FROM ip4"),
        "jn_ip6_country": _with("ip6", "SELECT * FROM ip6"),
        "jn_visible_sites": _with("meta", "SELECT site_id, site FROM meta WHERE site_id IN (1, 7)"),
        "wn_sessionize": _with("sess", "SELECT site_id, rid, new_session, seq FROM sess"),
        "wn_session_window": _with("sess", "SELECT site_id, vkey, CAST(epoch(min(instant)) AS BIGINT) AS started, count(*) AS pageviews FROM sess GROUP BY site_id, vkey, seq"),
        "ag_visits": _with("visits", f"SELECT {VISIT} FROM visits"),
        "ag_daily": _with("daily", "SELECT * FROM daily"),
        "ag_cube": _with("cube", "SELECT * FROM cube"),
        "ag_cube_hit_dims": _with("hit_cells", "SELECT * FROM hit_cells"),
        "ag_cube_status": _with("status_cells", "SELECT * FROM status_cells"),
        "ag_cube_visit_dims": _with("visit_cells", "SELECT * FROM visit_cells"),
        "ag_batch_totals": _with(
            "daily",
            """SELECT * FROM (SELECT site_id, min(datum) AS von, max(datum) AS bis, count(*) AS pageviews_total, CAST(sum(bytes) AS BIGINT) AS bytes_total FROM sess GROUP BY site_id)
    JOIN (SELECT site_id, count(*) AS visits_total, count(DISTINCT vkey) AS uniques_total, count(*) FILTER (pageviews = 1) AS bounces_total FROM visits GROUP BY site_id) USING (site_id)""",
        ),
        "ag_site_meta": _with("meta", "SELECT * FROM meta"),
        "ag_dim_summary": _with("mine", "SELECT CAST(coalesce(sum(pv), 0) AS BIGINT) AS pv, CAST(coalesce(sum(v), 0) AS BIGINT) AS v, count(DISTINCT dimkey) AS n FROM mine WHERE dim = 'entry' AND dimkey <> ''"),
        "ag_dim_totals": _with("mine", "SELECT dimkey, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v FROM mine WHERE dim = 'url' GROUP BY dimkey"),
        "st_local_hours": _with("hits", "SELECT site_id, datum, stunde, count(*) AS pageviews, CAST(sum(bytes) AS BIGINT) AS bytes FROM hits GROUP BY ALL"),
        "st_days_to_build": _with("daily", f"SELECT CAST(unnest(generate_series((SELECT max(datum) + 1 FROM daily WHERE datum < DATE '{FROM}'), DATE '{TO}' - 1, INTERVAL 1 DAY)) AS DATE) AS datum"),
        "tk_top_n": _with("mine", _top("entry", "v", 5)),
        "tk_top_n_page": _with("mine", _top("download", "pv", 3, 2)),
        "tk_children": _with("mine", _top("referrer_url", "v", 10, 0, "parent = 'DuckDuckGo'")),
        "tk_topn_table": _with(
            "windows",
            """, inside AS (SELECT w.win, c.* FROM cube c JOIN windows w USING (site_id) WHERE datum BETWEEN wfrom AND wto AND dimkey <> ''),
sums AS (
  SELECT site_id, win, dim, NULL::VARCHAR AS parent, dimkey, sum(pv) AS pv, sum(v) AS v, CASE WHEN dim IN ('download', 'status', 'method') THEN sum(pv) ELSE sum(v) END AS m, 0 AS level
  FROM inside WHERE dim IN ('keyword', 'entry', 'exit', 'download', 'status', 'method', 'browser', 'os', 'device', 'referrer_type', 'referrer_url') GROUP BY site_id, win, dim, dimkey
  UNION ALL
  SELECT site_id, win, dim, parent, dimkey, sum(pv), sum(v), sum(v), 1
  FROM inside WHERE dim IN ('browser_version', 'os_version', 'device_model', 'referrer_name', 'referrer_url') AND parent IS NOT NULL GROUP BY site_id, win, dim, parent, dimkey)
SELECT site_id, win, dim, parent, dimkey, CAST(pv AS BIGINT) AS pv, CAST(v AS BIGINT) AS v,
  CAST(row_number() OVER (PARTITION BY site_id, win, level, dim, parent ORDER BY m DESC, dimkey) AS SMALLINT) AS rnk
FROM sums QUALIFY rnk <= 5""",
        ),
        "tk_precomputed": _with(
            "windows",
            f"""SELECT dimkey, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v FROM cube JOIN windows USING (site_id)
    WHERE site_id = {SITE} AND win = 'last30' AND datum BETWEEN wfrom AND wto AND dim = 'browser' GROUP BY dimkey ORDER BY v DESC, dimkey LIMIT 8""",
        ),
        "tk_share": _with(
            "mine",
            f""", page AS ({_top("entry", "v", 5)}), total AS (SELECT sum(v) AS v, count(DISTINCT dimkey) AS n FROM mine WHERE dim = 'entry')
SELECT page.*, 100.0::DOUBLE * page.v / total.v AS share, 100.0::DOUBLE * page.v / max(page.v) OVER () AS bar, total.n - count(*) OVER () AS more FROM page, total""",
        ),
        "hr_tree_children": _with(
            "mine",
            f""", t AS ({TREE.format(n=4, p="/p", rows="mine")})
SELECT s0 AS segment, '/p/' || s0 AS path, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v, bool_or(r0 <> '') AS has_children, (SELECT count(DISTINCT s0) FROM t WHERE s0 <> '') AS n
FROM t WHERE s0 <> '' GROUP BY s0 ORDER BY pv DESC, s0 LIMIT 6 OFFSET 1""",
        ),
        "hr_url_tree": _with("mine", _levels("mine", 2, 4, 3)),
        "tw_preset_windows": _with("windows", "SELECT * FROM windows"),
        "tw_kpis": _with("days", f"{KPIS} FROM days"),
        "tw_kpi_deltas": _with(
            "before",
            f""", cur AS ({KPIS} FROM days), prev AS ({KPIS} FROM before),
both_ AS (SELECT kpi, c.x AS cur, p.x AS prev FROM (SELECT * FROM (SELECT COLUMNS(*)::DOUBLE FROM cur) UNPIVOT INCLUDE NULLS (x FOR kpi IN (visits, pageviews, uniques, bounces, bytes, bounce_rate))) c JOIN (SELECT * FROM (SELECT COLUMNS(*)::DOUBLE FROM prev) UNPIVOT INCLUDE NULLS (x FOR kpi IN (visits, pageviews, uniques, bounces, bytes, bounce_rate))) p USING (kpi)),
d AS ({deltas} FROM both_)
SELECT *, CASE WHEN trend IN ('up', 'down') THEN (trend = 'up') = (kpi <> 'bounce_rate') END AS good FROM d""",
        ),
        "tw_trend": _with(
            "before",
            """SELECT datum, pageviews, visits, uniques, p.pageviews_prev FROM (SELECT *, row_number() OVER (ORDER BY datum) AS n FROM days)
    LEFT JOIN (SELECT pageviews AS pageviews_prev, row_number() OVER (ORDER BY datum) AS n FROM before) p USING (n)""",
        ),
        "tw_hour_profile": _with(
            "mine",
            """SELECT hour, CAST(coalesce(sum(pv), 0) AS BIGINT) AS pv, CAST(coalesce(sum(v), 0) AS BIGINT) AS v
    FROM (SELECT lpad(CAST(range AS VARCHAR), 2, '0') AS hour FROM range(24)) LEFT JOIN (SELECT * FROM mine WHERE dim = 'hour') ON dimkey = hour GROUP BY hour""",
        ),
        "tw_country_intensity": _with(
            "mine",
            "SELECT dimkey, CAST(sum(v) AS BIGINT) AS v, sqrt(sum(v) / max(sum(v)) OVER ()) AS intensity FROM mine WHERE dim = 'country' AND dimkey <> '??' GROUP BY dimkey",
        ),
        "tw_month_chunks": _with(
            "daily",
            """SELECT greatest(CAST(m AS DATE), a) AS chunk_from, least(last_day(m), b) AS chunk_to FROM (
      SELECT a, b, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS m FROM (SELECT min(datum) AS a, max(datum) AS b FROM daily))""",
        ),
        "src_lines": _with("fields", f"SELECT line, CAST(strlen(line) + 1 AS BIGINT) AS nbytes FROM ({LINE})"),
        "snk_run_metrics": _with("fields", f"SELECT count(*) AS n, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM ({LINE})"),
        "src_site_list": "SELECT CAST(page_id AS INTEGER) AS site_id, url AS logfile, 'Site A' AS name FROM pages WHERE page_id % 5 <> 0",
        "src_ua_list": """SELECT CAST(page_id AS INTEGER) AS prio, url AS regex, 'a "name"' AS name, '$1' AS version FROM pages WHERE page_id % 5 <> 0""",
        "src_geo_native": RANGES,
        "src_geo_ip2location": RANGES,
        "src_geo_dbip": RANGES,
        "src_geo_maxmind": RANGES,
        "src_geo_ip6": f"""SELECT concat('20010db8', digits, repeat('0', 20)) AS start_hex, concat('20010db8', digits, 'ffff', repeat('0', 16)) AS end_hex, cc
    FROM (SELECT lpad(lower(to_hex(v % 65536)), 4, '0') AS digits, cc FROM ({NETWORKS}))""",
        "src_report_daily": _with(
            "daily",
            "SELECT datum, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("visits", "pageviews", "uniques", "bounces")) + ", CAST(0 AS BIGINT) AS bytes FROM daily GROUP BY datum",
        ),
        "snk_report_import": _with(
            "cube",
            f"""SELECT CAST(9 AS INTEGER) AS site_id, datum, dim, NULL::VARCHAR AS parent, dimkey, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v
    FROM cube WHERE dim IN ({REPORTED}) GROUP BY datum, dim, dimkey""",
        ),
        "jn_ip_nested": f"""WITH r AS (
  SELECT start, "end", cc FROM ({RANGES}) UNION ALL SELECT start, "end", cc || '2' FROM ({RANGES}) UNION ALL VALUES (16777216, 16777216 + 67108864, 'ZZ'), (0, 4294967295, '--')),
a AS (SELECT DISTINCT user_id // 20 * 256 + 16777216 + event_id % 700 - 200 AS ipint FROM events)
SELECT ipint, arg_min(cc, ("end" - start, start, cc)) AS cc FROM a JOIN r ON ipint BETWEEN start AND "end" GROUP BY ipint""",
        "wn_hot_visitor": _with(
            "hits_all",
            """, one AS (SELECT *, CASE WHEN epoch(instant) - lag(epoch(instant)) OVER w <= 1800 THEN 0 ELSE 1 END AS new_session FROM hits_all WINDOW w AS (PARTITION BY site_id ORDER BY instant, rid))
SELECT site_id, rid, new_session, CAST(sum(new_session) OVER (PARTITION BY site_id ORDER BY instant, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM one""",
        ),
        "snk_runs": _with("fields", f""", l AS (SELECT count(*) AS n, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM ({LINE} WHERE instant < TIMESTAMP '{FROM}'))
SELECT 'all' AS kind, 'done' AS status, n, bytes, NULL AS told FROM l UNION ALL SELECT 'batch', 'done', n, bytes, NULL FROM l
UNION ALL SELECT 'none', 'empty', 0, 0, NULL UNION ALL SELECT 'broken', 'failed', NULL, NULL, true"""),
        "jn_ua_sql": _with("hits_all", """, listed(n, browser, version, release) AS (VALUES (0, 'TestEdge', '109', '8.1'), (0, 'TestChrome', 'v109', '8.1'),
  (1, 'TestFox', '112.0', ''), (3, 'TestChrome', 'v108', ''), (4, 'TestChrome', 'v99', ''))
SELECT DISTINCT ua, listed.browser, version, release FROM hits_all JOIN listed ON v % 6 = n"""),
        "src_report_sql": _with("cube", "SELECT datum, 'browser' AS dim, dimkey, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v FROM cube WHERE dim = 'browser' GROUP BY datum, dimkey"),
        "st_import": _with("hits", IMPORTED),
        "st_two_streams": _with("hits", IMPORTED),
        "st_growing_lines": _with("fields", PLACED.format(order="late, rid")),
        "src_log_files": _with("fields", PLACED.format(order="rid")),
        "wn_file_order": _with("visits", "SELECT site_id, vkey, seq, pageviews, entry_url, exit_url FROM visits"),
        "chk_schema": _with("meta", "SELECT max(schema_version) AS schema_version FROM meta"),
        "dsh_daily": _with("meta", f"SELECT daily.* EXCLUDE (site_id) FROM daily JOIN meta USING (site_id) WHERE site_id = {SITE} AND datum BETWEEN CAST(bis AS DATE) - 6 AND CAST(bis AS DATE)"),
        "dsh_meta": _with("meta", f"SELECT * FROM meta WHERE site_id = {SITE}"),
        "dsh_sites": _with("meta", "SELECT site_id, site FROM meta"),
        "dsh_tree": _with("week", _levels("week", 1, DEFAULT_LIMIT, DEFAULT_LIMIT)),
        "dsh_cube": _with("meta", f"SELECT cube.* FROM cube JOIN meta USING (site_id) WHERE site_id = {SITE} AND datum BETWEEN CAST(bis AS DATE) - 6 AND CAST(bis AS DATE) AND dim IN ('country', 'hour')"),
        "snk_csv_report": _with(
            "days",
            f""", named(nth, dim, title, metric, most) AS (VALUES {_sections()}),
sums AS (SELECT nth, title, metric, most, dimkey, sum(pv) AS pv, sum(v) AS v, row_number() OVER (PARTITION BY dim ORDER BY CASE metric WHEN 'v' THEN sum(v) ELSE sum(pv) END DESC, dimkey) AS rnk
  FROM mine JOIN named USING (dim) WHERE dimkey <> '' GROUP BY nth, dim, title, metric, most, dimkey QUALIFY rnk <= most),
said AS (SELECT *, CASE metric WHEN 'v' THEN 'Visits' ELSE 'Page views' END AS measure FROM sums),
t AS (SELECT *, split_part(r0, '/', 1) AS s1 FROM ({TREE.format(n=2, p="", rows="mine")}) WHERE s0 <> ''),
one AS (SELECT s0, sum(pv) AS pv, sum(v) AS v, row_number() OVER (ORDER BY sum(pv) DESC, s0) AS rnk FROM t GROUP BY s0 QUALIFY rnk <= 100),
two AS (SELECT s0, s1, sum(t.pv) AS pv, sum(t.v) AS v, one.rnk AS up, row_number() OVER (PARTITION BY s0 ORDER BY sum(t.pv) DESC, s1) AS rnk FROM t JOIN one USING (s0) WHERE s1 <> '' GROUP BY s0, s1, one.rnk QUALIFY rnk <= 100),
paths AS (SELECT '/' || s0 AS path, pv, v, rnk AS up, 0 AS rnk FROM one UNION ALL SELECT '/' || s0 || '/' || s1, pv, v, up, rnk FROM two),
lines AS (
  SELECT 0 AS part, nth, line FROM meta, (VALUES (0, 'Web statistics export'), (1, 'Website;Site B'), (2, 'Period;{FROM};to;{TO}'), (3, 'As of;2024-02-01 00:00'), (4, '')) AS head(nth, line) WHERE site_id = {SITE}
  UNION ALL VALUES (1, 0, 'Trend (daily)'), (1, 1, 'Date;Visits;Page views;Unique visitors;Bounces;Bytes')
  UNION ALL SELECT 2, row_number() OVER (ORDER BY datum) - 1, concat_ws(';', datum, visits, pageviews, uniques, bounces, bytes) FROM days
  UNION ALL SELECT 10 + 2 * nth, unnest([0, 1, 2]), unnest(['', title || ' (' || measure || ')' || CASE WHEN most = 100 THEN '{PARTIAL}' ELSE '' END, 'Value;' || measure || ';Page views;Visits']) FROM said WHERE rnk = 1
  UNION ALL SELECT 11 + 2 * nth, rnk - 1, concat_ws(';', dimkey, CASE metric WHEN 'v' THEN v ELSE pv END, pv, v) FROM said
  UNION ALL SELECT 40, unnest([0, 1, 2]), unnest(['', 'Pages (subtree totals) – loaded subset only, see page tree in the dashboard', 'Path;Page views;Visits']) FROM one WHERE rnk = 1
  UNION ALL SELECT 41, row_number() OVER (ORDER BY up, rnk) - 1, concat_ws(';', path, pv, v) FROM paths)
SELECT part, CAST(nth AS INTEGER) AS nth, CASE WHEN line LIKE '%"%' THEN '"' || replace(line, '"', '""') || '"' ELSE line END AS line FROM lines""",
        ),
        "snk_migration": _with("cube", "SELECT * FROM cube"),
        "snk_undone": _with("cube", f"SELECT * FROM cube WHERE NOT (site_id = {SITE} AND datum BETWEEN DATE '{FROM}' AND DATE '{TO}')"),
        "ag_stored_summary": _with("mine", "SELECT dim, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(v) AS BIGINT) AS v, count(DISTINCT dimkey) AS n FROM mine WHERE dimkey <> '' GROUP BY dim"),
        "src_bot_list": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[a-z]+[.]', 'i') OR regexp_matches(url, '/[0-9]+[?]')",
        "tw_dashboard_presets": _with(
            "meta",
            f""", e AS (SELECT CAST(von AS DATE) AS von, CAST(bis AS DATE) AS bis, today, least(CAST(bis AS DATE), CAST(today AS DATE)) AS a
    FROM meta, (SELECT unnest(['{TO}', '2030-06-15']) AS today) WHERE site_id = {SITE}),
p AS (SELECT *, unnest([
    ('today', a, a), ('yesterday', a - 1, a - 1), ('last7', a - 6, a), ('last30', a - 29, a), ('thismonth', date_trunc('month', a)::DATE, last_day(a)),
    ('lastmonth', (date_trunc('month', a) - INTERVAL 1 MONTH)::DATE, (date_trunc('month', a) - INTERVAL 1 DAY)::DATE),
    ('thisyear', make_date(year(a), 1, 1), make_date(year(a), 12, 31)), ('lastyear', make_date(year(a) - 1, 1, 1), make_date(year(a) - 1, 12, 31)), ('all', von, bis),
    ('year:2024', DATE '2024-01-01', DATE '2024-12-31'), ('year:2023', DATE '2023-01-01', DATE '2023-12-31')]) AS x FROM e)
SELECT x[1] AS preset, today, CAST(greatest(x[2], von) AS VARCHAR) AS day_from, CAST(least(x[3], bis) AS VARCHAR) AS day_to FROM p""",
        ),
        "snk_purged": _with("daily", "SELECT * FROM daily WHERE datum >= DATE '2024-01-15'"),
        "snk_replaced": _with(
            "daily",
            f"""SELECT * REPLACE (CASE WHEN site_id = {SITE} AND datum BETWEEN DATE '{FROM}' AND DATE '{TO}' THEN 10 * visits ELSE visits END AS visits) FROM daily
    WHERE NOT (site_id = {SITE} AND datum BETWEEN DATE '{FROM}' AND DATE '{TO}' AND day(datum) % 3 = 0)""",
        ),
        "chk_smoke": _with(
            "meta",
            """, n AS (SELECT 'visits_total' AS "check", CAST(sum(visits_total) AS BIGINT) AS n FROM meta UNION ALL SELECT 'sites', count(*) FROM meta
    UNION ALL SELECT 'daily', count(*) FROM daily UNION ALL SELECT 'cube', count(*) FROM cube)
SELECT *, n > 0 AS ok FROM n""",
        ),
        "ag_table_counts": _with(
            "windows",
            """, sums AS (
  SELECT site_id, win, dim, NULL::VARCHAR AS parent, dimkey, CASE WHEN dim IN ('download', 'status', 'method') THEN sum(pv) ELSE sum(v) END AS m, 0 AS level
  FROM cube JOIN windows USING (site_id) WHERE datum BETWEEN wfrom AND wto AND dimkey <> ''
    AND dim IN ('keyword', 'entry', 'exit', 'download', 'status', 'method', 'browser', 'os', 'device', 'referrer_type', 'referrer_url') GROUP BY site_id, win, dim, dimkey
  UNION ALL
  SELECT site_id, win, dim, parent, dimkey, sum(v), 1 FROM cube JOIN windows USING (site_id) WHERE datum BETWEEN wfrom AND wto AND dimkey <> ''
    AND dim IN ('browser_version', 'os_version', 'device_model', 'referrer_name', 'referrer_url') AND parent IS NOT NULL GROUP BY site_id, win, dim, parent, dimkey),
best AS (SELECT site_id, row_number() OVER (PARTITION BY site_id, win, level, dim, parent ORDER BY m DESC, dimkey) AS rnk FROM sums QUALIFY rnk <= 100)
SELECT * FROM (SELECT site_id, count(*) AS cube FROM cube GROUP BY site_id) JOIN (SELECT site_id, count(*) AS daily FROM daily GROUP BY site_id) USING (site_id)
  JOIN (SELECT site_id, count(*) AS topn FROM best GROUP BY site_id) USING (site_id)""",
        ),
        "chk_freshness": _with(
            "meta",
            """, a AS (SELECT site_id, site, bis AS last_data, CAST(floor((epoch(TIMESTAMP '2024-02-01 12:30:00') - epoch(timezone('UTC', timezone('Europe/Berlin', CAST(bis AS TIMESTAMP) + INTERVAL '23:59:59')))) / 3600) AS BIGINT) AS age_hours FROM meta)
SELECT site_id, site, CASE WHEN age_hours >= 50 THEN 'CRIT' WHEN age_hours >= 26 THEN 'WARN' ELSE 'OK' END AS status, last_data, age_hours FROM a""",
        ),
    }
    # The same answers from other ways of storing.
    for stored, live in (("tk_rolled_topn", "tk_topn_table"), ("tk_rolled_range", "tk_top_n"), ("tk_exchange", "tk_top_n"), ("tk_exchange_children", "tk_children"), ("hr_stored_tree", "hr_url_tree"), ("hr_stored_children", "hr_tree_children")):
        out[stored] = out[live]
    return out
