"""The registered queries as DuckDB SQL, for checking results.

Statements share common table expressions, which are put together here as text.
"""

from __future__ import annotations

from pagetab.functions.urls import SENSITIVE_KEYS
from pagetab.operators.policies import NOT_GLOBAL_V4
from pagetab.plans.derived import ROBOTS_BODIES, SLOW_BODY, V6_STARTS

_KEYS = ", ".join(f"'{k}'" for k in SENSITIVE_KEYS)
_WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}', ' ', 'g'), ' ')"


def _sensitive(query: str) -> str:
    return (
        f"(len(list_filter(string_split({query}, '&'), lambda kv: regexp_matches(kv, '(?s)^[^=]*=.') AND "
        f"lower(url_decode(replace(split_part(kv, '=', 1), '+', ' '))) IN ({_KEYS}))) > 0)"
    )


def _normal(source: str, name: str) -> str:
    """CTEs that add ``normal`` to the relation ``source`` (which has a column ``raw``); the last one is ``name``."""
    return rf"""{name}_cut AS (
  SELECT *, regexp_extract(ltrim(raw, ' '), '(?s)^((?:[hH][tT][tT][pP])[sS]?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$',
                           ['scheme', 'netloc', 'path', 'query']) AS c FROM {source}),
{name}_auth AS (
  SELECT *, lower(c.scheme) AS scheme, regexp_extract(c.netloc, '^([^:\[\]@]+)(?::([0-9]*))?$', ['host', 'port']) AS a
  FROM {name}_cut),
{name} AS (
  SELECT * EXCLUDE (c, a, scheme), CASE
    WHEN raw IS NULL OR length(raw) > 4096 OR regexp_matches(raw, '[\x00-\x1f\\]') THEN NULL
    WHEN a.host = '' OR NOT regexp_matches(a.host, '^([^.]{{1,63}}\.)*[^.]{{0,63}}$') THEN NULL
    WHEN a.port <> '' AND coalesce(try_cast(a.port AS BIGINT), 65536) > 65535 THEN NULL
    WHEN {_sensitive('c.query')} THEN NULL
    ELSE scheme || '://' || lower(a.host)
      || CASE WHEN a.port = '' OR try_cast(a.port AS BIGINT) = CASE scheme WHEN 'https' THEN 443 ELSE 80 END THEN ''
              ELSE ':' || cast(try_cast(a.port AS BIGINT) AS VARCHAR) END
      || CASE WHEN c.path = '' THEN '/' ELSE c.path END
      || CASE WHEN c.query = '' THEN '' ELSE '?' || c.query END
    END AS normal FROM {name}_auth)"""


def _origin(url: str) -> str:
    return f"nullif(regexp_extract({url}, '^https?://[^/?#]*'), '')"


def _admitted(normal: str, allowed: str) -> tuple[str, str]:
    reason = (
        f"CASE WHEN {normal} IS NULL THEN 'invalid_or_sensitive_url' "
        f"WHEN {_origin(normal)} <> {allowed} THEN 'outside_origin' END"
    )
    return f"CASE WHEN {_origin(normal)} = {allowed} THEN {normal} END", reason


_URL_FORMS = r"""url_forms AS (
  SELECT page_id, url AS page_url, unnest([
    {'form': 'plain', 'raw': url},
    {'form': 'upper', 'raw': upper(url)},
    {'form': 'default_port', 'raw': regexp_replace(url, '^(https)(://[^/]+)', '\1\2:0443')},
    {'form': 'other_port', 'raw': regexp_replace(url, '^(https?://[^/]+)', '\1:8443')},
    {'form': 'bad_port', 'raw': regexp_replace(url, '^(https?://[^/]+)', '\1:65536')},
    {'form': 'word_port', 'raw': regexp_replace(url, '^(https?://[^/]+)', '\1:wrong')},
    {'form': 'userinfo', 'raw': replace(url, '://', '://me@')},
    {'form': 'secret', 'raw': regexp_replace(url, '[?#].*', '') || '?a=1&%74oken=x'},
    {'form': 'blank_secret', 'raw': regexp_replace(url, '[?#].*', '') || '?TOKEN='},
    {'form': 'upper_secret', 'raw': regexp_replace(url, '[?#].*', '') || '?Api_Key=1&b=2'},
    {'form': 'late_fragment', 'raw': regexp_replace(url, '#.*', '') || '#?token=1'},
    {'form': 'other_scheme', 'raw': regexp_replace(url, '^https?', 'ftp')},
    {'form': 'newline', 'raw': url || chr(10)},
    {'form': 'backslash', 'raw': url || '\x'},
    {'form': 'led_by_spaces', 'raw': '  ' || url},
    {'form': 'empty_label', 'raw': replace(url, '.example.', '..example.')},
    {'form': 'no_path', 'raw': regexp_extract(url, '^https?://[^/]+')},
    {'form': 'bare_query', 'raw': regexp_extract(url, '^https?://[^/]+') || '?'},
    {'form': 'too_long', 'raw': url || repeat('x', 4096)}], recursive := true) FROM pages)"""

# The page URL is already normal apart from its fragment.
_PAGES = rf"""p AS (
  SELECT page_id, html, url AS page_url, regexp_replace(url, '#.*', '') AS url, {_origin('url')} AS crawl_id FROM pages)"""

_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


def _entities(text: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{entity}', '{char}')"
    # A title cut off inside the entity has it without its semicolon, which HTML also reads.
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


_TEXTS = rf"""texts AS (
  SELECT page_id, url,
    {_clean(_entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
    {_clean(_entities(f"regexp_replace({_ARTICLE}, '<[^>]*>', ' ', 'g')"))} AS text
  FROM pages)"""

_ANCHORS = r"""hrefs AS (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
anchors AS (
  SELECT page_id, url, unnest(range(len(l))) AS pos, unnest(l) AS href FROM hrefs)"""

_STATUS = "CASE WHEN page_id % 17 = 3 THEN 503 WHEN page_id % 13 = 5 THEN 302 ELSE 200 END"

# Outcome of every derived capture: one row per page.
_OUTCOMES = rf"""captured AS (
  SELECT page_id, crawl_id, url, html, {_STATUS} AS status,
    CASE WHEN page_id % 19 = 7 THEN 'image/png' ELSE 'text/html' END AS type,
    page_id % 23 = 11 AS residual,
    CASE page_id % 4 WHEN 0 THEN crawl_id || '/moved/' || page_id WHEN 1 THEN 'https://elsewhere.example.org/x'
                     WHEN 2 THEN url ELSE CASE WHEN page_id % 8 = 7 THEN crawl_id || '/next?token=1' END END AS target
  FROM p),
outcomes AS (
  SELECT *, CASE WHEN kind = 'download_error' THEN CASE WHEN strlen(html) > 12000 THEN 'DownloadCancelledError' ELSE 'IgnoreRequest' END
            END AS error_type,
    CASE WHEN kind = 'redirect' THEN CASE WHEN target IS NULL THEN 'missing_location'
         WHEN contains(target, 'token=') THEN 'invalid_or_sensitive_url'
         WHEN {_origin('target')} <> crawl_id THEN 'outside_origin' ELSE 'in_scope' END END AS redirect_status,
    CASE WHEN kind = 'redirect' AND {_origin('target')} = crawl_id AND NOT contains(target, 'token=') THEN target END AS redirect_to,
    CASE WHEN kind <> 'download_error' THEN status END AS http_status
  FROM (SELECT *, CASE WHEN strlen(html) > 12000 OR residual THEN 'download_error' WHEN status = 302 THEN 'redirect'
               WHEN status = 503 THEN 'http_error' WHEN type = 'image/png' THEN 'unsupported_content' ELSE 'document' END AS kind
        FROM captured)),
first_outcomes AS (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY page_id) = 1)"""

_BODIES = ", ".join("'" + b.replace("'", "''") + "'" for b in ROBOTS_BODIES)
_LENIENT = "coalesce(robots_delay, 0) <= 60"

_ORIGINS = f"""origins AS (SELECT DISTINCT {_origin('url')} AS crawl_id FROM pages)"""

_ROBOTS = rf"""{_ORIGINS},
robots AS (
  SELECT crawl_id, CASE length(crawl_id) % 10 WHEN 7 THEN 404 WHEN 9 THEN 503 ELSE 200 END AS status,
    CASE WHEN length(crawl_id) % 10 = 5 THEN '{SLOW_BODY}' ELSE [{_BODIES}][length(crawl_id) % 3 + 1] END AS body FROM origins),
lines AS (
  SELECT crawl_id, unnest(range(len(l))) AS seq, unnest(l) AS line FROM (SELECT crawl_id, string_split(body, chr(10)) AS l FROM robots)),
stripped AS (
  SELECT crawl_id, seq, line, trim(split_part(line, '#', 1)) AS content FROM lines),
directives AS (
  SELECT *, CASE WHEN contains(content, ':') THEN lower(trim(split_part(content, ':', 1))) END AS directive,
    url_decode(trim(substr(content, strpos(content, ':') + 1))) AS value FROM stripped),
events AS (
  SELECT crawl_id, seq, directive, value, CASE WHEN line = '' THEN 'blank' WHEN directive = 'user-agent' THEN 'agent'
    WHEN directive IN ('allow', 'disallow', 'crawl-delay', 'request-rate') THEN 'rule' END AS event FROM directives),
opened AS (
  SELECT *, event = 'agent' AND lag(event, 1, 'none') OVER (PARTITION BY crawl_id ORDER BY seq) <> 'agent' AS opens
  FROM events WHERE event IS NOT NULL),
grouped AS (
  SELECT *, cast(sum(cast(opens AS INT)) OVER w AS INT) AS grp,
    last_value(CASE WHEN event <> 'rule' THEN event END IGNORE NULLS) OVER w AS owner
  FROM opened WINDOW w AS (PARTITION BY crawl_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
names AS (
  SELECT crawl_id, grp, list(value ORDER BY seq) AS agents FROM grouped WHERE event = 'agent' GROUP BY ALL),
rules AS (
  SELECT g.crawl_id, grp, seq, agents, directive, value FROM grouped g JOIN names USING (crawl_id, grp)
  WHERE event = 'rule' AND owner = 'agent'),
ranked AS (
  SELECT *, CASE WHEN list_contains(agents, '*') THEN 1000000 + grp
    WHEN len(list_filter(agents, lambda x: contains('pagetab', lower(x)))) > 0 THEN grp END AS rank FROM rules),
effective AS (
  SELECT * FROM ranked WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY crawl_id)),
delays AS (
  SELECT crawl_id, arg_max(cast(value AS BIGINT), seq) AS robots_delay FROM effective
  WHERE directive = 'crawl-delay' GROUP BY 1),
prefixes AS (
  SELECT crawl_id, seq, value AS prefix, directive = 'allow' OR value = '' AS allow FROM effective
  WHERE directive IN ('allow', 'disallow'))"""


def _verdicts(source: str, name: str, prefixes: str = "prefixes") -> str:
    """CTE ``name``: rows of ``source`` (crawl_id, url) with ``allowed``."""
    path = "regexp_replace(u.url, '^https?://[^/?#]*', '')"
    return rf"""{name} AS (
  SELECT u.*, coalesce((SELECT arg_min(r.allow, r.seq) FROM {prefixes} r
                        WHERE r.crawl_id = u.crawl_id AND starts_with({path}, r.prefix)), true) AS allowed FROM {source} u)"""


_FETCHABLE = r"[^A-Za-z0-9\-._~:/?@!$&''()*+,;=%]"


def _request_url(url: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({url}, '(?s).'), "
        rf"lambda ch: CASE WHEN regexp_matches(ch, '{_FETCHABLE}') THEN url_encode(ch) ELSE ch END), '')"
    )


_MENTIONS = rf"""{_PAGES},
{_ANCHORS},
mentions AS (
  SELECT {_origin('url')} AS crawl_id, {_origin('url')} || href AS url, page_id AS parent_seq, pos FROM anchors),
firsts AS (
  SELECT *, count(*) OVER (PARTITION BY crawl_id, url) AS n FROM mentions
  QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY parent_seq, pos) = 1),
capped AS (
  SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY parent_seq, pos) AS seq FROM firsts
  QUALIFY seq <= 3 + length(crawl_id) % 19)"""


def _wave(k: int, with_robots: bool) -> str:
    """CTEs of wave k: candidates w<k> with blocked and processed, from the wave before."""
    if k == 0:
        rows = "SELECT crawl_id, start_url AS url, NULL::VARCHAR AS discovered_from, 0 AS depth, 1 AS seq, 0 AS attempts, page_budget, max_candidates FROM starts"
        chain = f"c0 AS ({rows})"
    else:
        j = k - 1
        seen = " UNION ALL ".join(f"SELECT crawl_id, url FROM w{i}" for i in range(k))
        chain = rf"""s{k} AS (
  SELECT crawl_id, max(seq) AS taken, any_value(attempts) + count_if(processed AND NOT blocked) AS attempts,
    any_value(page_budget) AS page_budget, any_value(max_candidates) AS max_candidates FROM w{j} GROUP BY 1),
m{k} AS (
  SELECT e.crawl_id, e.url, w.request_url AS discovered_from, w.depth + e.deeper AS depth, w.seq AS parent_seq, e.pos
  FROM w{j} w JOIN edges e ON e.crawl_id = w.crawl_id AND e.src_url = w.request_url WHERE w.processed AND NOT w.blocked),
f{k} AS (
  SELECT * FROM m{k} m WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.crawl_id = m.crawl_id AND s.url = m.url)
  QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY parent_seq, pos) = 1),
c{k} AS (
  SELECT f.crawl_id, url, discovered_from, depth, taken + row_number() OVER (PARTITION BY f.crawl_id ORDER BY parent_seq, pos) AS seq,
    attempts, page_budget, max_candidates FROM f{k} f JOIN s{k} s ON s.crawl_id = f.crawl_id
  QUALIFY seq <= max_candidates)"""
    if with_robots:
        chain += ",\n" + _verdicts(f"c{k}", f"v{k}", "loaded_prefixes")
        source, blocked, request = f"v{k}", "NOT allowed", _request_url("url")
    else:
        source, blocked, request = f"c{k}", "false", "url"
    return chain + rf""",
b{k} AS (SELECT *, {blocked} AS blocked, {request} AS request_url FROM {source}),
w{k} AS (
  SELECT *, attempts + coalesce(sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY crawl_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < page_budget AS processed, {k} AS wave FROM b{k})"""


def _frontier(waves: int, with_robots: bool) -> str:
    parts = [_wave(k, with_robots) for k in range(waves)]
    columns = "crawl_id, url, request_url, discovered_from, depth, seq, blocked, processed, wave"
    union = " UNION ALL ".join(f"SELECT {columns} FROM w{k}" for k in range(waves))
    return ",\n".join(parts) + f",\nfrontier AS ({union})"


_CATALOG = r"""pairs AS (
  SELECT DISTINCT 'region-' || n_regionkey AS crawl_id, l_suppkey, l_partkey FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
starts AS (
  SELECT 'region-' || r_regionkey AS crawl_id, 'https://catalog.example.com/region/' || r_regionkey AS start_url,
    1000 AS page_budget, 10000 AS max_candidates FROM region),
edges AS (
  SELECT 'region-' || n_regionkey AS crawl_id, 'https://catalog.example.com/region/' || n_regionkey AS src_url, n_nationkey AS pos,
    'https://catalog.example.com/nation/' || n_nationkey AS url, 1 AS deeper FROM nation
  UNION ALL
  SELECT 'region-' || n_regionkey, 'https://catalog.example.com/nation/' || n_nationkey, s_suppkey,
    'https://catalog.example.com/supplier/' || s_suppkey, 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL
  SELECT crawl_id, 'https://catalog.example.com/supplier/' || l_suppkey, l_partkey, 'https://catalog.example.com/part/' || l_partkey, 1 FROM pairs
  UNION ALL
  SELECT crawl_id, 'https://catalog.example.com/part/' || l_partkey, l_suppkey, 'https://catalog.example.com/supplier/' || l_suppkey, 1 FROM pairs)"""

_SITE_LINKS = rf"""site_gates AS (
  SELECT crawl_id, CASE WHEN (is_wide) THEN 1000 ELSE 4 + length(crawl_id) % 17 END AS max_pages,
    CASE WHEN (is_wide) THEN 2000 ELSE 6 + length(crawl_id) % 13 END AS max_requests,
    CASE WHEN (is_wide) THEN 10000 ELSE 5 + length(crawl_id) % 29 * 2 END AS max_candidates, status AS robots_http_status,
    CASE status WHEN 404 THEN 'missing_404' WHEN 200 THEN 'loaded' ELSE 'unavailable' END AS robots_status,
    CASE WHEN status = 200 THEN robots_delay END AS robots_delay
  FROM robots LEFT JOIN delays USING (crawl_id)),
loaded_prefixes AS (SELECT * FROM prefixes JOIN (SELECT crawl_id FROM site_gates WHERE robots_status = 'loaded') USING (crawl_id)),
starts AS (
  SELECT crawl_id, crawl_id || '/' AS start_url, least(max_pages, max_requests - 1) AS page_budget, max_candidates
  FROM site_gates WHERE robots_status <> 'unavailable' AND {_LENIENT}),
site_outcomes AS (
  SELECT crawl_id, {_request_url('url')} AS url, page_id, kind, http_status,
    CASE WHEN error_type = 'DownloadCancelledError' AND page_id % 7 = 2 AND page_id % 23 <> 11 AND strlen(html) <= 24000 THEN 'IgnoreRequest' ELSE error_type END AS error_type,
    redirect_status, redirect_to FROM first_outcomes
  WHERE url <> crawl_id || '/'
  UNION ALL SELECT crawl_id, crawl_id || '/', -1, 'document', 200, NULL, NULL, NULL FROM origins),
site_links AS (
  SELECT o.crawl_id, o.url AS src_url, a.pos, o.crawl_id || a.href AS url
  FROM anchors a JOIN site_outcomes o ON o.page_id = a.page_id WHERE o.kind = 'document'
  UNION ALL SELECT crawl_id, crawl_id || '/', page_id, url FROM p),
edges AS (
  SELECT *, 1 AS deeper FROM site_links
  UNION ALL SELECT crawl_id, url, 0, redirect_to, 0 FROM site_outcomes WHERE redirect_to IS NOT NULL)"""

_RECORDS = rf"""requested AS (
  SELECT f.crawl_id, f.seq, coalesce(o.kind, 'download_error') AS kind, f.request_url AS url, f.discovered_from, f.depth,
    o.http_status, o.page_id, o.redirect_status, o.redirect_to,
    CASE WHEN o.kind IS NULL THEN 'NotCaptured' ELSE o.error_type END AS error_type
  FROM frontier f LEFT JOIN site_outcomes o ON o.crawl_id = f.crawl_id AND o.url = f.request_url
  WHERE f.processed AND NOT f.blocked),
worded AS (
  SELECT r.*, CASE WHEN kind = 'document' THEN CASE WHEN r.page_id = -1 THEN 'Site index' ELSE t.title END END AS title,
    CASE WHEN kind = 'document' THEN CASE WHEN r.page_id = -1 THEN 'Captured pages of ' || crawl_id ELSE t.text END END AS full_text
  FROM requested r LEFT JOIN texts t ON t.page_id = r.page_id),
records AS (
  SELECT crawl_id, seq, kind, url, CASE WHEN kind <> 'download_error' THEN discovered_from END AS discovered_from,
    CASE WHEN kind <> 'download_error' THEN depth END AS depth, http_status, title, title = '' AS title_missing,
    left(full_text, 600) AS text, length(full_text) > 600 AS text_truncated, sha256(full_text) AS content_sha256,
    redirect_status, redirect_to, error_type, CASE WHEN kind = 'download_error' THEN 'document' END AS phase, page_id
  FROM worded
  UNION ALL
  SELECT crawl_id, seq, 'blocked_robots', url, discovered_from, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM frontier WHERE processed AND blocked
  UNION ALL
  SELECT crawl_id, 0, 'robots_error', crawl_id || '/robots.txt', NULL, NULL, robots_http_status, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM site_gates WHERE robots_status = 'unavailable')"""

_EXCLUSIONS = r"""site_mentions AS (
  SELECT e.crawl_id, e.url FROM frontier f JOIN edges e ON e.crawl_id = f.crawl_id AND e.src_url = f.request_url
  WHERE f.processed AND NOT f.blocked),
exclusions AS (
  SELECT crawl_id, reason, cast(sum(n) AS BIGINT) AS n FROM (
    SELECT m.crawl_id, CASE WHEN f.url IS NULL THEN 'max_candidates' ELSE 'duplicate_url' END AS reason,
      m.n - CASE WHEN f.wave > 0 THEN 1 ELSE 0 END AS n
    FROM (SELECT crawl_id, url, count(*) AS n FROM site_mentions GROUP BY ALL) m LEFT JOIN frontier f USING (crawl_id, url))
  GROUP BY ALL HAVING sum(n) > 0
  UNION ALL SELECT crawl_id, 'outside_origin', count(*) FROM p JOIN starts USING (crawl_id) WHERE page_id % 3 = 0 GROUP BY ALL
  UNION ALL SELECT crawl_id, 'invalid_or_sensitive_url', count(*) FROM p JOIN starts USING (crawl_id) WHERE page_id % 5 = 0 GROUP BY ALL)"""

_STATES = r"""states AS (
  SELECT *, CASE WHEN documents = 0 THEN 'failed' WHEN stop_reason <> 'frontier_exhausted' OR problems > 0 THEN 'partial'
            ELSE 'complete_within_scope' END AS status
  FROM (SELECT *, CASE WHEN robots_status = 'unavailable' THEN 'robots_unavailable'
          WHEN robots_delay > 60 THEN 'robots_delay_exceeds_limit'
          WHEN remaining > 0 AND attempts + 1 >= max_requests THEN 'max_requests' WHEN remaining > 0 THEN 'max_pages'
          WHEN capped THEN 'max_candidates' ELSE 'frontier_exhausted' END AS stop_reason
        FROM (SELECT g.*, cast(coalesce(q.attempts, 0) AS BIGINT) AS attempts, cast(coalesce(q.remaining, 0) AS BIGINT) AS remaining,
                coalesce(r.documents, 0) AS documents, coalesce(r.problems, 0) AS problems, x.n IS NOT NULL AS capped
              FROM site_gates g
              LEFT JOIN (SELECT crawl_id, count_if(processed AND NOT blocked) AS attempts, count_if(NOT processed) AS remaining
                         FROM frontier GROUP BY 1) q USING (crawl_id)
              LEFT JOIN (SELECT crawl_id, count_if(kind = 'document') AS documents,
                           count_if(kind NOT IN ('document', 'redirect') OR coalesce(redirect_status <> 'in_scope', false)) AS problems
                         FROM records GROUP BY 1) r USING (crawl_id)
              LEFT JOIN (SELECT * FROM exclusions WHERE reason = 'max_candidates') x USING (crawl_id))))"""



def _site(wide: str) -> str:
    """The whole run; ``wide`` tells which origins have the widest budgets."""
    links = _SITE_LINKS.replace("is_wide", wide)
    return _ctes(_PAGES, _ANCHORS, _OUTCOMES, _ROBOTS, _TEXTS, links, _frontier(4, True), _RECORDS, _EXCLUSIONS, _STATES)


_SITE, _TIGHT = _site("true"), _site("length(crawl_id) % 2 = 0")


def _guard(cell: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({cell}, ''), '^[ \\t\\r\\n\\x{{feff}}]*[=+@\\-]') THEN '''' ELSE '' END || coalesce({cell}, '')"


def _count_json(table: str, key: str) -> str:
    return (
        f"coalesce((SELECT '{{' || string_agg('\"' || {key} || '\":' || n, ',' ORDER BY {key}) || '}}' FROM {table} k "
        f"WHERE k.crawl_id = s.crawl_id), '{{}}')"
    )




def _iso(page: str) -> str:
    return f"strftime(to_timestamp(1704067200 + greatest({page}, 0)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"


_SUMMARY = f"""kinds AS (SELECT crawl_id, kind, count(*) AS n FROM records GROUP BY ALL),
times AS (SELECT crawl_id, {_iso('min(page_id)')} AS started_at, {_iso('max(page_id)')} AS finished_at
  FROM records WHERE kind IN ('document', 'redirect', 'http_error', 'unsupported_content') GROUP BY 1),
summary AS (
  SELECT s.*, started_at, finished_at, {_count_json('kinds', 'kind')} AS kinds_json, {_count_json('exclusions', 'reason')} AS reasons_json
  FROM states s LEFT JOIN times USING (crawl_id))"""

_POLICY_ROWS = r"""faulty AS (
  SELECT cast(c_custkey AS VARCHAR) AS crawl_id, n, host, balance,
    'https://' || host || CASE WHEN n = 4 THEN ':8443' ELSE '' END || '/start' AS start_url,
    'https://' || host || CASE n WHEN 5 THEN '/path' WHEN 6 THEN '#x' WHEN 7 THEN ':wrong' ELSE '' END AS allowed_origin,
    coalesce(CASE WHEN balance >= 0 THEN cast(floor(balance / 8) AS INT) END, 20) AS max_pages,
    coalesce(CASE WHEN balance >= 1000 THEN cast(floor(balance / 4) AS INT) END, 25) AS max_requests,
    cast(floor(balance) AS INT) + 500 AS max_candidates,
    coalesce(CASE WHEN n > 10 THEN cast(floor(balance) AS INT) * 1100 END, 2000000) AS max_body_bytes,
    coalesce(CASE WHEN n > 12 THEN cast(floor(balance) AS INT) * 11 END, 5000) AS max_text_chars,
    coalesce(CASE WHEN n > 20 THEN floor(balance / 100) END, 0.5::DOUBLE) AS delay,
    coalesce(CASE WHEN n > 22 THEN floor(balance / 150) END, 10.0::DOUBLE) AS timeout,
    starts_with(c_mktsegment, 'A') AS allow_loopback
  FROM (SELECT *, c_nationkey AS n, c_acctbal AS balance, CASE c_nationkey WHEN 0 THEN 'localhost' WHEN 1 THEN '127.0.0.1'
          WHEN 2 THEN '10.0.0.1' WHEN 3 THEN '8.8.8.8' ELSE 'n' || c_nationkey || '.example.com' END AS host FROM customer))"""

_LIMITS = "max_pages, max_requests, max_candidates, max_body_bytes, max_text_chars, delay, timeout, allow_loopback"


def _network_test(number: str) -> str:
    tests = []
    for network in NOT_GLOBAL_V4:
        base, bits = network.split("/")
        a, b, c, e = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + e
        tests.append(f"{number} BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}")
    return "(" + " OR ".join(tests) + ")"


def _errors() -> str:
    checks = [
        ("n = 7", "invalid_allowed_origin"),
        ("n IN (5, 6)", "allow_origin_must_not_include_path_query_or_fragment"),
        ("n = 4", "start_outside_allowed_origin"),
        ("max_pages NOT BETWEEN 1 AND 1000", "invalid_max_pages"),
        ("max_requests NOT BETWEEN 1 AND 2000", "invalid_max_requests"),
        ("max_candidates NOT BETWEEN 1 AND 10000", "invalid_max_candidates"),
        ("max_body_bytes NOT BETWEEN 1 AND 10000000", "invalid_max_body_bytes"),
        ("max_text_chars NOT BETWEEN 1 AND 100000", "invalid_max_text_chars"),
        ("delay NOT BETWEEN 0 AND 60", "invalid_delay"),
        ("timeout <= 0 OR timeout > 60", "invalid_timeout"),
        ("n = 0 AND NOT allow_loopback", "loopback_requires_explicit_flag"),
        ("n = 2 OR (n = 1 AND NOT allow_loopback)", "non_public_ip_literal"),
    ]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{e}' END" for c, e in checks) + ")"


_LEDGER = r"""ledger AS (
  SELECT event_id AS request_id, cast(user_id AS VARCHAR) AS crawl_id, event_type, value, epoch_us(ts) AS micros,
    CASE WHEN event_type = 'click' AND value < 5 THEN 'https://other.example.com/' ELSE 'https://site.example.com/' END
      || event_type || '/' || event_id || CASE WHEN event_type = 'view' AND value < 3 THEN '?token=x' ELSE '' END AS url
  FROM events)"""


_STARTS_V6 = ", ".join(f"[{a}, {b}]" for a, b in V6_STARTS)

_V6 = rf"""WITH q AS (
  SELECT o_orderkey, o_orderkey // 7 % 5 AS form, [{_STARTS_V6}][o_orderkey % {len(V6_STARTS)} + 1] AS g,
    o_orderkey // 16 % 3 AS low, o_orderkey // 48 % 2 AS high, o_orderkey % 256 AS a,
    ((o_orderkey % 256 * 256 + (o_orderkey * 7) % 256) * 256 + (o_orderkey * 13 + 5) % 256) * 256 + (o_orderkey * 3) % 256 AS n
  FROM orders)"""

# The groups between the first two and the last two are zeros.
_V6_CLASS = r"""CASE
  WHEN g[1] = 0 AND high = 0 THEN CASE low WHEN 0 THEN 'not_global' WHEN 1 THEN 'loopback' ELSE 'global' END
  WHEN g[1] = 256 AND g[2] = 0 THEN 'not_global'
  WHEN g[1] = 8193 AND (g[2] = 3 OR g[2] BETWEEN 32 AND 63 OR (g[2] = 1 AND high = 0 AND low IN (1, 2))) THEN 'global'
  WHEN g[1] = 8193 AND (g[2] < 512 OR g[2] = 3512) THEN 'not_global'
  WHEN g[1] = 8194 OR g[1] BETWEEN 64512 AND 65023 OR g[1] BETWEEN 65152 AND 65215 THEN 'not_global'
  ELSE 'global' END"""


def build() -> dict[str, str]:
    admitted_url, admitted_reason = _admitted("n.normal", "o.allowed")
    forms_with_normal = _ctes(_URL_FORMS, _normal("url_forms", "n"))
    resolved = r"""link_forms AS (
  SELECT page_id, pos, url AS page_url, crawl_id, folder, unnest([
    {'form': 'as_is', 'raw': crawl_id || href},
    {'form': 'relative', 'raw': crawl_id || folder || rel},
    {'form': 'up', 'raw': crawl_id || regexp_replace(folder, '[^/]+/$', '') || rel},
    {'form': 'here', 'raw': crawl_id || folder || rel},
    {'form': 'query', 'raw': crawl_id || path || '?q=' || rel},
    {'form': 'fragment', 'raw': regexp_replace(url, '#.*', '')},
    {'form': 'other_host', 'raw': regexp_extract(url, '^https?:') || '//other.example.org' || href},
    {'form': 'script', 'raw': 'javascript:' || href},
    {'form': 'padded', 'raw': crawl_id || href},
    {'form': 'empty', 'raw': url}], recursive := true)
  FROM (SELECT *, regexp_extract(path, '^.*/') AS folder, substr(href, 2) AS rel FROM (
    SELECT *, nullif(regexp_extract(url, '^https?://[^/?#]*'), '') AS crawl_id,
      regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM anchors)))"""
    link_url, link_reason = _admitted("normal", "crawl_id")
    sql = {
        "normalize_url": f"{forms_with_normal} SELECT page_id, form, normal FROM n",
        "origin_counts": f"{forms_with_normal} SELECT {_origin('normal')} AS origin, count(*) AS urls, "
                         "count(DISTINCT page_id) AS pages FROM n WHERE normal IS NOT NULL GROUP BY 1",
        "admit_reason": f"{forms_with_normal}, o AS (SELECT page_id, {_origin('url')} AS allowed FROM pages) "
                        f"SELECT n.page_id, n.form, {admitted_url} AS url, {admitted_reason} AS reason FROM n JOIN o ON n.page_id = o.page_id",
        "sensitive_query": f"{_ctes(_URL_FORMS)} SELECT page_id, form, {_sensitive(chr(39).join(['regexp_extract(raw, ', '^[^?#]*[?]([^#]*)', ', 1)']))} "
                           "AS sensitive FROM url_forms",
        "policy_defaults": f"{_ctes(_POLICY_ROWS)} SELECT crawl_id, {_LIMITS} FROM faulty",
        "policy_errors": f"{_ctes(_POLICY_ROWS)} SELECT crawl_id, {_errors()} AS errors FROM faulty",
        "rejected_policies": f"{_ctes(_POLICY_ROWS)} SELECT crawl_id, cast(length(errors) - length(replace(errors, ',', '')) + 1 AS INT) AS n_errors, errors "
                             f"FROM (SELECT crawl_id, {_errors()} AS errors FROM faulty) WHERE errors <> ''",
        "chain_depth": "WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, lag(c_custkey) OVER w AS before, row_number() OVER w AS r FROM customer "
                       "WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)) SELECT 'nation-' || n AS crawl_id, "
                       "'https://catalog.example.com/customer/' || k AS url, 'https://catalog.example.com/customer/' || before AS discovered_from, "
                       "cast(r - 1 AS INT) AS depth, r AS seq, r <= 1000 AS processed FROM c WHERE r <= 1001",
        "host_literal": "WITH q AS (SELECT o_orderkey, o_orderkey % 256 AS a, ((o_orderkey % 256 * 256 + (o_orderkey * 7) % 256) * 256 "
                        "+ (o_orderkey * 13 + 5) % 256) * 256 + (o_orderkey * 3) % 256 AS n FROM orders) "
                        f"SELECT o_orderkey, CASE WHEN a = 127 THEN 'loopback' WHEN {_network_test('n')} AND n NOT IN (3221225481, 3221225482) "
                        "THEN 'not_global' ELSE 'global' END AS host_class FROM q",
        "ipv6_literal": f"{_V6} SELECT o_orderkey, cast(form AS INT) AS form, CASE form WHEN 4 THEN 'name' WHEN 3 THEN CASE WHEN a = 127 THEN 'loopback' "
                        f"WHEN {_network_test('n')} AND n NOT IN (3221225481, 3221225482) AND NOT n BETWEEN 1681915904 AND 1686110207 THEN 'not_global' "
                        f"ELSE 'global' END ELSE {_V6_CLASS} END AS host_class FROM q",
        "rejected_pages": f"{forms_with_normal} SELECT page_id, form, raw AS url, 'invalid_or_sensitive_url' AS reason FROM (SELECT u.page_id, u.form, u.raw, n.normal "
                          "FROM url_forms u JOIN n ON n.page_id = u.page_id AND n.form = u.form) WHERE normal IS NULL "
                          "UNION ALL SELECT page_id, 'absent', NULL, 'no_url' FROM pages",
        "outputs_written": f"{_SITE} SELECT 'documents' AS output, count(*) AS n_rows, cast(sum(length(url)) AS BIGINT) AS chars, true AS second_refused "
                           "FROM records WHERE kind = 'document' UNION ALL SELECT 'records', count(*), cast(sum(length(url)) AS BIGINT), true FROM records "
                           "UNION ALL SELECT 'reports', count(*), cast(sum(length(crawl_id)) AS BIGINT), true FROM states",
        "part_reconcile": "WITH listed AS (SELECT 'part-' || p_partkey AS key, p_size AS bytes, p_name AS name FROM part), "
                          "held AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS bytes, "
                          "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name FROM part "
                          "WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)), "
                          "present AS (SELECT 'part-' || p_partkey AS key, bytes, name FROM held UNION ALL SELECT 'part-' || p_partkey, bytes, name FROM held "
                          "WHERE p_partkey % 13 = 0 UNION ALL SELECT 'part-s' || s_suppkey, 1, s_name FROM supplier), "
                          "l AS (SELECT key, count(*) AS n, min(bytes) AS bytes, min(name) AS name FROM listed GROUP BY 1), "
                          "q AS (SELECT key, count(*) AS n, min(bytes) AS bytes, min(name) AS name FROM present GROUP BY 1) "
                          "SELECT coalesce(l.key, q.key) AS key, coalesce(l.n, 0) AS n_listed, coalesce(q.n, 0) AS n_present, "
                          "CASE WHEN q.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' WHEN l.n > 1 OR q.n > 1 THEN 'duplicate' "
                          "WHEN l.bytes <> q.bytes OR l.name <> q.name THEN 'mismatch' ELSE 'match' END AS status FROM l FULL JOIN q ON l.key = q.key",
        "clean_text": "SELECT doc_id, " + _clean("'  ' || replace(text, ' ', '  ' || chr(9)) || chr(12288) || chr(10)") + " AS text FROM documents",
        "page_title": f"{_ctes(_TEXTS)} SELECT page_id, title, title = '' AS title_missing FROM texts",
        "page_text": f"{_ctes(_TEXTS)} SELECT page_id, url, text FROM texts",
        "content_sha256": f"{_ctes(_TEXTS)} SELECT page_id, sha256(text) AS content_sha256 FROM texts",
        "text_truncated": "SELECT doc_id, left(text, 5000) AS text, length(text) > 5000 AS text_truncated FROM documents",
        "csv_guard": "WITH l AS (SELECT ['', '=', ' +', chr(9) || '@', '-', chr(65279) || '=', 'x='] AS leads), f AS (SELECT doc_id, text, "
                     "unnest(range(7)) AS form, unnest(leads) AS lead FROM documents, l) "
                     f"SELECT doc_id, cast(form AS INT) AS form, {_guard('(lead || text)')} AS cell FROM f",
        "links": f"{_ctes(_ANCHORS)} SELECT page_id, cast(pos AS INT) AS pos, href FROM anchors",
        "links_resolved": f"{_ctes(_ANCHORS, resolved, _normal('link_forms', 'n'))} "
                          f"SELECT page_id, cast(pos AS INT) AS pos, form, {link_url} AS url, {link_reason} AS reason FROM n",
        "links_uncaptured": f"{_ctes(_MENTIONS)} SELECT DISTINCT crawl_id, url FROM mentions m "
                            "WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.crawl_id = m.crawl_id AND p.url = m.url)",
        "decode_bodies": "SELECT page_id, CASE WHEN page_id % 9 <> 7 THEN sha256(html) END AS body_sha256, "
                         "CASE page_id % 9 WHEN 6 THEN 'unknown' WHEN 7 THEN 'gzip' END AS residual_encoding, "
                         "CASE WHEN page_id % 9 = 7 THEN 'BadGzipFile' END AS decode_error, page_id % 9 = 8 AS decode_truncated FROM pages",
        "residual_encoding": "SELECT page_id AS capture_id, page_id % 23 = 11 AS rejected FROM pages",
        "body_limit": "SELECT page_id AS capture_id, strlen(html) AS body_bytes, strlen(html) > 3000 AS too_large FROM pages",
        "classify_response": f"{_ctes(_PAGES, _OUTCOMES)} SELECT crawl_id, url, page_id AS capture_id, kind, http_status, error_type FROM first_outcomes",
        "redirects": f"{_ctes(_PAGES, _OUTCOMES)} SELECT page_id AS capture_id, url, redirect_status, redirect_to FROM outcomes WHERE kind = 'redirect'",
        "robots_rules": f"{_ctes(_ROBOTS)} SELECT crawl_id, grp, cast(seq AS INT) AS seq, array_to_string(agents, ',') AS agents, directive, value FROM rules",
        "robots_gate": f"{_ctes(_ROBOTS)} SELECT crawl_id, CASE status WHEN 404 THEN 'missing_404' WHEN 200 THEN 'loaded' ELSE 'unavailable' END "
                       "AS robots_status, status AS robots_http_status, NULL::VARCHAR AS robots_error FROM robots",
        "robots_delay": f"{_ctes(_ROBOTS)} SELECT crawl_id, robots_delay, CASE WHEN coalesce(robots_delay, 0) <= 60 "
                        "THEN greatest(0.5::DOUBLE, coalesce(robots_delay, 0)::DOUBLE) END AS effective_delay FROM robots LEFT JOIN delays USING (crawl_id)",
        "robots_blocked": f"{_ctes(_PAGES, _ROBOTS, 'u AS (SELECT DISTINCT crawl_id, url FROM p)', _verdicts('u', 'v'))} SELECT crawl_id, url, allowed FROM v",
        "first_seen": f"{_ctes(_MENTIONS)} SELECT crawl_id, url, parent_seq, pos, n AS mentions FROM firsts",
        "candidate_cap": f"{_ctes(_MENTIONS)} SELECT crawl_id, url, seq FROM capped",
        "page_budget": f"{_ctes(_MENTIONS, _ROBOTS, _verdicts('capped', 'v'))} SELECT crawl_id, url, seq, NOT allowed AS blocked, "
                       "coalesce(sum(CASE WHEN allowed THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING "
                       "AND 1 PRECEDING), 0) < least(20, 4 + length(crawl_id) % 7) AS processed FROM v",
        "frontier_depth": f"{_ctes(_CATALOG, _frontier(6, False))} SELECT crawl_id, url, discovered_from, depth, seq, processed FROM frontier",
        "crawl_records": f"{_SITE} SELECT * EXCLUDE (page_id), CASE WHEN kind IN ('document', 'redirect', 'http_error', 'unsupported_content') "
                         f"THEN {_iso('page_id')} END AS fetched_at FROM records",
        "documents_export": f"{_SITE} SELECT {_guard('url')} AS url, {_guard('title')} AS title, {_guard('text')} AS text, content_sha256, "
                            "strftime(to_timestamp(1704067200 + greatest(page_id, 0)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS fetched_at, "
                            "cast(http_status AS VARCHAR) AS http_status, coalesce(discovered_from, '') AS discovered_from, cast(depth AS VARCHAR) AS depth, "
                            "CASE WHEN text_truncated THEN 'True' ELSE 'False' END AS text_truncated, "
                            "CASE WHEN title_missing THEN 'True' ELSE 'False' END AS title_missing FROM records WHERE kind = 'document'",
        "record_counts": f"{_SITE} SELECT crawl_id, kind, count(*) AS n FROM records GROUP BY ALL",
        "link_exclusions": f"{_TIGHT} SELECT crawl_id, reason, n FROM exclusions",
        "run_status": f"{_TIGHT} SELECT crawl_id, stop_reason, status FROM states",
        "run_summary": f"{_SITE}, {_SUMMARY} SELECT crawl_id, 1 AS schema_version, 'pagetab' AS tool, status, stop_reason, robots_status, "
                       "robots_delay AS robots_crawl_delay, attempts + 1 AS http_attempts, attempts AS document_attempts, "
                       "remaining AS remaining_candidates, kinds_json AS record_counts, reasons_json AS excluded_link_counts, started_at, finished_at FROM summary",
        "report_json": f"{_SITE}, {_SUMMARY} SELECT crawl_id, '{{\"schema_version\":1,\"tool\":\"pagetab\",\"status\":\"' || status || '\",\"stop_reason\":\"' "
                       "|| stop_reason || '\",\"policy\":{\"start_url\":\"' || crawl_id || '/\",\"allowed_origin\":\"' || crawl_id || '\",\"max_pages\":' "
                       "|| max_pages || ',\"max_requests\":' || max_requests || ',\"max_candidates\":' || max_candidates || ',\"max_body_bytes\":12000,"
                       "\"max_text_chars\":600,\"delay\":0.5,\"timeout\":10.0,\"allow_loopback\":false},\"robots_status\":\"' || robots_status || '\"' "
                       "|| coalesce(',\"robots_crawl_delay\":' || robots_delay, '') || ',\"http_attempts\":' || (attempts + 1) || ',\"document_attempts\":' "
                       "|| attempts || ',\"remaining_candidates\":' || remaining || ',\"record_counts\":' || kinds_json || ',\"excluded_link_counts\":' "
                       "|| reasons_json || coalesce(',\"started_at\":\"' || started_at || '\",\"finished_at\":\"' || finished_at || '\"', '') || '}' AS report FROM summary",
        "manifest_reconcile": "WITH listed AS (SELECT 'customer-' || c_custkey AS key, c_nationkey AS bytes FROM customer), "
                              "present AS (SELECT 'customer-' || o_custkey AS key, CASE WHEN starts_with(o_orderpriority, '1') THEN 0 ELSE c_nationkey END AS bytes "
                              "FROM orders JOIN customer ON c_custkey = o_custkey "
                              "UNION ALL SELECT 'supplier-' || s_suppkey, s_nationkey FROM supplier), "
                              "l AS (SELECT key, count(*) AS n, min(bytes) AS bytes FROM listed GROUP BY 1), "
                              "q AS (SELECT key, count(*) AS n, min(bytes) AS bytes FROM present GROUP BY 1) "
                              "SELECT coalesce(l.key, q.key) AS key, coalesce(l.n, 0) AS n_listed, coalesce(q.n, 0) AS n_present, "
                              "CASE WHEN q.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' WHEN l.n > 1 OR q.n > 1 THEN 'duplicate' "
                              "WHEN l.bytes <> q.bytes THEN 'mismatch' ELSE 'match' END AS status FROM l FULL JOIN q ON l.key = q.key",
        "expectation_check": f"{_SITE}, e AS (SELECT crawl_id, count(*) AS urls, count_if(kind = 'document') AS documents FROM site_outcomes GROUP BY 1) "
                             "SELECT s.crawl_id AS name, concat_ws('; ', CASE WHEN s.status <> 'partial' THEN 'exit mismatch' END, "
                             "CASE WHEN s.status <> 'partial' THEN 'status mismatch' END, CASE WHEN s.attempts + 1 <> e.urls + 1 THEN 'requests mismatch' END, "
                             "CASE WHEN s.documents <> e.documents THEN 'documents mismatch' END, "
                             "CASE WHEN s.stop_reason <> 'max_requests' THEN 'stop_reason mismatch' END) AS errors, "
                             "errors = '' AS passed FROM e JOIN states s ON s.crawl_id = e.crawl_id",
        "scope_violations": f"{_ctes(_LEDGER)} SELECT request_id, crawl_id, url, violation FROM (SELECT *, CASE WHEN ends_with(crawl_id, '7') THEN 'no_policy' "
                            "WHEN contains(url, 'token=x') THEN 'invalid_or_sensitive_url' WHEN contains(url, '//other.') THEN 'outside_origin' "
                            "WHEN event_type = 'error' AND value > 60 THEN 'method' WHEN value > 90 THEN 'cookie' "
                            "WHEN event_type = 'signup' AND value > 80 THEN 'authorization' END AS violation FROM ledger) WHERE violation IS NOT NULL",
        "request_gaps": f"{_ctes(_LEDGER)} SELECT request_id, crawl_id, gap_micros FROM (SELECT *, micros - lag(micros) OVER "
                        "(PARTITION BY crawl_id ORDER BY micros, request_id) AS gap_micros FROM ledger) WHERE gap_micros < 1800000000",
        "ledger_reconcile": f"{_SITE}, asked AS (SELECT crawl_id, url FROM records WHERE kind NOT IN ('blocked_robots', 'robots_error') "
                            "UNION ALL SELECT crawl_id, url FROM records WHERE kind = 'http_error' "
                            "UNION ALL SELECT crawl_id, crawl_id || '/robots.txt' FROM site_gates), "
                            "logged AS (SELECT crawl_id, url, count(*) AS n FROM asked GROUP BY ALL), "
                            "totals AS (SELECT crawl_id, cast(sum(n) AS BIGINT) AS logged, cast(count_if(n > 1) AS BIGINT) AS repeated_urls, cast(count_if(EXISTS (SELECT 1 FROM records b "
                            "WHERE b.kind = 'blocked_robots' AND b.crawl_id = logged.crawl_id AND b.url = logged.url)) AS BIGINT) AS blocked_requested FROM logged GROUP BY 1) "
                            "SELECT s.crawl_id, s.attempts + 1 AS http_attempts, t.logged, t.repeated_urls, t.blocked_requested, "
                            "s.attempts + 1 = t.logged AND t.repeated_urls = 0 AND t.blocked_requested = 0 AS consistent "
                            "FROM states s JOIN totals t ON t.crawl_id = s.crawl_id",
    }
    counts = ", ".join(f"count_if(status = '{s}') AS {s}" for s in ("missing", "extra", "duplicate", "mismatch", "match"))
    for name, found in (("manifest", sql["manifest_reconcile"]), ("part", sql["part_reconcile"])):
        sql[f"{name}_all_match"] = f"SELECT coalesce(bool_and(status = 'match'), true) AS all_match, {counts} FROM ({found})"
        sql[f"{name}_missing"] = f"SELECT key FROM ({found}) WHERE status = 'missing'"
    sql["expectations_passed"] = f"SELECT coalesce(bool_and(passed), true) AS all_passed FROM ({sql['expectation_check']})"
    return sql
