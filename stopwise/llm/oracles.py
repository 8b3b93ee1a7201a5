"""SQL for the operators that SQL can express, for comparison on small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from stopwise.llm import mixing, urls, warc


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def component(nodes: str, node: str, links: str) -> str:
    """Tail of a recursive query: ``reach`` holds (a, b) for every b reachable from a."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(a, b) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
component AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams FROM words),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{component("sets", "doc_id", "links")}
SELECT doc_id, len(grams) AS n_shingles, root AS component_id FROM sets JOIN component ON node = doc_id"""

EMBEDDINGS = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
{component("embeddings", "vec_id", "links")},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN component ON node = vec_id LEFT JOIN degree ON degree.a = vec_id"""


def _host(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}')"


def _path(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _alias(url: str) -> str:
    kept = f"array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^{urls.TRACKING}(=|$)')), '&')"
    return f"CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END END"


def url_filter(rules: Sequence[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"({text(h)}, {text(p)}, {text(a)})" for h, p, a in rules)
    targets = " UNION ALL ".join(
        f"SELECT url, replace(regexp_extract(html, {text(pattern)}, 1), '&amp;', '&') AS target FROM pages" for pattern in (*urls.CANONICAL, urls.REFRESH)
    )
    site = f"regexp_extract(url, '^(.*?)://', 1) || '://' || {_host('url')}"
    return f"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (VALUES {listed}),
declared AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || target
    WHEN starts_with(target, '/') THEN {site} || target
    ELSE {site} || CASE WHEN regexp_extract({_path('url')}, '^(?:.*/)?') = '' THEN '/' ELSE regexp_extract({_path('url')}, '^(?:.*/)?') END || target END AS target
  FROM ({targets}) t WHERE target <> ''),
seen AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM declared) u),
parts AS (SELECT url, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path FROM seen),
named AS (SELECT url, host, path, {_alias('url')} AS alias FROM parts),
links AS (SELECT DISTINCT x.alias AS a, y.alias AS b FROM declared d JOIN named x ON x.url = d.url JOIN named y ON y.url = d.target WHERE x.alias <> y.alias),
aliases AS (SELECT DISTINCT alias FROM named WHERE alias IS NOT NULL),
{component("aliases", "alias", "links")},
fits AS (
  SELECT url, rule_host || rule_path AS rule, action FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC, action, rule_host || rule_path) = 1),
judged AS (
  SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule, f.action, c.root
  FROM pages p LEFT JOIN named n ON n.url = p.url LEFT JOIN fits f ON f.url = p.url LEFT JOIN component c ON c.node = n.alias),
spread AS (SELECT root, min(action) AS action FROM judged WHERE action IS NOT NULL AND root IS NOT NULL GROUP BY root)
SELECT page_id, host, path, rule, coalesce(j.action, s.action, 'allow') AS verdict FROM judged j LEFT JOIN spread s ON s.root = j.root"""


def _base32(hexes: str) -> str:
    value = lambda group: f"CAST('0x' || substr({hexes}, {5 * group + 1}, 5) AS INTEGER)"
    return " || ".join(f"substr('{warc.BASE32}', (({value(g)} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


_QUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
WARC = f"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
digested AS (SELECT page_id, url, strlen(html) AS n, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM raw)
SELECT page_id, n AS payload_bytes, {_base32('digest')} AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
  replace(replace(array_to_string(list_reverse(string_split({_host('url')}, '.')), ',') || ')' || {_path('url')} || {_QUERY}, chr(13), '%0D'), chr(10), '%0A') AS url_key,
  strftime(TIMESTAMP '{warc.FIRST_CAPTURE}' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM digested"""


def _filled(source: str, family: str, order: str) -> str:
    """One level of water filling over rows with supply, weight and budget."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""
  SELECT *, CASE WHEN level IS NULL THEN supply ELSE least(supply, level * weight) END AS got FROM (
    SELECT *, max(CASE WHEN here <= supply / weight THEN here END) OVER ({part}) AS level FROM (
      SELECT *, (budget - coalesce(before, 0)) / after AS here FROM (
        SELECT *, sum(supply) OVER ({part} ORDER BY supply / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
          sum(weight) OVER ({part} ORDER BY supply / weight, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM {source}) x) y) z"""


def _weight(column: str, weights: Mapping[str, float] | None) -> str:
    cases = " ".join(f"WHEN {column} = {text(v)} THEN CAST({w} AS DOUBLE)" for v, w in (weights or {}).items())
    return f"CASE {cases} ELSE CAST(1 AS DOUBLE) END" if cases else "CAST(1 AS DOUBLE)"


def mix(share: float, weights: Mapping[str, Mapping[str, float]], epochs: int, seed: int, domains: Sequence[str]) -> str:
    number = "coalesce(TRY_CAST(regexp_extract(source, '(\\d{1,9})$', 1) AS INTEGER), 0)"
    domain = f"[{', '.join(map(text, domains))}][{number} % {len(domains)} + 1]"
    place = lambda epoch: f"CAST('0x' || substr(md5('{seed}:' || CAST({epoch} AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, {domain} AS domain, coalesce(lang, chr(0)) AS lang_key, coalesce(source, chr(0)) AS source_key,
    len(regexp_extract_all(coalesce(text, ''), '{mixing.TOKEN}')) AS n FROM documents),
leaves AS (SELECT domain, lang_key, source_key, sum(n) AS tokens FROM docs GROUP BY 1, 2, 3),
total AS (SELECT sum(tokens) * CAST({share} AS DOUBLE) AS budget FROM leaves),
low AS (SELECT *, CAST(tokens AS DOUBLE) * {epochs} AS supply, {_weight('source_key', weights.get('source'))} AS weight FROM leaves),
mid AS (SELECT domain, lang_key, sum(supply) AS supply, {_weight('lang_key', weights.get('lang'))} AS weight FROM low GROUP BY 1, 2),
top AS (SELECT domain, sum(supply) AS supply, {_weight('domain', weights.get('domain'))} AS weight, (SELECT budget FROM total) AS budget FROM mid GROUP BY 1),
top_got AS ({_filled('top', '', 'domain')}),
mid_got AS ({_filled('(SELECT m.*, t.got AS budget FROM mid m JOIN top_got t USING (domain))', 'domain', 'domain, lang_key')}),
leaf_got AS ({_filled('(SELECT l.*, m.got AS budget FROM low l JOIN mid_got m USING (domain, lang_key))', 'domain, lang_key', 'domain, lang_key, source_key')}),
plan AS (
  SELECT domain, lang_key, source_key, tokens, CAST(whole AS BIGINT) AS whole, CASE WHEN got - whole * tokens > 0.5 THEN got - whole * tokens ELSE 0 END AS rest
  FROM (SELECT *, CASE WHEN tokens > 0 THEN floor(got / tokens + 1e-9) ELSE 0 END AS whole FROM leaf_got) x),
placed AS (SELECT d.*, p.whole, p.rest, {place('p.whole')} AS place FROM docs d JOIN plan p USING (domain, lang_key, source_key)),
running AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang_key, source_key ORDER BY place) AS upto FROM placed),
cuts AS (SELECT domain, lang_key, source_key, min(place) FILTER (rest > 0 AND upto >= rest) AS cut FROM running GROUP BY 1, 2, 3)
SELECT doc_id, domain, lang, source, unnest(range(CASE WHEN place <= cut THEN whole + 1 ELSE whole END)) AS epoch
FROM placed JOIN cuts USING (domain, lang_key, source_key)"""


#: Every mask meets every order here, unlike in the operator.
FILTER_AUDIT = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a
  JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l) JOIN letters d ON d.l NOT IN (a.l, b.l, c.l)
  JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (
  SELECT part, o, step, n, good, toxic, mask, o[step] AS l, contains(mask, o[step]) AS fails,
    len(list_filter(string_split(o[1:step - 1], ''), lambda x: x <> '' AND contains(mask, x))) > 0 AS gone
  FROM counts CROSS JOIN steps),
sums AS (
  SELECT part, o, step, l,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (mask = l), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM met GROUP BY part, o, step, l)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM sums"""
