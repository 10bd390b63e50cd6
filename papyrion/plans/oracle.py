"""The queries in SQL, written for DuckDB independently of the expressions they check."""

from __future__ import annotations

from papyrion.operators import snapshots
from papyrion.plans import html_queries, source_queries, upkeep_queries
from papyrion.plans.queries import SYNC_CUT
from papyrion.sinks.documents import TASKS

# Each capture and clip once; deliveries of an id hold the same content.
CAP = "cap AS (SELECT DISTINCT ON (capture_id) * FROM captures ORDER BY capture_id, ingested_at)"
CLIP = "clip AS (SELECT DISTINCT ON (clip_id) * FROM clip_log ORDER BY clip_id, received_at)"
SNAP = """snap AS (SELECT DISTINCT ON (inventory_id) inventory_id, collection_id, last_refreshed_at, pages FROM site_inventories
  WHERE pages IS NOT NULL AND last_refreshed_at IS NOT NULL AND collection_id IS NOT NULL ORDER BY inventory_id),
latest AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY last_refreshed_at DESC, inventory_id DESC) = 1)"""
_TRIM = r"' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(65279)"


def _trimmed(u: str) -> str:
    return f"trim({u}, {_TRIM})"


def _scheme(u: str) -> str:
    u = _trimmed(u)
    return rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


def _host(u: str) -> str:
    """Host and port as written, lower case."""
    u = _trimmed(u)
    return rf"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def _hostname(u: str) -> str:
    return f"nullif(regexp_replace({_host(u)}, ':[0-9]*$', ''), '')"


def _host_port(u: str) -> str:
    return f"nullif(CASE WHEN {_scheme(u)} = 'http' THEN regexp_replace({_host(u)}, ':(80)?$', '') WHEN {_scheme(u)} = 'https' THEN regexp_replace({_host(u)}, ':(443)?$', '') ELSE {_host(u)} END, '')"


def _canonical(u: str) -> str:
    rest = rf"regexp_extract({_trimmed(u)}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {_hostname(u)} IS NULL THEN {u} ELSE {_scheme(u)} || '://' || {_host_port(u)} || CASE WHEN {rest} = '' THEN '/' WHEN {rest}[1] = '?' THEN '/' || {rest} ELSE {rest} END END"


def _path(u: str) -> str:
    p = rf"regexp_extract({_trimmed(u)}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {_hostname(u)} IS NULL OR {p} = '' THEN '/' ELSE {p} END"


def _sane(c: str, fallback: str = "page") -> str:
    s = rf"""trim(regexp_replace(regexp_replace({c}, '[\x00-\x1f\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g'))"""
    s = f"regexp_replace(left(regexp_replace({s}, '[. ]+$', ''), 120), '[. ]+$', '')"
    return f"coalesce(nullif({s}, ''), '{fallback}')"


def _segment(c: str) -> str:
    s = _sane(c)
    return f"CASE WHEN regexp_matches(lower({s}), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN '_' || {s} ELSE {s} END"


def _rel(u: str) -> str:
    parts = f"list_filter(string_split({_path(u)}, '/'), lambda s: s <> '')"
    folder = f"list_transform(list_slice({parts}, 1, len({parts}) - 1), lambda s: {_segment('url_decode(s)')})"
    last = _segment(f"regexp_replace(url_decode({parts}[-1]), '\\.[A-Za-z0-9]+$', '')")
    return f"CASE WHEN len({parts}) = 0 THEN 'index.md' ELSE array_to_string(list_append({folder}, {last} || '.md'), '/') END"


def _slug(c: str) -> str:
    s = rf"""regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[''"]', '', 'g'), '[^a-z0-9]+', '-', 'g')"""
    return f"coalesce(nullif(regexp_replace(left(trim({s}, '-'), 80), '-+$', ''), ''), 'page')"


def _units(t: str) -> str:
    """UTF-16 code units of a text."""
    return f"flatten(list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) // 1024), 56320 + ((unicode(c) - 65536) % 1024)] ELSE [unicode(c)] END))"


def _fnv(t: str) -> str:
    return f"'fnv1a-' || lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform({_units(t)}, lambda x: x::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0')"


def _fingerprint_form(c: str) -> str:
    s = rf"regexp_replace(coalesce({c}, ''), '\r\n?', chr(10), 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '')"
    return rf"regexp_replace(regexp_replace({s}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


def _cell(c: str) -> str:
    return rf"trim(regexp_replace(replace(coalesce({c}, ''), '|', '\|'), '\r?\n', ' ', 'g'), {_TRIM})"


def _yaml(c: str) -> str:
    s = rf"regexp_replace({c}, '\r?\n', ' ', 'g')"
    special = r"""[:#\[\]{}&*!|>''"%@`,]"""
    need = rf"({s} = '' OR regexp_matches({s}, '^[\s\x{{0b}}\x{{a0}}\x{{feff}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]|[\s\x{{0b}}\x{{a0}}\x{{feff}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]$') OR regexp_matches({s}, '{special}') OR regexp_matches({s}, '^[-?]') OR regexp_matches(lower({s}), '^(true|false|null|yes|no|on|off|~)$') OR regexp_matches({s}, '^-?[0-9]'))"
    return rf"""CASE WHEN {need} THEN '"' || replace(replace({s}, '\', '\\'), '"', '\"') || '"' ELSE {s} END"""


def _line(key: str, c: str) -> str:
    return f"CASE WHEN nullif({c}, '') IS NOT NULL THEN '{key}: ' || {_yaml(c)} END"


def _encode(p: str) -> str:
    return f"replace(replace(replace(replace(replace(replace(replace(url_encode({p}), '%2F', '/'), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


_IDENTITY = f"coalesce('path:' || lower(nullif(trim(p.file_ref, {_TRIM}), '')), 'guid:' || lower(nullif(trim(p.guid, {_TRIM}), '')), 'url:' || lower(nullif(trim(p.url, {_TRIM}), '')), 'id:' || p.id)"
_PAGES = f"""linked AS (SELECT *, lag(inventory_id) OVER (PARTITION BY collection_id ORDER BY last_refreshed_at, inventory_id) AS previous_id FROM snap),
one AS (SELECT inventory_id, unnest(pages) AS p, generate_subscripts(pages, 1) AS pos FROM snap),
page AS (SELECT inventory_id, p, {_IDENTITY} AS page_key FROM one WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY inventory_id, page_key ORDER BY pos) = 1),
new AS (SELECT l.inventory_id, page_key, p FROM linked l JOIN page USING (inventory_id) WHERE previous_id IS NOT NULL AND page_key IS NOT NULL),
old AS (SELECT l.inventory_id, page_key, p FROM linked l JOIN page ON page.inventory_id = l.previous_id WHERE page_key IS NOT NULL),
change AS (SELECT inventory_id, page_key, CASE WHEN old.p IS NULL THEN 'new' WHEN new.p IS NULL THEN 'removed'
  WHEN coalesce(old.p.title,'') <> coalesce(new.p.title,'') OR coalesce(old.p.file_ref,'') <> coalesce(new.p.file_ref,'') OR coalesce(old.p.guid,'') <> coalesce(new.p.guid,'')
    OR coalesce(old.p.modified,'') <> coalesce(new.p.modified,'') OR coalesce(old.p.url,'') <> coalesce(new.p.url,'') THEN 'updated' ELSE 'unchanged' END AS change
  FROM old FULL JOIN new USING (inventory_id, page_key))"""
_DAY = "CASE WHEN {c} IS NULL THEN '' WHEN try_cast({c} AS TIMESTAMPTZ) IS NOT NULL THEN strftime(try_cast({c} AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') ELSE {c} END"
_BASE = "regexp_replace(coalesce(nullif(web_url, ''), nullif(source_url, ''), ''), '/+$', '')"
_KIND = lambda u: f"CASE WHEN {_hostname(u)} LIKE '%.sharepoint.com' OR {_hostname(u)} = 'sharepoint.com' THEN 'sharepoint' WHEN ({_hostname(u)} LIKE '%.atlassian.net' AND {_path(u)} LIKE '/wiki%') OR regexp_matches({_path(u)}, '^/(display|spaces)/') OR {_hostname(u)} LIKE '%confluence%' THEN 'confluence' ELSE 'website' END"
_SYNC = f"""
first AS (SELECT DISTINCT ON (capture_id) * FROM captures WHERE collection_id IS NOT NULL ORDER BY capture_id, ingested_at),
keyed AS (SELECT *, {_canonical('url')} AS k FROM first),
good AS (SELECT * FROM keyed WHERE markdown IS NOT NULL AND error IS NULL),
now AS (SELECT * FROM good WHERE ingested_at >= TIMESTAMPTZ '{SYNC_CUT}+00' QUALIFY row_number() OVER (PARTITION BY collection_id, k ORDER BY capture_id DESC) = 1),
prev AS (SELECT * FROM good WHERE ingested_at < TIMESTAMPTZ '{SYNC_CUT}+00' QUALIFY row_number() OVER (PARTITION BY collection_id, k ORDER BY capture_id DESC) = 1),
fail AS (SELECT collection_id, k, min(error) AS error FROM keyed WHERE error IS NOT NULL GROUP BY ALL),
want AS (SELECT collection_id, {_canonical('u')} AS k FROM (SELECT collection_id, unnest(urls) AS u FROM collections) UNION SELECT collection_id, k FROM fail UNION SELECT collection_id, k FROM prev WHERE title IS NOT NULL),
plan AS (
  SELECT n.collection_id, n.k, CASE WHEN p.k IS NOT NULL AND p.markdown = n.markdown THEN 'unchanged' ELSE 'write' END AS action, CAST(NULL AS VARCHAR) AS capture_error FROM now n LEFT JOIN prev p ON n.collection_id = p.collection_id AND n.k = p.k
  UNION ALL SELECT p.collection_id, p.k, CASE WHEN w.k IS NULL THEN 'removed' WHEN f.k IS NOT NULL THEN 'error' ELSE 'retained' END, CASE WHEN w.k IS NOT NULL THEN coalesce(f.error, 'No current page body was available') END
  FROM prev p LEFT JOIN want w ON w.collection_id = p.collection_id AND w.k = p.k LEFT JOIN fail f ON f.collection_id = p.collection_id AND f.k = p.k
  WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.collection_id = p.collection_id AND n.k = p.k))"""

SQL = {
    "p4_found": snapshots.P4_SQL,
    "page_canonical_url": f"WITH {CAP} SELECT capture_id, {_canonical('url')} AS canonical_url, {_host_port('url')} AS host, regexp_replace({_hostname('url')}, '^www\\.', '') AS site, {_scheme('url')} || '://' || {_host_port('url')} AS origin FROM cap",
    "page_host_stats": f"WITH {CAP} SELECT {_hostname('url')} AS host, count(*) AS n_captures, count(DISTINCT {_canonical('url')}) AS n_urls FROM cap GROUP BY 1",
    "page_dedupe_by_canonical": f"WITH {CAP} SELECT {_canonical('url')} AS canonical_url, min(capture_id) AS capture_id, count(*) AS n_captures FROM cap GROUP BY 1",
    "page_rel_path": f"WITH {CAP}, r AS (SELECT capture_id, {_rel('url')} AS rel_path FROM cap) SELECT capture_id, rel_path, {_encode('rel_path')} AS link_path FROM r",
    "page_unique_path": f"""WITH {CAP}, r AS (SELECT capture_id, collection_id, {_rel('url')} AS p FROM cap),
      n AS (SELECT *, row_number() OVER (PARTITION BY collection_id, p ORDER BY capture_id) - 1 AS k FROM r)
      SELECT capture_id, CASE WHEN k = 0 THEN p ELSE regexp_replace(p, '(\\.[^./]*)?$', '-' || k || coalesce(nullif(regexp_extract(p, '(\\.[^./]*)$', 1), ''), '')) END AS path FROM n""",
    "library_paths": f"""WITH {CAP}, r AS (SELECT capture_id, c.collection_id, coalesce({_hostname('url')}, 'unknown-host') AS h, collection_type, {_rel('url')} AS p FROM cap JOIN collections c USING (collection_id)),
      f AS (SELECT r.*, CASE WHEN collection_type = 'custom' AND n > 1 THEN h || '/' ELSE '' END AS folder FROM r JOIN (SELECT collection_id, count(DISTINCT h) AS n FROM r GROUP BY 1) USING (collection_id)),
      n AS (SELECT *, row_number() OVER (PARTITION BY collection_id, folder, p ORDER BY capture_id) - 1 AS k FROM f)
      SELECT capture_id, collection_id, folder || CASE WHEN k = 0 THEN p ELSE regexp_replace(p, '(\\.[^./]*)?$', '-' || k || coalesce(nullif(regexp_extract(p, '(\\.[^./]*)$', 1), ''), '')) END AS path FROM n""",
    "doc_fingerprint": f"SELECT doc_id, {_fnv(_fingerprint_form('text'))} AS fingerprint FROM documents",
    "doc_content_hash": f"SELECT doc_id, {_fnv("coalesce(text, '')")} AS content_hash, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS byte_length FROM documents",
    "clip_changed": f"WITH {CLIP} SELECT clip_id, CASE WHEN coalesce(content_fingerprint, '') = '' THEN 'unknown' WHEN content_fingerprint = preview_fingerprint THEN 'current' ELSE 'changed' END AS state FROM clip",
    "doc_slug": rf"""SELECT doc_id, {_slug('title')} AS slug, {_sane("coalesce(title, '')")} AS file_name, regexp_replace(trim(regexp_replace(lower(coalesce(title, '')), '[^A-Za-z0-9_\s-]', '', 'g'), {_TRIM}), '\s+', '-', 'g') AS anchor FROM documents""",
    "doc_auto_description": r"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
        '(?m)^#{1,6}[\s\x{0b}\x{a0}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}]+', '', 'g'), '[>*_#-]', ' ', 'g'), '[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM s),
      c AS (SELECT doc_id, t, left(t, 200) AS head, regexp_extract(left(t, 200), '(?s)^(.*) [^ ]*$', 1) AS cut FROM p)
      SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE trim(CASE WHEN length(cut) > 40 THEN cut ELSE head END) || '...' END AS description FROM c""",
    "doc_visible_length": r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS visible_length FROM documents",
    "doc_normalized": r"""WITH a AS (SELECT doc_id, replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '') AS t FROM a)
      SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{0b}\x{a0}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}]+|[\s\x{0b}\x{a0}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}]+$', '', 'g') AS markdown FROM b""",
    "doc_tag_rules": rf"""SELECT doc_id, array_to_string(list_filter([
        CASE WHEN lower(coalesce(title, '')) LIKE '%archive%' THEN 'archive' END,
        CASE WHEN lower(coalesce(text, '')) LIKE '%backup disk%' THEN 'storage' END, CASE WHEN lower(coalesce(text, '')) LIKE '%backup disk%' THEN 'backup' END,
        CASE WHEN regexp_matches(coalesce(url, '') || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, ''), '(?i)\bkarten?ansicht\b') THEN 'maps' END,
        CASE WHEN coalesce({_hostname('url')}, '') LIKE '%handbook%' THEN 'handbook' END,
        CASE WHEN coalesce({_hostname('url')}, '') LIKE '%handbook%' AND lower(coalesce(title, '')) NOT LIKE '%archive%' THEN 'archive' END,
        CASE WHEN regexp_matches(coalesce(url, ''), '(?i)https?://[^/]*\.example') THEN 'example-site' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""",
    "tag_union": rf"""WITH {CAP}, t AS (SELECT capture_id, mode, list_filter(list_transform(coalesce(metadata.tags, []), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS a FROM cap), u AS (SELECT capture_id, list_append(a, mode) AS a FROM t)
      SELECT capture_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS tags FROM u""",
    "inventory_reconcile": f"WITH {SNAP}, {_PAGES} SELECT inventory_id, page_key, change FROM change",
    "inventory_guard": f"""WITH {SNAP}, {_PAGES}, n AS (SELECT inventory_id, count_if(change = 'new') AS n_new, count_if(change = 'updated') AS n_updated, count_if(change = 'unchanged') AS n_unchanged, count_if(change = 'removed') AS n_removed FROM change GROUP BY 1)
      SELECT inventory_id, CAST(n_new AS BIGINT) AS n_new, CAST(n_updated AS BIGINT) AS n_updated, CAST(n_unchanged AS BIGINT) AS n_unchanged, CAST(n_removed AS BIGINT) AS n_removed,
        n_updated + n_unchanged + n_removed > 0 AND n_new < n_removed AND (n_updated + n_unchanged + n_new = 0 OR n_updated + n_unchanged + n_removed >= 5 AND (n_removed - n_new) / (n_updated + n_unchanged + n_removed) >= 0.25) AS needs_confirmation,
        CASE WHEN n_new + n_updated + n_removed = 0 THEN 'No changes found.' ELSE concat_ws(', ', CASE WHEN n_new > 0 THEN n_new || ' new' END, CASE WHEN n_updated > 0 THEN n_updated || ' updated' END, CASE WHEN n_removed > 0 THEN n_removed || ' no longer present' END) || '.' END AS summary FROM n""",
    "sync_plan": f"WITH {_SYNC} SELECT collection_id, sha256(k) || '.md' AS path, action, capture_error FROM plan",
    "sync_counts": f"WITH {_SYNC} SELECT collection_id, count_if(action <> 'removed')::BIGINT AS n_current, count_if(action = 'write')::BIGINT AS n_updated, count_if(action = 'unchanged')::BIGINT AS n_unchanged, count_if(action IN ('retained', 'error'))::BIGINT AS n_retained, count_if(action = 'error')::BIGINT AS n_failed, count_if(action = 'removed')::BIGINT AS n_removed FROM plan GROUP BY 1",
    "clip_log_newest": f"WITH {CLIP} SELECT clip_id, url, epoch_us(clipped) AS clipped_us FROM clip WHERE clipped >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND clip_type = 'article' ORDER BY clipped DESC NULLS LAST, clip_id LIMIT 100",
    "clip_latest_by_url": f"WITH {CLIP} SELECT {_canonical('url')} AS url_key, clip_id FROM clip WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_canonical('url')} ORDER BY clipped DESC NULLS LAST, clip_id) = 1",
    "clip_types": "SELECT DISTINCT clip_type FROM clip_log WHERE clip_type <> ''",
    "clip_lookup": f"WITH {CAP}, {CLIP}, newest AS (SELECT {_canonical('url')} AS k, clip_id FROM clip QUALIFY row_number() OVER (PARTITION BY {_canonical('url')} ORDER BY clipped DESC NULLS LAST, clip_id) = 1) SELECT capture_id, clip_id FROM cap JOIN newest ON k = {_canonical('cap.url')}",
    "clip_upsert": f"""WITH {CLIP}, k AS (SELECT *, {_canonical('url')} AS u FROM clip), old AS (SELECT * FROM k WHERE received_at < TIMESTAMPTZ '2026-06-01 00:00:00+00'),
      new AS (SELECT * FROM k WHERE received_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' AND u IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u ORDER BY clipped DESC NULLS LAST, clip_id) = 1),
      hit AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY u ORDER BY clipped DESC NULLS LAST, clip_id) = 1)
      SELECT o.clip_id, CASE WHEN h.clip_id IS NOT NULL THEN coalesce(n.url, o.url) ELSE o.url END AS url, CASE WHEN h.clip_id IS NOT NULL THEN coalesce(n.title, o.title) ELSE o.title END AS title, CASE WHEN h.clip_id IS NOT NULL THEN coalesce(o.clip_path, n.clip_path) ELSE o.clip_path END AS clip_path
      FROM old o LEFT JOIN hit h ON h.clip_id = o.clip_id LEFT JOIN new n ON n.u = o.u UNION ALL SELECT clip_id, url, title, clip_path FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.u = new.u)""",
    "activity_summary": f"WITH {CLIP} SELECT count(*) AS clips, count(DISTINCT {_hostname('url')}) AS source_sites, (SELECT count(*) FROM collections) AS collections, coalesce(strftime(max(clipped) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS last_clipped FROM clip",
    "collection_match": f"""WITH {CAP}, site AS (SELECT collection_id, {_BASE} AS base, coalesce(list_transform(list_filter(urls, lambda u: regexp_matches(u, '(?i)^https?://')), lambda u: {_canonical('u')}), []) AS listed FROM collections),
      m AS (SELECT capture_id, site.collection_id, base, list_contains(listed, {_canonical('url')}) AS is_listed FROM cap JOIN site ON list_contains(listed, {_canonical('url')}) OR base <> '' AND (url = base OR starts_with(url, base || '/') OR starts_with(url, base || '?')))
      SELECT capture_id, collection_id FROM m QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY is_listed DESC, length(base) DESC, collection_id) = 1""",
    "collections_due": "SELECT collection_id, added_at IS NULL OR epoch_us(TIMESTAMPTZ '2026-01-15 00:00:00+00') - epoch_us(added_at) >= 7 * 86400000000 AS weekly_due, added_at IS NULL OR epoch_us(TIMESTAMPTZ '2026-01-15 00:00:00+00') - epoch_us(added_at) >= 30 * 86400000000 AS monthly_due, FALSE AS off_due FROM collections",
    "collections_refreshable": "SELECT collection_id FROM collections WHERE coalesce(collection_type, '') <> 'custom' AND coalesce(source_mode, '') <> 'crawl'",
    "collection_presets": f"""WITH {SNAP}, u AS (SELECT collection_id, trim(x, {_TRIM}) AS url FROM (SELECT collection_id, unnest(urls) AS x FROM collections UNION ALL SELECT collection_id, unnest(pages).url FROM latest) WHERE regexp_matches(trim(x, {_TRIM}), '(?i)^https?://')),
      n AS (SELECT collection_id, count(DISTINCT url) AS n FROM u GROUP BY 1), c AS (SELECT c.*, coalesce(n, 0) AS n, {_BASE} AS base FROM collections c LEFT JOIN n USING (collection_id))
      SELECT collection_id, CASE WHEN n > 0 THEN 'list' WHEN source_mode IN ('sitemap', 'llms') THEN source_mode ELSE 'crawl' END AS mode, CASE WHEN n = 0 AND source_mode IN ('sitemap', 'llms') THEN coalesce(nullif(source_url, ''), base) ELSE base END AS start_url,
        CAST(CASE WHEN n > 0 THEN least(n, 500) WHEN source_mode IN ('sitemap', 'llms') THEN 100 ELSE 25 END AS BIGINT) AS max_pages, n AS inventory_count,
        CASE WHEN n = 0 AND coalesce(source_mode, '') NOT IN ('sitemap', 'llms') AND (collection_type = 'sharepoint' OR regexp_matches(base, '(?i)\\.sharepoint\\.com/')) THEN '/SitePages/' ELSE '' END AS include_pattern FROM c""",
    "collection_inventory_csv": f"""WITH {SNAP}, r AS (SELECT c.*, l.last_refreshed_at, CASE WHEN len(coalesce(pages, [])) > 0 THEN list_transform(pages, lambda p: {{'t': p.title, 'm': p.modified, 'u': p.url}}) WHEN len(coalesce(urls, [])) > 0 THEN list_transform(urls, lambda u: {{'t': CAST(NULL AS VARCHAR), 'm': CAST(NULL AS VARCHAR), 'u': u}}) ELSE [{{'t': CAST(NULL AS VARCHAR), 'm': CAST(NULL AS VARCHAR), 'u': CAST(NULL AS VARCHAR)}}] END AS ps FROM collections c LEFT JOIN latest l USING (collection_id)),
      x AS (SELECT *, unnest(ps) AS p FROM r)
      SELECT coalesce(collection_name, '') AS collection_name, coalesce(collection_type, '') AS collection_type, coalesce(source_mode, '') AS discovery_method, coalesce(nullif(source_url, ''), nullif(web_url, ''), '') AS collection_url, coalesce(p.t, '') AS page_title, coalesce(p.u, '') AS page_url, coalesce(p.m, '') AS modified, coalesce(strftime(last_refreshed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS last_refreshed FROM x""",
    "inventory_urls": f"WITH {SNAP} SELECT DISTINCT collection_id, url FROM (SELECT collection_id, unnest(urls) AS url FROM collections UNION ALL SELECT collection_id, unnest(pages).url FROM latest) WHERE coalesce(url, '') <> ''",
    "catalog": f"WITH {_SYNC}, n AS (SELECT collection_id, count(*) AS n_pages FROM plan WHERE action <> 'removed' GROUP BY 1) SELECT collection_id, collection_name AS name, collection_type AS type, coalesce(nullif(array_to_string(list_transform(list_filter(string_split(coalesce(library_path, ''), '/'), lambda s: trim(s) NOT IN ('', '.', '..')), lambda s: {_segment('s')}), '/'), ''), collection_type || '/' || {_slug('collection_name')}) AS folder, coalesce(nullif(source_url, ''), nullif(web_url, ''), '') AS source_url, n_pages, '2026-12-31T00:00:00.000Z' AS synced_at FROM collections JOIN n USING (collection_id)",
    "health_rows": f"WITH {CAP} SELECT url, CASE WHEN error IS NULL THEN coalesce(title, '') ELSE '' END AS title, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN '' ELSE coalesce(nullif(error, ''), 'Capture failed') END AS error FROM cap",
    "job_stats": f"WITH {CAP} SELECT job_id, CAST(count_if(error IS NULL) AS BIGINT) AS n_captured, CAST(count_if(error IS NOT NULL) AS BIGINT) AS n_failed FROM cap GROUP BY 1",
    "job_progress": f"""WITH {CAP}, j AS (SELECT job_id, CAST(count_if(error IS NULL) AS BIGINT) AS captured, CAST(count_if(error IS NOT NULL) AS BIGINT) AS failed, max(epoch_ms(captured_at)) - min(epoch_ms(captured_at)) AS ms FROM cap GROUP BY 1),
      t AS (SELECT *, captured + failed AS completed, greatest(captured + failed, least(captured + failed + 40, 50 + failed)) AS total FROM j), e AS (SELECT *, CASE WHEN completed > 0 AND total > completed THEN CAST(floor(CAST(ms * (total - completed) AS DOUBLE) / completed + 0.5) AS BIGINT) END AS eta_ms FROM t)
      SELECT job_id, captured, failed, completed, total, CAST(least(100, floor(completed * 100.0 / total + 0.5)) AS INT) AS percent, eta_ms, CASE WHEN eta_ms IS NOT NULL THEN printf('%02d:%02d:%02d', CAST(ceil(eta_ms / 1000) AS BIGINT) // 3600, CAST(ceil(eta_ms / 1000) AS BIGINT) % 3600 // 60, CAST(ceil(eta_ms / 1000) AS BIGINT) % 60) ELSE '00:00:00' END AS clock FROM e""",
    "failed_urls": f"WITH {CAP} SELECT DISTINCT job_id, url FROM cap WHERE error IS NOT NULL",
    "result_meta": f"WITH {CAP} SELECT job_id, url, {_rel('url')} AS path, CAST(octet_length(encode(coalesce(markdown, ''))) AS BIGINT) AS byte_length FROM cap",
    "missing_bodies": f"WITH {CAP} SELECT job_id, count(*) AS n_results, CAST(count_if(NOT EXISTS (SELECT 1 FROM cap b WHERE b.job_id = cap.job_id AND b.url = cap.url AND b.markdown IS NOT NULL)) AS BIGINT) AS n_missing FROM cap GROUP BY 1",
    "link_distances": f"""WITH RECURSIVE {CAP}, n AS (SELECT capture_id, {_canonical('url')} AS u FROM cap WHERE url IS NOT NULL), e AS (SELECT DISTINCT a.u AS s, b.u AS d FROM n a JOIN n b ON b.capture_id IN (2 * a.capture_id, 2 * a.capture_id + 1)),
      walk AS (SELECT u, 0 AS depth FROM n WHERE capture_id = 1 UNION SELECT e.d, depth + 1 FROM walk JOIN e ON e.s = walk.u WHERE depth < 30) SELECT u AS url_key, min(depth) AS depth FROM walk GROUP BY 1""",
    "page_links": rf"""WITH {CAP}, l AS (SELECT capture_id, unnest(list_concat(regexp_extract_all(markdown, '\[[^\]]*\]\(([^\s)]+)(?:\s+["''][^"'']*["''])?\)', 1), regexp_extract_all(markdown, '(?i)https?://[^\s<>"'')\]]+'))) AS url FROM cap WHERE markdown IS NOT NULL) SELECT DISTINCT capture_id, url FROM l WHERE regexp_matches(url, '^https?://')""",
    "front_matter": f"""WITH {CAP}, p AS (SELECT capture_id, title, url, metadata.author AS author, nullif(metadata.published, '') AS published, nullif(metadata.modified, '') AS modified, metadata.description AS description, metadata.site AS site, metadata.captured_at AS captured, metadata.tags AS tags FROM cap),
      f AS (SELECT capture_id, array_to_string(list_filter([{_line('title', 'title')}, {_line('source', 'url')}, {_line('author', 'author')}, {_line('published', 'published')}, CASE WHEN modified IS DISTINCT FROM published THEN {_line('modified', 'modified')} END, {_line('description', 'description')}, {_line('site', 'site')},
        CASE WHEN len(tags) > 0 THEN 'tags:' || chr(10) || array_to_string(list_transform(tags, lambda t: '  - ' || {_yaml('t')}), chr(10)) END, {_line('captured', 'captured')}], lambda x: x IS NOT NULL), chr(10)) AS body FROM p)
      SELECT capture_id, CASE WHEN body = '' THEN '' ELSE '---' || chr(10) || body || chr(10) || '---' END AS front_matter FROM f""",
    "template_selectors": r"""WITH p AS (SELECT DISTINCT ON (profile_id) * FROM setting_profiles), r AS (SELECT profile_id, list_transform(regexp_extract_all(concat_ws(chr(10), template, filename_template), '\{\{\s*selector:([^|{}]+)', 1), lambda x: trim(x)) AS a FROM p) SELECT profile_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS selectors FROM r""",
    "site_index": f"""WITH {CAP}, r AS (SELECT capture_id, collection_id, title, {_rel('url')} AS path FROM cap WHERE collection_id IS NOT NULL)
      SELECT collection_id, '# ' || collection_id || chr(10) || chr(10) || count(*) || CASE WHEN count(*) = 1 THEN ' page.' ELSE ' pages.' END || chr(10) || chr(10) || string_agg('- [' || replace(coalesce(nullif(title, ''), path), ']', '\\]') || '](' || {_encode('path')} || ')', chr(10) ORDER BY capture_id) || chr(10) AS content FROM r GROUP BY 1""",
    "aggregate_sections": f"""WITH {CAP}, r AS (SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY capture_id) AS n, coalesce(nullif(title, ''), url) AS name, url, markdown FROM cap WHERE collection_id IS NOT NULL)
      SELECT collection_id, n, '- [' || replace(name, ']', '\\]') || '](#' || regexp_replace(trim(regexp_replace(lower(n || '. ' || name), '[^A-Za-z0-9_\\s-]', '', 'g'), {_TRIM}), '\\s+', '-', 'g') || ')' AS toc,
        '## ' || n || '. ' || name || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || trim(coalesce(markdown, ''), ' ') || chr(10) || chr(10) || '---' || chr(10) AS section FROM r""",
    "knowledge_index": f"""WITH {CLIP}, r AS (SELECT *, '| ' || concat_ws(' | ', {_cell('title')}, {_cell('clip_path')}, {_cell('url')}, coalesce(strftime(clipped AT TIME ZONE 'UTC', '%Y-%m-%d'), ''), {_cell('clip_type')}, coalesce(array_to_string(list_transform(tags, lambda t: {_cell('t')}), ', '), '')) || ' |' AS line FROM clip WHERE collection_id IS NOT NULL)
      SELECT collection_id, '# Knowledge base' || chr(10) || chr(10) || count(*) || CASE WHEN count(*) = 1 THEN ' clip.' ELSE ' clips.' END || chr(10) || chr(10) || '| title | path | source_url | clipped | type | tags |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY clipped DESC NULLS LAST, clip_id) || chr(10) AS content FROM r GROUP BY 1""",
    "prompt_inventory": f"""WITH {CLIP}, r AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY clip_id) AS n FROM clip WHERE collection_id IS NOT NULL),
      l AS (SELECT collection_id, n, '| ' || concat_ws(' | ', CAST(n AS VARCHAR), {_cell('title')}, {_cell('clip_path')}, {_cell('url')}, coalesce(strftime(clipped AT TIME ZONE 'UTC', '%Y-%m-%d'), ''), coalesce(array_to_string(list_transform(tags, lambda t: {_cell('t')}), ', '), '')) || ' |' AS line FROM r)
      SELECT collection_id, 'SCOPE: All saved clips' || chr(10) || 'SOURCE FOLDER: not configured' || chr(10) || chr(10) || 'Read the files named below before you answer, and cite each file''s source_url.' || chr(10) || chr(10) || 'INVENTORY' || chr(10) || chr(10) || '| # | title | file | source_url | clipped | tags |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10)
        || string_agg(line, chr(10) ORDER BY n) || chr(10) || chr(10) || 'TASK' || chr(10) || chr(10) || '{TASKS['compare']}' || chr(10) || chr(10) || 'Say also what the files leave out.' AS content FROM l GROUP BY 1""",
    "metadata_days": f"WITH {CAP} SELECT capture_id, {_DAY.format(c='metadata.published')} AS published_day, {_DAY.format(c='metadata.modified')} AS modified_day FROM cap",
}
SQL |= html_queries.SQL | source_queries.SQL | upkeep_queries.SQL
_LABELED = lambda key, c: f"CASE WHEN nullif({c}, '') IS NOT NULL THEN '{key}: ' || {c} END"
_P = "p AS (SELECT capture_id, title, url, nullif(metadata.author, '') AS author, nullif(metadata.published, '') AS published, nullif(metadata.modified, '') AS modified, metadata.description AS description, metadata.site AS site, metadata.captured_at AS captured, metadata.tags AS tags, mode, markdown, variables FROM cap)"
_TAGS = f"CASE WHEN len(tags) > 0 THEN 'tags:' || chr(10) || array_to_string(list_transform(tags, lambda t: '  - ' || {_yaml('t')}), chr(10)) END"
_FOLDER = f"coalesce(nullif(array_to_string(list_transform(list_filter(string_split(coalesce(library_path, ''), '/'), lambda s: trim(s) NOT IN ('', '.', '..')), lambda s: {_segment('s')}), '/'), ''), collection_type || '/' || {_slug('collection_name')})"
_COL = f"""norm AS (SELECT DISTINCT ON (collection_id) collection_id, source_mode, library_path, added_at, coalesce(nullif(trim(web_url), ''), nullif(trim(source_url), '')) AS address, web_url, source_url,
  list_distinct(list_filter(list_transform(coalesce(urls, []), lambda u: {_trimmed('u')}), lambda u: regexp_matches(u, '(?i)^https?://'))) AS urls, collection_name AS n, collection_type AS t FROM collections),
named AS (SELECT * EXCLUDE (n, t), CASE WHEN t IN ('sharepoint', 'confluence', 'website', 'custom') THEN t ELSE {_KIND('address')} END AS collection_type, n AS collection_name FROM norm)"""
_TITLE = f"coalesce(nullif(trim(CASE WHEN capture_id % 3 = 0 THEN ' Edited ' || capture_id WHEN capture_id % 3 = 1 THEN ' ' ELSE title END, {_TRIM}), ''), nullif(title, ''), 'page')"
SQL |= {
    "metadata_lists": f"""WITH {CAP}, {_P} SELECT capture_id, array_to_string(list_filter([{_LABELED('Source', 'url')}, {_LABELED('Author', 'author')}, {_LABELED('Published', 'published')}, CASE WHEN modified IS DISTINCT FROM published THEN {_LABELED('Modified', 'modified')} END, {_LABELED('Description', 'description')}, {_LABELED('Site', 'site')},
      CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END, {_LABELED('Captured', 'captured')}], lambda x: x IS NOT NULL), chr(10)) AS metadata_list FROM p""",
    "knowledge_base_matter": f"""WITH {CAP}, {_P}, f AS (SELECT capture_id, array_to_string(list_filter([{_line('title', 'title')}, {_line('source_url', 'url')}, {_line('author', 'author')}, {_line('published', 'published')}, {_line('description', 'description')}, {_TAGS}, 'type: article'], lambda x: x IS NOT NULL), chr(10)) AS body FROM p WHERE description <> '')
      SELECT capture_id, '---' || chr(10) || body || chr(10) || '---' AS front_matter FROM f""",
    "assembled_documents": f"""WITH {CAP}, e AS (SELECT capture_id, mode, {_TITLE} AS title, CASE WHEN capture_id % 4 = 0 THEN 'https://edited.test/x' ELSE url END AS url, capture_id % 5 = 0 OR regexp_matches(coalesce(cap.title, ''), '[^\x00-\x7F]') AS own FROM cap)
      SELECT capture_id, title, url, mode, CASE WHEN own THEN 'my file ' || capture_id ELSE {_sane(_slug('title'))} END || '.md' AS file_name FROM e""",
    "assembled_templates": f"""WITH {CAP}, {_P} SELECT capture_id, coalesce(nullif(trim(coalesce(title, ''), {_TRIM}), ''), nullif(title, ''), 'page') || ' by An Editor' || chr(10) || coalesce(site, '') || '|' || coalesce(array_to_string(tags, ', '), '') || chr(10) || chr(10) AS markdown FROM p""",
    "permitted_pages": f"WITH {CAP}, o AS (SELECT DISTINCT {_hostname('coalesce(web_url, source_url)')} AS h FROM collections WHERE collection_type = 'website') SELECT capture_id FROM cap WHERE {_hostname('url')} IN (SELECT h FROM o WHERE h IS NOT NULL)",
    "unique_folders": f"""WITH {_COL}, f AS (SELECT collection_id, added_at, 'Lib/' || left(collection_name, 1) AS folder FROM named), n AS (SELECT *, row_number() OVER (PARTITION BY lower(folder) ORDER BY added_at NULLS LAST, collection_id) AS k FROM f)
      SELECT collection_id, folder || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS folder FROM n""",
    "collections_normalized": f"WITH {_COL} SELECT collection_id, collection_name, collection_type, {_FOLDER} AS folder, len(urls) AS n_urls, {_KIND('coalesce(web_url, source_url)')} AS url_type FROM named",
    "inventory_pages": f"""WITH {SNAP}, u AS (SELECT collection_id, unnest(pages) AS p, generate_subscripts(pages, 1) AS pos FROM latest), k AS (SELECT collection_id, p, {_IDENTITY} AS page_key FROM u WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection_id, page_key ORDER BY pos) = 1),
      l AS (SELECT *, {_trimmed("regexp_replace(regexp_replace(url_decode(regexp_extract(" + _path('p.url') + ", '([^/]+)/?$', 1)), '(?i)\\.[a-z0-9]+$', ''), '[-_]+', ' ', 'g')")} AS words FROM k WHERE page_key IS NOT NULL)
      SELECT collection_id, page_key, coalesce(nullif({_trimmed('p.title')}, ''), nullif(words, ''), {_hostname('p.url')}, p.url) AS title, {_DAY.format(c='p.modified')} AS modified_day FROM l""",
    "page_state": f"""WITH {CAP}, {CLIP}, s AS (SELECT DISTINCT {_canonical('u')} AS k FROM (SELECT unnest(urls) AS u FROM collections)), n AS (SELECT {_canonical('url')} AS k, coalesce(nullif(preview_fingerprint, ''), content_fingerprint) AS fp FROM clip WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_canonical('url')} ORDER BY clipped DESC NULLS LAST, clip_id) = 1),
      p AS (SELECT capture_id, {_canonical('url')} AS k, {_fnv(_fingerprint_form('markdown'))} AS now FROM cap WHERE markdown IS NOT NULL)
      SELECT capture_id, CASE WHEN n.k IS NOT NULL AND coalesce(n.fp, '') <> '' THEN CASE WHEN n.fp = now THEN 'current' ELSE 'changed' END WHEN s.k IS NOT NULL THEN 'stored' WHEN n.k IS NOT NULL THEN 'known' ELSE 'unknown' END AS state FROM p LEFT JOIN n ON n.k = p.k LEFT JOIN s ON s.k = p.k""",
    "inventory_csv_lines": "SELECT array_to_string([" + ", ".join(rf"""CASE WHEN regexp_matches({c}, '[",\r\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END""" for c in ("collection_name", "collection_type", "discovery_method", "collection_url", "page_title", "page_url", "modified", "last_refreshed")) + "], ',') AS line FROM (" + SQL["collection_inventory_csv"] + ")",
    "aggregate_documents": f"""WITH {CAP}, r AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY capture_id) AS n, coalesce(nullif(title, ''), url) AS name, url, markdown FROM cap WHERE job_id IS NOT NULL),
      l AS (SELECT job_id, n, '- [' || replace(name, ']', '\\]') || '](#' || regexp_replace(trim(regexp_replace(lower(n || '. ' || name), '[^A-Za-z0-9_\\s-]', '', 'g'), {_TRIM}), '\\s+', '-', 'g') || ')' AS toc, '## ' || n || '. ' || name || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || trim(coalesce(markdown, ''), ' ') || chr(10) || chr(10) || '---' || chr(10) AS section FROM r),
      d AS (SELECT job_id, '# Site export' || chr(10) || chr(10) || count(*) || CASE WHEN count(*) = 1 THEN ' page.' ELSE ' pages.' END || chr(10) || chr(10) || '## Contents' || chr(10) || chr(10) || coalesce(string_agg(toc, chr(10) ORDER BY n), '') || chr(10) || chr(10) || coalesce(string_agg(section, chr(10) ORDER BY n), '') AS t FROM l GROUP BY 1)
      SELECT job_id, trim(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\n+$', ''), ' ') || chr(10) AS content FROM d""",
}
_SPACES = r"[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _normal(c: str) -> str:
    """Normalized Markdown."""
    t = rf"replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), chr(160), ' ')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '')"
    return rf"regexp_replace(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_LEAD = r"'^((?:[ \t]*(?:!\[[^\n]*|-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*)?[ \t]*\n)*)(#{1,6}[ \t]+[^\n]*)(?:\n|$)'"
_ONE_SPACE = lambda c: rf"trim(regexp_replace(lower({c}), '{_SPACES}+', ' ', 'g'))"
SQL |= {
    "composed_documents": rf"""WITH front AS ({SQL["front_matter"]}), cap AS (SELECT DISTINCT ON (capture_id) * FROM captures ORDER BY capture_id, ingested_at),
      n AS (SELECT capture_id, regexp_replace(regexp_replace(coalesce(title, ''), '^#+{_SPACES}*', ''), '^{_SPACES}+|{_SPACES}+$', '', 'g') AS heading, {_normal("coalesce(markdown, '')")} AS md FROM cap),
      l AS (SELECT *, regexp_extract(md, {_LEAD}, 0) AS lead, regexp_extract(md, {_LEAD}, 1) AS ahead, regexp_replace(regexp_extract(md, {_LEAD}, 2), '^#{{1,6}}[ \t]+', '') AS own FROM n),
      b AS (SELECT capture_id, heading, CASE WHEN lead <> '' AND heading <> '' AND {_ONE_SPACE('own')} = {_ONE_SPACE('heading')} THEN ahead || substring(md, length(lead) + 1) ELSE md END AS body FROM l)
      SELECT capture_id, {_normal("concat_ws(chr(10) || chr(10), nullif(front_matter, ''), CASE WHEN heading <> '' THEN '# ' || heading END, nullif(body, ''))")} || chr(10) AS content FROM b JOIN front USING (capture_id)""",
}
