"""The core queries in DuckDB SQL, written from the operators' definitions and independently of their plans."""

from __future__ import annotations

NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
LINES = r"list_filter(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x, i: i < len(regexp_split_to_array(text, '\r\n|[\n\r]')) OR x <> '')"

ORACLES: dict[str, str] = {}

_LINES = f"""
l AS (SELECT doc_id, unnest(generate_series(1, len({LINES}))) AS n, {LINES} AS a FROM documents WHERE text <> ''),
r AS (SELECT doc_id, n, a[n] AS line, {NORM.format('a[n]')} AS clean FROM l)"""

ORACLES["line_numbering"] = f"WITH {_LINES} SELECT doc_id, n::BIGINT AS line_no, md5(line) AS line_md5 FROM r"

_SECTIONS = f"""{_LINES},
h AS (SELECT *, length(clean) <= 20 AND clean <> '' AS head FROM r),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM h),
s AS (SELECT doc_id, grp, coalesce(max(CASE WHEN head THEN clean END), 'pembuka') AS heading, min(n) FILTER (NOT head) AS start_line, max(n) AS end_line,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), ''), '^\\s+|\\s+$', '', 'g') AS body FROM g GROUP BY doc_id, grp HAVING count(*) FILTER (NOT head) > 0),
o AS (SELECT g.doc_id, max(g.n) AS n, arg_max(g.clean, g.n) FILTER (g.head) AS last FROM g WHERE g.doc_id NOT IN (SELECT doc_id FROM s) GROUP BY g.doc_id),
a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS idx, heading, body, start_line, end_line FROM s
  UNION ALL SELECT doc_id, 1, last, '', n + 1, n FROM o
  UNION ALL SELECT doc_id, 1, 'pembuka', '', 1, 1 FROM documents WHERE coalesce(text, '') = '')"""

ORACLES["section_split"] = f"WITH {_SECTIONS} SELECT doc_id, idx::BIGINT AS idx, heading, length(body)::BIGINT AS chars, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM a"
ORACLES["section_slug_counts"] = f"""WITH {_SECTIONS}
SELECT CASE WHEN trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'section' ELSE trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') END AS slug, count(*)::BIGINT AS n FROM a GROUP BY 1"""

ORACLES["whitespace_normalize"] = f"SELECT doc_id, md5({NORM.format('text')}) AS text_md5, length({NORM.format('text')})::BIGINT AS chars FROM documents"

ORACLES["number_extract_all"] = r"""
WITH f AS (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '[0-9]{4,}') AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS number, unnest(generate_series(1, len(a))) AS i FROM f),
d AS (SELECT doc_id, number, min(i) AS i FROM e GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS pos, number FROM d"""

ORACLES["ordered_distinct"] = f"""
WITH w AS (SELECT doc_id, string_split({NORM.format('text')}, ' ') AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS word, unnest(generate_series(1, len(a))) AS i FROM w),
d AS (SELECT doc_id, arg_min(word, i) AS word, min(i) AS i FROM e GROUP BY doc_id, lower(word))
SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS words_md5, count(*)::BIGINT AS n FROM d GROUP BY doc_id"""

ORACLES["outcome_rules"] = """
SELECT CASE event_type WHEN 'purchase' THEN 'granted_partly' WHEN 'click' THEN 'rejected' WHEN 'view' THEN 'inadmissible' WHEN 'signup' THEN 'withdrawn' ELSE 'unknown' END AS outcome_key, count(*)::BIGINT AS n FROM events GROUP BY 1"""

ORACLES["roman_numerals"] = """
WITH RECURSIVE sym(v, s) AS (VALUES (1000, 'M'), (900, 'CM'), (500, 'D'), (400, 'CD'), (100, 'C'), (90, 'XC'), (50, 'L'), (40, 'XL'), (10, 'X'), (9, 'IX'), (5, 'V'), (4, 'IV'), (1, 'I')),
src AS (SELECT n_nationkey AS k, n_nationkey * 161 + 1 AS a, n_nationkey + 1 AS b FROM nation),
step(n, rest, out) AS (SELECT x, x, '' FROM (SELECT a AS x FROM src UNION SELECT b FROM src)
  UNION ALL SELECT n, rest - (SELECT max(v) FROM sym WHERE v <= rest), out || (SELECT arg_max(s, v) FROM sym WHERE v <= rest) FROM step WHERE rest > 0),
done AS (SELECT n, out FROM step WHERE rest = 0)
SELECT k::BIGINT AS sequence, x.out AS roman, b || '/PUU-' || y.out || '/' || (k + 2003) AS case_number, b || '_PUU-' || y.out || '_' || (k + 2003) AS slug
FROM src JOIN done x ON x.n = a JOIN done y ON y.n = b"""

ORACLES["party_names"] = "SELECT c_custkey, trim(c_name, ' ,;:-.') AS name FROM customer"

ORACLES["date_display"] = """
SELECT o_orderkey, day(o_orderdate) || ' ' || ['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli', 'Agustus', 'September', 'Oktober', 'November', 'Desember'][month(o_orderdate)] || ' ' || year(o_orderdate) AS shown,
strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders"""

ORACLES["search_filter"] = "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'the') AND contains(lower(text), 'tion')"

ORACLES["search_rank"] = """
WITH h AS (SELECT doc_id, n_chars, contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'que')::INT AS t,
  contains(lower(source), 'the')::INT + contains(lower(source), 'tion')::INT + contains(lower(source), 'que')::INT AS s,
  contains(lower(lang), 'the')::INT + contains(lower(lang), 'tion')::INT + contains(lower(lang), 'que')::INT AS l FROM documents)
SELECT doc_id, (s * 50 + l * 35 + t + CASE WHEN s = 3 THEN 50 ELSE 0 END + CASE WHEN l = 3 THEN 35 ELSE 0 END + CASE WHEN t = 3 THEN 1 ELSE 0 END)::BIGINT AS relevance, n_chars
FROM h ORDER BY relevance DESC, n_chars DESC, doc_id"""

ORACLES["search_excerpt"] = f"""
WITH n AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents WHERE contains(lower(text), 'tion')),
p AS (SELECT doc_id, t, greatest(CASE WHEN strpos(lower(t), 'tion') > 0 THEN strpos(lower(t), 'tion') - 1 ELSE 0 END - 75, 0) AS a FROM n)
SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(t, a + 1, 240) || CASE WHEN length(t) > a + 240 THEN '…' ELSE '' END AS excerpt FROM p"""

ORACLES["best_match_field"] = """
WITH c AS (SELECT doc_id, 50 AS w, 'source' AS label, source || ' the' AS t FROM documents UNION ALL SELECT doc_id, 35, 'lang', lang FROM documents UNION ALL SELECT doc_id, 1, 'text', text FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, label DESC, t DESC) AS k FROM c WHERE contains(lower(t), 'the')),
p AS (SELECT doc_id, label, t, greatest(strpos(lower(t), 'the') - 76, 0) AS a FROM b WHERE k = 1)
SELECT doc_id, label AS match_label, md5(CASE WHEN a > 0 THEN '…' ELSE '' END || substr(t, a + 1, 240) || CASE WHEN length(t) > a + 240 THEN '…' ELSE '' END) AS excerpt_md5 FROM p"""

ORACLES["search_reference"] = """
SELECT o_orderkey, (o_orderkey % 49 + 1) || '/PUU-' || ['XVIII', 'XIX', 'XX', 'XXI', 'XXII', 'XXIII'][o_orderkey % 6 + 1] || '/' || (2020 + o_orderkey % 6) AS case_number
FROM orders WHERE o_orderkey % 49 = 6 AND o_orderkey % 6 = 3"""

ORACLES["sort_newest_nulls_last"] = """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS decision_date FROM orders)
SELECT o_orderkey, decision_date FROM d ORDER BY decision_date IS NULL, decision_date DESC, CASE WHEN decision_date IS NOT NULL THEN o_orderkey::VARCHAR END DESC, o_orderkey"""

ORACLES["page_20"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40"

_FLAT = """
flat AS (SELECT d.doc_id, d.lang AS document_type, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'ok' ELSE 'partial' END AS status,
  list_filter([CASE WHEN n_chars < 300 THEN 'too_short' END, CASE WHEN n_chars > 10000 THEN 'too_long' END, CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS review_flags,
  d.source AS topic, substr(n_chars::VARCHAR, 1, 1) AS year, d.doc_id || '.json' AS file_name, CASE WHEN toxic = 1 THEN ['parties', 'outcome'] ELSE [] END AS failed_extractors
  FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT *, len(review_flags) > 0 AS needs_manual_review FROM flat)"""

ORACLES["flag_counts"] = f"WITH {_FLAT}, e AS (SELECT doc_id, unnest(review_flags) AS flag FROM f) SELECT flag, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM e GROUP BY flag ORDER BY n DESC, first_doc"
ORACLES["route_split"] = f"WITH {_FLAT} SELECT CASE WHEN needs_manual_review THEN 'review_queue' ELSE 'validated' END AS route, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM f GROUP BY 1"

_FACETS = """
SELECT 'status' AS facet, coalesce(status, 'unknown') AS value, lang FROM {0} UNION ALL SELECT 'document_type', document_type, lang FROM {0} UNION ALL SELECT 'total', '', lang FROM {0}
UNION ALL SELECT 'needs_review', '', lang FROM {0} WHERE needs_manual_review UNION ALL SELECT 'year', year, lang FROM {0} WHERE year <> '' UNION ALL SELECT 'review_flag', unnest(review_flags), lang FROM {0} UNION ALL SELECT 'topic', topic, lang FROM {0}"""
ORACLES["facets"] = f"WITH {_FLAT}, x AS (SELECT *, document_type AS lang FROM f), u AS ({_FACETS.format('x')}) SELECT facet, value, count(*)::BIGINT AS n FROM u GROUP BY 1, 2"
ORACLES["facets_vs_stats"] = f"WITH {_FLAT}, x AS (SELECT *, document_type AS lang FROM f), u AS ({_FACETS.format('x')}) SELECT facet, value, count(*)::BIGINT AS facet_n, (count(*) FILTER (lang = 'en'))::BIGINT AS stat_n FROM u GROUP BY 1, 2"

ORACLES["related_topk"] = """
WITH t AS (SELECT c_custkey, unnest(['n-' || c_nationkey || '-' || c_mktsegment, 'b' || floor(c_acctbal / 10)::BIGINT]) AS topic FROM customer),
s AS (SELECT x.c_custkey, y.c_custkey AS other, string_agg(x.topic, ', ' ORDER BY x.topic) AS common FROM t x JOIN t y USING (topic) WHERE x.c_custkey <> y.c_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY other DESC) AS rank FROM s)
SELECT c_custkey, rank::BIGINT AS rank, other, common FROM r WHERE rank <= 3"""

_COUNTS = """SELECT '{1}' AS stage, 'status' AS kind, coalesce(status, 'unknown') AS value FROM {0} UNION ALL SELECT '{1}', 'document_type', document_type FROM {0} UNION ALL SELECT '{1}', 'file_count', '' FROM {0}
UNION ALL SELECT '{1}', 'review_flag', unnest(review_flags) FROM {0} UNION ALL SELECT '{1}', 'failed_extractor', unnest(failed_extractors) FROM {0}"""
ORACLES["directory_summary"] = f"WITH {_FLAT}, u AS ({_COUNTS.format('f', 'parsed')}) SELECT stage, kind, value, count(*)::BIGINT AS n FROM u GROUP BY 1, 2, 3"
ORACLES["stage_report"] = f"""WITH {_FLAT}, v AS (SELECT * FROM f WHERE NOT needs_manual_review), q AS (SELECT * FROM f WHERE needs_manual_review),
u AS ({_COUNTS.format('f', 'parsed')} UNION ALL {_COUNTS.format('v', 'validated')} UNION ALL {_COUNTS.format('q', 'review_queue')}) SELECT stage, kind, value, count(*)::BIGINT AS n FROM u GROUP BY 1, 2, 3"""
ORACLES["listed_files"] = f"WITH {_FLAT} SELECT 'needing_review' AS list, file_name FROM f WHERE needs_manual_review UNION ALL SELECT 'failed', file_name FROM f WHERE status = 'failed'"
ORACLES["run_counters"] = "SELECT (count(*) FILTER (quality = 1))::BIGINT AS processed, (count(*) FILTER (quality <> 1))::BIGINT AS review, 0::BIGINT AS failed, (count(*) FILTER (quality IS NULL))::BIGINT AS skipped FROM documents LEFT JOIN labels USING (doc_id)"

ORACLES["display_compact"] = f"""
WITH t AS (SELECT conv_id, turn, {NORM.format("text")} AS t FROM conversations),
d AS (SELECT conv_id, lower(t) AS k, arg_min(t, turn) AS t, min(turn) AS turn FROM t WHERE t <> '' GROUP BY 1, 2),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (length(t) <= 50) AS fine FROM d GROUP BY 1)
SELECT c.conv_id, (coalesce(n, 0) - least(coalesce(fine, 0), 2))::BIGINT AS hidden, least(coalesce(fine, 0), 2)::BIGINT AS n_shown FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id)"""

ORACLES["corrections"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderpriority IS DISTINCT FROM '0-NEW' THEN '0-NEW' END AS priority, NULL::VARCHAR AS status FROM orders"

ORACLES["manifest_check"] = """
WITH k AS (SELECT s_suppkey, s_suppkey - CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS number FROM supplier), c AS (SELECT number, count(*) AS n FROM k GROUP BY 1)
SELECT s_suppkey, array_to_string(list_filter([CASE WHEN n > 1 THEN 'identity' END, CASE WHEN s_suppkey % 7 = 0 THEN 'url' END, CASE WHEN s_suppkey % 11 = 0 THEN 'file name' END, CASE WHEN s_suppkey % 13 = 0 THEN 'sha256' END], lambda x: x IS NOT NULL), ',') AS errors FROM k JOIN c USING (number)"""

ORACLES["content_hash_dedupe"] = """
SELECT sha256(text) AS hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL) GROUP BY 1"""
ORACLES["inbox_antijoin"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"

ORACLES["source_priority"] = """
WITH f AS (SELECT n_chars, doc_id, 'src' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 3) AS source FROM documents),
r AS (SELECT n_chars % 97 AS key, source, doc_id, row_number() OVER (PARTITION BY n_chars % 97 ORDER BY list_position(['src2', 'src0', 'src1'], source), lpad(doc_id::VARCHAR, 8, '0')) AS k FROM f)
SELECT key, source, doc_id FROM r WHERE k = 1"""

ORACLES["overlay_merge"] = """
SELECT coalesce(b.doc_id, e.doc_id) AS doc_id, coalesce(CASE WHEN e.quality = 1 THEN 1 END, CASE WHEN b.doc_id IS NOT NULL THEN 0 END, -1)::BIGINT AS quality, coalesce(e.toxic, CASE WHEN b.doc_id IS NOT NULL THEN 0 END, -1)::BIGINT AS toxic,
b.source, e.doc_id IS NOT NULL AS overlaid, b.doc_id IS NULL AS added FROM (SELECT doc_id * 2 AS doc_id, source FROM documents) b FULL JOIN labels e ON b.doc_id = e.doc_id"""

ORACLES["last_wins_manifest"] = r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^/]*//[^/]*/[^/]*)', 1) AS p FROM pages),
k AS (SELECT page_id, url, lower(regexp_extract(p, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(p, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '?' AS place FROM u)
SELECT place, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM k GROUP BY 1"""


ORACLES["universal_semi_join"] = """
SELECT DISTINCT conv_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND NOT EXISTS (SELECT 1 FROM labels d WHERE d.doc_id = e.conv_id * 7 + e.turn * 3))"""

ORACLES["story_entries"] = """
WITH s AS (SELECT doc_id % 300 AS case_number, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1)
SELECT conv_id, turn, conv_id + turn AS case_number, lang FROM conversations JOIN s ON s.case_number = conv_id + turn"""

ORACLES["story_neighbors"] = """
SELECT conv_id, turn, (row_number() OVER w)::BIGINT AS number, (count(*) OVER (PARTITION BY conv_id))::BIGINT AS entries, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""

ORACLES["chapter_counts"] = """
SELECT c.conv_id, chapter, count(e.role)::BIGINT AS n FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (VALUES ('user'), ('assistant'), ('epilogue')) g(chapter) LEFT JOIN conversations e ON e.conv_id = c.conv_id AND e.role = chapter GROUP BY 1, 2"""

ORACLES["vote_tally"] = "SELECT c.conv_id, CASE WHEN p.role IN ('user', 'assistant') THEN p.role ELSE 'unverified' END AS position, count(*)::BIGINT AS n FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn GROUP BY 1, 2"

ORACLES["orphan_gc"] = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id * 2 = d.doc_id)"

ORACLES["party_dedupe"] = """
WITH n AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) ELSE c_mktsegment END || ' ' || (c_custkey % 3) AS name FROM customer),
d AS (SELECT c_nationkey, arg_min(name, c_custkey) AS name, min(c_custkey) AS k FROM n GROUP BY c_nationkey, lower(name))
SELECT c_nationkey::BIGINT AS c_nationkey, string_agg(name, '; ' ORDER BY k) AS names FROM d GROUP BY 1"""

ORACLES["revision_log"] = "SELECT user_id AS id, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'signup'"

ORACLES["save_conflicts"] = """
WITH c AS (SELECT s_suppkey + 1 AS id, s_suppkey % 2 AS revision, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE s_name || 'x' END AS name FROM supplier)
SELECT c.id, 'stale' AS reason FROM c LEFT JOIN supplier s ON s.s_suppkey = c.id WHERE coalesce(s.s_suppkey % 3, 0) <> c.revision
UNION ALL SELECT DISTINCT c.id, 'duplicate' FROM c JOIN supplier s ON s.s_name = c.name AND s.s_suppkey <> c.id"""

ORACLES["target_resolution"] = """
WITH o AS (SELECT 'old' || (s_suppkey % 20) AS n, min('case-' || s_suppkey) AS c, count(DISTINCT s_suppkey) AS m FROM supplier GROUP BY 1)
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 6 = 0 AND a.s_suppkey IS NOT NULL THEN 'case-' || p_partkey END, CASE WHEN p_partkey % 4 = 0 AND a.s_suppkey IS NOT NULL THEN 'case-' || p_partkey END, o.c) AS target,
CASE WHEN a.s_suppkey IS NOT NULL AND (p_partkey % 6 = 0 OR p_partkey % 4 = 0) THEN 1 ELSE coalesce(o.m, 0) END::BIGINT AS candidates
FROM part LEFT JOIN supplier a ON a.s_suppkey = p_partkey LEFT JOIN o ON o.n = 'old' || (p_partkey % 40)"""

ORACLES["new_entries"] = "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus)"

ORACLES["import_batch"] = """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 OR p_partkey // 2 NOT IN (SELECT c_custkey FROM customer) THEN 'missing file' WHEN p_partkey % 7 = 0 THEN 'checksum' WHEN p_partkey % 11 = 0 THEN 'case number' ELSE '' END AS reason FROM part"""

ORACLES["archive_names"] = """
WITH t AS (SELECT 'Brand#' || c_nationkey AS p_brand, count(*) AS n FROM customer GROUP BY 1),
k AS (SELECT p_partkey, p.p_brand, row_number() OVER (PARTITION BY p.p_brand ORDER BY p_partkey) + coalesce(n, 0) AS k FROM part p LEFT JOIN t ON t.p_brand = p.p_brand)
SELECT p_partkey, CASE WHEN k = 1 THEN p_brand || '.pdf' ELSE p_brand || '__' || k || '.pdf' END AS archived_name FROM k"""

_STRIP = "html"
for _pattern, _by in [
    (r"(?is)<script.*?>.*?</script>", "chr(10)"), (r"(?is)<style.*?>.*?</style>", "chr(10)"), (r"(?s)<!--.*?-->", "chr(10)"), (r"(?is)</t[dh]>\s*<t[dh][^>]*>", "' : '"), (r"(?is)</tr>", "chr(10)"),
    (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|tr|td|th|li|ul|ol|h[1-6]|table|section)>", "chr(10)"), (r"(?s)<[^>]+>", "' '"),
]:
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', {_by}, 'g')"
ORACLES["html_lines"] = f"""
WITH s AS (SELECT page_id, {_STRIP} AS t FROM pages), l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r]'), lambda x: {NORM.format('x')}), lambda x: x <> '') AS a FROM s)
SELECT page_id, length(coalesce(array_to_string(a, chr(10)), ''))::BIGINT AS chars, len(a)::BIGINT AS lines FROM l"""

ORACLES["html_links"] = rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)[^>]*>.*?</a\s*>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)[^>]*>.*?</a\s*>'), 1) AS i FROM pages),
f AS (SELECT page_id, i, trim(regexp_extract(a, '(?is)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '"''') AS href, {NORM.format(r"regexp_replace(regexp_extract(a, '(?is)^<a\b[^>]*>(.*)</a\s*>$', 1), '(?s)<[^>]+>', '', 'g')")} AS title FROM a)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS pos, href, title FROM f WHERE title <> ''"""

ORACLES["link_categories"] = "SELECT CASE WHEN contains(url, '/de/') THEN 'decision' WHEN contains(lower(replace(url, '/fr/', '/audio/')), 'audio') THEN 'hearing_audio' ELSE 'other' END AS category, count(*)::BIGINT AS n FROM pages GROUP BY 1"

ORACLES["url_canonical"] = r"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '?' || array_to_string(list_sort(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')), '&') AS url_key,
nullif(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '') AS file_name FROM pages"""

_SCAN = """
o AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'miss' WHEN 'error' THEN 'stop' ELSE 'hit' END AS outcome FROM events),
h AS (SELECT *, row_number() OVER w AS n, sum((outcome = 'hit')::INT) OVER w AS hits FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, sum((outcome = 'miss')::INT) OVER (PARTITION BY user_id, hits ORDER BY event_id) AS misses FROM h),
e AS (SELECT user_id, min(n) AS stop FROM m WHERE misses >= 2 OR outcome = 'stop' GROUP BY 1),
s AS (SELECT user_id, event_id, outcome, misses::BIGINT AS misses FROM m LEFT JOIN e USING (user_id) WHERE n <= least(coalesce(stop, 40), 40))"""
ORACLES["miss_run_scan"] = f"WITH {_SCAN} SELECT user_id, event_id, outcome, misses FROM s"
ORACLES["scan_checkpoint"] = f"WITH {_SCAN} SELECT user_id, max(event_id) AS last_checked, max(event_id) + 1 AS next, arg_max(misses, event_id) AS consecutive_misses FROM s GROUP BY 1"
ORACLES["inbox_stream_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"

ORACLES["ingest_replay"] = """
WITH d AS (SELECT sha256(coalesce(text, '')) AS hash, coalesce(text, '') AS text, lang FROM documents)
SELECT hash, CASE WHEN bool_or(lang IN ('en', 'de')) THEN 'a' ELSE 'b' END AS batch, CASE WHEN max(length(text)) > 0 THEN 'processed' ELSE 'failed' END AS status, 1::BIGINT AS records FROM d GROUP BY 1"""

ORACLES["save_conflicts_in_batch"] = """
SELECT p_partkey AS id, 'duplicate' AS reason FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size, p_type) AS n FROM part) WHERE n > 1"""

ORACLES["publish_drafts"] = """
WITH u AS (SELECT c_custkey AS n, s_suppkey AS s FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
d AS (SELECT n, s, coalesce(s % 3, 0)::BIGINT AS revision, CASE WHEN s IS NOT NULL THEN 'case-' || s END AS target FROM u WHERE NOT (n % 7 = 0 AND s IS NULL)),
f AS (SELECT *, 'Supplier#' || substr(n::VARCHAR, 1, 1) AS case_number, CASE WHEN starts_with(coalesce(target, sha256_case), 'case-1') THEN 'own' WHEN s IS NOT NULL THEN 'e' || s END AS edits
  FROM (SELECT *, 'case-' || substr(sha256('h' || n || '/d' || n), 1, 32) AS sha256_case FROM d))
SELECT 'd' || n AS draft_id, CASE WHEN revision + length(edits) > 0 THEN coalesce(target, sha256_case) END AS target, revision, case_number, edits, '' AS error FROM f
UNION ALL SELECT 'd' || n, NULL, NULL, NULL, NULL, 'unknown target' FROM u WHERE n % 7 = 0 AND s IS NULL"""

_VERDICTS = """
v AS (SELECT s_suppkey, s_suppkey AS k, s_name, CASE s_suppkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Menolak ' || repeat('x', 160) WHEN 3 THEN 'MENGABULKAN ' || s_name WHEN 4 THEN 'MENGABULKAN ' || s_name WHEN 5 THEN 'MENGABULKAN ' || s_name ELSE s_name END AS summary FROM supplier),
r AS (SELECT *, list_filter([
  CASE WHEN k % 5 < 3 THEN 'too_few_sections_detected' END, CASE WHEN k % 9 = 0 THEN 'decision_date_missing' END, CASE WHEN k % 3 = 0 THEN 'judges_not_extracted' END, CASE WHEN k % 5 = 0 THEN 'applicants_missing' END, CASE WHEN k % 5 = 1 THEN 'applicant_count_high' END,
  CASE WHEN k % 6 > 4 THEN 'respondent_count_high' END, CASE WHEN k % 11 > 8 THEN 'legal_counsel_count_high' END, CASE WHEN k % 7 > 5 THEN 'expert_count_high' END, CASE WHEN k % 7 > 5 THEN 'witness_count_high' END, CASE WHEN k % 5 > 3 THEN 'amicus_count_high' END,
  CASE WHEN k % 5 > 1 AND k % 6 = 0 THEN 'applicants_contains_empty_name' WHEN k % 5 > 1 AND k % 6 = 1 THEN 'applicants_contains_very_long_name' WHEN k % 5 > 1 AND k % 6 = 2 THEN 'applicants_contains_suspicious_text' END,
  CASE WHEN trim(coalesce(summary, '')) = '' THEN 'outcome_summary_missing' END, CASE WHEN k % 8 > 5 THEN 'outcome_summary_not_in_amar_style' END, CASE WHEN k % 3 = 1 AND k % 8 = 2 THEN 'outcome_summary_too_long' END,
  CASE WHEN k % 4 = 0 THEN 'constitutional_articles_missing_for_putusan' END], lambda x: x IS NOT NULL) AS flags,
  list_filter([CASE WHEN k % 13 = 0 THEN 'document.case_number is required by business rules' END, CASE WHEN k % 5 = 0 AND k % 11 = 0 AND k % 6 = 0 AND k % 7 = 0 THEN 'at least one party or participant should be detected' END,
  CASE WHEN k % 3 = 0 THEN 'outcome.dictum should not be empty' END], lambda x: x IS NOT NULL) AS errors FROM v)"""
ORACLES["review_flags"] = f"WITH {_VERDICTS} SELECT s_suppkey, array_to_string(flags, ',') AS flags, array_to_string(errors, ',') AS errors, len(flags) + len(errors) > 0 AS needs_manual_review FROM r"
ORACLES["catalog_summary"] = f"""
WITH {_VERDICTS}, l AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'UU 1' ELSE '' END AS law, CASE WHEN k % 13 > 0 THEN s_name ELSE '' END AS number FROM r)
SELECT 'c' || k AS case_id, CASE WHEN k % 4 = 2 THEN 'Judul ' || number WHEN law <> '' THEN law ELSE 'Perkara ' || CASE WHEN number <> '' THEN number ELSE 'c' || k END END AS title, law, CASE WHEN k % 9 > 0 THEN '2020' ELSE '' END AS year,
summary AS description, CASE WHEN len(flags) + len(errors) > 0 THEN 'partial' ELSE 'ok' END AS status, len(flags) + len(errors) > 0 AS needs_manual_review, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 16 ELSE 1 END::INTEGER AS applicant_count,
CASE WHEN k % 8 = 2 THEN 'rejected' WHEN k % 8 IN (3, 4, 5) THEN 'granted' ELSE 'unknown' END AS outcome_key, 'c' || k || '.json' AS file_name FROM l"""

ORACLES["ruling_facts"] = """
WITH c AS (SELECT c_custkey AS k, c_name, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment, c_mktsegment, c_custkey % 20 + 2004 AS year FROM customer),
x AS (SELECT *, (k % 200 + 1) || '/PUU-' || ['II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX', 'XXI'][k % 20 + 1] || '/' || year AS number,
  (k % 7 + 300) || '/PUU-XVII/2019' AS cited, CASE WHEN k % 2 = 0 THEN 'Menolak' ELSE 'Mengabulkan' END || ' permohonan ' || segment || ';' AS verdict FROM c)
SELECT k AS c_custkey, 'putusan' AS document_type, 'PUU' AS case_type, number AS case_number, 'PUTUSAN' AS title, printf('%04d-%02d-%02d', year, k % 12 + 1, k % 28 + 1) AS decision_date,
c_name || CASE WHEN k % 3 = 0 THEN '' ELSE '; Ibu ' || c_mktsegment END AS applicants, 'Budi ' || segment || ', S.H; Siti Aminah' AS counsels, 'DPR; Pemerintah' AS respondents,
'Undang-Undang Nomor ' || (k % 30 + 1) || ' Tahun 2010 tentang Hal ' || (k % 30 + 1) AS objects, 'Pasal ' || (k % 5 + 20) || ' ayat (1)' AS constitutional, 'Pasal ' || (k % 30 + 1) AS procedural,
'BUKTI P-' || (k % 30 + 1) || '; REFERENSI:' || number || '; REFERENSI:' || cited AS evidence, 'mendengar keterangan ahli; sidang pleno; Mendengar keterangan ahli dalam sidang pleno.' AS proceedings,
verdict || '; Memerintahkan pemuatan putusan ini.' AS dictum, verdict AS summary, 'Andi Wijaya; Rina ' || CASE WHEN k % 4 = 0 THEN 'H' ELSE 'K' END || 'artono' AS judges, 'Dewi Lestari' AS clerks, number || '; ' || cited AS cases,
8::BIGINT AS n_sections, 'ok' AS status, '' AS flags FROM x"""

#: The entities that the pages hold; ``&amp`` may lack its end.
_DECODED = "replace(replace(replace(replace(regexp_replace({}, '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), chr(1), '&')"
ORACLES["html_strip"] = f"""
WITH s AS (SELECT page_id, {_DECODED.format(_STRIP)} AS t FROM pages), l AS (SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r]'), lambda x: {NORM.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM s)
SELECT page_id, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM l"""
ORACLES["page_link_table"] = f"""
WITH a AS ({ORACLES['html_links']}), d AS (SELECT page_id, pos, {NORM.format(_DECODED.format('title'))} AS title, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || href AS url, href FROM a JOIN pages USING (page_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, lower(title) ORDER BY pos) AS k FROM d WHERE title <> '')
SELECT page_id, pos, title, url, 'other' AS category, ltrim(href, '/') AS file_name FROM f WHERE k = 1"""

def _scan_after(run: int) -> str:
    """The common tables of one more run of the scan: it looks at what comes after the run before."""
    seen = f"SELECT user_id, max(event_id) AS last FROM s{run - 1} GROUP BY 1" if run > 1 else "SELECT DISTINCT user_id, -1 AS last FROM events"
    return f"""
l{run} AS ({seen}),
h{run} AS (SELECT user_id, event_id, outcome, row_number() OVER w AS n, sum((outcome = 'hit')::INT) OVER w AS hits FROM o JOIN l{run} USING (user_id) WHERE event_id > last WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m{run} AS (SELECT *, sum((outcome = 'miss')::INT) OVER (PARTITION BY user_id, hits ORDER BY event_id) AS misses FROM h{run}),
e{run} AS (SELECT user_id, min(n) AS stop FROM m{run} WHERE misses >= 2 OR outcome = 'stop' GROUP BY 1),
s{run} AS (SELECT user_id, event_id, outcome, misses::BIGINT AS misses FROM m{run} LEFT JOIN e{run} USING (user_id) WHERE n <= least(coalesce(stop, 40), 40))"""


ORACLES["sync_and_ingest"] = f"""
WITH o AS (SELECT user_id, event_id, props, CASE event_type WHEN 'view' THEN 'miss' WHEN 'error' THEN 'stop' ELSE 'hit' END AS outcome FROM events),{_scan_after(1)},{_scan_after(2)},
s AS (SELECT 1 AS run, * FROM s1 UNION ALL SELECT 2, * FROM s2),
f AS (SELECT s.*, props FROM s JOIN o USING (user_id, event_id)),
r AS (SELECT props, arg_min(user_id, run || '/' || user_id || '/' || event_id) AS user_id FROM f WHERE f.outcome = 'hit' GROUP BY 1),
n AS (SELECT user_id, count(*) AS records FROM r GROUP BY 1)
SELECT user_id, max(event_id) AS last_checked, max(event_id) + 1 AS next, arg_max(misses, event_id) AS consecutive_misses, count(*) AS looked, count(*) FILTER (outcome = 'hit') AS hits,
count(*) FILTER (outcome = 'hit') AS snapshots, coalesce(any_value(records), 0) AS records FROM s LEFT JOIN n USING (user_id) GROUP BY 1"""

ORACLES["ingest_forced"] = """
WITH d AS (SELECT sha256(coalesce(text, '')) AS hash, doc_id::VARCHAR AS path, doc_id IN (SELECT doc_id FROM labels) AS again FROM documents)
SELECT hash, coalesce(min(path) FILTER (again), min(path)) AS path, CASE WHEN bool_or(again) THEN 'forced-1' ELSE 'a' END AS batch, CASE WHEN bool_or(again) THEN 2 ELSE 1 END::BIGINT AS tries FROM d GROUP BY 1"""

ORACLES["snapshot_sink"] = """
WITH a AS (SELECT n_nationkey::BIGINT AS number, n_name AS body, 'n' AS batch, 1 AS rank FROM nation UNION ALL SELECT s_suppkey, s_name, 's', 2 FROM supplier UNION ALL SELECT c_custkey, c_name, 'c', 3 FROM customer)
SELECT number, arg_min(body, rank) AS body, arg_min(batch, rank) AS batch FROM a GROUP BY 1"""

ORACLES["archive_moves"] = """
WITH f AS (SELECT *, CASE WHEN s_acctbal < 0 THEN 'failed' ELSE 'processed' END AS target FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY target, s_nationkey ORDER BY s_suppkey) + (target = 'processed')::INT AS k FROM f)
SELECT s_suppkey, target, 'n' || s_nationkey || CASE WHEN k > 1 THEN '__' || k ELSE '' END || '.txt' AS archived_name, 'moved' AS state, s_name AS content FROM n"""

def _holds(number: int, terms: tuple[str, ...]) -> str:
    tests = " AND ".join(f"(contains(lower(text), '{t}') OR contains(lower(source), '{t}'))" for t in terms)
    return f"SELECT {number}::BIGINT AS search, doc_id FROM documents WHERE {tests}"


ORACLES["indexed_search"] = " UNION ALL ".join(_holds(i, t) for i, t in enumerate((("the", "tion"), ("e", "qu", "b"), ("s", "source", "the"), ("zqxjzq",), ("ation of the", "and"))))

ORACLES["catalog_order"] = """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS decision_date FROM orders)
SELECT row_number() OVER (ORDER BY decision_date IS NULL, decision_date DESC, CASE WHEN decision_date IS NOT NULL THEN o_orderkey::VARCHAR END DESC, o_orderkey) - 1 AS position, o_orderkey, decision_date FROM d"""

ORACLES["catalog_refresh"] = """
WITH d AS (SELECT 'd' || doc_id AS key, coalesce(d.text, '') AS old, b.text AS new FROM documents d LEFT JOIN benchmark b ON item_id = doc_id WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
e AS (SELECT key, coalesce(new, old) AS text, CASE WHEN new IS NOT NULL AND new <> old THEN 2 ELSE 1 END AS made_by FROM d UNION ALL SELECT 'c' || c_custkey, c_name, 2 FROM customer)
SELECT key, length(text)::BIGINT AS chars, md5(text) AS text_md5, made_by::BIGINT AS made_by FROM e"""

ORACLES["schema_check"] = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
m AS (SELECT k, CASE WHEN k % 11 = 0 THEN ['<root>: not JSON'] ELSE list_filter([
CASE WHEN starts_with(p, '1') THEN 'title: missing required property' END, CASE s WHEN 'F' THEN 'status: value ''failed'' not in enum' WHEN 'O' THEN NULL ELSE 'status: expected string' END,
CASE WHEN k % 3 = 0 THEN 'number: expected one of [''string'', ''null'']' END, CASE WHEN k % 7 < 2 THEN 'pages: expected integer' END,
CASE WHEN k % 5 = 0 THEN 'parties: expected array' WHEN k % 5 = 1 THEN 'parties/1/name: missing required property' ELSE 'parties/0/name: expected string' END,
CASE WHEN k % 5 = 1 THEN 'parties/1/role: expected string' WHEN k % 5 > 1 THEN 'parties/1/role: missing required property' END, CASE WHEN k % 5 = 1 THEN 'parties/2: expected object' END], lambda x: x IS NOT NULL) END AS e FROM o)
SELECT k AS o_orderkey, array_to_string(e, '; ') AS errors FROM m"""

ORACLES["translate_composite"] = """
WITH p AS (SELECT p_partkey, 'brand ' || p_brand AS b, lower(p_type) AS t, p_name AS n, p_type AS o, p_size AS z FROM part),
e AS (SELECT p_partkey, ['Prepared from: ' || t || '.', t || ' · Indonesian match', 'Also about ' || b || ', ' || t || ', ' || n, b || ': ' || t || ' · ABCD', '  Remove ' || b || ': · ' || z || ' cases → ', n || ': ' || o, n || ', 5 May 2020 · Judgment', '· ' || b || ': Page ' || z || ' ↗'] AS e FROM p)
SELECT p_partkey, unnest(range(0, 8)) AS kind, unnest(e) AS english FROM e"""

ORACLES["insight_citations"] = """
WITH c AS (SELECT c_custkey AS k, c_name FROM customer),
p AS (SELECT k, 'change' AS part, unnest(CASE WHEN k % 2 <> 0 THEN [] WHEN k % 4 = 0 THEN [k % 7, k % 5] ELSE [k % 9] END) AS page, unnest(range(CASE WHEN k % 2 <> 0 THEN 0 WHEN k % 4 = 0 THEN 2 ELSE 1 END)) AS pos FROM c
UNION ALL SELECT k, 'reasoning', 2 * i, i - 1 FROM c, range(1, 6) r(i) WHERE i <= k % 4 + 1 UNION ALL SELECT k, 'thresholds', k % 11, 0 FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'positions', k % 50, i FROM c, range(2) r(i) WHERE k % 3 = 0)
SELECT k AS c_custkey, part, pos::BIGINT AS pos, page::BIGINT AS page, 'PDF hlm. ' || page AS label FROM p WHERE page <> 0"""

ORACLES["decree_facts"] = """
WITH c AS (SELECT c_custkey AS k, c_name, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment, [1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 20, 21][c_custkey % 12 + 1] AS day, c_custkey % 7 + 1 AS month, [2005, 2021, 2019][c_custkey % 3 + 1] AS year,
  ['satu', 'dua', 'tiga', 'empat', 'lima', 'enam', 'tujuh', 'sepuluh', 'sebelas', 'dua belas', 'dua puluh', 'dua puluh satu'][c_custkey % 12 + 1] || ', bulan ' || ['januari', 'februari', 'maret', 'april', 'mei', 'juni', 'juli'][c_custkey % 7 + 1] || ', tahun ' || ['dua ribu lima', 'dua ribu dua puluh satu', '2019'][c_custkey % 3 + 1] AS raw,
  CASE WHEN c_custkey % 2 = 0 THEN 'Hana' ELSE 'Rina Dewi' END AS witness FROM customer)
SELECT k AS c_custkey, 'ketetapan' AS document_type, printf('%04d-%02d-%02d', year, month, day) AS decision_date, raw AS decision_date_raw, c_name AS applicants, segment || '; ' || witness AS experts, witness AS witnesses, 'Lembaga ' || segment AS amicus_curiae,
'Pasal ' || (k % 30 + 1) AS objects, 'mendengar keterangan ahli; mendengar keterangan saksi' AS proceedings, 'Menyatakan permohonan ' || segment || ' ditarik kembali;; Memerintahkan pencatatan perkara ini.' AS dictum, 'Andi Wijaya' AS judges FROM c"""
