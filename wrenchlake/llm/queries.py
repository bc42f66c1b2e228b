"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op2_bpe_round_trip
from .decontamination import op9_benchmark_decontamination
from .hard_negatives import op12_hard_negatives
from .lm_score import op4_lm_scoring
from .near_dedup import op6_minhash_near_dedup
from .prefix_trie import op11_conversation_trie
from .quality_gam import op7_quality_classifier
from .quality_rules import op1_quality_rules
from .sharding import op10_stratified_sharding
from .substring_dedup import op5_substring_dedup
from .suffix_dedup import op3_suffix_array_dedup
from .topk_search import op13_topk_search
from .url_filter import CANONICAL, CONTENT, HREF, OG_URL, REFRESH, REFRESHED, op8_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filters": op8_url_filters,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_stratified_sharding": op10_stratified_sharding,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_topk_search": op13_topk_search,
}

ORACLE: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _part(url: str, pattern: str) -> str:
    return f"regexp_extract({_rest(url)}, '(?s){pattern}', 1)"


HOST, PATH, QUERY = "^([^/?#]*)", "^[^/?#]*([^?#]*)", "^[^?#]*(\\?[^#]*)"


def _form(url: str) -> str:
    scheme = f"regexp_extract({url}, '(?s)^(.*?)://', 1)"
    return f"CASE WHEN instr({url}, '://') > 0 THEN concat({_low(scheme)}, '://', {_low(_part(url, HOST))}, coalesce(nullif({_part(url, PATH)}, ''), '/'), {_part(url, QUERY)}) END"


def _without_dots(path: str) -> str:
    done = f"list_reduce(list_concat([''], string_split({path}, '/')[2:]), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE concat(acc, '/', s) END)"
    return f"concat({done}, CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END)"


def _resolved(t: str, page: str) -> str:
    top = f"concat(regexp_extract({page}, '(?s)^(.*?)://', 1), '://', {_part(page, HOST)})"
    bare, tail = f"regexp_extract({t}, '(?s)^([^?#]*)', 1)", f"regexp_extract({t}, '(?s)^[^?#]*(.*)', 1)"
    folder = f"concat(regexp_extract({_part(page, PATH)}, '(?s)^(.*)/', 1), '/')"
    return f"""CASE WHEN {t} = '' OR {t} LIKE '#%' OR instr({page}, '://') = 0 THEN NULL WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN {t} LIKE '//%' THEN concat(regexp_extract({page}, '(?s)^(.*?)://', 1), ':', {t}) WHEN {t} LIKE '/%' THEN concat({top}, {_without_dots(bare)}, {tail}) WHEN {t} LIKE '?%' THEN concat({top}, {_part(page, PATH)}, {t}) ELSE concat({top}, {_without_dots(f'concat({folder}, {bare})')}, {tail}) END"""


def _quoted(pattern: str) -> str:
    return "'(?is)" + pattern.replace('\\"', '"').replace("'", "''") + "'"


ORACLE["op8_url_filters"] = f"""
WITH RECURSIVE h AS (SELECT page_id, url, html, {_form('url')} AS form, coalesce({_low(_part('url', HOST))}, '') AS host, coalesce({_part('url', PATH)}, '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule FROM h),
j AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruling FROM r),
tags AS (SELECT url, form, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM h WHERE form IS NOT NULL),
targets AS (SELECT url, form, CASE WHEN regexp_matches(tag, {_quoted(CANONICAL)}) THEN regexp_extract(tag, {_quoted(HREF)}, 1) WHEN regexp_matches(tag, {_quoted(REFRESH)}) THEN regexp_extract(tag, {_quoted(REFRESHED)}, 1) WHEN regexp_matches(tag, {_quoted(OG_URL)}) THEN regexp_extract(tag, {_quoted(CONTENT)}, 1) ELSE '' END AS t FROM tags),
full_targets AS (SELECT form AS a, {_resolved('t', 'url')} AS u FROM targets),
edges AS (SELECT a, {_form('u')} AS b FROM full_targets WHERE u IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
reach AS (SELECT DISTINCT form AS a, form AS b FROM h WHERE form IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
found AS (SELECT reach.a AS form, min(CASE WHEN j.ruling = 'allow' THEN 0 ELSE 1 END) AS least FROM reach JOIN j ON j.form = reach.b AND j.ruling IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN least = 1 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN found USING (form)
"""

#: CRC-32 by its table: each entry is eight steps of the reflected polynomial.
CRC_TABLE = "table_ AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"
ORACLE["op10_stratified_sharding"] = f"""
WITH {CRC_TABLE},
bytes AS (SELECT doc_id, source, text, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, source, x, octet_length(encode(x)) + 1 AS size, xor(list_reduce(list_concat([4294967295], list_transform(range(0, CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, table_),
digests AS (SELECT *, sha256('shards-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(x)) AS digest FROM sums),
ranks AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY digest, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM digests),
places AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, digest, doc_id) - 1 AS at_, count(*) OVER () AS total FROM ranks)
SELECT doc_id, size, text_crc32, 'rows' AS law, at_ * 8 // total AS shard, at_ - CAST(ceil((at_ * 8 // total) * total / 8.0) AS BIGINT) AS slot, NULL AS grown_shard, source FROM places
"""

ORACLE["op11_conversation_trie"] = f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, any_value(s) AS s, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, role, k) AS t FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, own.t AS t, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, i, 1)))), lambda c, b: xor(table_.t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 4 AS h FROM own, table_),
made AS (SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM heads a LEFT JOIN heads b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (SELECT conv_id, len(t) AS n, d, t[1:d] AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM made)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN p[d].w ELSE 0 END AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT p[1:a] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256 FROM counted c JOIN sums USING (p) LEFT JOIN nodes u ON c.d > 0 AND u.p = c.p[1:c.d - 1]
"""


def _vectors(scale: int, label: str) -> str:
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"v AS (SELECT row_number() OVER () AS row_, vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {usable} AND {label} IS NOT NULL)"


ORACLE["op12_hard_negatives"] = f"""
WITH {_vectors(256, 'CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END')},
pairs AS (SELECT a.row_ AS a, a.vec_id AS anchor_id, b.row_ AS b, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.row_ <> b.row_ WHERE a.vec_id % 100 = 0),
good AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other, b) <= 5)
SELECT g.anchor_id, g.other AS positive_id, CAST(row_number() OVER (PARTITION BY g.a, g.b ORDER BY n.score DESC, n.other, n.b) AS INTEGER) AS rank, n.other AS negative_id, g.score AS positive_score, n.score AS negative_score
FROM good g JOIN pairs n ON n.a = g.a AND NOT n.same AND 80 * g.score <= 100 * n.score AND n.score <= g.score QUALIFY rank <= 5
"""

ORACLE["op13_topk_search"] = f"""
WITH {_vectors(1024, '0')}
SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.row_ ORDER BY list_inner_product(a.x, b.x) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
FROM v a JOIN v b ON a.row_ <> b.row_ WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10
"""
