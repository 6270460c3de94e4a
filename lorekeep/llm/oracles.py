"""The queries of this subpackage in SQL, where SQL can express them."""

from lorekeep.llm import urls
from lorekeep.llm.license_texts import TEMPLATES

_PAYLOADS = """SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
  sha256(coalesce(html, '')) AS payload_digest FROM pages"""

_FIRST = """CASE WHEN payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest)
  THEN min(page_id) OVER (PARTITION BY payload_digest) END"""


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"


_URL = f"""
WITH lowered AS (SELECT page_id, url, translate(coalesce(url, ''), '{urls.UPPER}', '{urls.LOWER}') AS u,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    CAST({" + ".join(map(_hit, urls.STRICT))} AS INT) AS strict_hits,
    CAST({" + ".join(map(_hit, urls.SOFT))} AS INT) AS soft_hits FROM lowered),
ruled AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block' WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_LIMIT} THEN 'block'
    ELSE 'allow' END AS verdict, strict_hits, soft_hits FROM ruled"""

_COMPONENTS = f"""
WITH RECURSIVE words AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle_lists AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingle_lists),
shingles AS (SELECT doc_id, unnest(s) AS s FROM shingle_lists),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, n AS n_shingles, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id) AS component_id FROM sizes"""

_LATIN = [c for c in range(0xC0, 0xDF) if c != 0xD7]
_UP, _LOW = urls.UPPER + "".join(map(chr, _LATIN)), urls.LOWER + "".join(chr(c + 32) for c in _LATIN)


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"


_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))

_LICENSES = f"""
WITH template AS (SELECT * FROM (VALUES {_TEMPLATES}) v(template, license, text)),
template_words AS (SELECT template, license, {_words('text')} AS w FROM template),
template_grams AS (SELECT DISTINCT template, license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM template_words),
template_sizes AS (SELECT template, count(*) AS size FROM template_grams GROUP BY template),
split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS number, len(parts) AS n FROM split),
lined AS (SELECT doc_id, number, {_words('line')} AS w,
    sum((number > 0 AND number < n - 1 AND regexp_full_match(line, '[ \\t\\x0B\\f\\r]*'))::INT) OVER (PARTITION BY doc_id ORDER BY number) AS paragraph FROM line),
word AS (SELECT doc_id, number, paragraph, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lined),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number, i) AS pos,
    lead(w) OVER (PARTITION BY doc_id ORDER BY number, i) AS after, lead(number) OVER (PARTITION BY doc_id ORDER BY number, i) AS after_line,
    lead(paragraph) OVER (PARTITION BY doc_id ORDER BY number, i) AS after_paragraph FROM word),
unit_words AS (
  SELECT doc_id, 'line' AS unit, 0 AS o, number, pos, w || ' ' || after AS g, after_line = number AS inside FROM placed
  UNION ALL SELECT doc_id, 'paragraph', 1, paragraph, pos, w || ' ' || after, after_paragraph = paragraph FROM placed
  UNION ALL SELECT doc_id, 'text', 2, 0, pos, w || ' ' || after, after IS NOT NULL FROM placed),
unit AS (SELECT doc_id, unit, o, number, min(pos) AS first, max(pos) AS last, count(DISTINCT g) FILTER (inside) AS size FROM unit_words GROUP BY ALL),
shared AS (SELECT u.doc_id, u.unit, u.number, t.template, t.license, count(DISTINCT u.g) AS c
  FROM unit_words u JOIN template_grams t ON t.g = u.g WHERE u.inside GROUP BY ALL),
scored AS (SELECT s.doc_id, s.license, s.unit, u.o, s.number, u.first, u.last, max(2 * s.c / (u.size + t.size)) AS dice
  FROM shared s JOIN unit u ON u.doc_id = s.doc_id AND u.unit = s.unit AND u.number = s.number
  JOIN template_sizes t ON t.template = s.template GROUP BY ALL HAVING max(2 * s.c / (u.size + t.size)) >= 0.8)
SELECT doc_id, license, unit, number::INT AS number, dice FROM scored
QUALIFY rank() OVER (PARTITION BY doc_id, first, last ORDER BY o, dice DESC) = 1"""

_CRC_TABLE = []
for _byte in range(256):
    for _ in range(8):
        _byte = _byte >> 1 ^ (0xEDB88320 if _byte & 1 else 0)
    _CRC_TABLE.append(_byte)


def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits."""
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, ({_CRC_TABLE}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


_TRIE = f"""
WITH turns AS (SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))
    || octet_length(encode(coalesce(text, '')))::VARCHAR AS id FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS l, {_crc32("conv_id")} % 9 AS h FROM turns GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefix AS (SELECT conv_id, len(l) AS n, l, unnest(range(0, len(l) + 1)) AS depth FROM rebuilt),
node AS (SELECT depth, l[1:depth] AS l, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM prefix GROUP BY ALL),
keyed AS (SELECT *, array_to_string(l, '/') AS k, array_to_string(l[1:depth - 1], '/') AS up,
    CASE WHEN depth > 0 THEN substr(l[depth], 33)::BIGINT ELSE 0 END AS bytes FROM node),
counted AS (SELECT v.*, (SELECT count(*) FROM keyed w WHERE w.depth = v.depth + 1 AND w.up = v.k) AS n_children FROM keyed v),
below AS (SELECT d AS depth, array_to_string(l[1:d], '/') AS k, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM counted v JOIN below b ON b.depth = v.depth AND b.k = v.k LEFT JOIN counted p ON p.depth = v.depth - 1 AND p.k = v.up"""


def _leaf(text: str) -> str:
    fields = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": text}
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v}))::VARCHAR || ':' || {v} END" for c, v in fields.items()) + ")"


def _levels(name: str, tree: str) -> str:
    return f"""SELECT lvl + 1, {tree}, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY lvl, {tree}, idx // 8, n"""


_BESIDE = """coalesce(string_agg(h, '') OVER (PARTITION BY lvl, tree, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER (PARTITION BY lvl, tree, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a"""

_MERKLE = f"""
WITH RECURSIVE leafed AS (SELECT doc_id, lang, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("coalesce(doc_id, 0)")} % 3 = 0 AND doc_id IS NOT NULL THEN {_leaf(f"translate(text, '{urls.UPPER}', '{urls.LOWER}')")} ELSE {_leaf("text")} END AS offered FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM leafed),
node(lvl, tree, idx, n, h) AS (SELECT 0, tree, idx, n, leaf FROM leaves UNION ALL {_levels("node", "tree")}),
upper(lvl, tree, idx, n, h) AS (SELECT 0, 0, tree, (SELECT count(DISTINCT tree) FROM leaves), h FROM node WHERE n = 1 UNION ALL {_levels("upper", "tree")}),
beside AS (SELECT 0 AS part, lvl, tree, idx, {_BESIDE} FROM node WHERE n > 1 UNION ALL SELECT 1, lvl, tree, idx, {_BESIDE} FROM upper WHERE n > 1),
path AS (SELECT l.tree, l.idx, list({{'b': s.b, 'a': s.a}} ORDER BY s.part, s.lvl) AS steps FROM leaves l JOIN beside s
    ON CASE s.part WHEN 0 THEN s.tree = l.tree AND s.idx = l.idx >> (3 * s.lvl) ELSE s.idx = l.tree >> (3 * s.lvl) END GROUP BY ALL),
folded AS (SELECT l.doc_id, l.leaf, (SELECT h FROM node r WHERE r.tree = l.tree AND r.n = 1) AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
    sha256(coalesce(list_reduce(list_transform(p.steps, lambda s: s.b || s.a), lambda x, y: x || y), '')) AS proof_sha256,
    list_reduce([{{'b': l.offered, 'a': ''}}] || coalesce(p.steps, []), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
  FROM leaves l LEFT JOIN path p ON p.tree = l.tree AND p.idx = l.idx)
SELECT *, folded_root = root AS verified FROM folded"""

ORACLES: dict[str, str] = {
    "op2_warc_revisits": f"""
WITH p AS ({_PAYLOADS}), f AS (SELECT *, {_FIRST} AS refers_to FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  refers_to FROM f""",
    "op3_license_scan": _LICENSES,
    "op4_url_filter": _URL,
    "op10_jaccard_join": _COMPONENTS,
    "op11_prefix_trie": _TRIE,
    "op13_merkle_manifest": _MERKLE,
}
