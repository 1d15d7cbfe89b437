"""SQL twins of the queries that SQL can express, for the tables as they are (distinct doc_ids)."""

from vistrata.llm.repetition import GRAM_LIMITS, LINE_LIMIT, SYMBOL_LIMIT

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
BLANK = "chr(32) || chr(9) || chr(13) || chr(12) || chr(11)"


def _gram(n: int) -> str:
    more = "max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)" if n == 8 else "0"
    return f"""
g{n} AS (SELECT doc_id, pos, word, CASE WHEN pos <= n - {n - 1} THEN array_to_string(list_slice(ws, pos, pos + {n - 1}), ' ') END AS gram FROM words),
f{n} AS (SELECT doc_id, pos, word, (gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1)::INT AS again,
  (gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1)::INT AS twice FROM g{n}),
c{n} AS (SELECT doc_id, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside,
  {more} AS pair FROM f{n}),
s{n} AS (SELECT doc_id, sum(CASE WHEN inside = 1 THEN length(word) ELSE 0 END)::BIGINT AS chars, sum(pair)::BIGINT AS repeated FROM c{n} GROUP BY 1)"""


QUALITY = rf"""
WITH base AS (SELECT doc_id, text, {WORDS.format("text")} AS ws FROM documents),
words AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM base),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM base),
spoken AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines,
  coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (again), 0)::BIGINT AS dup_line_chars FROM spoken GROUP BY 1),
{",".join(_gram(n) for n in GRAM_LIMITS)},
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(s8.repeated, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(s{n}.chars, 0)::BIGINT AS dup_gram_chars_{n}" for n in GRAM_LIMITS)}
  FROM base LEFT JOIN l USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in GRAM_LIMITS)})
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
  AND 100 * n_symbols <= {SYMBOL_LIMIT} * n_words
  {" ".join(f"AND 100 * dup_gram_chars_{n} <= {limit} * word_chars" for n, limit in GRAM_LIMITS.items())} AS kept FROM m"""

LINE_WINDOWS = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
spoken AS (SELECT doc_id, pos, trim(line, {BLANK}) AS line FROM lines WHERE trim(line, {BLANK}) <> ''),
runs AS (SELECT doc_id, pos AS p, lead(pos) OVER o AS q, lead(pos, 2) OVER o AS r,
  line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS w FROM spoken WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (SELECT doc_id, p, q, r, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) = 1 AS first FROM runs
  WHERE w IS NOT NULL QUALIFY count(*) OVER (PARTITION BY w) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([p, q, r]) AS pos FROM marked WHERE NOT first),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_removed
  FROM lines LEFT JOIN gone g USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)"""


def _crc32(code: str) -> str:
    """Unsigned CRC-32 of the bytes that a text of hexadecimal digits names, half a byte at a time; the table follows
    from the polynomial."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    digit = lambda at: f"instr('123456789ABCDEF', substr({code}, {at}, 1))::BIGINT"
    halves = f"flatten(list_transform(range(1, strlen({code}), 2), lambda i: [{digit('i + 1')}, {digit('i')}]))"
    step = f"xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, x: {step}))"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _tree(name: str, leaves: str) -> str:
    """All nodes of the trees over `leaves` (g, pos, n, node), by level."""
    return f"""
{name} AS (SELECT g, 0 AS level, pos, n, node FROM {leaves}
  UNION ALL SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2, n)"""


MERKLE = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
  {_leaf(f"n_chars + CASE WHEN {_crc32('hex(doc_id::VARCHAR)')} % 7 = 0 THEN 1 ELSE 0 END")} AS claim FROM documents),
leaves AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{_tree("tree", "leaves")},
subroots AS (SELECT '' AS g, g AS lang, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{_tree("top", "subroots")},
levels AS (SELECT g, level, n FROM tree WHERE n > 1 GROUP BY ALL),
top_levels AS (SELECT level, n FROM top WHERE n > 1 GROUP BY ALL),
beside AS (SELECT l.doc_id, k.level, (l.pos >> k.level) & 1 AS side, coalesce(t.node, '') AS node FROM leaves l JOIN levels k USING (g)
    LEFT JOIN tree t ON t.g = l.g AND t.level = k.level AND t.pos = xor(l.pos >> k.level, 1)
  UNION ALL SELECT l.doc_id, 1000 + k.level, (s.pos >> k.level) & 1, coalesce(t.node, '') FROM leaves l JOIN subroots s ON s.lang = l.g CROSS JOIN top_levels k
    LEFT JOIN top t ON t.level = k.level AND t.pos = xor(s.pos >> k.level, 1)),
path AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM beside),
folds AS (SELECT doc_id, 0::BIGINT AS step, claim AS x FROM leaves
  UNION ALL SELECT doc_id, p.step, sha256(CASE WHEN side = 1 THEN p.node || x ELSE x || p.node END) FROM folds f JOIN path p USING (doc_id) WHERE p.step = f.step + 1),
folded AS (SELECT doc_id, arg_max(x, step) AS folded_root FROM folds GROUP BY 1),
proofs AS (SELECT doc_id, sha256(string_agg(node, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM leaves l JOIN subroots s ON s.lang = l.g JOIN (SELECT node FROM top WHERE n = 1) r ON true JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id)"""


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RUNS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _features(table: str, key: str) -> str:
    return f"""SELECT {key}, f, count(*) AS c FROM (SELECT {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f
  FROM (SELECT {key}, {RUNS} AS ws FROM {table})) GROUP BY ALL"""


RESAMPLING = f"""
WITH own AS ({_features("documents", "doc_id")}),
aim AS ({_features("benchmark", "item_id")}),
buckets AS (SELECT f, {_crc32("code")} % 10000 AS b FROM (SELECT f, hex(f) AS code FROM (SELECT f FROM own UNION SELECT f FROM aim))),
s AS (SELECT b, sum(c) AS s FROM own JOIN buckets USING (f) GROUP BY 1),
t AS (SELECT b, sum(c) AS t FROM aim JOIN buckets USING (f) GROUP BY 1),
gains AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000)
  / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
sums AS (SELECT doc_id, sum(c) AS n, sum(c * gain) AS total FROM own JOIN buckets USING (f) JOIN gains USING (b) GROUP BY 1),
weights AS (SELECT doc_id, coalesce(len({RUNS}), 0) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
  CASE WHEN n > 0 THEN (total - (((total % n) + n) % n)) // n ELSE 0 END::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN sums USING (doc_id)),
scores AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weights),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT s.doc_id, n_words, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scores s LEFT JOIN ranks USING (doc_id)"""
