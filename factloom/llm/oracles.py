"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH RECURSIVE counted AS (SELECT doc_id, coalesce(source, chr(1)) AS source, len({WORDS}) AS tokens FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS total FROM counted GROUP BY source HAVING sum(tokens) > 0),
whole AS (SELECT sum(total)::BIGINT AS b FROM sources),
search AS (
  SELECT 0::BIGINT AS low, 1048576::BIGINT AS high
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN ok THEN (low + high) // 2 ELSE high END FROM (
    SELECT low, high, max(pow(total / b::DOUBLE, ((low + high) // 2) / 1048576.0::DOUBLE) * b::DOUBLE / total) / sum(pow(total / b::DOUBLE, ((low + high) // 2) / 1048576.0::DOUBLE)) <= 1.25 AS ok
    FROM search, sources, whole WHERE low < high GROUP BY low, high)),
powers AS (SELECT source, total, b, pow(total / b::DOUBLE, k / 1048576.0::DOUBLE) AS power FROM sources, whole, (SELECT min(low) AS k FROM search WHERE low = high)),
weighed AS (SELECT source, total, round(power / (SELECT sum(power) FROM powers) * b::DOUBLE)::BIGINT AS quota FROM powers),
turned AS (
  SELECT c.doc_id, c.source, c.tokens, w.total, w.quota, w.quota // w.total AS passes, w.quota % w.total AS rest,
    unnest(CASE WHEN w.total IS NULL THEN [0] ELSE range(0, w.quota // w.total + CASE WHEN w.quota % w.total > 0 THEN 1 ELSE 0 END) END)::BIGINT AS pass
  FROM counted c LEFT JOIN weighed w USING (source)),
keyed AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', '0', pass::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))), 1, 15))::BIGINT AS place_key,
    ('0x' || substr(md5(concat_ws(':', '0:order', pass::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))), 1, 15))::BIGINT AS order_key FROM turned),
summed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY place_key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM keyed),
parts AS (SELECT greatest(1, ceil(sum(quota) / 100000.0))::BIGINT AS n FROM weighed),
kept AS (SELECT s.*, coalesce(least(floor((pass * total + start)::DOUBLE * n::DOUBLE / quota)::BIGINT, n - 1), 0) AS block FROM summed s, parts WHERE total IS NULL OR pass < passes OR start < rest)
SELECT doc_id, nullif(source, chr(1)) AS source, pass, tokens::BIGINT AS n_tokens, block,
  row_number() OVER (PARTITION BY block ORDER BY order_key, doc_id NULLS FIRST, tokens) - 1 AS place
FROM kept
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(g.n, 0) AS n_links
FROM documents d LEFT JOIN classes c ON c.x = d.doc_id LEFT JOIN degrees g ON g.x = d.doc_id
"""

SUBSTRINGS = rf"""
WITH worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
phrases AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS p FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM worded WHERE len(w) >= 20)),
firsts AS (SELECT p, min((doc_id, i)) AS first FROM phrases GROUP BY p HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM phrases JOIN firsts USING (p) WHERE (doc_id, i) <> first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS k
  FROM worded d LEFT JOIN lists USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

QUALITY_RULES = rf"""
WITH worded AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM spans GROUP BY doc_id, s HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM spans JOIN twice USING (doc_id, s)) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM worded),
measured AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM worded d JOIN lined USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
valued AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length FROM measured),
named AS (
  SELECT lang, source, u.rule AS rule, u.v AS v FROM (
    SELECT lang, source, unnest([{{'rule': 'symbols', 'v': symbols}}, {{'rule': 'dup_lines', 'v': dup_lines}}, {{'rule': 'word_length', 'v': word_length}}]) AS u FROM valued WHERE n_words > 0)),
bucketed AS (SELECT lang, source, rule, v - v % pow(2, greatest(0, length(bin(v)) - 7))::BIGINT AS bucket FROM named),
summed AS (
  SELECT lang, source, rule, bucket, sum(count(*)) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY lang, source, rule) AS size,
    CASE rule WHEN 'symbols' THEN 50 WHEN 'dup_lines' THEN 10 ELSE 20 END AS tail FROM bucketed GROUP BY lang, source, rule, bucket),
summed_lang AS (
  SELECT lang, rule, bucket, sum(count(*)) OVER (PARTITION BY lang, rule ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY lang, rule) AS size,
    CASE rule WHEN 'symbols' THEN 50 WHEN 'dup_lines' THEN 10 ELSE 20 END AS tail FROM bucketed GROUP BY lang, rule, bucket),
own AS (SELECT lang, source, rule, any_value(size) AS size, min(CASE WHEN upto * 1000 >= size * tail THEN bucket END) AS low, min(CASE WHEN upto * 1000 >= size * (1000 - tail) THEN bucket END) AS high FROM summed GROUP BY lang, source, rule),
whole AS (SELECT lang, rule, min(CASE WHEN upto * 1000 >= size * tail THEN bucket END) AS low, min(CASE WHEN upto * 1000 >= size * (1000 - tail) THEN bucket END) AS high FROM summed_lang GROUP BY lang, rule),
used AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN size < 50 THEN w.low ELSE least(o.low, w.low) END AS low, CASE WHEN size < 50 THEN w.high ELSE greatest(o.high, w.high) END AS high
  FROM own o JOIN whole w ON o.lang IS NOT DISTINCT FROM w.lang AND o.rule = w.rule),
bounds AS (
  SELECT lang, source, max(CASE WHEN rule = 'symbols' THEN high + high // 8 END) AS s, max(CASE WHEN rule = 'dup_lines' THEN high + high // 8 END) AS d,
    max(CASE WHEN rule = 'word_length' THEN high + high // 8 END) AS h, max(CASE WHEN rule = 'word_length' THEN low - low // 8 END) AS l
  FROM used GROUP BY lang, source),
judged AS (
  SELECT v.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(symbols > s, false) OR coalesce(dup_lines > d, false) OR coalesce(word_length > h, false) OR coalesce(word_length < l, false) AS out
  FROM valued v LEFT JOIN bounds b ON v.lang IS NOT DISTINCT FROM b.lang AND v.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT out AS kept FROM judged
"""

WARC = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS last FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM sized LEFT JOIN last USING (payload_digest)
"""

NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH items AS (SELECT item_id, {NORMAL} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
worded AS (SELECT doc_id, {NORMAL} AS w FROM documents),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM windows JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SCAN = rf"""
WITH occurring AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM occurring GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM lengths),
asked AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM occurring SEMI JOIN asked USING (term) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, documents),
norms AS (SELECT doc_id, 100 - 75 + (75 * n * documents) // length AS m FROM lengths, whole),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM counts JOIN weights USING (term) JOIN norms USING (doc_id)),
scored AS (SELECT item_id, doc_id, sum(repeats * part)::BIGINT AS score FROM parts JOIN asked USING (term) GROUP BY item_id, doc_id HAVING sum(repeats * part) > 0)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored) WHERE rank <= 10
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


# crc32 over the characters of a number: the register goes through eight shifts for each.
_CRC32 = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda r, c: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(r, c)), 4294967295::BIGINT), 4294967295)"""


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, idx, digest, n nodes of the level) and runs of children."""
    return f"""
{name}_nodes AS (
  SELECT tree, 0 AS level, idx, digest, n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 3),
{name}_runs AS (SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS d FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 3),
{name}_steps AS (
  SELECT l.tree, l.idx, r.level, (idx // pow(3, level)::BIGINT % 3)::VARCHAR || array_to_string(list_concat(d[1:idx // pow(3, level)::BIGINT % 3], d[idx // pow(3, level)::BIGINT % 3 + 2:]), '') AS step
  FROM {leaves} l JOIN {name}_runs r ON l.tree IS NOT DISTINCT FROM r.tree AND r.run = l.idx // pow(3, level + 1)::BIGINT)"""


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source AS tree, {_row("text")} AS digest, CASE WHEN ({_CRC32}) % 2 = 0 THEN {_row("replace(text, chr(10), '')")} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_tree("low", "leaves")},
subroots AS (SELECT tree AS name, digest FROM low_nodes WHERE n = 1),
tops AS (SELECT 0 AS tree, name, digest, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM subroots),
{_tree("high", "tops")},
whole AS (SELECT digest AS root FROM high_nodes WHERE n = 1),
steps AS (
  SELECT tree, idx, level, step FROM low_steps
  UNION ALL
  SELECT l.tree, l.idx, 1000 + h.level, h.step FROM leaves l JOIN tops t ON l.tree IS NOT DISTINCT FROM t.name JOIN high_steps h ON h.idx = t.idx),
proofs AS (SELECT tree, idx, list(step ORDER BY level) AS steps FROM steps GROUP BY tree, idx),
proven AS (
  SELECT doc_id, l.digest AS leaf, s.digest AS subroot, root, coalesce(tampered, l.digest) AS start, coalesce(steps, []) AS steps
  FROM leaves l JOIN subroots s ON l.tree IS NOT DISTINCT FROM s.name CROSS JOIN whole LEFT JOIN proofs p ON l.tree IS NOT DISTINCT FROM p.tree AND l.idx = p.idx),
folded AS (
  SELECT *, list_reduce(steps, lambda d, x: sha256(substr(x, 2, 64 * x[1]::INTEGER) || d || substr(x, 2 + 64 * x[1]::INTEGER)), start) AS folded_root FROM proven)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

ORACLES: dict[str, str] = {
    "op2_mixing": MIXING, "op5_ngram_join": NGRAM_JOIN, "op6_substring_dedup": SUBSTRINGS, "op7_quality_rules": QUALITY_RULES, "op8_warc": WARC, "op9_decontamination": DECONTAMINATION,
    "op12_lexical_scan": LEXICAL_SCAN, "op13_merkle_manifest": MERKLE}
