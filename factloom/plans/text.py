"""Text, entity, page and corpus queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import dates, text as tx, urls
from factloom.functions.ids import table_digest
from factloom.operators import corpus, entities
from factloom.plans.common import table as t

QUERIES = {}
ORACLES = {}

# Terms of the invented language of the driver tables, in the place of the domain terms.
TOPIC_TERMS = {
    "mechanism": ("anst", "thor", "ention", "eauoux"),
    "efficacy": ("thre", "erand", "ciónue", "lich"),
    "safety": ("onth", "eranin", "of"),
}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def _runs(words, n):
    """All runs of ``n`` words with their places."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct((i - 1).alias("position"), F.array_join(F.slice(words, i, n), " ").alias("alias")))


def benchmark_dictionary(spark, sf):
    """Dictionary made of all pairs and all triples of neighbouring words of every benchmark item."""
    items = t(spark, sf, "benchmark").select("item_id", F.split(tx.normalize_text(F.col("text")), " ").alias("words"))
    words = F.col("words")
    rows = items.select(
        F.element_at(F.array(F.lit("adc"), F.lit("target"), F.lit("payload")), (F.col("item_id") % 3 + 1).cast("int"))
        .alias("entity_type"),
        (F.col("item_id") / 2).cast("bigint").cast("string").alias("entity_id"),
        F.concat(F.lit("Item "), (F.col("item_id") / 2).cast("bigint").cast("string")).alias("canonical_name"),
        F.explode(F.concat(_runs(words, 2), _runs(words, 3))).alias("r"),
    ).select("entity_type", "entity_id", "canonical_name", F.col("r.position").alias("position"), F.col("r.alias").alias("alias"))
    return rows.groupBy("entity_type", "entity_id", "canonical_name", "alias").agg(F.min("position").alias("position"))


DICTIONARY_SQL = """
norm AS (SELECT item_id, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
dict AS (SELECT entity_type, entity_id, 'Item ' || entity_id AS canonical_name, alias, min(position) AS position FROM (
  SELECT (['adc', 'target', 'payload'])[item_id % 3 + 1] AS entity_type, CAST(item_id // 2 AS VARCHAR) AS entity_id,
    unnest(list_concat(list_transform(range(1, len(w)), lambda i: {'alias': w[i] || ' ' || w[i + 1], 'position': i - 1}),
      list_transform(range(1, len(w) - 1), lambda i: {'alias': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 'position': i - 1})), recursive := true) FROM norm)
  GROUP BY ALL),
docs AS (SELECT doc_id, source, text, ' ' || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n
  FROM documents),
matches AS (SELECT doc_id, entity_type, entity_id, arg_max(canonical_name, (length(alias), -position, alias))
    AS canonical_name, arg_max(alias, (length(alias), -position, alias)) AS matched_alias
  FROM docs JOIN dict ON contains(n, ' ' || alias || ' ') GROUP BY 1, 2, 3)"""


@query("WITH " + DICTIONARY_SQL + " SELECT doc_id, entity_type, entity_id, canonical_name, matched_alias FROM matches")
def normalize_match_dictionary(spark, sf):
    return entities.match_dictionary(t(spark, sf, "documents").select("doc_id", "text"), benchmark_dictionary(spark, sf),
                                     key="doc_id", text="text")


@query("WITH " + DICTIONARY_SQL + """
SELECT 'ev_' || substr(sha256('pubmed' || chr(31) || doc_id || chr(31) || entity_type || chr(31) || entity_id || chr(31)
    || 'mentions'), 1, 24) AS evidence_id, entity_type, entity_id, CAST(doc_id AS VARCHAR) AS source_record_id,
  matched_alias, canonical_name AS value, md5(substr(coalesce(list_filter(regexp_split_to_array(
    regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(' ' ||
    trim(regexp_replace(replace(lower(s), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || matched_alias || ' '))[1], text), 1, 600))
    AS excerpt_md5
FROM matches JOIN docs USING (doc_id)""")
def document_links(spark, sf):
    documents = t(spark, sf, "documents").select("doc_id", "text", "source")
    linked = entities.mention_links(
        documents, benchmark_dictionary(spark, sf), record_type="document", source="pubmed", key="doc_id",
        record_id="doc_id", text="text", url="source", confidence=0.9)
    return linked.select("evidence_id", "entity_type", "entity_id", "source_record_id", "matched_alias", "value",
                         F.md5("evidence_text").alias("excerpt_md5"))


def _topic_sql() -> str:
    items = []
    for topic, terms in TOPIC_TERMS.items():
        tests = ", ".join(
            f"CASE WHEN {_term_sql(term)} THEN '{term}' END" for term in terms)
        items.append(f"{{'topic': '{topic}', 'terms': list_filter([{tests}], lambda x: x IS NOT NULL)}}")
    return ("SELECT doc_id, unnest(list_filter([" + ", ".join(items) +
            "], lambda r: len(r.terms) > 0)) AS r FROM (SELECT doc_id, lower(text) AS l FROM documents)")


def _term_sql(term: str) -> str:
    if len(term) <= 4 and term.isascii():
        return f"regexp_matches(l, '(?:^|[^\\p{{L}}\\p{{N}}_]){term}(?:[^\\p{{L}}\\p{{N}}_]|$)')"
    return f"contains(l, '{term}')"


def document_topics(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.explode(tx.topics(F.col("text"), TOPIC_TERMS)).alias("r"))
    return d.select("doc_id", "r.topic", F.array_join("r.matched_terms", ",").alias("matched_terms"))


@query(f"SELECT doc_id, r.topic AS topic, array_to_string(r.terms, ',') AS matched_terms FROM ({_topic_sql()})")
def topic_classification(spark, sf):
    return document_topics(spark, sf)


@query(f"""WITH x AS (SELECT doc_id, r.topic AS topic FROM ({_topic_sql()}))
SELECT topic AS label, count(*) AS n FROM x GROUP BY 1
UNION ALL SELECT 'classified_documents', count(DISTINCT doc_id) FROM x
UNION ALL SELECT 'unclassified_documents', (SELECT count(*) FROM documents) - count(DISTINCT doc_id) FROM x""")
def topic_coverage(spark, sf):
    found = t(spark, sf, "documents").select(F.transform(tx.topics(F.col("text"), TOPIC_TERMS), lambda r: r["topic"]).alias("t"))
    per_topic = found.select(F.explode("t").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    totals = found.agg(F.count_if(F.size("t") > 0).alias("c"), F.count_if(F.size("t") == 0).alias("u"))
    rows = totals.select(F.explode(F.array(
        F.struct(F.lit("classified_documents").alias("label"), F.col("c").alias("n")),
        F.struct(F.lit("unclassified_documents").alias("label"), F.col("u").alias("n")))).alias("r")).select("r.label", "r.n")
    return per_topic.unionByName(rows)


@query("""
SELECT doc_id, unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS category, damaged FROM (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)token\\s*=\\s*"[0-9a-f]{32,}"') THEN 'api_key' END,
  CASE WHEN regexp_matches(text, '\\b\\d{1,3}(\\.\\d{1,3}){3}\\b') THEN 'network_address' END,
  CASE WHEN regexp_matches(text, '(?i)(?:sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{20,})') THEN 'vendor_key' END],
  lambda x: x IS NOT NULL) AS c,
  text IS NULL OR trim(text) = '' OR regexp_matches(text, '[\\x{FFFD}\\x{FEFF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]')
  AS damaged FROM documents)""")
def sensitive_text_scan(spark, sf):
    patterns = {
        "api_key": r'(?i)token\s*=\s*"[0-9a-f]{32,}"',
        "network_address": r"\b\d{1,3}(\.\d{1,3}){3}\b",
        "vendor_key": tx.SENSITIVE_PATTERNS["api_key"],
    }
    found = tx.sensitive_categories(F.coalesce("text", F.lit("")), patterns)
    return t(spark, sf, "documents").select("doc_id", F.explode_outer(found).alias("category"), tx.is_damaged(F.col("text")).alias("damaged"))


PAGE_LINKS_SQL = """
WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS names FROM pages)
SELECT page_id, title, CAST(unnest(generate_series(1, len(hrefs))) AS INTEGER) AS position, unnest(hrefs) AS path,
  unnest(names) AS name FROM p"""


@query(PAGE_LINKS_SQL)
def html_title_links(spark, sf):
    link = r'<a href="([^"]*)">([^<]*)</a>'
    pages = t(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("path"),
            F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("name"))).alias("i", "l"))
    return pages.select("page_id", "title", (F.col("i") + 1).alias("position"), "l.path", "l.name")


@query("""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(
  regexp_replace(html, '(?i)<br\\s*/?>', '; ', 'g'), '<[^>]+>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'),
  '&nbsp;', ' '), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'),
  '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_clean_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(tx.clean_html(F.col("html"))).alias("text_md5"))


@query("""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT CASE WHEN ends_with(host, 'example.com') THEN 'commercial' WHEN ends_with(host, 'example.org') THEN 'organisation'
  ELSE 'other' END AS source_class, count(*) AS pages, count(DISTINCT host) AS hosts,
  count(*) FILTER (WHERE url LIKE 'https://%') AS https_pages, count(*) FILTER (WHERE path IN ('', '/')) AS generic_pages
FROM h GROUP BY 1""")
def url_class(spark, sf):
    url = F.col("url")
    classes = (("example.com", "commercial"), ("example.org", "organisation"))
    return t(spark, sf, "pages").groupBy(urls.source_class(url, classes, "other").alias("source_class")).agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct(urls.url_host(url)).alias("hosts"),
        F.count_if(url.startswith("https://")).alias("https_pages"), F.count_if(urls.is_generic_url(url)).alias("generic_pages"))


ISSUE_DATE_SQL = """
d AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%b-%d')
  WHEN 3 THEN strftime(o_orderdate, '%Y-%b') WHEN 4 THEN strftime(o_orderdate, '%Y')
  WHEN 5 THEN strftime(o_orderdate, '%Y Jan-Feb %d') WHEN 6 THEN strftime(o_orderdate, '%Y-13-%d')
  WHEN 7 THEN '' ELSE strftime(o_orderdate, '%Y-Xyz-%d') END AS v, CASE o_orderkey % 9
  WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
  WHEN 2 THEN CAST(o_orderdate AS DATE) WHEN 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
  WHEN 4 THEN CAST(date_trunc('year', o_orderdate) AS DATE)
  WHEN 5 THEN CAST(strftime(o_orderdate, '%Y-01-%d') AS DATE) END AS d FROM orders)"""


def issue_dates(spark, sf):
    k, d = F.col("o_orderkey") % 9, F.col("o_orderdate")
    formats = {0: "yyyy-MM-dd", 1: "yyyy-MM", 2: "yyyy-MMM-dd", 3: "yyyy-MMM", 4: "yyyy", 5: "yyyy 'Jan-Feb' dd",
               6: "yyyy-'13'-dd", 8: "yyyy-'Xyz'-dd"}
    text = F.lit("")
    for value, fmt in formats.items():
        text = F.when(k == value, F.date_format(d, fmt)).otherwise(text)
    return t(spark, sf, "orders").select("o_orderkey", text.alias("issue_date"))


@query("WITH " + ISSUE_DATE_SQL + " SELECT o_orderkey, v AS issue_date, CAST(d AS VARCHAR) AS parsed FROM d")
def partial_date_parse(spark, sf):
    return issue_dates(spark, sf).select(
        "o_orderkey", "issue_date", dates.partial_date(F.col("issue_date")).cast("string").alias("parsed"))


@query("WITH " + ISSUE_DATE_SQL + """
SELECT count(*) AS observed_count, count(*) FILTER (WHERE v = '') AS missing_count,
  count(*) FILTER (WHERE v <> '' AND d IS NULL) AS invalid_count, CAST(min(d) AS VARCHAR) AS min_date,
  CAST(max(d) AS VARCHAR) AS max_date, count(*) FILTER (WHERE d > DATE '2001-06-30') AS after_as_of_count,
  CASE WHEN count(*) FILTER (WHERE (v <> '' AND d IS NULL) OR d > DATE '2001-06-30') > 0 THEN 'needs_review' ELSE 'pass' END
    AS status,
  (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM (SELECT DISTINCT v FROM d WHERE v <> '' AND d IS NULL ORDER BY v
    LIMIT 5)) AS invalid_examples,
  (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM (SELECT DISTINCT v FROM d WHERE d > DATE '2001-06-30' ORDER BY v
    LIMIT 5)) AS after_as_of_examples FROM d""")
def partial_date_quality(spark, sf):
    return dates.date_quality(issue_dates(spark, sf), "issue_date", F.lit("2001-06-30").cast("date"))


CHUNK_SQL = """
u AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text, WS),
    '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, WS)), lambda x: x <> '') AS raw FROM documents),
w AS (SELECT doc_id, flatten(list_transform(raw, lambda x: CASE WHEN length(x) <= 1200 THEN [x]
    ELSE list_transform(generate_series(1, length(x), 1040), lambda s: substr(x, s, 1200)) END)) AS units FROM u),
f AS (SELECT doc_id, list_reduce(list_transform(units, lambda x: {'c': CAST([] AS VARCHAR[]), 't': x}),
  lambda a, x: CASE
    WHEN length(CASE WHEN a.t = '' THEN x.t ELSE trim(a.t || chr(10) || x.t, WS) END) <= 1200
      THEN {'c': a.c, 't': CASE WHEN a.t = '' THEN x.t ELSE trim(a.t || chr(10) || x.t, WS) END}
    WHEN a.t <> '' AND 1199 - length(x.t) > 0
      THEN {'c': list_append(a.c, a.t),
            't': trim(ltrim(right(a.t, least(160, 1199 - length(x.t))), WS) || chr(10) || x.t, WS)}
    ELSE {'c': CASE WHEN a.t = '' THEN a.c ELSE list_append(a.c, a.t) END, 't': x.t} END,
  {'c': CAST([] AS VARCHAR[]), 't': ''}) AS s FROM w),
g AS (SELECT doc_id, CASE WHEN s.t = '' THEN s.c ELSE list_append(s.c, s.t) END AS chunks FROM f),
chunks AS (SELECT doc_id, CAST(unnest(generate_series(0, len(chunks) - 1)) AS INTEGER) AS chunk_index,
  unnest(chunks) AS content FROM g)""".replace("WS", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")


def retrieval_documents(spark, sf):
    """Publication-style documents of the ``documents`` table, without links."""
    doc = F.col("doc_id").cast("string")
    return t(spark, sf, "documents").select(
        F.concat(F.lit("pubmed:"), doc).alias("retrieval_document_id"), F.lit("pubmed").alias("source_type"),
        doc.alias("source_record_id"), F.col("source").alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://records.example/"), doc).alias("source_url"), F.struct("lang").alias("metadata"), "doc_id")


@query("WITH " + CHUNK_SQL + """
SELECT 'pubmed:' || doc_id || '#chunk-' || CASE WHEN chunk_index < 1000 THEN lpad(CAST(chunk_index AS VARCHAR), 3, '0')
  ELSE CAST(chunk_index AS VARCHAR) END AS chunk_id, chunk_index, CAST(length(content) AS INTEGER) AS char_count,
  md5(content) AS content_md5 FROM chunks""")
def chunk_documents(spark, sf):
    return corpus.chunk_documents(retrieval_documents(spark, sf)).select(
        "chunk_id", "chunk_index", "char_count", F.md5("content").alias("content_md5"))


PROFILE_SQL = """
WITH a AS (SELECT p_partkey, list_sort([upper(p_name), 'P-' || p_partkey]) AS al FROM part)
SELECT 'adc_profile:' || p_partkey AS retrieval_document_id, 'ADC profile: ' || p_name AS title,
 'ADC 名称 / ADC name: ' || p_name || chr(10) || '别名 / aliases: ' || array_to_string(al, ', ') || chr(10) ||
 '靶点 / target: ' || p_brand || chr(10) || '抗体 / antibody: not recorded' || chr(10) ||
 '连接子 / linker: ' || CASE WHEN p_size % 5 = 0 THEN 'not recorded' ELSE 'L' || p_size END || chr(10) ||
 '连接子类型 / linker type: unknown' || chr(10) || '载荷 / payload: ' || p_type || chr(10) ||
 '载荷类型 / payload class: not recorded' || chr(10) || '药物抗体比 / DAR: ' || CASE WHEN p_size % 7 = 0 THEN 'not recorded'
   ELSE CAST(CAST(p_size AS DOUBLE) / 2 AS VARCHAR) END || chr(10) || '适应证 / indication: not recorded' || chr(10) ||
 '研发状态 / development status: ' || CASE WHEN p_size > 25 THEN 'approved' ELSE 'investigational' END || chr(10) ||
 '企业 / company: not recorded' AS content, p_brand AS target, array_to_string(al, '|') AS aliases
FROM part JOIN a USING (p_partkey)"""


def part_catalogue(spark, sf):
    """The part table in the shape of the entity catalogue."""
    null = F.lit(None).cast("string")
    k = F.col("p_partkey").cast("string")
    return t(spark, sf, "part").select(
        k.alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("target"), null.alias("antibody"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("L"), F.col("p_size").cast("string"))).alias("linker_name"),
        F.lit("unknown").alias("linker_type"), F.col("p_type").alias("payload_name"), null.alias("payload_class"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double") / F.lit(2.0)).alias("dar"),
        null.alias("indication"),
        F.when(F.col("p_size") > 25, "approved").otherwise("investigational").alias("development_status"),
        null.alias("company"), F.concat(F.lit("https://parts.example/"), k).alias("source_url"))


@query(PROFILE_SQL)
def profile_documents(spark, sf):
    catalogue = part_catalogue(spark, sf)
    aliases = catalogue.select("entity_id", F.explode(F.array(
        F.upper("name"), F.concat(F.lit("P-"), "entity_id"))).alias("alias"))
    return corpus.profile_documents(catalogue, aliases).select(
        "retrieval_document_id", "title", "content", F.element_at("metadata.targets", 1).alias("target"),
        F.array_join("metadata.aliases", "|").alias("aliases"))


@query("""
WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS ids,
  list_sort(list(DISTINCT p_name)) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT 'trial:' || o_orderkey AS retrieval_document_id, 'Clinical trial: ' || o_orderkey || chr(10) || 'Brief title: Order '
  || o_orderkey || chr(10) || 'Recruitment status: ' || o_orderstatus || chr(10) || 'Phase: ' || o_orderpriority ||
  CASE WHEN o_custkey % 3 > 0 THEN chr(10) || 'Enrollment: ' || o_custkey ELSE '' END || chr(10) || 'Start date: ' ||
  strftime(o_orderdate, '%Y-%m-%d') AS content, coalesce(array_to_string(ids, ','), '') AS entity_ids,
  coalesce(array_to_string(names, ','), '') AS entity_names
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def trial_documents(spark, sf):
    strings = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    key = F.col("o_orderkey").cast("string")
    trials = t(spark, sf, "orders").select(
        key.alias("nct_id"), F.concat(F.lit("Order "), key).alias("brief_title"), null.alias("official_title"),
        F.col("o_orderstatus").alias("overall_status"), F.array("o_orderpriority").alias("phases"),
        strings.alias("conditions"), strings.alias("interventions"), null.alias("sponsor"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("enrollment"), strings.alias("primary_outcomes"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), null.alias("completion_date"),
        F.lit("").alias("source_url"))
    links = t(spark, sf, "lineitem").select(
        F.lit("adc").alias("entity_type"), F.col("l_partkey").cast("string").alias("entity_id"),
        F.lit("trial").alias("source_record_type"), F.col("l_orderkey").cast("string").alias("source_record_id"))
    catalogue = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("name"))
    built = corpus.trial_documents(trials, corpus.linked_entities(links, catalogue, "trial"))
    return built.select("retrieval_document_id", "content", F.array_join("metadata.adc_ids", ",").alias("entity_ids"),
                        F.array_join("metadata.adc_names", ",").alias("entity_names"))


@query("""
WITH n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || ' rev' ELSE text END) AS h FROM documents
  WHERE doc_id % 17 <> 5), o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 2)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted'
  WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def incremental_corpus_diff(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    revised = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" rev"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 17 <> 5").select("doc_id", F.sha2(revised, 256).alias("content_hash"))
    old = d.filter("doc_id % 13 <> 2").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return corpus.classify_changes(old, new, "doc_id")


@query("""
WITH h AS (SELECT sha256(doc_id || chr(31) || text || chr(31) || source) AS h FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS row_count, """ + ", ".join(
    f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS w{i}" for i in range(8)) + """ FROM h)
SELECT row_count, 'corpus_' || sha256(row_count || chr(31) || """ + " || chr(31) || ".join(
    f"w{i}" for i in range(8)) + ") AS version FROM s")
def corpus_table_version(spark, sf):
    return table_digest(t(spark, sf, "documents"), ["doc_id", "text", "source"], "corpus_")


@query("""
SELECT item_id AS question_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS question_key,
  CAST(count(*) OVER (PARTITION BY regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g')) AS BIGINT)
  AS same_wording FROM benchmark""")
def question_wording_keys(spark, sf):
    keyed = t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), tx.question_key(F.col("text")).alias("question_key"))
    counts = keyed.groupBy("question_key").agg(F.count(F.lit(1)).alias("same_wording"))
    return keyed.join(counts, "question_key").select("question_id", "question_key", "same_wording")


@query("""
SELECT doc_id, CAST(nullif(regexp_extract(text, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS first_number,
 CASE WHEN contains(n, 'thre') THEN 'approved' WHEN n <> '' THEN 'investigational' ELSE 'unknown' END AS status
FROM (SELECT doc_id, text, trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'approved', ''), '[^a-z0-9]+', ' ', 'g')) AS n
  FROM documents)""")
def scalar_extraction(spark, sf):
    text = F.replace(F.lower("text"), F.lit("approved"), F.lit(""))
    status = F.replace(text, F.lit("thre"), F.lit("approved"))
    return t(spark, sf, "documents").select("doc_id", tx.first_number(F.col("text")).alias("first_number"),
                                            tx.development_status(status).alias("status"))
