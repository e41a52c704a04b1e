"""Text, vocabulary and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sets, text
from ..operators import ordered, records, vocabulary
from ..sources import documents as parsers
from .registry import query

LEXICON = {"estimation": ("ation", "tion th"), "ordering": ("der ", "ing the"), "network": ("graph", "eau"), "search": ("quer", "find")}  # fixed values: stems of the supplied tables
FORMULA = "p_brand || ' + ' || split_part(p_name, ' ', 1) || '_' || CAST(p_size % 3 AS VARCHAR) || ' = ' || p_type"


def _formula():
    return F.concat("p_brand", F.lit(" + "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_"), (F.col("p_size") % 3).cast("string"), F.lit(" = "), "p_type")


@query("WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN ('and','for','from','that','the','this','with')) AS a FROM documents), g AS (SELECT id, unnest(list_concat(a, list_concat(list_transform(range(1, len(a)), lambda i: array_to_string(a[i:i + 1], ' ')), list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i + 2], ' '))))) AS term FROM w), f AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM g GROUP BY term HAVING df >= 2), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark), s AS (SELECT term, tf, df, tf * (1 + 0.25 * (len(term) - len(replace(term, ' ', '')))) * ln(1 + (SELECT count(*) FROM documents) / df::DOUBLE) AS score FROM f ANTI JOIN k USING (term)) SELECT term, CAST(tf AS BIGINT) AS tf, df, round(score, 6) AS score FROM s ORDER BY s.score DESC, df DESC, term LIMIT 500")
def vocabulary_mining(t):
    """The best n-grams of the documents that the benchmark doesn't have."""
    words = F.array_compact(F.filter(text.every(F.lower("text"), "[a-z]{3,}"), lambda x: ~x.isin(*text.STOP)))
    known = t("benchmark").select(F.explode(text.every(F.lower("text"), "[a-z]{3,}")).alias("term"))
    return vocabulary.mine_terms(t("documents").select(F.col("doc_id").alias("id"), "text"), known, words).withColumn("score", F.round("score", 6))


@query(r"WITH c AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM benchmark), s AS (SELECT item_id, list_filter(string_split(regexp_replace(x, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: y <> '') AS s FROM c) SELECT item_id, CAST(len(s) AS INTEGER) AS n, array_to_string(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[i:i + 2], ' ')), '|') AS windows FROM s")
def sentence_windows(t):
    """Overlapping windows of three sentences."""
    w = text.sentence_windows(F.col("text"), 3)
    return t("benchmark").select("item_id", F.size(w).alias("n"), F.array_join(w, "|").alias("windows"))


@query(r"WITH c AS (SELECT item_id, regexp_replace('It ends. no capital follows! ' || text, '\s+', ' ', 'g') AS x FROM benchmark), s AS (SELECT item_id, string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM c) SELECT item_id, substr(list_filter(s, lambda y: contains(replace(lower(y), 'ß', 'ss'), 'tion') OR contains(replace(lower(y), 'ß', 'ss'), 'capital f'))[1], 1, 700) AS evidence, substr(list_filter(s, lambda y: contains(replace(lower(y), 'ß', 'ss'), 'tion'))[1], 1, 700) AS stem FROM s")
def evidence_sentence(t):
    """The first sentence that holds a pattern."""
    c = F.concat(F.lit("It ends. no capital follows! "), "text")
    return t("benchmark").select("item_id", text.evidence_sentence(c, F.array(F.lit("tion"), F.lit("capital f"))).alias("evidence"), text.evidence_sentence(c, F.array(F.lit("tion"))).alias("stem"))


@query("WITH d AS (SELECT doc_id, replace(lower(coalesce(text, '')), 'ß', 'ss') AS x FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(x, 'ation') OR contains(x, 'tion th') THEN 'estimation' END, CASE WHEN contains(x, 'der ') OR contains(x, 'ing the') THEN 'ordering' END, CASE WHEN contains(x, 'graph') OR contains(x, 'eau') THEN 'network' END, CASE WHEN contains(x, 'quer') OR contains(x, 'find') THEN 'search' END], lambda y: y IS NOT NULL), ',') AS families FROM d")
def keyword_families(t):
    """Families by folded substrings, in the lexicon's order."""
    return t("documents").select("doc_id", F.array_join(text.keyword_hits(F.col("text"), LEXICON), ",").alias("families"))


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents"
_ANY = lambda hints: " OR ".join(f"contains(f, '{h}')" for h in hints)


@query(f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, i, x, replace(lower(x), 'ß', 'ss') AS f FROM l WHERE trim(x) <> ''), g AS (SELECT doc_id, count(*) AS sections, sum(len(regexp_extract_all(x, '[A-Za-z0-9][A-Za-z0-9_''-]*'))) AS words, sum(CASE WHEN {_ANY(records.PROBLEM_HINTS)} THEN 1 ELSE 0 END) AS problem, sum(CASE WHEN {_ANY(records.METHOD_HINTS)} THEN 1 ELSE 0 END) AS method, sum(CASE WHEN len(regexp_extract_all(x, '[A-Za-z] = ')) >= 2 THEN 1 ELSE 0 END) AS dense FROM s GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(sections, 0) AS INTEGER) AS sections, CAST(coalesce(words, 0) AS INTEGER) AS words, CAST(coalesce(problem, 0) AS INTEGER) AS problem_sections, CAST(coalesce(method, 0) AS INTEGER) AS method_sections, CAST(coalesce(dense, 0) AS INTEGER) AS math_dense, CASE WHEN sections IS NULL THEN 'document contains no parsed sections,' ELSE '' END || 'document contains no parsed references' AS warnings FROM documents LEFT JOIN g USING (doc_id)""")
def document_intelligence(t):
    """Words, sections with hints of problems and methods, sections dense in equations, and warnings. Sections are the lines with ink."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    section = F.transform(lines, lambda x: F.struct(F.lit("body").alias("kind"), x.alias("text"), F.size(text.every(x, "[A-Za-z] = ")).alias("equations")))
    return t("documents").select("doc_id", records.intelligence(section, F.lit(0)).alias("r")).select("doc_id", *[f"r.{c}" for c in ("sections", "words", "problem_sections", "method_sections", "math_dense")], F.array_join("r.warnings", ",").alias("warnings"))


@query(f"WITH f AS (SELECT p_partkey, {FORMULA} AS x FROM part) SELECT p_partkey, array_to_string(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|==|<=|>=|!=|[-+*/^_=<>()\\[\\]{{}},]'), ' ') AS tokens, sha256(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS exact FROM f")
def latex_tokens(t):
    """H7: tokens and the hash of a formula's spelling."""
    d = t("part").select("p_partkey", _formula().alias("x"))
    return d.select("p_partkey", F.array_join(text.latex_tokens(F.col("x")), " ").alias("tokens"), F.sha2(text.collapse(F.col("x")), 256).alias("exact"))


@query(f"""WITH f AS (SELECT p_partkey, regexp_extract_all({FORMULA}, '\\\\?[A-Za-z]+|[^A-Za-z\\\\]+|\\\\') AS p FROM part), g AS (SELECT p_partkey, p, list_filter(p, lambda x: regexp_full_match(x, '[A-Za-z]+')) AS v FROM f), u AS (SELECT p_partkey, p, list_filter(v, lambda x, i: list_position(v, x) = i) AS v FROM g)
SELECT p_partkey, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z]+') THEN 'v' || list_position(v, x) ELSE x END), '') AS normal FROM u""")
def alpha_normalize(t):
    """H6: names renamed in order of first appearance."""
    return t("part").select("p_partkey", text.alpha_normalize(_formula()).alias("normal"))


@query(r"""SELECT p_partkey, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS id FROM (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('lodestone:part:' || p_partkey)) AS h FROM part)""")
def stable_ids(t):
    """H1: name-based identifiers."""
    return t("part").select("p_partkey", text.stable_id("part", F.col("p_partkey").cast("string")).alias("id"))


@query("""SELECT p_partkey, 'sha256:' || sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}') AS fingerprint FROM part""")
def fingerprints(t):
    """H2: hashes of compact sorted JSON."""
    return t("part").select("p_partkey", text.canonical_fingerprint(name=F.col("p_name"), brand=F.col("p_brand")).alias("fingerprint"))


_IDS = "CASE p_partkey % 13 WHEN 0 THEN 'https://doi.org/10.1/A' || p_partkey || '?x=1' WHEN 1 THEN 'PMID: ' || p_partkey WHEN 2 THEN 'pmc' || p_partkey WHEN 3 THEN 'arXiv:2401.0' || p_partkey WHEN 4 THEN 'W' || p_partkey WHEN 5 THEN 'DOI:10.2/B' || p_partkey WHEN 6 THEN 'pmcid:pmc' || p_partkey WHEN 7 THEN '2401.' || lpad(CAST(p_partkey AS STRING), 5, '0') || 'v2' WHEN 8 THEN 'https://api.openalex.org/works/W' || p_partkey || '/' WHEN 9 THEN 'openalex:W' || p_partkey WHEN 10 THEN '10.x.y/Z' || p_partkey WHEN 11 THEN 'http://dx.doi.org/10.1/q' ELSE 'none ' || p_partkey END"


@query("SELECT k AS p_partkey, CASE k % 13 WHEN 0 THEN 'doi' WHEN 1 THEN 'pmid' WHEN 2 THEN 'pmcid' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'openalex' WHEN 5 THEN 'doi' WHEN 6 THEN 'pmcid' WHEN 7 THEN 'arxiv' WHEN 8 THEN 'openalex' WHEN 9 THEN 'openalex' WHEN 10 THEN 'doi' END AS scheme, CASE k % 13 WHEN 0 THEN '10.1/a' || k WHEN 1 THEN ' ' || k WHEN 2 THEN 'PMC' || k WHEN 3 THEN '2401.0' || k WHEN 4 THEN 'W' || k WHEN 5 THEN '10.2/b' || k WHEN 6 THEN 'PMC' || k WHEN 7 THEN '2401.' || lpad(CAST(k AS VARCHAR), 5, '0') || 'v2' WHEN 8 THEN 'W' || k WHEN 9 THEN 'W' || k WHEN 10 THEN '10.x.y/z' || k END AS value FROM (SELECT p_partkey AS k FROM part)")
def identifier_parse(t):
    """Scheme and normal form of identifiers in many spellings."""
    d = t("part").select("p_partkey", F.expr(_IDS).alias("v")).withColumn("id", text.parse_identifier(F.col("v")))
    return d.select("p_partkey", F.col("id.scheme").alias("scheme"), F.col("id.value").alias("value"))


_REF = "CASE p_partkey % 4 WHEN 0 THEN 'See doi 10.1234/AB.' || p_partkey || '.; and pmid: ' || (123456 + p_partkey) WHEN 1 THEN 'arXiv: 2401.' || (10000 + p_partkey % 1000) || 'v3, PMID12345' WHEN 2 THEN 'nothing' ELSE '(10.5555/x' || p_partkey || ')' END"


@query("SELECT p_partkey, p_size AS ord, CASE p_partkey % 4 WHEN 0 THEN 'doi=10.1234/ab.' || p_partkey || ',pmid=' || (123456 + p_partkey) WHEN 1 THEN 'arxiv=2401.' || (10000 + p_partkey % 1000) || 'v3' WHEN 2 THEN '' ELSE 'doi=10.5555/x' || p_partkey END AS identifiers FROM part")
def reference_records(t):
    """References as records with the identifiers that their text names."""
    d = t("part").select("p_partkey", records.reference(F.col("p_partkey").cast("string"), F.col("p_size"), F.expr(_REF)).alias("r"))
    return d.select("p_partkey", F.col("r.ord").alias("ord"), F.array_join(F.transform(F.map_entries("r.identifiers"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("identifiers"))


@query("WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS p FROM benchmark) SELECT item_id, string_agg(w, ' ' ORDER BY p) AS text FROM w GROUP BY item_id")
def inverted_index_text(t):
    """Texts rebuilt from their positions of tokens."""
    w = t("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
    m = w.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return m.select("item_id", text.inverted_text(F.col("index")).alias("text"))


@query("WITH f AS (SELECT text AS t, item_id, len(text) AS weight FROM benchmark), c AS (SELECT *, replace(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), 'ß', 'ss') AS folded FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY weight DESC, item_id) AS r FROM c) SELECT item_id, row_number() OVER (ORDER BY weight DESC, folded) AS rank FROM b WHERE r = 1 ORDER BY rank LIMIT 24")
def query_compile(t):
    """Of equal folded clauses the heaviest, and the best 24."""
    d = t("benchmark").select(F.lit("all").alias("concept"), "text", F.length("text").alias("weight"), F.col("item_id").alias("ord"))
    return vocabulary.compile_clauses(d, "concept").select(F.col("ord").alias("item_id"), "rank")


@query("WITH p AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part) SELECT p_brand, i // 8 AS batch, min(i) AS \"offset\", count(*) AS n, string_agg('\"' || p_name || '\"', ' OR ' ORDER BY i) AS rendered FROM p GROUP BY p_brand, i // 8")
def query_batches(t):
    """Clauses in chunks of eight, quoted and joined."""
    d = t("part").withColumn("q", text.quoted(F.col("p_name")))
    return ordered.batches(d, [F.col("p_retailprice").desc(), F.col("p_partkey")], "q", 8, "p_brand")


@query("SELECT page_id, regexp_replace(url, '[?#].*', '') || '?page=' || page_id || CASE page_id % 3 WHEN 0 THEN '&API_KEY=%3Credacted%3E' WHEN 1 THEN '&Authorization=%3Credacted%3E&q=a+b%2F%C3%A9' ELSE '&mailto=%3Credacted%3E&blank=' END || '#top' AS redacted FROM pages")
def url_redaction(t):
    """The pages' addresses with parameters of each kind, secrets hidden and the rest encoded anew."""
    more = F.expr("CASE page_id % 3 WHEN 0 THEN '&API_KEY=s%20x' WHEN 1 THEN '&Authorization=Bearer+1&q=a%20b/é' ELSE '&mailto=a@b.c&&blank' END")
    url = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?page="), "page_id", more, F.lit("#top"))
    return t("pages").select("page_id", text.redacted_url(url).alias("redacted"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM pages")
def clean_markup(t):
    """Tags to spaces, whitespace collapsed."""
    return t("pages").select("page_id", text.clean_markup(F.col("html")).alias("text"))


@query()
def html_sections(t):
    """Pages parsed to a title and text."""
    d = t("pages").select("page_id", parsers.html(F.col("html")).alias("d"))
    return d.select("page_id", F.col("d.title").alias("title"), F.length(F.col("d.sections")[0]["text"]).alias("chars"))


@query("WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE ELSE 0 END, 6) AS jaccard FROM p")
def set_jaccard(t):
    """Token sets of name and type."""
    return t("part").select("p_partkey", F.round(sets.jaccard(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), 6).alias("jaccard"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL) SELECT lang, w AS token, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM n JOIN documents USING (doc_id) GROUP BY lang, w")
def token_multiset(t):
    """Counts of words by language, and of the documents that hold them; words are counted where documents are read, before they move."""
    n = vocabulary.term_counts(t("documents"), text.every(F.lower("text"), "[a-z]+"), F.col("lang"))
    return n.select(F.col("by").alias("lang"), F.col("term").alias("token"), F.col("tf").alias("n"), F.col("df").alias("docs"))
