"""Envelopes made of events, and records of public sources made of parts; the SQL gives what each was made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as j
from ..operators import envelopes, providers
from .lineage import dealt
from .registry import query

#: an envelope for each event, of seven shapes
ENVELOPE = """CASE event_id % 7
WHEN 0 THEN '{"data":{"results":[{"title":"T' || event_id || '","doi":"10.1/' || event_id || '","publication_year":2001,"provider":"p' || user_id % 3 || '","provider_score":0.5,"fused_rank":4}]},"citation":{"type":"source","provider":"c","source_id":"s' || event_id || '"},"spec":"v1","receipt":{}}'
WHEN 1 THEN '{"data":{"rows":[{"display_name":"D","pmid":"' || event_id || '","year":"1999"},{"name":"N","id":"x","rank":7}]},"citation":[{"provider":"a","source_id":"s0","result_index":[1]},{"provider":"b","source_id":"s1"}],"lineage":[{"step":0},{"step":1}],"spec":"v' || user_id % 2 || '"}'
WHEN 2 THEN '{"data":{"hits":[{"title":"never shown"}]},"citation":[],"lineage":[{"step":0}]}'
WHEN 3 THEN '{"rows":[1]}'
WHEN 4 THEN '{"data":{"results":[{"record":{"title":"  ","name":"R' || event_id || '","openalex_id":"W1","publication_year":1980,"summary":"about"},"source":"src","provider_rank":0,"rank":3,"score":2}]}}'
WHEN 5 THEN 'not json'
ELSE '{"data":{"results":[{"doi":"10.9/none"}]},"citation_legacy":{"provider":"old","source_id":"o"}}' END"""
_TOLD = "SELECT event_id, CAST(place AS INTEGER) AS place, provider, CAST(rank AS BIGINT) AS rank, CAST(fused_rank AS BIGINT) AS fused_rank, score, source_id, title, abstract, CAST(year AS BIGINT) AS year, scheme, identifier FROM ("


@query(_TOLD + """SELECT event_id, 0 AS place, 'p' || user_id % 3 AS provider, 1 AS rank, 4 AS fused_rank, 0.5::DOUBLE AS score, 's' || event_id AS source_id, 'T' || event_id AS title, NULL AS abstract, 2001 AS year, 'doi' AS scheme, '10.1/' || event_id AS identifier FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 0, 'unknown', 1, NULL, NULL, NULL, 'D', NULL, NULL, 'pmid', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 7 = 1
UNION ALL SELECT event_id, 1, 'a', 7, NULL, NULL, 's0', 'N', NULL, NULL, 'other', 'x' FROM events WHERE event_id % 7 = 1
UNION ALL SELECT event_id, 0, 'src', 1, NULL, 2.0, NULL, 'R' || event_id, 'about', 1980, 'openalex', 'W1' FROM events WHERE event_id % 7 = 4
UNION ALL SELECT event_id, 0, 'old', 1, NULL, NULL, 'o', NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 7 = 6)""")
def search_hits(t):
    """Ranked hits of federated searches, with the citation that grounds each."""
    return envelopes.hits(t("events").select("event_id", F.expr(ENVELOPE).alias("json")), "event_id")


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'missing receipt' WHEN 2 THEN 'no citations' WHEN 3 THEN 'missing citation' WHEN 4 THEN 'missing citation' WHEN 5 THEN 'not an object' ELSE 'missing receipt' END AS problem FROM events")
def envelope_problems(t):
    """Why an envelope is refused, null if it isn't."""
    return t("events").select("event_id", envelopes.problem(j.parsed(F.expr(ENVELOPE))).alias("problem"))


@query("SELECT user_id, count(*) AS envelopes, CAST(sum(CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 6 THEN 1 ELSE 0 END) AS BIGINT) AS citations, CAST(sum(CASE event_id % 7 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS lineage, coalesce(string_agg(DISTINCT CASE event_id % 7 WHEN 0 THEN 'v1' WHEN 1 THEN 'v' || user_id % 2 END, ',' ORDER BY CASE event_id % 7 WHEN 0 THEN 'v1' WHEN 1 THEN 'v' || user_id % 2 END), '') AS specs FROM events GROUP BY user_id")
def envelope_summary(t):
    """Envelopes, citations, lineage and distinct specs of each campaign."""
    d = envelopes.summary(t("events").select("user_id", F.expr(ENVELOPE).alias("json")), "user_id")
    return d.select("user_id", "envelopes", "citations", "lineage", F.array_join("specs", ",").alias("specs"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'old' WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'new' END AS campaign FROM events")
def envelope_campaigns(t):
    """C17: envelopes of some runs join a campaign if they have none."""
    e = t("events").select("event_id", F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 5 == 0, "old").alias("campaign"))
    return envelopes.link(t("events").where("event_type = 'error'").select(F.col("user_id").alias("run_id")), e, "new").select("event_id", "campaign")


RELATIONS = """CASE s_suppkey % 4
WHEN 0 THEN '{"data":{"relations":[{"source":{"raw_id":"a' || s_suppkey || '"},"target":"b","relation":"same_as","provider":"p","confidence":0.5},{"target":"c"},{"object":{"id":"d"},"type":"retracts","status":"final"}]}}'
WHEN 1 THEN '{"data":{"edges":[{"subject":"e","object":{"identifier":"f"},"relation_type":"same_work","asserting_provider":"q","score":1}],"notices":[{"status":"withdrawn"},{"x":1}]}}'
WHEN 2 THEN '{"data":{"assertions":[{"subject":{"name":"none"},"target":"g","relation":"updates"}]}}' ELSE '{"data":{}}' END"""


@query("""SELECT asked, source, relation, target, provider, confidence FROM (
SELECT 'i' || s_suppkey AS asked, 'a' || s_suppkey AS source, 'same_as' AS relation, 'b' AS target, 'p' AS provider, 0.5::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'i' || s_suppkey, 'i' || s_suppkey, 'retracts', 'd', 'unknown', NULL FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'i' || s_suppkey, 'e', 'same_work', 'f', 'q', 1.0 FROM supplier WHERE s_suppkey % 4 = 1)""")
def identity_assertions(t):
    """Identity relations of many shapes as assertion rows."""
    return envelopes.identity_assertions(t("supplier").select(F.concat(F.lit("i"), "s_suppkey").alias("asked"), F.expr(RELATIONS).alias("json")), "asked")


@query("""SELECT * FROM (SELECT 'i' || s_suppkey AS asked, 'i' || s_suppkey AS subject, 'same_as' AS relation, 'b' AS object, 'p' AS provider, 'asserted' AS status FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'i' || s_suppkey, 'i' || s_suppkey, 'retracts', 'd', 'unknown', 'final' FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'i' || s_suppkey, 'i' || s_suppkey, 'withdrawn', NULL, 'unknown', 'withdrawn' FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT 'i' || s_suppkey, 'i' || s_suppkey, 'updates', 'g', 'unknown', 'asserted' FROM supplier WHERE s_suppkey % 4 = 2)""")
def integrity_assertions(t):
    """Integrity notices of many shapes as assertion rows."""
    return envelopes.integrity_assertions(t("supplier").select(F.concat(F.lit("i"), "s_suppkey").alias("asked"), F.expr(RELATIONS).alias("json")), "asked")


MANIFEST = """CASE s_suppkey % 3
WHEN 0 THEN '{"manifest":{"spec":"s","operations":[{"operation_id":"o' || s_suppkey || '","path":"/a","capability":"search"},{"id":"p","url":"/b","capabilities":["fetch","search"]},{"name":"q"},{"path":"/c"},7]},"operations":[{"id":"wrong","path":"/w"}]}'
WHEN 1 THEN '{"operations":[{"name":"r","path":"/d"}],"data":{"x":1}}' ELSE '{"operations":"none"}' END"""


@query("""SELECT s_suppkey, operation_id, path, capability, searches FROM (SELECT s_suppkey, 'o' || s_suppkey AS operation_id, '/a' AS path, 'search' AS capability, true AS searches FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'p', '/b', 'fetch', true FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'r', '/d', 'unknown', false FROM supplier WHERE s_suppkey % 3 = 1)""")
def manifest_operations(t):
    """Operations of manifests, and whether each serves a search; of A15, which operations serve a capability."""
    o = envelopes.operations(t("supplier").select("s_suppkey", F.expr(MANIFEST).alias("json")), "s_suppkey")
    can = envelopes.operations_for(o, "search").select("s_suppkey", "operation_id", F.lit(True).alias("searches"))
    return o.join(can, ["s_suppkey", "operation_id"], "left").select("s_suppkey", "operation_id", "path", "capability", F.coalesce("searches", F.lit(False)).alias("searches"))


PAGE = """CASE s_suppkey % 4 WHEN 0 THEN '{"data":{"records":[{"a":1},2,{"b":2}],"next_cursor":"n' || s_suppkey || '","exhausted":false}}' WHEN 1 THEN '{"data":{"rows":[{"a":1}]}}' WHEN 2 THEN '{"data":{"records":"x","cursor":"c","exhausted":true}}'
ELSE '{"data":{"providers":[{"name":"z","lifecycle":"live","capabilities":["s","f"]},{"status":"nameless"}],"gaps":[1],"years":{"from":1990},"langs":3}}' END"""


@query("SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS records, CASE s_suppkey % 4 WHEN 0 THEN 'n' || s_suppkey WHEN 2 THEN 'c' END AS cursor, s_suppkey % 4 <> 0 AS exhausted, CASE WHEN s_suppkey % 4 = 3 THEN 'z:live:s+f' ELSE '' END AS providers, CASE s_suppkey % 4 WHEN 3 THEN 'langs=3,years={\"from\":1990}' END AS dimensions FROM supplier")
def harvest_pages(t):
    """Pages of a cursor harvest, providers of a sync report, and dimensions of a coverage report."""
    v = j.parsed(F.expr(PAGE))
    d = t("supplier").select("s_suppkey", envelopes.harvest_page(v).alias("p"), envelopes.sync_providers(v).alias("s"), envelopes.coverage_dimensions(v).alias("c"))
    told = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["provider"], x["status"], F.array_join(x["capabilities"], "+"))), ",")
    dims = F.when(F.col("s_suppkey") % 4 == 3, F.array_join(F.transform(F.array_sort(F.map_entries("c")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))
    return d.select("s_suppkey", F.size("p.records").alias("records"), "p.cursor", "p.exhausted", told.alias("providers"), dims.alias("dimensions"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'denied' WHEN 2 THEN 'denied' ELSE 'allowed' END AS retention, CASE p_size % 4 WHEN 2 THEN 'unknown' WHEN 3 THEN 'denied' ELSE 'unknown' END AS tdm FROM part")
def rights_facets(t):
    """Permissions of facets; own rights go before inherited ones, and citation-only denies what is not said."""
    own = F.expr("""CASE p_size % 4 WHEN 0 THEN '{"retention":"allowed","citation_only":true}' WHEN 1 THEN '{"retention":"denied"}' WHEN 2 THEN '{"citation_only":true,"retention":"unknown","tdm":"maybe"}' END""")
    both = t("part").select("p_partkey", j.parsed(own).alias("own"), j.parsed(F.lit('{"retention":"allowed","tdm":"denied"}')).alias("other"))
    return both.select("p_partkey", *[envelopes.permission(F.col("own"), F.col("other"), f).alias(f) for f in ("retention", "tdm")])


#: records of four sources for each part
WORKS = """CASE p_partkey % 4
WHEN 0 THEN '{"display_name":" ' || p_name || ' ","id":"https://x.org/W' || p_partkey || '","ids":{"doi":"https://doi.org/10.1/A' || p_partkey || '","pmid":"p1"},"publication_year":' || (1900 + p_size) || ',"type":"article","abstract_inverted_index":{"two":[1],"one":[0,2]},"authorships":[{"author":{"display_name":"A B"}},{"author":{}}],"primary_location":{"pdf_url":"u1","landing_page_url":"u2"},"best_oa_location":{"pdf_url":"u1","landing_page_url":"u3"}}'
WHEN 1 THEN '{"title":["", "' || p_name || '"],"DOI":"10.2/B","abstract":"<p>x  <b>y</b></p>","issued":{"date-parts":[[1990,1]]},"published-online":{"date-parts":[[' || (1900 + p_size) || ']]},"published-print":{"date-parts":[["1999"]]},"author":[{"given":"G","family":"F"},{"family":"H"},{}],"link":[{"URL":"u","content-type":"text/xml"},{"URL":"v"},{"x":1}]}'
WHEN 2 THEN '{"title":"' || p_name || '","pmid":"7","pmcid":"PMC7","pubYear":"' || (1900 + p_size) || '","pubType":"review","abstractText":"abs","authorList":{"author":[{"fullName":"Q R"},{"fullName":" "}]},"fullTextUrlList":{"fullTextUrl":[{"url":"u","documentStyle":"pdf"},{"url":"v"},{"documentStyle":"html"}]}}'
ELSE '<entry xmlns="http://a.org/x" xmlns:m="http://m.org"><id>http://a.org/abs/2401.0' || p_partkey || 'v2</id><title> ' || p_name || '  </title><summary>s</summary><published>' || (1900 + p_size) || '-02-03T00:00:00Z</published><m:doi>10.3/C</m:doi><author><name>X Y</name></author><link href="h1" rel="alternate" type="text/html"/><link href="h2" type="application/pdf"/></entry>' END"""


@query("""SELECT p_partkey, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'one two one' WHEN 1 THEN 'x y' WHEN 2 THEN 'abs' ELSE 's' END AS abstract, CAST(1900 + p_size AS BIGINT) AS year, CASE p_partkey % 4 WHEN 0 THEN 'article' WHEN 2 THEN 'review' WHEN 3 THEN 'preprint' END AS kind,
CASE p_partkey % 4 WHEN 0 THEN 'openalex:W' || p_partkey || ',doi:10.1/a' || p_partkey || ',pmid:p1' WHEN 1 THEN 'doi:10.2/b' WHEN 2 THEN 'pmid:7,pmcid:PMC7' ELSE 'arxiv:2401.0' || p_partkey || ',doi:10.3/c' END AS identifiers,
CASE p_partkey % 4 WHEN 0 THEN 'A B' WHEN 1 THEN 'G F,H' WHEN 2 THEN 'Q R' ELSE 'X Y' END AS authors,
CASE p_partkey % 4 WHEN 0 THEN 'pdf=u1,landing_page=u2,landing_page=u3' WHEN 1 THEN 'fulltext=u,link=v' WHEN 2 THEN 'pdf=u,fulltext=v' ELSE 'alternate=h1,pdf=h2' END AS assets FROM part""")
def source_works(t):
    """Works from the records of four public sources."""
    d = dealt(t("part").select("p_partkey", "p_name", "p_size"), "p_partkey").select("p_partkey", F.expr(WORKS).alias("raw")).withColumn("v", j.parsed(F.col("raw")))
    k = F.col("p_partkey") % 4
    d = d.withColumn("w", F.when(k == 0, providers.openalex(F.col("v"))).when(k == 1, providers.crossref(F.col("v"))).when(k == 2, providers.europe_pmc(F.col("v"))).otherwise(providers.arxiv(F.col("raw"))))
    listed = lambda c, sep, a, b: F.array_join(F.transform(f"w.{c}", lambda x: F.concat(x[a], F.lit(sep), x[b])), ",").alias(c)
    return d.select("p_partkey", "w.title", "w.abstract", "w.year", "w.kind", listed("identifiers", ":", "scheme", "value"), F.array_join("w.authors", ",").alias("authors"), listed("assets", "=", "representation", "url"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 1 THEN NULL END AS operation_id, CASE s_suppkey % 3 WHEN 0 THEN 'search is ambiguous' ELSE 'no operation serves search' END AS error, CASE WHEN s_suppkey % 3 = 0 THEN 'p' END AS fetches FROM supplier WHERE s_suppkey % 3 < 2")
def operation_dispatch(t):
    """The operation of each manifest that serves a search or a fetch, or why none can be chosen."""
    o = envelopes.operations(t("supplier").select("s_suppkey", F.expr(MANIFEST).alias("json")), "s_suppkey")
    fetch = envelopes.chosen(o, "s_suppkey", "fetch").select("s_suppkey", F.col("operation_id").alias("fetches"))
    return envelopes.chosen(o, "s_suppkey", "search").join(fetch, "s_suppkey").select("s_suppkey", "operation_id", "error", "fetches")


_EDGES = """CASE s_suppkey % 4 WHEN 0 THEN '{"data":{"edges":[{"source":{"raw_id":"a' || s_suppkey || '","id":"no"},"target":{"id":"b"},"provider":"p","edge_id":"e1"},{"source":"text","target":{"raw_id":" "},"asserting_provider":"q","id":"e2"},7]}}'
WHEN 1 THEN '{"data":{"edges":"none"}}' WHEN 2 THEN '{"data":{"edges":[{"target":{"id":"c"}}]}}' END"""


@query("""SELECT s_suppkey, 'references' AS direction, CAST(place AS INTEGER) AS place, source, target, provider, edge_id FROM (SELECT s_suppkey, 0 AS place, 'a' || s_suppkey AS source, 'b' AS target, 'p' AS provider, 'e1' AS edge_id FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, 1, 'unknown', 'unknown', 'q', 'e2' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 2, 'unknown', 'unknown', 'unknown', NULL FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 0, 'unknown', 'c', 'unknown', NULL FROM supplier WHERE s_suppkey % 4 = 2)""")
def reference_edges(t):
    """Citation edges of answers, well formed or not."""
    return envelopes.citation_edges(t("supplier").select("s_suppkey", F.expr(_EDGES).alias("json")), "s_suppkey", "references")


_ASSETS = """CASE s_suppkey % 4 WHEN 0 THEN '{"data":{"assets":[{"id":"x' || s_suppkey || '","representation":"jats","url":"u","rights":{"retention":"denied"}},{"asset_id":"y","type":"pdf","href":"v"},"text"]},"citation":[{"provider":"c","rights":{"retention":"allowed"},"assets":[{"id":"not this"}]}]}'
WHEN 1 THEN '{"data":{"assets":[]},"citation":{"provider":"d","rights":{"citation_only":true},"assets":[{"id":"z","url":"w"}]}}' WHEN 2 THEN '{"data":{},"citation":[]}' END"""


@query("""SELECT s_suppkey, CAST(place AS INTEGER) AS place, id, representation, url, provider, retention FROM (SELECT s_suppkey, 0 AS place, 'x' || s_suppkey AS id, 'jats' AS representation, 'u' AS url, 'c' AS provider, 'denied' AS retention FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, 1, 'y', 'pdf', 'v', 'c', 'allowed' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 0, 'z', 'unknown', 'w', 'd', 'denied' FROM supplier WHERE s_suppkey % 4 = 1)""")
def answered_assets(t):
    """Assets of answers, else of their first citation, with rights that they inherit."""
    return envelopes.asset_rows(t("supplier").select("s_suppkey", F.expr(_ASSETS).alias("json")), "s_suppkey")
