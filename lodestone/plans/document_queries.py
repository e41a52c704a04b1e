"""Documents of each format made from the tables, parsed back; the SQL gives what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula, text
from ..operators import records
from ..sources import documents as parsers
from .lineage import dealt
from .registry import query

_TEX = """replace('~title{x} before ~section{On ' || p_name || '} First  part. ~begin{align*} a_' || p_size || ' = b ~end{align*} ~subsection*{Sub} tail ~[ c < d ~] ~begin{equation}~sum_i x~end{equation}' || CASE WHEN p_partkey % 2 = 0 THEN '~begin{thebibliography}{9}~bibitem[K]{k} A ref  doi:10.1234/z' || p_partkey || ' ~bibitem{l} Other~end{thebibliography}' ELSE '' END, '~', chr(92))"""


def _parts(t):
    return dealt(t("part").select("p_partkey", "p_name", "p_size"), "p_partkey")


@query("""SELECT p_partkey, 'On ' || p_name AS title, CAST(2 AS INTEGER) AS sections, 'section,subsection' AS kinds, 'tail' AS starts, 'a_' || p_size || ' = b|' || chr(92) || 'sum_i x|c < d' AS equations,
CASE WHEN p_partkey % 2 = 0 THEN 'A ref doi:10.1234/z' || p_partkey || '|Other' ELSE '' END AS refs, CASE WHEN p_partkey % 2 = 0 THEN '10.1234/z' || p_partkey END AS doi FROM part""")
def latex_documents(t):
    """LaTeX parsed natively to sections, equations and references."""
    d = _parts(t).select("p_partkey", parsers.parser("LaTeX")(F.expr(_TEX)).alias("d"))
    kinds = F.array_join(F.transform("d.sections", lambda s: s["kind"]), ",")
    doi = text.reference_ids(F.get("d.refs", 0))["doi"]
    return d.select("p_partkey", "d.title", F.size("d.sections").alias("sections"), kinds.alias("kinds"), F.substring(F.get("d.sections", 1)["text"], 1, 4).alias("starts"), F.array_join("d.equations", "|").alias("equations"), F.array_join("d.refs", "|").alias("refs"), doi.alias("doi"))


_JATS = """'<article><front/><body><sec><title>T ' || p_name || '</title><p>one <b>two</b></p><p> </p><disp-quote>three</disp-quote><sec><p>inner &amp; more</p></sec></sec><sec><x>dropped</x></sec><fig id="f"><caption><p>cap ' || p_size || '</p></caption></fig><table-wrap/><disp-formula><tex-math>a=' || p_size || '</tex-math></disp-formula></body><back><ref-list><ref>R1</ref><ref> </ref></ref-list></back></article>'"""
_TEI = """'<TEI xmlns="u"><text><body><div><head>H</head><p>p1</p><ab>' || p_name || '</ab></div><div/></body></text><listBibl><bibl>B ' || p_size || '</bibl></listBibl></TEI>'"""


@query("""SELECT p_partkey, 'T ' || p_name || '|' AS titles, 'one two/three|inner & more' AS texts, 'cap ' || p_size AS figures, 1 AS tables, 'a=' || p_size AS equations, 'R1' AS refs, 'H|' AS tei_titles, 'p1/' || p_name || '|' AS tei_texts, 'B ' || p_size AS tei_refs FROM part""")
def xml_documents(t):
    """JATS and TEI parsed to sections, equations, figures, tables and references."""
    d = _parts(t).select("p_partkey", parsers.jats(F.expr(_JATS)).alias("j"), parsers.tei(F.expr(_TEI)).alias("t"))
    listed = lambda c, f: F.array_join(F.transform(c, lambda s: F.coalesce(F.replace(s[f], F.lit("\n\n"), F.lit("/")), F.lit(""))), "|")
    return d.select("p_partkey", listed("j.sections", "title").alias("titles"), listed("j.sections", "text").alias("texts"), F.array_join("j.figures", "|").alias("figures"), F.size("j.tables").alias("tables"), F.array_join("j.equations", "|").alias("equations"), F.array_join("j.refs", "|").alias("refs"), listed("t.sections", "title").alias("tei_titles"), listed("t.sections", "text").alias("tei_texts"), F.array_join("t.refs", "|").alias("tei_refs"))


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text, CAST(len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x)))) AS INTEGER) AS tokens FROM documents")
def text_documents(t):
    """Plain texts as one section, and the distinct folded tokens of a document."""
    d = t("documents").select("doc_id", parsers.text(F.coalesce("text", F.lit(""))).alias("d"))
    whole = records.document_text(F.col("d.sections"))
    return d.select("doc_id", whole.alias("text"), F.size(records.token_set(whole)).alias("tokens"))


@query("""SELECT p_partkey, k AS place, CASE k WHEN 0 THEN '' WHEN 1 THEN 'sum' ELSE '' END AS operators, CASE k WHEN 0 THEN 'equals' WHEN 2 THEN 'lt' END AS relation, k = 1 AS commands FROM part, range(3) AS r(k)""")
def document_formulas(t):
    """One row an equation of each parsed document, with its features."""
    d = _parts(t).select("p_partkey", parsers.latex(F.expr(_TEX)).alias("d")).select("p_partkey", F.posexplode("d.equations").alias("place", "x"))
    d = d.withColumn("f", formula.features(F.col("x"))).withColumn("g", formula.fingerprint(F.col("x")))
    return d.select("p_partkey", "place", F.array_join("f.operators", " ").alias("operators"), F.col("g.relation").alias("relation"), (F.size("f.commands") > 0).alias("commands"))


@query("SELECT p_partkey, sha256('{\"a\":\"' || p_name || '\",\"b\":\"' || p_size || '\"}') AS fingerprint, least(8.0::DOUBLE, 0.5 * 2 ** (p_size % 7)) AS delay FROM part")
def request_fingerprints(t):
    """Hashes of payloads without their cursor, and the delay before each attempt."""
    payload = F.create_map(F.lit("cursor"), F.col("p_type"), F.lit("b"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_name"))
    return t("part").select("p_partkey", text.payload_fingerprint(payload).alias("fingerprint"), text.retry_delay(F.col("p_size") % 7 + 1, F.lit(None)).alias("delay"))
