"""Response envelopes of a federated search: results, what grounds them, manifests, assertions and rights, from JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as j

# fixed values: fields that hold an identifier, in their order, and its scheme
IDENTIFIERS = (("doi", "doi"), ("pmid", "pmid"), ("pmcid", "pmcid"), ("arxiv_id", "arxiv"), ("openalex_id", "openalex"), ("id", "other"))
# fixed values: facets that a citation-only source denies unless it says otherwise
DENIED = ("redistribution", "retention")


def work(record: Column) -> Column:
    """struct(title, abstract, year, scheme, identifier) of a record; null without a title. Years are whole numbers only."""
    title = j.first_text(record, ("title", "display_name", "name"))
    named = [F.when(F.trim(j.text(record, n)) != "", F.struct(F.lit(s).alias("scheme"), j.text(record, n).alias("value"))) for n, s in IDENTIFIERS]
    own = F.coalesce(*named)
    year = j.first(record, ("publication_year", "year"), j.whole)
    return F.when(title.isNotNull(), F.struct(title.alias("title"), j.first_text(record, ("abstract", "abstract_text", "summary")).alias("abstract"), year.alias("year"), own["scheme"].alias("scheme"), own["value"].alias("identifier")))


def citations(v: Column) -> Column:
    """The citations as a list: of an object, one; none if there is neither an object nor a list."""
    told = j.first(v, ("citation", "citation_legacy"), j.field)
    listed = F.coalesce(F.try_variant_get(told, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.when(j.is_object(told), F.array(told)).otherwise(listed)


def problem(v: Column, receipt: bool = True) -> Column:
    """Why an envelope is refused, null if it isn't."""
    told = j.first(v, ("citation", "citation_legacy"), j.field)
    shaped = j.is_object(told) | F.coalesce(F.schema_of_variant(told).startswith("ARRAY"), F.lit(False))
    out = F.when(~j.is_object(v), "not an object").when(~shaped, "missing citation").when(F.size(citations(v)) == 0, "no citations").when(j.field(v, "data").isNull(), "missing data")
    return out.when(j.field(v, "receipt").isNull(), "missing receipt") if receipt else out


def grounds(cited: Column, i: Column) -> Column:
    """The first citation that names result i, or that names none and stands at its place."""
    indexes = lambda c: F.coalesce(F.try_variant_get(c, "$.result_index", "array<bigint>"), F.array().cast("array<bigint>"))
    placed = F.transform(cited, lambda c, p: F.struct(p.alias("p"), c.alias("c"), indexes(c).alias("named")))
    fits = lambda x: F.when(F.size(x["named"]) > 0, F.array_contains(x["named"], i.cast("long"))).otherwise(x["p"] == i)
    return F.get(F.filter(placed, fits), 0)["c"]


def hits(envelopes: DataFrame, key: str, column: str = "json") -> DataFrame:
    """One row a result of each envelope: key, place, provider, rank, fused_rank, score, source_id and the work's fields.

    An envelope with citations of which one is refused (without any citation, say) has no result; one without citations has ungrounded ones.
    """
    # an explode in place of a filter, through which the text would be parsed twice
    v = envelopes.select(key, F.explode(F.array_compact(F.array(j.parsed(F.col(column))))).alias("v"))
    has = j.first(F.col("v"), ("citation", "citation_legacy"), j.field).isNotNull() & j.field(F.col("v"), "data").isNotNull()
    found = j.first(F.col("v"), ("data.results", "data.rows", "data.hits"), j.field)
    v = v.select(key, citations(F.col("v")).alias("cited"), has.alias("has"), F.when(~has | problem(F.col("v"), receipt=False).isNull(), F.try_variant_get(found, "$", "array<variant>")).alias("rs"))
    d = v.select(key, "cited", "has", F.posexplode("rs").alias("i", "r"))
    d = d.withColumn("c", F.when(F.col("has"), grounds(F.col("cited"), F.col("i"))))
    inner = j.first(F.col("r"), ("raw_record", "record"), j.field)
    d = d.withColumn("w", work(F.coalesce(inner, F.col("r"))))
    positive = lambda c: F.when(c > 0, c)
    provider = F.coalesce(j.first_text(F.col("r"), ("provider", "source", "source_id")), j.text(F.col("c"), "provider"), F.lit("unknown"))
    return d.select(key, F.col("i").alias("place"), provider.alias("provider"), F.coalesce(positive(j.first(F.col("r"), ("provider_rank", "rank"), j.whole)), F.col("i") + 1).cast("long").alias("rank"), positive(j.whole(F.col("r"), "fused_rank")).alias("fused_rank"), j.first(F.col("r"), ("provider_score", "score"), j.number).alias("score"), j.text(F.col("c"), "source_id").alias("source_id"), "w.*")


def _end(value: Column, name: tuple[str, ...], default: Column) -> Column:
    """An end of an assertion: an object's own name, or a text."""
    told = j.first(value, name, j.field)
    return F.when(told.isNull(), default).when(j.is_object(told), j.first_text(told, ("raw_id", "id", "identifier"))).when(F.schema_of_variant(told) == "STRING", F.try_variant_get(told, "$", "string"))


def identity_assertions(envelopes: DataFrame, asked: str, column: str = "json") -> DataFrame:
    """asked (the identifier), source, relation, target, provider, confidence: relations that have all three parts."""
    v = envelopes.select(asked, j.parsed(F.col(column)).alias("v"))
    told = j.first(F.col("v"), ("data.relations", "data.edges", "data.assertions"), j.field)
    r = v.select(asked, F.explode(F.try_variant_get(told, "$", "array<variant>")).alias("r"))
    d = r.select(asked, _end(F.col("r"), ("source", "subject"), F.col(asked)).alias("source"), j.first_text(F.col("r"), ("relation", "relation_type", "type")).alias("relation"), _end(F.col("r"), ("target", "object"), F.lit(None).cast("string")).alias("target"), F.coalesce(j.first_text(F.col("r"), ("provider", "asserting_provider", "source_provider")), F.lit("unknown")).alias("provider"), j.first(F.col("r"), ("confidence", "score"), j.number).alias("confidence"))
    return d.where("source <> '' AND target <> '' AND relation IS NOT NULL")


def integrity_assertions(envelopes: DataFrame, asked: str, column: str = "json") -> DataFrame:
    """asked, subject, relation, object, provider, status: notices that name a relation; without a subject they are about what was asked."""
    v = envelopes.select(asked, j.parsed(F.col(column)).alias("v"))
    told = j.first(F.col("v"), ("data.relations", "data.notices", "data.assertions"), j.field)
    r = v.select(asked, F.explode(F.try_variant_get(told, "$", "array<variant>")).alias("r"))
    subject = F.coalesce(F.nullif(_end(F.col("r"), ("subject",), F.col(asked)), F.lit("")), F.col(asked))
    d = r.select(asked, subject.alias("subject"), j.first_text(F.col("r"), ("relation", "relation_type", "type", "status")).alias("relation"), _end(F.col("r"), ("target", "object"), F.lit(None).cast("string")).alias("object"), F.coalesce(j.first_text(F.col("r"), ("provider", "asserting_provider")), F.lit("unknown")).alias("provider"), F.coalesce(j.first_text(F.col("r"), ("status",)), F.lit("asserted")).alias("status"))
    return d.where("relation IS NOT NULL")


def harvest_page(v: Column) -> Column:
    """struct(records, cursor, exhausted) of a page: exhausted as it says, else if it has no cursor."""
    told = j.first(v, ("data.records", "data.rows", "data.hits"), j.field)
    records = F.filter(F.coalesce(F.try_variant_get(told, "$", "array<variant>"), F.array().cast("array<variant>")), j.is_object)
    cursor = j.first_text(v, ("data.next_cursor", "data.cursor"))
    return F.struct(records.alias("records"), cursor.alias("cursor"), F.coalesce(j.flag(v, "data.exhausted"), cursor.isNull()).alias("exhausted"))


def sync_providers(v: Column) -> Column:
    """array of struct(provider, status, capabilities) of a report; entries without a name are dropped."""
    data = F.when(j.is_object(j.field(v, "data")) & (F.size(F.map_keys(F.try_variant_get(v, "$.data", "map<string, variant>"))) > 0), j.field(v, "data")).otherwise(v)
    entry = lambda p: F.struct(j.first_text(p, ("provider", "id", "name")).alias("provider"), F.coalesce(j.first_text(p, ("status", "lifecycle")), F.lit("unknown")).alias("status"), F.transform(j.items(p, "capabilities"), lambda c: F.try_variant_get(c, "$", "string")).alias("capabilities"))
    return F.filter(F.transform(j.items(data, "providers"), entry), lambda e: e["provider"].isNotNull())


def coverage_dimensions(v: Column) -> Column:
    """The fields of a coverage report beside gaps and providers, as a map to JSON."""
    data = F.coalesce(F.try_variant_get(v, "$.data", "map<string, variant>"), F.try_variant_get(v, "$", "map<string, variant>"))
    return F.transform_values(F.map_filter(data, lambda k, _: ~k.isin("gaps", "providers", "provider_reports")), lambda _, x: F.to_json(x))


def operations(manifests: DataFrame, key: str, column: str = "json") -> DataFrame:
    """key, operation_id, path, capability, capabilities: the operations of a manifest that have a name and a path."""
    v = manifests.select(key, j.parsed(F.col(column)).alias("v"))
    inside = lambda n: F.when(j.is_object(j.field(F.col("v"), n)) & F.coalesce(j.field(F.col("v"), f"{n}.operations"), j.field(F.col("v"), f"{n}.capabilities"), j.field(F.col("v"), f"{n}.spec")).isNotNull(), j.field(F.col("v"), n))
    root = F.coalesce(inside("envelope"), inside("manifest"), inside("data"), F.col("v"))
    o = v.select(key, root.alias("root")).select(key, F.explode(j.objects(F.col("root"), "operations")).alias("o"))
    listed = F.transform(j.items(F.col("o"), "capabilities"), lambda c: F.try_variant_get(c, "$", "string"))
    own = F.coalesce(F.nullif(j.text(F.col("o"), "capability"), F.lit("")), F.get(listed, 0), F.lit("unknown"))
    d = o.select(key, j.first(F.col("o"), ("operation_id", "id", "name"), j.text).alias("operation_id"), j.first(F.col("o"), ("path", "url"), j.text).alias("path"), own.alias("capability"), listed.alias("capabilities"))
    return d.where("operation_id <> '' AND path <> ''")


def operations_for(found: DataFrame, capability: str) -> DataFrame:
    return found.where((F.col("capability") == capability) | F.array_contains("capabilities", capability))


def permission(rights: Column, inherited: Column, facet: str) -> Column:
    """allowed, denied or unknown, of an item's own rights if it has any, else of the inherited ones (variants)."""
    r = F.when(j.is_object(rights), rights).otherwise(inherited)
    told = j.text(r, facet)
    out = F.when(told.isin("allowed", "denied"), told)
    if facet in DENIED:
        out = out.when(F.coalesce(j.flag(r, "citation_only"), F.lit(False)), "denied")
    return out.otherwise("unknown")


def summary(envelopes: DataFrame, by: str, column: str = "json") -> DataFrame:
    """by, envelopes, citations, lineage, specs: counts of each campaign and its distinct specs."""
    v = envelopes.select(by, j.parsed(F.col(column)).alias("v"))
    d = v.select(by, F.size(citations(F.col("v"))).alias("c"), F.size(j.items(F.col("v"), "lineage")).alias("l"), j.text(F.col("v"), "spec").alias("s"))
    return d.groupBy(by).agg(F.count("*").alias("envelopes"), F.sum("c").alias("citations"), F.sum("l").alias("lineage"), F.array_sort(F.collect_set("s")).alias("specs"))


def link(runs: DataFrame, envelopes: DataFrame, campaign: str) -> DataFrame:
    """envelopes(run_id, campaign, ...): those of the runs(run_id) that belong to no campaign yet join this one."""
    met = envelopes.join(runs.select("run_id", F.lit(True).alias("_own")).distinct(), "run_id", "left")
    return met.withColumn("campaign", F.coalesce("campaign", F.when(F.col("_own"), F.lit(campaign)))).drop("_own")


def chosen(found: DataFrame, key: str, capability: str) -> DataFrame:
    """operations() of manifests -> key, operation_id, path, error: the one operation that serves a capability; none or several are an error, a manifest without operations is not there."""
    n = found.groupBy(key).agg(F.count_if(_serves(capability)).alias("n"), F.min(F.when(_serves(capability), F.struct("operation_id", "path"))).alias("o"))
    one = F.col("n") == 1
    return n.select(key, F.when(one, F.col("o.operation_id")).alias("operation_id"), F.when(one, F.col("o.path")).alias("path"), F.when(F.col("n") == 0, f"no operation serves {capability}").when(~one, f"{capability} is ambiguous").alias("error"))


def _serves(capability: str) -> Column:
    return F.coalesce((F.col("capability") == capability) | F.array_contains("capabilities", capability), F.lit(False))


def citation_edges(envelopes: DataFrame, asked: str, direction: str, column: str = "json") -> DataFrame:
    """asked, direction, place, source, target, provider, edge_id of answers on references or cited_by; ends without an id are unknown."""
    v = envelopes.select(asked, j.parsed(F.col(column)).alias("v"))
    e = v.select(asked, F.posexplode(j.items(F.col("v"), "data.edges")).alias("place", "e"))
    end = lambda n: F.coalesce(j.first_text(F.col("e"), (f"{n}.raw_id", f"{n}.id")), F.lit("unknown"))
    return e.select(asked, F.lit(direction).alias("direction"), "place", end("source").alias("source"), end("target").alias("target"), F.coalesce(j.first_text(F.col("e"), ("provider", "asserting_provider")), F.lit("unknown")).alias("provider"), j.first_text(F.col("e"), ("edge_id", "id")).alias("edge_id"))


def asset_rows(envelopes: DataFrame, asked: str, column: str = "json") -> DataFrame:
    """asked, place, id, representation, url, provider, retention: assets of the answer, else those of its first citation; rights an asset lacks are the citation's."""
    v = envelopes.select(asked, j.parsed(F.col(column)).alias("v")).withColumn("c", F.get(citations(F.col("v")), 0))
    own = j.objects(F.col("v"), "data.assets")
    listed = F.when(F.size(j.items(F.col("v"), "data.assets")) > 0, own).otherwise(F.coalesce(j.objects(F.col("c"), "assets"), F.array().cast("array<variant>")))
    a = v.select(asked, "c", F.posexplode(listed).alias("place", "a"))
    rights = permission(j.field(F.col("a"), "rights"), j.field(F.col("c"), "rights"), "retention")
    return a.select(asked, "place", j.first_text(F.col("a"), ("id", "asset_id")).alias("id"), F.coalesce(j.first_text(F.col("a"), ("representation", "type")), F.lit("unknown")).alias("representation"), j.first_text(F.col("a"), ("url", "href")).alias("url"), F.coalesce(j.text(F.col("c"), "provider"), F.lit("unknown")).alias("provider"), rights.alias("retention"))
