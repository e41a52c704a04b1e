"""Works from the records of public bibliographic sources, as column expressions over JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import json as j
from ..functions.text import casefold, clean_markup, collapse, inverted_text, let, normalize_arxiv, normalize_doi, normalize_openalex

ASSET = "struct<representation: string, url: string, mime: string>"
NO_ASSETS = f"cast(array() AS array<{ASSET}>)"


def _work(title, abstract, year, kind, identifiers, authors, assets) -> Column:
    """A work; null without a title. identifiers: (scheme, value), those that are null left out."""
    ids = F.filter(F.array(*[F.struct(F.lit(s).alias("scheme"), v.alias("value")) for s, v in identifiers]), lambda x: x["value"].isNotNull())
    parts = {"title": F.trim(title), "abstract": abstract, "year": year, "kind": kind, "identifiers": ids, "authors": authors, "assets": assets}
    return F.when(F.trim(title) != "", F.struct(*[c.alias(k) for k, c in parts.items()]))


def _names(people: Column, name) -> Column:
    return F.filter(F.transform(people, name), lambda n: F.coalesce(F.trim(n) != "", F.lit(False)))


def _asset(representation: Column, url: Column, mime: Column) -> Column:
    return F.struct(representation.alias("representation"), url.alias("url"), mime.alias("mime"))


def distinct_by_url(assets: Column) -> Column:
    """The first asset of each address; those without one are left out."""
    urls = lambda all_: F.array_distinct(F.transform(F.filter(all_, lambda a: F.length(a["url"]) > 0), lambda a: a["url"]))
    return let(assets, lambda all_: F.transform(urls(all_), lambda u: F.get(F.filter(all_, lambda a: a["url"] == u), 0)))


def openalex(v: Column) -> Column:
    """Titles by display name, abstracts from the inverted index, the primary and the best open location's addresses."""
    index = F.try_variant_get(v, "$.abstract_inverted_index", "map<string, array<int>>")
    places = [_asset(F.lit(r), j.text(v, f"{p}.{f}"), F.lit(m)) for p in ("primary_location", "best_oa_location") for f, r, m in (("pdf_url", "pdf", "application/pdf"), ("landing_page_url", "landing_page", "text/html"))]
    ids = [("openalex", normalize_openalex(j.text(v, "id"))), ("doi", normalize_doi(F.coalesce(j.text(v, "ids.doi"), j.text(v, "doi")))), ("pmid", j.text(v, "ids.pmid")), ("pmcid", j.text(v, "ids.pmcid"))]
    abstract = F.when(F.size(F.flatten(F.map_values(index))) > 0, inverted_text(index))
    return _work(j.first(v, ("display_name", "title"), j.text), abstract, j.whole(v, "publication_year"), j.text(v, "type"), ids, _names(j.items(v, "authorships"), lambda a: j.text(a, "author.display_name")), distinct_by_url(F.array(*places)))


def crossref_year(v: Column) -> Column:
    """The first date-part of the first date that has one, print before online before any before issued."""
    first_part = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{k}']['date-parts'][0][0]", "variant")) == "BIGINT", F.try_variant_get(v, f"$['{k}']['date-parts'][0][0]", "bigint"))
    return F.coalesce(*[first_part(k) for k in ("published-print", "published-online", "published", "issued")])


def crossref(v: Column) -> Column:
    """Titles are a list or a text, abstracts lose their tags."""
    listed = F.get(F.filter(F.transform(j.items(v, "title"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), 0)
    author = lambda a: F.trim(F.concat_ws(" ", F.nullif(F.trim(j.text(a, "given")), F.lit("")), F.nullif(F.trim(j.text(a, "family")), F.lit(""))))
    link = lambda x: _asset(F.when(j.text(x, "content-type").isNotNull(), "fulltext").otherwise("link"), j.text(x, "URL"), j.text(x, "content-type"))
    assets = F.filter(F.transform(j.objects(v, "link"), link), lambda a: F.length(a["url"]) > 0)
    return _work(F.coalesce(listed, j.text(v, "title")), clean_markup(j.text(v, "abstract")), crossref_year(v), j.text(v, "type"), [("doi", normalize_doi(j.text(v, "DOI")))], _names(j.objects(v, "author"), author), assets)


def europe_pmc(v: Column) -> Column:
    """Years are numbers or texts of digits; MIME types follow the style of a full text."""
    year = F.coalesce(j.whole(v, "pubYear"), F.when(j.text(v, "pubYear").rlike("^[0-9]+$"), j.text(v, "pubYear").try_cast("bigint")))

    def full(x):
        style = F.coalesce(j.text(x, "documentStyle"), F.lit("fulltext"))
        mime = F.when(F.contains(casefold(style), F.lit("pdf")), "application/pdf").when(F.contains(casefold(style), F.lit("html")), "text/html").when(F.contains(casefold(style), F.lit("xml")), "application/xml")
        return _asset(style, j.text(x, "url"), mime)

    assets = F.filter(F.transform(j.objects(v, "fullTextUrlList.fullTextUrl"), full), lambda a: F.length(a["url"]) > 0)
    ids = [("doi", normalize_doi(j.text(v, "doi"))), ("pmid", j.text(v, "pmid")), ("pmcid", j.text(v, "pmcid"))]
    return _work(j.text(v, "title"), j.text(v, "abstractText"), year, j.text(v, "pubType"), ids, _names(j.objects(v, "authorList.author"), lambda a: j.text(a, "fullName")), assets)


def arxiv(entry: Column) -> Column:
    """An Atom entry without its namespace prefixes: the version goes from the id, years come from the date."""
    schema = "id string, title string, summary string, published string, doi string, author array<struct<name string>>, link array<struct<_href string, _rel string, _type string>>"
    bare = F.regexp_replace(F.regexp_replace(entry, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    inked = lambda c: F.nullif(collapse(c), F.lit(""))
    link = lambda l: _asset(F.when(l["_type"] == "application/pdf", "pdf").otherwise(F.coalesce(l["_rel"], F.lit("alternate"))), l["_href"], l["_type"])

    def read(x):
        assets = F.filter(F.transform(F.coalesce(x["link"], F.expr("cast(array() AS array<struct<_href string, _rel string, _type string>>)")), link), lambda a: F.length(a["url"]) > 0)
        names = _names(F.coalesce(x["author"], F.expr("cast(array() AS array<struct<name string>>)")), lambda a: inked(a["name"]))
        year = F.year(F.try_to_timestamp(F.regexp_replace(inked(x["published"]), "Z$", "+00:00")))
        w = _work(inked(x["title"]), inked(x["summary"]), year.cast("bigint"), F.lit("preprint"), [("arxiv", normalize_arxiv(inked(x["id"]))), ("doi", normalize_doi(inked(x["doi"])))], names, assets)
        return F.when(inked(x["id"]).isNotNull(), w)

    return let(F.from_xml(bare, schema), read)
