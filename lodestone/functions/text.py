"""Scalar text operators as column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words left out of lexical tokens
STOP = ("the", "and", "for", "with", "from", "that", "this")
# fixed values: redacted URL parameters
SECRETS = ("api_key", "apikey", "access_token", "token", "key", "authorization", "email", "mailto")
# fixed value: tokens of a formula
LATEX_TOKEN = r"\\[A-Za-z]+|[A-Za-z][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|==|<=|>=|!=|[-+*/^_=<>()\[\]{},]"
# fixed values: relations, in the order tried, and their names
RELATIONS = (("=", "equals"), ("<=", "le"), (">=", "ge"), ("<", "lt"), (">", "gt"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def lexical_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.transform(every(c, r"[A-Za-z][A-Za-z0-9_-]{2,}"), F.lower)), F.array(*map(F.lit, STOP)))


def word_tokens(c: Column) -> Column:
    return every(c, r"[A-Za-z0-9][A-Za-z0-9_'-]*")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_markup(c: Column) -> Column:
    """Tags to spaces, whitespace collapsed; null if nothing is left."""
    return F.nullif(collapse(F.regexp_replace(c, "<[^>]+>", " ")), F.lit(""))


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: s != "")


def sentence_windows(c: Column, size: int = 3) -> Column:
    """Overlapping windows of `size` sentences, the last ones shorter."""
    return let(sentences(c), lambda s: F.transform(s, lambda _, i: F.array_join(F.slice(s, i + 1, size), " ")))


def evidence_sentence(c: Column, patterns: Column, cap: int = 700) -> Column:
    """The first sentence that holds one of the (folded) patterns; here a sentence ends at any stop before white space, whatever follows."""
    parts = F.split(F.regexp_replace(c, r"\s+", " "), r"(?<=[.!?])\s+")
    hit = F.filter(parts, lambda s: F.exists(patterns, lambda p: F.contains(casefold(s), p)))
    return F.substring(F.try_element_at(hit, F.lit(1)), 1, cap)


def ngrams(tokens: Column, most: int = 3) -> Column:
    """All runs of 1 to `most` tokens, joined by a space."""
    runs = lambda t, n: F.transform(F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(tokens, lambda t: F.flatten(F.array(*[runs(t, n) for n in range(1, most + 1)])))


def alpha_normalize(c: Column) -> Column:
    """Names in order of first appearance become v1, v2, ...; commands stay."""
    named = lambda p: p.rlike("^[A-Za-z]+$")
    renamed = lambda parts, names: F.transform(parts, lambda p: F.when(named(p), F.concat(F.lit("v"), F.array_position(names, p).cast("string"))).otherwise(p))
    return let(every(c, r"\\?[A-Za-z]+|[^A-Za-z\\]+|\\"), lambda parts: F.array_join(let(F.array_distinct(F.filter(parts, named)), lambda names: renamed(parts, names)), ""))


def latex_tokens(c: Column) -> Column:
    return every(c, LATEX_TOKEN)


def relation(tokens: Column) -> Column:
    """struct(name, left, right): the first relation, in their order, that is a token, and what stands before and behind its first place; null without one."""
    out = F.lit(None).cast("struct<name: string, left: string, right: string>")
    for sign, name in reversed(RELATIONS):
        at = F.array_position(tokens, F.lit(sign)).cast("int")
        part = lambda start, n: F.array_join(F.slice(tokens, start, n), " ")
        found = F.struct(F.lit(name).alias("name"), part(F.lit(1), F.greatest(at - 1, F.lit(0))).alias("left"), part(at + 1, F.greatest(F.size(tokens) - at, F.lit(0))).alias("right"))
        out = F.when(F.array_contains(tokens, sign), found).otherwise(out)
    return out


def multiset(tokens: Column) -> Column:
    """token -> count, in order of tokens: runs of the sorted tokens, so the work is that of a sort."""

    def counted(s):
        heads = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        runs = lambda h: F.map_from_arrays(F.transform(h, lambda i: F.get(s, i)), F.transform(h, lambda i, k: F.coalesce(F.get(h, k + 1), F.size(s)) - i))
        return let(heads, runs)

    return let(F.array_sort(tokens), counted)


def stable_id(namespace: str, value: Column, domain: str = "lodestone") -> Column:
    """UUID version 5 of domain:namespace:value under the URL namespace."""
    url = "6ba7b8119dad11d180b400c04fd430c8"
    h = F.sha1(F.concat(F.unhex(F.lit(url)), F.encode(F.concat(F.lit(f"{domain}:{namespace}:"), F.trim(value)), "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*map(F.lit, "89ab")), nibble + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_fingerprint(**fields: Column) -> Column:
    """sha256 of the compact JSON object with sorted keys."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256))


def payload_fingerprint(payload: Column, without: str = "cursor") -> Column:
    """sha256 of the compact JSON of a map, sorted by key, but for one key."""
    own = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(payload, lambda k, _: k != without))))
    return F.sha2(F.to_json(own), 256)


def retry_delay(attempt: Column, retry_after: Column, base: float = 0.5, cap: float = 8.0) -> Column:
    """Seconds before the next attempt: as the answer says, else doubling from base up to cap; the first attempt is 1."""
    return F.coalesce(retry_after.cast("double"), F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1)))


def decade(year: Column) -> Column:
    return F.coalesce(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")), F.lit("unknown"))


def quoted(c: Column) -> Column:
    x = F.replace(collapse(c), F.lit('"'), F.lit(""))
    return F.when(x.rlike(r"[\s()\[\]{}]"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)


def normalize_doi(c: Column) -> Column:
    """Lower case without the prefix; null if nothing is left."""
    return F.nullif(casefold(F.regexp_replace(F.trim(c), r"(?i)^(https?://doi\.org/|doi:)", "")), F.lit(""))


def normalize_openalex(c: Column) -> Column:
    """The last part of a path."""
    return F.nullif(F.substring_index(F.regexp_replace(F.trim(c), "/+$", ""), "/", -1), F.lit(""))


def normalize_arxiv(c: Column) -> Column:
    """Without address, prefix and version."""
    v = F.trim(c)
    v = F.when(F.contains(v, F.lit("/abs/")), F.regexp_replace(F.substring_index(v, "/abs/", -1), r"[?#].*$", "")).otherwise(v)
    return F.regexp_replace(F.regexp_replace(v, "(?i)^arxiv:", ""), r"v[0-9]+$", "")


def parse_identifier(c: Column) -> Column:
    """struct(scheme, value) by the first rule that fits, else null."""
    v = F.trim(c)
    path = F.regexp_extract(v, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    behind = F.regexp_replace(v, "^[^:]*:", "")
    rules = [
        (r"(?i)^https?://doi\.org/", "doi", casefold(F.regexp_replace(path, "^/+", ""))),
        (r"(?i)^doi:", "doi", casefold(behind)),
        (r"(?i)^pmid:", "pmid", behind),
        (r"(?i)^pmcid:", "pmcid", F.upper(behind)),
        (r"(?i)^PMC[0-9]+$", "pmcid", F.upper(v)),
        (r"(?i)^arxiv:", "arxiv", behind),
        (r"^[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?$", "arxiv", v),
        (r"(?i)openalex\.org/", "openalex", F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)),
        (r"(?i)^openalex:", "openalex", behind),
        (r"^W[0-9]+$", "openalex", v),
        (r"(?s)^10\..*/", "doi", casefold(v)),
    ]
    out = F.lit(None).cast("struct<scheme:string,value:string>")
    for pattern, scheme, value in reversed(rules):
        out = F.when(v.rlike(pattern), F.struct(F.lit(scheme).alias("scheme"), value.alias("value"))).otherwise(out)
    return out


def reference_ids(c: Column) -> Column:
    """doi, pmid and arxiv ids named in a reference string, as a map."""
    doi = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(c, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)]+$", "")), F.lit(""))
    pmid = F.nullif(F.regexp_extract(c, r"(?i)pmid:?\s*(\d{6,9})", 1), F.lit(""))
    arxiv = F.nullif(F.regexp_extract(c, r"(?i)arxiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.lit(""))
    named = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("doi", doi), ("pmid", pmid), ("arxiv", arxiv))])
    return F.map_from_entries(F.filter(named, lambda e: e["v"].isNotNull()))


def _encoded(c: Column) -> Column:
    """Form encoding; Java leaves '*' and encodes '~', which is set right."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redacted_url(c: Column) -> Column:
    """The address with the values of secret parameters hidden and all parameters encoded anew."""
    base, fragment = F.regexp_extract(c, r"(?s)^([^?#]*)", 1), F.regexp_extract(c, r"(?s)(#.*)$", 1)
    query = F.regexp_extract(c, r"(?s)^[^?#]*\?([^#]*)", 1)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    name = lambda kv: decoded(F.substring_index(kv, "=", 1))
    value = lambda kv: decoded(F.when(F.contains(kv, F.lit("=")), F.regexp_replace(kv, "(?s)^[^=]*=", "")).otherwise(""))
    shown = lambda kv: F.concat(_encoded(name(kv)), F.lit("="), _encoded(F.when(casefold(name(kv)).isin(*SECRETS), F.lit("<redacted>")).otherwise(value(kv))))
    told = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), shown), "&")
    return F.concat(base, F.when(told != "", F.concat(F.lit("?"), told)).otherwise(""), F.when(fragment == "#", "").otherwise(fragment))


def title_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(c), r"(?U)\W+", " "))


def inverted_text(index: Column) -> Column:
    """map<token, positions> -> the text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["t"]), " ")


def keyword_hits(c: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Names, in the lexicon's order, of which a pattern is a (folded) substring."""
    folded = casefold(F.coalesce(c, F.lit("")))
    named = [F.when(F.exists(F.array(*map(F.lit, p)), lambda x: F.contains(folded, x)), F.lit(n)) for n, p in lexicon.items()]
    return F.filter(F.array(*named), lambda n: n.isNotNull())


def infer_format(mime: Column) -> Column:
    m, out = F.lower(mime), F.lit(None).cast("string")
    for name in reversed(("jats", "tei", "tex", "html", "text")):
        out = F.when(F.contains(m, F.lit(name)), name).otherwise(out)
    return out


def lenient_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))
