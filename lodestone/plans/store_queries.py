"""Stores of records with children in two versions, tallies of one pass, and a campaign that is stopped and resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import children, observed, ordered, state
from ..sources.tableset import Changes, table
from .campaign import Stage, run_campaign, summary
from .lineage import shared_folder
from .registry import query


def _problems(t, version: int):
    k, v = F.col("p_partkey"), F.lit(version)
    name, pick = F.split("p_name", " "), lambda n: F.slice(F.split("p_name", " "), 1, (k % n).cast("int") + version)
    objects = F.transform(pick(2), lambda x: F.struct(x.alias("name"), F.lit("word").alias("object_type"), F.when(F.lit(version) == 1, "rep").alias("representation"), F.lit(None).cast("string").alias("role")))
    method = lambda c, role: F.struct(c.alias("name"), F.when(k % 3 > 0, F.col("p_brand")).alias("method_type"), role.cast("string").alias("role"))
    d = t("part").select(
        k.cast("string").alias("id"), (k % 50).cast("string").alias("work_id"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("task_family"), F.concat("p_name", F.lit(" v"), v.cast("string")).alias("statement"), (F.col("p_size") / 50).alias("confidence"),
        F.transform(pick(3), lambda x: F.upper(x)).alias("evidence"), objects.alias("objects"), F.array(method(F.col("p_type"), F.lit(None))).alias("known_methods"), F.when(k % 2 == 0, F.array(method(name[0], F.when(k % 4 == 0, "own")))).otherwise(F.array()).alias("classical_baselines"),
    )
    return d if version == 1 else d.where("CAST(id AS BIGINT) % 5 < 2")


_V = "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey % 5 < 2 THEN 2 ELSE 1 END AS v FROM part"


@query(f"""WITH x AS ({_V}) SELECT 'problem' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name || ' v' || v AS what, 0 AS place FROM x
UNION ALL SELECT 'evidence', CAST(p_partkey AS VARCHAR), upper(unnest(string_split(p_name, ' ')[:p_partkey % 3 + v])), unnest(range(least(len(string_split(p_name, ' ')), p_partkey % 3 + v))) FROM x
UNION ALL SELECT 'object', CAST(p_partkey AS VARCHAR), unnest(string_split(p_name, ' ')[:p_partkey % 2 + v]) || CASE v WHEN 1 THEN ':rep' ELSE ':' END || ':unspecified', 0 FROM x
UNION ALL SELECT 'method', CAST(p_partkey AS VARCHAR), p_type || ':' || CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'unknown' END || ':known_method', 0 FROM x
UNION ALL SELECT 'method', CAST(p_partkey AS VARCHAR), split_part(p_name, ' ', 1) || ':' || CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'unknown' END || CASE WHEN p_partkey % 4 = 0 THEN ':own' ELSE ':classical_baseline' END, 0 FROM x WHERE p_partkey % 2 = 0""")
def problem_store(t):
    """Problems and their children after a second version of two fifths, in one commit each."""
    spark = t("part").sparkSession
    folder = f"{shared_folder(spark)}/problems-{uuid.uuid4().hex}"
    for version in (1, 2):
        with Changes(spark, folder) as c:
            children.put_problems(c, _problems(t, version))
    read = lambda name: table(spark, folder, name)
    none = F.lit(0)
    o, m = read("objects").withColumnRenamed("id", "object_id"), read("methods").withColumnRenamed("id", "method_id")
    parts = [
        read("problems").select(F.lit("problem").alias("kind"), "id", F.col("statement").alias("what"), none.alias("place")),
        read("problem_evidence").select(F.lit("evidence").alias("kind"), F.col("problem_id").alias("id"), F.col("quote").alias("what"), "place"),
        read("problem_objects").join(o, "object_id").select(F.lit("object").alias("kind"), F.col("problem_id").alias("id"), F.concat_ws(":", "name", F.coalesce("canonical_form", F.lit("")), "role").alias("what"), none.alias("place")),
        read("problem_methods").join(m, "method_id").select(F.lit("method").alias("kind"), F.col("problem_id").alias("id"), F.concat_ws(":", "name", F.coalesce("method_type", F.lit("unknown")), "role").alias("what"), none.alias("place")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH m AS (SELECT o_custkey AS f, o_orderkey AS k, 1 AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_orderkey % 3 = 0), d AS (SELECT f, k % 97 AS member, min(v) AS v, min(CASE WHEN v = 1 THEN k END) AS k1, min(CASE WHEN v = 2 THEN k END) AS k2 FROM m GROUP BY 1, 2)
SELECT CAST(f AS VARCHAR) AS family, CAST(member AS VARCHAR) AS member, CAST(row_number() OVER (PARTITION BY f ORDER BY v, CASE v WHEN 1 THEN k1 ELSE k2 END) - 1 AS INTEGER) AS place, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.f = d.f AND m.v = 2) THEN 'v2' ELSE 'v1' END AS name FROM d""")
def family_store(t):
    """Families of customers whose members of a second version join those of the first, once each and behind them."""
    orders = t("orders")
    spark = orders.sparkSession
    folder = f"{shared_folder(spark)}/families-{uuid.uuid4().hex}"
    for version, part in ((1, "o_orderkey % 2 = 0"), (2, "o_orderkey % 3 = 0")):
        listed = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: (k % 97).cast("string"))
        with Changes(spark, folder) as c:
            children.put_families(c, orders.where(part).groupBy(F.col("o_custkey").cast("string").alias("id")).agg(listed.alias("members")).withColumn("name", F.lit(f"v{version}")))
    names = table(spark, folder, "families").withColumnRenamed("id", "family_id")
    return table(spark, folder, "family_members").join(names, "family_id").select(F.col("family_id").alias("family"), F.col("member_id").alias("member"), "place", "name")


def _works(t, version: int):
    k = F.col("p_partkey")
    key, r = k.cast("string"), k % 6
    none, one = F.lit(None).cast("string"), lambda a, b: F.struct(F.lit(a).alias("scheme"), F.concat(F.lit(b), key).alias("value"))
    own = F.concat(F.lit("w"), key)
    d = t("part").withColumn("v", F.lit(version))
    d = d.where(r.isin(0, 2, 4)) if version == 1 else d.where(r.isin(0, 1, 2))
    ids = F.array(one("doi", "10/")) if version == 1 else F.when(r == 2, F.array(one("pmid", "n"), one("doi", "10/"))).otherwise(F.array(one("doi", "10/")))
    person = F.struct(F.concat(F.lit("a"), (k % 7).cast("string")).alias("id"), F.lit(f"N{version}").alias("name"))
    other = F.struct(F.lit("b").alias("id"), F.lit("B").alias("name"))
    asset = F.struct(F.concat(F.lit("s"), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string")).alias("id"), F.lit(f"r{version}").alias("representation"), F.lit("u").alias("url"))
    return d.select(
        F.when((F.lit(version) == 2) & (r == 2), F.concat(F.lit("x"), key)).otherwise(own).alias("id"), F.concat("p_name", F.lit(f" v{version}")).alias("title"), F.when(F.lit(version) == 1, "abs").otherwise(none).alias("abstract"), F.col("p_size").cast("int").alias("year"), ids.alias("identifiers"),
        F.struct(F.when((F.lit(version) == 2) & (r == 2), "2").otherwise("1").alias("label"), F.lit(f"p{version}").alias("provider")).alias("version"), (F.array(person) if version == 1 else F.array(other, person)).alias("authors"), F.array(asset).alias("assets"), F.array(F.struct(F.lit(f"p{version}").alias("provider"), F.concat(F.lit("r"), key).alias("record"))).alias("provenance"),
    )


@query("""WITH k AS (SELECT p_partkey AS k, p_name, p_partkey % 6 AS r FROM part)
SELECT 'work' AS kind, 'w' || k AS work, p_name || CASE r WHEN 4 THEN ' v1|abs' ELSE ' v2|' END AS what FROM k WHERE r IN (0, 1, 2, 4)
UNION ALL SELECT 'identifier', 'w' || k, 'doi:10/' || k FROM k WHERE r IN (0, 1, 2, 4) UNION ALL SELECT 'identifier', 'w' || k, 'pmid:n' || k FROM k WHERE r = 2
UNION ALL SELECT 'version', 'w' || k, CASE r WHEN 0 THEN '1:p2' WHEN 1 THEN '1:p2' ELSE '1:p1' END FROM k WHERE r IN (0, 1, 2, 4) UNION ALL SELECT 'version', 'w' || k, '2:p2' FROM k WHERE r = 2
UNION ALL SELECT 'author', 'w' || k, 'a' || k % 7 || CASE WHEN k % 7 IN (SELECT k % 7 FROM k WHERE r < 3) THEN ':N2' ELSE ':N1' END || CASE r WHEN 4 THEN ':1' ELSE ':2' END FROM k WHERE r IN (0, 1, 2, 4) UNION ALL SELECT 'author', 'w' || k, 'b:B:1' FROM k WHERE r < 3
UNION ALL SELECT 'asset', 'w' || k, 's' || k || CASE WHEN r = 4 THEN ':r1' ELSE ':r2' END FROM k WHERE r IN (0, 2, 4)
UNION ALL SELECT 'provenance', 'w' || k, 'p1:r' || k FROM k WHERE r IN (0, 2, 4) UNION ALL SELECT 'provenance', 'w' || k, 'p2:r' || k FROM k WHERE r < 3""")
def work_store(t):
    """L1: works in two versions, known by id or by identifier, with identifiers, versions, authors, assets and provenance."""
    spark = t("part").sparkSession
    folder = f"{shared_folder(spark)}/works-{uuid.uuid4().hex}"
    for version in (1, 2):
        with Changes(spark, folder) as c:
            children.put_works(c, _works(t, version))
    read = lambda name: table(spark, folder, name)
    row = lambda d, kind, work, *what: d.select(F.lit(kind).alias("kind"), F.col(work).alias("work"), F.concat_ws(":", *what).alias("what"))
    named = read("work_authors").join(read("authors").select(F.col("id").alias("author_id"), "name"), "author_id")
    out = read("works").select(F.lit("work").alias("kind"), F.col("id").alias("work"), F.concat("title", F.lit("|"), F.coalesce("abstract", F.lit(""))).alias("what"))
    for d in (row(read("identifiers"), "identifier", "work_id", "scheme", "value"), row(read("versions"), "version", "work_id", "label", "provider"), row(named, "author", "work_id", "author_id", "name", F.col("position").cast("string")), row(read("assets"), "asset", "work_id", "id", "representation"), row(read("provenance"), "provenance", "work_id", "provider", "record")):
        out = out.unionByName(d)
    return out


@query("""WITH a AS (SELECT c_custkey AS k, c_custkey % 3 AS r FROM customer), one AS (SELECT k, 'asserted' AS status, CASE WHEN k % 2 = 0 THEN 'w' || k END AS work FROM a), two AS (SELECT k, 'final' AS status FROM a WHERE r = 0)
SELECT 'integrity' AS kind, 's' || k AS id, coalesce(two.status, one.status) AS what, work FROM one LEFT JOIN two USING (k)
UNION ALL SELECT 'review', 's' || k, 'accept:' || CASE WHEN r = 0 THEN 'p2' ELSE 'p1' END, NULL FROM a UNION ALL SELECT 'review', 's' || k, 'reject:p2', NULL FROM a WHERE r = 0
UNION ALL SELECT 'experiment', 'e' || k, CASE r WHEN 0 THEN 'completed:m' WHEN 1 THEN 'completed:' ELSE 'running:' END, NULL FROM a""")
def audit_stores(t):
    """Integrity assertions whose work is found by identifier, reviews merged by what they say, experiments from start to finish."""
    customer, k = t("customer"), F.col("c_custkey")
    spark = customer.sparkSession
    key = k.cast("string")
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    ids = customer.where(k % 2 == 0).select(F.concat(F.lit("w"), key).alias("work_id"), F.lit("doi").alias("scheme"), F.concat(F.lit("10.1/k"), key).alias("value"))

    def told(version):
        asked = F.concat(F.lit("https://doi.org/10.1/K"), key) if version == 1 else F.concat(F.lit("10.9/none"), key)
        return customer.where(F.lit(version == 1) | (k % 3 == 0)).select(asked.alias("asked"), F.concat(F.lit("s"), key).alias("subject"), F.lit("retracts").alias("relation"), F.lit(None).cast("string").alias("object"), F.lit("p").alias("provider"), F.lit("asserted" if version == 1 else "final").alias("status"))

    def reviews(decision, version):
        return customer.where(F.lit(version == 1) | (k % 3 == 0)).select(F.lit("work").alias("object_type"), F.concat(F.lit("s"), key).alias("object_id"), F.lit("r").alias("reviewer"), F.lit(decision).alias("decision"), F.lit(None).cast("string").alias("notes"), F.lit(f"p{version}").alias("payload"))

    run = F.concat(F.lit("e"), key).alias("id")
    with Changes(spark, folder) as c:
        c["identifiers"] = ids
    with Changes(spark, folder) as c:
        children.put_integrity(c, told(1))
        children.put_reviews(c, reviews("accept", 1))
        children.start_experiments(c, customer.select(run, F.lit("n").alias("name"), F.lit("{}").alias("parameters")))
    with Changes(spark, folder) as c:
        children.put_integrity(c, told(2))
        children.put_reviews(c, reviews("accept", 2).unionByName(reviews("reject", 2)))
        children.finish_experiments(c, customer.where(k % 3 < 2).select(run, F.when(k % 3 == 0, "m").alias("metrics")))
    read = lambda name: table(spark, folder, name)
    none = F.lit(None).cast("string").alias("work")
    parts = [
        read("integrity").select(F.lit("integrity").alias("kind"), F.col("subject").alias("id"), F.col("status").alias("what"), F.col("work_id").alias("work")),
        read("reviews").select(F.lit("review").alias("kind"), F.col("object_id").alias("id"), F.concat_ws(":", "decision", "payload").alias("what"), none),
        read("experiments").select(F.lit("experiment").alias("kind"), "id", F.concat(F.col("status"), F.lit(":"), F.coalesce("metrics", F.lit(""))).alias("what"), none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RUN = """CASE event_id % 4 WHEN 0 THEN '{"spec":"v1","data":{},"citation":[{"x":1},{"execution":{"request_id":"q' || event_id || '","response_sha256":"h"}},{"execution":{"request_id":"later"}}],"lineage":[1,2]}'
WHEN 1 THEN '{"spec":"v2","citation":{"execution":{"query_fingerprint":"f","request_id":7}}}' WHEN 2 THEN '{"citation":[],"lineage":"none"}' ELSE 'broken' END"""


@query("""WITH e AS (SELECT event_id AS k, user_id AS u, event_id % 4 AS r FROM events), run AS (SELECT DISTINCT u FROM e)
SELECT 'envelope' AS kind, CAST(k AS VARCHAR) AS id, CASE r WHEN 0 THEN 'v1|q' || k || '||h|2' WHEN 1 THEN 'v2||f||0' ELSE '||||0' END AS what, CASE r WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n FROM e
UNION ALL SELECT 'run', CAST(u AS VARCHAR), CASE WHEN u % 5 = 0 THEN 'failed' ELSE 'completed' END, (SELECT count(*) FROM e WHERE e.u = run.u AND r < 3 AND u % 5 > 0) FROM run
UNION ALL SELECT 'provenance', 'w' || k % 50, 'p' || u % 3 || ':' || u, 0 FROM (SELECT DISTINCT k % 50 AS k, u FROM e WHERE r < 2 AND u % 5 > 0)""")
def retrieval_stores(t):
    """Retrieval runs with their hits and who told of each work, and envelopes with the first execution that their citations tell."""
    e, k, u = t("events"), F.col("event_id"), F.col("user_id")
    spark = e.sparkSession
    folder = f"{shared_folder(spark)}/retrievals-{uuid.uuid4().hex}"
    run = e.select(u).distinct().select(u.cast("string").alias("id"), F.concat(F.lit("p"), (u % 3).cast("string")).alias("provider"), F.lit("q").alias("query"), F.when(u % 5 == 0, "away").alias("error"))
    hits = e.where((k % 4 < 3) & (u % 5 > 0)).select(u.cast("string").alias("run_id"), k.cast("int").alias("place"), F.when(k % 4 < 2, F.concat(F.lit("w"), (k % 50).cast("string"))).alias("work_id"), F.lit(1).cast("long").alias("rank"))
    with Changes(spark, folder) as c:
        children.put_retrieval(c, run, hits)
        children.put_envelopes(c, e.select(k.cast("string").alias("id"), u.cast("string").alias("run_id"), F.expr(_RUN).alias("json")))
    read = lambda name: table(spark, folder, name)
    told = F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in ("spec", "request_id", "query_fingerprint", "response_sha256")], F.col("lineage").cast("string"))
    parts = [
        read("envelopes").select(F.lit("envelope").alias("kind"), "id", told.alias("what"), F.col("citations").alias("n")),
        read("retrievals").select(F.lit("run").alias("kind"), "id", F.col("status").alias("what"), F.col("hits").alias("n")),
        read("provenance").select(F.lit("provenance").alias("kind"), F.col("work_id").alias("id"), F.concat_ws(":", "provider", "record").alias("what"), F.lit(0).cast("long").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH o AS (SELECT DISTINCT 'order' AS st, CAST(l_orderkey AS VARCHAR) AS s, l_returnflag AS r, CASE WHEN l_partkey % 2 = 0 THEN 'part' END AS ot, CAST(l_partkey AS VARCHAR) AS o, l_linestatus AS p FROM lineitem) SELECT st, s, r, ot, o, p, CASE WHEN CAST(s AS BIGINT) % 3 = 0 THEN 'new' ELSE 'old' END AS payload FROM o UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'Q', NULL, '0', NULL, 'new' FROM orders""")
def relation_store(t):
    """Typed relations by their six columns, nulls equal; the payload of a third is replaced, and one an order is new."""
    text_of = lambda c: F.col(c).cast("string")
    key = [F.lit("order").alias("subject_type"), text_of("l_orderkey").alias("subject"), F.col("l_returnflag").alias("relation"), F.when(F.col("l_partkey") % 2 == 0, "part").alias("object_type"), text_of("l_partkey").alias("object"), F.col("l_linestatus").alias("provider")]
    lines = t("lineitem")
    none = F.lit(None).cast("string")
    old = lines.select(*key).distinct().withColumn("payload", F.lit("old"))
    fresh = t("orders").select(F.lit("order").alias("subject_type"), text_of("o_orderkey").alias("subject"), F.lit("Q").alias("relation"), none.alias("object_type"), F.lit("0").alias("object"), none.alias("provider"))
    new = lines.where("l_orderkey % 3 = 0").select(*key).unionByName(fresh).withColumn("payload", F.lit("new"))
    return state.store("relation", old, new).toDF("st", "s", "r", "ot", "o", "p", "payload")


@query("WITH o AS (SELECT p_partkey AS l, p_partkey + 1 AS r FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT least(p_partkey, p_size + 0) AS l, greatest(p_partkey, p_size + 0) AS r FROM part UNION SELECT p_partkey, p_partkey + 1 FROM part) SELECT l AS left_id, r AS right_id, 'old' AS method FROM o UNION ALL SELECT l, r, 'new' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l = n.l AND o.r = n.r)")
def pair_store(t):
    """Pairs known by their ids in order; one that is there stays as it was, in whichever order it comes again."""
    part = t("part")
    k = F.col("p_partkey")
    old = part.where(k % 2 == 0).select(k.alias("left_id"), (k + 1).alias("right_id"), F.lit("old").alias("method"))
    new = part.select((k + 1).alias("left_id"), k.alias("right_id")).unionByName(part.select(k.alias("left_id"), F.col("p_size").cast("long").alias("right_id"))).withColumn("method", F.lit("new"))
    return state.store("similarity", old, state.sorted_pairs(new))


@query("SELECT 'q' || event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN 503 ELSE 200 END AS code, CASE WHEN event_id % 4 > 0 THEN 'again' END AS note FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'q' || event_id, 200, 'again' FROM events WHERE event_id % 4 IN (1, 3)")
def http_audit(t):
    """Calls by request id; a later word on a request replaces the earlier, nulls too."""
    k = F.col("event_id")
    key = F.concat(F.lit("q"), k.cast("string")).alias("request_id")
    old = t("events").where(k % 2 == 0).select(key, F.lit(503).alias("code"), F.lit(None).cast("string").alias("note"))
    return state.store("http_call", old, t("events").where(k % 4 > 0).select(key, F.lit(200).alias("code"), F.lit("again").alias("note")))


@query("WITH s AS (SELECT s_name, s_nationkey, s_suppkey FROM supplier), v AS (SELECT s_name, s_nationkey, s_suppkey % 3 = 0 AS changed FROM s) SELECT 'sha256:' || sha256('{\"nation\":\"' || s_nationkey || '\",\"provider\":\"' || s_name || '\"}') AS fingerprint, s_name AS provider, 1 AS seen FROM v UNION ALL SELECT 'sha256:' || sha256('{\"nation\":\"' || (s_nationkey + 1) || '\",\"provider\":\"' || s_name || '\"}'), s_name, 2 FROM v WHERE changed")
def provider_snapshots(t):
    """Snapshots of providers known by their content: what says the same again is not added."""
    def told(seen, nation):
        return t("supplier").select(state.content_id(provider=F.col("s_name"), nation=nation.cast("string")).alias("fingerprint"), F.col("s_name").alias("provider"), F.lit(seen).alias("seen"))

    nation = F.col("s_nationkey")
    return state.store("provider_snapshot", told(1, nation), told(2, F.when(F.col("s_suppkey") % 3 == 0, nation + 1).otherwise(nation)))


_VALID = {"ref": "l_orderkey IS NOT NULL AND l_partkey IS NOT NULL", "quantity": "l_quantity BETWEEN 1 AND 45", "discount": "l_discount < 0.1"}


@query("SELECT count(*) AS total, count(*) FILTER (" + " AND ".join(_VALID.values()) + ") AS valid, count(*) - count(*) FILTER (" + " AND ".join(_VALID.values()) + ") AS invalid, " + ", ".join(f"count(*) FILTER (NOT ({c})) AS broken_{n}" for n, c in _VALID.items()) + ", CAST(len(list(DISTINCT l_returnflag)) AS INTEGER) AS disciplines FROM lineitem")
def validation_summary(t):
    """Rows, valid and invalid ones, faults by rule and distinct kinds, told by one pass that writes the valid rows."""
    d = t("lineitem")
    spark = d.sparkSession
    # kinds are a vocabulary, so their set is small
    told, seen = observed.validated(d, {n: F.expr(c) for n, c in _VALID.items()}, {"disciplines": F.size(F.collect_set("l_returnflag"))})
    told.where(F.size("faults") == 0).drop("faults").write.parquet(f"{shared_folder(spark)}/valid-{uuid.uuid4().hex}")
    return spark.createDataFrame([seen.get], ", ".join(f"{c} {'int' if c == 'disciplines' else 'long'}" for c in seen.get))


@query("""WITH c AS (SELECT p_brand AS concept, lower(trim(p_name)) AS term, max(p_retailprice) AS weight FROM part GROUP BY 1, 2), q AS (SELECT concept, term, row_number() OVER (PARTITION BY concept ORDER BY weight DESC, term) AS r FROM c), k AS (SELECT * FROM q WHERE r <= 24), h AS (SELECT concept, p_partkey AS work FROM part JOIN k ON lower(trim(p_name)) = term AND p_brand = concept), e AS (SELECT h.*, l_orderkey IS NOT NULL AS cited FROM h LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = work)
SELECT 'compile' AS stage, (SELECT count(*) FROM k) AS n UNION ALL SELECT 'batch', (SELECT CAST(sum(b) AS BIGINT) FROM (SELECT (count(*) + 7) // 8 AS b FROM k GROUP BY concept)) UNION ALL SELECT 'harvest', (SELECT count(*) FROM h) UNION ALL SELECT 'enrich', (SELECT count(*) FROM e WHERE cited) UNION ALL SELECT 'enqueue', (SELECT count(DISTINCT work) FROM e WHERE NOT cited)""")
def campaign_ledger(t):
    """M6: compile, batch, harvest, enrich and enqueue over the tables, stopped in the third stage once and resumed; counts as the ledger has them."""
    part, lines = t("part"), t("lineitem")
    spark = part.sparkSession
    folder = f"{shared_folder(spark)}/campaign-{uuid.uuid4().hex}"
    calls = []

    def compiled(_, p):
        d = part.select(F.col("p_brand").alias("concept"), F.lower(F.trim("p_name")).alias("term"), F.col("p_retailprice").alias("weight")).groupBy("concept", "term").agg(F.max("weight").alias("weight"))
        return d.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(F.col("weight").desc(), "term"))).where(F.col("r") <= p["most"])

    def harvest(made, _):
        calls.append("harvest")
        if len(calls) == 1:
            raise ConnectionError("the source is away")
        on = (F.lower(F.trim("p_name")) == F.col("term")) & (F.col("p_brand") == F.col("concept"))
        return part.join(made["compile"], on).select("concept", F.col("p_partkey").alias("work"))

    stages = [
        Stage("compile", compiled, parameters={"most": 24}),
        Stage("batch", lambda made, p: ordered.batches(made["compile"].withColumn("q", text.quoted(F.col("term"))), [F.col("r")], "q", p["size"], "concept"), ("compile",), {"size": 8}),
        Stage("harvest", harvest, ("compile", "batch")),
        Stage("enrich", lambda made, _: made["harvest"].join(lines.where("l_quantity > 40").select(F.col("l_partkey").alias("work")).distinct(), "work", "left_semi"), ("harvest",)),
        Stage("enqueue", lambda made, _: made["harvest"].select("work").distinct().join(made["enrich"].select("work").distinct(), "work", "left_anti"), ("harvest", "enrich")),
    ]
    first, second = run_campaign(spark, folder, stages), run_campaign(spark, folder, stages)
    if first.status != "failed" or second.skipped != ["compile", "batch"] or second.status != "completed":
        raise RuntimeError(f"the campaign did not go on where it was stopped: {first.status}, {second.skipped}, {second.error}")
    return summary(spark, folder).select("stage", "n")
