"""Readers and writers of the formats beside Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; bad lines fail, or stay in `_corrupt_record` if not strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*kind, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header; blank strings are null."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes])


def split_list(c: Column) -> Column:
    """The parts of a list with ';' between, those with ink."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def import_absent(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """old with the rows of new whose key it lacks, each key once, and how many those are."""
    added = cut(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))
    return old.unionByName(added), added.count()


#: one record of a native vocabulary
NATIVE = "native_id string, label string, alternate array<string>, historical array<string>, broader array<string>, narrower array<string>, related array<string>, definition string, deprecated boolean, replaced_by array<string>"


def read_native(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of native records."""
    return read_jsonl(spark, path, NATIVE).where("native_id IS NOT NULL AND label IS NOT NULL")


def _native(d: DataFrame, **have: Column) -> DataFrame:
    """The columns of a native record, those not given null or empty."""
    kinds = [x.split(" ") for x in NATIVE.split(", ")]
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)
    return d.select(*[have.get(name, empty(kind)).cast(kind).alias(name) for name, kind in kinds]).where("native_id IS NOT NULL AND label IS NOT NULL")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """[Term] stanzas as native records; other stanzas and those without id or name are left out."""
    d = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    d = d.withColumn("value", F.regexp_replace("value", r"(?m)^\s*!.*$", ""))
    many = lambda k, inside=r"(.+?)": F.regexp_extract_all("value", F.lit(rf"(?m)^\s*{k}\s*:\s*{inside}\s*$"), F.lit(1))
    first = lambda k: F.get(many(k), 0)
    quoted = F.regexp_extract_all("value", F.lit(r'(?m)^\s*synonym\s*:\s*"(.*?)"'), F.lit(1))
    parent = F.transform(many("is_a"), lambda x: F.trim(F.substring_index(x, " ! ", 1)))
    return _native(d, native_id=first("id"), label=first("name"), alternate=quoted, broader=parent, definition=first("def"), deprecated=F.coalesce(F.lower(first("is_obsolete")) == "true", F.lit(False)), replaced_by=many("replaced_by"))


def read_skos(spark: SparkSession, path: str) -> DataFrame:
    """SKOS RDF/XML concepts as native records; those without about or prefLabel are left out."""
    link = "array<struct<`_rdf:resource`: string>>"
    schema = f"`_rdf:about` string, `skos:prefLabel` string, `skos:definition` string, `skos:altLabel` array<string>, `skos:broader` {link}, `skos:narrower` {link}, `skos:related` {link}"
    d = spark.read.format("xml").option("rowTag", "skos:Concept").schema(schema).load(path)
    to = lambda k: F.filter(F.transform(F.coalesce(f"`skos:{k}`", F.array().cast(link)), lambda b: b["_rdf:resource"]), lambda x: x.isNotNull())
    alt = F.filter(F.transform(F.coalesce("`skos:altLabel`", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return _native(d, native_id=F.col("`_rdf:about`"), label=F.trim("`skos:prefLabel`"), alternate=alt, broader=to("broader"), narrower=to("narrower"), related=to("related"), definition=F.nullif(F.trim("`skos:definition`"), F.lit("")))


def blob_key(content: Column) -> Column:
    h = F.sha2(content, 256)
    return F.concat(F.lit("sha256/"), F.substring(h, 1, 2), F.lit("/"), h)


def put_blobs(df: DataFrame, store: str) -> DataFrame:
    """df(content, ...) with `key`; contents that the store lacks are written to it, once each, in 256 folders by the key's first two digits."""
    spark = df.sparkSession
    keyed = cut(df.withColumn("key", blob_key(F.col("content"))))
    new = keyed.select("key", "content", F.substring("key", 8, 2).alias("part")).dropDuplicates(["key"])
    old = get_blobs(spark, store)
    new = new if old is None else new.join(old.select("part", "key"), ["part", "key"], "left_anti")
    new.write.mode("append").partitionBy("part").parquet(store)
    return keyed


def get_blobs(spark: SparkSession, store: str) -> DataFrame | None:
    """key, content, part of all blobs; None if nothing was stored yet."""
    try:
        return spark.read.schema("key string, content binary, part string").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def atomic_write(df: DataFrame, path: str) -> None:
    """Writes beside path and then takes its place, so a reader sees the old table or the new one, and a failed write leaves the old."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    temp, old = (hadoop.Path(f"{path}.{x}") for x in ("new", "old"))
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(temp, target):
        fs.rename(old, target)
        raise OSError(f"could not put {path} in place")
    fs.delete(old, True)


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS one").first().one == 1


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable:
    """Registers f(spark, query, limit) -> DataFrame as a search source."""

    def put(f):
        SOURCES[name] = f
        return f

    return put


def json_source(extract: Callable[[Column], Column], normalise: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """A search over raw answers: extract takes the results out of a variant, normalise makes a row of each; nulls are left out."""

    def search(raw: DataFrame, column: str) -> DataFrame:
        d = raw.select(F.posexplode(extract(F.try_parse_json(column))).alias("place", "r"))
        return d.select((F.col("place") + 1).alias("rank"), normalise(F.col("r")).alias("w")).where("w IS NOT NULL").select("rank", "w.*")

    return search


def fixture(spark: SparkSession, rows: list[tuple], schema: str, limit: int) -> DataFrame:
    """Rows in their order, the first `limit`."""
    return spark.createDataFrame(rows[:limit], schema)


def save_catalog(df: DataFrame, path: str, version: str) -> None:
    """A catalogue as one JSON table with its version."""
    df.withColumn("catalog_version", F.lit(version)).coalesce(1).write.mode("overwrite").json(path)


def load_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, catalog_version string").option("mode", "FAILFAST").json(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files with content-addressed keys: key, path, content; equal contents once."""
    d = spark.read.format("binaryFile").load(path).withColumn("key", blob_key(F.col("content")))
    return d.groupBy("key").agg(F.min("path").alias("path"), F.first("content").alias("content"))


def snapshot(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A tagged union of tables as JSON lines, in order of part and key: type, key, data."""
    out = None
    for i, (name, (df, key)) in enumerate(parts.items()):
        d = df.select(F.lit(i).alias("part"), F.lit(name).alias("type"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("data"))
        out = d if out is None else out.unionByName(d)
    return out.orderBy("part", "key").drop("part")


#: the sort keys of a corpus snapshot, in the order of its parts
EXPORT = {"work": ("id",), "identifier": ("work_id", "scheme", "value"), "asset": ("work_id", "id"), "citation": ("source", "target", "provider"), "problem": ("id",)}


def export_corpus(parts: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Works, identifiers, assets, citations and problems as JSON lines (type, data), each sorted by its key -> rows of each part."""
    out = None
    for i, (name, key) in enumerate(EXPORT.items()):
        d = parts[name].select(F.lit(i).alias("_part"), F.array(*[F.col(k).cast("string") for k in key]).alias("_key"), F.lit(name).alias("type"), F.to_variant_object(F.struct("*")).alias("data"))
        out = d if out is None else out.unionByName(d)
    out.orderBy("_part", "_key").select(F.to_json(F.struct("type", "data")).alias("value")).write.mode("overwrite").text(path)
    told = {r.type: r.n for r in out.groupBy("type").agg(F.count("*").alias("n")).collect()}
    return {name: told.get(name, 0) for name in EXPORT}


def json_schema(df: DataFrame) -> str:
    return df.schema.json()


def write_schemas(tables: dict[str, DataFrame], folder: str) -> int:
    """One schema file for each registered table."""
    rows = [(name, json_schema(df)) for name, df in tables.items()]
    spark = next(iter(tables.values())).sparkSession
    for name, told in rows:
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return len(rows)
