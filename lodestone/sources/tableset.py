"""Tables that change together: a version of a set of tables is one row of a commit table, written last.

Data of a version lie in a folder of their own; the commit says for each table which
version holds it, so tables that didn't change are not copied. Spark's committer writes the
commit row, so a reader sees either all of a version or none, and a write that fails leaves what
was there. Two writers that start from one version meet at the folder of the next: the second fails.
"""

from __future__ import annotations

from types import TracebackType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

COMMIT = "version long, held map<string, long>"


def _commits(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT).parquet(f"{folder}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict[str, int]]:
    """(version, table -> version that holds it) as of a version, the last one if none is given; (0, {}) before the first."""
    found = _commits(spark, folder)
    rows = [] if found is None else (found if version is None else found.where(f"version <= {int(version)}")).orderBy("version", ascending=False).limit(1).collect()
    return (rows[0].version, dict(rows[0].held)) if rows else (0, {})


def table(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table as of a version; None if it has never been written by then."""
    held = current(spark, folder, version)[1].get(name)
    return None if held is None else spark.read.parquet(f"{folder}/data/v{held}/{name}")


def healthy(spark: SparkSession, folder: str) -> bool:
    """Whether every table of the last version can be read."""
    try:
        held = current(spark, folder)[1]
        return all(spark.read.parquet(f"{folder}/data/v{v}/{name}").limit(1).count() >= 0 for name, v in held.items())
    except AnalysisException:
        return False


class Changes:
    """with Changes(spark, folder) as c: c["t"] reads a table as it was, c["t"] = df says what it becomes; all or nothing is kept at the end."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version, self.held = current(spark, folder)
        self.new: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame | None:
        held = self.held.get(name)
        return None if held is None else self.spark.read.parquet(f"{self.folder}/data/v{held}/{name}")

    def get(self, name: str, schema) -> DataFrame:
        """The table as it was, or an empty one."""
        found = self[name]
        return self.spark.createDataFrame([], schema) if found is None else found

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.new[name] = df

    def __enter__(self) -> Changes:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind is not None or not self.new:
            return
        nxt = self.version + 1
        # leftovers of a write that failed are no version and may be written over; a version that was committed since is another writer's
        if current(self.spark, self.folder)[0] != self.version:
            raise RuntimeError(f"another writer has changed {self.folder} since version {self.version}")
        for name, df in self.new.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/data/v{nxt}/{name}")
        self.spark.createDataFrame([(nxt, self.held | dict.fromkeys(self.new, nxt))], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
