"""Files the library reads and writes: tables with explicit schemas, splits, dates, listings and properties."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.rank import ranged
from faultline.schema import BUILD_REPORT, COMMIT_DATES, FEATURES, PART_LISTS, PART_ROWS, SPLIT


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, under a fixed schema; types are never inferred, and a wrong header is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FEATURES) if path.endswith(".csv") else spark.read.schema(FEATURES).parquet(path)


def done_keys(spark: SparkSession, path: str) -> DataFrame:
    """The (project, bug) already in a Parquet sink; none if it isn't there. Only two columns are read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "project string, bug long")
    return spark.read.parquet(path).select("project", "bug").distinct()


def write_part(tests: DataFrame, changes: DataFrame, path: str) -> None:
    """A part of the intermediate table, compressed: tests at path, and the ;-joined modified_classes of each of their changes at path.changes.

    A change's list is written once, not beside each of its tests: the rows would grow with tests times classes.
    """
    for df, at in ((tests.select(*PART_ROWS.names), path), (changes.select(*PART_LISTS.names), f"{path}.changes")):
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(at)


def read_part_lists(spark: SparkSession, pattern: str) -> DataFrame:
    """project, bug, modified_classes, modified_classes_count of the changes of each part, by the glob of the parts; part as read_parts() names it."""
    lists = read_parts(spark, f"{pattern}.changes", PART_LISTS)
    return lists.withColumn("part", F.regexp_replace("part", r"[.]changes$", ""))


def read_parts(spark: SparkSession, pattern: str, schema: T.StructType = PART_ROWS) -> DataFrame:
    """CSV parts by a glob, with part, the file's name, which orders them. No match is an error of the reader."""
    return read_csv(spark, pattern, schema).withColumn("part", F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1))


def part_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("rows"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """side, project, bug of a split file: side -> project -> ids."""
    raw = spark.read.schema(SPLIT).option("multiLine", True).json(path)
    sides = raw.select(F.explode(F.create_map(F.lit("train"), F.col("train"), F.lit("test"), F.col("test"))).alias("side", "projects"))
    return sides.select("side", F.explode("projects").alias("project", "bugs")).select("side", "project", F.explode("bugs").alias("bug"))


def split_json(split: DataFrame, method: str = "chronological") -> DataFrame:
    """One row, value: the split as JSON with sorted ids for each side and project. It has one id for each change."""
    ids = split.groupBy("side", "project").agg(F.sort_array(F.collect_list("bug")).alias("bugs"))
    side = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("project", "bugs"))))).alias(s) for s in ("train", "test")]
    return ids.agg(*side).select(F.to_json(F.struct(F.lit(method).alias("method"), "train", "test")).alias("value"))


def write_split(split: DataFrame, path: str) -> None:
    split_json(split).write.mode("overwrite").text(path)


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """The date of each change. A missing file is an error; ids never stand in for dates."""
    return read_csv(spark, path, COMMIT_DATES)


def active_changes(spark: SparkSession, pattern: str) -> DataFrame:
    """project, bug, revision of the active-change lists at <project>/active-bugs.csv; an empty table without such files."""
    try:
        raw = spark.read.option("header", True).csv(pattern)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "project string, bug long, revision string")
        raise
    project = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/active-bugs", 1)
    return raw.select(project.alias("project"), F.col("`bug.id`").cast("long").alias("bug"), F.col("`revision.id.fixed`").alias("revision"))


def read_properties(spark: SparkSession, pattern: str) -> DataFrame:
    """project, bug, property, content of text files at <project>/<bug>/<property>."""
    raw = spark.read.text(pattern, wholetext=True)
    at = F.col("_metadata.file_path")
    return raw.select(*[F.regexp_extract(at, r"([^/]+)/(\d+)/([^/]+)$", i).alias(n) for i, n in ((1, "project"), (2, "bug"), (3, "property"))], F.col("value").alias("content")).withColumn("bug", F.col("bug").cast("long"))


def read_listings(spark: SparkSession, pattern: str) -> DataFrame:
    """Class-listing dumps, a file a row."""
    return spark.read.text(pattern, wholetext=True)


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet sink by project; each call is durable when it returns."""
    df.write.mode("append").partitionBy("project").parquet(path)


def append_report(df: DataFrame, path: str) -> None:
    """Adds attempts to the build report, with the time order in which calls came."""
    spark = df.sparkSession
    last = -1 if not exists(spark, path) else spark.read.parquet(path).agg(F.max("attempt")).first()[0]
    df.select(*BUILD_REPORT.names).withColumn("attempt", F.lit(last + 1).cast("long")).write.mode("append").parquet(path)


def export_sorted(df: DataFrame, path: str, columns: list[str], by: list[str], files: int | None = None) -> None:
    """CSV files of a table with fixed columns: each is sorted, and so are the files by their names. files: how many at most; else Spark decides by size."""
    ranged(df.select(*columns), by, files).write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_texts(df: DataFrame, folder: str) -> None:
    """A file for each row (path, content), at path under folder, written by the tasks that hold the rows; a row written twice is the same file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}", compression=None) as f:
                    f.write((content or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["path"])

    df.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
