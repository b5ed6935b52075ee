"""Readers of source trees, register shards and word lists, and writers of the compiled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.paths import YEAR


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root/data) and text of all .mit files under authors and works."""
    rows = spark.read.text(f"{root}/data", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.mit")
    inner = F.regexp_extract("_metadata.file_path", r"/data/((?:authors|works)/.*)$", 1)
    return rows.select(inner.alias("path"), F.col("value").alias("text")).filter("path <> ''")


def source_listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modification time of the sources, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mit").load(f"{root}/data")
    return rows.select(F.regexp_extract("path", r"/data/((?:authors|works)/.*)$", 1).alias("path"), "length", F.col("modificationTime").alias("modified")).filter("path <> ''")


def layout(files: DataFrame) -> DataFrame:
    """What each path is by convention: author, work stub or edition, with its slugs."""
    parts = F.split(F.regexp_replace("path", r"\.mit$", ""), "/")
    last, above = F.element_at(parts, -1), F.element_at(parts, -2)
    slug = F.when(last == "index", above).otherwise(last)
    n = F.size(parts)
    kind = (
        F.when((parts[0] == "authors") & (n == 2), "author")
        .when((parts[0] == "works") & slug.rlike(YEAR) & (n >= 4), "edition")
        .when((parts[0] == "works") & (last == "index") & (n == 4), "stub")
        .otherwise("other")
    )
    return files.select("*", kind.alias("kind"), slug.alias("slug"), F.get(parts, 1).alias("host_slug"), F.get(parts, 2).alias("work_slug"))


def shard_entries(spark: SparkSession, root: str) -> DataFrame:
    """Register entries as authored: shard, its place, key, the key's place, JSON value. No folder gives no rows."""
    schema = "shard string, shard_ord int, key_ord int, surface string, value string"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/data/dictionary")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.text(f"{root}/data/dictionary", wholetext=True, pathGlobFilter="*.json").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"), "value")
    return parse_shards(rows.withColumnRenamed("value", "text"))


def parse_shards(shards: DataFrame) -> DataFrame:
    """Entries of shards(shard, text): keys keep their order and repeats, values stay JSON."""
    keys = F.json_object_keys("text")
    values = F.from_json("text", "map<string, string>", {"mode": "PERMISSIVE"})
    line = F.regexp_extract_all("text", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*(null|"(?:[^"\\]|\\.)*"|\[[^\]]*\]|-?[0-9.]+|true|false|\{[^}]*\})'), F.lit(2))
    rows = shards.select("shard", F.posexplode(F.arrays_zip(keys.alias("k"), line.alias("v"))).alias("key_ord", "e"), F.size(values).alias("_n"))
    order = shards.select("shard").distinct().select("shard", F.ascii(F.lower("shard")).alias("shard_ord"))
    return rows.join(order, "shard").select("shard", "shard_ord", "key_ord", F.col("e.k").alias("surface"), F.col("e.v").alias("value"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a list, one a line, trimmed and in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def exception_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a JSON array."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("word")).distinct()


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None) -> None:
    """Replace the compiled tables; a table named in partition_by is split by that column."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{path}/{name}")


def write_changed(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def resolve_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref, an id or path without suffix) with the file that holds it, case put aside: x.mit, else x/index.mit."""
    held = files.select(F.lower("path").alias("_p"), "path")
    want = F.lower(F.concat(F.lit("works/"), F.replace("ref", F.lit("."), F.lit("/"))))
    plain = held.select(F.regexp_replace("_p", r"\.mit$", "").alias("_want"), F.col("path").alias("_plain"))
    index = held.filter(F.col("_p").endswith("/index.mit")).select(F.regexp_replace("_p", r"/index\.mit$", "").alias("_want"), F.col("path").alias("_index"))
    enough = F.size(F.split("ref", r"\.")) >= 3
    out = refs.withColumn("_want", F.when(enough, want)).join(plain, "_want", "left").join(index, "_want", "left")
    return out.withColumn("resolved", F.coalesce("_plain", "_index")).drop("_want", "_plain", "_index")
