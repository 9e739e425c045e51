"""Readers of catalogs, rule lists, item lists and literature records; each keeps arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table_text(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """CSV as text columns with lower-case headers; missing optional columns get their default."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def read_values(spark: SparkSession, path: str, id_prefix: str, header_words: tuple[str, ...] = ("smiles", "value")) -> DataFrame:
    """``(ord, value, id)`` from lines ``value [id]`` (plain or gzip): comments, blank lines and a header
    are skipped; missing ids are made from the place. Places order by file and line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    parts = lines.withColumn("p", F.split(F.trim("line"), r"[\s,]+"))
    kept = parts.where((F.trim("line") != "") & ~F.trim("line").startswith("#") & ~F.lower(F.col("p")[0]).isin(*header_words))
    return kept.select(
        F.struct("file", "at").alias("ord"), F.col("p")[0].alias("value"),
        F.when(F.size("p") > 1, F.col("p")[1]).otherwise(F.concat(F.lit(id_prefix), F.left(F.sha2(F.col("p")[0], 256), F.lit(12)))).alias("id"),
    )


def read_rule_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules by line (``#`` comments dropped) with their arity, and how many lines each class has."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    left = F.element_at(F.split("value", ">>"), 1)
    arity = F.when(~F.contains("value", F.lit(">>")), F.lit(None)).otherwise(F.size(F.split(left, r"\.")))
    rules = lines.select(F.trim("value").alias("reaction"), arity.alias("molecularity"))
    label = F.when(F.col("molecularity").isNull(), "malformed").when(F.col("molecularity") > 3, "too_many").otherwise("kept")
    return rules.where(label == "kept"), rules.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; a missing path gives an empty table."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return spark.read.schema(schema).json(path) if exists else spark.createDataFrame([], schema)


def read_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON object ``{key: [records]}`` as rows ``(key, ord, record)``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,array<{value}>>")).alias("key", "records")).select("key", F.posexplode("records").alias("ord", "record"))


def write_stamped(df: DataFrame, path: str, version: int, source_hash: str) -> None:
    """A table with version and source stamp, replaced as a whole by Spark's committer."""
    df.withColumns({"_version": F.lit(version), "_source": F.lit(source_hash)}).write.mode("overwrite").parquet(path)


def read_stamped(spark: SparkSession, path: str, version: int, source_hash: str) -> DataFrame | None:
    """The stamped table, or None if it is missing or its stamp differs."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    df = spark.read.parquet(path)
    stale = df.where((F.col("_version") != version) | (F.col("_source") != source_hash))
    return df.drop("_version", "_source") if stale.isEmpty() else None


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of records as rows; an empty array is an error."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def read_vocabulary(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Vocabulary records by line; a record without one of the required fields is an error."""
    df = spark.read.schema(schema).json(path)
    lacking = df.where(" or ".join(f"`{c}` is null" for c in required))
    if not lacking.isEmpty():
        raise ValueError(f"a record of {path} lacks one of {required}")
    return df


def read_numbered_files(spark: SparkSession, path: str, pattern: str, wanted: DataFrame | None = None, default: bytes | None = None) -> DataFrame:
    """``(number, content)``: files by the number in their path; files without number or content are
    skipped. With ``wanted`` (a column ``number``) there is a row for each of its numbers, ``default``
    taking the place of a missing or empty file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.regexp_extract("path", pattern, 1).alias("n"), "content").where("n <> '' and length(content) > 0")
    rows = rows.select(F.col("n").cast("bigint").alias("number"), "content")
    if wanted is None:
        return rows
    return wanted.select(F.col("number").cast("bigint").alias("number")).join(rows, "number", "left").select("number", F.coalesce("content", F.lit(default)).alias("content"))


def union_of(*tables: DataFrame) -> DataFrame:
    """Tables of any columns put together by name, with the place of their source in ``source_ord``."""
    out = tables[0].withColumn("source_ord", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("source_ord", F.lit(i)), allowMissingColumns=True)
    return out
