"""Reading and writing of line records, whole texts and file facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "sid string, msg_idx int, block_idx int, has_real_thinking boolean, real_thinking_summary string, action_name string, action_input string, n_prior_msgs int"
CANDIDATES = "key string, candidates array<string>, provider string"
SCORES = "key string, base double, results array<struct<r string, s_suff double, s_nat double, leak array<string>>>"
SESSION_LINE = "line_no long, raw string"


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines of a fixed schema. Strict: a malformed line fails the job; otherwise it is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_records`` without strictness; no file gives no rows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return read_records(spark, path, schema, strict=False)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): unparsed lines with an id that follows the order of files and lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of files, contents not read. Empty files are not listed, so a gate sees them as missing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def append_records(df: DataFrame, path: str) -> None:
    """Append JSON lines; with ``cohort.pending`` on the key a run can be resumed."""
    df.write.mode("append").json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_arms(df: DataFrame, path: str) -> None:
    """One folder per arm."""
    df.write.mode("overwrite").partitionBy("arm").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def violated(gate: DataFrame) -> bool:
    """Whether a gate's query for violations has rows; stands for a process's exit status."""
    return not gate.isEmpty()


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON document that spans lines, one row per file."""
    return spark.read.option("multiLine", True).json(path)
