"""Log tables, templates, raw text and run records as DataFrames; schemas are stated, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip_text

#: A text that cannot be a field, so that an empty field stays empty and NA stays text.
_NO_NULL = "\x00weirlog-null\x00"


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], multi_line: bool = True) -> DataFrame:
    """The named columns of CSV files with a header, all as text, quotes and line ends within fields included; BOMs are skipped.

    A file whose fields may hold line ends is read by one task. Without multi_line every record is a line, and files
    are split over tasks.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"', nullValue=_NO_NULL, emptyValue="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = reader.csv(path)
    clean = {c: c.lstrip("﻿").strip('"') for c in df.columns}
    df = df.withColumnsRenamed({a: b for a, b in clean.items() if a != b})
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{path}:1 lacks the columns {lost}")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def with_idx(df: DataFrame) -> DataFrame:
    """df with idx, the place of each row in its files' order, by partition sizes and a rank within partitions."""
    from pyspark.sql import Window as W

    numbered = df.withColumn("weirlog_n", F.monotonically_increasing_id()).withColumn("weirlog_p", F.shiftright("weirlog_n", 33))
    sizes = numbered.groupBy("weirlog_p").agg(F.count("*").alias("weirlog_size"))
    base = sizes.select(F.col("weirlog_p").alias("p"), (F.sum("weirlog_size").over(W.orderBy("weirlog_p")) - F.col("weirlog_size")).alias("weirlog_base"))
    joined = numbered.join(F.broadcast(base), F.col("weirlog_p") == F.col("p"))
    at = F.col("weirlog_base") + F.col("weirlog_n").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("idx", at).drop("p", "weirlog_base", "weirlog_n", "weirlog_p")


def read_structured(spark: SparkSession, path: str, event_id: bool = False, multi_line: bool = True) -> DataFrame:
    """(idx, LineId, Content, EventTemplate[, EventId]); contents are stripped."""
    df = read_csv(spark, path, ["LineId", "Content", "EventTemplate", *(["EventId"] if event_id else [])], multi_line)
    return with_idx(df.withColumn("Content", strip_text(F.col("Content"))))


def read_pairs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(idx, LineId, EventTemplate) for evaluation."""
    return with_idx(read_csv(spark, path, ["LineId", "EventTemplate"], multi_line))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(EventTemplate, Occurrences)."""
    return read_csv(spark, path, ["EventTemplate", "Occurrences"]).withColumn("Occurrences", F.col("Occurrences").cast("long"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(idx, Content) of a text file's lines; bytes that are not UTF-8 become replacement characters."""
    return with_idx(spark.read.text(path).withColumnRenamed("value", "Content"))


def raw_line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


RUN_SCHEMA = (
    "run_id string, dataset string, quadrant string, config_hash string, rows long, sampling_protocol string, bucket_count long, cluster_count long, template_count long, "
    "config struct<preprocess_mode:string,parameter_mode:string,params:struct<theta:double,n_positions:int,tau:double,sample_size:int,top_k:int,delta_l:int,early_stop:double>>, "
    "protocol struct<evaluation_mode:string,dataset_specific_preprocessing:boolean,dataset_specific_parameters:boolean,target_file_used_for_template_generation:boolean,target_file_used_for_cache_initialization:boolean,chronological_split:boolean,held_out_target_system:boolean>, "
    "timing_seconds map<string,double>, metrics struct<PA:double,GA:double,FGA:double,PTA:double,RTA:double,FTA:double>"
)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run records (run_metadata.json) below root with their paths, in path order."""
    df = spark.read.schema(RUN_SCHEMA).options(multiLine=True, recursiveFileLookup=True, pathGlobFilter="run_metadata.json").json(root)
    return df.select("*", F.col("_metadata.file_path").alias("path")).orderBy("path")


_WORDS, _COUNTS = ("Timestamp", "Dataset", "FTA_definition"), ("TotalLogs", "GT_Clusters", "Pred_Clusters", "Matched_Clusters", "Matched_Templates")
RESULT_COLUMNS = (
    "Timestamp", "Dataset", "TotalLogs", "GT_Clusters", "Pred_Clusters", "Matched_Clusters", "Matched_Templates", "PA", "GA", "FGA", "PTA", "RTA", "FTA", "FTA_definition", "Runtime(s)", "EPS(Logs/s)",
)


def _result_type(name: str) -> str:
    return "string" if name in _WORDS else "long" if name in _COUNTS else "double"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A metrics summary, or all that a glob names; columns that older files lack are null."""
    names = spark.read.options(header=True).csv(path).columns
    have = {n.lstrip("﻿") for n in names}
    text = spark.read.options(header=True).csv(path)
    text = text.withColumnsRenamed({n: n.lstrip("﻿") for n in names if n != n.lstrip("﻿")})
    return text.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(_result_type(n)).alias(n) for n in RESULT_COLUMNS])


def read_variant_results(spark: SparkSession, folder: str) -> DataFrame:
    """All ablation_*_results.csv of a folder with Variant and Dataset taken from the key {Dataset}_{Variant}."""
    df = read_results(spark, f"{folder}/ablation_*_results.csv")
    return df.withColumns({"Variant": F.expr("split_part(Dataset, '_', 2)"), "DatasetName": F.expr("split_part(Dataset, '_', 1)")})


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
