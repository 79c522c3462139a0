"""From raw documents to packed sequences: toxicity, near-duplicates, repeated passages, source mixture, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import minhash, mixing, packing, suffixes, toxicity
from weirlog.llm.common import collecting, drop_staged, shared_dir, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage of a run has staged, by thread and tables.
_left: dict[tuple[int, str], list[str]] = {}


def _tidy(step: Stage) -> Stage:
    """Delete what the stage before has staged: its result is written and read again by now."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault((get_ident(), sf_dir), [])
        drop_staged(spark, left)
        with collecting(left):
            return step(spark, docs, sf_dir)

    return run_step


@_tidy
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold. The model is learnt from the labelled documents among docs."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def _named(docs: DataFrame) -> DataFrame:
    """docs' ids and texts, (weirlog_id, weirlog_text, t1, t2): t1 and t2 hash a text, ids that come with several texts get new ones.

    Ids are unique afterwards but for rows with equal texts. New ones are counted in the order of the old ones, so the
    smallest still goes with the smallest.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", F.col("text").alias("weirlog_text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    several = rows.groupBy("doc_id").agg(F.min(F.struct("t1", "t2")).alias("a"), F.max(F.struct("t1", "t2")).alias("z")).where("a <> z").limit(1).count()
    if not several:
        return rows.withColumn("weirlog_id", F.col("doc_id"))
    ids = rows.select("doc_id", "t1", "t2").distinct().orderBy("doc_id", "t1", "t2").withColumn("weirlog_id", F.monotonically_increasing_id())
    return rows.join(stage(ids, "newids"), ["doc_id", "t1", "t2"])


@_tidy
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; documents without an id stay.

    Different texts under one id are documents of their own. Of rows that repeat id and text, the first stays in the order
    of their other columns.
    """
    named = _named(docs)
    kept = minhash.near_duplicates(named, id_col="weirlog_id", text_col="weirlog_text").where("kept").select(F.col("doc_id").alias("weirlog_id")).distinct()
    kept = stage(named.select("weirlog_id", F.col("doc_id").alias("k_id"), "t1", "t2").join(kept, "weirlog_id").groupBy("k_id", "t1", "t2").agg(F.count("*").alias("weirlog_n")), "keptids")
    text = F.coalesce("text", F.lit(""))
    is_kept = (docs["doc_id"] == kept["k_id"]) & (F.xxhash64(text) == kept["t1"]) & (F.xxhash64(F.lit(1), text) == kept["t2"])
    out = docs.where("doc_id is not null").join(kept.where("weirlog_n = 1"), is_kept, "left_semi")
    again = kept.where("weirlog_n > 1")
    if again.limit(1).count():
        rows = docs.where("doc_id is not null").join(again, is_kept, "left_semi")
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        whole = rows.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])).alias("order"))
        out = out.unionByName(whole.groupBy("doc_id", "text").agg(F.min_by("row", "order").alias("row")).select("row.*"))
    return out.unionByName(docs.where("doc_id is null"))


@_tidy
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that came earlier; a document of which nothing is left goes.

    A character that is cut in two goes as a whole. n_chars follows the text. Documents that lose nothing stay as they are.
    """
    r = suffixes.remove_repeats(docs, as_text=True)
    changed = F.col("n_removed") > 0
    r = r.where((F.col("n_removed") < F.col("n_bytes")) | ~changed)
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return r.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mixture takes them (0 to 3 times), spread so that sources and copies mix."""
    m = mixing.mix_sources(docs, cut=False, carry=True).where("size > 0 and taken > 0")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("taken div size").cast("int"))))
    return m.repartition(F.xxhash64("doc_id", "size", "copy")).select("row.*")


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, sequence by sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: Learnt scores and token ids are beyond SQL; tests hold each stage against its definition instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/corpus-{uuid4().hex}"
    for name, step in STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
