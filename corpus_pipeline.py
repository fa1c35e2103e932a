"""A corpus from raw documents: quality filter, near-duplicate removal, benchmark decontamination, secrets
replaced, texts encoded. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldoc.llm.common import stored, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or as toxic, go."""
    from veldoc.llm.quality import fit, judge

    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model, host_col="source", path_col="lang").where("keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays. Of rows that repeat an id and a text the one of least other
    columns stays; rows without words, under other ids, are no copies of each other."""
    from veldoc.llm.near_dups import near_duplicates

    keyed = docs.withColumn("node", text_key(F.col("text")))
    # an id and its text are told by two keys, so that a repeated row is found without a shuffle of texts
    repeated = stored(keyed.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    gone = stored(near_duplicates(docs).where(~F.col("is_first")).select("doc_id", "node"), "gone")
    rows = _without(keyed, gone.union(repeated.select("doc_id", "node")))
    again = _only(keyed, repeated.select("doc_id", "node")).groupBy("doc_id", "node").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row"))
    return rows.select(*COLUMNS).union(_without(again, gone).select("doc_id", "row.*").select(*COLUMNS))


def _matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = keys.select(F.col("doc_id").alias("key_id"), F.col("node").alias("key_node"))
    return rows.join(keys, rows["doc_id"].eqNullSafe(keys["key_id"]) & (rows["node"] == keys["key_node"]), how)


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return _matched(rows, keys, "left_anti")


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return _matched(rows, keys, "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    from veldoc.llm.decontaminate import find_benchmark

    return find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark."""
    import public_tokenizers

    from veldoc.llm.secrets import redact

    return redact(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text."""
    import public_tokenizers

    from veldoc.llm.bpe import encode as encoded

    out = encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: None of the stages but the third can be written in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
