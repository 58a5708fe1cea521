"""The corpus pipeline: each stage works on the documents that its predecessor kept.

A stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, jaccard, packing, quality, suffix_dedup
from panelspark.llm.common import materialize
from panelspark.storage import delete, scratch, shared_folder

#: Documents below this probability go; the threshold of the classifier's own query.
KEEP = 0.3
#: Bytes of a string that must not repeat. A passage of over 50 words has more: of all stretches of 51 words in prose
#: of the four languages, 99 of 100 are longer.
REPEAT = 240


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. A row's other columns do not matter and stay; nulls score as
    empty texts, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels, quality.fold() != 0)
    score = _unused(docs, "_score")
    return quality.score(docs, weights, out=score).where(F.col(score) >= KEEP).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the least id stays; of rows equal in id and text, one.

    A row without id stays if its whole component has none; equal texts without id are one row."""
    found = jaccard.join_similar(docs).where(F.col("component").isNull() | F.col("_id").eqNullSafe(F.col("component")))
    kept = materialize(found.groupBy("_id", "_th").agg(F.count("*").alias("_n")), "kept")
    rows = docs.withColumn("_panelspark_key", F.xxhash64(F.col("text").cast("string")))
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_panelspark_key"] == kept["_th"]), "left_semi").drop("_panelspark_key")
    return out.dropDuplicates(["doc_id", "text"]) if kept.where("_n > 1").head(1) else out


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``REPEAT`` bytes that also start elsewhere; a character that is cut apart
    goes whole, and n_chars is counted anew where a text changed. No document goes: one that is all repeats stays, empty."""
    cut = suffix_dedup.dedup_suffixes(docs.withColumn("_panelspark_null", F.col("text").isNull()), REPEAT, rest=True).withColumn("_kept", suffix_dedup.text_of("kept"))
    text = F.when(~F.col("_rest._panelspark_null"), F.col("_kept"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("_rest.n_chars"))}
    return cut.select(*(changed.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    items, best = _unused(docs, "_items"), _unused(docs, "_best")
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=(items, best))
    return found.where(F.size(items) == 0).drop(items, best)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Trained weights, hashes and token ids have no SQL; each stage is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; the last one's rows are returned. What a
    stage and its operator wrote goes once the next stage is written."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        if done:
            delete(spark, done)
        done = path
    return docs
