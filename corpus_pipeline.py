"""A training-data pipeline over ``documents``: each stage keeps the table's columns but the last.

Quality rules reject documents; of each group of near copies one stays; long repeated
strings of bytes or words are cut from the texts; documents with benchmark passages go; the rest is
encoded. Every stage works on all that its predecessor kept, written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sentencepiece_bpe import sentencepiece_roundtrip
from tidemark.llm.suffix_dedup import WORDS, suffix_array_dedup
from tidemark.session import Scratch


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (op 4), with thresholds from ``labels``.

    Null and empty texts fail the base rule and go; repeated rows are judged alike.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "lang", "text")
    judged = quality_rules(packed, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["row", "doc_id", "lang"])
    return judged.where("kept").select("row.*")


def keep_one_of_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (op 2: five words, 0.75) the document with the smallest id.

    Of rows with the same id the one with the least text stays; rows without an id stay.
    """
    classes = jaccard_components(docs.select("doc_id", "text"))
    stay = classes.where("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = chosen.groupBy("doc_id").agg(F.min_by(row, F.struct("text")).alias("row")).select("row.*")
    return first.unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings of 400 bytes or 50 words (op 7); n_chars follows. Null texts stay null."""
    cut = suffix_array_dedup(docs, kept_text="__kept", words=WORDS)
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _columns(out, docs)


def drop_benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark (op 6); null and empty texts stay."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    judged = decontaminate(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return judged.where("NOT contaminated").select("row.*")


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its token ids, their number and the digests of ids and decoded text (op 9)."""
    import public_tokenizers

    coded = sentencepiece_roundtrip(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), drop_text=True)
    return coded.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the thresholds, the seeds and the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(i))
    return docs
