"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Language ID, line dedup, near-dedup, benchmark decontamination, BPE. Every stage works on
all documents that its predecessor kept, and all but the last return the input's columns.
Further columns of the documents pass through; ``n_chars``, where there is one, follows the
text when lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.bpe import encode_decode
from strata.llm.language import identify, train
from strata.llm.lines import drop_site_lines
from strata.llm.minhash import near_duplicates, row_prints
from strata.llm.queries import tokenizer_path
from strata.llm.tiling import find_items
from strata.session import scratch_path
from strata.sources import fs

JUDGED = 40                                       # letters of a text that can be told to be in no learned language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of ``JUDGED`` letters or more that score lower
    than the texts the machines learned from do: noise, and most texts in languages that no
    label names. NULL texts have no letter; without any label no document can stay; repeated
    rows fare alike."""
    model = train(docs)
    found = identify(docs, model).filter(F.col("lang_pred") != "und")
    letters = F.length(F.regexp_replace(F.col("doc.text"), r"\P{L}", ""))
    strange = F.when(F.col("score") < (model["least"] if model else 0.0), letters >= JUDGED).otherwise(False)
    return found.filter(~strange).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; no document does."""
    page = drop_site_lines(docs, "source").select("page.*")
    if "n_chars" in docs.columns:
        page = page.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return page


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, 0.8) the document with the
    smallest doc_id stays, in one copy; documents with a blank text are in no class."""
    classes = near_duplicates(docs, shingle=5, percent=80, keep_prints=True)
    names = ["print_a", "print_b"]
    stay = classes.filter("kept").select(*names).distinct()
    rows = docs.select(*row_prints("doc_id", "text"), F.struct("*").alias("doc"))
    # copies of a row meet in the join's partitions, so dropping them moves nothing more
    return rows.join(stay, names, "left_semi").dropDuplicates(names).select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_items(docs, items).filter(F.size("hits") == 0).select("doc.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, their token ids, and the digest of the decoded text."""
    out = encode_decode(docs, tokenizer_path(), columns=("n_tokens", "ids", "decoded_sha256"))
    return out.select("doc.*", "n_tokens", "ids", "decoded_sha256")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("bpe", bpe)]

#: SQL cannot express these stages; tests/llm compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's result is written and read again, and goes
    once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            fs.delete(spark, before)              # its rows are all read and written on
        before = path
    return docs
