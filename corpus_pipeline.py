"""The corpus pipeline: quality, lines, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``, with ``n_chars``
the length of the text as it then is.  Other columns are left out at each stage,
whatever their names.

Defined cases, for every stage: an empty table gives an empty one; rows without
an id are kept by the first four stages as they are by their operators (scored,
lines looked up, never a near-duplicate to go, no passages cut) and packed first;
null texts are scored as empty, keep one empty line, belong to no group and hold
the end id only; rows that share an id are judged row by row in ``quality``,
``passages`` and ``packing``, are one document in ``lines``, and go or stay
together in ``near_duplicates``; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm._common import files_for, write_stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents scored below this are taken as label 0.
CUTOFF = 0.3


def _sized(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``docs`` in parts of some thousand of the documents that were ``before``, so that no stage writes a tiny file a task."""
    return docs.coalesce(files_for(before.count()))


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes as label 1."""
    from framelake.llm.quality import quality_scores

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _sized(quality_scores(docs.select(*COLUMNS), labels, cutoff=CUTOFF).where("predicted = 1").select(*COLUMNS), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the largest document that holds them."""
    from framelake.llm.line_dedup import dedup_lines

    return _sized(_shaped(dedup_lines(docs.select(*COLUMNS))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates (five-word shingles, 0.8)."""
    from framelake.llm.minhash import keep_one

    return _sized(keep_one(docs.select(*COLUMNS), words=5, percent=80).select(*COLUMNS), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes stay only in the smallest document that holds them."""
    from framelake.llm.suffix_dedup import remove_repeats

    return _sized(_shaped(remove_repeats(docs.select(*COLUMNS), width=50)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 2048 tokens."""
    import public_tokenizers

    from framelake.llm.packing import pack_documents

    return _sized(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1), docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: The classifier and the packing plan have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_stage(docs, name)
    return docs
