"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and is written as Parquet before the next one reads it. All but the last return
the columns of documents, whatever other columns docs has, under any name.

In every stage each row is judged by its whole text, however long, and an empty
table gives no rows. What nulls, empty texts, ties and repeated rows give is said
at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, near, packing, pii, quality
from millrace.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; a score equal to it stays.

    A null text is scored as an empty one, and its row keeps its null. Repeated rows
    and rows without an id have the score of their text, each for itself. Labels
    teach only where their doc_id is found; without any, the score is one for all.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(COLUMNS), model, "_score").where(F.col("_score") >= quality.THRESHOLD).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every near-duplicate group (five-word shingles, similarity 0.8).

    Of rows with one id and one text, one stays; rows with one id and different
    texts are different documents. Texts without words, null or empty, are like
    nothing and stay. Rows with a null id can't be named as the one that stays, so
    all of them do. Similarity right at 0.8 links.
    """
    found = near.near_duplicates(docs, width=5, percent=80).where("doc_id is not null")
    rows = found.where("kept").groupBy("doc_id").count()
    docs = docs.select(COLUMNS)
    one = docs.join(rows.where("count = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = docs.join(rows.where("count > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(repeated).unionByName(docs.where("doc_id is null")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold no item and stay; repeated rows and rows without an
    id are searched each for itself. A distance equal to an item's budget counts.
    """
    return decontam.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars of the new text.

    A null text stays null, with a null n_chars; an empty one stays empty. Where
    spans overlap the first one's kind names their union; equal shares choose the
    earlier candidate. Repeated rows are masked alike.
    """
    return pii.redacted(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens.

    Null and empty texts are one piece of one token, their end. Only documents
    longer than a sequence are cut, a very long one into as many pieces as that
    takes. Pieces of one length are ranked by id and piece; repeated rows and rows
    without an id are pieces of their own.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_leaks), ("pii", mask_personal), ("packing", pack)]

#: The stages use trained models, edit distances and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder.

    What lies between two stages is written to the shared folder, and deleted
    once the stage that reads it is written too.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage, spark, docs, sf_dir)
    return docs
