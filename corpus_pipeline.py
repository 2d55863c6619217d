"""The corpus pipeline: quality filter, near-dedup, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. run() writes each stage's result to the shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, quality, suffixes
from tidemark.llm.common import table, write_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on this input's labelled documents, does not reject (0.5 is kept).

    A text that is null, empty or all white space scores the share of good documents in the sample; equal texts are
    kept or go together, and rows that repeat are kept each. No documents give no rows; any column names may occur.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = "score_" + "_" * max(map(len, docs.columns))  # longer than any name that is there
    return quality.score(docs, model, keep=tuple(docs.columns), name=name).filter(F.col(name) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each class of near-duplicates; a null id is kept.

    A null text is an empty one; rows of one id are one document and stay or go together; no documents give no rows.
    """
    found = neardup.classes(docs).filter("duplicate").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a 100-byte string repeats; a character that a removal's edge cuts goes whole.

    A null text stays null, and n_chars follows the text. Rows of one id do not repeat each other; a null id comes
    first. No documents give no rows; any column names may occur.
    """
    names = [f"c{n}" for n in range(len(docs.columns))]  # no name of ours may meet one of theirs
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    cut = suffixes.remove_repeats(docs.toDF(*names), key=key, text=text, keep=tuple(n for n in names if n not in (key, text)), as_text=True)
    out = cut.select(*[F.col("kept" if n == text else n).cast(docs.schema[c].dataType).alias(c) for n, c in zip(names, docs.columns)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one end id; rows of one id, and rows that repeat, are packed each; other columns are
    not read. No documents give no rows.
    """
    return packing.pack(docs).drop("ids")


STAGES = [("quality classifier", keep_quality), ("MinHash near-dedup", drop_near_duplicates), ("suffix-array dedup", remove_repeats), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, "stage")
    return docs
