"""The corpus pipeline: five stages from documents to packed sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, language, neardup, packing, secrets
from tracewright.llm._shared import discard, folders, settle, sized, work_dir
from tracewright.llm.queries import table, tokenizer_path


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rows that the model rejects go (null and empty texts, texts without a letter, low scores).
    Repeated rows are judged alike; an empty table stays one. Columns other than text, lang and doc_id are carried only, but
    for lang_pred, score and rejected, which a table of documents must not have."""
    return language.identify(docs, language.train(docs)).filter(~F.col("rejected")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: the document with the smallest doc_id of each class stays, once if its row is repeated (all rows without
    a doc_id stay). Rows of one doc_id with other texts are one document: they stay or go together. Decisions are made on
    ids; the texts stay where they are unless the ids that go are too many to send out."""
    with folders() as made:
        classes = neardup.near_duplicates(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL")
        judged = classes.groupBy("doc_id").agg(F.max(F.col("class_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n")).filter("gone OR n > 1")
        done = list(made)
        judged = settle(judged, f"{work_dir(spark, 'judged')}/rows")
        discard(spark, done)
    gone, again = judged.filter("gone").select("doc_id"), judged.filter("NOT gone").select("doc_id")
    if again.isEmpty():
        return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(sized(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(sized(judged.select("doc_id")), "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: rows whose text holds a benchmark item go, whatever their doc_id (a null one too, and no other row of
    the same doc_id). Rows are judged where they stand; null and empty texts stay; an empty table stays one."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every span is masked in the text, the document stays; n_chars follows the new text, if there is one.
    Null texts stay null; repeated rows stay; the other columns are carried only."""
    return secrets.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left, as of ``packing.pack``: a row for each piece; null and empty texts are one piece of
    the end id, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Classifier, shingle sets and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is written before its work folders and its predecessor's table go."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with folders() as made:
            result = stage(spark, docs, sf_dir)
            done = list(made)
            docs = settle(result, f"{(root := work_dir(spark, f'pipeline-{name}'))}/rows")
        discard(spark, done + before)
        before = [root]
    return STAGES[-1][1](spark, docs, sf_dir)
