"""The corpus pipeline: stages that each take what the one before them kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import queries as llm
from anchorline.llm.decontaminate import marked_contamination
from anchorline.llm.jaccard_join import marked_classes
from anchorline.llm.packing import pack_documents
from anchorline.llm.pii import redact
from anchorline.llm.shared import row_mark, small_enough, table, workspace, written
from anchorline.llm.toxicity import fit, score_texts

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Marks to drop up to which they are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


def held(docs: DataFrame, *columns: Column) -> DataFrame:
    """Some columns, and all columns of ``docs`` as one, so that no name of theirs clashes."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def marked(docs: DataFrame) -> DataFrame:
    return held(docs, row_mark().alias("mark"))


def hinted(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small_enough(small, BROADCAST_ROWS) else small


def without(spark: SparkSession, docs: DataFrame, marks: DataFrame, label: str) -> DataFrame:
    """``docs`` whose row_mark() is not among ``marks``."""
    dropped = written(marks.select("mark").distinct(), workspace(spark, label))
    return marked(docs).join(hinted(dropped), "mark", "left_anti").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity below 0.5, by a model of the labels of this stage's documents.

    Null and empty texts have the score of no feature; rows that repeat are scored alike; an empty table stays empty. Columns
    of any name pass.
    """
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_texts(held(docs, F.col("text")), model).filter("toxicity < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id; of rows that repeat its doc_id and text one."""
    classes = written(marked_classes(docs).select("mark", "class_mark"), workspace(spark, "classes"))
    kept = without(spark, docs, classes.filter("mark <> class_mark"), "near-duplicates")
    # Only a mark that repeats is grouped: its rows are few, and each row alone in its group otherwise.
    twice = written(classes.filter("mark = class_mark").groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), workspace(spark, "repeated"))
    if twice.isEmpty():
        return kept
    first = marked(kept).join(hinted(twice), "mark", "left_semi").groupBy("mark").agg(F.first("row").alias("row"))
    return marked(kept).join(hinted(twice), "mark", "left_anti").select("row.*").unionByName(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null, empty and wordless texts have none and stay; of rows with one doc_id, or without, each goes by its own text. With an
    empty benchmark all stay. Columns of any name pass.
    """
    hit = marked_contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return without(spark, docs, hit, "contaminated")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the kind's name, and n_chars, if there is one, as it then is.

    Null and empty texts stay as they are; rows that repeat are redacted alike; an empty table stays empty.
    """
    redacted = redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents that are left: a row for each piece (see pack_documents()); null texts are empty."""
    return pack_documents(docs, llm.TOKENIZER)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
#: The classifier, the similarity join's recall and the tokenizer can't be told in SQL; tests hold the stages, and a whole run of
#: them, to what is planted in small tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), workspace(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
