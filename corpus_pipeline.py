"""A corpus pipeline over ``documents``: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm import decontam, jaccard, langid, packing, suffix
from wharfline.llm.queries import tokenizer_path
from wharfline.llm.shared import collecting, drop, materialise

MIN_SCORE = 0.5  # of the predicted language
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)  # a task holds its batch several times, in the JVM and in Python


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``docs``, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(n for i in range(len(taken) + 1) if (n := "_" * (i + 1) + name) not in taken) for name in names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, and those whose language is doubtful, go; texts are read whole.

    Without any label to learn from, all stay. Repeated rows are judged each by itself. Other columns stay, whatever their
    names; an empty table gives an empty one.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs
    lang, score = _free(docs, "lang", "score")
    known = langid.identify(docs, model, out=(lang, score))
    return known.filter((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; repeats of it count once.

    Near-duplicates are texts linked by SimHash, or by a similarity of their five-word shingles of 0.8 or more.

    Of different texts under that id the one with the smallest hash stays. Rows without an id stay. Texts without a word are
    alike; texts are read whole. Other columns stay, whatever their names; an empty table gives an empty one.
    """
    found = jaccard.classes(docs).filter("doc_id is not null").groupBy("component", "doc_id", "row").count()
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row", "count")).alias("first"))
    (row,) = _free(docs, "row")
    first = materialise(first.select(F.col("first.row").alias(row), "first.count"), "first-documents")
    marked = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kept = marked.join(first.select(row).hint("merge"), row, "left_semi")  # rows grow with the corpus: never broadcast
    if not first.filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([row])
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document has go, and the characters they are part of; documents left empty by that go, too.

    Rows without an id stay as they are; so do texts in which nothing repeats, empty ones among them, whatever their
    characters. Texts are read whole. Other columns stay, whatever their names; an empty table gives an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffix.find_repeats(docs.filter("doc_id is not null"), carry=others, whole_characters=True).filter("n_removed < n_bytes or n_bytes = 0")
    kept = found.withColumn("text", F.col("kept").cast("string")).filter("text <> '' or n_removed = 0")
    kept = kept.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *[F.col(f"carried.`{c}`") for c in others])
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their id: they are found by a hash of their text. Null and empty texts hold none.

    Texts are read whole. Repeated rows go or stay together. Other columns stay, whatever their names; an empty table gives
    an empty one.
    """
    (row,) = _free(docs, "row")
    marked = docs.withColumn(row, F.xxhash64("text"))
    found = decontam.find(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row).select("doc_id").distinct()
    found = materialise(found.select(F.col("doc_id").alias(row)), "leaks")
    return marked.join(found, row, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, in the proportions of the sources; see ``packing.pack`` for nulls and repeats."""
    return packing.pack(docs, tokenizer_path())


_written: dict[tuple[str, str, str], list[str]] = {}  # intermediate tables by application, folder and stage


def _clearing(name: str, stage, before: str = ""):  # noqa: ANN001, ANN202
    """The stage, which first deletes the intermediate tables that the stage before wrote for the same folder.

    By then that stage's result has been written, as STAGES demand. Tables of other folders and stages are left alone.
    Arrow batches are bounded by BATCH from then on, for the whole session, unless it has a bound of its own: results are lazy.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if BATCH[0] not in spark.conf.getAll:
            spark.conf.set(*BATCH)
        run = spark.sparkContext.applicationId, sf_dir
        drop(spark, _written.pop((*run, before), []))
        with collecting(_written.setdefault((*run, name), [])):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _clearing("language", language)),
    ("near duplicates", _clearing("near duplicates", near_duplicates, "language")),
    ("repeats", _clearing("repeats", repeats, "near duplicates")),
    ("leaks", _clearing("leaks", leaks, "repeats")),
    ("packing", _clearing("packing", pack, "leaks")),
]

#: SQL can't express the learned model, the tokenizer and the searches; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
