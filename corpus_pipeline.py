"""A corpus from raw documents to training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` applies them to ``documents``,
writing what each returns to the shared folder. All but the last return the columns of documents. Columns beyond those of
documents go along unchanged, whatever their names (the last stage leaves them out).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import langid, mixing, neardup, packing, passages
from weirflow.llm.common import bound_batches, bounded, drop, scratch, sealed, ship, table

#: A text is rejected if it has no letters, or its language is less sure than this.
LEAST_SURE = 0.2
#: Bytes of a repeated passage, ids of a sequence, the id that ends a document, file name of the tokenizer.
PASSAGE, SEQUENCE, END, TOKENIZER = 100, 4096, 2, "word_bpe_49k.json"
#: Bytes of text that packing takes at once: less than by itself, as the stages before have filled the executors' heaps.
SLICE_BYTES = 2 << 20

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def others_aside(stage: Stage) -> Stage:
    """``stage``, with the columns beyond those of documents under names that no operator uses while it works."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c in COLUMNS]
        names = {c: c if c in COLUMNS else f"other column {i}" for i, c in enumerate(docs.columns)}
        if len(own) == len(names):
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])

    return run_stage


@others_aside
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts in no language (null, empty or without a letter, or of no sure language); fill in a lang that is missing.

    Each row is judged by its own text, whatever rows share its doc_id.
    """
    model = langid.learn(docs, F.lit(True))
    found = langid.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@others_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest doc_id (null last), of these the smallest hash of the text.

    Rows are told apart by doc_id and text, so of rows that share a doc_id only those go whose text another row stands for;
    of rows equal in both, one stays. Rows without a word stay.
    """
    named = docs.withColumns({"_key": sealed(F.col("doc_id").cast("string")), "_hash": F.xxhash64("text")})
    with scratch(spark) as keep:
        found = neardup.leaders(neardup.components(docs)).withColumn("_key", sealed(F.col("doc_id").cast("string"))).withColumnRenamed("text_hash", "_hash")
        gone = keep(found.where("not stays").select("_key", "_hash"), "gone")
        repeated = keep(found.where("stays and times > 1").select("_key", "_hash"), "repeated")
    left = named.join(bounded(gone, gone.count(), 64), ["_key", "_hash"], "left_anti")
    n = repeated.count()
    if n == 0:
        return left.select(docs.columns)
    single = left.join(bounded(repeated, n, 64), ["_key", "_hash"], "left_anti")
    # Of rows equal in doc_id and text the same one stays in every run, whatever their other columns are.
    rows = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    once = left.join(bounded(repeated, n, 64), ["_key", "_hash"], "left_semi").select("_key", "_hash", rows).groupBy("_key", "_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("_key", "_hash", "row.*")
    return single.unionByName(once).select(docs.columns)


@others_aside
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that are there earlier; a text of which nothing is left goes. Rows that share a doc_id are each cut,
    the earlier being the one read first."""
    cut = passages.strip(docs, PASSAGE)
    left = cut.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@others_aside
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as its source's target asks. Rows equal in doc_id and text draw the same number, each for its own source's rate."""
    return mixing.mix(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences: a row a piece. Rows that share a doc_id are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), SEQUENCE, END, SLICE_BYTES, spare=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can't express these stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what a stage wrote on its way, and the table before it, go once its own is written."""
    bound_batches(spark)
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(stage(spark, before, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
