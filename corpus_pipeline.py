"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, source weights, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it
kept; all but the last return the columns of ``docs``. ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again, so a lost executor costs at most
the tasks of one stage. Texts may be null or empty; rows that repeat a doc_id are
handled as said at each stage; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.llm.decontaminate import contaminated
from horosphere.llm.mixture import mix_sources
from horosphere.llm.parity_join import near_components
from horosphere.llm.quality_pu import filter_quality, fit_quality
from horosphere.llm.tables import fold, kept, prepare, table, tokenizer_path
from horosphere.llm.token_blocks import token_blocks

#: Documents below this score go; lower than the classifier's own threshold,
#: because a clean document lost costs more than one doubtful document kept.
KEEP_SCORE = 0.15


#: Benchmark items of fewer words are no evidence of a leak: a common word or phrase is in many clean documents.
LEAST_ITEM = 4

#: Column that names a row in the stages that take rows away.
_ROW = "__row"


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of (doc_id, text) in front of a null or repeated doc_id: decisions are by row. Rows that
    agree in both are the same document."""
    return docs.withColumn(_ROW, F.xxhash64("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Trained on the
    labels of ids outside the held-out fold; each row is judged by its text alone, so rows with a null or
    repeated doc_id are judged like any other (a null one has no label), and all copies of a text alike."""
    prepare(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda c: ~fold(c, 5, 0))
    return filter_quality(docs, model, KEEP_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8):
    the one with the least doc_id. Texts without words are no duplicates. Decisions are by row: of rows that
    share a doc_id each is compared by its own text, rows that repeat doc_id and text are one document; a null
    doc_id stays."""
    prepare(spark)
    docs = _rows(docs)
    own = docs.where("doc_id is not null").select(F.col(_ROW).alias("doc_id"), "text")
    part = kept(near_components(own, width=5, num=80, den=100)
                .select(F.col("doc_id").alias(_ROW), F.col("component_id").alias("c")), "components")
    several = part.where(F.col("c") != F.col(_ROW)).select("c").distinct()
    inside = part.join(several, "c", "left_semi").join(docs.select(_ROW, "doc_id"), _ROW)
    first = inside.groupBy("c").agg(F.min(F.struct("doc_id", _ROW)).alias("m"))
    gone = inside.join(first.select("c", F.col(f"m.{_ROW}").alias("stays")), "c").where(F.col(_ROW) != F.col("stays"))
    docs = docs.join(gone.select(_ROW).distinct(), _ROW, "left_anti")
    again = part.groupBy(_ROW).count().where("count > 1").select(_ROW)
    if not again.isEmpty():
        docs = docs.join(again, _ROW, "left_anti").unionByName(
            docs.join(again, _ROW, "left_semi").dropDuplicates([_ROW]))
    return docs.drop(_ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no stretch with a benchmark item of LEAST_ITEM words or more. Decisions are by row: a null doc_id does not
    save a row, and a clean row stays beside a leaked one of the same doc_id; copies share their fate."""
    prepare(spark)
    docs = _rows(docs)
    hits = contaminated(docs.select(F.col(_ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), LEAST_ITEM)
    return docs.join(hits.select(F.col("doc_id").alias(_ROW)).distinct(), _ROW, "left_anti").drop(_ROW)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times), whole: the one in
    which a source's budget ends is taken if at least half of it fits. Texts without words
    add nothing to a mix and go."""
    prepare(spark)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source")
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return (mix_sources(packed).where(times > 0)
            .select(F.explode(F.sequence(F.lit(1), times)).alias("copy"), "doc").select("doc.*"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, read back: doc_id, start, n_tokens, ids_crc32. Every row is a
    document, in the order of (doc_id, nulls first, text); null texts count as empty."""
    prepare(spark)
    return token_blocks(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture),
          ("token-ID / binary output", token_output)]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, "stage-" + name.replace(" ", "-").replace("/", ""))
    return docs
