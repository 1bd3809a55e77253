"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tremolith.llm import decontaminate as op8, langid as op3, mixing as op2, near_dedup as op1, token_output as op9
from tremolith.llm.queries import BYTE_BPE, read
from tremolith.llm.stage import new_path, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # learned language models decide the first stage


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: no text, no letter, or far from every language learnt."""
    found = op3.identify(docs, op3.train(docs, F.lit(True)))
    return found.where(~F.col("language.rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8), the one with the least id."""
    kept = op1.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go."""
    found = op8.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~op8.contaminated()).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents about as often as the mix takes their words; each source's words meet those taken within its largest document.

    Each row is repeated by the whole part of taken / size.  The rest is rounded along a running sum within the source, from
    large documents to small ones: the running counts are never off by more than half a row, so (sizes falling) the words
    are never off by more than half the largest document.
    """
    numbered = stage(docs.withColumn("row", F.monotonically_increasing_id()), "mix-numbered")
    made = op2.mix_sources(numbered, row="row")
    one = 1 << 30
    times = stage(made.taken.where("taken > 0").join(made.rows.select("row", "sk"), "row").select(
        "row", "doc_id", "sk", "size", F.floor(F.col("taken") / F.col("size")).cast("long").alias("whole"),
        F.round(F.pmod("taken", "size") / F.col("size") * one).cast("long").alias("rest")).where("whole > 0 or rest > 0"), "mix-times")
    # running sums in two levels, so that no source is one task: within (size, part), then over one row each
    times = times.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 + times.count() // (1 << 20))))
    ahead = times.groupBy("sk", "size", "part").agg(F.sum("rest").alias("sum"))
    ahead = ahead.withColumn("ahead", F.sum("sum").over(Window.partitionBy("sk").orderBy(F.desc("size"), "part")) - F.col("sum")).drop("sum")
    within = F.sum("rest").over(Window.partitionBy("sk", "size", "part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    run = times.withColumn("own", within).join(ahead, ["sk", "size", "part"]).withColumn("run", F.col("ahead") + F.col("own") + one // 2)
    times = run.select("row", (F.col("whole") + F.shiftright("run", 30) - F.shiftright(F.col("run") - F.col("rest"), 30)).cast("int").alias("times")).where("times > 0")
    return numbered.join(times, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; one row a document, read back from them."""
    path = new_path(spark, "pipeline-tokens")
    op9.write(docs, path, BYTE_BPE)
    return op9.read_documents(spark, path)


STAGES = [("language identification", keep_languages), ("near-duplicate removal", drop_near_duplicates), ("benchmark decontamination", drop_contaminated),
          ("source mixing", mix), ("token output", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
