"""Thin queries over the given tables, one per operator; SQL where it can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate as op8, langid as op3, mixing as op2, fingerprint as op5, lm_score as op6, toxicity as op4, pii as op7, chat as op10, near_dedup as op1, token_output as op9, hard_negatives as op11, packing as op12, whitening as op13
from .stage import new_path, stage

try:
    import public_tokenizers
    BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:
    BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_decontaminate", op8.SQL)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    c = F.col("contamination")
    found = op8.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), c["n_items"].alias("n_items"),
                        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), op8.contaminated().alias("contaminated"))


@query("op9_token_output")
def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-output")
    op9.write(read(spark, sf_dir, "documents").select("doc_id", "text"), path, BYTE_BPE)
    return op9.read_documents(spark, path)


@query("op1_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def remainder(n: int) -> "F.Column":
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op3.train(docs, remainder(3) != 1)
    c = F.col("language")
    return op3.identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), c["lang"].alias("lang_pred"), c["score"].alias("score"),
                                                                     c["entropy"].alias("entropy"), c["rejected"].alias("rejected"))


@query("op2_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.mix_sources(read(spark, sf_dir, "documents")).taken.drop("row")


@query("op5_fingerprint")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = op5.with_next(read(spark, sf_dir, "documents")).withColumn("edited", op5.edited(F.col("text"), F.col("next_text")))
    made = op5.with_fingerprint(op5.with_fingerprint(pairs, "text", "fingerprint"), "edited", "edited_fingerprint")
    made = stage(made.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "fingerprints")
    both = op5.with_next(made, text="fingerprint", keep=("n_chars", "edited_sha256", "edited_fingerprint"))
    return both.select("doc_id", "n_chars", "edited_sha256", F.col("text").alias("fingerprint"), "edited_fingerprint", op5.likeness(F.col("text"), F.col("edited_fingerprint")).alias("near_edited"),
                       op5.likeness(F.col("text"), F.col("next_text")).alias("near_next"))


@query("op6_lm_score")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return op6.score(docs, remainder(7) != 2).select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(remainder(5) != 0)
    model = op4.train(docs.where(remainder(5) != 0), labels)
    score = F.col("toxicity")
    return op4.classify(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query("op7_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7.find_personal_data(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(op7.KINDS)]
    return found.select("doc_id", *counts, F.sha2(op7.written(F.col("base")), 256).alias("base_sha256"), op7.written(F.concat("base", "added")).alias("spans"))


@query("op10_preference_pairs", op10.SQL)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = op10.conversations(read(spark, sf_dir, "conversations"))
    return op10.preference_pairs(convs, op10.neighbours(convs))


@query("op11_hard_negatives", op11.SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op11.hard_negatives(op11.integer_rows(read(spark, sf_dir, "embeddings"), labels=moved))


@query("op12_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op12.pack(read(spark, sf_dir, "documents"), BYTE_BPE)
    pieces = packed.pieces.select("part", "place", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packed.slots, ["part", "place"]).drop("part", "place")


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op13.integer_rows(read(spark, sf_dir, "embeddings"))
    model, distinct = op13.fit(rows)
    error = op13.identity_error(distinct, model, 16) if model else 0.0
    return op13.apply(rows, model, 16).select(F.col("id").alias("vec_id"), "component", F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
