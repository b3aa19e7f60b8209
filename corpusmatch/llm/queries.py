"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmatch.llm import (
    decontaminate,
    divergence,
    mincut,
    packing,
    pii,
    ppm,
    resampling,
    sharding,
    simhash,
    suffixes,
    token_frames,
    transcripts,
    whitening,
)

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op1_spaced_seed_decontamination"] = decontaminate.oracle()


@query
def op2_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


@query
def op3_seekable_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_frames.token_table(_table(spark, sf_dir, "documents"), end_id=2)
    return read.select(
        "doc_id", "start", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op6_transcript_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written out as transcripts in several styles, parsed again."""
    told = transcripts.transcripts(_table(spark, sf_dir, "conversations"))
    model = transcripts.learn(told.filter(F.pmod("conv_id", F.lit(5)) != 0), "known")
    found = transcripts.parse(told.drop("known"), model)
    return found.select(
        "conv_id",
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
        "rendered",
    )


@query
def op7_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(_table(spark, sf_dir, "documents"), 50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_minimum_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = mincut.extract(pages, weights=mincut.learn(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op9_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(_table(spark, sf_dir, "documents"), 2048, end_id=1))


@query
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = sharding.shard_by_bytes(docs, "doc_id", sharding.text_size(F.col("text")), 16, keep={"text_crc32": crc})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 32)


@query
def op12_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.learn(docs)))


@query
def op13_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
