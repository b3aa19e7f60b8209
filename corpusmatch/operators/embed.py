"""Text embedding with a content-hash cache.

An encoder is any function from a text column to an ``array<float>`` column that gives NULL for NULL:
a JVM expression, or an iterator UDF that loads a model once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusmatch.functions import text as tx, vectors as vx
from corpusmatch.functions.worker import once_per_worker
from corpusmatch.operators.skew import spread_join
from corpusmatch.operators.storage import small_batches, written
from corpusmatch.operators.upserts import replace_by_key

Encoder = Callable[[Column], Column]


def hashed_bag_of_words(dim: int = 256) -> Encoder:
    """Encoder that needs no model: ASCII word counts hashed into ``dim`` buckets, scaled to unit length."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket_of_word = once_per_worker(("hashed words", dim), dict)

        def vectors(texts: pa.Array) -> pa.Array:
            words = pc.split_pattern_regex(texts.fill_null(""), "[^a-z0-9_]+")
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(bucket_of_word) > 1 << 16:
                bucket_of_word.clear()
            for word in distinct:
                if word not in bucket_of_word:
                    bucket_of_word[word] = int(md5(word.encode()).hexdigest()[:4], 16) % dim
            bucket = np.array([bucket_of_word[w] if w else -1 for w in distinct], np.int64)[
                coded.indices.to_numpy(zero_copy_only=False)
            ]
            row = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
            counts = np.bincount((row * dim + bucket)[bucket >= 0], minlength=len(texts) * dim).reshape(-1, dim)
            norm = np.sqrt((counts * counts).sum(axis=1).astype(float))[:, None]
            unit = (counts / np.where(norm == 0, 1, norm)).astype(np.float32)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * dim
            mask = texts.is_null() if texts.null_count else None
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()), mask=mask)

        for texts in batches:
            parts = [vectors(texts.slice(at, 1000)) for at in range(0, len(texts), 1000)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    # or Spark would encode once more for every filter on the vector
    once = encode.asNondeterministic()
    return lambda text: once(F.lower(text))


def embed_texts(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    """Add the vector of ``text`` to every row; a blank text gets NULL."""
    return df.withColumn(out, encoder(F.when(tx.strip(F.col(text)) != "", F.col(text))))


def with_embedding_text(
    symbols: DataFrame, min_chars: int = 0, max_body: int | None = None
) -> DataFrame:
    """Add ``text`` and ``text_hash`` where a symbol still needs a vector and is long enough, else NULL."""
    text = tx.symbol_text(F.col("name"), F.col("kind"), F.col("docstring"), F.col("source"), max_body)
    due = ~vx.is_embedded(F.col("embedding")) & tx.long_enough(F.col("docstring"), F.col("source"), min_chars)
    with_text = symbols.withColumn("text", F.when(due & (text != ""), text))
    return with_text.withColumn("text_hash", F.when(F.col("text").isNotNull(), F.sha2("text", 256)))


def cache_hits(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``text_hash, embedding`` of the cache rows that some text asks for.

    Copies of a text collapse on the map side; the two sides then meet on unique hashes.
    """
    return cache.select("text_hash", "embedding").join(texts.select("text_hash").distinct(), "text_hash", "left_semi")


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``text_hash, text``: each distinct text that is not in the cache yet.

    Copies collapse on the map side before anything is joined. An outer join with a test for no match,
    because Spark would move an anti join below the aggregate, where the copies are still apart.
    """
    distinct = texts.filter(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.first("text").alias("text"))
    known = cache.select("text_hash", F.lit(True).alias("_known"))
    return distinct.join(known, "text_hash", "left").filter(F.col("_known").isNull()).drop("_known")


def cache_merge(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by hash."""
    return replace_by_key(cache.select("text_hash", "embedding"), new.select("text_hash", "embedding"), "text_hash")


def attach_embeddings(rows: DataFrame, cache: DataFrame, row_key: str = "symbol_id") -> DataFrame:
    """Set ``embedding`` from the cache for rows that have a ``text_hash``; the other rows keep theirs.

    Copies of one text, or rows without any, may be a large share: both are spread.
    """
    vectors = cache.select("text_hash", F.col("embedding").alias("_cached"))
    joined = spread_join(rows, vectors, "text_hash", row_key, "left")
    chosen = F.when(F.col("text_hash").isNotNull(), F.col("_cached")).otherwise(F.col("embedding"))
    return joined.withColumn("embedding", chosen).drop("_cached").select(*rows.columns)


def embed_incremental(
    symbols: DataFrame,
    cache: DataFrame | Callable[[DataFrame], DataFrame],
    encoder: Encoder,
    min_chars: int = 0,
    folder: str | None = None,
    max_body: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(vectors, fresh)``: a vector per embeddable symbol, and the cache rows this run had to add.

    One pass over the symbols writes the short texts to be embedded; everything after reads those. The
    encoder, the expensive step, runs once per distinct text the cache lacks, and its result is
    written too. ``cache`` may be a function that gives the cache for a table of hashes, so that it need not be read
    whole. ``vectors`` is (symbol_id, repo_id, text_hash, embedding): the wide symbol rows
    themselves are never shuffled. Appending ``fresh`` completes the cache, since no old row changes.
    """
    due = with_embedding_text(symbols, min_chars, max_body).filter(F.col("text_hash").isNotNull())
    texts = written(due.select("symbol_id", "repo_id", "text_hash", "text"), "texts", folder)
    cache = cache(texts.select("text_hash")) if callable(cache) else cache
    encoded = embed_texts(cache_misses(texts, cache), "text", encoder).select("text_hash", "embedding")
    with small_batches(symbols.sparkSession):
        fresh = written(encoded, "new_vectors", folder)
    complete = cache.select("text_hash", "embedding").unionByName(fresh)
    keys = texts.select("symbol_id", "repo_id", "text_hash")
    return spread_join(keys, complete, "text_hash", row_key="symbol_id"), fresh


def update_embeddings(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """Symbols with the vectors of ``vectors`` written back; symbols it does not mention keep theirs."""
    new = vectors.select("symbol_id", F.col("embedding").alias("_new"), F.lit(True).alias("_hit"))
    joined = symbols.join(new, "symbol_id", "left")
    chosen = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("embedding"))
    return joined.withColumn("embedding", chosen).select(*symbols.columns)


def embed_coverage(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Per repository: rows with a ``text_hash``, how many of them the cache has, how many it lacks.

    Counted per (repository, hash) before the join, so copies collapse on the map side.
    """
    counted = texts.filter(F.col("text_hash").isNotNull()).groupBy("repo_id", "text_hash").agg(
        F.count(F.lit(1)).alias("rows")
    )
    known = cache.select("text_hash", F.lit(True).alias("_known"))
    return (
        counted.join(known, "text_hash", "left")
        .groupBy("repo_id")
        .agg(
            F.sum("rows").alias("total"),
            F.sum(F.when(F.col("_known"), F.col("rows")).otherwise(0)).alias("cached"),
            F.sum(F.when(F.col("_known"), 0).otherwise(F.col("rows"))).alias("newly_embedded"),
        )
    )
