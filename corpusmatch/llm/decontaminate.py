"""Benchmark passages in documents, by spaced-seed hashing.

Texts are words: runs of letters and digits, in lower case. A mask names the positions of a window of words
that count; the others may hold anything, so a replaced word does not break the match. The windows of
documents and benchmark items that agree in all counted positions of a mask are a hit. A hit fixes how the two
texts lie on each other (its diagonal). An overlap is verified if, on a hit's diagonal, some stretch of
``window`` words (the whole item, if it is shorter) agrees in at least ``similarity`` of its positions.
An item too short for every mask is looked up as a whole, word by word; one of fewer than ``min_words`` words says
too little and is passed over.

The windows of documents never move: hashed seeds of the benchmark go to all tasks up to ``sent_seeds`` rows; a larger
benchmark is met by a shuffle join on the hash. Only hits leave their task, one row per diagonal.

Nulls and empty texts have no words and no hits. Rows that repeat an id are one document; a null id is one, too.
Items of the same words are looked up once and all reported. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# 1: the position counts. Wherever a window of 13 words holds two replaced ones, or a shorter item as many as 0.8 lets it,
# some mask falls between or across them; the tests try every placement.
MASKS = ("1111", "11101", "11011", "10111")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """``at, mask, key`` of every window of every mask (by its number); the other columns stay."""
    n, least = F.size("h"), min(map(len, masks))
    at = F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least)))
    keys = [
        F.when(
            F.col("at") + len(m) <= n,
            F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + i) for i, c in enumerate(m) if c == "1"]),
        )
        for m in masks
    ]
    placed = rows.select("*", at.alias("at"))
    return placed.select("*", F.posexplode(F.array(*keys)).alias("mask", "key")).filter(F.col("key").isNotNull())


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later steps read instead of working it out again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    window: int = 13,
    similarity: float = 0.8,
    min_words: int = 5,
    sent_seeds: int = 2_000_000,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, start, window, matched``: the best verified stretch of each document and item.

    ``start`` counts words of the document; the first of equally good stretches is given.
    """
    items = _hashed(benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("t")), "t")
    items = items.filter(F.size("h") >= min_words).select("item_id", "h")
    texts = items.groupBy("h").agg(F.min("item_id").alias("first"))
    least = min(map(len, masks))
    short = texts.filter(F.size("h") < least).select(F.size("h").alias("n")).distinct().collect()
    whole = ["1" * r["n"] for r in short]
    seeds = _seeds(texts.filter(F.size("h") >= least), list(masks))
    if whole:
        # a mask for each length below the shortest window, for items of exactly that length
        length = F.element_at(F.array(*[F.lit(len(m)) for m in whole]), F.col("mask") + 1)
        brief = _seeds(texts.filter(F.size("h") < least), whole)
        seeds = seeds.unionByName(brief.filter(length == F.size("h")))
    seeds = seeds.select("key", "first", F.col("at").alias("q"), F.size("h").alias("words")).distinct()
    if seeds.count() <= sent_seeds:
        seeds = F.broadcast(seeds)
    rows = _hashed(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), "t").select("doc_id", "h")
    met = _seeds(rows, [*masks, *whole]).join(seeds, "key")
    # only the words that lie on the item leave the scan's stage, and once per diagonal
    d = F.col("at") - F.col("q")
    part = F.slice("h", F.greatest(d, F.lit(0)) + 1, F.col("words"))
    lines = met.select("doc_id", "first", d.alias("d"), part.alias("part"))
    lines = lines.groupBy("doc_id", "first", "d").agg(F.collect_set("part").alias("parts"))
    lines = lines.join(texts.withColumnRenamed("h", "ih"), "first").select(
        "doc_id", "first", "d", "ih", F.explode("parts").alias("part")
    )
    behind = F.least(F.col("d"), F.lit(0))
    agrees = F.transform(
        F.col("ih"), lambda w, j: F.when(F.get("part", j + behind) == w, F.lit("1")).otherwise(F.lit("0"))
    )
    lines = _once(lines, "agrees", F.array_join(agrees, "")).drop("ih", "part")
    width = F.least(F.lit(window), F.length("agrees"))
    stretches = F.transform(
        F.sequence(F.lit(0), F.length("agrees") - width),
        lambda s: F.struct(
            F.length(F.replace(F.substring(F.col("agrees"), s + 1, width), F.lit("0"), F.lit(""))).alias("matched"),
            (-s).alias("s"),
        ),
    )
    best = _once(lines, "b", F.array_max(stretches)).select(
        "doc_id", "first", width.alias("window"), F.struct("b.matched", (F.col("b.s") - F.col("d")).alias("s")).alias("b")
    )
    best = best.filter(F.col("b.matched") >= F.lit(similarity) * F.col("window"))
    best = best.groupBy("doc_id", "first", "window").agg(F.max("b").alias("b"))
    named = items.join(texts, "h").select("item_id", "first")
    return best.join(named, "first").select(
        "doc_id",
        "item_id",
        (-F.col("b.s")).cast("long").alias("start"),
        F.col("window").cast("long").alias("window"),
        F.col("b.matched").cast("long").alias("matched"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document overlaps no item."""
    found = overlaps(docs, benchmark, key=key, **options).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["_found"]), "left_anti")


def oracle(masks: tuple[str, ...] = MASKS, window: int = 13, similarity: float = 0.8, min_words: int = 5) -> str:
    """The same as SQL, on words instead of their hashes."""
    least = min(map(len, masks))

    def seeds(table: str, name: str) -> str:
        parts = []
        for m in masks:
            word = " || ' ' || ".join(f"h[p + {i + 1}]" for i, c in enumerate(m) if c == "1")
            places = f"range(0, greatest(0, len(h) - {len(m) - 1}))"
            parts.append(
                f"SELECT {name}, '{m}' AS m, unnest({places}) AS p, unnest(list_transform({places}, lambda p: {word})) AS k "
                f"FROM {table}"
            )
        return " UNION ALL ".join(parts)

    return rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS h FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS h FROM benchmark),
iu AS (SELECT * FROM iw WHERE len(h) >= {min_words}),
sizes AS (SELECT DISTINCT len(h) AS n FROM iu WHERE len(h) < {least}),
dplaces AS (SELECT doc_id, h, n, unnest(range(0, greatest(0, len(h) - n + 1))) AS p FROM dw, sizes),
dseeds AS ({seeds("dw", "doc_id")}
  UNION ALL SELECT doc_id, n::VARCHAR, p, array_to_string(h[p + 1 : p + n], ' ') FROM dplaces),
iseeds AS ({seeds(f"(SELECT * FROM iu WHERE len(h) >= {least})", "item_id")}
  UNION ALL SELECT item_id, len(h)::VARCHAR, 0, array_to_string(h, ' ') FROM iu WHERE len(h) < {least}),
lines AS (SELECT DISTINCT doc_id, item_id, d.p - i.p AS d FROM dseeds d JOIN iseeds i USING (m, k)),
agreed AS (
  SELECT doc_id, item_id, d, least({window}, len(iu.h)) AS w, len(iu.h) AS n,
    list_transform(range(0, len(iu.h)),
      lambda j: CASE WHEN d + j >= 0 AND dw.h[d + j + 1] = iu.h[j + 1] THEN 1 ELSE 0 END) AS a
  FROM lines JOIN dw USING (doc_id) JOIN iu USING (item_id)),
stretches AS (SELECT *, unnest(range(0, n - w + 1)) AS s FROM agreed),
counted AS (SELECT doc_id, item_id, w, d + s AS start, list_sum(a[s + 1 : s + w]) AS matched FROM stretches)
SELECT doc_id, item_id, start::BIGINT AS start, w::BIGINT AS window, matched::BIGINT AS matched
FROM counted WHERE matched >= {similarity} * w
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""
