"""From repositories and a catalogue to hits: the steps in order, each a Spark job over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpusmatch import schemas
from corpusmatch.functions import text as tx
from corpusmatch.operators.embed import Encoder, embed_incremental
from corpusmatch.operators.extract import errors_of, extract, symbols_of
from corpusmatch.operators.hits import HIT_KEY, attach_snippets, backfill_hash, enrich_hits, insert_ignore
from corpusmatch.operators.keyword import keyword_scan
from corpusmatch.operators.semantic import semantic_match
from corpusmatch.operators.skew import keep_first
from corpusmatch.operators.storage import small_batches, staging, written
from corpusmatch.operators import standing
from corpusmatch.operators.upserts import upsert_patterns, upsert_repos
from corpusmatch.sources.catalog import embed_catalog, load_patterns
from corpusmatch.sources.files import index_files, read_tree
from corpusmatch.sources.lines import collect_urls
from corpusmatch.sources.tables import Tables, bucket_of

CACHE_BUCKETS = 256
# Goes up when extraction gives other symbols for the same bytes; files are parsed again then.
EXTRACTION = "1"
# Files (two digests each) that are sent to all tasks to tell which have changed; more are joined by key.
SENT_FILES = 200_000


@dataclass(frozen=True)
class Limits:
    """What is passed over or cut. Nothing by default; the values of the original tool are 120, 1500 and 8000."""

    min_chars: int = 0
    max_body: int | None = None
    snippet_chars: int | None = None


class Store(Tables):
    """The tables of a corpus."""

    def repos(self) -> DataFrame:
        return self.read("repos", schemas.REPOS)

    def patterns(self) -> DataFrame:
        return self.read("patterns", schemas.PATTERNS)

    def cache(self, encoder: str = "default", hashes: DataFrame | None = None) -> DataFrame:
        """Cached vectors of an encoder; with ``hashes`` only the buckets that these can be in."""
        only = None if hashes is None else [r["b"] for r in hashes.select(_cache_bucket().alias("b")).distinct().collect()]
        rows = self.read("embeddings_cache", schemas.STORED_CACHE, only).filter(F.col("encoder") == encoder)
        return rows.select("text_hash", "embedding")

    def files(self) -> DataFrame:
        return self.read("files", schemas.FILES)

    def extract_errors(self) -> DataFrame:
        return errors_of(self.read("files", schemas.INDEXED_FILES))

    def symbols(self, repos: DataFrame | None = None) -> DataFrame:
        return self._of("symbols", schemas.SYMBOLS, repos)

    def vectors(self, repos: DataFrame | None = None) -> DataFrame:
        return self._of("symbol_vectors", schemas.SYMBOL_VECTORS, repos)

    def hits(self, repos: DataFrame | None = None) -> DataFrame:
        return self._of("pattern_hits", schemas.HITS, repos)

    def _of(self, name: str, schema: StructType, repos: DataFrame | None) -> DataFrame:
        """A table by repository; only the buckets and rows of ``repos``, where they are given."""
        if repos is None:
            return self.read(name, schema)
        ids = repos.select("repo_id").distinct()
        buckets = [r["b"] for r in ids.select(bucket_of(F.col("repo_id"), self.buckets).alias("b")).distinct().collect()]
        return self.read(name, schema, buckets).join(ids, "repo_id", "left_semi")

    def standing(self) -> standing.Standing:
        return standing.Standing(self.read("reserve", schemas.RESERVE), self.read("floors", schemas.FLOORS))

    def hits_enriched(self) -> DataFrame:
        return enrich_hits(self.hits(), self.repos())


def _cache_bucket() -> Column:
    return F.conv(F.substring("text_hash", 1, 2), 16, 10).cast("int")


def encoder_name(encoder: Encoder) -> str:
    """An encoder may say its name; vectors of different names are kept apart."""
    return getattr(encoder, "name", "default")


def save_patterns(store: Store, patterns: DataFrame, encoder: Encoder | None = None) -> None:
    """Upsert the catalogue by name; names it no longer has stay.

    With an encoder every stored pattern gets its vector, those that stay as well: their old one may be missing or
    come from another encoder.
    """
    merged = upsert_patterns(store.patterns(), patterns.withColumn("pos", F.lit(0)))
    store.overwrite("patterns", merged if encoder is None else embed_catalog(merged, encoder), schemas.PATTERNS)


def embed_all_patterns(store: Store, encoder: Encoder) -> None:
    store.overwrite("patterns", embed_catalog(store.patterns(), encoder), schemas.PATTERNS)


def save_repos(store: Store, repos: DataFrame) -> None:
    """Upsert repositories (``url, local_path, default_branch``) by URL, with the time of this run."""
    new = repos.select(
        schemas.key_of(F.col("url")).alias("repo_id"),
        "url",
        tx.repo_name(F.col("url")).alias("name"),
        "local_path",
        "default_branch",
        F.current_timestamp().alias("last_sync_ts"),
        F.lit(0).alias("pos"),
    )
    store.overwrite("repos", upsert_repos(store.repos(), new), schemas.REPOS)


def index_repositories(
    store: Store, contents: DataFrame, repos: DataFrame, encoder: Encoder, folder: str, limits: Limits = Limits()
) -> None:
    """Replace files, symbols and vectors of the repositories in ``repos`` by what ``contents`` holds.

    ``contents`` is (repo_id, path, rel_path, lang, content) with an optional ``read_error``. It is read
    once: what extraction made of it is written and serves all tables. A file that is stored with the same checksum
    and language is not parsed again; it keeps its symbols. One that could not be extracted is tried again.
    """
    if "read_error" not in contents.columns:
        contents = contents.withColumn("read_error", F.lit(None).cast("string"))
    known = _known_files(store, repos)
    files = index_files(contents)
    if known is None:
        files = files.withColumn("unchanged", F.lit(False))
    else:
        files = files.join(known, ["file_id", "sha256", "lang"], "left")
        files = files.withColumn("unchanged", F.col("unchanged").isNotNull())
        # without its text a file goes through extraction untouched
        files = files.withColumn("text", F.when(~F.col("unchanged"), F.col("text")))
    indexed = extract(files).withColumn("error", F.coalesce("read_error", "error"))
    indexed = indexed.withColumn("extraction", F.lit(EXTRACTION))
    with small_batches(store.spark):
        extracted = written(indexed, "extracted", folder)
    symbols = schemas.conform(symbols_of(extracted), schemas.SYMBOLS)
    if known is not None:
        again = store.symbols(repos).join(extracted.filter("unchanged").select("file_id"), "file_id")
        symbols = symbols.unionByName(schemas.conform(again, schemas.SYMBOLS))
        # the stored table that it comes from is replaced next
        symbols = written(symbols, "symbols", folder)
    store.replace("files", extracted, repos, schemas.INDEXED_FILES, "repo_id")
    store.replace("symbols", symbols, repos, schemas.SYMBOLS, "repo_id")

    name = encoder_name(encoder)
    vectors, fresh = embed_incremental(
        symbols, lambda texts: store.cache(name, texts), encoder, limits.min_chars, folder, limits.max_body
    )
    store.replace("symbol_vectors", vectors, repos, schemas.SYMBOL_VECTORS, "repo_id")
    store.append("embeddings_cache", fresh.withColumn("encoder", F.lit(name)), schemas.STORED_CACHE, _cache_bucket())


def _known_files(store: Store, repos: DataFrame) -> DataFrame | None:
    """``file_id, sha256, lang, unchanged`` of the stored files of ``repos`` that this extraction had no error with."""
    rows = store._of("files", schemas.INDEXED_FILES, repos).filter(F.col("extraction") == EXTRACTION)
    once = rows.groupBy("file_id").agg(
        F.min("sha256").alias("sha256"),
        F.min("lang").alias("lang"),
        (F.count(F.lit(1)) == 1).alias("unchanged"),
        F.max("error").alias("error"),
    )
    once = once.filter(F.col("unchanged") & F.col("error").isNull() & F.col("sha256").isNotNull()).drop("error")
    found = once.limit(SENT_FILES + 1).count()
    if not found:
        return None
    return F.broadcast(once) if found <= SENT_FILES else once


def catalog_digest(patterns: DataFrame) -> str:
    """Changes with what a keyword scan depends on: ids, names and indicators of the patterns."""
    row = F.xxhash64("pattern_id", "name", F.to_json("indicators")).cast("decimal(38,0)")
    found = patterns.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("s")).first()
    return f"{found['n']}:{found['s']}"


def match(
    store: Store,
    topk: int = 50,
    min_cos: float = 0.45,
    changed: DataFrame | None = None,
    accumulate: bool = False,
    folder: str | None = None,
    limits: Limits = Limits(),
) -> None:
    """Compute the hits of the store and replace the stored ones.

    The hits depend on the stored tables only, not on the order in which repositories came in: the
    semantic top k is always taken over all vectors. Given the repositories in ``changed``, only their texts are
    scanned for keywords if the catalogue is still the one that the stored hits were made with; the keyword hits of
    the others cannot differ then. Only their vectors are scored (``operators.standing``), and only repositories with other
    winners than before have their hits written again. With ``accumulate`` all stored hits of the others stay and win over
    new ones with the same key.
    """
    symbols, patterns = store.symbols(), store.patterns()
    digest, setting = catalog_digest(patterns), f"{topk} {min_cos!r} {limits.snippet_chars}"
    same = changed is not None and store.note("hits_catalog") == digest
    before = store.standing() if changed is not None and store.note("standing") == setting else None
    if before is None:
        state = standing.build(store.vectors(), patterns, topk, min_cos, topk, folder)
    else:
        batch = changed.select("repo_id").distinct()
        state, _ = standing.replace(
            before, batch, store.vectors(batch), store.vectors(), patterns, topk, min_cos, topk, folder
        )
    best = written(state.best(topk), "best", folder)
    with store.change():
        # hits that a batch has accumulated are no function of the stored tables: they go as a whole
        if same and before is not None and not accumulate and store.note("hits_are") == "computed":
            _match_affected(store, patterns, batch, written(before.best(topk), "best_before", folder), best, topk, folder, limits)
        else:
            _match_all(store, symbols, patterns, best, topk, changed, same, accumulate, folder, limits)
        store.overwrite("reserve", state.reserve, schemas.RESERVE)
        store.overwrite("floors", state.floors, schemas.FLOORS)
        store.set_note("hits_catalog", digest)
        store.set_note("standing", setting)
        store.set_note("hits_are", "accumulated" if accumulate else "computed")


def _match_affected(
    store: Store,
    patterns: DataFrame,
    batch: DataFrame,
    before: DataFrame,
    best: DataFrame,
    topk: int,
    folder: str | None,
    limits: Limits,
) -> None:
    """Hits of the repositories in ``batch`` and of those whose winners have changed; the others' stay as they are."""
    moved = before.subtract(best.select(*before.columns)).unionByName(best.select(*before.columns).subtract(before))
    affected = written(batch.unionByName(moved.select("repo_id")).distinct(), "affected", folder)
    symbols = store.symbols(affected)
    stored = backfill_hash(store.hits(affected)).join(batch, "repo_id", "left_anti").filter(F.col("match_kind") == "keyword")
    stored = written(schemas.conform(stored, schemas.HITS), "kept_hits", folder)
    semantic = semantic_match(
        symbols, patterns, topk, snippet_chars=limits.snippet_chars, winners=best.join(affected, "repo_id", "left_semi")
    )
    new = insert_ignore(None, keyword_scan(store.symbols(batch), patterns), semantic)
    new = new.join(stored.select(*HIT_KEY).distinct(), HIT_KEY, "left_anti")
    hits = schemas.conform(attach_snippets(new, symbols, limits.snippet_chars), schemas.HITS)
    store.replace("pattern_hits", hits.unionByName(stored), affected, schemas.HITS, "repo_id")


def _match_all(
    store: Store,
    symbols: DataFrame,
    patterns: DataFrame,
    best: DataFrame,
    topk: int,
    changed: DataFrame | None,
    same: bool,
    accumulate: bool,
    folder: str | None,
    limits: Limits,
) -> None:
    """All hits of the store."""
    existing, scanned = None, symbols
    if changed is not None and (same or accumulate):
        batch = changed.select("repo_id").distinct()
        others = backfill_hash(store.hits()).join(batch, "repo_id", "left_anti")
        kept = others if accumulate else others.filter(F.col("match_kind") == "keyword")
        existing = written(schemas.conform(kept, schemas.HITS), "kept_hits", folder)
        scanned = symbols.join(batch, "repo_id", "left_semi") if same else symbols
    keyword = keyword_scan(scanned, patterns)
    semantic = semantic_match(symbols, patterns, topk, snippet_chars=limits.snippet_chars, winners=best)
    new = insert_ignore(None, keyword, semantic)
    if existing is not None:
        new = new.join(existing.select(*HIT_KEY).distinct(), HIT_KEY, "left_anti")
    hits = schemas.conform(attach_snippets(new, symbols, limits.snippet_chars), schemas.HITS)
    store.overwrite("pattern_hits", hits if existing is None else hits.unionByName(existing), schemas.HITS, "repo_id")


def upkeep(store: Store) -> None:
    """Fill in missing snippet hashes of stored hits and keep the first hit of each key, by symbol."""
    hits = backfill_hash(store.hits())
    slim = keep_first(hits.drop("code_snippet"), HIT_KEY, F.col("symbol_id"), F.col("match_kind"))
    texts = hits.groupBy(*HIT_KEY).agg(F.first("code_snippet").alias("code_snippet"))
    same = [slim[c].eqNullSafe(texts[c]) for c in HIT_KEY]
    joined = slim.join(texts, same[0] & same[1] & same[2]).select(slim["*"], "code_snippet")
    store.overwrite("pattern_hits", joined, schemas.HITS, "repo_id")


def ingest(
    store: Store,
    repos: DataFrame,
    encoder: Encoder,
    topk: int = 50,
    min_cos: float = 0.45,
    accumulate: bool = False,
    read: Callable[[DataFrame, str], DataFrame] = read_tree,
    limits: Limits = Limits(),
) -> None:
    """Ingest repositories (``url, local_path, default_branch``) in one batch and recompute the hits.

    All tables change together, when everything has been written: a batch that breaks off leaves the store as it
    was, and is run again. ``accumulate`` keeps all hits of the other repositories.
    """
    with staging(store.spark) as folder, store.change():
        save_repos(store, repos)
        batch = repos.select(schemas.key_of(F.col("url")).alias("repo_id"), F.col("local_path").alias("root"))
        index_repositories(store, read(batch, folder), batch, encoder, folder, limits)
        match(store, topk, min_cos, batch, accumulate, folder, limits)


def listed_repositories(
    spark: SparkSession,
    arguments: Sequence[str],
    list_file: str | None = None,
    local_path: Callable[[Column], Column] = lambda url: url,
    default_branch: str = "main",
) -> DataFrame:
    """Repositories from entries, ``@file`` lists and a list file; ``local_path`` says where an entry's folder is.

    No entry at all is an error.
    """
    entries = collect_urls(spark, arguments, list_file)
    if entries.isEmpty():
        raise ValueError("there is no repository to ingest: no entry was given and the lists hold none")
    url = F.col("url")
    return entries.select("url", local_path(url).alias("local_path"), F.lit(default_branch).alias("default_branch"))


def run(
    spark: SparkSession,
    store_path: str,
    repos: DataFrame | Sequence[str],
    encoder: Encoder,
    catalog_path: str | None = None,
    topk: int = 50,
    min_cos: float = 0.45,
    limits: Limits = Limits(),
    list_file: str | None = None,
) -> DataFrame:
    """Load the catalogue (or use the stored one), ingest the repositories, return the enriched hits.

    ``repos`` is a table of them, or a list of entries as for ``listed_repositories``.
    """
    if not isinstance(repos, DataFrame):
        repos = listed_repositories(spark, repos, list_file)
    elif repos.isEmpty():
        raise ValueError("there is no repository to ingest: the table is empty")
    store = Store(spark, store_path)
    with store.change():
        if catalog_path:
            save_patterns(store, load_patterns(spark, catalog_path), encoder)
        else:
            embed_all_patterns(store, encoder)
        ingest(store, repos, encoder, topk, min_cos, limits=limits)
    return store.hits_enriched()
