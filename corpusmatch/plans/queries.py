"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmatch import schemas
from corpusmatch.functions import text as tx, vectors as vx
from corpusmatch.operators import embed, extract as ex, hits as ht, lookups, standing, upserts
from corpusmatch.operators.keyword import keyword_pairs, keyword_scan
from corpusmatch.operators.semantic import semantic_match, semantic_topk
from corpusmatch.operators.storage import new_folder, staging, written
from corpusmatch.plans import ingest as plan
from corpusmatch.plans.roles import Corpus
from corpusmatch.sources import catalog, files as fs, lines as ls
from corpusmatch.sources.tables import Tables

TOPK, MIN_COS = 50, 0.1
_HIT = ["pattern_id", "pattern_name", "symbol_id", "repo_id", "match_kind", "reason", "snippet_hash"]

QUERIES = {}


def query(function):
    """Register under the function's name (without a final underscore, which only avoids a clash here)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Corpus(spark, sf_dir))

    QUERIES[function.__name__.rstrip("_")] = run
    return run


def _hash(c):
    return F.sha2(c, 256)


# --- matching -----------------------------------------------------------------------------------


@query
def semantic_topk_(c: Corpus) -> DataFrame:
    best = semantic_topk(c.vector_symbols(), c.label_patterns(), TOPK, MIN_COS)
    return best.withColumn("score", F.round("score", 6))


@query
def semantic_match_(c: Corpus) -> DataFrame:
    found = semantic_match(c.vector_symbols(), c.label_patterns(), TOPK, MIN_COS, snippet_chars=tx.SNIPPET_CHARS)
    return found.select(*_HIT, F.round("score", 6).alias("score"))


@query
def semantic_standing(c: Corpus) -> DataFrame:
    """The top k after two replacements: repositories of an older state with other vectors, and one that was not there."""
    vectors, patterns = c.vector_symbols().select("symbol_id", "repo_id", "embedding"), c.label_patterns()
    repo = F.pmod(F.xxhash64("repo_id"), F.lit(3))
    older = vectors.filter(repo != 0).withColumn("embedding", F.when(repo == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    state = standing.build(older, patterns, TOPK, MIN_COS, spare=10)
    for turn, now in ((1, vectors.filter(repo != 0)), (0, vectors)):
        fresh = vectors.filter(repo == turn)
        state, _ = standing.replace(state, fresh.select("repo_id"), fresh, now, patterns, TOPK, MIN_COS, spare=10)
    return state.best(TOPK).withColumn("score", F.round("score", 6))


@query
def semantic_hashed(c: Corpus) -> DataFrame:
    """Benchmark items against documents by the vectors of the default encoder."""
    encoder = embed.hashed_bag_of_words()
    symbols = embed.embed_texts(c.doc_symbols().drop("embedding"), "source", encoder)
    patterns = embed.embed_texts(c.item_patterns(), "description", encoder)
    best = semantic_topk(symbols, patterns, TOPK, 0.45)
    return best.withColumn("score", F.round("score", 6))


@query
def cosine_pairs(c: Corpus) -> DataFrame:
    """Every vector against the first of its label, and against one that is too short."""
    firsts = c.label_patterns().select(F.col("pattern_id").alias("label"), F.col("embedding").alias("first"))
    pairs = c.table("embeddings").join(firsts, "label")
    short = F.slice("first", 1, 63)
    return pairs.select(
        "vec_id",
        "label",
        F.round(vx.cosine(F.col("embedding"), F.col("first")), 6).alias("score"),
        vx.cosine(F.col("embedding"), short).alias("misfit"),
    )


@query
def keyword_scan_(c: Corpus) -> DataFrame:
    return keyword_scan(c.doc_symbols(), c.item_patterns()).select(*_HIT)


@query
def keyword_contains(c: Corpus) -> DataFrame:
    """Plain substring predicate: does a document contain a fragment, or the name of its source, ignoring case?"""
    text = tx.keyword_text(F.col("name"), F.col("docstring"))
    return c.doc_symbols().select(
        "symbol_id",
        tx.contains_keyword(text, F.lit("TION")).alias("has_tion"),
        tx.contains_keyword(text, F.col("repo_id")).alias("has_source"),
        tx.contains_keyword(text, F.lit("")).alias("has_nothing"),
    )


@query
def wholeword_gate(c: Corpus) -> DataFrame:
    text = tx.keyword_text(F.col("name"), F.col("docstring"))
    # each text is folded and taken apart once, however many patterns it meets
    checked = tx.folded(tx.gate_text(F.col("name"), F.col("docstring"), F.col("source")))
    symbols = c.doc_symbols().select("symbol_id", "name", "docstring", checked.alias("checked"))
    symbols = symbols.withColumn("own_words", tx.words_of(F.col("checked")))
    pairs = keyword_pairs(symbols, c.item_patterns(), text).select("pattern_id", "symbol_id", "checked", "own_words")
    gated = pairs.join(c.item_patterns().select("pattern_id", "indicators"), "pattern_id")
    checked, words = F.col("checked"), F.col("own_words")
    return gated.select(
        "pattern_id",
        "symbol_id",
        tx.has_whole_word(checked, F.col("indicators"), words).alias("passes"),
        tx.has_whole_word(checked, F.array().cast("array<string>"), words).alias("passes_empty"),
        tx.has_whole_word(checked, F.array(F.lit(" ")), words).alias("passes_blank"),
    )


# --- hit table ----------------------------------------------------------------------------------


@query
def hits_dedup(c: Corpus) -> DataFrame:
    """Keyword hits of two runs with ids of their own, as a stored table."""
    found = keyword_scan(c.doc_symbols(), c.item_patterns())
    number = F.concat(
        F.lpad(F.col("symbol_id").cast("string"), 19, "0"), F.lit("-"), F.lpad(F.col("pattern_id").cast("string"), 19, "0")
    )
    runs = [found.withColumn("id", F.concat(F.lit(f"{run}-"), number)) for run in (0, 1)]
    with staging(c.spark) as folder:
        stored = written(runs[0].unionByName(runs[1]), "hits", folder)
        return written(ht.dedup_hits(stored, "id").select("id", *_HIT), "deduplicated")


@query
def insert_ignore(c: Corpus) -> DataFrame:
    keyword = keyword_scan(c.doc_symbols(), c.item_patterns())
    semantic = semantic_match(c.vector_symbols(), c.label_patterns(), TOPK, MIN_COS, snippet_chars=tx.SNIPPET_CHARS)
    existing = keyword.filter(F.col("pattern_id") < 5).withColumn("reason", F.lit("kept"))
    return ht.insert_ignore(existing, keyword, semantic).select(*_HIT)


@query
def hash_backfill(c: Corpus) -> DataFrame:
    i = F.col("doc_id")
    old = c.table("documents").select(
        i,
        F.when(i % 11 != 0, F.col("text")).alias("code_snippet"),
        F.when(i % 3 == 1, "").when(i % 3 == 2, "given").alias("snippet_hash"),
    )
    return ht.backfill_hash(old).select("doc_id", "snippet_hash")


@query
def hits_enriched(c: Corpus) -> DataFrame:
    found = keyword_scan(c.doc_symbols(), c.item_patterns())
    ht.create_enriched_view(found, c.repositories())
    return c.spark.table("pattern_hits_enriched").select(*_HIT, "repo_name", "repo_url")


@query
def cascade_delete(c: Corpus) -> DataFrame:
    """What is left of hits, symbols and files after two repositories are deleted."""
    symbols = c.line_symbols().select("symbol_id", "file_id")
    files = c.doc_files().select("file_id", "repo_id")
    hits = symbols.select(F.col("file_id").alias("pattern_id"), "symbol_id")
    gone = c.table("documents").select(F.col("source").alias("repo_id")).filter(F.col("repo_id").isin("src1", "src2"))
    left = ht.cascade_delete(hits, symbols, files, gone)
    keys = [left[0].select("symbol_id"), left[1].select("symbol_id"), left[2].select(F.col("file_id").cast("string"))]
    named = [k.toDF("key").withColumn("kept", F.lit(n)) for n, k in zip(("hit", "symbol", "file"), keys)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- text functions -----------------------------------------------------------------------------


@query
def snippet_hash(c: Corpus) -> DataFrame:
    head = tx.first_chars(F.col("text"), tx.SNIPPET_CHARS)
    return c.table("documents").select(
        "doc_id",
        tx.text_hash(head).alias("head_hash"),
        F.length(head).alias("head_chars"),
        tx.text_hash(F.col("text")).alias("full_hash"),
        tx.text_hash(F.lit(None).cast("string")).alias("null_hash"),
    )


@query
def symbol_text(c: Corpus) -> DataFrame:
    """Document symbols, every other one without docstring, every third without kind."""
    i = F.col("symbol_id")
    text = tx.symbol_text(
        F.col("name"), F.when(i % 3 != 0, F.col("kind")), F.when(i % 2 == 0, F.col("docstring")), F.col("source"),
        tx.MAX_BODY_CHARS,
    )
    return c.doc_symbols().select("symbol_id", F.length(text).alias("chars"), _hash(text).alias("hash"))


@query
def pattern_text(c: Corpus) -> DataFrame:
    rows = catalog.catalog_from_sheet(c.sheet(), "item_id")
    cols = [F.col(n) for n in ("name", "description", "motivation", "solution")]
    return rows.select(
        "name", tx.pattern_text(*cols).alias("text"), tx.pattern_load_text(*cols).alias("load_text")
    )


@query
def clean_name(c: Corpus) -> DataFrame:
    raw = F.concat(F.lit("\u00a0"), F.substring("text", 1, 30), F.lit("  [ 7b]\t (12 ) [x1] "), "item_id")
    return c.table("benchmark").select("item_id", tx.clean_pattern_name(raw).alias("name"))


@query
def repo_name(c: Corpus) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".git//").otherwise(".github.git"))
    return c.table("pages").select("page_id", tx.repo_name(url).alias("name"))


@query
def list_lines(c: Corpus) -> DataFrame:
    """Document lines, some made comments, some padded with odd white space."""
    pos, line = F.col("ordinal"), F.col("source")
    raw = (
        F.when(pos % 5 == 0, F.concat(F.lit("\t # "), line))
        .when(pos % 7 == 0, F.concat(F.lit("\u3000\u00a0"), line, F.lit(" \r")))
        .otherwise(line)
    )
    entries = ls.list_entries(c.line_symbols().select("file_id", "ordinal", raw.alias("line")), "line")
    return entries.select("file_id", "ordinal", F.length("line").alias("chars"), _hash(F.col("line")).alias("hash"))


@query
def line_slice(c: Corpus) -> DataFrame:
    first = F.when(F.col("doc_id") % 6 != 5, (F.col("doc_id") % 6).cast("int"))
    last = (first + F.col("doc_id") % 9 - 1).cast("int")
    cut = tx.line_slice(F.concat("text", F.lit("\n")), first, last)
    return c.table("documents").select("doc_id", F.length(cut).alias("chars"), _hash(cut).alias("hash"))


@query
def min_len_gate(c: Corpus) -> DataFrame:
    """Lines and whole documents that reach the minimum length."""
    lines = c.line_symbols().select(F.col("symbol_id").alias("id"), F.lit(None).cast("string").alias("doc"), "source")
    docs = c.table("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("doc"), F.col("text").alias("source"))
    both = lines.unionByName(docs).filter(tx.long_enough(F.col("doc"), F.col("source"), tx.MIN_EMBED_CHARS))
    return both.select("id", F.length("source").alias("chars"))


@query
def json_indicators(c: Corpus) -> DataFrame:
    """Encoded indicator lists; objects are no list, nor is broken or missing JSON."""
    i = F.col("pattern_id")
    encoded = F.to_json("indicators")
    damaged = F.when(i % 5 == 1, "").when(i % 5 == 2, F.concat(F.lit("["), encoded)).when(i % 5 != 3, encoded)
    lists = c.item_patterns().select(F.concat(F.lit("item"), "pattern_id").alias("key"), damaged.alias("json"))
    objects = c.table("events").select(F.concat(F.lit("event"), "event_id").alias("key"), F.col("props").alias("json"))
    words = tx.json_strings(F.col("json"))
    return lists.unionByName(objects).select(
        "key", F.size(words).alias("n"), F.array_join(words, "|").alias("words")
    )


# --- files --------------------------------------------------------------------------------------


@query
def detect_lang(c: Corpus) -> DataFrame:
    odd = F.element_at(
        F.array(*map(F.lit, [".py", "a.PY", "..py", "x.tar.json", "readme.md", "README.md", "Dockerfile.txt", "a.", ".json"])),
        (F.col("page_id") % 9 + 1).cast("int"),
    )
    path = F.concat("url", F.lit("/"), odd)
    pages = c.table("pages").select(path.alias("path"), tx.detect_lang(path).alias("lang"))
    docs = c.doc_files().select(F.col("rel_path").alias("path"), tx.detect_lang(F.col("rel_path")).alias("lang"))
    return pages.unionByName(docs)


@query
def path_filter(c: Corpus) -> DataFrame:
    paths = c.doc_contents().select(tx.relative_path(F.col("path"), F.col("root")).alias("rel_path"))
    return paths.filter(tx.outside_git_dir(F.col("rel_path")))


@query
def sha256_files(c: Corpus) -> DataFrame:
    return c.doc_contents().select("path", F.sha2("content", 256).alias("sha256"))


@query
def decode_text(c: Corpus) -> DataFrame:
    """Document bytes with invalid bytes, mixed line ends and a real replacement character added."""
    dirty = F.concat(
        F.unhex(F.lit("C328FF")), "content", F.unhex(F.lit("0D0A")), F.lit("a\ufffdb\r").cast("binary"), F.unhex(F.lit("E282"))
    )
    text = tx.decode_utf8(dirty)
    return c.doc_contents().select("file_id", F.length(text).alias("chars"), _hash(text).alias("hash"))


@query
def files_index(c: Corpus) -> DataFrame:
    contents = c.doc_contents().filter(tx.outside_git_dir(tx.relative_path(F.col("path"), F.col("root"))))
    rows = contents.withColumn("rel_path", tx.relative_path(F.col("path"), F.col("root"))).drop("root", "file_id")
    indexed = fs.index_files(fs.known_files(rows))
    return schemas.conform(indexed, schemas.FILES).drop("file_id")


@query
def read_tree(c: Corpus) -> DataFrame:
    """The documents written as files below a folder per source, listed and read back."""
    folder = new_folder(c.spark)
    files = c.doc_contents().select(F.concat(F.lit(folder), "path").alias("path"), "content")
    files.mapInArrow(fs.write_files, "path string").count()
    roots = c.table("documents").select("source").distinct().select(
        F.col("source").alias("repo_id"), F.concat(F.lit(f"{folder}/corpus/"), "source").alias("root")
    )
    indexed = fs.index_files(fs.read_tree(roots))
    return indexed.select("repo_id", "rel_path", "lang", "sha256")


# --- extraction ---------------------------------------------------------------------------------

_SYMBOL = ["file_id", "ordinal", "kind", "name", "lineno", "end_lineno", "signature", "docstring", "parent_name"]


def _symbols(files: DataFrame) -> DataFrame:
    return ex.symbols_of(ex.extract(files)).select(*_SYMBOL, _hash(F.col("source")).alias("source_hash"))


@query
def symbols_index(c: Corpus) -> DataFrame:
    """All languages dispatched: whole-file symbols come from the documents, the rest from generated files."""
    docs = fs.known_files(c.doc_files()).withColumn("file_id", F.concat(F.lit("doc"), "file_id"))
    parts = c.part_sources().withColumn("file_id", F.concat(F.lit("part"), "file_id"))
    chats = c.turn_notebooks().withColumn("file_id", F.concat(F.lit("chat"), "file_id"))
    extracted = ex.extract(docs.unionByName(parts).unionByName(chats))
    return ex.symbols_of(extracted).groupBy("file_id", "repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def whole_file_symbols(c: Corpus) -> DataFrame:
    return _symbols(fs.known_files(c.doc_files()))


@query
def py_symbols(c: Corpus) -> DataFrame:
    return _symbols(c.part_sources())


@query
def notebook_cells(c: Corpus) -> DataFrame:
    return _symbols(c.turn_notebooks())


@query
def extract_errors(c: Corpus) -> DataFrame:
    errors = ex.errors_of(ex.extract(c.part_sources()))
    return errors.select("file_id", "repo_id", "rel_path", F.substring_index("error", ":", 1).alias("error"))


# --- lookups ------------------------------------------------------------------------------------


@query
def symbols_files_join(c: Corpus) -> DataFrame:
    joined = lookups.symbols_with_repo(c.line_symbols(), c.doc_files())
    return joined.select("symbol_id", "file_id", "repo_id", "ordinal")


@query
def symbols_of_repo(c: Corpus) -> DataFrame:
    return lookups.symbols_with_repo(c.line_symbols(), c.doc_files(), "src3").select("symbol_id", "file_id", "repo_id")


def _asked(c: Corpus) -> DataFrame:
    """One line of the labelled documents, and one that does not exist."""
    ids = c.table("labels")
    real = ids.select(F.concat("doc_id", F.lit(":0")).alias("symbol_id"))
    return real.unionByName(ids.select(F.concat("doc_id", F.lit(":none")).alias("symbol_id")))


@query
def repo_of_symbol(c: Corpus) -> DataFrame:
    return lookups.repo_of_symbols(_asked(c), c.line_symbols(), c.doc_files(), c.repositories())


@query
def repo_of_symbol_missing(c: Corpus) -> DataFrame:
    return lookups.symbols_without_repo(_asked(c), c.line_symbols(), c.doc_files(), c.repositories())


# --- vectors and embedding ----------------------------------------------------------------------


@query
def l2_normalize(c: Corpus) -> DataFrame:
    factor = (F.col("vec_id") % 5).cast("float")
    scaled = F.transform("embedding", lambda x: x * factor)
    unit = F.col("unit")
    return c.table("embeddings").select("vec_id", vx.l2_normalize(scaled).alias("unit")).select(
        "vec_id",
        F.round(unit[0].cast("double"), 5).alias("first"),
        F.round(unit[63].cast("double"), 5).alias("last"),
        F.round(vx.cosine(unit, unit), 5).alias("length"),
    )


@query
def json_vectors(c: Corpus) -> DataFrame:
    """Vectors written as JSON text and read back; missing and broken ones are skipped."""
    i = F.col("vec_id")
    written = vx.to_json_text(F.col("embedding"))
    text = F.when(i % 10 == 1, "").when(i % 10 == 2, F.concat(F.lit("{"), written)).when(i % 10 != 3, written)
    decoded = c.table("embeddings").select(i, "embedding", vx.from_json_text(text).alias("decoded"))
    return decoded.filter(F.col("decoded").isNotNull()).select(
        "vec_id", F.size("decoded").alias("dim"), (F.col("decoded") == F.col("embedding")).alias("same")
    )


@query
def embed_hashed(c: Corpus) -> DataFrame:
    """The non-zero weights of every document's vector."""
    embedded = embed.embed_texts(c.table("documents"), "text", embed.hashed_bag_of_words())
    weights = embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return weights.filter(F.col("weight") != 0).select(
        "doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query
def cache_hits(c: Corpus) -> DataFrame:
    found = embed.cache_hits(c.symbol_texts(), c.old_cache())
    return found.select("text_hash", F.col("embedding")[0].cast("int").alias("mark"))


@query
def cache_misses(c: Corpus) -> DataFrame:
    missing = embed.cache_misses(c.symbol_texts(), c.old_cache())
    return missing.select("text_hash", F.length("text").alias("chars"))


@query
def cache_merge(c: Corpus) -> DataFrame:
    new = c.symbol_texts().filter(F.col("symbol_id") % 3 == 0).groupBy("text_hash").agg(
        F.array((-F.max("symbol_id")).cast("float")).alias("embedding")
    )
    merged = embed.cache_merge(c.old_cache(), new)
    return merged.select("text_hash", F.col("embedding")[0].cast("int").alias("mark"))


@query
def embed_attach(c: Corpus) -> DataFrame:
    attached = embed.attach_embeddings(embed.with_embedding_text(c.doc_symbols(), tx.MIN_EMBED_CHARS, tx.MAX_BODY_CHARS), c.old_cache())
    return attached.select("symbol_id", F.col("embedding")[0].cast("int").alias("mark"))


@query
def embed_coverage(c: Corpus) -> DataFrame:
    return embed.embed_coverage(c.symbol_texts(), c.old_cache())


@query
def embed_incremental(c: Corpus) -> DataFrame:
    """Document symbols embedded on top of a cache; old texts keep the cached vector."""
    symbols = c.doc_symbols()
    vectors, fresh = embed.embed_incremental(
        symbols, c.old_cache(), embed.hashed_bag_of_words(), tx.MIN_EMBED_CHARS, max_body=tx.MAX_BODY_CHARS
    )
    new = fresh.select("text_hash", F.lit(True).alias("is_new"))
    done = embed.update_embeddings(symbols, vectors).select("symbol_id", "embedding")
    used = vectors.select("symbol_id", "text_hash").join(new, "text_hash", "left")
    return done.join(used, "symbol_id", "left").select(
        "symbol_id",
        "text_hash",
        F.coalesce("is_new", F.lit(False)).alias("is_new"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("nonzero"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("largest"),
    )


# --- catalogue, upserts, lists ------------------------------------------------------------------


@query
def pattern_catalog(c: Corpus) -> DataFrame:
    rows = catalog.catalog_from_sheet(c.sheet(), "item_id")
    return rows.drop("pattern_id", "indicators", "embedding")


@query
def catalog_file(c: Corpus) -> DataFrame:
    """All documents written as a sheet, two rows to a name, and loaded from there as a catalogue."""
    path = f"{new_folder(c.spark)}/sheet"
    sheet = c.table("documents").orderBy("doc_id").select(
        F.concat(F.lit("Doc "), F.floor(F.col("doc_id") / 2).cast("string")).alias("Pattern Name"),
        F.col("text").alias("Description"),
        F.col("source").alias("Link"),
        F.col("doc_id").cast("string").alias("Comments"),
    )
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    sheet.write.options(**options).csv(path)
    return catalog.load_patterns(c.spark, path).select(
        "name", F.sha2("description", 256).alias("description_hash"), "link", "comments"
    )


@query
def upsert_patterns(c: Corpus) -> DataFrame:
    """The catalogue of the even items, updated by that of all items from the tenth on."""

    def part(condition):
        return catalog.catalog_from_sheet(c.sheet().filter(condition), "item_id").drop("indicators", "embedding")

    old = part("item_id % 2 = 0").withColumn("pattern_id", F.concat(F.lit("old "), "name"))
    new = part("item_id >= 10").withColumn("pattern_id", F.concat(F.lit("new "), "name")).withColumn("pos", F.lit(1))
    return upserts.upsert_patterns(old, new).select("pattern_id", "name", "description", "motivation", "link", "sub_category")


@query
def upsert_repos(c: Corpus) -> DataFrame:
    """Hosts as repositories: known ones from the even pages, then one insert per odd page."""
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    rows = c.table("pages").select(
        host.alias("url"),
        F.concat(F.lit("r"), "page_id").alias("repo_id"),
        F.concat(F.lit("name"), "page_id").alias("name"),
        F.concat(F.lit("/repos/"), "page_id").alias("local_path"),
        F.when(F.col("page_id") % 4 != 3, "main").alias("default_branch"),
        F.timestamp_seconds(F.col("page_id")).alias("last_sync_ts"),
        F.col("page_id").alias("pos"),
    )
    old = upserts.last_per_key(rows.filter("pos % 2 = 0"), "url", "pos").drop("pos")
    merged = upserts.upsert_repos(old, rows.filter("pos % 2 = 1"))
    return merged.withColumn("last_sync_ts", F.unix_timestamp("last_sync_ts"))


@query
def collect_urls(c: Corpus) -> DataFrame:
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    entries = c.table("pages").select(
        host.alias("url"),
        (F.col("page_id") % 3).cast("int").alias("source_rank"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("page_id").alias("pos"),
    )
    return ls.first_occurrences(entries).select("url", "source_rank", "pos")


@query
def replace_by_repo(c: Corpus) -> DataFrame:
    """Index all documents, then again for three repositories: one changed, one emptied, one new."""
    tables = Tables(c.spark, new_folder(c.spark))
    rows = c.doc_files().withColumn("file_id", F.col("file_id").cast("string"))
    batch = c.table("documents").select(F.col("source").alias("repo_id")).distinct()
    tables.replace("files", rows.filter("repo_id <> 'src4'"), batch, schemas.FILES, "repo_id")
    again = rows.filter("repo_id in ('src4', 'src5')").withColumn("rel_path", F.concat(F.lit("new/"), "rel_path"))
    tables.replace("files", again, batch.filter("repo_id in ('src4', 'src5', 'src6')"), schemas.FILES, "repo_id")
    return tables.read("files", schemas.FILES).select("file_id", "repo_id", "rel_path")


@query
def ingest_e2e(c: Corpus) -> DataFrame:
    """Documents, generated sources and notebooks through the whole ingest; what the store then holds."""
    store = _ingested(c)
    files = store.files().select("repo_id", F.concat(F.lit("file "), "lang").alias("what"))
    symbols = store.symbols().select("repo_id", F.concat(F.lit("symbol "), "kind").alias("what"))
    vectors = store.vectors().select("repo_id", F.lit("vector").alias("what"))
    # documents under code names are no code: only the generated repositories have foreseeable errors
    errors = store.extract_errors().filter(F.col("rel_path").startswith("parts/")).select(
        "repo_id", F.lit("error").alias("what")
    )
    urls = store.repos().select(F.col("repo_id"), F.lit("repo").alias("what"))
    found = files.unionByName(symbols).unionByName(vectors).unionByName(errors).unionByName(urls)
    names = store.repos().select("repo_id", F.col("name").alias("repo"))
    return found.join(names, "repo_id").groupBy("repo", "what").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_semantic_hits(c: Corpus) -> DataFrame:
    """The semantic hits of the same ingest, enriched by their repository."""
    enriched = _ingested(c).hits_enriched().filter(F.col("match_kind") == "semantic")
    return enriched.select("pattern_name", "repo_name", "repo_url", "reason", "snippet_hash")


def _ingested(c: Corpus) -> plan.Store:
    def url(name):
        return F.concat(F.lit("https://git.example.org/"), name, F.lit(".git"))

    store = plan.Store(c.spark, new_folder(c.spark))
    encoder = embed.hashed_bag_of_words()
    items = c.item_patterns().withColumn("pattern_id", schemas.key_of(F.col("name")))
    empty = F.lit("")
    described = items.withColumns({n: empty for n in ("motivation", "solution")})
    plan.save_patterns(store, schemas.conform(described, schemas.PATTERNS), encoder)

    cols = ["repo_id", "rel_path", "text"]
    everything = (
        c.doc_files().select(*cols)
        .unionByName(c.part_sources().select(*cols))
        .unionByName(c.turn_notebooks().select(*cols))
    )
    contents = fs.known_files(everything.filter(tx.outside_git_dir(F.col("rel_path")))).select(
        schemas.key_of(url("repo_id")).alias("repo_id"),
        F.col("rel_path").alias("path"),
        "rel_path",
        "lang",
        F.col("text").cast("binary").alias("content"),
    )
    repos = everything.select(url("repo_id").alias("url")).distinct().select(
        "url", F.lit("/none").alias("local_path"), F.lit("main").alias("default_branch")
    )
    limits = plan.Limits(tx.MIN_EMBED_CHARS, tx.MAX_BODY_CHARS, tx.SNIPPET_CHARS)
    plan.ingest(store, repos, encoder, TOPK, 0.45, read=lambda *_: contents, limits=limits)
    return store
