"""The whole way from folders to hits, and what running it again does."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmatch.operators.embed import embed_incremental, hashed_bag_of_words, update_embeddings
from corpusmatch.plans import ingest as plan
from corpusmatch.schemas import HITS, PATTERNS, STORED_CACHE, SYMBOLS, conform

BODY = "plan the work, call a tool, observe what it returned, then plan again until the goal is reached; " * 2

AGENT = f'def planner(x):\n    """plans"""\n    return "{BODY}"\n'


def _write(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


@pytest.fixture
def setting(spark, tmp_path):
    _write(tmp_path / "one", {"agent.py": AGENT, "README.md": BODY, "bad.py": "def ("})
    _write(tmp_path / "two", {"copy/agent.py": AGENT, "notes.txt": "weather " * 30})
    (tmp_path / "catalog.csv").write_text(
        "Pattern Name,Description\nPlanner,plan call a tool observe then plan again until the goal\nWeather [1],weather weather\n"
    )
    rows = [(f"https://git.example.org/x/{n}.git", str(tmp_path / n), "main") for n in ("one", "two")]
    repos = spark.createDataFrame(rows, "url string, local_path string, default_branch string")
    return tmp_path, repos, plan.Store(spark, f"{tmp_path}/store")


def _hits(store):
    rows = store.hits_enriched().select("pattern_name", "repo_name", "match_kind", "reason", "snippet_hash", "symbol_id")
    return sorted(map(tuple, rows.collect()))


def test_run_and_run_again(spark, setting):
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    hits = plan.run(spark, store.path, repos, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)
    first = _hits(store)
    assert hits.count() == len(first)
    assert {(p, r) for p, r, *_ in first} == {("Planner", "one"), ("Planner", "two"), ("Weather", "two")}
    assert [r["rel_path"] for r in store.extract_errors().collect()] == ["bad.py"]
    assert store.files().count() == 5
    # equal bodies are embedded once for both repositories
    assert store.vectors().count() == store.cache().count() + 1

    keys = store.hits().groupBy("pattern_id", "snippet_hash", "repo_id").count()
    assert keys.filter("count > 1").count() == 0
    assert store.hits().join(store.symbols(), "symbol_id", "left_anti").count() == 0

    cached = store.cache().count()
    plan.ingest(store, repos, encoder, min_cos=0.3)
    assert _hits(store) == first and store.cache().count() == cached and store.files().count() == 5
    assert store.repos().count() == 2 and store.patterns().count() == 2


def test_unchanged_files_are_not_parsed_again(spark, setting, monkeypatch):
    """Stored symbols are marked: those of unchanged files keep the mark, the others are made anew."""
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    plan.run(spark, store.path, repos, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)

    def mark():
        store.overwrite("symbols", store.symbols().withColumn("signature", F.lit("marked")), SYMBOLS, "repo_id")

    def marked():
        paths = store.symbols().join(store.files().select("file_id", "rel_path"), "file_id")
        return {(r["rel_path"], r["signature"] == "marked") for r in paths.collect()}

    mark()
    everything = [("agent.py", True), ("README.md", True), ("copy/agent.py", True), ("notes.txt", True)]
    plan.ingest(store, repos, encoder, min_cos=0.3)
    assert marked() == set(everything)
    assert [r["rel_path"] for r in store.extract_errors().collect()] == ["bad.py"]

    # a changed file, one that is gone, one that is new, one that has moved and one that can be parsed now
    (tmp_path / "one" / "agent.py").write_text(AGENT + "\ndef other():\n    return 2\n")
    (tmp_path / "one" / "README.md").rename(tmp_path / "one" / "moved.md")
    (tmp_path / "two" / "notes.txt").unlink()
    _write(tmp_path / "one", {"new.py": AGENT, "bad.py": "def good():\n    return 1\n"})
    monkeypatch.setattr(plan, "SENT_FILES", 0)
    plan.ingest(store, repos, encoder, min_cos=0.3)
    new = {(p, False) for p in ("agent.py", "moved.md", "new.py", "bad.py")}
    assert marked() == new | {("copy/agent.py", True)}
    assert store.extract_errors().count() == 0

    # equal to a store that is made from nothing, once the mark is gone
    whole = plan.Store(spark, f"{tmp_path}/whole")
    plan.run(spark, whole.path, repos, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)
    columns = [c for c in store.symbols().columns if c != "signature"]
    assert sorted(map(str, store.symbols().select(columns).collect())) == sorted(map(str, whole.symbols().select(columns).collect()))
    assert _hits(store) == _hits(whole)

    # another extraction than the stored one parses everything
    mark()
    monkeypatch.setattr(plan, "EXTRACTION", "next")
    plan.ingest(store, repos, encoder, min_cos=0.3)
    assert not any(m for _, m in marked())


def test_a_repository_is_replaced_as_a_whole(spark, setting):
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    plan.run(spark, store.path, repos, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)
    before = _hits(store)
    for path in ("agent.py", "README.md", "bad.py"):
        (tmp_path / "one" / path).unlink()
    one = repos.filter("url like '%one.git'")
    plan.ingest(store, one, encoder, min_cos=0.3)
    assert _hits(store) == [h for h in before if h[1] != "one"]
    names = {r["repo_id"]: r["name"] for r in store.repos().collect()}
    for table in (store.files(), store.symbols(), store.vectors()):
        assert {names[r["repo_id"]] for r in table.select("repo_id").distinct().collect()} == {"two"}


def test_accumulated_hits_of_other_repositories_stay(spark, setting):
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    one, two = repos.filter("url like '%one.git'"), repos.filter("url like '%two.git'")
    plan.run(spark, store.path, one, encoder, f"{tmp_path}/catalog.csv", topk=1, min_cos=0.3)
    after_one = _hits(store)
    plan.ingest(store, two, encoder, topk=1, min_cos=0.3, accumulate=True)
    assert set(after_one) <= set(_hits(store))
    plan.ingest(store, two, encoder, topk=1, min_cos=0.3)
    assert store.hits().groupBy("pattern_id").count().filter("count > 1").count() == 0


def test_input_order_does_not_matter(spark, setting):
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    plan.run(spark, store.path, repos, encoder, f"{tmp_path}/catalog.csv", topk=1, min_cos=0.3)
    other = plan.Store(spark, f"{tmp_path}/other")
    two, one = repos.filter("url like '%two.git'"), repos.filter("url like '%one.git'")
    plan.run(spark, other.path, two, encoder, f"{tmp_path}/catalog.csv", topk=1, min_cos=0.3)
    plan.ingest(other, one, encoder, topk=1, min_cos=0.3)
    assert _hits(other) == _hits(store)


@pytest.mark.parametrize("table, accumulate", [("symbols", False), ("pattern_hits", True)])
def test_a_broken_batch_leaves_the_store_as_it_was(spark, setting, monkeypatch, table, accumulate):
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    one, two = repos.filter("url like '%one.git'"), repos.filter("url like '%two.git'")
    plan.run(spark, store.path, one, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)
    before = _hits(store), store.repos().count(), store.files().count(), store.cache().count()
    write = plan.Store._write

    def breaks(self, name, *rest):
        if name == table:
            raise OSError("no space left")
        return write(self, name, *rest)

    monkeypatch.setattr(plan.Store, "_write", breaks)
    with pytest.raises(OSError):
        plan.ingest(store, two, encoder, min_cos=0.3, accumulate=accumulate)
    monkeypatch.undo()
    again = plan.Store(spark, store.path)
    assert (_hits(again), again.repos().count(), again.files().count(), again.cache().count()) == before
    plan.ingest(again, two, encoder, min_cos=0.3, accumulate=accumulate)
    whole = plan.Store(spark, f"{tmp_path}/whole")
    plan.run(spark, whole.path, one, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)
    plan.ingest(whole, two, encoder, min_cos=0.3, accumulate=accumulate)
    assert _hits(again) == _hits(whole) and again.cache().count() == whole.cache().count()


def test_a_pattern_saved_in_between_is_looked_for_everywhere(spark, setting):
    tmp_path, repos, store = setting
    encoder = hashed_bag_of_words()
    one, two = repos.filter("url like '%one.git'"), repos.filter("url like '%two.git'")
    plan.run(spark, store.path, one, encoder, f"{tmp_path}/catalog.csv", min_cos=0.3)
    new = conform(spark.createDataFrame([("k", "Key", ["planner"])], "pattern_id string, name string, indicators array<string>"), PATTERNS)
    plan.save_patterns(store, new)
    assert {r["name"] for r in store.patterns().collect()} == {"Planner", "Weather", "Key"}
    plan.run(spark, store.path, two, encoder, min_cos=0.3)
    found = {(p, r) for p, r, kind, *_ in _hits(store) if kind == "keyword"}
    assert found == {("Key", "one"), ("Key", "two")}
    # the new pattern has its vector now, like all others
    assert store.patterns().filter("embedding is null").count() == 0


def test_nothing_to_ingest_is_an_error(spark, setting):
    tmp_path, repos, store = setting
    (tmp_path / "list.txt").write_text("# none\n\n")
    for given in ([], [f"@{tmp_path}/list.txt"], repos.limit(0)):
        with pytest.raises(ValueError, match="no repository"):
            plan.run(spark, store.path, given, hashed_bag_of_words())


def test_run_from_a_list(spark, setting):
    tmp_path, repos, store = setting
    (tmp_path / "list.txt").write_text(f"# ours\n{tmp_path}/one\n{tmp_path}/two\n")
    entries = [f"{tmp_path}/two", f"@{tmp_path}/list.txt"]
    plan.run(spark, store.path, entries, hashed_bag_of_words(), f"{tmp_path}/catalog.csv", min_cos=0.3)
    assert {r["name"] for r in store.repos().collect()} == {"one", "two"} and store.files().count() == 5


def test_upkeep_of_older_hits(spark, setting):
    _, _, store = setting
    rows = [("p", "s2", "r", "text", None), ("p", "s1", "r", "text", ""), ("p", "s3", "r", "other", "h")]
    old = spark.createDataFrame(rows, "pattern_id string, symbol_id string, repo_id string, code_snippet string, snippet_hash string")
    store.overwrite("pattern_hits", old, HITS, "repo_id")
    plan.upkeep(store)
    assert sorted((r["symbol_id"], r["code_snippet"]) for r in store.hits().collect()) == [("s1", "text"), ("s3", "other")]


def test_a_small_batch_reads_its_part_of_the_cache(spark, setting):
    _, _, store = setting
    rows = spark.range(512).selectExpr("sha2(cast(id as string), 256) as text_hash", "array(cast(id as float)) as embedding", "'default' as encoder")
    store.append("embeddings_cache", rows, STORED_CACHE, plan._cache_bucket())
    few = rows.limit(2)
    assert store.cache("default", few).join(few, "text_hash").count() == 2
    assert len(store.cache("default", few).inputFiles()) <= 2 < len(store.cache().inputFiles())
    assert store.cache("another", few).count() == 0


def test_only_missing_texts_are_encoded(spark):
    schema = "symbol_id string, repo_id string, kind string, name string, docstring string, source string, embedding array<float>"
    rows = [(f"s{i:02}", "r", "doc", "n", None, BODY * (1 + i % 3), None) for i in range(12)]
    rows += [("tiny", "r", "doc", "n", None, "x", None), ("done", "r", "doc", "n", None, BODY, [0.5])]
    symbols = spark.createDataFrame(rows, schema)
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>")
    vectors, fresh = embed_incremental(symbols, cache, hashed_bag_of_words(16), 120)
    assert fresh.count() == 3 and vectors.count() == 12
    marked = fresh.selectExpr("text_hash", "array(cast(7 as float)) as embedding")
    again, none = embed_incremental(symbols, marked, hashed_bag_of_words(16), 120)
    assert none.count() == 0 and {tuple(r["embedding"]) for r in again.collect()} == {(7.0,)}
    back = {r["symbol_id"]: r["embedding"] for r in update_embeddings(symbols, again).collect()}
    assert back["tiny"] is None and back["done"] == [0.5] and back["s03"] == [7.0]


def test_blank_texts_have_no_vector(spark):
    from corpusmatch.operators.embed import embed_texts

    df = spark.createDataFrame([("a b a",), (" \t",), (None,), ("é",)], "t string")
    got = {r["t"]: r["embedding"] for r in embed_texts(df, "t", hashed_bag_of_words(4)).collect()}
    assert got[" \t"] is None and got[None] is None and got["é"] == [0.0] * 4
    assert abs(sum(x * x for x in got["a b a"]) - 1) < 1e-6


def test_costly_python_steps_get_small_batches(spark, tmp_path):
    """So that a worker's memory doesn't follow the rows of its task; the session's settings come back."""
    from corpusmatch.operators.embed import embed_incremental
    from corpusmatch.operators.storage import SMALL_BATCHES

    @F.arrow_udf("array<float>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([[float(len(texts))]] * len(texts), pa.list_(pa.float32()))

    symbols = spark.range(5000).coalesce(1).select(
        F.col("id").alias("symbol_id"), F.lit("r").alias("repo_id"), F.lit("doc").alias("kind"), F.lit("n").alias("name"),
        F.lit(None).cast("string").alias("docstring"), F.col("id").cast("string").alias("source"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>")
    before = {key: spark.conf.get(key) for key in SMALL_BATCHES}
    vectors, fresh = embed_incremental(symbols, cache, encode, folder=str(tmp_path))
    assert vectors.count() == 5000 and max(r[0] for r in fresh.selectExpr("embedding[0]").collect()) <= 1000
    assert {key: spark.conf.get(key) for key in SMALL_BATCHES} == before
