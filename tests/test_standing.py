"""The kept top k against a full computation over random sequences of replacements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmatch.operators import standing
from corpusmatch.operators.semantic import semantic_topk
from corpusmatch.plans import ingest as plan

VECTORS = "symbol_id string, repo_id string, embedding array<float>"
PATTERNS = "pattern_id string, name string, embedding array<float>"


def _rows(frame):
    return sorted(map(tuple, frame.select(*standing.RESERVE).collect()))


def _vectors(rng, repo, n):
    # few directions, so that equal scores are frequent
    found = rng.integers(-1, 2, (n, 3)).astype(float)
    return [(f"{repo}-{i:03}", repo, [float(x) for x in v]) for i, v in enumerate(found)]


@pytest.mark.parametrize("seed, k, spare", [(0, 3, 2), (1, 4, 0)])
def test_equal_to_a_full_computation(spark, seed, k, spare):
    rng = np.random.default_rng(seed)
    corpus = {f"r{i}": _vectors(rng, f"r{i}", int(rng.integers(0, 12))) for i in range(5)}
    rows = [(f"p{i}", f"n{i}", [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(6)]
    rows.append(("none", "no vector", None))
    frame = lambda c: spark.createDataFrame([r for v in c.values() for r in v], VECTORS)
    patterns = spark.createDataFrame(rows, PATTERNS)
    state, scored = standing.build(frame(corpus), patterns, k, 0.5, spare), 0
    for step in range(3):
        names = [f"r{i}" for i in rng.choice(7, int(rng.integers(1, 3)), replace=False)]
        for name in names:
            # replaced, added or emptied
            corpus[name] = _vectors(rng, name, int(rng.integers(0, 9)))
        if step == 1:
            rows = [(p, n, [1.0, 1.0, 1.0] if p == "p1" else v) for p, n, v in rows if p != "p2"] + [("new", "new", [0.0, 1.0, 0.0])]
            patterns = spark.createDataFrame(rows, PATTERNS)
        fresh = frame({n: corpus[n] for n in names}) if any(corpus[n] for n in names) else frame(corpus).limit(0)
        replaced = spark.createDataFrame([(n,) for n in names], "repo_id string")
        state, anew = standing.replace(state, replaced, fresh, frame(corpus), patterns, k, 0.5, spare)
        scored += anew.count()
        assert _rows(state.best(k)) == _rows(semantic_topk(frame(corpus), patterns, k, 0.5))
        assert state.reserve.groupBy("pattern_id").count().filter(F.col("count") > k + spare).count() == 0
    assert scored < 3 * 6


def test_an_ingest_scores_and_writes_only_what_is_affected(spark, tmp_path, monkeypatch):
    """One repository of five is replaced: its vectors are scored, hits of others are neither scored nor written again."""
    from corpusmatch.operators.embed import hashed_bag_of_words

    topics = ["plan the work and call a tool", "weather in the mountains today", "cooking rice with some salt", "old trains on new rails", "stars"]
    for i, topic in enumerate(topics):
        (tmp_path / f"r{i}").mkdir()
        for j in range(4):
            (tmp_path / f"r{i}" / f"t{j}.txt").write_text(f"{topic} " * (j + 3))
    lines = "\n".join(f"P{i},{t}" for i, t in enumerate(topics))
    (tmp_path / "catalog.csv").write_text(f"name,description\n{lines}\n")
    rows = [(f"https://h/{i}.git", str(tmp_path / f"r{i}"), "main") for i in range(5)]
    repos = spark.createDataFrame(rows, "url string, local_path string, default_branch string")
    store = plan.Store(spark, f"{tmp_path}/store")
    encoder = hashed_bag_of_words()
    plan.run(spark, store.path, repos, encoder, f"{tmp_path}/catalog.csv", topk=3, min_cos=0.3)

    scored, written = [], []
    topk, write = standing.semantic_topk, plan.Store._write
    monkeypatch.setattr(standing, "semantic_topk", lambda v, p, *a, **b: (scored.append((v.count(), p.count())), topk(v, p, *a, **b))[1])
    monkeypatch.setattr(
        plan.Store, "_write", lambda self, name, rows, *a: (written.append((name, {r["repo_id"] for r in rows.collect()})) if name == "pattern_hits" else 0, write(self, name, rows, *a))[1]
    )
    (tmp_path / "r1" / "t0.txt").write_text("weather " * 40)
    plan.ingest(store, repos.filter("url = 'https://h/1.git'"), encoder, topk=3, min_cos=0.3)
    monkeypatch.undo()
    assert [v for v, _ in scored] == [4]
    whole = plan.Store(spark, f"{tmp_path}/whole")
    plan.run(spark, whole.path, repos, encoder, f"{tmp_path}/catalog.csv", topk=3, min_cos=0.3)
    hits = lambda s: sorted(map(tuple, s.hits().select("pattern_id", "symbol_id", "repo_id", "match_kind", "reason", "code_snippet").collect()))
    assert hits(store) == hits(whole)
    assert len(written) == 1 and len(written[0][1]) < 5
