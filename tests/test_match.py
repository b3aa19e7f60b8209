"""Both matchers against brute force, whole or in blocks of the catalogue."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmatch.operators.hits import HIT_KEY, attach_snippets, insert_ignore
from corpusmatch.operators.keyword import keyword_scan
from corpusmatch.operators.semantic import semantic_match, semantic_topk
from corpusmatch.schemas import HITS, conform

SYMBOL = "symbol_id string, repo_id string, name string, docstring string, source string, embedding array<float>"
PATTERN = "pattern_id string, name string, indicators array<string>, embedding array<float>"


def _unit(rng, n, dim=16):
    v = rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    symbols = _unit(rng, 400)
    symbols[200:] = symbols[:200]  # every vector twice: ties
    patterns = _unit(rng, 7)
    s = [(f"s{i:03}", f"r{i % 3}", f"n{i}", None, f"tool {i % 5}", v.tolist()) for i, v in enumerate(symbols)]
    s += [("none", "r0", "x", "d", "tool", None), ("empty", "r0", "x", "d", "tool", []), ("short", "r0", "x", "d", "t", [1.0])]
    s += [("nan", "r0", "x", "d", "tool", [float("nan")] * 16), ("hole", "r0", "x", "d", "tool", [None] + [0.1] * 15)]
    inds = [[], None, ["tool 1"], [" "], ["too"], ["TOOL", "nothing"], ["tool 4", "tool 2"]]
    p = [(f"p{i}", f"pattern {i}", inds[i], v.tolist()) for i, v in enumerate(patterns)]
    p += [("q", "no vector", [], None)]
    return spark.createDataFrame(s, SYMBOL).repartition(6), spark.createDataFrame(p, PATTERN), s, p


def _brute_topk(s, p, k, min_cos):
    out = []
    for pid, pname, _, pv in p:
        scored = []
        for sid, repo, _, _, _, sv in s:
            if not sv or not pv:
                continue
            if len(sv) != len(pv):
                score = -1.0
            else:
                score = 0.0
                for x, y in zip(pv, sv):
                    score += float("nan") if y is None else float(np.float32(x)) * float(np.float32(y))
            if score >= min_cos:
                scored.append((-score, sid, repo))
        out += [(pid, pname, sid, repo, -neg) for neg, sid, repo in sorted(scored)[:k]]
    return sorted(out)


@pytest.mark.parametrize("k, min_cos", [(50, 0.1), (5, 0.3), (1000, -0.2), (1000, -1.0), (50, 0.99)])
@pytest.mark.parametrize("max_bytes", [64 << 20, 1])
def test_semantic_topk(vectors, k, min_cos, max_bytes):
    symbols, patterns, s, p = vectors
    got = sorted(map(tuple, semantic_topk(symbols, patterns, k, min_cos, max_bytes).collect()))
    assert got == _brute_topk(s, p, k, min_cos)


def test_top_k_comes_before_the_gate(vectors):
    symbols, patterns, s, p = vectors
    sources, indicators = {r[0]: r[4] for r in s}, {r[0]: r[2] for r in p}

    def passes(pid, sid):
        words = indicators[pid]
        return not words or any(w.strip() and w.lower() in ("tool", sources[sid]) for w in words)

    best = _brute_topk(s, p, 20, 0.0)
    want = sorted((pid, sid, f"semantic={score:.2f}", sources[sid]) for pid, _, sid, _, score in best if passes(pid, sid))
    hits = semantic_match(symbols, patterns, 20, 0.0)
    got = sorted(map(tuple, hits.select("pattern_id", "symbol_id", "reason", "code_snippet").collect()))
    assert got == want and 0 < len(want) < len(best)


def test_vectors_kept_apart_give_the_same_hits(vectors):
    symbols, patterns, _, _ = vectors
    apart = symbols.select("symbol_id", "repo_id", "embedding")
    one = semantic_match(symbols, patterns, 20, 0.0)
    two = semantic_match(symbols.drop("embedding"), patterns, 20, 0.0, vectors=apart)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_winners_too_many_to_broadcast(vectors, monkeypatch):
    from corpusmatch.operators import semantic

    symbols, patterns, _, _ = vectors
    broadcast = semantic_match(symbols, patterns, 20, 0.0)
    monkeypatch.setattr(semantic, "MAX_WINNER_BYTES", 0)
    shuffled = semantic_match(symbols, patterns, 20, 0.0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, broadcast.collect()))


def test_no_patterns_no_hits(vectors):
    symbols, patterns, _, _ = vectors
    nothing = patterns.filter("pattern_id = 'q'")
    assert semantic_match(symbols, nothing).count() == 0
    assert keyword_scan(symbols, nothing).count() == 0


def test_long_bodies_keep_their_head(spark):
    body = "\U0001f600" * 9000
    symbols = spark.createDataFrame([("s", "r", "n", "Agent", body, [1.0])], SYMBOL)
    patterns = spark.createDataFrame([("p", "p", ["agent"], [1.0])], PATTERN)
    keyword, semantic = keyword_scan(symbols, patterns), semantic_match(symbols, patterns, snippet_chars=8000)
    both = attach_snippets(insert_ignore(None, keyword, semantic), symbols, 8000).collect()
    assert sorted(len(r["code_snippet"]) for r in both) == [8000, 9000]  # their hashes differ: both stay


@pytest.mark.parametrize("max_bytes", [64 << 20, 1])
def test_keyword_scan(spark, max_bytes):
    words = ["tool", "Tool", "ol us", "", "é", "İstanbul", "ÄPFEL", "zz", "oo", None, "aa"]
    texts = [
        ("Tool", "use"), ("tool", None), (None, "ÉCOLE"), ("İSTANBUL", "äpfel"), ("", ""), (None, None), ("aaaa", "Zz"), ("xoolusx", "x"),
    ]
    s = [(f"s{i}", "r", n, d, "tool é", None) for i, (n, d) in enumerate(texts)]
    p = [(f"p{i}", f"n{i}", words[i:] + words[:1], None) for i in range(len(words))] + [("none", "n", [], None), ("null", "n", None, None)]
    want = []
    for sid, repo, n, d, source, _ in s:
        text = " ".join([n or "", d or ""]).lower()
        for pid, pname, inds, _ in p:
            reasons = sorted({w for w in inds or [] if w and w.lower() in text})
            if reasons:
                want.append((pid, pname, sid, "matched: " + ", ".join(reasons), source))
    hits = keyword_scan(spark.createDataFrame(s, SYMBOL), spark.createDataFrame(p, PATTERN), max_bytes)
    got = hits.select("pattern_id", "pattern_name", "symbol_id", "reason", "code_snippet").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_first_hit_wins_in_insert_order(spark):
    def hits(kind, rows):
        full = [(p, f"name {p}", s, r, kind, score, f"{kind} {s}", "text", h) for p, s, r, h, score in rows]
        return conform(spark.createDataFrame(full, HITS), HITS).repartition(3)

    existing = hits("keyword", [("p", "s9", "r", "h1", None)]).withColumn("reason", F.lit("old"))
    keyword = hits("keyword", [("p", "s2", "r", "h1", None), ("p", "s3", "r", "h2", None), ("p", "s2", "r", "h2", None), ("p", "s2", "q", "h1", None)])
    semantic = hits("semantic", [("p", "s1", "r", "h2", 0.9), ("p", "s5", "r", "h3", 0.5), ("p", "s6", "r", "h3", 0.7), ("p", "s4", "r", "h3", 0.7)])
    got = insert_ignore(existing, keyword, semantic).select(*HIT_KEY, "reason").collect()
    assert sorted(map(tuple, got)) == [
        ("p", "h1", "q", "keyword s2"), ("p", "h1", "r", "old"), ("p", "h2", "r", "keyword s2"), ("p", "h3", "r", "semantic s4"),
    ]
    again = insert_ignore(None, keyword.unionByName(keyword), semantic.unionByName(semantic))
    assert sorted(map(str, again.collect())) == sorted(map(str, insert_ignore(None, keyword, semantic).collect()))
