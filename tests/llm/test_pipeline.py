"""The pipeline's rows against its stages worked out one document at a time."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from .test_small_cases import PASSAGE, _fingerprint, _ids, _linked, _removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string"


def _prose(rng, n):
    words = ["".join(rng.choice(list("abdefgilmnorstu"), int(rng.integers(2, 9)))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    texts = [_prose(rng, int(rng.integers(60, 400))) for _ in range(30)]
    shared = _prose(rng, 60)
    texts[3] = texts[2]
    texts[5] = texts[4] + " more"
    texts[7] += "\n" + shared
    texts[8] = shared + "\n" + texts[8]
    texts[9] += " É" + shared[1:] + " end"
    texts[10] += " " + PASSAGE
    texts[11] += " " + PASSAGE.replace("wizards", "witches") + " tail"
    texts[12] = "too short"
    texts[13] = "again and " * 100
    found = [(i, t, "en", f"s{i % 3}", len(t), "clash") for i, t in enumerate(texts)]
    found += [(20, texts[20], "en", "s2", 1, None), (40, None, None, None, None, None), (41, "", "en", "s", 0, "")]
    return found


def _failed(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words) < 50 or 100 * len(again) > 50 * len(words)


def test_pipeline(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {r[0]: r[1] for r in rows if not _failed(r[1])}
    label = _linked(list(good), [_fingerprint(t) for t in good.values()])
    left = [(i, t) for i, t in good.items() if label[i] == i]
    assert len(good) == 28 and len(left) == 26
    cut = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in _removed(left, 50)}
    assert sum(len(t) for t in cut.values()) < sum(len(t) for _, t in left) - 400
    words = PASSAGE.split()
    want = {}
    for i, text in cut.items():
        own = re.findall(r"\w+", text.lower())
        runs = [own[p : p + 19] for p in range(len(own) - 18)]
        if not any(sum(a == b for a, b in zip(run, words)) >= 0.8 * len(words) for run in runs):
            want[i] = _ids(text, 1)
    assert 10 not in want

    got = defaultdict(list)
    for r in pieces:
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], r["length"]))
    assert set(got) == set(want)
    for i, parts in got.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(want[i])


def test_stages_keep_the_columns(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            result = stage(spark, given, str(tmp_path))
            assert result.columns == docs.columns, name
            assert result.count() <= docs.count()


def test_repeated_ids_keep_rows_of_other_texts(spark):
    """Each row is judged by its own text; of rows that are the same one stays, whatever the partitions."""
    rng = np.random.default_rng(3)
    a, b, c = (_prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (3, b + " x"), (7, c), (7, c), (8, c), (None, a), (None, None), (9, None), (4, ""), (7, c + " ")]
    stay = []
    for parts in (1, 3, 5):
        docs = spark.createDataFrame([(i, t, "en", "s", 1, "d") for i, t in rows], SCHEMA).repartition(parts)
        docs = docs.withColumn("id", F.lit("clash")).withColumn("digest", F.lit(None).cast("string"))
        found = corpus_pipeline.near_copies(spark, docs, "")
        assert found.columns == docs.columns
        stay.append(sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr))
    assert stay[0] == stay[1] == stay[2]
    assert [r for r in stay[0] if r[0] != 7] == sorted([(1, a), (1, b), (4, ""), (None, a), (None, None)], key=repr)
    assert [r[1].strip() for r in stay[0] if r[0] == 7] == [c]
