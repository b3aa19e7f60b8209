"""Whitening, personal data and resampling, against brute force and held-out cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmatch.llm import pii, queries, resampling, whitening

# --- 11 ---

VECTORS = "vec_id long, embedding array<float>, label int, component string, n int"


def _vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) * 0.3 + 2
    rows = [(i, [float(x) for x in v], 1, "clash", 3) for i, v in enumerate(base)]
    rows += [(62, rows[7][1], None, None, None), (62, rows[7][1], None, None, None), (None, rows[9][1], 1, "", 1)]
    bad = [None, [], [None] * 6, [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] * 6, [1.0, 2.0]]
    return rows, rows + [(100 + i, v, 1, "x", 1) for i, v in enumerate(bad)]


def test_whitening(spark):
    good, rows = _vectors()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.whiten(frame, 4).collect()
    x = np.floor(np.array([r[1] for r in good], np.float32).astype(float) * 64).astype(int) + 1000000
    n, sums = len(x), x.sum(axis=0)
    covariance = np.cov(x.T.astype(float), bias=True)
    values = np.linalg.eigvalsh(covariance)[::-1]
    assert len(got) == n * 4 and {r["n"] for r in got} == {n}
    assert Counter(r["vec_id"] for r in got) == Counter({k: 4 * c for k, c in Counter(r[0] for r in good).items()})
    deviation = {r[0]: sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for r, row in zip(good, x)}
    white = np.zeros((60, 4))
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]]
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
        if r["vec_id"] is not None and r["vec_id"] < 60:
            white[r["vec_id"], r["component"] - 1] = r["whitened"]
    centred = x[:60] - sums / n
    for k in range(4):
        # the component is what the centred rows are turned by: an eigenvector of unit length
        vector = np.linalg.lstsq(centred, white[:, k], rcond=None)[0] * math.sqrt(values[k])
        assert np.allclose(covariance @ vector, values[k] * vector, atol=1e-6 * values[0])
        assert math.isclose(vector @ vector, 1, rel_tol=1e-9)


def test_whitening_of_extremes(spark, sf_dir):
    """Sums stay exact where longs would not hold them; components without variance are null."""
    rows = [(i, [3e38 * (-1) ** i, 1e-30, float(i)], 1, "", 1) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), 32).collect()
    assert len(got) == 15 and {r["deviation"] for r in got} == {None}
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3}
    same = spark.createDataFrame([(1, [1.0, 2.0], 1, "", 1)] * 3, VECTORS)
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in whitening.whiten(same).collect()} == {
        (None, None, None, 0)
    }
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "", 1)], VECTORS)).count() == 0


def test_whitening_covariance_is_exact(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fitted = whitening.fit(frame.repartition(3))
    rows = [r[0] for r in frame.select("embedding").collect() if r[0]]
    x = (np.floor(np.array(rows, np.float64) * 64) + 1000000).astype(int).tolist()
    n = len(x)
    for i, j in ((0, 0), (0, 1), (5, 40), (63, 62)):
        exact = n * sum(v[i] * v[j] for v in x) - sum(v[i] for v in x) * sum(v[j] for v in x)
        assert fitted.covariance[i, j] == exact / n**2


# --- 12 ---

SCHEMA = "doc_id long, text string, base string, added string"


def _base_by_patterns(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        odd, even = digits[-1::-2], digits[-2::-2]
        total = sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_are_those_of_the_patterns(sf_dir, spark):
    rng = np.random.default_rng(6)
    pieces = ["1", "25", "256", ".", ".", "@", "+", " ", "-", "(", "a", "b.c", "007", "4111111111111111", "é", "\n", "+1 555", "x@y.z"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(1, 40)))) for _ in range(4000)]
    texts += [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["1.2.3.4.5.6.7.8.9", "a@b.c@d.e", "0000001.2.3.4", "9" * 5000 + ".1.1.1"[:4], "+1+2 345 678 901"]
    for text in texts:
        assert pii.base_spans(text) == _base_by_patterns(text), text


def test_long_texts_are_searched_in_linear_time():
    import time

    start = time.perf_counter()
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "(+" * 150_000, "a at b " * 40_000):
        pii.base_spans(text)
        pii.candidates(text)
    assert time.perf_counter() - start < 30


def _prose(rng, n):
    return " ".join("".join(rng.choice(list("abdefgilmnorstu"), int(rng.integers(2, 9)))) for _ in range(n))


def _strict(rng):
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    card = "4" + number(14)
    return [
        f"{_prose(rng, 1)}.{number(2)}@mail{number(1)}.example.com",
        ".".join(str(x) for x in rng.integers(1, 256, 4)),
        card + next(d for d in "0123456789" if pii.luhn(card + d)),
        f"+1 ({number(3)}) 555-{number(4)}",
    ]


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(400):
        kinds = _strict(rng)
        texts.append(f"{_prose(rng, 30)} {kinds[i % 4]} {_prose(rng, 20)}, {rng.integers(10**9, 10**10)} {_prose(rng, 5)}")
    docs = spark.createDataFrame([(i, t, "b", "a") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return pii.learn(docs)


def test_held_out_spans_in_other_forms_are_found(model):
    """Forms and contexts that no example had; other numbers stay."""
    rng = np.random.default_rng(99)
    caught, wanted, wrong, clean = 0, 0, 0, 0
    for _ in range(60):
        mail, ip, card, phone = _strict(rng)
        digits = re.sub("[^0-9]", "", phone)
        forms = [mail.replace("@", " [at] ").replace(".", " [dot] "), ip.replace(".", "[.]"), f"({digits[1:4]}) {digits[4:7]}-{digits[7:]}"]
        forms.append("/".join(card[i : i + 4] for i in range(0, 16, 4)))
        for form in forms:
            text = f"{_prose(rng, 12)} {form} {_prose(rng, 12)}"
            wanted += 1
            caught += text[slice(*[pii.added(text, pii.base_spans(text), model)[0][i] for i in (0, 2)])] == form if pii.added(text, pii.base_spans(text), model) else 0
        n = rng.integers(10**6, 10**7)
        for other in (f"2019-0{n % 9 + 1}-1{n % 9}", f"v{n % 9}.{n % 7}.{n % 5}", str(n * 131), f"{n % 900 + 100} {n % 800 + 100}", f"met at noon. Then {n}"):
            text = f"{_prose(rng, 12)} {other} {_prose(rng, 12)}"
            clean += 1
            wrong += bool(pii.added(text, pii.base_spans(text), model))
    assert caught >= 0.9 * wanted and wrong <= 0.03 * clean


def test_pii_table(spark, model):
    rows = [
        (1, "x a.b@c.de y 10.0.0.1 z", "", ""), (2, None, None, None), (3, "", "", ""), (None, "+1 555 123 4567", "", ""),
        (1, "x a.b@c.de y 10.0.0.1 z", "", ""), (4, "é" * 70_000 + " 4111-1111-1111-1111 ü", "", ""),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in pii.digests(pii.find(docs, None)).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        spans = _base_by_patterns(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = [sum(k == x for _, x, _ in spans) for k in range(4)]
        want[(doc_id, *counts, hashlib.sha256(told.encode()).hexdigest(), told)] += 1
    assert got == want
    assert pii.learn(docs) is None and pii.find(docs.limit(0), model).count() == 0
    found = {r["doc_id"]: (r["text"], r["base"]) for r in pii.redact(docs, model).collect()}
    assert found[1] == ("x [email] y [ip] z", "") and found[2] == (None, None) and found[4][0] == "é" * 70_000 + " [card] ü"


def test_pii_learns_from_every_text(spark, monkeypatch):
    """Each text and each span gives its examples, in whatever order; the trees are the same from tasks and from the driver."""
    rng = np.random.default_rng(3)
    texts = [f"{_prose(rng, 5)} {' , '.join(_strict(rng)[i % 4] for _ in range(30))} {_prose(rng, 5)}" for i in range(40)]
    docs = spark.createDataFrame([(i, t, "b", "a") for i, t in enumerate(texts + texts[:1])] + [(99, None, "", "")], SCHEMA)
    rows = pii._all_examples(docs, "text").collect()
    # of a text with 30 spans too, and of a copy
    assert sum(r["n"] for r in rows) == sum(1 for t in texts + texts[:1] for _ in pii.examples(t))
    base = sum(len(pii.base_spans(t)) for t in texts + texts[:1])
    assert base >= 41 * 30 and sum(r["n"] for r in rows if r["good"]) >= 2 * base

    monkeypatch.setattr(pii, "ROUNDS", 12)
    first = pii.learn(docs.repartition(3))
    monkeypatch.setattr(pii, "ROWS_PER_TASK", 20)
    other = pii.learn(docs.orderBy(docs.doc_id.desc()).repartition(5))
    for part in ("feature", "cut", "leaf"):
        assert np.array_equal(getattr(first.trees, part), getattr(other.trees, part))
    assert first.thresholds == other.thresholds and min(first.thresholds) < float("inf")


def test_pii_query_keeps_base_spans(spark, sf_dir):
    got = queries.op12_boosted_candidates(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in _base_by_patterns(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


# --- 13 ---


def _resampled(rows, targets, percent, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def buckets(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]

    docs = [(i, *buckets(t)) for i, t in rows]
    s, t = (Counter(b for _, bs in x for b in bs) for x in ([d[1:] for d in docs], [buckets(x) for x in targets]))
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    out = []
    for i, words, bs in docs:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize("percent, least", [(25, 20), (60, 0), (100, 5)])
def test_resampling(spark, percent, least):
    rng = np.random.default_rng(percent)
    rows = [(i, _prose(rng, int(rng.integers(0, 60)))) for i in range(80)]
    rows += [(3, rows[3][1])] * 3 + [(7, "Another TEXT of 7, é! " * 9), (None, rows[5][1]), (200, None), (201, ""), (202, "-- !"), (203, "x" * 3000 + " Y")]
    docs = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows], "doc_id long, text string, rank int, score string, weight double")
    targets = [rows[3][1], None, "", "another text of seven and more"]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resampling.resample(docs.repartition(4), target, percent, least)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == _resampled(
        rows, targets, percent, least
    )


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).count() == 0
    got = resampling.resample(docs, docs.limit(0), 50, 0)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == _resampled(
        [(1, "a b"), (2, None)], [], 50, 0
    )


def test_resampling_query(spark, sf_dir):
    got = queries.op13_prefix_crc_resampling(spark, sf_dir).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    targets = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = Counter((i, n, w, s, rank) for i, _, n, w, s, rank in _resampled(rows, targets, 25, 20).elements())
    assert Counter(tuple(r) for r in got) == want


def test_crcs_of_long_runs():
    rng = np.random.default_rng(12)
    texts = [_prose(rng, 300).encode(), b"", "Ünï c0de".encode() * 200, b"z" * 70_000 + b" end"]
    crcs, owners, counts = resampling.ngram_crcs(texts, 5)
    want = []
    for n in range(1, 6):
        for k, text in enumerate(texts):
            words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
            want += [(zlib.crc32(b" ".join(words[i : i + n])), k) for i in range(len(words) - n + 1)]
    assert list(zip(crcs.tolist(), owners.tolist())) == want
    assert counts.tolist() == [300, 0, 201, 2]
