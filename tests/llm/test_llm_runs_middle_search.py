"""Periodic runs, fill-in-the-middle and collision search against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.llm import collision_search, fill_middle, periodic_runs, queries

ROWS = "doc_id long, text string"


def clashing(frame):
    """Extra columns with names the operators use themselves."""
    names = ("n", "runs", "output", "form", "key", "ids", "dim", "block", "found", "_n", "_u", "_v", "_b")
    return frame.withColumns({c: F.lit("x") for c in names})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 periodic runs ------------------------------------------------------------


def plain_runs(words, least=12):
    """Every period in turn; the least period of each interval."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(plain_collapsed(words, runs)))


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 4), st.integers(0, 70), st.integers(0, 60), st.integers(3, 9)), min_size=1, max_size=4),
    st.sampled_from([2, 4, 12]),
    st.randoms(use_true_random=False),
)
def test_runs_on_the_grammar_are_all_runs(shapes, least, random):
    docs = []
    for letters, n, at, parts in shapes:
        words = [random.randrange(letters) for _ in range(n)]
        a, p = min(at, n), 1 + max(n - at, 0) // parts
        docs.append([str(words[i] if i < a else words[a + (i - a) % p]) for i in range(n)])
    told = periodic_runs._told(pa.array(range(len(docs))), [[w.encode() for w in d] for d in docs], least).to_pylist()
    for words, row in zip(docs, told, strict=True):
        runs = plain_runs(words, least)
        assert [tuple(r.values()) for r in row["runs"]] == runs
        assert row["collapsed"] == plain_collapsed(words, runs)


def test_a_grammar_derives_its_text():
    text = np.array([*[0, 1, 2, 1] * 30, 3, 5, *[4] * 17, 6])
    walls = np.array([121, 139])
    text[walls] = [5, 6]
    grammar = periodic_runs.Grammar(text, walls)
    lo, mid, hi = (np.concatenate(x) for x in (grammar.start, grammar.middle, grammar.stop))
    assert ((lo < mid) & (mid < hi)).all() and len(grammar.symbols) == 4  # two documents and their walls
    for rule, place in zip(np.concatenate(grammar.rule), np.concatenate(grammar.place), strict=True):
        assert (text[lo[rule] : hi[rule]] == text[place : place + hi[rule] - lo[rule]]).all()
    assert len(lo) < 40  # the repeats share their rules


def test_common_stretches():
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(0, 3, 200), np.tile([0, 1], 50)]
    repeats = periodic_runs.Repeats(text)
    i, j = rng.integers(0, 299, 400), rng.integers(0, 299, 400)
    i, j = i[i != j], j[i != j]
    limit = np.minimum(len(text) - np.maximum(i, j), rng.integers(0, 80, len(i)))
    for a, b, m, got in zip(i, j, limit, repeats.forward(i, j, limit), strict=True):
        assert got == next((k for k in range(m) if text[a + k] != text[b + k]), m)
    limit = np.minimum(np.minimum(i, j), rng.integers(0, 80, len(i)))
    for a, b, m, got in zip(i, j, limit, repeats.backward(i, j, limit), strict=True):
        assert got == next((k for k in range(m) if text[a - 1 - k] != text[b - 1 - k]), m)


def test_runs_of_awkward_texts(spark):
    phrase = " ".join(f"w{k}" for k in range(7))
    texts = [None, "", " \t\n\x0b ", "a", "a " * 11, "a " * 12, f"{phrase} " * 3, f"{phrase} " * 1, "é é  " * 15]
    texts += ["x " * 300_000 + "y", "ab ab\tcd " * 40_000]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(None, "a b " * 9), (None, "a b " * 9), (4, "z " * 13)]
    frame = clashing(spark.createDataFrame(rows, ROWS))
    out = periodic_runs.periodic_runs(frame).collect()
    for row, (doc_id, text) in zip(out, rows, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        assert (row["doc_id"], row["n"]) == (doc_id, len(words))
        if len(words) < 1000:
            assert [tuple(r) for r in row["runs"]] == plain_runs(words)
            assert row["collapsed"] == plain_collapsed(words, plain_runs(words))
    assert [tuple(r) for r in out[9]["runs"]] == [(0, 300_000, 1)] and out[9]["collapsed"] == "x y"
    assert [tuple(r) for r in out[10]["runs"]] == [(0, 120_000, 3)] and out[10]["collapsed"] == "ab ab cd"
    empty = frame.where("false")
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.extend_periodically(empty))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(frame, least=1)


def test_run_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [r for r in rows if len((r[1] or "").split()) < 1500]  # plain runs are quadratic
    out = {r["doc_id"]: tuple(r) for r in queries.op11(spark, sf).collect()}
    assert len(out) == len(rows) and len(short) > 150
    assert [out[r[0]] for r in short] == [plain_row(*r) for r in short]


def test_periodic_texts_with_odd_ids(spark):
    tens = [k for k in range(300) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, " ".join(f"w{j}" for j in range(k))) for k in tens] + [(None, "a b c d"), (tens[0], None), (tens[1], " \n")]
    texts = periodic_runs.extend_periodically(clashing(spark.createDataFrame(rows, ROWS)))
    out = periodic_runs.run_digests(periodic_runs.periodic_runs(texts)).collect()
    assert list(map(tuple, out)) == [plain_row(*r) for r in rows]


# ---- 12 fill in the middle -------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles_of_awkward_texts(spark):
    texts = [None, "", "a", "\n", "<", "a<P>b", "<S", "<<P>>", "<<<>>>PSM", "P>a<S", "$1 \\2 $", "𠀀é́ \U0001f600x", "a\r\nb\x00c", "word " * 9]
    rows = [(k * 100 + j, t) for j, t in enumerate(texts) for k in range(40)] + [(None, "one two"), (None, "one two"), (7, "same"), (7, "same")]
    rows.append((3, "ab 1é\n" * 300_000))
    made = fill_middle.fill_in_middle(clashing(spark.createDataFrame(rows, ROWS)))
    out = made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out] == [plain_middle(*r) for r in rows]
    assert all(r["back"] == (t or "") for r, (_, t) in zip(out, rows, strict=True))
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert made.where("false").count() == 0


def test_middle_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*p[:5], sha(p[5]), sha(t or "")) for p, (_, t) in ((plain_middle(*r), r) for r in rows)]
    assert sorted(map(tuple, queries.op12(spark, sf).collect())) == sorted(want)


def test_the_transformation_runs_no_python(spark, sf):
    plan = queries.op12(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- 13 nearest neighbours -------------------------------------------------------


def vectors_of(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def plain_nearest(rows, k=5, every=50):
    """(query, [(score, id)]) over all usable rows, equal (id, vector) once."""
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.asarray(v, np.float32).tolist())), None)
    items = [(i, np.array(v)) for i, v in good]
    out = []
    for i, v in items:
        if i % every == 0:
            with_scores = [(-float(v @ w / np.sqrt((v @ v) * (w @ w))), j) for j, w in items if j != i and len(w) == len(v)]
            out.append((i, [(-s, j) for s, j in sorted(with_scores)[:k]]))
    return out


def found_by(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_threshold_of_collisions():
    """A vector within the radius reaches the threshold in all but one of a hundred draws."""
    rng = np.random.default_rng(5)
    met = (np.abs(rng.normal(size=(20_000, collision_search.DIRECTIONS))) <= collision_search.WIDTH / 2).sum(axis=1)
    assert 0.98 < (met >= collision_search.collision_threshold()).mean() <= 1
    assert collision_search.collision_threshold(4, 0.1) == 1


def test_a_block_finds_its_nearest_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.1
    index = collision_search.SortedProjections(x)
    hits, verified = 0, 0
    for q, (rows, scores) in enumerate(index.search(x[:60], 6, collision_search.collision_threshold())):
        exact = (x @ x[q]) / (index.norm * index.norm[q])
        assert np.allclose(scores, exact[rows], rtol=0, atol=1e-12) and len(set(rows)) == len(rows)
        hits += len(set(np.argsort(-exact)[:6]) & set(rows))
        verified += len(rows)
    assert hits >= 0.97 * 360 and verified < 60 * 3000 / 5  # clusters: most rows are never looked at


@pytest.mark.parametrize(("block_rows", "least_rows"), [(65_536, 256), (40, 10)])
def test_neighbours_of_awkward_vectors(spark, block_rows, least_rows):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=12).astype(np.float32).tolist(), k % 3) for k in range(300)]
    same = rows[50][1]
    rows += [(1000 + k, same, None) for k in range(40)] + [(400, same, 1), (400, same, 1), (2000, [2 * x for x in same], 1)]
    bad = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11]
    rows += [(5000 + 50 * k, v, 1) for k, v in enumerate(bad)]
    rows += [(None, same, 1), (6000, [1.0, 2.0], 1), (6001, [2.0, 1.0], 1), (6050, [-1.0, 0.5], 1), (7000, [1.0, 2.0, 3.0], 1)]
    rows += [(8000, [1e-30] * 12, 1), (8001, [1e30] * 12, 1)]
    got = found_by(collision_search.nearest_neighbours(vectors_of(spark, rows), block_rows=block_rows, least_rows=least_rows))
    want = {q: near for q, near in plain_nearest(rows) if near}
    assert set(got) == set(want)  # 7000 has no candidate
    hits = 0
    for q, near in want.items():
        assert len(got[q]) == len(near)
        if q in (50, 400, 1000):  # all five are copies of one vector: ties go to the smaller id
            assert [i for _, i in got[q]] == [i for _, i in near]
        hits += len({i for _, i in got[q]} & {i for _, i in near}) / len(near)
        exact = dict((i, s) for s, i in plain_nearest(rows, k=10**6)[[x for x, _ in plain_nearest(rows)].index(q)][1])
        assert all(abs(s - exact[i]) < 1e-9 for s, i in got[q])
    assert hits >= 0.95 * len(want)
    assert collision_search.nearest_neighbours(vectors_of(spark, rows).where("false")).count() == 0


def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found_by(queries.op13(spark, sf)), dict(plain_nearest(rows))
    assert set(got) == {q for q, near in want.items() if near}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.95 * sum(len(near) for near in want.values())
