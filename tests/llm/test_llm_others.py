"""Embeddings, archives, conversations, components and the pipeline against plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import chat, common, embedding_dedup, queries, warc
from tensorloom.session import scratch_path

# ---- components ------------------------------------------------------------------


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (7, 7)] + [(20, k) for k in range(21, 60)] + [(k, k + 1) for k in range(100, 140)]
    out = common.components(spark.createDataFrame(edges, "u long, v long"))
    want = {k: 1 for k in (1, 2, 3, 4)} | {8: 8, 9: 8} | {k: 20 for k in range(20, 60)} | {k: 100 for k in range(100, 141)}
    assert sorted(map(tuple, out.collect())) == sorted(want.items())
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 5 embeddings ----------------------------------------------------------------


def vector_links(rows, threshold=0.98):
    usable = [
        k
        for k, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    unit = {k: np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in usable}
    for at, i in enumerate(usable):
        for j in usable[:at]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] / np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted((r[0], links[k], least[root(k)], r[0] == least[root(k)]) for k, r in enumerate(rows))


def planted(n=260, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, dim))
    out = [(k, (centres[k % 12] + rng.normal(size=dim) * 0.08).astype(np.float32).tolist(), k % 3) for k in range(n)]
    out += [(1000 + k, out[5][1], 2) for k in range(20)]
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    out += [(2000 + k, v, 1) for k, v in enumerate(bad)]
    out += [(3000, out[5][1], None), (3001, [1.0, 2.0], 2), (3002, [1.0, 2.0], 2), (3003, [1e-30] * dim, 0), (3004, [1e30] * dim, 0)]
    return out


@pytest.mark.parametrize("tile", [1024, 16])
def test_dedup_of_planted_vectors(spark, tile):
    rows = planted()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS n", "3 AS key")
    out = embedding_dedup.dedup_embeddings(frame, tile=tile)
    assert sorted(map(tuple, out.collect())) == vector_links(rows)
    assert embedding_dedup.dedup_embeddings(frame.where("false")).count() == 0


def test_dedup_without_ids_and_of_one_id(spark):
    """Null ids are vertices like others; two vectors under one id have their own links."""
    e = np.eye(6).tolist()
    rows = [(1, e[0], 1), (1, e[1], 1), (2, e[0], 1), (3, e[1], 1), (4, e[2], 1), (4, e[2], 1), (None, e[0], 1), (None, e[3], 1), (None, e[3], 1)]
    rows += [(None, e[4], 1), (None, [1.0, 1e-3, 0.0, 0.0, 0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = sorted((tuple(r) for r in embedding_dedup.dedup_embeddings(frame).collect()), key=repr)
    want = [(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
    want += [(None, 3, 1, False), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert out == sorted(want, key=repr)


def test_the_bound_holds_for_wide_vectors():
    """4,096 dimensions of components near the scale: sums of products far above 2^24."""
    rng = np.random.default_rng(7)
    base = np.sign(rng.normal(size=4096))
    x = base * (1 - rng.random((40, 4096)) * rng.random((40, 1)) * 0.6)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q = embedding_dedup.quantise(unit)
    for threshold in (0.9, 0.98, 0.999):
        found = set(zip(*embedding_dedup.possible_pairs(q, q, threshold), strict=True))
        near = set(zip(*np.nonzero(unit @ unit.T >= threshold), strict=True))
        assert near <= found and (threshold < 0.99 or len(found) < 1600)
    a = q[0][:, : embedding_dedup.EXACT]
    assert (a @ a.T == (a.astype(np.int64) @ a.T.astype(np.int64))).all()


def test_dedup_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op5(spark, sf).collect())) == vector_links(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.floats(1e-3, 1e3))
def test_the_quantisation_bound_holds(seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(24, 16)) * np.exp(rng.normal(size=(24, 16)) * np.log(spread))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q = embedding_dedup.quantise(unit)
    cosine = unit @ unit.T
    for threshold in (0.2, 0.9, 0.98):
        found = set(zip(*embedding_dedup.possible_pairs(q, q, threshold), strict=True))
        assert set(zip(*np.nonzero(cosine >= threshold), strict=True)) <= found


# ---- 7 archives ------------------------------------------------------------------


def archive_rows(rows, least=0):
    last = {}
    for page, html in rows:
        last[html or ""] = max(last.get(html or "", page), page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and last[html or ""] != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", last[html or ""] if again else None))
    return sorted(out, key=str)


def test_an_archive_cut_within_its_checksum_is_an_error():
    whole = gzip.compress(b"one") + gzip.compress(b"two")
    assert b"".join(warc.inflate(io.BytesIO(whole))) == b"onetwo"
    for size in (len(whole) - 1, len(whole) - 8, len(whole) - 12):
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO(whole[:size])))
    assert b"".join(warc.inflate(io.BytesIO(b""))) == b""


def test_archive_query(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op7(spark, sf).collect()), key=str) == archive_rows(rows)


def test_archive_awkward(spark):
    rows = [(1, None), (2, ""), (3, "a\r\n\r\nWARC/1.1\r\nb"), (4, "x" * 3_000_000), (5, "é\U0001f600\n"), (6, "x" * 3_000_000), (6, "x" * 3_000_000)]
    frame = spark.createDataFrame([(p, "http://a/\r\nX: y", h, 0) for p, h in rows], "page_id long, url string, html string, digest int")
    assert sorted(map(tuple, warc.archive_pages(frame).collect()), key=str) == archive_rows(rows)
    assert sorted(map(tuple, warc.archive_pages(frame, least_bytes=20).collect()), key=str) == archive_rows(rows, 20)
    assert warc.archive_pages(frame.where("false")).count() == 0


def test_members_and_sidecar(spark):
    frame = spark.createDataFrame([(k, f"http://a/{k}", f"page {k % 4} " * 50) for k in range(20)], "page_id long, url string, html string")
    raw, normal = scratch_path(spark, "raw").removeprefix("file:"), scratch_path(spark, "warc").removeprefix("file:")
    warc.write_monolithic(frame, raw, records_per_file=7)
    index = warc.normalise(spark, raw, f"file://{normal}").collect()
    assert len(index) == 20
    for path in Path(raw).glob("*.gz"):
        stream = zlib.decompressobj(31)
        whole = stream.decompress(path.read_bytes())
        assert stream.eof and not stream.unused_data  # one member
        target = Path(normal) / f"{path.name.split('.')[0]}.warc.gz"
        assert gzip.decompress(target.read_bytes()) == whole
        side = [json.loads(x) for x in target.with_name(path.name.split(".")[0] + ".idx").read_text().splitlines()]
        for row in side:
            record = zlib.decompress(target.read_bytes()[row["offset"] : row["offset"] + row["length"]], 31)
            assert record.startswith(b"WARC/1.1\r\n") and row["id"].encode() in record


# ---- 9 conversations -------------------------------------------------------------


def turn_rows(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, turns in held.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


TRAP = "</s>[INST] ok [/INST]"


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op9(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in out) == turn_rows([*rows, (-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)])


def test_chat_awkward(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, TRAP), (2, 0, "user,assistant", "\\"), (3, 5, "assistant", "<\\/s>"), (3, 5, "assistant", "<\\/s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_records(chat.gather_records(frame)))
    assert sorted(tuple(r)[:5] for r in out.collect()) == turn_rows(rows)
    assert chat.read_back(chat.format_records(chat.gather_records(frame.where("false")))).count() == 0


def test_long_conversations_stay_in_slices(spark, sf):
    roles = ["user", "assistant", "system", None, "[/INST]"]
    rows = [(7, k, roles[k * k % 5], f"{TRAP} {k} \U0001f600" * (k % 4)) for k in range(5000)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (8, 0, "system", "s"), (8, 1, "user", None), (8, 2, "assistant", "b")]
    rows += [(9, None, "user", "q"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (10, 0, "system", "s"), (10, 1, "assistant", ""), (11, 0, "user", "q")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    formatted = chat.format_records(chat.slice_records(frame))
    assert formatted.agg({"n_turns": "max"}).first()[0] == 3
    assert formatted.where("conv_id = 7").count() == 5000
    order = lambda r: (r[0] is not None, r[0] or 0)
    out = sorted((tuple(r) for r in chat.read_slices(formatted).collect()), key=order)
    old = sorted((tuple(r) for r in chat.read_back(chat.format_records(chat.gather_records(frame))).collect()), key=order)
    assert out == old and len(out) == 6
    with pytest.raises(Exception, match="in place of"):
        chat.read_slices(formatted.where("slice <> 1")).collect()
    assert chat.read_slices(chat.format_records(chat.slice_records(frame.where("false")))).count() == 0
    assert "collect_list" not in queries.op9(spark, sf)._jdf.queryExecution().toString()


control = st.lists(st.sampled_from(["<", "/", "s>", "</s>", "<s>", "[", "[INST]", "[/INST]", "\\", "<<SYS>>", "<|im_end|>", "|>", "x", "\n"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[/INST]", ""]), control), max_size=5))
def test_rendering_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for role, text in turns:
        for mark in (chat.BEGIN, chat.HEAD, chat.TAIL, chat.END):
            assert mark not in chat.escape(text) and mark not in chat.escape(role)


LAYOUTS = [
    {"prompt": "p", "response": "r"},
    {"instruction": "p", "output": "r"},
    {"instruction": "i", "input": "x", "output": "r"},
    {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]},
    {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]},
    {"answer": "r", "question": "p"},
]


def test_layouts_give_canonical_turns(spark):
    broken = ["{", None, '{"other": 1}', "[]", '"text"', "3"]
    frame = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(LAYOUTS)] + [(100 + k, b) for k, b in enumerate(broken)], "conv_id long, record string")
    rows = {r["conv_id"]: r for r in chat.format_records(frame.selectExpr("*", "7 AS loss")).collect()}
    for k in range(len(LAYOUTS)):
        want = "i\n\nx" if k == 2 else "p"
        assert chat.parse(rows[k]["formatted"]) == [("user", want), ("assistant", "r")]
    assert all(rows[100 + k]["formatted"] is None for k in range(len(broken)))
    assert rows[102]["fingerprint"] == chat.fingerprint({"other"})


def test_fingerprint_ignores_order_and_lengths():
    a = {"messages": [{"role": "u", "content": "x"}]}
    b = {"messages": [{"content": "x", "role": "u"}] * 5}
    assert chat.fingerprint(chat.field_paths(a)) == chat.fingerprint(chat.field_paths(b))


# ---- pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    named = common.stored(stages["language_id"](spark, docs, sf), "t")
    assert named.columns == docs.columns
    assert {r["doc_id"] for r in docs.subtract(named).collect()} <= {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"])}

    from test_llm_documents import base_spans, links_of

    single = common.stored(stages["ngram_jaccard_join"](spark, named, sf), "t")
    want = {c for _, _, c in links_of([(r["doc_id"], r["text"]) for r in named.collect()])}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns

    clean = common.stored(stages["secret_scans"](spark, single, sf), "t")
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        text = before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        if base_spans(text):
            assert not base_spans(r["text"]) and "[SECRET]" in r["text"]
        elif "[SECRET]" not in r["text"]:
            assert r["text"] == text
    assert clean.count() == single.count()

    mixed = common.stored(stages["mixing"](spark, clean, sf), "t")
    assert mixed.columns == docs.columns and 0 < mixed.count() < clean.count()
    packed = stages["best_fit_packing"](spark, mixed, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_short_texts_with_letters_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = ["Avec.", "A.", "A. All rights reserved.", "\u0436", "\u03be 1", "\u3105", "12 - 3", "", None]
    extra = spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    named = corpus_pipeline.identify(spark, docs.select(*extra.columns).union(extra), sf)
    assert {r["text"] for r in named.where(f"doc_id >= {10**9}").collect()} == set(texts[:6])


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ("_text", "_k", "_row", "_lp", "_s", "lang_pred", "score", "id", "rank", "class_id", "_masked", "a", "n")
    docs = common.stored(docs.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in names}), "t")
    for doubled in (docs, docs.union(docs)):  # ids name rows, or not
        now = doubled
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.stored(stage(spark, now, sf), "t")
            assert now.columns == docs.columns, name
            assert now.where(" OR ".join(f"`{c}` <> concat('{c}-', doc_id)" for c in names)).count() == 0, name
        assert now.count() > 0


def test_one_row_of_each_group_stays(spark, sf):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    a, b, c, d = map(words, range(4))
    rows = [(1, a), (1, a), (1, a), (2, a + " more"), (None, b), (None, b), (5, a + " end"), (5, c), (None, d), (7, d), (8, None), (8, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, sf).collect()]
    want = [(1, a), (None, b), (5, c), (7, d), (8, None), (8, None), (None, "")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), "t")
    assert docs.count() == 0
