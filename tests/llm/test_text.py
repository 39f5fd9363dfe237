"""Decontamination, language identification, the language model and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from tastegrid.llm import gru, language, language_model, positional
from test_near import brute_fingerprint, roots

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_hits(docs, items, length):
    """By row: words, hit positions, items."""
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    cuts = [(i, w[s : s + length]) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - length + 1))]
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in cuts:
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(str(i))
        out.append((k, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "The quick brown fox jumps"), (2, "ONE"), (3, ""), (4, None), (5, "a b"), (6, "brown fox jumps over it all"), (10, "é à É x y z"), (7, "rare the the the the"), (8, "One")]
TEXTS = [
    (1, "the Quick, brown fox jumps over it all day"), (2, None), (3, ""), (4, "one a b one"), (5, "the the the the the the"), (5, "rare the the the the"),
    (5, "rare the the the the"), (None, "é à É x y z"), (None, "nothing"), (6, "a 1 b a b2"), (7, "quick brown fox jumps"), (8, "É à é x y z"), (9, "x " * 4000 + "a b"),
]
SHAPE = "contaminated int, doc_id long, text string, w string"


def test_positional(frame):
    docs = frame([(0, k, t, "") for k, t in TEXTS], SHAPE)
    items = frame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in positional.contamination(docs, items, length=4).collect()]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted(brute_hits(TEXTS, ITEMS, 4), key=key)
    kept = positional.clean(docs, items, length=4)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(k), t or "") for (k, t), b in zip(TEXTS, brute_hits(TEXTS, ITEMS, 4)) if not b[5])
    none = positional.contamination(docs, items.limit(0)).toPandas()
    assert len(none) == len(TEXTS) and not none["contaminated"].any() and set(none["items_sha256"]) == {sha256(b"").hexdigest()}
    assert positional.contamination(docs.limit(0), items).count() == 0


def test_positional_counts_a_null_item(frame):
    docs = frame([(1, "aa bb cc dd"), (2, "aa bb cc dd ee ff gg hh"), (3, "zz")], "doc_id long, text string")
    items = frame([(None, "aa bb cc dd"), (None, "bb cc dd"), (7, "ee ff gg hh")], "item_id long, text string")
    got = {r.doc_id: r for r in positional.contamination(docs, items, length=4).collect()}
    assert [(got[i].contaminated, got[i].n_items) for i in (1, 2, 3)] == [(True, 1), (True, 2), (False, 0)]
    assert [got[i].items_sha256 for i in (1, 2)] == [sha256(x).hexdigest() for x in (b"", b"7")]


def test_positional_without_broadcast(frame, monkeypatch):
    monkeypatch.setattr(positional, "TERMS_BROADCAST", 0)
    test_positional(frame)


def test_proximity(frame):
    docs = frame([(1, "aa bb x cc dd ee"), (2, "aa bb cc dd ee"), (3, "aa bb x y z cc dd ee")], "doc_id long, text string")
    terms = positional.window_terms(positional.windows(frame([(1, "aa bb zz cc dd ee aa bb")], "i long, t string"), "i", "t", 2)).where("w != 'zz' and nxt != 'zz'")
    near = positional.window_terms(positional.windows(frame([(1, "bb cc dd ee")], "i long, t string"), "i", "t", 3))
    postings, _ = positional.index(docs, "doc_id", "text", near.union(terms))
    assert {r.doc_id for r in positional.matches(postings, "doc_id", near).where("win = 'bb cc dd'").collect()} == {2}
    spread = near.where("win = 'cc dd ee'")
    assert {r.doc_id for r in positional.matches(postings, "doc_id", spread, slop=1).collect()} == {1, 2, 3}


def numeric(f, w, i):
    old, e = w.flat[i], 1e-2
    w.flat[i] = old + e
    up = f()
    w.flat[i] = old - e
    down = f()
    w.flat[i] = old
    return (up - down) / (2 * e)


def test_bidirectional_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], 4)
    symbols, targets = rng.integers(0, 256, (9, 5)), rng.integers(0, 3, 5)
    loss = lambda: -np.log(net.probabilities(symbols)[:, targets, np.arange(5)].astype(np.float64)).mean()
    grads = net.gradients(symbols, targets)
    for name, w in net.weights().items():
        used = symbols.ravel()[0] if name.endswith("table") else 0
        for i in (used, used + w.shape[1] if w.ndim > 1 and w.shape[0] > 1 else used):
            assert grads[name].flat[i] == pytest.approx(numeric(loss, w, i), abs=2e-4)


def test_language_model_gradients_and_carried_state(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_model.Model(rng.integers(1, 50, 20).astype(float), 5, 4, 2)
    for w in model.weights.values():
        w += (rng.normal(size=w.shape) * 0.2).astype(np.float32)
    docs = [rng.integers(0, 20, n) for n in (7, 3, 11)]
    held = {}

    class Catch:
        def gather(self, grads, size, least):
            for k, g in grads.items():
                held[k] = held.get(k, 0) + g * size

        def flush(self, least):
            pass

    model.run(docs, Catch())
    for name, i in [("g.table", 3), ("g.back", 2), ("class.w", 1), ("class.b", 0), ("word.w", 9), ("word.b", 5)]:
        assert -held[name].flat[i] == pytest.approx(numeric(lambda: model.run(docs).sum(), model.weights[name], i), abs=2e-2)
    whole = model.run(docs)
    monkeypatch.setattr(language_model, "SPAN", 2)
    assert np.allclose(model.run(docs), whole, atol=1e-4) and np.allclose(model.run(docs[::-1])[::-1], whole, atol=1e-4)
    # one word at a time, the probabilities of all symbols add up to one
    total = sum(math.exp(model.run([np.array([s])])[0]) for s in range(20))
    assert total == pytest.approx(1, abs=1e-4)


def test_few_tokens_teach_too():
    """Less than one step's tokens make a smaller step; none are thrown away."""
    rng = np.random.default_rng(3)
    model = language_model.Model(np.ones(8), 5, 4, 2)
    docs = [np.array([2, 3, 2, 3, 2, 3, 2, 3, 0] * 5) for _ in range(10)]
    assert sum(map(len, docs)) < 500 < language_model.STEP_TOKENS
    before, step = model.run(docs).sum(), gru.Adam(model.weights, 0.01)
    for _ in range(50):
        model.run(docs, step)
    assert step.held_size == 0 and step.step == 50 and model.run(docs).sum() > before + 50
    # the size of the step follows the share
    whole, part = {"w": np.zeros(3, np.float32)}, {"w": np.zeros(3, np.float32)}
    grads = {"w": rng.normal(size=3).astype(np.float32)}
    a, b = gru.Adam(whole, 0.1), gru.Adam(part, 0.1)
    a.gather(dict(grads), 100, 100)
    b.gather(dict(grads), 25, 100)
    b.flush(100)
    assert np.allclose(whole["w"], 4 * part["w"])


def held(k, n):
    return zlib.crc32(("" if k is None else str(k)).encode()) % n


def test_language(spark, frame):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "lang", "7 AS score")
    odd = [(5001, None, "en", 0), (5002, "", "en", 0), (5003, "123 !!", "de", 0), (None, "the and of to in is was", None, 0), (5004, "x" * 9000, "fr", 0)]
    both = docs.union(frame(odd, "doc_id long, text string, lang string, score int"))
    got = language.identify(both).toPandas()
    want = {r.doc_id: r.lang for r in both.collect()}
    assert len(got) == len(want) and got["score"].between(0, 1).all() and set(got["lang_pred"]) <= {"en", "de", "fr", "es", "und"}
    test = got[got["held_out"] & (got["doc_id"] < 5000)]
    assert (test["lang_pred"] == test["doc_id"].map(want)).mean() > 0.9
    assert all(got["held_out"] == [held(None if pd.isna(k) else int(k), 4) == 2 for k in got["doc_id"]])
    assert set(got[got["doc_id"].isin([5001, 5002, 5003])]["lang_pred"]) == {"und"}
    unlabelled = language.identify(both.limit(20).withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert set(unlabelled["lang_pred"]) == {"und"} and set(unlabelled["score"]) == {0.0}
    assert language.identify(docs.limit(0)).count() == 0
    assert language.identified(both).columns == both.columns


def test_whole_texts_are_read():
    """Every byte counts once, whatever the cut into windows."""
    net = language.Network(["a", "b"], 3)
    net.out["bias"][:] = [[0.0], [0.0]]
    text = bytes(range(97, 120)) * 40
    got = language._read(net, [text, text[:5], text[: language.WINDOW + 1]])
    assert np.allclose(got.sum(1), 1, atol=1e-5)


def test_language_model(spark, frame):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "lang AS score")
    odd = frame([(5001, None, ""), (5002, " \t", ""), (None, "unseen zqzqzq words", ""), (5003, "The the THE", ""), (5003, "The the THE", "")], "doc_id long, text string, score string")
    both = docs.union(odd)
    split = language.remainder(F.col("doc_id"), 5) == 1
    got = language_model.scores(both, split, sample_tokens=20_000, vocabulary=300).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in both.collect()]
    c = Counter(w for k, ws in rows if held(k, 5) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), held(k, 5) == 1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for k, ws in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert language_model.scores(both, F.lit(True)).count() == len(rows)
    assert language_model.scores(both.limit(0), split).count() == 0


def test_pipeline(spark):
    """Every stage decides as brute force does on what the stages before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    net = language.train(docs, "doc_id", "text", "lang", language.remainder(F.col("doc_id"), 4) == 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    names, scores = language.judge(net, list(texts.values()))
    left = {k: t for (k, t), name, s in zip(texts.items(), names, scores) if name != "und" and s >= 0.35}
    fp = {k: brute_fingerprint(t, 5) for k, t in left.items()}
    root = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 7])
    left = {k: t for k, t in left.items() if root[k] == k}
    left = {k: t for (k, t), b in zip(left.items(), brute_hits(left.items(), items, 10)) if not b[5]}
    assert set(got) == set(left) and len(left) < len(texts)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in left.items():
        ids = tool.encode(t, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == sha256(t.encode()).hexdigest()


def test_stages_keep_columns(spark, frame):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"_text": F.lit(1), "score": F.lit("s"), "rep": F.lit(2), "fp": F.lit(3)})
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, SMALL)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        assert step(spark, docs.limit(0), SMALL).count() == 0
