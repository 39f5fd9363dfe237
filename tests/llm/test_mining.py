"""Collocations, alignment and nearest neighbours against brute force."""

import json
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from conftest import SMALL
from tastegrid.llm import alignment, bpe, collocations, neighbours

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

SCHEMA = "rank int, doc_id long, text string, lang string, phrase string"
ODD = [
    (1, 1, None, "en", "x"), (1, 2, "", "en", None), (1, 3, " \t ", "en", ""), (1, 4, "!!.,;", None, "x"), (1, None, "A b\tA  b A b", None, "x"),
    (1, 5, "a b\x0ba b\ra b\nb c a", "und", "x"), (1, 5, "a b\x0ba b\ra b\nb c a", "und", "x"), (1, 6, "É é \x00 \x1c É é \x00 \x1c", "fr", "x"),
    (1, 7, "one two three four " * 3000, "big", "x"), (1, 8, "x" * 3000 + " y z", "big", "x"), (1, 9, "lone", "one", "x"),
]


def phrases(rows, least, covered, most):
    """Plain counting of all runs of one to three words."""
    lower, counts = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}
    for text, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            c.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        candidates = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        longest = Counter()
        for k, v in candidates.items():
            for s in (k[:2], k[1:]) if len(k) == 3 else ():
                longest[s] = max(longest[s], v)
        found = []
        for k, a in candidates.items():
            if len(k) == 2 and longest[k] and 100 * longest[k] >= covered * a:
                continue
            s, _, x, y = min((10**6 * a * a // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            found.append((-s, -a, " ".join(k).encode(), x, y))
        n = sum(v for k, v in c.items() if len(k) == 1)
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, covered, run, block, hot", [(2, 50, 1_500_000, 1 << 20, 4_000_000), (1, 80, 40, 16, 5), (3, 50, 500, 100, 50)])
def test_phrases(spark, frame, monkeypatch, least, covered, run, block, hot):
    monkeypatch.setattr(collocations, "RUN_TOKENS", run)
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = frame(ODD, SCHEMA).union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("1", "doc_id", "text", "lang", "'x'"))
    got = collocations.mine(docs, least=least, covered=covered, most=300, hot_entries=hot)
    want = phrases([(r.text, r.lang) for r in docs.collect()], least, covered, 300)
    assert sorted(map(tuple, got.collect())) == want


def test_runs_join_across_flushes(monkeypatch):
    """Every place counts once, wherever a run ends."""
    text = b"A b c, d e f g h! a b c d  e\tf"
    want = Counter()
    for w in (x.split() for x in re.split(b"[,!]", text.lower())):
        want.update(zip(w, [*w[1:], b""]))
    for run in range(1, 12):
        for block in (1, 4, 100):
            monkeypatch.setattr(collocations, "RUN_TOKENS", run)
            monkeypatch.setattr(collocations, "BLOCK", block)
            r, got = collocations.Runs(1, None), Counter()
            for prefix, nexts, counts in [*r.add(text), *r.flush()]:
                for p, ns, cs in zip(prefix.to_pylist(), nexts.to_pylist(), counts.to_pylist()):
                    got.update({(p.encode(), n.encode()): c for n, c in zip(ns, cs)})
            assert got == want


def test_no_documents(frame):
    assert collocations.mine(frame([], SCHEMA)).count() == 0


def alignment_rows(rows):
    """One text after the other, with sets and lists."""
    a_tool, b_tool = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tool.encode_special_tokens = True
    back = {c: b for b, c in enumerate(bpe.byte_letters())}
    spelled = {i: bytes(back[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items() if t != "<|endoftext|>"}

    def piece(i):
        p = b_tool.IdToPiece(i)
        return bytes([int(p[3:5], 16)]) if b_tool.IsByte(i) else p.replace("\u2581", " ").encode()

    def ends(sizes):
        at, out = 0, []
        for n in sizes:
            at += n
            out.append(at)
        return out

    texts, held = [], Counter()
    for key, text in rows:
        groups = []
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            if b"".join(map(spelled.get, a)) == b"".join(map(piece, b)) == (" " + text).encode():
                a_ends, b_ends = ends(len(spelled[i]) for i in a), ends(len(piece(i)) for i in b)
                i = j = 0
                for e in sorted(set(a_ends) & set(b_ends)):
                    x, y = a_ends.index(e, i) + 1, b_ends.index(e, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        links = Counter()
        for xs, ys in groups:
            for x, n in Counter(xs).items():
                for y, m in Counter(ys).items():
                    links[x, y] += n * m
        texts.append((key, groups, links))
        held.update(links.keys())
    best = Counter()
    for (x, _), c in held.items():
        best[x] = max(best[x], c)
    out = []
    for key, groups, links in texts:
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            str(key), sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for (x, y), n in links.items() if held[x, y] == best[x]), sum(n * held[k] for k, n in links.items()),
            sha256(named.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


TEXTS = [
    None, "", " ", "a", "a  b", "\n\n x", "x \n", "don't stop", "é ß 漢字 漢字", "😀😀 ok", "a<|endoftext|> b</s> <s>", "▁ ▁a", "tab\tx",
    "\x00\x1c\x85", "word " * 50, "aaaa" * 300, "aab" * 700, "漢字仮名" * 200, "￿ ໠ ꟛ", "The the THE", "<0x41> A", "e\u0301 ﬁ",
]


@pytest.mark.parametrize("shuffled", [False, True])
def test_alignment(spark, frame, monkeypatch, shuffled):
    # tasks run in workers with the default of LARGE; the next test changes it
    if shuffled:
        monkeypatch.setattr(alignment, "PAIRS_BROADCAST", -1)
    own = frame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, "a", 1, "x"), (None, "null key", 1, "x"), (3, "a", 1, "x")],
                "doc_id long, text string, row int, even string")
    docs = own.union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 100", "text", "1", "'x'"))
    got = alignment.measure(docs, A, B).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == alignment_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_count_alike(monkeypatch):
    tool = alignment.sides(A, B)
    plain = alignment.align(tool, [t or "" for t in TEXTS])
    monkeypatch.setattr(alignment, "LARGE", 0)
    for x, y in zip(plain, alignment.align(tool, [t or "" for t in TEXTS])):
        assert str(x) == str(y) if isinstance(x, list) else x.equals(y)


def test_sides_are_the_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    chars = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + chr(c) + "  " + chr(c) + "1" for c in chars]
    tool = alignment.sides(A, B)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert tool._a.encode_ordinary(text) == want.ids


def test_no_alignment(frame):
    assert alignment.measure(frame([], "doc_id long, text string"), A, B).count() == 0


VECTORS = "rank int, vec_id long, embedding array<double>, q long"


def nearest(rows, k, every):
    """All rows compared with all queries."""
    sound = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    rows = [(i, tuple(v)) for i, v in rows if i is not None and sound(v)]
    out = []
    for i, v in {r for r in rows if r[0] % every == 0}:
        others = list(rows)
        others.remove((i, v))
        scored = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), j) for j, w in others if len(w) == len(v))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def same_lists(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12, atol=1e-12)


def test_nearest_odd_rows(frame):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.integers(-3, 4, 3).astype(float).tolist()) for i in range(200)]  # many ties, equal rows and zeros
    rows += [(i, rnd.normal(size=5).tolist()) for i in range(300, 310)]  # fewer than k of this length
    rows += [(400, None), (405, []), (410, [0.0, 0.0, 0.0]), (415, [1.0, None, 2.0]), (420, [float("nan"), 1.0, 1.0]), (425, [float("inf"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (10, [9.0, 9.0, 9.0]), (430, [1.0])]
    rows += [(500 + i, [2.0, 1.0, 2.0]) for i in range(60)]  # more copies than a list is long
    vectors = frame([(1, i, v, 7) for i, v in rows], VECTORS)
    got = neighbours.search(vectors, F.col("vec_id") % 5 == 0, k=8).collect()
    same_lists(sorted(map(tuple, got)), nearest(rows, 8, 5))
    assert neighbours.search(frame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
    assert neighbours.search(vectors, F.lit(False)).count() == 0


def test_nearest_recall(frame):
    """Clusters of several densities and lengths, searched through many small cells."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16)) * rnd.lognormal(0, 0.3, size=(40, 1))
    x = centres[rnd.integers(0, 40, 4000)] + rnd.normal(size=(4000, 16)) * 0.3
    vectors = frame([(1, i, v, 7) for i, v in enumerate(x.tolist())], VECTORS)
    got = {(r[0], r[2]) for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20, rows_per_cell=50).collect()}
    want = {(r[0], r[2]) for r in nearest(list(enumerate(x.tolist())), 20, 20)}
    assert len(got) == len(want) == 4000
    assert len(got & want) >= 0.93 * len(want)


def test_short_queries_see_every_row(frame):
    """One visited cell finds too few rows: all are compared then."""
    rnd = np.random.default_rng(6)
    rows = list(enumerate((rnd.normal(size=(300, 4)) * 2).tolist()))
    vectors = frame([(1, i, v, 7) for i, v in rows], VECTORS)
    got = neighbours.search(vectors, F.col("vec_id") % 10 == 0, k=250, rows_per_cell=2, target=0.01).collect()
    same_lists(sorted(map(tuple, got)), nearest(rows, 250, 10))


def test_visits_follow_the_distance():
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(500, 6))
    t = neighbours.Tables.fit(x, float(np.sqrt((x * x).sum(1).max())), 2, 3, 1.0, 1)
    q = t.queries(x[:5])
    at = t.project(q) + t.shift[:, None]
    for table in range(2):
        names = t.visited(x[:5], table)
        for j in range(5):
            costs = []
            for name in names[j].tolist():
                cost = 0.0
                for a in (2, 1, 0):
                    n = int(t.high[table, a] - t.low[table, a] + 1)
                    name, s = divmod(name, n)
                    lo = -np.inf if s == 0 else (s + t.low[table, a]) * t.width[table, a]
                    hi = np.inf if s == n - 1 else (s + t.low[table, a] + 1) * t.width[table, a]
                    cost += max(lo - at[table, j, a], at[table, j, a] - hi, 0) ** 2
                costs.append(cost)
            assert np.allclose(costs, sorted(costs)) and len(set(names[j].tolist())) == len(costs)


def test_best_of_a_task():
    """What is left after pruning is what a plain sort leaves, whatever came in between."""
    rnd = np.random.default_rng(8)
    best, kept = neighbours.Best(3), {}
    for _ in range(30):
        names = [(int(q), 7) for q in rnd.choice(6, 4, replace=False)]
        asked = best.numbered(names)
        j = np.repeat(np.arange(4), 5)
        rep, score = rnd.integers(0, 40, 20), rnd.integers(0, 50, 20) / 8.0
        score = np.array([kept.setdefault((names[a], r), s) for a, r, s in zip(j.tolist(), rep.tolist(), score.tolist())])
        best.add(asked[j], pa.array(rep), pa.array(rep * 10), score)
        if rnd.random() < 0.3:
            best.prune()
    best.prune()
    got = {(x["q"], x["rep"]): x["score"] for b in best.rows(pa.int64()) for x in b.to_pylist()}
    want = {}
    for q in range(6):
        own = sorted(((s, r) for (n, r), s in kept.items() if n[0] == q), reverse=True)
        want |= {(q, r): s for s, r in own if s >= own[min(2, len(own) - 1)][0]}
    assert got == want and best.held == 0
