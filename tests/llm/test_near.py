"""SimHash, lattice hashing, components, sharding and url verdicts against brute force."""

import math
import random
import struct
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
import xxhash

from conftest import SMALL
from tastegrid.llm import graph, hosts, lattice, shards, simhash
from tastegrid.llm.queries import URL_RULES

DOCS = "component_id int, doc_id long, text string, fp string"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def near_texts():
    rnd = random.Random(4)
    out, vocabulary = {}, [f"w{i}" for i in range(300)]
    for g in range(12):
        base = rnd.choices(vocabulary, k=300)
        for c in range(rnd.choice([1, 1, 3, 20])):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            out[len(out)] = " ".join(w)
    for t in [None, "", " \t", "one", "one", "A b C", "a B c", "x " * 3000, "a b", "word é ß"]:
        out[len(out)] = t
    return out


@pytest.mark.parametrize("distance, segments, ring, k", [(4, 3, None, 4), (4, 2, None, 4), (1, 3, None, 5), (7, None, 4, 5), (6, 4, 2, 4)])
def test_simhash(frame, near_texts, distance, segments, ring, k):
    rows = [(0, i, t, "x") for i, t in near_texts.items()]
    got = simhash.near_duplicates(frame(rows + rows[:3], DOCS), words_per_shingle=k, distance=distance, segments=segments, ring=ring).toPandas()
    assert len(got) == len(rows) + 3 and list(got.columns) == ["doc_id", "fingerprint", "component_id"]
    fp = {i: brute_fingerprint(t, k) for i, t in near_texts.items()}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= distance]
    want = roots(fp, pairs)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.itertuples()} == {(i, f"{x:016x}", want[i]) for i, x in fp.items()}


def test_simhash_odd_ids(frame):
    rows = [(0, 5, "a b c d e", ""), (0, 5, "q r s t u", ""), (0, 9, "q r s t u", ""), (0, None, "a b c d e", ""), (0, None, "only here x", "")]
    got = simhash.near_duplicates(frame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 5)]
    left = simhash.one_per_group(frame(rows, DOCS)).collect()
    assert sorted(r.doc_id or -1 for r in left) == [-1, -1, 5] and left[0].asDict().keys() == {"component_id", "doc_id", "text", "fp"}
    assert simhash.near_duplicates(frame([], DOCS)).count() == 0


def test_segment_count():
    assert simhash.cheapest_segments(200_000, 4) == 3 and simhash.cheapest_segments(200_000, 7) == 4
    assert simhash.cheapest_segments(10**9, 7) < 4
    for distance in range(64):
        for n in (0, 1, 10**6, 10**12):
            assert simhash._asks(simhash.cheapest_segments(n, distance), distance) <= simhash.MOST_ASKS
    for distance in (-1, 64):
        with pytest.raises(ValueError):
            simhash.cheapest_segments(5, distance)


def test_simhash_without_rows(frame):
    empty = frame([], DOCS)
    for distance in (4, 7):
        assert simhash.near_duplicates(empty, distance=distance, segments=None).count() == 0
        assert simhash.one_per_group(empty, distance=distance, segments=None, ring=4).count() == 0
    lost = simhash.near_duplicates(frame([(0, None, "a b", "")] * 2, DOCS), segments=None).collect()
    assert [r.component_id for r in lost] == [None, None]
    with pytest.raises(ValueError):
        simhash.links(frame([(1, 1)], "rep long, fp long"), distance=7, segments=1)


def test_simhash_string_ids(frame):
    rows = [(0, "b", "x y z w", ""), (0, "a", "X Y Z w", ""), (0, "c", "other words are here", "")]
    docs = frame(rows, "component_id int, doc_id string, text string, fp string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_links_come_once(frame, near_texts):
    fps = sorted({brute_fingerprint(t, 4) for t in near_texts.values()})
    found = frame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "rep long, fp long")
    got = [tuple(sorted(r)) for r in simhash.links(found).collect()]
    want = sorted((b, a) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4)
    assert sorted(got) == want


def test_multiplied_fingerprints_are_not_broadcast(frame):
    # at Spark's own limit of 10 MB: the file of the fingerprints is small, the rows asked for are 67 times as many
    found = simhash.stage(frame([(i, i * 7919) for i in range(2000)], "rep long, fp long"), "found")
    for df in (simhash.links(found), simhash._classes(found, found.selectExpr("rep AS a", "rep + 1 AS b"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_components(frame):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rnd.randrange(900, 960), rnd.randrange(900, 960)) for _ in range(40)]
    got = {r.node: r.root for r in graph.components(frame(pairs + [(7, 7)], "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != r}
    assert graph.components(frame([], "a long, b long")).count() == 0


def test_lattice_points():
    """The decoder finds a point of E8 that no neighbour beats."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(500, 8)) * 3
    near = lattice.nearest_e8(x)
    assert len(lattice.shortest_vectors()) == 240 and np.allclose((lattice.shortest_vectors() ** 2).sum(1), 2)
    assert (np.isclose(near % 1, 0).all(1) | np.isclose(near % 1, 0.5).all(1)).all() and np.allclose(near.sum(1) % 2, 0)
    own = ((x - near) ** 2).sum(1)
    others = ((x[:, None] - near[:, None] - lattice.shortest_vectors()) ** 2).sum(2)
    assert (own[:, None] <= others + 1e-9).all()


def test_near_vectors(frame):
    rnd = np.random.default_rng(3)
    rows, where = [], "kept string, vec_id long, embedding array<double>, label int"
    for g in range(40):
        base = rnd.normal(size=64)
        for c in range(int(rnd.choice([1, 2, 12]))):
            noise = rnd.normal(size=64) * rnd.choice([0.0, 0.1, 0.25, 0.33])
            rows.append(("", len(rows), [float(v) for v in base + noise], int(g % 3)))
    rows += [("", 900, rows[0][2], None), ("", 901, None, 1), ("", 902, [0.0] * 64, 1), ("", 903, [float("nan")] * 64, 1), ("", 904, [1.0, None], 1)]
    rows += [("", 905, [1.0, 2.0], 1), ("", 906, [2.0, 4.0], 1), ("", 907, [1e300, 2e300], 1), ("", 908, [float("inf"), 1.0], 1), ("", 909, [], 1)]
    got = lattice.near_vectors(frame(rows, where)).toPandas().set_index("vec_id")
    unit = {r[1]: (r[3], len(r[2]), np.array(r[2]) / max(map(abs, r[2]))) for r in rows if r[3] is not None and r[2] and None not in r[2] and all(map(math.isfinite, r[2])) and any(r[2])}
    pairs = [(a, b) for a, (la, da, x) in unit.items() for b, (lb, db, y) in unit.items() if a < b and (la, da) == (lb, db) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93]
    n = Counter(x for p in pairs for x in p)
    found = got["n_links"].sum() / 2
    assert 0.9 * len(pairs) <= found <= len(pairs) and len(pairs) > 100
    assert all(got.loc[i, "n_links"] <= n[i] for i in got.index)
    if found == len(pairs):
        assert got["component_id"].to_dict() == roots(got.index, pairs)
    assert (got["kept"] == (got.index == got["component_id"])).all()
    assert all(got.loc[i, "n_links"] == 0 and got.loc[i, "kept"] for i in (900, 901, 902, 903, 904, 908, 909))
    again = frame([("", 1, [1.0, 0.0], 1), ("", 1, [1.0, 0.0], 1), ("", None, [1.0, 0.0], 1), ("", None, [0.0, 1.0], 1)], where)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in lattice.near_vectors(again).collect()) == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert lattice.near_vectors(frame([], where)).count() == 0


def test_shards(frame, spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "'x' AS size", "1 AS shard")
    odd = frame([(None, "a", "", 0), (3, None, "", 0), (3, None, "", 0), (4, "", "", 0)], "doc_id long, text string, size string, shard int")
    got = shards.assign(docs.union(odd), "doc_id", "text", [1.0] * 40, [1.0] * 41, rows_per_cell=2).toPandas()
    assert len(got) == 204 and set(got["law"]) == {"key"}
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) <= {40} and len(moved) < 25
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = got[got["doc_id"] == 17].iloc[0]
    assert one["size"] == len(texts[17].encode()) + 16 and one["text_crc32"] == crc32(texts[17].encode())
    assert set(got[(got["doc_id"] == 3) & (got["size"] == 16)]["text_crc32"]) == {0}
    assert shards.assign(odd.limit(0), "doc_id", "text", [1.0, 2.0]).count() == 0


def test_draws_are_recomputed(frame):
    """The winner of every key, drawn again with the hash of another library."""
    weights = [1.0, 2.0, 0.5, 3.0, 1.0]
    keys = [None, *range(-50, 250), 2**62, -(2**63)]

    def winner(key):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        best = []
        for i, w in enumerate(weights):
            drawn = xxhash.xxh64_intdigest(b"rendezvous", xxhash.xxh64_intdigest(struct.pack("<i", i), h)) >> 11
            best.append((-w / math.log((drawn + 0.5) / 2**53), -i))
        return -max(best)[1]

    got = shards.assign(frame([(k, "t") for k in keys], "id long, text string"), "id", "text", weights).collect()
    assert sorted((str(r.id), r.shard) for r in got) == sorted((str(k), winner(k)) for k in keys)


def test_shard_weights(spark):
    keys = spark.range(20_000).selectExpr("id", "'t' AS text")
    got = shards.assign(keys, "id", "text", [1.0, 2.0, 5.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert got.sum() == 20_000 and all(abs(got[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate((1, 2, 5)))
    assert shards.assign(keys, "id", "text", [1.0, 2.0]).where("grown_shard is not null").count() == 0


def test_url_rules(frame):
    urls = [
        ("https://A.COM/x?y#z", "a.com", "/x", "com/", "allow"), ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("x://b.net/es/q", "b.net", "/es/q", "net/es/", "block"),
        ("x://net/fr/", "net", "/fr/", "net/fr/", "block"), ("x://b.net/fr", "b.net", "/fr", None, "allow"), ("x://a.com", "a.com", "", None, "allow"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("a://b#c://d/e", "b", "", None, "allow"), ("x://É.com/", "É.com", "/", "com/", "allow"), ("x://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ]
    pages = frame([("h", i, u[0], None) for i, u in enumerate(urls)], "host string, page_id long, url string, html string")
    got = sorted(hosts.verdicts(pages, URL_RULES).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule) for r in got] == [u[1:4] for u in urls]
    assert [r.verdict for r, u in zip(got, urls) if u[3]] == [u[4] for u in urls if u[3]]
    assert hosts.verdicts(pages.limit(0), URL_RULES).count() == 0


def test_link_graph(frame):
    link = lambda *to: "<p>" + "".join(f'<A HREF="{t}">x</a> <a  href={t}>y</a>' for t in to)
    pages = [
        (1, "h://good.com/a", link("//mid.org/x", "/self")), (2, "h://mid.org/", link("http://far.org/", "h://bad.net/es/")),
        (3, "h://bad.net/es/1", link("rel")), (4, "h://bad.net/es/2", None), (5, "h://near.org/", link("h://bad.net/")), (6, "h://far.org/q", ""),
        (7, "h://bad.net/other", ""), (8, "h://bad.net/es/3", ""), (9, "h://farm.org/1", link("h://near.org/", "h://near.org/")),
    ]
    got = {r.page_id: r for r in hosts.verdicts(frame(pages, "page_id long, url string, html string"), URL_RULES, threshold=0.2).collect()}
    names = ["good.com", "mid.org", "bad.net", "near.org", "far.org", "farm.org"]
    at, w = {n: i for i, n in enumerate(names)}, np.zeros((6, 6))
    for a, b, n in [("good.com", "mid.org", 2), ("good.com", "good.com", 2), ("mid.org", "far.org", 2), ("mid.org", "bad.net", 2), ("bad.net", "bad.net", 2), ("near.org", "bad.net", 2), ("farm.org", "near.org", 4)]:
        w[at[a], at[b]] = n
    out, into = w.sum(1, keepdims=True), w.sum(0, keepdims=True)
    ahead, back = np.divide(w, out, where=out > 0, out=np.zeros_like(w)), np.divide(w, into, where=into > 0, out=np.zeros_like(w))
    trust = np.linalg.solve(np.eye(6) - 0.85 * ahead.T, 0.15 * np.array([1, 0, 0, 0, 0, 0.0]))
    distrust = np.linalg.solve(np.eye(6) - 0.85 * back, 0.15 * np.array([0, 0, 0.75, 0, 0, 0.0]))
    for r in got.values():
        assert r.trust == pytest.approx(trust[at[r.host]], abs=1e-5) and r.distrust == pytest.approx(distrust[at[r.host]], abs=1e-5)
        assert r.rule or r.verdict == ("block" if distrust[at[r.host]] - trust[at[r.host]] > 0.2 else "allow")


def test_hosts_blocked_over_links(frame):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = [
        (1, "h://lone.net/es/1", ""), (2, "h://lone.net/es/2", ""), (3, "h://lone.net/es/3", ""), (4, "h://lone.net/es/4", ""), (5, "h://lone.net/other", ""),
        (6, "h://half.net/es/1", link("rel")), (7, "h://half.net/fr/2", ""), (8, "h://half.net/es/3", ""), (9, "h://half.net/fr/4", ""), (10, "h://half.net/other", ""),
        (11, "h://reader.org/", link("h://half.net/", "h://good.com/")), (12, "h://good.com/", link("h://liked.org/", "/self")), (13, "h://liked.org/", ""),
        (14, "h://hub.org/", link("h://a.net/es/1", "h://b.net/es/1", "h://c.net/es/1")),
        (15, "h://a.net/es/1", ""), (16, "h://b.net/es/1", ""), (17, "h://c.net/es/1", ""),
    ]
    judged = hosts.verdicts(frame(pages, "page_id long, url string, html string"), URL_RULES)
    got = {r.page_id: r for r in judged.collect()}
    # nobody links to lone.net, half of the links to half.net are its own, and hub.org has no page under a rule
    assert {i for i, r in got.items() if r.rule is None and r.verdict == "block"} == {5, 10, 14}
    assert all(r.distrust < 0.5 for r in got.values())
    assert {i for i, r in got.items() if r.rule is None and r.verdict == "allow"} == {11, 13}
