"""Exact dedup, SimHash, cross-polytope hashing, components: against brute force, with edges."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import data
from vektorium.llm import cross_polytope, exact_dedup, simhash
from vektorium.llm.components import connected_components


def brute_groups(rows, pick):
    out = []
    for ident, text in rows:
        same = [i for i, t in rows if (t or "") == (text or "")]
        known = [i for i in same if i is not None]
        keep = pick(known) if known else None
        out.append((ident, keep, len(same), ident == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.encode(c, "UTF-8"), 1, 3)])
def test_exact_groups(spark, keep, pick, digest):
    rows = [r[:2] for r in data.rows()] + [(None, "nobody"), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.groups(df, keep, digest, memtable=3, slice_rows=1)
    assert data.kept(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_groups(rows, pick)


def test_exact_edges(spark):
    assert exact_dedup.groups(data.empty(spark)).count() == 0
    assert exact_dedup.groups(data.docs(spark)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    with pytest.raises(ValueError):
        exact_dedup.picker("first")


def test_merge_index():
    rng, pick = random.Random(1), exact_dedup.picker("smallest")
    rows = [(bytes([rng.randrange(40)]) * 4, rng.randrange(1000)) for _ in range(500)]
    want = {}
    for d, i in rows:
        want[d] = (min(i, want.get(d, (i, 0))[0]), want.get(d, (0, 0))[1] + 1)
    runs, mem = [], exact_dedup.Memtable(pick)
    for d, i in rows:
        mem.put(d, i)
        if len(mem.rows) == 7:
            runs.append(exact_dedup.Run(mem.flush(), pick))
    runs.append(exact_dedup.Run(mem.flush(), pick))
    out = exact_dedup.compact(runs)
    assert {d: (i, n) for d, i, n in out.rows} == want and out.rows == sorted(out.rows)
    assert all(out.may_have(list(want)))


def fingerprint(text, n=3):
    w = data.words(text.lower() if text and text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < n else [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in data.real(spark, sf_dir).collect()] + [(1000 + i, t) for i, (_, t) in enumerate(x[:2] for x in data.rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fp = [fingerprint(t) for _, t in rows]
    comp = data.components([i for i, _ in rows], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, comp)), key=repr)
    assert data.kept(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == want
    assert len(set(comp)) < len(rows)


def test_blocks_find_every_close_pair(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in fps[:100] for k in (1, 2, 3)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    comp = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    want = data.components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert [comp.get(i, i) for i in range(len(fps))] == want


def test_a_very_large_bucket():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 20, 5000).astype(np.uint64))
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = simhash._forest(fp, 1)
    assert len(links) < len(fp)
    for a, b in links:
        assert (int(fp[a]) ^ int(fp[b])).bit_count() <= 1
        parent[root(a)] = root(b)
    at = {int(f): i for i, f in enumerate(fp)}
    for f, i in at.items():
        for b in range(20):
            j = at.get(f ^ 1 << b)
            assert j is None or root(i) == root(j)


def test_simhash_edges(spark):
    out = simhash.near_duplicates(data.docs(spark)).collect()
    assert len(out) == len(data.rows()) and all(r["kept"] for r in out if r["doc_id"] is None)
    stay = simhash.representatives(data.docs(spark))
    assert stay.columns == data.docs(spark).columns
    ids = [r["doc_id"] for r in stay.select("doc_id").collect()]
    assert ids.count(4) == 1 and 5 not in ids and 0 in ids and None in ids
    assert simhash.near_duplicates(data.empty(spark)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64))
    near = [x[i] + 0.03 * rng.normal(size=64) * k for i in range(20) for k in (1, 2)]
    rows = [(i, [float(v) for v in np.float32(r)], i % 3) for i, r in enumerate([*x, *near])]
    rows += [(200, rows[5][1], 2), (201, rows[5][1], 2), (202, rows[5][1], 1), (203, [2 * v for v in rows[5][1]], 2)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 64, 1), (303, [float("nan")] * 64, 1), (304, [float("inf")] + [0.0] * 63, 1), (305, rows[5][1], None), (None, rows[5][1], 2), (306, [None, 1.0], 1), (307, [1.0, 2.0], 1), (308, [1.0, 2.01], 1), (200, rows[5][1], 2)]
    return rows


@pytest.mark.parametrize("block,whole", [(1024, 8192), (2, 0)])
def test_cross_polytope(spark, block, whole, monkeypatch):
    monkeypatch.setattr(cross_polytope, "SLICE", max(1, whole))
    rows = vectors(spark)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, codes string, w double").repartition(3)

    def sound(r):
        return r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    def linked(a, b):
        p, q = rows[a], rows[b]
        if not (sound(p) and sound(q)) or p[2] != q[2] or len(p[1]) != len(q[1]):
            return False
        u, v = np.array(p[1]), np.array(q[1])
        return u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93 - 1e-12

    n = [sum(linked(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    comp = data.components([r[0] for r in rows], linked)
    want = sorted(((r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, comp)), key=repr)
    assert data.kept(cross_polytope.near_duplicates(df, block=block, whole=whole), "vec_id", "n_links", "component_id", "kept") == want
    assert cross_polytope.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("d", [3, 16, 64, 128, 384, 768, 1024])
def test_pairs_at_the_bound_are_found(d):
    """Pairs of cosine 0.93 share a bucket and have near sketches in any number of dimensions."""
    rng = np.random.default_rng(d)
    n = 300 if d > 500 else 1500
    x, y = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    assert (cross_polytope._first_shared(cross_polytope.codes(x), cross_polytope.codes(y)) < np.iinfo(np.int64).max).all()
    apart = np.bitwise_count(cross_polytope.sketches(x) ^ cross_polytope.sketches(y)).sum(axis=1)
    assert (apart <= cross_polytope.most_apart(0.93)).all()


def test_hadamard_is_orthogonal():
    h = cross_polytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = data.components(list(range(450)), lambda a, b: frozenset((a, b)) in pairs)
    assert all(got.get(i, i) == want[i] for i in range(450))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
