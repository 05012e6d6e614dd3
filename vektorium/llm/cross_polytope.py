"""Op 2: near-duplicate embeddings by cross-polytope hashing, with verified candidates.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash
is the index and sign of the largest coordinate of the rotated vector. A table joins two such
hashes (from two rotations) to one bucket code. Multiprobing puts each vector, besides its own
bucket, into those with the nearest runner-up coordinates, ranked by how much they lose.

Vectors that are equal in all components (and label) are collapsed first, by a 128-bit hash of
both. Buckets first get ids with sketches of 128 sign bits, not vectors: a vector goes on to a
bucket only if another one's sketch there is as near as that of a link (mean plus 7.5 standard
deviations of the differing bits, which loses about one link at the bound in 10**9). Pairs of what
is left are verified by cosine in double precision. A pair counts in the first bucket it shares
only, so counts need no table of pairs; blocks send on counts and a spanning forest of their links.

Buckets are compared by blocks of at most ``BLOCK`` vectors. Hot buckets (of more than ``WHOLE``
rows and 1 / 10,000 of all; told by counts of 2**16 cells of buckets, of which at most 10,000 are
broadcast) are dealt out as pairs of blocks, so no task holds one, and every pair is still compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label or vec_id, link with nothing and are components of their own; vectors of other
lengths are compared with those of their own length only; rows with the same vec_id and vector
are copies of each other; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import HOT_KEYS, Slices, cut, table

# measured at cosine 0.93 in 64 dimensions: one table misses 5.7% of such pairs, six miss 3 in 10**8
TABLES, PROBES, BLOCK, SEED = 6, 6, 1_024, 11
COSINE = 0.93
SKETCH, CELLS = 128, 1 << 16
WHOLE = 8 * BLOCK
SLICE = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(x.shape[1])


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(n, tables, probes) bucket codes of unit vectors; the first probe is the vector's own bucket."""
    if not 1 <= probes <= 16:
        raise ValueError("1 to 16 probes")
    width = 1 << max(2, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.empty((len(x), tables, probes), np.int64)
    near = 4
    for t in range(tables):
        ids, loss = [], []
        for half in range(2):
            r = rotated(x, seed * 1000 + 2 * t + half)
            size = np.abs(r)
            top = np.argpartition(-size, near - 1, axis=1)[:, :near]
            val = np.take_along_axis(size, top, 1)
            by = np.argsort(-val, axis=1, kind="stable")
            top, val = np.take_along_axis(top, by, 1), np.take_along_axis(val, by, 1)
            ids.append(2 * top + (np.take_along_axis(r, top, 1) < 0))
            loss.append(val[:, :1] ** 2 - val**2)
        both = (ids[0][:, :, None] * (2 * width) + ids[1][:, None, :]).reshape(len(x), -1)
        cost = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(x), -1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(both, pick, 1)
    return out


def sketches(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(n, SKETCH / 64) words of the signs of seeded random projections."""
    g = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ g > 0, axis=1).view(np.uint64)


def most_apart(cosine: float) -> int:
    """Differing sketch bits up to which a pair is compared."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(SKETCH * p + 7.5 * np.sqrt(SKETCH * p * (1 - p))))


def _near(words: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Which rows have another one within `most` bits (left and right the same array: inside it)."""
    out = np.zeros(len(words), bool)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        for to in range(at if left is right else 0, len(right), 4096):
            cols = right[to : to + 4096]
            near = sum(np.bitwise_count(words[rows, k][:, None] ^ words[cols, k][None, :]).astype(np.uint8) for k in range(words.shape[1])) <= most
            if left is right:
                near &= rows[:, None] != cols[None, :]
            out[rows] |= near.any(axis=1)
            out[cols] |= near.any(axis=0)
    return out


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of codes (m, tables, probes): the smallest table * 2**40 + code that both have."""
    best = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(a.shape[1]):
        open_ = np.flatnonzero(best == np.iinfo(np.int64).max)
        if not len(open_):
            break
        same = a[open_, t, :, None] == b[open_, t, None, :]
        code = np.where(same, a[open_, t, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
        hit = code < np.iinfo(np.int64).max
        best[open_[hit]] = (t << 40) + code[hit]
    return best


def _compare(x: np.ndarray, shared: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, code: np.ndarray, lab: np.ndarray, cosine: float):
    """Counts and forest links between rows `left` and `right` (the same array: inside it), for pairs whose first bucket is this one."""
    n, parent, links = np.zeros(len(x), np.int64), list(range(len(x))), []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        own = (_first_shared(shared[i], shared[j]) == code[i]) & (code[i] == code[j]) & (lab[i] == lab[j])
        i, j = i[own], j[own]
        n += np.bincount(i, weights=weight[j], minlength=len(x)).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=len(x)).astype(np.int64)
        for a, b in zip(i.tolist(), j.tolist()):
            p, q = root(a), root(b)
            if p != q:
                parent[q] = p
                links.append((a, b))
    return n, links


def _blocks(rows: DataFrame, block: int, whole: int) -> DataFrame:
    """rows(rep, bucket, ...) dealt by bucket, with columns own, lo and hi: the row's block, and the pair of blocks it meets in."""
    cell = F.pmod("bucket", F.lit(CELLS))
    n = rows.count()
    hot = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > max(whole, n // HOT_KEYS))
    hot = F.broadcast(hot.select("cell", F.ceil(F.col("n") / block).cast("int").alias("m")))
    rows = rows.withColumn("cell", cell).join(hot, "cell", "left").withColumn("m", F.coalesce("m", F.lit(1))).drop("cell")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("m").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).drop("m")
    return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def _each_group(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(rows of one bucket and pair of blocks) -> record batch or None, streamed; a group may go on in the next batch."""
    keys = ["bucket", "lo", "hi"]

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            cuts = _cuts(t)
            for lo, hi in zip(cuts[:-2], cuts[1:-1]):
                if hi - lo > 1 and (got := fn(t.slice(lo, hi - lo))) is not None:
                    yield got
            held = t.slice(cuts[-2]) if len(cuts) > 1 else t
        if held is not None and held.num_rows > 1 and (got := fn(held)) is not None:
            yield got

    def _cuts(t):
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = t[k].to_numpy()
            new |= v[1:] != v[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist(), t.num_rows] if t.num_rows else [0]

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lo, hi, own = t["lo"][0].as_py(), t["hi"][0].as_py(), t["own"].to_numpy()
    if lo == hi:
        every = np.arange(t.num_rows)
        return every, every
    return np.flatnonzero(own == lo), np.flatnonzero(own == hi)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = SEED, whole: int = WHOLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.elementType
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("x"), "label")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("x", F.when(sound, F.transform("x", lambda v: (v + F.lit(0).cast(kind)).cast(kind))))  # -0.0 + 0.0 = 0.0
    good = rows.where("x IS NOT NULL").withColumn("k1", F.xxhash64("label", "x")).withColumn("k2", F.xxhash64(F.lit(seed), "x", "label"))
    # one row for each class and task is sent on, however many copies there are
    classes = good.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "x")).alias("m"), F.first("label").alias("label"), F.count("*").alias("w"))
    classes = cut(classes.select("k1", "k2", F.col("m.vec_id").alias("rep"), F.col("m.x").alias("x"), F.xxhash64("label", F.size("m.x")).alias("lab"), "w"))

    def hashed(batches):
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                part = b.take(pa.array(np.flatnonzero(lengths == d)))
                x = part.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                x = x / np.sqrt((x * x).sum(1))[:, None]
                c = codes(x, tables, probes, seed).astype(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(c.reshape(-1)), tables * probes).cast(pa.list_(pa.int64()))
                s = sketches(x, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), flat, pa.array(s[:, 0]), pa.array(s[:, 1])], ["rep", "lab", "codes", "s0", "s1"])

    named = cut(classes.select("rep", "x", "lab").mapInArrow(hashed, "rep long, lab long, codes array<long>, s0 long, s1 long"))
    spread = named.select("rep", "lab", "s0", "s1", F.posexplode("codes").alias("k", "code"))
    spread = spread.withColumn("code", F.shiftleft(F.floor(F.col("k") / probes), 40) + F.col("code")).drop("k")
    spread = spread.select("rep", "s0", "s1", F.xxhash64("lab", "code").alias("bucket"), "code", "lab")
    most = most_apart(cosine)

    def filtered(t: pa.Table):
        words = np.stack([t["s0"].to_numpy(), t["s1"].to_numpy()], axis=1).view(np.uint64)
        keep = np.flatnonzero(_near(words, *_sides(t), most))
        return t.select(["rep", "bucket", "code", "lab"]).take(keep).combine_chunks().to_batches()[0] if len(keep) else None

    alive = _each_group(_blocks(spread, block, whole), filtered, "rep long, bucket long, code long, lab long")
    alive = cut(alive.distinct())
    carried = classes.select("rep", "lab", "w", "x").join(named.select("rep", "lab", "codes"), ["rep", "lab"])
    wide = _blocks(alive, block, whole).join(carried, ["rep", "lab"])

    def compare(t: pa.Table):
        rep, w = t["rep"].to_numpy(), t["w"].to_numpy()
        x = t["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        shared = t["codes"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, tables, probes)
        n, links = _compare(x, shared, w, *_sides(t), t["code"].to_numpy(), t["lab"].to_numpy(), cosine)
        some = np.flatnonzero(n)
        if not len(some):
            return None
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        cols = (np.concatenate([rep[some], rep[a]]), np.concatenate([rep[some], rep[b]]), np.concatenate([n[some], np.zeros(len(links), np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "n"])

    found = cut(_each_group(wide, compare, "u long, v long, n long"))
    counted = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("outer_links"))
    comp = connected_components(found.where("u <> v").select("u", "v")).withColumnRenamed("node", "rep")
    by_class = classes.select("k1", "k2", "rep", "w").join(counted, "rep", "left").join(comp, "rep", "left")
    by_class = by_class.select("k1", "k2", (F.coalesce("outer_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    sizes = classes.agg(F.sum("w")).first()[0] or 0
    slices = Slices(classes.select("k1", "k2", F.col("w").alias("n")), ["k1", "k2"], sizes, SLICE)
    linked = slices.salt(good.select("vec_id", "k1", "k2")).join(slices.repeat(by_class), ["k1", "k2", "slice"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2_cross_polytope: all embeddings, cosine 0.93, within equal labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings),
n AS (SELECT vec_id, x, label, sqrt(list_inner_product(x, x)) AS s FROM e),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n AS a JOIN n AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.s * b.s) >= 0.93),
c AS (WITH RECURSIVE r(u, v) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v) SELECT u, min(v) AS m FROM r GROUP BY 1),
k AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept FROM e LEFT JOIN k ON k.u = e.vec_id JOIN c ON c.u = e.vec_id
"""
