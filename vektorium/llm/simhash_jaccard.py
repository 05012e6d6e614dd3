"""Near copies by word-shingle Jaccard: SimHash sketches find candidates, shingle sets verify them.

A text stands for the set of its word shingles; equal sets are collapsed first. A sketch has 384
majority bits of the set's hashes. Disjoint runs of 12 bits key 32 tables, and sets that share a
bucket and differ in at most ``MOST`` of the first 128 bits are candidates. At Jaccard 0.8 a bit differs
with probability arccos(0.889) / pi = 0.15, so a pair misses all tables with probability below 0.01.

Candidates are verified on whole sets. First each set is compared with its nearest one of smaller
key only; then all candidates that are still in different components are compared, without a bound.
Links are thus missed only where the sketches miss the pair. Null, empty and blank texts are one set;
rows without doc_id link nothing and are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import column_bytes, mix, release, run_hashes, runs, window_hashes
from .shared import cut

WORDS, TABLES, BITS, CHECKED, MOST = 6, 32, 12, 2, 36
THRESHOLD = (4, 5)


def shingle_sets(col, n: int):
    """For each text the sorted distinct hashes of its n-word shingles (ASCII lower case); a shorter text is one shingle."""
    data, offs = column_bytes(col)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = runs(data, offs)
    h = run_hashes(data, starts, ends)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        x = np.sort(window_hashes(h[lo:hi], min(n, hi - lo))) if hi > lo else h[:0]
        keep = np.ones(len(x), bool)
        keep[1:] = x[1:] != x[:-1]
        yield x[keep]


def _key(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(x + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(x))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sketch(x: np.ndarray) -> bytes:
    out = []
    for k in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 14):
            h = mix(x[at : at + (1 << 14)] + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        out.append(np.packbits(ones * 2 > len(x)).tobytes())
    return b"".join(out)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id long, c long, sketch binary): c is the key of the text's shingle set."""

    def run(batches):
        for b in batches:
            c, s = [], []
            for x in shingle_sets(b.column(1), words):
                c.append(_key(x))
                s.append(_sketch(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int64()), pa.array(s, pa.binary())], ["doc_id", "c", "sketch"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, c long, sketch binary")


def _pairs(at: np.ndarray, fp: np.ndarray, comp: np.ndarray | None):
    """Rows (u, v, bits) of one bucket, indices in order of key: the nearest before each (-1 for none), or all in different components."""
    n = len(at)
    for lo in range(0, n, 512):
        rows = np.arange(lo, min(lo + 512, n))
        low, near = np.full(len(rows), 255, np.int64), np.full(len(rows), -1, np.int64)
        for c in range(0, int(rows[-1]) + 1, 4096):
            cols = np.arange(c, min(c + 4096, int(rows[-1]) + 1))
            d = sum(np.bitwise_count(fp[rows, w][:, None] ^ fp[cols, w][None, :]).astype(np.int16) for w in range(CHECKED))
            d[(cols[None, :] >= rows[:, None]) | (d > MOST)] = 255
            if comp is None:
                best = d.argmin(axis=1)
                value = d[np.arange(len(rows)), best]
                better = value < low
                low[better], near[better] = value[better], cols[best[better]]
                hit = cols[(d < 255).any(axis=0)]
                yield hit, np.full(len(hit), -1), np.zeros(len(hit), np.int64)
            else:
                i, j = np.nonzero(d < 255)
                i, j, d = rows[i], cols[j], d[i, j]
                apart = comp[i] != comp[j]
                yield j[apart], i[apart], d[apart]
        if comp is None:
            some = near >= 0
            yield near[some], rows[some], low[some]


def candidates(sets: DataFrame, whole: bool) -> DataFrame:
    """(u, v, bits) between sets(c, sketch, comp) with u < v: each v's nearest in each bucket, and (u, null) for all that have a candidate; or with `whole` all between different components."""

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(raw, axis=1)[:, : TABLES * BITS].reshape(b.num_rows, TABLES, BITS)
            key = bits @ (1 << np.arange(BITS)) + (np.arange(TABLES) << BITS)[None, :]
            fp = np.ascontiguousarray(raw[:, : 8 * CHECKED]).view(np.int64)
            many = lambda x: np.repeat(x, TABLES)
            comp = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).astype(np.int32)), *(pa.array(many(x)) for x in (b.column(0).to_numpy(), comp, *fp.T))], ["bucket", "c", "comp", "a", "b"])

    def run(batches):
        """Buckets stand in order; one may continue in the next batch."""
        held = None

        def found(t):
            bucket, c, comp, *fp = (t.column(k).to_numpy() for k in range(5))
            fp = np.stack(fp, axis=1).view(np.uint64)
            at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
            u, v, d = [c[:0]], [c[:0]], [c[:0]]
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if hi - lo > 1:
                    for i, j, bits in _pairs(np.arange(hi - lo), fp[lo:hi], comp[lo:hi] if whole else None):
                        u.append(c[lo:hi][i])
                        v.append(np.where(j < 0, c[lo:hi][i], c[lo:hi][j]))
                        d.append(bits)
            u, v, d = (np.concatenate(x).astype(np.int64) for x in (u, v, d))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=u == v), pa.array(d)], ["u", "v", "bits"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            bucket = t.column(0).to_numpy()
            stop = int(np.searchsorted(bucket, bucket[-1]))
            if stop:
                yield found(t.slice(0, stop))
            held = t.slice(stop)
        if held is not None:
            yield found(held)
        held = None
        release()

    dealt = sets.select("c", "sketch", "comp").mapInArrow(deal, "bucket int, c long, comp long, a long, b long")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "c").mapInArrow(run, "u long, v long, bits long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of pairs whose sets(c, x) have Jaccard 0.8 or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * THRESHOLD[1] >= (len(x) + len(y) - both) * THRESHOLD[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    a, b = sets.select(F.col("c").alias("u"), F.col("x").alias("xu")), sets.select(F.col("c").alias("v"), F.col("x").alias("xv"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "xu", "xv").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text); the component's smallest doc_id."""

    def sets(batches):
        for b in batches:
            xs = list(shingle_sets(b.column(0), words))
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in xs], pa.int64()), pa.array([x.tobytes() for x in xs], pa.binary())], ["c", "x"])
        release()

    rows = cut(sketches(docs, words))
    classes = rows.where("doc_id IS NOT NULL").groupBy("c", "sketch").agg(F.min("doc_id").alias("rep"))
    first = cut(candidates(classes.withColumn("comp", F.lit(0).cast("long")), False).groupBy("v", F.when(F.col("v").isNull(), F.col("u")).alias("alone")).agg(F.min(F.struct("bits", "u")).alias("m")))
    nearest = first.where("v IS NOT NULL").select(F.col("m.u").alias("u"), "v")
    touched = cut(first.select(F.coalesce("v", "alone").alias("c")).distinct().join(classes, "c"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(touched.select("rep").distinct(), "rep", "left_semi").select("text")
    held = cut(texts.mapInArrow(sets, "c long, x binary").dropDuplicates(["c"]))
    links = cut(verified(nearest, held))
    comp = connected_components(links)
    placed = touched.join(comp, touched.c == comp.node, "left").select("c", "sketch", F.coalesce("component", "c").alias("comp"))
    more = cut(verified(candidates(placed, True).select("u", "v").distinct(), held))
    if more.take(1):
        comp = connected_components(links.unionByName(more))
    named = classes.join(comp, classes.c == comp.node, "left").select("c", "rep", F.coalesce("component", "c").alias("component"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "c").join(named.join(low, "component").select("c", "component_id"), "c", "left").select("doc_id", "component_id")


def representatives(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs that stay: of each component the document of the smallest doc_id, once; all columns pass through."""
    ids = cut(near_copies(docs, words).where("doc_id IS NULL OR doc_id = component_id").select("doc_id"))
    keep = ids.distinct()
    out = docs.alias("d").join(keep.alias("k"), F.expr("cast(d.doc_id as bigint) <=> k.doc_id"), "left_semi")
    # rows that repeat an id are rare; only then are whole rows compared
    return out if ids.count() == keep.count() else out.dropDuplicates(["doc_id", "text"])
