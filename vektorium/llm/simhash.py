"""Op 6: SimHash near-duplicates by pigeonhole blocks.

Fingerprints have 64 bits. They are split into six blocks; two that differ in at most three
bits agree on at least three whole blocks, so for each of the 20 choices of three blocks the
fingerprints are bucketed by those blocks' bits and compared inside buckets. Equal
fingerprints are collapsed first, whatever their number. A bucket sends on a spanning forest
of its links (fewer rows than it has fingerprints), not its pairs, and components follow from
large-star and small-star steps.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; a
text of one or two words has one shingle, its whole word sequence; repeated rows fall into one
component; rows without doc_id link nothing and are kept, with the component of their fingerprint
if it has one; an empty table gives no rows; further columns are dropped by ``near_duplicates``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import column_bytes
from .shared import cut, table

BLOCKS = (11, 11, 11, 11, 10, 10)
SEED = 42


def _fingerprint(raw: bytes, n: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= n:
        hashes = np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    else:
        cuts = np.cumsum([len(w) + 1 for w in words])
        ends = (cuts[n - 1 :] - 1).tolist()
        starts = [0, *cuts[: len(words) - n].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id long, fp long) of whole texts: majority bits of the XXH64 of their word shingles."""

    def run(batches):
        for b in batches:
            data, offs = column_bytes(b.column(1))
            raw, seen, out = data.tobytes(), {}, []
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                text = raw[lo:hi]
                if text not in seen:
                    seen[text] = _fingerprint(text, words)
                out.append(seen[text])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (indices) that connect what pairs within `most` bits connect; at most len(fp) - 1 of them."""
    parent = np.arange(len(fp))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []

    def blocked(idx):
        for lo in range(0, len(idx), 512):
            rows = idx[lo : lo + 512]
            for at in range(lo, len(idx), 4096):
                cols = idx[at : at + 4096]
                near = np.argwhere(np.bitwise_count(fp[rows][:, None] ^ fp[cols][None, :]) <= most)
                for i, j in near.tolist():
                    a, b = root(rows[i]), root(cols[j])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((int(rows[i]), int(cols[j])))

    if len(fp) <= 4096:
        blocked(np.arange(len(fp)))
        return out
    # a very large bucket: the pigeonhole again, on the bits that vary in it
    varying = [k for k in range(64) if len(np.unique(fp >> np.uint64(k) & np.uint64(1))) > 1]
    for part in np.array_split(np.array(varying), most + 1):
        key = np.zeros(len(fp), np.uint64)
        for k in part:
            key = key << np.uint64(1) | (fp >> np.uint64(int(k)) & np.uint64(1))
        order = np.argsort(key, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(group) > 1:
                blocked(group)
    return out


def links(classes: DataFrame, most: int = 3, blocks: tuple = BLOCKS) -> DataFrame:
    """(u, v) between classes(rep, fp) of distinct fingerprints, enough to connect all within `most` bits."""
    cuts = np.cumsum([0, *blocks]).tolist()
    keep = len(blocks) - most
    if sum(blocks) != 64 or keep < 1:
        raise ValueError("blocks must have 64 bits and be more than `most`")
    choices = []
    for k, chosen in enumerate(combinations(range(len(blocks)), keep)):
        mask = sum(((1 << blocks[c]) - 1) << cuts[c] for c in chosen)
        choices.append(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    rows = classes.select("rep", "fp", F.explode(F.array(*choices)).alias("x")).select("rep", "fp", "x.t", "x.key")

    def run(batches):
        """Buckets stand in order; one may continue in the next batch."""
        held = None

        def pairs(t):
            key, tab = t.column(3).to_numpy(), t.column(2).to_numpy()
            rep, fp = t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64)
            at = np.flatnonzero((np.diff(key) != 0) | (np.diff(tab) != 0)) + 1
            at = np.concatenate([[0], at, [len(key)]])
            u, v = [], []
            for k in np.flatnonzero(np.diff(at) > 1).tolist():
                lo, hi = int(at[k]), int(at[k + 1])
                for i, j in _forest(fp[lo:hi], most):
                    u.append(rep[lo + i])
                    v.append(rep[lo + j])
            return pa.RecordBatch.from_arrays([pa.array(np.array(u, np.int64)), pa.array(np.array(v, np.int64))], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            key, tab = t.column(3).to_numpy(), t.column(2).to_numpy()
            last = np.flatnonzero((key != key[-1]) | (tab != tab[-1]))
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield pairs(t.slice(0, stop).combine_chunks())
            held = t.slice(stop).combine_chunks()
        if held is not None:
            yield pairs(held)

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, most: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs(doc_id, text)."""
    fps = cut(fingerprints(docs, words))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = connected_components(links(classes.select("rep", "fp").where("rep IS NOT NULL"), most))
    named = classes.join(comp, classes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def representatives(docs: DataFrame, most: int = 3, words: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the document of the smallest doc_id, once; all columns pass through."""
    ids = cut(near_duplicates(docs, most, words).where("kept").select("doc_id"))
    keep = ids.distinct()
    out = docs.alias("d").join(keep.alias("k"), F.expr("cast(d.doc_id as bigint) <=> k.doc_id"), "left_semi")
    # rows that repeat an id are rare; only then are whole rows compared
    return out if ids.count() == keep.count() else out.dropDuplicates(["doc_id", "text"])


def query(spark, sf_dir: str) -> DataFrame:
    """op6_simhash: 3-word shingles, links at 3 or fewer differing bits, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = None
