"""Op 9: exact duplicates through a log-structured merge index of digests.

Every task fills memtables (digest -> kept id, count). A full memtable is flushed as a sorted
run, cut into ranges of the digest; the pieces of a range are compacted in size tiers: of two
runs, the digests of the smaller are first put to the Bloom filter of the larger, and only
those it may have are looked up there. Compaction adds the counts and keeps one identifier for
each digest (the smallest, or the largest where asked). A digest that occurs once needs no more
work; digests that were hit twice or more get byte verification of each text against the kept
one's. Texts that take part are found by a Bloom filter of the hits, of at most ``FILTER_WORDS``
64-bit words whatever the input (a full filter lets more texts through, never fewer).

A run sends one entry for each digest, so a text that fills a third of the table costs one
entry for each run. There is a range for every ``RANGE`` rows of the table, so what a task compacts
does not grow. Rows of hot groups are salted before any join: a group of more than 1 / 10,000 of
the table (at most 10,000 groups, whose digests are broadcast) is cut into slices of ``slice_rows``,
and its entry of the index and its kept text are repeated once for each slice.

Defined cases: null counts as the empty text; repeated rows (same id, same text) are copies of
each other and are all marked kept if their id is; a null id stays only in a group without any
other id; an empty table gives no rows; further columns are dropped, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import squeeze, unsqueeze
from .shared import Slices, cut, table, tasks

MEMTABLE = 200_000
SLICE = 2_000
RANGE = 100_000
FILTER_WORDS = 1 << 20
_PIECE = "bucket long, run long, digests array<binary>, ids array<long>, counts binary"
_PIECE_ARROW = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("digests", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("counts", pa.binary())])


def picker(keep: str):
    """The function that says which of two identifiers stays; null gives way to any other."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    better = max if keep == "largest" else min
    return lambda a, b: b if a is None else a if b is None else better(a, b)


def probes(digests: list[bytes], bits: int, count: int = 4) -> np.ndarray:
    """(len(digests), count) places in a Bloom filter of so many bits."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, digests), np.uint64, len(digests))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + np.arange(count, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Memtable:
    """digest -> (kept id, count), flushed as a sorted run."""

    def __init__(self, pick):
        self.pick, self.rows = pick, {}

    def put(self, digest: bytes, ident: int | None, n: int = 1) -> None:
        have = self.rows.get(digest)
        self.rows[digest] = (ident, n) if have is None else (self.pick(have[0], ident), have[1] + n)

    def flush(self) -> list[tuple]:
        out, self.rows = sorted(((d, *v) for d, v in self.rows.items()), key=itemgetter(0)), {}
        return out


class Run:
    """Sorted entries (digest, kept id, count) with a Bloom filter of 10 bits a digest."""

    def __init__(self, rows: list[tuple], pick):
        self.rows, self.pick = rows, pick
        self.bits = max(64, 10 * len(rows))
        self.filter = np.zeros(self.bits, bool)
        self.filter[probes([r[0] for r in rows], self.bits).ravel()] = True

    def may_have(self, digests: list[bytes]) -> list[bool]:
        return self.filter[probes(digests, self.bits)].all(axis=1).tolist() if digests else []

    def merge(self, other: Run) -> Run:
        """Compaction of two runs; only what the larger run's filter lets through is looked up in it."""
        large, small = (self, other) if len(self.rows) >= len(other.rows) else (other, self)
        rows, new = list(large.rows), []
        for row, maybe in zip(small.rows, large.may_have([r[0] for r in small.rows])):
            k = bisect_left(rows, row[0], key=itemgetter(0)) if maybe else len(rows)
            if k < len(rows) and rows[k][0] == row[0]:
                rows[k] = (row[0], self.pick(rows[k][1], row[1]), rows[k][2] + row[2])
            else:
                new.append(row)
        return Run(sorted(rows + new, key=itemgetter(0)), self.pick)


def compact(runs: list[Run]) -> Run:
    """One run of all, merged in tiers of like size."""
    tiers: list[Run] = []
    for r in runs:
        tiers.append(r)
        while len(tiers) > 1 and len(tiers[-2].rows) <= 2 * len(tiers[-1].rows):
            tiers.append(tiers.pop().merge(tiers.pop()))
    while len(tiers) > 1:
        tiers.append(tiers.pop().merge(tiers.pop()))
    return tiers[0]


def _range(digest: bytes, ranges: int) -> int:
    return int.from_bytes(digest[:4].ljust(4, b"\0"), "big") * ranges >> 32


def pieces(digests: DataFrame, pick, ranges: int, memtable: int = MEMTABLE) -> DataFrame:
    """Runs of (doc_id, digest), one or more for each task, cut into ranges of the digest."""

    def run(batches):
        mem, part, k = Memtable(pick), TaskContext.get().partitionId(), 0

        def out():
            nonlocal k
            rows, cells, at = mem.flush(), [], 0
            while at < len(rows):
                r = _range(rows[at][0], ranges)
                end = at + 1
                while end < len(rows) and _range(rows[end][0], ranges) == r:
                    end += 1
                d, i, n = zip(*rows[at:end])
                cells.append({"bucket": r, "run": (part << 24) | k, "digests": list(d), "ids": list(i), "counts": squeeze(np.array(n, np.int64))})
                at = end
            k += 1
            return pa.Table.from_pylist(cells, schema=_PIECE_ARROW).to_batches(max_chunksize=1000)

        for b in batches:
            for ident, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mem.put(digest, ident)
                if len(mem.rows) >= memtable:
                    yield from out()
        if mem.rows:
            yield from out()

    return digests.mapInArrow(run, _PIECE)


def hits(digests: DataFrame, keep: str, ranges: int, memtable: int = MEMTABLE) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that occur twice or more among (doc_id, digest)."""
    pick = picker(keep)

    def merged(t: pa.Table) -> pa.Table:
        runs = []
        for r in t.sort_by("run").to_pylist():
            runs.append(Run(list(zip(r["digests"], r["ids"], unsqueeze(r["counts"], np.int64).tolist())), pick))
        rows = [x for x in compact(runs).rows if x[2] > 1]
        return pa.table({"digest": pa.array([x[0] for x in rows], pa.binary()), "keep_id": pa.array([x[1] for x in rows], pa.int64()), "group_size": pa.array([x[2] for x in rows], pa.int64())})

    return pieces(digests, pick, ranges, memtable).groupBy("bucket").applyInArrow(merged, "digest binary, keep_id long, group_size long")


def _filter(found: DataFrame, n: int) -> np.ndarray:
    """Bits of a Bloom filter of n digests; the driver gets FILTER_WORDS numbers at most."""
    words = 1
    while words < min(FILTER_WORDS, n // 4 + 1):
        words *= 2

    def run(batches):
        own = np.zeros(64 * words, bool)
        for b in batches:
            own[probes(b.column(0).to_pylist(), 64 * words).ravel()] = True
        packed = np.packbits(own, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["word", "bits"])

    t = found.select("digest").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[t["word"].to_numpy()] = t["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def groups(docs: DataFrame, keep: str = "largest", digest=None, memtable: int = MEMTABLE, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text).

    ``digest`` is a function from the text column to a binary one, by default SHA-256; a weak one
    only costs time, since texts of one digest that differ are told apart by their bytes.
    """
    pick = {"largest": F.max, "smallest": F.min}[keep]
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.unhex(F.sha2("text", 256))
    key = sha if digest is None else digest(F.col("text"))
    ids = cut(texts.select("doc_id", key.alias("digest"), sha.alias("sha")) if digest else texts.select("doc_id", key.alias("digest")))
    n_rows = ids.count()
    found = cut(hits(ids.select("doc_id", "digest"), keep, max(tasks(docs.sparkSession), -(-n_rows // RANGE)), memtable))
    n = found.count()
    slices = Slices(found.select("digest", F.col("group_size").alias("n")), ["digest"], n_rows, slice_rows)

    hex_ = F.lower(F.hex("sha" if digest else "digest"))
    size = F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    stays = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id")
    out = slices.salt(ids).join(slices.repeat(found), ["digest", "slice"], "left").select("doc_id", stays, size, hex_.alias("text_sha256"), "digest")
    if n:
        # byte verification of the hits: the kept text goes to each slice of its group
        sent = docs.sparkSession.sparkContext.broadcast(_filter(found, n))

        def suspects(batches):
            for b in batches:
                may = sent.value[probes(b.column(2).to_pylist(), len(sent.value))].all(axis=1)
                if may.any():
                    yield b.filter(pa.array(may))

        full = texts.select("doc_id", "text", key.alias("digest")).mapInArrow(suspects, "doc_id long, text string, digest binary")
        member = slices.salt(full).join(slices.repeat(found), ["digest", "slice"])
        first = member.where("doc_id <=> keep_id").groupBy("digest").agg(F.min("text").alias("kept_text"))
        odd = cut(member.join(slices.repeat(first), ["digest", "slice"]).where("NOT (text <=> kept_text)").select("digest").distinct())
        if odd.head(1):  # digests that do not stand for one text: these alone are grouped by the bytes
            mixed = full.join(odd, "digest", "left_semi")
            apart = mixed.groupBy("text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            redone = mixed.join(apart, "text").select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
            out = out.join(odd, "digest", "left_anti").drop("digest").unionByName(redone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op9_exact_dedup: equal whole texts of documents; the largest doc_id stays."""
    return groups(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
