"""Packs: whole rows kept as compressed Arrow batches, and a counting exchange between them.

Operators that must look at every text several times (n-gram scoring, substring and line
dedup) first turn the table into *packs* of a few MB. A pack is one Spark row with an id
and a zstd-compressed Arrow IPC stream of whole rows, so any column passes through. Packs
are dealt by id and checkpointed once: later passes, cogroups by pack included, read them
without another shuffle of text, and what a pack holds is fixed before anything refers to
it, so lost executors cannot change it.

``ask`` sends each pack's distinct hashes, with local counts, to hash ranges; ``answer``
adds the counts up over all packs and sends back to each pack which of its hashes occur at
least twice, with totals. A frequent hash costs one entry for each pack, however often it
occurs, so no key gathers more than (number of packs) entries.

The exchange is a radix exchange whose rows grow with the data. A pack sends one row to each of
``1 << BITS`` ranges, whatever the number of packs. Where there are more packs than that, a
range is too large for one task, so crews of ``1 << BITS`` packs add up what they have in a
range and send it on to ``1 << BITS`` parts of it, and so on: the number of levels is the
logarithm of the number of packs, every row holds about 1 / ``1 << BITS`` of a pack's hashes, and
no task holds more than about a pack's hashes at once.

Ranges and packs have ids whose partition is known (``even_ids``), so partitions hold equally many.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import squeeze, unsqueeze
from .shared import cut_dealt, scan_partitions, tasks

PACK_BYTES = 8 << 20
BITS = 8
ASKED = "bucket long, part long, pack long, kind int, n long, hashes binary, counts binary"
ANSWERED = "pack long, part long, kind int, n long, hit binary, totals binary"
_ASKED_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("pack", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ANSWERED_ARROW = pa.schema([("pack", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("hit", pa.binary()), ("totals", pa.binary())])
_TRIES = 20


def murmur(x: np.ndarray) -> np.ndarray:
    """The JVM's hash of 64-bit integers (Murmur3, seed 42), by which a repartition by a long column deals."""
    x = np.asarray(x, np.int64).view(np.uint64)
    h = np.full(len(x), 42, np.uint32)
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    for word in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        h = turn(h ^ turn(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def even_id(number: int, slot: int, partitions: int) -> int:
    """An id of its own for number (below 2**43) that a repartition by id into so many partitions puts into partition slot."""
    at = 0
    while at < 1 << _TRIES:
        ids = (number << _TRIES) + np.arange(at, min(at + 4 * partitions + 64, 1 << _TRIES), dtype=np.int64)
        hit = np.flatnonzero(murmur(ids).astype(np.int64) % partitions == slot)
        if len(hit):
            return int(ids[hit[0]])
        at += len(ids)
    return number << _TRIES  # dealt like any other id


class Shape(NamedTuple):
    """How hashes are dealt: bits of the hash that name a range, packs that send to each, ids of the ranges."""

    bits: int
    packs: int
    ids: tuple

    def parts(self, u: np.ndarray) -> np.ndarray:
        return (u >> np.uint64(64 - self.bits)).astype(np.int64)

    def bucket(self, part: int) -> int:
        return self.ids[part] if self.ids else part


def seal(batches: list[pa.RecordBatch], names: list[str]) -> bytes:
    """Rows as one compressed value; ``unseal`` is the inverse."""
    t = pa.Table.from_batches(batches).rename_columns(names).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unseal(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def make_packs(df: DataFrame, size: int = PACK_BYTES) -> DataFrame:
    """(pack long, rows long, blob binary), checkpointed and dealt by pack. Column k is stored as ``c<k>``.

    There are as many partitions as the scan has splits, or the session's shuffle partitions where that is more.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    splits = scan_partitions(df)
    n = max(tasks(df.sparkSession), splits)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, weight = [], 0

        def out():
            nonlocal k
            blob = seal(held, names)
            ident = even_id(part << 21 | k, (part + k * splits) % n, n)
            got = pa.RecordBatch.from_pydict({"pack": pa.array([ident], pa.int64()), "rows": pa.array([sum(b.num_rows for b in held)], pa.int64()), "blob": pa.array([blob], pa.binary())})
            k += 1
            return got

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # cut long batches at rows
                n_rows = batch.num_rows - at
                while n_rows > 1 and batch.slice(at, n_rows).nbytes > size - weight:
                    n_rows = (n_rows + 1) // 2
                held.append(batch.slice(at, n_rows))
                weight += batch.slice(at, n_rows).nbytes
                at += n_rows
                if weight >= size * 0.9:
                    yield out()
                    held, weight = [], 0
        if held:
            yield out()

    return cut_dealt(df.toDF(*names).mapInArrow(run, "pack long, rows long, blob binary"), n, "pack")


def shape_for(packs: DataFrame, bits: int | None = None) -> Shape:
    """The first level: ``1 << bits`` ranges."""
    bits = BITS if bits is None else bits
    n = tasks(packs.sparkSession)
    return Shape(bits, max(1, packs.count()), tuple(even_id(k, k * n >> bits, n) for k in range(1 << bits)))


def cuts_of(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, end) of each run of equal parts."""
    if not len(parts):
        return []
    at = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]]).tolist()
    return [(int(parts[lo]), lo, hi) for lo, hi in zip(at[:-1], at[1:])]


def ask(pack: int, kind: int, u: np.ndarray, counts: np.ndarray, shape: Shape) -> list[dict]:
    """Rows of ASKED for sorted distinct hashes u."""
    out = []
    for p, lo, hi in cuts_of(shape.parts(u)):
        part = u[lo:hi].copy()
        part[1:] -= u[lo : hi - 1]
        out.append({"bucket": shape.bucket(p), "part": p, "pack": pack, "kind": kind, "n": hi - lo, "hashes": squeeze(part), "counts": squeeze(counts[lo:hi].astype(np.uint64))})
    return out


def asked(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ASKED_ARROW)


def _open(t: pa.Table):
    """For each kind: its rows, and the hashes and counts of all of them."""
    rows = t.select(["pack", "part", "kind", "n"]).to_pylist()
    for kind in sorted({r["kind"] for r in rows}):
        own = [i for i, r in enumerate(rows) if r["kind"] == kind]
        h = np.concatenate([np.cumsum(unsqueeze(t["hashes"][i].as_py(), np.uint64), dtype=np.uint64) for i in own])
        c = np.concatenate([unsqueeze(t["counts"][i].as_py(), np.uint64) for i in own]).astype(np.int64)
        yield kind, [rows[i] for i in own], h, c


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their sums, and where each entry of h is among them."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], np.add.reduceat(c[order], np.flatnonzero(new)), place


def _replies(rows: list[dict], total: np.ndarray) -> list[dict]:
    out, at = [], 0
    for r in rows:
        part = total[at : at + r["n"]]
        at += r["n"]
        hit = part >= 2
        if hit.any():
            out.append(r | {"hit": np.packbits(hit).tobytes(), "totals": squeeze(part[hit])})
    return out


def answer(df: DataFrame, shape: Shape, bits: int | None = None) -> DataFrame:
    """ANSWERED rows for ASKED rows: for each pack's part of a range, the hashes that occur twice or more in all."""
    bits = BITS if bits is None else bits

    def add(t: pa.Table) -> pa.Table:
        out = []
        for _, rows, h, c in _open(t):
            _, sums, place = _summed(h, c)
            out += _replies(rows, sums[place])
        return pa.Table.from_pylist(out, schema=_ANSWERED_ARROW)

    if shape.packs <= 1 << bits:
        return df.groupBy("bucket").applyInArrow(add, ANSWERED)
    crews = -(-shape.packs >> bits)
    below = Shape(shape.bits + bits, crews, ())

    def merge(t: pa.Table) -> pa.Table:
        return asked([r for kind, _, h, c in _open(t) for r in ask(t["crew"][0].as_py(), kind, *_summed(h, c)[:2], below)])

    def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            for kind, rows, h, c in _open(left):
                u, _, place = _summed(h, c)
                out += _replies(rows, told(right, kind, u, below)[place])
        return pa.Table.from_pylist(out, schema=_ANSWERED_ARROW)

    crew = F.pmod(F.xxhash64("pack"), F.lit(crews)).alias("crew")
    df = df.select("*", crew)
    totals = answer(df.groupBy("part", "crew").applyInArrow(merge, ASKED), below, bits)
    totals = totals.select("*", F.shiftright("part", bits).alias("home"))
    return df.groupBy("part", "crew").cogroup(totals.groupBy("home", "pack")).applyInArrow(pass_on, ANSWERED)


def told(t: pa.Table, kind: int, u: np.ndarray, shape: Shape) -> np.ndarray:
    """Totals for the sorted distinct hashes u of one pack; 1 where a hash occurs once in all."""
    first = {p: lo for p, lo, _ in cuts_of(shape.parts(u))}
    out = np.ones(len(u), np.int64)
    for r in t.select(["part", "kind", "n", "hit", "totals"]).to_pylist():
        if r["kind"] == kind:
            hit = np.unpackbits(np.frombuffer(r["hit"], np.uint8), count=r["n"]).astype(bool)
            out[first[r["part"]] + np.flatnonzero(hit)] = unsqueeze(r["totals"], np.int64)
    return out


def each_pack(packs: DataFrame, fn, schema: str, answers: DataFrame | None = None) -> DataFrame:
    """Apply fn(pack, table of rows, table of answers or None) -> pa.Table to every pack."""
    if answers is None:

        def plain(batches):
            for b in batches:
                for pack, blob in zip(b.column(0).to_pylist(), b.column(1)):
                    yield from fn(pack, unseal(blob.as_py()), None).to_batches(max_chunksize=20_000)

        return packs.select("pack", "blob").mapInArrow(plain, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return fn(None, None, right)
        return fn(left["pack"][0].as_py(), unseal(left["blob"][0].as_py()), right)

    return packs.select("pack", "blob").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(both, schema)
