"""Op 5: byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece's bytes are the leaves of a segment tree of ``WIDTH`` children a node, whose nodes hold the
smallest rank of the pairs that start below them; the first child that has a node's rank leads to
the leftmost pair of minimum rank. A merge removes one position and renews the leaves of its live
neighbours: three point updates of logarithmic cost, so a piece of n bytes takes O(n log n) however
long it is. Pieces of at most ``WIDTH`` pairs, nearly all words, have a tree of one node; many of
them are merged at once, as the rows of a matrix (``Coder._together``), with the same ids.

Texts are cut where a space stands before a character that is not white space; no match of the
pattern crosses such a place, so the parts can be encoded by themselves and remembered. The parts
of about ``GROUP`` characters are looked up together and the unknown ones encoded at once. The memory
holds ``CACHE`` parts and those of one group; the half that was not used lately is dropped when full.

Defined cases: null counts as empty (no ids, digests of the empty string); there are no special
tokens: their strings are ordinary text; repeated rows give repeated results; an empty table
gives no rows; further columns are dropped by ``digests`` and kept by ``encode``; bytes that are no
UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import column_bytes, release
from .shared import table

CACHE = 300_000
GROUP = 1 << 19
ROWS = 1 << 13
WIDTH = 32
NONE = 1 << 62
SLICE = 1 << 18
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_coders: dict = {}


def explicit(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelt out as Unicode white space."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == "\\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == "\\S":
            out.append(f"[^{WHITE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = {"[": True, "]": False}.get(two[:1], inside)
            out.append(two[:1])
            k -= 1
        k += 2
    return "".join(out)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if not n:
        return []
    get = ranks.get
    leaves = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > WIDTH:
        x = levels[-1]
        levels.append([min(x[i : i + WIDTH]) for i in range(0, len(x), WIDTH)])
    root, below = levels[-1], levels[-2::-1]
    after = [*range(1, n + 1), n]  # start of the next live token, n at the end
    before = [*range(-1, n)]
    while (low := min(root, default=NONE)) != NONE:
        i = root.index(low)
        for x in below:
            i = x.index(low, i * WIDTH)
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        h = before[i]
        leaves[i] = get(piece[i : after[k]], NONE) if k < n else NONE
        if j < n - 1:
            leaves[j] = NONE
        if h >= 0:
            leaves[h] = get(piece[h:k], NONE)
        if below:
            for at in {x // WIDTH for x in (h, i, j) if 0 <= x < n - 1}:
                for x, up in zip(levels, levels[1:]):
                    value = min(x[at * WIDTH : at * WIDTH + WIDTH])
                    if up[at] == value:
                        break
                    up[at] = value
                    at //= WIDTH
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Coder:
    """Encodes texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys()))
        self.find = regex.compile(explicit(pattern)).findall
        blank = regex.compile(f"[{WHITE}]").match
        self.white = {"", *(c for c in map(chr, range(0x3001)) if blank(c))}
        self.cut = regex.compile(f" (?=[^{WHITE}])").split
        self.new: dict[str, bytes] = {}  # ids of a space and a part; those used lately, then those used before them
        self.old: dict[str, bytes] = {}
        self._pairs()

    def _pairs(self) -> None:
        """Every two ids that make a third one, for ``_together``; not where the vocabulary lacks a byte."""
        get, self.none = self.ranks.get, max(self.ranks.values(), default=-1) + 1
        first = [get(bytes([b])) for b in range(256)]
        self.together = None not in first and self.none < 1 << 31
        if not self.together:
            return
        found = [(a, b, r) for t, r in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        a, b, r = np.array([*found, (self.none,) * 3], "i8").T  # the last one ends the search and is no pair
        key = a * (self.none + 1) + b
        order = np.argsort(key)
        self.keys, self.made = key[order], r[order].astype("i4")
        self.first = np.array([*first, self.none], "i4")  # the last one stands for no byte
        self.first_pairs = self._made(np.repeat(self.first, 257), np.tile(self.first, 257)).reshape(257, 257)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each two ids make, or ``none``."""
        key = a * np.int64(self.none + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(self.none))

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces whose trees are one node: a row of ranks for each, one merge in every row at a time."""
        none, lengths = self.none, np.fromiter(map(len, pieces), "i8", len(pieces))
        width = int(lengths.max()) + 2  # a column without a byte at both ends
        data = np.full((len(pieces), width), 256, "i4")
        cols = np.arange(width)
        data[(cols > 0) & (cols <= lengths[:, None])] = np.frombuffer(b"".join(pieces), "u1")
        rank = np.full(data.shape, none, "i4")
        rank[:, :-1] = self.first_pairs[data[:, :-1], data[:, 1:]]
        ids = self.first[data]
        flat_ids, flat_rank = ids.reshape(-1), rank.reshape(-1)
        after = np.arange(1, ids.size + 1)  # places in the flat arrays
        before = np.arange(-1, ids.size - 1)
        rows = np.arange(len(pieces))
        while len(rows):
            i = rows * width + rank[rows].argmin(1)
            low = flat_rank[i]
            live = low != none
            if not live.all():
                rows, i, low = rows[live], i[live], low[live]
            j = after[i]
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            flat_ids[i], flat_ids[j], flat_rank[j] = low, none, none
            made = self._made(flat_ids[np.concatenate((i, h))], flat_ids[np.concatenate((k, i))])
            flat_rank[i], flat_rank[h] = made[: len(i)], made[len(i) :]
        live = ids != none
        raw = ids[live].astype("<u4").tobytes()
        ends = (4 * live.sum(1).cumsum()).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece."""
        out, short, ranks, most = {}, {}, self.ranks, (WIDTH + 1) * self.together
        for p in pieces:
            x = p.encode()
            if len(x) <= most and x not in ranks:
                short[x] = p
            else:
                got = merge(x, ranks)
                out[p] = struct.pack(f"<{len(got)}I", *got)
        by_length = sorted(short, key=len)
        for at in range(0, len(short), ROWS):
            some = by_length[at : at + ROWS]
            out.update(zip(map(short.__getitem__, some), self._together(some)))
        return out

    def _found(self, parts: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all parts, a space before each, and where each part's pieces end."""
        text = "".join([" " + p for p in parts])
        pieces = self.find(text)
        ends = np.fromiter(map(len, pieces), "i8", len(pieces)).cumsum()
        want = np.fromiter(map(len, parts), "i8", len(parts)).cumsum() + np.arange(1, len(parts) + 1)
        at = np.searchsorted(ends, want)
        if len(parts) and (ends[-1:] != len(text) or (ends[at] != want).any()):  # a pattern that leaves characters out
            lists = [self.find(" " + p) for p in parts]
            return [*chain.from_iterable(lists)], np.cumsum([len(x) for x in lists]).tolist()
        return pieces, (at + 1).tolist()

    def _slices(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the parts that are not remembered are encoded at once for all of them."""
        if len(self.new) >= CACHE // 2:
            self.old, self.new = self.new, {}
        new, old, white = self.new, self.old, self.white
        split, wanted = [], set()
        for text in texts:
            first, *rest = text.split(" ")
            missing = set(rest).difference(new)
            if not white.isdisjoint([p[:1] for p in missing]):  # the space before it is no place to cut
                first, *rest = self.cut(text)
                missing = set(rest).difference(new)
            split.append((self.find(first), rest))
            wanted |= missing
        fresh = wanted.difference(old)
        again = wanted - fresh
        new.update(zip(again, map(old.__getitem__, again)))
        wanted = [*fresh]
        pieces, ends = self._found(wanted)
        ids = self._merged({*pieces, *chain.from_iterable(first for first, _ in split)})
        own = [*map(ids.__getitem__, pieces)]
        new.update((p, own[a] if b - a == 1 else b"".join(own[a:b])) for p, a, b in zip(wanted, [0, *ends], ends))
        out = [b"".join([*map(ids.__getitem__, first), *map(new.__getitem__, rest)]) for first, rest in split]
        for p in wanted:
            if len(p) >= 100:
                del new[p]
        return out

    def _slice(self, text: str) -> bytes:
        return self._slices([text])[0]

    def slices(self, text: str):
        """The text in parts of about SLICE characters, cut before a space and a character that is not white space."""
        at = 0
        while len(text) - at > SLICE:
            cut = text.find(" ", at + SLICE)
            while cut >= 0 and text[cut + 1 : cut + 2] in self.white:
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def coded(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """For each text the ids of its slices. Slices of about GROUP characters are encoded at once."""

        def slices():
            held, size = [], 0
            for k, text in enumerate(texts):
                for x in self.slices(text):
                    held.append((k, x))
                    size += len(x)
                    if size >= GROUP:
                        yield held
                        held, size = [], 0
            yield held

        pairs = (pair for held in slices() for pair in zip([k for k, _ in held], self._slices([x for _, x in held])))
        return (map(itemgetter(1), own) for _, own in groupby(pairs, itemgetter(0)))

    def encode(self, text: str) -> bytes:
        return b"".join(next(self.coded([text])))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(vocabulary: bytes, pattern: str) -> Coder:
    """One Coder for each Python worker, kept from task to task."""
    key = hashlib.sha256(vocabulary + pattern.encode()).digest()
    if key not in _coders:
        _coders[key] = Coder(vocabulary, pattern)
    return _coders[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a further column of binary ids; ``path`` is a rank file that the driver can read (a few MB at most, broadcast)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(_read(path))

    @F.pandas_udf(T.BinaryType())
    def run(texts):
        c = coder(vocabulary.value, pattern)
        return pd.Series([b"".join(x) for x in c.coded(x or "" for x in texts)], dtype=object)

    return docs.withColumn(ids, run(F.make_valid_utf8(F.coalesce(column, F.lit("")))))


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids decoded again; with_ids adds ids array<int>."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        c = coder(vocabulary.value, pattern)
        for b in batches:
            data, offs = column_bytes(b.column(1))
            raw, rows = data.tobytes(), []
            texts = (raw[lo:hi].decode(errors="replace") for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()))
            for coded in c.coded(texts):
                n, ids, back, parts = 0, hashlib.sha256(), hashlib.sha256(), []
                for got in coded:
                    n += len(got) // 4
                    ids.update(got)
                    back.update(c.decode(got))
                    if with_ids:
                        parts.append(np.frombuffer(got, "<i4"))
                rows.append((n, ids.hexdigest(), back.hexdigest(), np.concatenate(parts) if parts else None))
            n, ids, back, lists = zip(*rows) if rows else ((), (), (), ())
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                out.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)
        release()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5_bpe: every whole text of documents under the public multilingual ranks."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


SQL = None
