"""Op 8: remove repeated passages, by level-wise doubling of window lengths.

A window is ``width`` consecutive words of one text. Words covered by a window whose words
also start anywhere else (the same text included) are removed. Windows are looked at level
by level: short windows first, and only starts whose short windows occur twice or more are
asked about at up to twice the length, until the full width. With the default width of 35
the lengths are 9, 18 and 35.

At the shortest length a start is represented by the smallest of the hashes of the short
windows that lie inside its full window. Equal full windows have the same smallest one at
the same place, so no repeated window is lost, and only about one short window in 14 is
sent. At the middle length a full window needs both its first and its last part to repeat.
Windows are compared by 64-bit hashes; a start that survives has repeated at every level.

Defined cases: a null text has no words (``kept_sha256`` of the empty string); texts under
``width`` words keep everything; repeated rows count as places of their own; an empty table
gives no rows; further columns are dropped by the query and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import column_bytes, distinct, run_hashes, runs, window_hashes
from .packs import ASKED, PACK_BYTES, Shape, answer, ask, asked, each_pack, make_packs, shape_for, told
from .shared import cut

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(width: int) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [width]
    while out[0] > 12:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _smallest(h: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the leftmost smallest entry of h[i : i + span], by doubling."""
    at, have = np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


class _Text:
    """Words of one pack and the starts of its full windows."""

    def __init__(self, t: pa.Table, width: int):
        self.data, self.offs = column_bytes(t["c1"])
        self.starts, self.ends, self.first = runs(self.data, self.offs)
        self.h = run_hashes(self.data, self.starts, self.ends)
        sizes = np.diff(self.first)
        left = np.repeat(self.first[1:], sizes) - np.arange(len(self.h))
        self.full = np.flatnonzero(left >= width)

    def places(self, level: int, lengths: list[int], alive: np.ndarray) -> list[np.ndarray]:
        """For each living start, the starts of the windows of this level that stand for it."""
        width, n = lengths[-1], lengths[level]
        if level == len(lengths) - 1:
            return [alive]
        if level == 0:
            at = _smallest(window_hashes(self.h, n), width - n + 1)
            return [at[alive]]
        return [alive, alive + (width - n)]

    def hashes(self, level: int, lengths: list[int], at: np.ndarray) -> np.ndarray:
        g = window_hashes(self.h, lengths[level])
        return g[at] if len(at) else np.zeros(0, np.uint64)

    def survivors(self, upto: int, lengths: list[int], replies: pa.Table, shape: Shape) -> np.ndarray:
        """Starts whose windows repeat at every level before upto."""
        alive = self.full
        for level in range(upto):
            if not len(alive):
                break
            ok = np.ones(len(alive), bool)
            sent = self.places(level, lengths, alive)
            u = distinct(self.hashes(level, lengths, distinct(np.concatenate(sent))))
            total = told(replies, level, u, shape)
            for at in sent:
                ok &= total[np.searchsorted(u, self.hashes(level, lengths, at))] >= 2
            alive = alive[ok]
        return alive


def removed_words(docs: DataFrame, width: int, pack_bytes: int, finish, schema: str) -> DataFrame:
    """Run the levels over docs, whose columns are (doc_id, text, ...), and apply finish(rows, text, gone) to each pack."""
    if width < 2:
        raise ValueError("width >= 2")
    lengths = levels(width)
    packs = make_packs(docs, pack_bytes)
    shape = shape_for(packs)
    answers = None
    for level in range(len(lengths)):

        def send(pack, t, replies, level=level):
            text = _Text(t, width)
            alive = text.survivors(level, lengths, replies, shape)
            if not len(alive):
                return asked([])
            # every occurrence counts: a place is sent once, however many windows it stands for
            at = distinct(np.concatenate(text.places(level, lengths, alive)))
            u, c = np.unique(text.hashes(level, lengths, at), return_counts=True)
            return asked(ask(pack, level, u, c, shape))

        new = cut(answer(each_pack(packs, send, ASKED, answers), shape))
        answers = new if answers is None else answers.unionByName(new)

    def end(pack, t, replies):
        text = _Text(t, width)
        hit = text.survivors(len(lengths), lengths, replies, shape)
        gone = np.zeros(len(text.h) + 1, np.int64)
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + width, -1)
        return finish(t, text, np.cumsum(gone)[:-1] > 0)

    return each_pack(packs, end, schema, answers)


def _digest(t: pa.Table, text: _Text, gone: np.ndarray) -> pa.Table:
    raw = text.data.tobytes()
    sums, out, n = np.concatenate([[0], np.cumsum(gone)]), [], np.diff(text.first)
    removed = sums[text.first[1:]] - sums[text.first[:-1]]
    for k in range(t.num_rows):
        if removed[k]:
            i = np.flatnonzero(~gone[text.first[k] : text.first[k + 1]]) + text.first[k]
            kept = b" ".join([raw[a:b] for a, b in zip(text.starts[i].tolist(), text.ends[i].tolist())])
        else:
            kept = b" ".join(raw[text.offs[k] : text.offs[k + 1]].split())
        out.append(hashlib.sha256(kept).hexdigest())
    return pa.table({"doc_id": t["c0"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(out, pa.string())})


def _texts(t: pa.Table, text: _Text, gone: np.ndarray) -> pa.Table:
    raw, out = text.data.tobytes(), []
    for k in range(t.num_rows):
        i = np.flatnonzero(~gone[text.first[k] : text.first[k + 1]]) + text.first[k]
        out.append(b" ".join([raw[a:b] for a, b in zip(text.starts[i].tolist(), text.ends[i].tolist())]).decode())
    return pa.table({"doc_id": t["c0"], "kept_text": pa.array(out, pa.string())})


def dedup(docs: DataFrame, width: int = 35, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, kept_text): each text without its repeated passages, kept words joined by one space."""
    return removed_words(docs.select(F.col("doc_id").cast("long"), "text"), width, pack_bytes, _texts, "doc_id long, kept_text string")


def query(spark, sf_dir: str, width: int = 35, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """op8_substring_dedup: windows of 35 words over every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed_words(docs.select(F.col("doc_id").cast("long"), "text"), width, pack_bytes, _digest, RESULT)


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM t),
r AS (SELECT doc_id, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
y AS (SELECT x.doc_id, p, word, max(r.i) OVER (PARTITION BY x.doc_id ORDER BY p) AS last_start FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.p),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (last_start IS NOT NULL AND p < last_start + 35) AS g,
  string_agg(word, ' ' ORDER BY p) FILTER (last_start IS NULL OR p >= last_start + 35) AS kept FROM y GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_words, CAST(coalesce(z.g, 0) AS BIGINT) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256
FROM w LEFT JOIN z USING (doc_id)
"""
