"""Op 1: Stupid-backoff scores of whole texts under counts of the whole corpus.

Every text is exploded into its n-grams of orders 1..N. Their count tables are partitioned by
hash: each hash range adds up what the whole corpus has of an n-gram, the exploded n-grams are
joined to their totals there, and the scores are summed per document. n-grams travel as sorted,
compressed blocks (one for each pack of texts and hash range), one order after the other, and an
n-gram that occurs once needs no answer: a row for each n-gram would be about 15 times the input.

Word i of a document with words w takes the longest order n <= min(N, i + 1) whose n-gram ending
at i occurs ``min_count`` times or more in the corpus:

    alpha^(m - n) * c(w[i-n+1..i]) / c(w[i-n+1..i-1]),   m = min(N, i + 1)

with c() / number of words of the corpus at order 1. The result is the sum of natural
logarithms. With ``min_count`` 1, the default, all n-grams count, singletons included.

Defined cases: null, empty or blank texts have 0 words and score 0 (``mean_score`` null);
rows that repeat are counted and scored each time; an empty table gives no rows; further
columns are dropped from the result. n-grams are compared by hashes of 64 bits, not word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import column_bytes, run_hashes, runs, window_hashes
from .packs import ASKED, PACK_BYTES, answer, ask, asked, each_pack, make_packs, shape_for, told
from .shared import cut

RESULT = "doc_id long, n_words long, n_full long, n_elsewhere long, score double, mean_score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_full", pa.int64()), ("n_elsewhere", pa.int64()), ("score", pa.float64()), ("mean_score", pa.float64())])


def _ordered(t: pa.Table):
    """Word hashes, and for each word the number of words before it in its text."""
    data, offs = column_bytes(t["c1"])
    starts, ends, first = runs(data, offs)
    h = run_hashes(data, starts, ends)
    sizes = np.diff(first)
    before = np.arange(len(h)) - np.repeat(first[:-1], sizes)
    return h, before, first


def _grams(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the last words of all n-grams, and the n-grams' hashes."""
    if n == 1:
        return np.arange(len(h)), h
    at = np.flatnonzero(before >= n - 1)
    return at, window_hashes(h, n)[at - (n - 1)] if len(at) else np.zeros(0, np.uint64)


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 1, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Score every row of docs(doc_id, text) under the counts of docs itself; columns as in RESULT.

    ``n_full`` counts the words found at the longest order they could have, ``n_elsewhere`` those whose
    n-gram of that order occurs in another place too.
    """
    if order < 1 or min_count < 1 or not 0 < alpha <= 1:
        raise ValueError("order >= 1, min_count >= 1 and 0 < alpha <= 1")
    packs = make_packs(docs.select(F.col("doc_id").cast("long"), "text"), pack_bytes)
    shape = shape_for(packs)

    def counted(n: int) -> DataFrame:
        """The answers of one order; cutting here lets its blocks go before the next order's are made."""

        def count(pack, t, _):
            h, before, _ = _ordered(t)
            u, c = np.unique(_grams(h, before, n)[1], return_counts=True)
            return asked(ask(pack, n, u, c, shape))

        return cut(answer(each_pack(packs, count, ASKED), shape))

    def totals(pack, t, _):
        sizes = np.diff(runs(*column_bytes(t["c1"]))[2])
        return pa.table({"words": pa.array([int(sizes.sum())], pa.int64())})

    answers = counted(1)
    for n in range(2, order + 1):
        answers = answers.unionByName(counted(n))
    words = each_pack(packs, totals, "words long").agg(F.sum("words")).first()[0] or 0

    def score(pack, t, replies):
        h, before, first = _ordered(t)
        total = np.zeros((order + 1, len(h)), np.int64)
        for n in range(1, order + 1):
            at, g = _grams(h, before, n)
            u, back = np.unique(g, return_inverse=True)
            total[n, at] = told(replies, n, u, shape)[back]
        longest = np.minimum(before + 1, order)
        value, found = np.log(np.maximum(total[1], 1) / max(words, 1)), np.ones(len(h), np.int64)
        for n in range(2, order + 1):
            use = np.flatnonzero((before >= n - 1) & (total[n] >= min_count))
            value[use] = np.log(total[n, use] / total[n - 1, use - 1])
            found[use] = n
        value += (longest - found) * np.log(alpha)
        elsewhere = total[longest, np.arange(len(h))] >= 2
        sizes = np.diff(first)
        sums = np.zeros(len(sizes))
        full, shared = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        some = sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(value, first[:-1][some])
            full[some] = np.add.reduceat((found == longest).astype(np.int64), first[:-1][some])
            shared[some] = np.add.reduceat(elsewhere.astype(np.int64), first[:-1][some])
        return pa.table([t["c0"], pa.array(sizes), pa.array(full), pa.array(shared), pa.array(sums), pa.array(sums / np.maximum(sizes, 1), mask=~some)], schema=_SCHEMA)

    return each_pack(packs, score, RESULT, answers)


def query(spark, sf_dir: str) -> DataFrame:
    """op1_lm_score: every text of documents, order 3, alpha 0.4, all counts."""
    out = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumn("score", F.round("score", 5)).withColumn("mean_score", F.round("mean_score", 7))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS a3, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, a3, lag(a3) OVER p AS a2, lag(a3, 2) OVER p AS a1 FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT a3 AS x, count(*) AS c FROM g GROUP BY 1),
c2 AS (SELECT a2 AS x, a3 AS y, count(*) AS c FROM g WHERE i > 1 GROUP BY 1, 2),
c3 AS (SELECT a1 AS x, a2 AS y, a3 AS z, count(*) AS c FROM g WHERE i > 2 GROUP BY 1, 2, 3),
s AS (SELECT g.doc_id, CASE
    WHEN c3.c IS NOT NULL THEN ln(c3.c / p2.c)
    WHEN c2.c IS NOT NULL THEN ln(c2.c / p1.c) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(c1.c / (SELECT count(*) FROM g)) + CASE WHEN i > 2 THEN 2 * ln(0.4) WHEN i = 2 THEN ln(0.4) ELSE 0 END END AS v,
  CASE WHEN i > 2 THEN c3.c IS NOT NULL WHEN i = 2 THEN c2.c IS NOT NULL ELSE true END AS full_order,
  CASE WHEN i > 2 THEN c3.c WHEN i = 2 THEN c2.c ELSE c1.c END > 1 AS elsewhere
  FROM g JOIN c1 ON c1.x = g.a3
  LEFT JOIN c1 AS p1 ON p1.x = g.a2
  LEFT JOIN c2 ON c2.x = g.a2 AND c2.y = g.a3
  LEFT JOIN c2 AS p2 ON p2.x = g.a1 AND p2.y = g.a2
  LEFT JOIN c3 ON c3.x = g.a1 AND c3.y = g.a2 AND c3.z = g.a3)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(f, 0) AS BIGINT) AS n_full, CAST(coalesce(e, 0) AS BIGINT) AS n_elsewhere,
  round(coalesce(v, 0), 5) AS score, round(v / n, 7) AS mean_score
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (full_order) AS f, count(*) FILTER (elsewhere) AS e, sum(v) AS v FROM s GROUP BY 1) USING (doc_id)
"""
