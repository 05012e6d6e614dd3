"""Queries of the engine over the tables of a folder, and their SQL twins."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..ingest import embed as E
from ..ingest import text as T
from ..operators import evaluate, programs, search, tables
from ..operators.index import HnswIndex, IvfIndex, IvfPqIndex, pq
from ..operators.index.kmeans import lloyd, seeds
from ..operators.programs import scratch as _scratch
from ..sources import files
from ..streaming import append

K, NLIST, NPROBE, M, WORDS, BITS, DEPTH = 10, 16, 12, 32, 64, 6, 50
_ALL: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _base(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", "embedding")


def _queries(spark, d) -> DataFrame:
    """Every row whose id is divisible by 20, so that the queries grow with the table."""
    return _base(spark, d).where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _every(spark, d) -> DataFrame:
    return _base(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


# ---- pieces of SQL

def _dot(a, b):
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _l2(a, b):
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _best(scored: str, k: int, value: str, down: bool) -> str:
    order = f"{value} {'DESC' if down else 'ASC'}, vec_id"
    return f"SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, {value} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS r FROM ({scored})) WHERE r <= {k}"


def _top(score: str, value: str, down: bool, which: str = "q.vec_id % 20 = 0", k: int = K) -> str:
    return _best(f"SELECT q.vec_id AS query_id, e.vec_id, {score} AS {value} FROM embeddings AS q, embeddings AS e WHERE {which}", k, value, down)


_DOT = _dot("q.embedding", "e.embedding")
_L2 = f"round({_l2('q.embedding', 'e.embedding')}, 9)"
_TOP_DOT, _TOP_L2 = _top(_DOT, "score", True), _top(_L2, "dist", False)
_ABS = "list_max(list_transform(embedding, lambda x: abs(x)))"
_I8 = f"""
i8s AS (SELECT vec_id, embedding, CASE WHEN {_ABS} > 0 THEN CAST({_ABS} / 127::FLOAT AS FLOAT) ELSE 1::FLOAT END AS scale FROM embeddings),
i8 AS (SELECT vec_id, scale, list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(CAST(x * CAST(1::FLOAT / scale AS FLOAT) AS FLOAT) AS DOUBLE), 0))) AS TINYINT)) AS codes FROM i8s)"""
_ULP = "pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10)"
_HALF = f"list_transform({{0}}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x::DOUBLE / {_ULP}, 0) * {_ULP} END)"  # 11 bits, halves to even
_I8_TOP = _best(f"SELECT q.vec_id AS query_id, i8.vec_id, {_dot('q.embedding', 'i8.codes')} * CAST(i8.scale AS DOUBLE) AS score FROM embeddings AS q, i8 WHERE q.vec_id % 20 = 0", "{k}", "score", True)


def _kmeans_sql(steps: int = 2) -> str:
    """CTEs c0..c<steps> of (list_id, c), each one Lloyd step from the one before."""
    out = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS list_id, embedding::DOUBLE[] AS c FROM embeddings ORDER BY vec_id LIMIT {NLIST})"]
    for s in range(steps):
        out.append(f"a{s} AS ({_assign_sql(f'c{s}')})")
        out.append(f"m{s} AS (SELECT list_id, dim, avg(v) AS v FROM (SELECT list_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding::DOUBLE[]) AS v FROM a{s} JOIN embeddings USING (vec_id)) GROUP BY 1, 2)")
        out.append(f"c{s + 1} AS (SELECT c{s}.list_id, coalesce(n.c, c{s}.c) AS c FROM c{s} LEFT JOIN (SELECT list_id, list(v ORDER BY dim) AS c FROM m{s} GROUP BY 1) AS n ON n.list_id = c{s}.list_id)")
    return ", ".join(out)


def _assign_sql(c: str) -> str:
    return f"SELECT vec_id, list_id FROM (SELECT e.vec_id, k.list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_l2('e.embedding', 'k.c')}, k.list_id) AS r FROM embeddings AS e, {c} AS k) WHERE r = 1"


def _ivf_sql(nprobe: int) -> str:
    probes = f"SELECT query_id, list_id FROM (SELECT q.vec_id AS query_id, k.list_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_l2('q.embedding', 'k.c')}, k.list_id) AS r FROM embeddings AS q, c2 AS k WHERE q.vec_id % 20 = 0) WHERE r <= {nprobe}"
    scored = f"SELECT p.query_id, e.vec_id, {_L2} AS dist FROM ({probes}) AS p JOIN lists USING (list_id) JOIN embeddings AS e ON e.vec_id = lists.vec_id JOIN embeddings AS q ON q.vec_id = p.query_id"
    return f"WITH {_kmeans_sql()}, lists AS ({_assign_sql('c2')}), ivf AS ({_best(scored, K, 'dist', False)})"


_WORDS = f"SELECT CAST(vec_id AS INTEGER) AS code, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < {WORDS}"
_PART = "list_slice({v}, p * {s} + 1, p * {s} + {s})"


def _pq_sql(dim: int = 64) -> str:
    s = dim // M
    a, b = _PART.format(v="e.embedding::DOUBLE[]", s=s), _PART.format(v="w.w", s=s)
    q = _PART.format(v="q.embedding::DOUBLE[]", s=s)
    codes = f"SELECT vec_id, CAST(p AS INTEGER) AS part, code FROM (SELECT e.vec_id, p, code, row_number() OVER (PARTITION BY e.vec_id, p ORDER BY {_l2(a, b)}, code) AS r FROM embeddings AS e, words AS w, generate_series(0, {M - 1}) AS g(p)) WHERE r = 1"
    table = f"SELECT q.vec_id AS query_id, p AS part, code, {_l2(q, b)} AS d FROM embeddings AS q, words AS w, generate_series(0, {M - 1}) AS g(p) WHERE q.vec_id % 20 = 0"
    scored = "SELECT query_id, vec_id, round(sum(d), 9) AS dist FROM codes JOIN dist_table USING (part, code) GROUP BY 1, 2"
    return f"WITH words AS ({_WORDS}), codes AS ({codes}), dist_table AS ({table}), adc AS ({scored})"


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CUT = """CASE WHEN length(rest) <= 2000 THEN length(rest)
  WHEN length(regexp_extract(substr(rest, 1201, 800), '(?s)^.*[.!?。！？]')) > 0 THEN 1200 + length(regexp_extract(substr(rest, 1201, 800), '(?s)^.*[.!?。！？]'))
  WHEN length(regexp_extract(substr(rest, 1, 2000), '(?s)^.*[.!?。！？]')) > 0 THEN length(regexp_extract(substr(rest, 1, 2000), '(?s)^.*[.!?。！？]'))
  ELSE 2000 END"""
_CHUNKS = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, 0 AS i, {_STRIP.format("coalesce(text, '')")} AS rest, '' AS chunk FROM documents
  UNION ALL
  SELECT doc_id, i + 1, substr(rest, {_CUT} + 1), {_STRIP.format(f"substr(rest, 1, {_CUT})")} FROM r WHERE rest <> ''),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, chunk FROM r WHERE i > 0 AND chunk <> '')"""


# ---- exact search


@query(_TOP_DOT)
def exact_topk_dot(spark, d):
    return search.exact_search(_base(spark, d), _queries(spark, d), K, "dot")


@query(_TOP_L2)
def exact_topk_l2(spark, d):
    return search.exact_search(_base(spark, d), _queries(spark, d), K, "l2", digits=9)


@query(_TOP_DOT)
def exact_topk_numpy(spark, d):
    return search.exact_search(_base(spark, d), _queries(spark, d), K, "dot", kernel="numpy")


@query(_top(_DOT, "score", True, "true"))
def batched_topk_dot(spark, d):
    """Every vector as a query, by block products."""
    return search.exact_search(_base(spark, d), _every(spark, d), K, "dot", kernel="numpy")


@query(_TOP_L2)
def tiled_topk_l2(spark, d):
    """Neither side broadcast: tiles of the base meet blocks of queries."""
    return _rounded(search.exact_search(_base(spark, d), _queries(spark, d), K, "l2", kernel="numpy", broadcast_bytes=0), "dist")


@query(_top(_DOT, "score", True, "q.vec_id = (SELECT min(vec_id) FROM embeddings)"))
def single_query_topk(spark, d):
    return search.search_first_query(_base(spark, d), _every(spark, d), K)


# ---- vector functions and tables


@query(f"SELECT vec_id, sqrt({_dot('embedding', 'embedding')}) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _base(spark, d).select("vec_id", vector.norm("embedding").alias("norm"))


@query(f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, sqrt({_dot('embedding', 'embedding')}) AS norm, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite FROM embeddings")
def vector_sanity(spark, d):
    return tables.check_vectors(_base(spark, d))


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, v / n AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS v, sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings)")
def normalize_vectors(spark, d):
    return _base(spark, d).select("vec_id", F.posexplode(vector.normalize("embedding")).alias("dim", "value"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, value FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS value FROM embeddings WHERE vec_id < 3) WHERE i <= 8")
def dump_preview(spark, d):
    return tables.preview(_base(spark, d))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id < 100")
def slice_first_n(spark, d):
    return tables.slice_first(_base(spark, d), 100).select("vec_id", F.size("embedding").alias("dim"))


@query("SELECT vec_id, embedding[1] AS first FROM embeddings WHERE vec_id IN (3, 7, 499)")
def rows_by_id(spark, d):
    return tables.row_at(_base(spark, d), [3, 7, 499]).select("vec_id", F.col("embedding")[0].alias("first"))


@query("SELECT vec_id FROM embeddings ORDER BY md5('42-' || vec_id), vec_id LIMIT 50")
def sample_queries_random(spark, d):
    return tables.sample_random(_base(spark, d), 50, 42).select("vec_id")


@query("SELECT t.dtype, count(*) AS rows, CAST(max(len(embedding)) AS BIGINT) AS dim, CAST(count(*) * (max(len(embedding)) * t.b + t.x) AS BIGINT) AS bytes FROM embeddings, (VALUES ('float32', 4, 0), ('float16', 2, 0), ('int8', 1, 4)) AS t(dtype, b, x) GROUP BY t.dtype, t.b, t.x")
def storage_bytes(spark, d):
    return tables.storage_bytes(_base(spark, d))


@query(f"WITH {_I8} SELECT vec_id, scale, CAST(i - 1 AS INTEGER) AS dim, code FROM (SELECT vec_id, scale, generate_subscripts(codes, 1) AS i, unnest(codes) AS code FROM i8)")
def quantize_int8(spark, d):
    return tables.quantize_int8(_base(spark, d)).select("vec_id", "scale", F.posexplode("codes").alias("dim", "code"))


@query(f"WITH {_I8} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(code AS FLOAT) * scale AS value FROM (SELECT vec_id, scale, generate_subscripts(codes, 1) AS i, unnest(codes) AS code FROM i8)")
def dequantize_int8(spark, d):
    return tables.dequantize_int8(tables.quantize_int8(_base(spark, d))).select("vec_id", F.posexplode("embedding").alias("dim", "value"))


@query(f"WITH {_I8} {_I8_TOP.format(k=K)}")
def int8_topk_dot(spark, d):
    return search.exact_search(tables.quantize_int8(_base(spark, d)), _queries(spark, d), K, "dot", "int8")


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(value AS FLOAT) AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest({_HALF.format('embedding')}) AS value FROM embeddings)")
def f16_convert(spark, d):
    return tables.from_float16(tables.to_float16(_base(spark, d))).select("vec_id", F.posexplode("embedding").alias("dim", "value"))


@query(_best(f"SELECT q.vec_id AS query_id, h.vec_id, {_dot('q.embedding', 'h.x')} AS score FROM embeddings AS q, (SELECT vec_id, {_HALF.format('embedding')} AS x FROM embeddings) AS h WHERE q.vec_id % 20 = 0", K, "score", True))
def f16_topk_dot(spark, d):
    return search.exact_search(tables.to_float16(_base(spark, d)), _queries(spark, d), K, "dot", "float16", kernel="numpy")


# ---- approximate search


@query(f"WITH {_kmeans_sql()} SELECT list_id, CAST(i - 1 AS INTEGER) AS dim, round(v, 9) AS value FROM (SELECT list_id, generate_subscripts(c, 1) AS i, unnest(c) AS v FROM c2)")
def kmeans_centroids(spark, d):
    c = lloyd(_base(spark, d), NLIST, 2)
    rows = [(i, c[i].tolist()) for i in range(len(c))]
    return spark.createDataFrame(rows, "list_id int, c array<double>").select("list_id", F.posexplode("c").alias("dim", "value")).withColumn("value", F.round("value", 9))


def _ivf(spark, d) -> IvfIndex:
    return IvfIndex.build(_base(spark, d), NLIST, None, 2)


@query(f"WITH {_kmeans_sql()} {_assign_sql('c2')}")
def ivf_assign(spark, d):
    return _ivf(spark, d).lists.select("vec_id", "list_id")


@query(f"WITH {_kmeans_sql()}, lists AS ({_assign_sql('c2')}) SELECT list_id, count(*) AS n FROM lists GROUP BY 1")
def ivf_list_sizes(spark, d):
    return _ivf(spark, d).list_sizes()


@query(_ivf_sql(NPROBE) + " SELECT * FROM ivf")
def ivf_search(spark, d):
    return _rounded(_ivf(spark, d).search(_queries(spark, d), K, NPROBE), "dist")


@query(_TOP_L2)
def ivf_search_all_lists(spark, d):
    return _rounded(_ivf(spark, d).search(_queries(spark, d), K, NLIST), "dist")


@query(_ivf_sql(NPROBE) + " SELECT * FROM ivf")
def ivf_saved_search(spark, d):
    """Built, written by list, extended and read again: the same results."""
    path, base = _scratch(spark, "ivf"), _base(spark, d)
    index = _ivf(spark, d)
    IvfIndex(index.centroids, index.lists.where("vec_id % 2 = 0")).save(path)
    IvfIndex.append(path, base.where("vec_id % 2 = 1"))
    return _rounded(IvfIndex.load(spark, path).search(_queries(spark, d), K, NPROBE), "dist")


@query(f"WITH cand AS ({_top(_DOT, 'score', True, k=40)}) " + _best(f"SELECT cand.query_id, cand.vec_id, {_L2} AS dist FROM cand JOIN embeddings AS q ON q.vec_id = cand.query_id JOIN embeddings AS e ON e.vec_id = cand.vec_id", K, "dist", False))
def refine_candidates(spark, d):
    """The 40 best by dot product, ranked again by distance."""
    base, q = _base(spark, d), _queries(spark, d)
    return _rounded(search.refine(search.exact_search(base, q, 40, "dot", kernel="numpy"), base, q, K), "dist")


@query(f"WITH {_I8}, cand AS ({_I8_TOP.format(k=30)}) " + _best(f"SELECT cand.query_id, cand.vec_id, {_L2} AS dist FROM cand JOIN embeddings AS q ON q.vec_id = cand.query_id JOIN embeddings AS e ON e.vec_id = cand.vec_id", K, "dist", False))
def int8_refine(spark, d):
    """30 candidates by int8 codes, ranked again by exact distance."""
    base, q = _base(spark, d), _queries(spark, d)
    cand = search.exact_search(tables.quantize_int8(base), q, search.candidate_depth(K, 30), "dot", "int8")
    return _rounded(search.refine(cand, base, q, K), "dist")


def _codebooks(spark, d) -> np.ndarray:
    """Codewords by a rule that SQL can restate: the parts of the first vectors."""
    x = seeds(_base(spark, d), WORDS)
    return np.stack(np.split(x, M, axis=1))


@query(_pq_sql() + " SELECT vec_id, part, code FROM codes")
def pq_encode(spark, d):
    codes = pq.pq_encode(_base(spark, d), _codebooks(spark, d))
    return codes.select("vec_id", F.posexplode("codes").alias("part", "code")).withColumn("code", F.col("code").cast("int"))


@query(_pq_sql() + " " + _best("SELECT * FROM adc", K, "dist", False))
def pq_adc_topk(spark, d):
    books = _codebooks(spark, d)
    return pq.adc_search(pq.pq_encode(_base(spark, d), books), books, _queries(spark, d), K)


@query(_pq_sql() + f", cand AS ({_best('SELECT * FROM adc', DEPTH, 'dist', False)}) " + _best(f"SELECT cand.query_id, cand.vec_id, {_L2} AS dist FROM cand JOIN embeddings AS q ON q.vec_id = cand.query_id JOIN embeddings AS e ON e.vec_id = cand.vec_id", K, "dist", False))
def pq_refine(spark, d):
    base, q, books = _base(spark, d), _queries(spark, d), _codebooks(spark, d)
    cand = pq.adc_search(pq.pq_encode(base, books), books, q, search.candidate_depth(K, DEPTH))
    return _rounded(search.refine(cand, base, q, K), "dist")


@query(None)
def ivfpq_search(spark, d):
    base = _base(spark, d)
    return IvfPqIndex.build(base, NLIST, M, BITS).search(_queries(spark, d), K, NPROBE, DEPTH, base)


@query(None)
def opq_search(spark, d):
    base = _base(spark, d)
    return IvfPqIndex.build(base, NLIST, M, BITS, rotate=True, rounds=5).search(_queries(spark, d), K, NPROBE, DEPTH, base)


@query(None)
def hnsw_search(spark, d):
    return HnswIndex.build(_base(spark, d), 8, 64).search(_queries(spark, d), K, 48)


_QUALITY = f"SELECT count(*) AS queries, CAST(count(*) * {K} AS BIGINT) AS rows, true AS distances_exact, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0"


def _quality(spark, d, got: DataFrame) -> DataFrame:
    """(queries, rows, distances_exact, recall_reached): k rows for each query, distances as exact ones, mean recall of 0.9 or more."""
    base, q = _base(spark, d), _queries(spark, d)
    truth = evaluate.build_ground_truth(base, q, K, "l2")
    found = got.select("query_id", "rank", "vec_id", "dist").persist()
    again = found.join(base, "vec_id").join(q, "query_id").select((F.abs(vector.l2_squared("q", "embedding") - F.col("dist")) < 1e-9).alias("same"))
    facts = found.agg(F.count("*").alias("rows")).crossJoin(again.agg(F.coalesce(F.bool_and("same"), F.lit(False)).alias("distances_exact")))  # one row each
    recall = evaluate.mean_recall(found, truth, K).select("queries", (F.col("recall") >= 0.9).alias("recall_reached"))
    return recall.crossJoin(facts).select("queries", "rows", "distances_exact", "recall_reached")


@query(_QUALITY)
def hnsw_quality(spark, d):
    return _quality(spark, d, hnsw_search(spark, d))


@query(_QUALITY)
def ivf_quality(spark, d):
    return _quality(spark, d, _ivf(spark, d).search(_queries(spark, d), K, NPROBE))


@query(_QUALITY)
def ivfpq_quality(spark, d):
    return _quality(spark, d, ivfpq_search(spark, d))


@query(_QUALITY)
def opq_quality(spark, d):
    return _quality(spark, d, opq_search(spark, d))


@query(_QUALITY)
def hnsw_saved_quality(spark, d):
    """Graphs written and read again."""
    path = _scratch(spark, "hnsw")
    HnswIndex.build(_base(spark, d), 8, 64).save(path)
    return _quality(spark, d, HnswIndex.load(spark, path).search(_queries(spark, d), K, 48))


@query(_QUALITY)
def ivfpq_saved_quality(spark, d):
    """Codes written by list, read again, and searched by pruned folders."""
    path, base = _scratch(spark, "ivfpq"), _base(spark, d)
    IvfPqIndex.build(base, NLIST, M, BITS).save(path)
    return _quality(spark, d, IvfPqIndex.load(spark, path).search(_queries(spark, d), K, NPROBE, DEPTH, base))


@query(f"WITH {_kmeans_sql()}, lists AS ({_assign_sql('c2')}) SELECT list_id, count(*) AS n FROM lists GROUP BY 1")
def ivf_streamed_sizes(spark, d):
    """Half of the vectors saved, the other half appended by a stream."""
    path, index = _scratch(spark, "ivf"), _ivf(spark, d)
    IvfIndex(index.centroids, index.lists.where("vec_id % 2 = 0")).save(path)
    rows = spark.readStream.schema("vec_id long, embedding array<float>").parquet(f"{d}/embeddings.parquet*").where("vec_id % 2 = 1")
    append.append_to_ivf(rows, path, _scratch(spark, "stream")).awaitTermination()
    return append.with_stream(spark, path).list_sizes()


# ---- ground truth, recall, statistics


@query(_TOP_DOT)
def ground_truth(spark, d):
    return evaluate.build_ground_truth(_base(spark, d), _queries(spark, d), K)


@query(f"WITH {_I8}, got AS ({_I8_TOP.format(k=K)}), truth AS ({_TOP_DOT}) SELECT truth.query_id, count(got.vec_id) AS hits, count(got.vec_id) / {K} AS recall FROM truth LEFT JOIN got USING (query_id, vec_id) GROUP BY 1")
def recall_int8(spark, d):
    base, q = _base(spark, d), _queries(spark, d)
    got = search.exact_search(tables.quantize_int8(base), q, K, "dot", "int8")
    return evaluate.recall_at_k(got, evaluate.build_ground_truth(base, q, K), K)


@query(_ivf_sql(NPROBE) + f", truth AS ({_TOP_L2}) SELECT count(*) AS queries, round(avg(r), 9) AS recall FROM (SELECT truth.query_id, count(ivf.vec_id) / {K} AS r FROM truth LEFT JOIN ivf USING (query_id, vec_id) GROUP BY 1)")
def recall_ivf(spark, d):
    base, q = _base(spark, d), _queries(spark, d)
    truth = evaluate.build_ground_truth(base, q, K, "l2")
    return _rounded(evaluate.mean_recall(_ivf(spark, d).search(q, K, NPROBE), truth, K), "recall")


@query(f"WITH {_I8}, got AS ({_I8_TOP.format(k=K)}), truth AS ({_TOP_DOT}) SELECT query_id, vec_id FROM truth SEMI JOIN got USING (query_id, vec_id)")
def recall_hits(spark, d):
    """The rows of the ground truth that a search has found."""
    base, q = _base(spark, d), _queries(spark, d)
    return evaluate.hits(search.exact_search(tables.quantize_int8(base), q, K, "dot", "int8"), evaluate.build_ground_truth(base, q, K), K)


@query(f"SELECT query_id, rank, vec_id FROM ({_TOP_DOT})")
def truth_file(spark, d):
    """Ground truth written as a binary file by numbers of the queries, and read again with its header checked."""
    base, q = _base(spark, d), _queries(spark, d)
    truth = evaluate.build_ground_truth(base, q, K).withColumn("query_id", (F.col("query_id") / 20).cast("long"))
    path = _folder(spark, "truth") + "/truth"
    n, dim = base.count(), search.dimension(base, "embedding")
    files.write_truth(truth, path, dim, n)
    return files.read_truth(spark, path, K, dim, q.count(), n).withColumn("query_id", F.col("query_id") * 20)


@query("SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS own, false AS bad FROM embeddings")
def sql_functions(spark, d):
    """The vector functions from SQL."""
    vector.register_sql(spark)
    return spark.sql("SELECT vec_id, vec_norm(embedding) AS norm, vec_dot(embedding, embedding) AS own, vec_has_nonfinite(embedding) AS bad FROM {e}", e=_base(spark, d))


_STATS = "count(value) AS n, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(1000 / avg(value), 6) AS qps"


@query(f"SELECT {_STATS} FROM events")
def latency_stats(spark, d):
    return _rounded(evaluate.latency_stats(_table(spark, d, "events"), "value"), "avg_ms", "p50_ms", "p95_ms", "p99_ms", "qps", digits=6)


@query(f"SELECT {_STATS}, round(sum(value), 4) AS total_ms, CAST(128000 AS BIGINT) AS bytes_per_query, round(128000 * 1e-6 / avg(value), 9) AS gb_per_s FROM events")
def bench_stats(spark, d):
    out = _rounded(evaluate.bench_stats(_table(spark, d, "events"), 128_000, "value"), "avg_ms", "p50_ms", "p95_ms", "p99_ms", "qps", digits=6)
    return _rounded(_rounded(out, "total_ms", digits=4), "gb_per_s")


@query("SELECT event_id, round(value + 250.0 / count(*) OVER (), 9) AS total_ms FROM events")
def staged_total(spark, d):
    return _rounded(evaluate.staged_total(_table(spark, d, "events").select("event_id", "value"), 250.0, "value").select("event_id", "total_ms"), "total_ms")


@query("SELECT 'RESULT events=' || count(*) || ' users=' || count(DISTINCT user_id) AS line FROM events")
def result_line(spark, d):
    e = _table(spark, d, "events")
    return evaluate.result_line(e.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")))


# ---- documents


@query("SELECT doc_id, sha256(CASE WHEN trim(coalesce(text, '')) = '' THEN 'short' ELSE text END) AS chosen FROM documents")
def choose_text(spark, d):
    docs = _table(spark, d, "documents").withColumn("full_text", F.lit("  ")).withColumn("abstract", F.lit("short"))
    return docs.select("doc_id", F.sha2(T.choose_text(docs, prefer_full=True), 256).alias("chosen"))


@query(f"SELECT item_id, regexp_replace(lower({_STRIP.format('text')}), '[\\s\\-_:]+', ' ', 'g') AS heading FROM benchmark")
def heading_normalize(spark, d):
    return _table(spark, d, "benchmark").select("item_id", T.normalize_heading(F.col("text")).alias("heading"))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_STRIP.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n, section, CAST(length(body) AS INTEGER) AS chars FROM t, (VALUES (0, 'introduction'), (1, 'results')) AS s(n, section) WHERE body <> ''
UNION ALL SELECT doc_id, 0, 'body', CAST(length({_STRIP.format("'front' || chr(10) || '1 Introduction' || chr(10) || text || chr(10) || 'IV. Results' || chr(10) || text")}) AS INTEGER) FROM t WHERE body = ''""")
def split_sections(spark, d):
    """The documents with headings put between their lines."""
    docs = _table(spark, d, "documents")
    text = F.concat(F.lit("front\n1 Introduction\n"), F.coalesce("text", F.lit("")), F.lit("\nIV. Results\n"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.posexplode(T.split_sections(text)).alias("n", "s")).select("doc_id", "n", "s.section", F.length("s.text").alias("chars"))


@query(_CHUNKS + " SELECT doc_id, chunk_index, chunk FROM chunks")
def chunk_documents(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.chunk(F.coalesce("text", F.lit("")))).alias("chunk_index", "chunk"))


@query("SELECT item_id, 'item-' || item_id || chr(10) || '[SECTION: body]' || chr(10) || text AS embed_text FROM (SELECT item_id, " + _STRIP.format("text") + " AS text FROM benchmark)")
def embed_template(spark, d):
    b = _table(spark, d, "benchmark")
    return b.select("item_id", T.embed_template(F.concat(F.lit("item-"), F.col("item_id")), F.lit("body"), F.col("text")).alias("embed_text"))


@query(_CHUNKS + ", n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM documents) SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS row, doc_idx, doc_id::VARCHAR AS id, chunk_index, sha256('doc-' || doc_id || chr(10) || '[SECTION: abstract]' || chr(10) || chunk) AS embed_sha256 FROM chunks JOIN n USING (doc_id)")
def chunk_numbering(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"), F.col("text").alias("abstract"))
    return E.chunked(docs).select("row", "doc_idx", "id", "chunk_index", F.sha2("embed_text", 256).alias("embed_sha256"))


_EMBED = """SELECT {id} AS id, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {id})) AS FLOAT) AS DOUBLE) AS v FROM (SELECT {id}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {id}, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM {t}) GROUP BY 1, 2)"""


@query(f"WITH q AS ({_EMBED.format(id='item_id', t='benchmark')}), e AS ({_EMBED.format(id='doc_id', t='documents')}) " + _best("SELECT q.id AS query_id, e.id AS vec_id, round(sum(q.v * e.v), 5) AS score FROM q JOIN e USING (b) GROUP BY 1, 2", K, "score", True))
def hash_embed_topk(spark, d):
    """All texts of benchmark against all documents, by block products; scores are rounded before they are ranked."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), E.embed(F.col("text")).alias("embedding"))
    items = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), E.embed(F.col("text")).alias("q"))
    return search.exact_search(docs, items, K, "dot", kernel="numpy", broadcast_bytes=search.BROADCAST_BYTES, digits=5)


_META = _CHUNKS + ", n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM documents) SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS row, doc_idx, doc_id::VARCHAR AS id, 'doc-' || doc_id AS title, 'abstract' AS section, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks JOIN n USING (doc_id)"


@query(_META)
def ingest_files(spark, d):
    """Documents written as CSV, and from there to a file of vectors and the rows' metadata, which is read again."""
    place = _folder(spark, "ingest")
    docs = _table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"), F.coalesce("text", F.lit("")).alias("abstract"))
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{place}/csv")
    E.ingest_csv(spark, f"{place}/csv", f"{place}/vectors", f"{place}/meta")
    meta = spark.read.schema("row long, doc_idx long, id string, title string, section string, chunk_index long").json(f"{place}/meta")
    return meta.join(files.read_vectors(spark, f"{place}/vectors").select(F.col("vec_id").alias("row")), "row", "left_semi")


@query("SELECT count(*) AS chunks, CAST(count(DISTINCT doc_idx) AS BIGINT) AS docs FROM (" + _META + ") WHERE doc_idx < 25")
def ingest_max_docs(spark, d):
    """Chunks of the first 25 documents, as asked for."""
    docs = _table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("abstract"))
    return E.chunked(docs, max_docs=25).agg(F.count("*").alias("chunks"), F.countDistinct("doc_idx").alias("docs"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder, below the shared checkpoint place, that driver and executors reach by the same path."""
    place = "/" + _scratch(spark, name).removeprefix("file:").lstrip("/")
    os.makedirs(place)
    return place


_ERROR = "round(sqrt(" + _l2("embedding", "back") + "), 9) AS error"


@query(f"WITH {_I8} SELECT dtype, vec_id, {_ERROR} FROM (SELECT 'float32' AS dtype, vec_id, embedding, embedding::DOUBLE[] AS back FROM embeddings UNION ALL SELECT 'float16', vec_id, embedding, {_HALF.format('embedding')} FROM embeddings UNION ALL SELECT 'int8', i8.vec_id, embedding, list_transform(codes, lambda c: CAST(CAST(c AS FLOAT) * scale AS DOUBLE)) FROM i8 JOIN embeddings USING (vec_id))")
def file_roundtrip(spark, d):
    """Written as binary files of each type and read again: each row's error."""
    base, place, out = _base(spark, d), _folder(spark, "files"), None
    for dtype in ("float32", "float16", "int8"):
        path = f"{place}/{dtype}"
        files.write_vectors(tables.quantize_int8(base) if dtype == "int8" else base, path, dtype=dtype)
        back = files.read_vectors(spark, path)
        back = tables.dequantize_int8(back) if dtype == "int8" else back.select("vec_id", "embedding")
        err = base.join(back.withColumnRenamed("embedding", "back"), "vec_id").select(F.lit(dtype).alias("dtype"), "vec_id", F.round(F.sqrt(vector.l2_squared("embedding", "back")), 9).alias("error"))
        out = err if out is None else out.unionByName(err)
    return out


_EVAL = f"""SELECT count(*) AS queries, CAST({K} AS INTEGER) AS k, true AS recall_reached, true AS timed FROM embeddings WHERE vec_id % 20 = 0"""


def _evaluated(spark, d, **options) -> DataFrame:
    base, q = _base(spark, d), _queries(spark, d)
    out = programs.evaluate(_ivf(spark, d), base, q, K, nprobe=NPROBE, warmup=0, **options)
    return out.select("queries", "k", (F.col("recall") >= 0.9).alias("recall_reached"), ((F.col("avg_ms") > 0) & (F.col("p99_ms") >= F.col("p50_ms")) & (F.col("qps") > 0)).alias("timed"))


@query(_EVAL)
def evaluate_staged(spark, d):
    return _evaluated(spark, d, refine_k=DEPTH, pipeline="staged")


@query(_EVAL)
def evaluate_interleaved(spark, d):
    return _evaluated(spark, d, refine_k=DEPTH, pipeline="interleaved", batch=64)


@query(_EVAL)
def evaluate_ann_only(spark, d):
    return _evaluated(spark, d, mode="ann_only")


@query("SELECT count(*) AS queries, true AS timed FROM embeddings WHERE vec_id % 20 = 0")
def bench_exact(spark, d):
    out = programs.bench_exact(_base(spark, d), _queries(spark, d), K, batch=64, warmup=1)
    return out.select(F.col("n").alias("queries"), ((F.col("avg_ms") > 0) & (F.col("gb_per_s") > 0)).alias("timed"))
