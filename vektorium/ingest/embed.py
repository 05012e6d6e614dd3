"""Embedding providers and the whole way from documents to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..sources import files
from . import text as T

DIM = 64


def hashing(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """The default provider, without a model: words of the lower-cased text are counted in buckets by MD5.
    It shows which words texts share, nothing of their sense."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                row[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
        return out

    return run


def embed(text: Column, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing, batch: int = 256) -> Column:
    """array<float> of unit length for each text. make() is called once in each Python worker, so a model is loaded once.
    Texts go to Python in small batches."""
    small_batches(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for part in parts:
            texts, rows = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                x = np.asarray(provider(texts[at : at + batch]), np.float64)
                n = np.sqrt((x * x).sum(axis=1, keepdims=True))
                rows += list((x / np.where(n > 0, n, 1)).astype(np.float32))
            yield pd.Series(rows, dtype=object)

    return run(text)


def chunked(docs: DataFrame, key: str = "doc_id", id_col: str = "id", title: str = "title", abstract: str = "abstract", prefer_full: bool = False, size: int = 2000, max_docs: int | None = None) -> DataFrame:
    """(row, doc_idx, id, title, section, chunk_index, embed_text) of all chunks of docs.

    Documents are numbered by key; one without text keeps its number. chunk_index goes on across the
    sections of a document.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    abs_ = name(abstract) if prefer_full else F.lit("")
    chosen = T.choose_text(docs, abstract, prefer_full)
    rows = docs.select(F.col(key).alias("key"), name(id_col).alias("id"), name(title).alias("title"), chosen.alias("chosen"), abs_.alias("abs"))
    rows = T.numbered(rows, "key", ["id"], "doc_idx")
    if max_docs is not None:
        rows = rows.where(F.col("doc_idx") < max_docs)
    parts = T.split_sections(F.col("chosen"), F.col("abs")) if prefer_full else F.array(F.struct(F.lit("abstract").alias("section"), F.col("chosen").alias("text")))
    rows = rows.select("doc_idx", "id", "title", F.posexplode(parts).alias("s", "part"))
    rows = rows.select("doc_idx", "id", "title", "s", F.col("part.section").alias("section"), F.posexplode(T.chunk(F.col("part.text"), size)).alias("c", "chunk"))
    before = F.row_number().over(T.W.partitionBy("doc_idx").orderBy("s", "c")) - 1
    rows = rows.withColumn("chunk_index", before)
    rows = rows.withColumn("embed_text", T.embed_template(F.col("title"), F.col("section"), F.col("chunk")))
    out = T.numbered(rows.persist(), "doc_idx", ["chunk_index"], "row")  # cut once; lost blocks are cut again
    return out.select("row", "doc_idx", "id", "title", "section", "chunk_index", "embed_text")


def ingest(docs: DataFrame, make: Callable = hashing, **options) -> DataFrame:
    """chunked() with embedding array<float>; vec_id repeats row. Write it with write_vectors and write_rowmeta."""
    rows = chunked(docs, **options)
    return rows.withColumn("embedding", embed(F.col("embed_text"), make)).withColumn("vec_id", F.col("row"))


def ingest_csv(spark: SparkSession, csv: str, vectors: str, meta: str, make: Callable = hashing, key: str = "doc_id", columns: tuple = ("id", "title", "abstract", *T.FULL_TEXT), **options) -> DataFrame:
    """From CSV to a binary file of vectors and JSON lines of the rows' metadata; (rows, docs, dim) of what was written.

    The key column holds whole numbers, by which documents are numbered; columns that are not there count as empty.
    """
    docs = files.read_csv(spark, csv, [key, *columns])
    rows = ingest(docs.withColumn(key, F.col(key).cast("long")), make, key=key, **options).persist()
    files.write_vectors(rows, vectors)
    files.write_rowmeta(rows, meta)
    out = rows.agg(F.count("*").alias("rows"), F.countDistinct("doc_idx").alias("docs"), F.max(F.size("embedding")).alias("dim"))
    return spark.createDataFrame(out.collect(), out.schema)
