"""Op 3: mixing sources to target weights by capped water-filling. DataFrame functions only.

Sources are ordered by code point, null last, and weigh 3, 1, 2, 3, 1, 2, ... The mix has
``share`` times the words of the table. Targets are proportional to the weights, stop at
``epochs`` times their source's size, and the excess is shared again by weight until no target
is above its stop. With sources ordered by stop / weight this is one pass: the water level is
fixed by the first source that is not stopped.

A source's documents are repeated floor(target / size) times as a whole; for the fraction that
is left, documents are taken once more in the order of a seeded hash for as long as that brings
the sum of words nearer to the target, so it ends within half a document of it. Running sums
are made in slices of the hash range (slice totals first), so a source that holds a third of
all rows is not summed by one task.

Only rows for each source, never for each document, come together in one task (two windows over
the table of sources).

Defined cases: null and blank texts have size 0 and are repeated like the others but add no
words; a source without any words has target 0; sources of one size and weight are ordered by
name; rows that share a doc_id are documents of their own, equal ones included; an empty table gives no
rows; further columns are dropped by ``plan`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, table

WEIGHTS = (3, 1, 2)
SEED = 20
SLICE = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of each whole text; equal rows have equal keys."""
    return docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("doc_id", "text", "source").alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, docs, target) for each source of sized(source, size)."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything = W.partitionBy()
    k = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int")))
    own = own.withColumn("stop", F.col("source_size") * epochs)
    upto = everything.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("total", F.sum("source_size").over(everything) * share).withColumn("all_w", F.sum("w").over(everything))
    own = own.withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(upto), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # the first source whose stop lies above the level that is left sets the level for itself and all after it
    open_level = F.min(F.when(F.col("stop") / F.col("w") > F.col("level"), F.struct(F.col("stop") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    own = own.withColumn("open", open_level)
    target = F.when(F.col("open").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("w") * F.col("open")))
    return own.select("source", "source_size", "docs", target.alias("target"))


def plan(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source)."""
    return _planned(cut(sizes(docs)), share, epochs, weights, seed).drop("key")


def _planned(sized: DataFrame, share: float, epochs: float, weights: tuple, seed: int) -> DataFrame:
    # the hash as a whole number below 2**28; slices are ranges of it, about SLICE documents each
    named = sized.withColumn("h", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 7), 16, 10).cast("long"))
    by_source = targets(sized, share, epochs, weights).withColumn("slices", F.ceil(F.col("docs") / SLICE).cast("long"))
    by_source = by_source.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    by_source = by_source.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = named.alias("d").join(by_source.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.source_size", "s.target", "s.whole", "s.rest", F.shiftright(F.col("h") * F.col("slices"), 28).alias("slice"))
    rows = rows.withColumn("_s", F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")))
    ahead = rows.groupBy("_s", "slice").agg(F.sum("size").alias("in_slice"))
    ahead = ahead.withColumn("before_slice", F.coalesce(F.sum("in_slice").over(W.partitionBy("_s").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("in_slice")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("_s", "slice").orderBy("h", "doc_id", "size", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(ahead, ["_s", "slice"])
    once_more = F.col("before_slice") + F.col("inside") + F.col("size") / 2 <= F.col("rest")
    copies = F.col("whole") + F.when((F.col("rest") > 0) & once_more, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("int")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "key")


def mixed(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs with each row repeated as often as the plan takes it (not at all, where that is 0)."""
    planned = cut(_planned(cut(sizes(docs)), share, epochs, weights, seed).groupBy("key").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")))
    chosen = planned.where("n > 0")
    extra = "copy" + "_" * max(map(len, docs.columns))  # longer than any name of docs
    keyed = docs.withColumn(extra, F.xxhash64("doc_id", "text", "source")).alias("d")

    def repeated(rows: DataFrame, plan_: DataFrame) -> DataFrame:
        both = rows.alias("d").join(plan_.alias("c"), F.expr(f"d.`{extra}` = c.key"))
        return both.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("c.n").cast("int"))).alias(extra)).drop(extra)

    if not planned.where("rows > 1").head(1):
        return repeated(keyed, chosen)
    # equal rows stand for one another: one of them is repeated as often as all of them are taken
    several = chosen.where("rows > 1")
    one = keyed.join(several.alias("s"), F.expr(f"d.`{extra}` = s.key"), "left_semi").dropDuplicates([extra])
    return repeated(keyed, chosen.where("rows = 1")).unionByName(repeated(one, several))


def query(spark, sf_dir: str) -> DataFrame:
    """op3_mixing: all documents, 150% of all words, at most 2 epochs."""
    return plan(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5('20-' || doc_id), 1, 7) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS stop FROM s),
o AS (SELECT *, stop / w AS full_at, row_number() OVER (ORDER BY stop / w, source NULLS LAST) AS r,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN stop ELSE least(stop, w * f.level) END AS target
  FROM o LEFT JOIN (SELECT level FROM o WHERE full_at > level ORDER BY r LIMIT 1) AS f ON true),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
n AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM n
"""
