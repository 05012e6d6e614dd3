"""Small tables with edges: nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    None,
    "",
    "  \n\t ",
    "one",
    "The quick brown fox jumps over the lazy dog\nand runs away from it all day",
    "The quick brown fox jumps over the lazy dog\nand runs away from it all day",
    "the quick brown fox jumps over the lazy dog again\nÜber den Wolken, naïve café — 漢字 😀",
    f"before it {PASSAGE} after it",
    f"something else {PASSAGE}\n{PASSAGE}",
    LONG,
    LONG + " end",
    "12345 67890 !!!",
    "released under the MIT License, see CC BY and Apache License\nGNU General Public License gnu general public license",
    "x" * 5_000,
]
#: further columns whose names are used inside the operators
CLASH = ["c0", "c1", "pack", "blob", "h", "size", "copies", "target", "digest", "slice", "fp", "rep", "key", "rank", "ids", "n", "component", "copy of the mix", "w", "label"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASH])


def rows():
    out = [(i, t, None if i == 3 else "en", None if i % 5 == 1 else f"s{i % 3}", None if t is None else len(t), *[None] * len(CLASH)) for i, t in enumerate(TEXTS)]
    out.append(out[4])  # a repeated row
    out.append((None, TEXTS[4], None, None, None, *[None] * len(CLASH)))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def kept(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def components(ids, linked):
    """Smallest id reachable for each of ids, by brute force; ids may be None."""
    at = {i: i for i in range(len(ids))}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                at[root(a)] = root(b)
    low = {}
    for i, v in enumerate(ids):
        if v is not None:
            low[root(i)] = min(v, low.get(root(i), v))
    return [low.get(root(i)) for i in range(len(ids))]
