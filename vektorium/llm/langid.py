"""Op 10: language identification by sparse multinomial logistic regression.

Features are character n-grams (1 to 3 code points of the lower-cased text) hashed to 2**14
columns, weighted by (1 + log tf) * idf and scaled to unit length. Document frequencies are
counted over every labelled document that may be learned from. The regression is trained with
FTRL-proximal and elastic-net penalties on a sample of at most ``per_label`` documents of each
label, those with the smallest hashes of doc_id and text, then calibrated with one temperature on
a part of that sample that it was not trained on.

The sample is taken without bringing a label's rows together: a bound of the hash that about four
times ``per_label`` documents stay under is set from the label's distinct count (sketches, merged
map-side), and only hashes under it are gathered; where too few are, the bound is raised. At most
``MOST_LABELS`` labels are learned (more raise an error), which bounds the model that is broadcast.

Learned from are rows with a text, a non-null lang and crc32(doc_id as text) mod 5 <> 0.
Predictions see the text alone.

Defined cases: ``und`` with score 0 for a null text, a text without any letter, and every text if
there is nothing to learn from; repeated rows are predicted alike and sampled once, rows that share a
doc_id but not the text are documents of their own; null doc_id counts as the empty string for the
fold; an empty table gives no rows; further columns are dropped by ``predict`` and kept by
``accepted``, which keeps every text with a letter where there is no model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import squeeze, unsqueeze
from .shared import table

BITS = 14
PER_LABEL = 500
MOST_LABELS = 400
SLACK = 64
_LETTER = regex.compile(r"\p{L}")
_STEP = 1 << 20


def counts(text: str, bits: int = BITS, orders: int = 3) -> np.ndarray:
    """How often each hashed n-gram of the whole text occurs."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(1 << bits, np.int64)
    for at in range(0, len(cp), _STEP):
        g = np.zeros(0, np.uint64)
        for n in range(1, orders + 1):
            part = cp[at : at + _STEP + n - 1]
            g = part if n == 1 else g[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :]
            h = g * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            out += np.bincount(((h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return out


def weigh(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and unit-length TF-IDF values; the last column is the constant 1."""
    at = np.flatnonzero(c)
    v = (1 + np.log(c[at])) * idf[at]
    return np.append(at, len(idf)), np.append(v / max(np.sqrt((v * v).sum()), 1e-12), 1.0)


class Ftrl:
    """Multinomial logistic regression, FTRL-proximal per coordinate, with L1 and L2 penalties."""

    def __init__(self, features: int, labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((features, labels)), np.zeros((features, labels))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[label] -= 1
        g = v[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of smallest negative log-likelihood, on a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _fold() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _sample(hashes: DataFrame, per_label: int) -> list[tuple[str, int]]:
    """(lang, h): the per_label smallest distinct h of each lang."""
    sizes = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    low, high = -(1 << 63), (1 << 63) - 1
    open_ = {lang: min(1.0, (4 * per_label + SLACK) / max(1, n)) for lang, n in sizes.items()}
    out = []
    while open_:
        bounds = {lang: high if part >= 1 else low + int(part * (1 << 64)) for lang, part in open_.items()}
        few = F.broadcast(hashes.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound long"))
        under: dict = {lang: [] for lang in open_}
        for r in hashes.join(few, "lang").where("h <= bound").select("lang", "h").distinct().collect():
            under[r["lang"]].append(r["h"])
        for lang, h in under.items():
            if len(h) >= per_label or bounds[lang] == high:
                out += [(lang, x) for x in sorted(h)[:per_label]]
                del open_[lang]
            else:
                open_[lang] = min(1.0, 4 * open_[lang])
    return sorted(out)


def train(docs: DataFrame, per_label: int = PER_LABEL, epochs: int = 4, seed: int = 7) -> dict | None:
    """A model (labels, idf, weights, temperature) from docs(doc_id, text, lang); None if there is nothing to learn from."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (_fold() != 0))
    size = 1 << BITS

    def frequencies(batches):
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            for x in b.column(0):
                df += counts(x.as_py()) > 0
                n += 1
        if n:  # in slices, so that sums are made by many tasks
            for k in range(0, size, 1024):
                yield pa.RecordBatch.from_arrays([pa.array(range(k, k + 1024), pa.int32()), pa.array(df[k : k + 1024]), pa.array(np.full(1024, n if k == 0 else 0))], ["k", "df", "n"])

    got = usable.select("text").mapInArrow(frequencies, "k int, df long, n long").groupBy("k").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    df = np.zeros(size)
    df[got["k"].to_numpy()] = got["df"].to_numpy()
    total = float(got["n"][got["k"] == 0].iloc[0])
    idf = np.log((1 + total) / (1 + df)) + 1

    chosen = _sample(usable.select("lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")), per_label)

    def features(batches):
        for b in batches:
            blobs = [(c := counts(x.as_py())) is not None and (squeeze(np.flatnonzero(c).astype(np.uint16)), squeeze(c[c > 0].astype(np.uint32))) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in blobs], pa.binary()), pa.array([x[1] for x in blobs], pa.binary())], ["lang", "h", "at", "c"])

    # a bounded amount: per_label documents of each of MOST_LABELS labels at most
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h long"))
    picked = usable.withColumn("h", F.xxhash64("doc_id", "text", F.lit(seed))).join(few, ["lang", "h"], "left_semi").select("lang", "h", "text")
    rows = picked.mapInArrow(features, "lang string, h long, at binary, c binary").dropDuplicates(["lang", "h"]).collect()
    labels = sorted({r["lang"] for r in rows})
    examples = []
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        c = np.zeros(size, np.int64)
        c[unsqueeze(r["at"], np.uint16)] = unsqueeze(r["c"], np.uint32)
        examples.append((*weigh(c, idf), labels.index(r["lang"])))
    rng = np.random.default_rng(seed)
    rng.shuffle(examples)
    held = examples[: len(examples) // 5]
    model = Ftrl(size + 1, len(labels))
    learn = examples[len(held) :] or examples
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            model.learn(*learn[k])
    w = model.weights()
    t = temperature(np.array([v @ w[at] for at, v, _ in held]), np.array([y for _, _, y in held])) if held else 1.0
    return {"labels": labels, "idf": idf, "weights": w, "temperature": t}


def score(text: str | None, model: dict | None) -> tuple[str, float]:
    """Label and calibrated probability of one text."""
    if model is None or text is None or not _LETTER.search(text):
        return "und", 0.0
    at, v = weigh(counts(text), model["idf"])
    p = softmax(v @ model["weights"][at] / model["temperature"])
    k = int(np.argmax(p))
    return model["labels"][k], float(p[k])


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). The model (2**14 columns for each label) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [score(x.as_py(), sent.value) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), (_fold() == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language with a score of ``least`` or more (without a model: has a letter); all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        if sent.value is None:
            return pd.Series([x is not None and bool(_LETTER.search(x)) for x in texts], dtype=bool)
        got = [score(x, sent.value) for x in texts]
        return pd.Series([g[0] != "und" and g[1] >= least for g in got], dtype=bool)

    return docs.where(known(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """op10_language_id: trained on the documents outside the held-out fold, predicting every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


SQL = None
