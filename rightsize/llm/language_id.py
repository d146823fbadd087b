"""Language ID: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader (FTRL-proximal) and elastic
net, then calibrated by a temperature.

Character n-grams (1 to ``orders`` characters, lower-cased, anything but letters
read as a blank) are hashed to ``2**bits`` features. Document frequencies come
from all texts to learn from; a partition sends one row per feature at most. The
classifier is fitted on a sample of at most about ``sample`` documents, spread
evenly over the languages and drawn by a hash of the text; whole texts, of which
only the n-gram counts reach the driver. A fifth of the sample is held back to
fit the temperature. Scoring is one pass: the mean of idf-weighted coefficients
over a text's n-grams.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without documents to learn from every text is; equal texts get equal results;
rows with a null doc_id or lang are not learned from; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rightsize.llm.byte_bpe import LETTER, char_classes
from rightsize.llm.common import raw_bytes, slices, tidy

UNKNOWN = "und"
SCALE = 100.0  # of term frequencies, which are shares of a text's n-grams


def grams(texts: pa.Array, classes: np.ndarray, bits: int, orders: int):
    """(feature, row) of every n-gram, an array pair for each order, and whether each text has a letter."""
    data, bounds = raw_bytes(pc.utf8_lower(texts))
    if not len(data):
        return [], np.zeros(len(texts), bool)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter = classes[points] == LETTER
    points = np.where(letter, points, np.uint32(32))
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(at, bounds)))
    has = np.bincount(of[letter], minlength=len(texts)) > 0
    out, code = [], np.zeros(len(points), np.uint32)
    for n in range(1, orders + 1):
        if len(points) < n:
            break
        code = (code[: len(points) - n + 1] * np.uint32(0x01000193)) + points[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        h = code ^ (code >> np.uint32(15))
        h = h * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)
        rows = of[: len(code)]
        inside = rows == of[n - 1 :]
        out.append((h[inside], rows[inside]))
    return out, has


def _frequencies(classes, bits, orders):
    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        docs = 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                for at in range(0, part.num_rows, 512):
                    few = part.slice(at, 512)
                    found, has = grams(few["text"], classes.value, bits, orders)
                    seen = np.zeros((few.num_rows, 1 << bits), bool)
                    for h, rows in found:
                        seen[rows, h] = True
                    total += seen[has].sum(axis=0)
                    docs += int(has.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], docs))], names=["feature", "n"])

    return tidy(run)


def _counts(classes, bits, orders):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                found, has = grams(part["text"], classes.value, bits, orders)
                if not found:
                    continue
                code = np.concatenate([rows.astype(np.int64) << bits | h for h, rows in found])
                code, n = np.unique(code, return_counts=True)
                cuts = np.searchsorted(code, np.arange(part.num_rows + 1, dtype=np.int64) << bits)
                h = (code & ((1 << bits) - 1)).astype(np.uint32)
                keep = np.flatnonzero(has).tolist()
                yield pa.RecordBatch.from_arrays([part["lang"].take(pa.array(keep, pa.int64())), part["draw"].take(pa.array(keep, pa.int64())), *(pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in keep], pa.binary()) for x in (h, n.astype(np.uint32)))], names=["lang", "draw", "feature", "n"])

    return tidy(run)


class Ftrl:
    """FTRL-proximal for a softmax over ``classes``, one document at a time."""

    def __init__(self, features: int, classes: int, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
        self.z = np.zeros((features + 1, classes))  # the last row is the bias
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.
    Labels are smoothed by one document for each class, so that a sample without
    errors does not call for certainty."""
    n, k = logits.shape
    goal = np.full((n, k), 1.0 / (n + k))
    goal[np.arange(n), labels] += n / (n + k)
    loss = lambda t: -(goal * np.log(softmax(logits / np.exp(t)) + 1e-300)).sum(axis=1).mean()
    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(learn: DataFrame, classes, bits: int = 15, orders: int = 3, sample: int = 2000, epochs: int = 4) -> dict:
    """The model of ``learn(text, lang)``: idf-weighted coefficients, bias, temperature, languages."""
    read = learn.select("text", F.col("lang").cast("string").alias("lang"))
    rows = read.select("text").mapInArrow(_frequencies(classes, bits, orders), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
    feature, n = (rows[c].to_numpy() for c in ("feature", "n"))
    frequency = np.zeros(1 << bits)
    frequency[feature[feature >= 0]] = n[feature >= 0]
    docs = int(n[feature < 0].sum())
    per_lang = {r["lang"]: r["n"] for r in read.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(per_lang)
    if not docs:
        return {"langs": []}
    idf = np.log((1 + docs) / (1 + frequency)) + 1
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, sample / len(langs) / per_lang[k]))))
    draw = F.xxhash64("text", F.lit("sample"))
    drawn = read.select("text", "lang", draw.alias("draw")).filter(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    taken = sorted(drawn.mapInArrow(_counts(classes, bits, orders), "lang string, draw long, feature binary, n binary").toArrow().to_pylist(), key=lambda r: (r["draw"], r["lang"], r["feature"]))
    data = []
    for r in taken:
        f, n = np.frombuffer(r["feature"], np.uint32).astype(np.int64), np.frombuffer(r["n"], np.uint32)
        data.append((np.append(f, 1 << bits).astype(np.int32), np.append(SCALE * n / n.sum() * idf[f], 1.0).astype(np.float32), langs.index(r["lang"])))
    del rows, taken
    pa.default_memory_pool().release_unused()
    held = data[::5] if len(data) >= 50 else data
    train = [d for i, d in enumerate(data) if i % 5] if len(data) >= 50 else data
    model = Ftrl(1 << bits, len(langs))
    for _ in range(epochs):
        for d in train:
            model.learn(*d)
    w = model.weights()
    t = temperature(np.array([x @ w[f] for f, x, _ in held]), np.array([k for *_, k in held]))
    return {"langs": langs, "w": (SCALE * w[:-1] * idf[:, None]).astype(np.float32), "bias": w[-1], "t": t, "bits": bits, "orders": orders}


def _predict(classes, model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                n = part.num_rows
                langs, score = [UNKNOWN] * n, np.zeros(n)
                if m["langs"]:
                    found, has = grams(part["text"], classes.value, m["bits"], m["orders"])
                    sums, total = np.zeros((n, len(m["langs"]))), np.zeros(n)
                    for h, rows in found:
                        total += np.bincount(rows, minlength=n)
                        for k in range(len(m["langs"])):
                            sums[:, k] += np.bincount(rows, weights=m["w"][h, k], minlength=n)
                    p = softmax((sums / np.maximum(total, 1)[:, None] + m["bias"]) / m["t"])
                    best = p.argmax(axis=1)
                    langs = [m["langs"][b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has.tolist())]
                    score = np.where(has, p[np.arange(n), best], 0.0)
                rest = [part[c] for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*(c for c in part.schema.names if c != "text"), "lang_pred", "score"])

    return tidy(run)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs(doc_id, text, lang)``."""
    share = docs.sparkSession.sparkContext.broadcast
    classes = share(char_classes())
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = share(fit(learn, classes, **options))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return read.mapInArrow(_predict(classes, model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` in a language that was learned, with all their
    columns: those that are not ``und`` and score ``least`` or more."""
    share = docs.sparkSession.sparkContext.broadcast
    classes = share(char_classes())
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = share(fit(learn, classes, **options))
    # the columns pass through the scoring task, the text twice (once to be read, once to be kept)
    named = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = named.drop("text").schema.add("lang_pred", "string").add("score", "double")
    out = named.mapInArrow(_predict(classes, model), schema)
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
