"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features. A text is lower-cased and its 1- to 3-grams of characters are hashed to 2^15 places. A
feature is (1 + log count) x IDF, scaled to length 1. Document frequencies are counted over *all*
training documents. The text is used whole.

Model. Follow-the-regularised-leader (FTRL-proximal, per coordinate) with elastic-net penalties is fitted on a
bounded sample of labelled training documents: the first of each language by a hash of (id, text), SAMPLE at most and
MOST_SAMPLE for all languages together (a documented limit of fitting alone). The MOST_LANGS most frequent labels are told apart, so a
column with junk labels stops nothing. A fifth of the sample is held back: passes over the rest end
when its loss no longer falls, and one temperature that calibrates the probabilities is fitted to it. Targets
are smoothed as in Platt's scaling, (N + 1) / (N + 2) for the true label, so that the best temperature is not 0 where all
of the held-back documents are told right; the search widens until the best one lies inside its ends.

The penalty leaves few weights: they are kept by place as (label, weight), 8 bytes each, so what is broadcast is
bounded by PLACES x MOST_LANGS of these, and is far less in fact.

Prediction sees the text alone. A text that is null or has no letter (Unicode category L; numerals and marks are none) is `und`
with score 0; so is every text when there is nothing to learn from.

Defined results: null language rows are predicted but not learned from; null ids hash as null and
count as held out of nothing (their remainder is null: not held out, not learned from); repeated
rows get equal results; an empty table gives an empty result; other columns are carried along,
columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import bounded_batches, doc_hash, load, slices, trim

BITS, GRAMS = 15, 3
PLACES = 1 << BITS
#: Labelled documents a language and in all that the classifier is fitted on, most passes over them, and most languages that it tells apart.
SAMPLE, MOST_SAMPLE, MOST_EPOCHS, MOST_LANGS = 1000, 50_000, 12, 400
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.4, 1e-4
#: A pass that lowers the held-back loss by less than this share is the last.
LEAST_GAIN = 0.01
UNDETERMINED = "und"
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_PART = 1 << 18  # characters hashed at once


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the hashed 1- to 3-grams of a whole text."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(PLACES, dtype=np.int64)
    for at in range(0, len(x), _PART):
        part = x[at : at + _PART + GRAMS - 1]
        own = min(_PART, len(x) - at)
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(GRAMS):
            m = len(part) - n
            if m <= 0:
                break
            h = (h[:m] ^ part[n:]) * _MULTIPLY[n]
            total += np.bincount((h[: min(m, own)] ^ (h[: min(m, own)] >> np.uint32(13))) >> np.uint32(32 - BITS), minlength=PLACES)
    places = np.flatnonzero(total)
    return places, total[places]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, and the weights that are not zero: those of place p are at first[p] to first[p + 1]."""

    langs: list[str]
    idf: np.ndarray
    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    passes: int = 0

    @classmethod
    def of(cls, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Model:
        place, label = np.nonzero(weights)
        first = np.searchsorted(place, np.arange(PLACES + 1))
        return cls(langs, idf, first, label.astype(np.int32), weights[place, label].astype(np.float32), bias)

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(self.idf, places, counts)

    def scores(self, places: np.ndarray, vector: np.ndarray) -> np.ndarray:
        n = self.first[places + 1] - self.first[places]
        at = np.repeat(self.first[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.label[at], np.repeat(vector, n) * self.weight[at], len(self.langs)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        places, counts = feature_counts(text)
        z = self.scores(places, self.vector(places, counts)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def weighted(idf: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[places]
    return v / max(1e-12, np.sqrt((v * v).sum()))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def smoothed_loss(scores: np.ndarray, labels: np.ndarray, temperature: float) -> float:
    """Mean cross entropy with Platt's targets: (N + 1) / (N + 2) for the true label, the rest even."""
    n, k = scores.shape
    p = np.log(np.maximum(_softmax(scores / temperature), 1e-300))
    true, miss = p[np.arange(n), labels], 1 / (n + 2)
    return float(-((1 - miss) * true + miss * (p.sum(axis=1) - true) / max(1, k - 1)).mean())


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least smoothed loss, by golden-section search over its logarithm; the ends move out until it lies inside."""
    if not len(labels) or scores.shape[1] < 2:
        return 1.0
    ratio, wide = (np.sqrt(5) - 1) / 2, np.log(16.0)
    while True:
        lo, hi = -wide, wide
        for _ in range(60):
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if smoothed_loss(scores, labels, np.exp(a)) <= smoothed_loss(scores, labels, np.exp(b)) else (a, hi)
        if abs(lo + hi) / 2 < 0.99 * wide or wide > 100:  # beyond e^100 nothing changes: all scores are equal
            return float(np.exp((lo + hi) / 2))
        wide *= 2


def fit(langs: list[str], idf: np.ndarray, places: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over the documents in the order given; each fifth one only ends the passes and sets the temperature."""
    n_lang = len(langs)
    vectors = [weighted(idf, p, c) for p, c in zip(places, counts)]
    held = np.arange(len(labels)) % 5 == 4
    # the last place is the bias, which is not penalised
    z, g2 = np.zeros((PLACES + 1, n_lang)), np.zeros((PLACES + 1, n_lang))
    rng, rows = np.random.default_rng(7), np.flatnonzero(held)

    def weight(at: np.ndarray) -> np.ndarray:
        zz, l1 = z[at], np.where(at == PLACES, 0.0, L1)[:, None]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    def fitted() -> Model:
        weights = np.concatenate([weight(np.arange(lo, min(lo + 4096, PLACES))) for lo in range(0, PLACES, 4096)])
        return Model.of(langs, idf, weights, weight(np.array([PLACES]))[0])

    loss, passes = np.inf, 0
    while passes < MOST_EPOCHS:
        for k in rng.permutation(np.flatnonzero(~held)).tolist():
            at, x = np.append(places[k], PLACES), np.append(vectors[k], 1.0)
            w = weight(at)
            p = _softmax(x @ w)
            p[labels[k]] -= 1
            grad = x[:, None] * p
            more = g2[at] + grad * grad
            z[at] += grad - (np.sqrt(more) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] = more
        model, passes = fitted(), passes + 1
        scores = np.stack([model.scores(places[k], vectors[k]) for k in rows]) if len(rows) else np.zeros((0, n_lang))
        model.temperature, model.passes = best_temperature(scores, labels[rows]), passes
        before, loss = loss, smoothed_loss(scores, labels[rows], model.temperature) if len(rows) else 0.0
        if loss > before * (1 - LEAST_GAIN):
            return model
    return model if passes else fitted()


def _document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many documents have each place, over all of docs; and the number of documents."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(PLACES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                if has_letter(text):
                    df[feature_counts(text)[0]] += 1
                    n += 1
            trim()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*df[at].tolist(), n], pa.int64())], names=["place", "n"])

    out, n = np.zeros(PLACES), 0
    for r in docs.select(text_col).mapInArrow(work, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if r["place"] < 0:
            n = r["n"]
        else:
            out[r["place"]] = r["n"]
    return out, n


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows of docs (all of them may be learned from)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    df, n = _document_frequencies(labelled, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    # the first of each language by hash: of large languages, only hashes that can be among them are sorted
    at = F.shiftrightunsigned(doc_hash(id_col, text_col), 1)
    counted = labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "_lang").limit(MOST_LANGS)
    sizes = {r["_lang"]: r["n"] for r in counted.collect()}
    sample = min(sample, max(1, MOST_SAMPLE // max(1, len(sizes))))
    share = {lang: (3 * sample + 100) / n for lang, n in sizes.items()}
    most = {lang: int(x * (1 << 63)) if x < 1 else (1 << 63) - 1 for lang, x in share.items()}
    limits = docs.sparkSession.createDataFrame(list(most.items()), "_lang string, _most long")
    likely = labelled.select(F.col(lang_col).alias("_lang"), at.alias("_hash"), id_col, text_col).join(F.broadcast(limits), "_lang").where("_hash <= _most")
    order = Window.partitionBy("_lang").orderBy("_hash", id_col)
    picked = likely.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, h, *feature_counts(t)) for lang, h, t in zip(batch.column("_lang").to_pylist(), batch.column("_hash").to_pylist(), batch.column(text_col).to_pylist()) if has_letter(t)]
            cols = [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
            cols[2], cols[3] = [x.astype(np.uint16).tobytes() for x in cols[2]], [x.astype(np.uint32).tobytes() for x in cols[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "h", "places", "counts"])

    rows = picked.mapInArrow(work, "lang string, h long, places binary, counts binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    langs = sorted(set(rows["lang"].to_pylist()))
    places = [np.frombuffer(x, np.uint16).astype(np.int64) for x in rows["places"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32).astype(np.float64) for x in rows["counts"].to_pylist()]
    labels = np.array([langs.index(x) for x in rows["lang"].to_pylist()], dtype=np.int64)
    return fit(langs, idf, places, counts, labels)


def identify(df: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep_text: bool = True) -> DataFrame:
    """df with the predicted language and its calibrated probability."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c.lower() not in (lang_out, score_out) and (keep_text or c != text_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            for part in slices(batch, text_col):
                found = [predict(t) for t in part.column(text_col).to_pylist()]
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=[*kept, lang_out, score_out])

    fields = {f.name: f for f in df.schema.fields}
    return df.mapInArrow(work, T.StructType([*(fields[c] for c in kept), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_split(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(train_split(docs))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False)
