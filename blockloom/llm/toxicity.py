"""Toxicity by a counterfactual-regularised logistic regression.

Features are the presence of a word and of its leading bytes (so that inflected forms share
evidence), hashed. Training texts that mention a group are copied with the group's name
swapped for another one, and the loss holds a penalty on the squared change of the score, so
that naming a group is no evidence by itself. The model is fitted on a bounded sample of
labelled rows in one task and has a bounded number of weights; scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import words as W
from blockloom.llm.common import unused

U = np.uint64
SAMPLE = 8000  # labelled rows that the model is fitted on, at most
SAMPLE_CHARS = 40_000  # longer texts aren't fitted on
FEATURES = 16_384  # weights, at most
BITS = 22
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
# Terms for groups of people; each row's terms are swapped for one another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("transgender", "cisgender"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"), ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("blind", "deaf", "disabled"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, end byte) of every word and of each prefix shorter than the word; texts are lower case.
    ASCII punctuation around a word is left out."""
    raw, offsets = W.flat(texts)
    starts, ends, first = W.spans(raw, offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mark = np.zeros(256, bool)
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    for _ in range(4):
        if len(starts):
            starts = starts + (mark[raw[starts]] & (ends - starts > 1))
            ends = ends - (mark[raw[ends - 1]] & (ends - starts > 1))
    out_doc, out_feature = [doc], [W.word_hashes(raw, starts, ends, 7)]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        out_doc.append(doc[longer])
        out_feature.append(W.mix(W.word_hashes(raw, starts[longer], starts[longer] + k, 7) + U(k)))
    return np.concatenate(out_doc), (np.concatenate(out_feature) >> U(64 - BITS)).astype(np.int64), np.diff(offsets)


def term_features(term: str) -> np.ndarray:
    return np.unique(features(pa.array([term]))[1])


def fit(texts: list[str], toxic: np.ndarray, strength: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights, and the bias. `strength` weighs the counterfactual penalty."""
    n = len(texts)
    if not n or toxic.min() == toxic.max():
        return np.zeros(0, np.int64), np.zeros(0), -8.0
    keys = []
    for lo in range(0, n, 500):
        doc, feature, _ = features(pa.array(texts[lo : lo + 500]))
        keys.append(np.unique((doc + lo) << BITS | feature))
    doc, feature = (k := np.concatenate(keys)) >> BITS, k & ((1 << BITS) - 1)
    is_toxic = toxic.astype(bool)
    hit = np.bincount(feature[is_toxic[doc]], minlength=1 << BITS)
    some = np.flatnonzero(hit >= 3)  # all that follows is on these alone, as the whole space is large
    miss = np.bincount(feature[~is_toxic[doc]], minlength=1 << BITS)[some].astype(float)
    hit = hit[some].astype(float)
    p, q = is_toxic.sum(), n - is_toxic.sum()
    odds = np.log((hit + 0.5) / (p - hit + 0.5)) - np.log((miss + 0.5) / (q - miss + 0.5))
    sure = odds / np.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5) + 1 / (p - hit + 0.5) + 1 / (q - miss + 0.5))
    best = np.argsort(-sure, kind="stable")[:FEATURES]
    best = some[best[sure[best] > 2.5]]
    pairs = [(a, b) for row in IDENTITY for a in row for b in row if a != b]
    own = {t: term_features(t) for t in {t for pair in pairs for t in pair}}
    chosen = np.unique(np.concatenate([best, *own.values()]))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = place[feature] >= 0
    doc, col = doc[kept], place[feature[kept]]
    change = _counterfactuals(texts, own, place)
    y = is_toxic.astype(float)
    weight = np.where(is_toxic, min(20.0, n / p), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(len(chosen)), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[col], n) + bias
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, r[doc], len(w)) + 2e-5 * w
        if len(change):
            rows, cols, signs = change.T
            moved = np.bincount(rows, w[cols] * signs, rows.max() + 1)
            g += strength * 2 / n * np.bincount(cols, moved[rows] * signs, len(w))
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        w = w - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return chosen, w, float(bias)


def _counterfactuals(texts: list[str], own: dict[str, np.ndarray], place: np.ndarray) -> np.ndarray:
    """Rows (pair, column, sign): what changes when a text's term is swapped for another of its row."""
    out, k = [], 0
    for text in texts:
        for row in IDENTITY:
            for a in row:
                if a in text and a in (words := {x.strip(".,;:!?\"'()") for x in text.split()}):
                    for b in row:
                        if b not in words:
                            gone, new = np.setdiff1d(own[a], own[b]), np.setdiff1d(own[b], own[a])
                            out += [(k, int(place[f]), -1) for f in gone] + [(k, int(place[f]), 1) for f in new]
                            k += 1
    return np.array(out, np.int64).reshape(-1, 3)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(i, x, y) for b in batches for i, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))  # the same order whatever the shuffle brought first
    chosen, w, bias = fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
    used = np.flatnonzero(np.abs(w) > 1e-4)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[chosen[used], -1].astype(np.int64)), pa.array(np.r_[w[used], bias])], ["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict[int, float]:
    """Weights by feature (the bias under -1), fitted on the `sample` labelled rows of lowest hashed
    id among those whose crc32(id as text) mod 3 isn't 1 and whose text has at most SAMPLE_CHARS
    characters. An id with several labels counts as toxic if one says so; of several texts of an id the
    least is fitted. Null ids, labels and texts are not fitted; without rows of both labels every
    score is that of the bias -8."""
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marks = marks.where(~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # ids are distinct: bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lower(F.col(text_col)).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    met = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row an id
    rows = met.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic"))
    fitted = rows.coalesce(64).repartition(1).mapInArrow(_fit_task, "feature bigint, weight double")
    return {-1: -8.0} | {r.feature: r.weight for r in fitted.collect()}  # at most FEATURES and the identity terms


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    doc, feature, _ = features(texts)
    some = weights[feature] != 0
    key = np.unique(doc[some] << BITS | feature[some])
    z = np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column `score_col` (0 to 1) from the whole text; a null text counts as empty. Only
    the text is read by the model. A column of that name in `docs` is replaced; all others, null ids
    and repeated rows are carried along; an empty table gives an empty result."""
    docs = docs.drop(score_col)
    names, low = docs.columns, unused(docs, "low")
    bias = model.get(-1, -8.0)
    at = np.array(sorted(k for k in model if k >= 0), np.int64)
    value = np.array([model[k] for k in at.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[at] = value
        for batch in batches:
            for part in W.slices(batch, low, 1 << 20):
                got = score_texts(part.column(low), weights, bias)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(got)], [*names, score_col])

    schema = docs.schema.add(score_col, "double")
    return docs.withColumn(low, F.lower(F.col(text_col))).mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), model)
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
