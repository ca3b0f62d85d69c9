"""Language identification by nearest centroid.

Character 1- to 3-grams are hashed into a fixed number of dimensions, weighted
by TF-IDF and normalised. Spherical k-means gives several centroids for each
language; a text gets the language of the centroid with the highest cosine,
and is rejected when it lies too far from every centroid.

Training uses a bounded sample: about ``per_lang`` texts of each language
(those with the smallest hashes of their ids), fewer where there are many
languages so that about ``max_sample`` rows, and never twice as many, are used. Prediction reads whole texts and
never looks at lang, source or id.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; repeated rows are judged one by one alike; an empty table gives an
empty result; ties go to the language that sorts first; without any training
text every result is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches

DIM_BITS = 12
DIM = 1 << DIM_BITS
UNKNOWN = "und"


@dataclass
class CentroidModel:
    """langs[i] is the language of centroids[i]; reject_below is a cosine."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: float


def _letter_table() -> np.ndarray:
    table = np.arange(128, dtype=np.uint32)
    for c in range(128):
        table[c] = ord(chr(c).lower()) if chr(c).isalpha() else 32
    return table


_ASCII = _letter_table()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of 1- to 3-grams over the whole text, in slices."""
    out = np.zeros(DIM, np.int64)
    shift = np.uint32(32 - DIM_BITS)
    step = 1 << 20
    for at in range(0, len(text), step):
        piece = f" {text[at:at + step]} ".lower()
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
        c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        two = two * np.uint32(0x165667B1)
        three = three ^ (three >> np.uint32(15))
        three = three * np.uint32(0x9E3779B1)
        out += np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.intp), minlength=DIM)
    return out


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are spread by farthest-first from the mean."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds].copy()
    for _ in range(rounds):
        label = np.argmax(x @ centres.T, 1)
        for i in range(len(centres)):
            if (own := label == i).any():
                m = x[own].mean(0)
                centres[i] = m / max(float(np.sqrt(m @ m)), 1e-12)
    return centres


def training_ids(docs: DataFrame, eligible: Column, id_col: str, lang_col: str, per_lang: int, max_sample: int) -> list:
    """(id, lang) of the bounded sample: ids whose hash lies below the share
    of its language's rows that is wanted. No rows are gathered by language."""
    rows = docs.where(eligible & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    most = max(1, min(per_lang, max_sample // max(1, langs)))
    counts = F.broadcast(counts) if langs <= 10_000 else counts  # a hot language is not shuffled to one task
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.join(counts, "lang").where(share < F.lit(float(most)) / F.col("n")).select("id", "lang")
    return [tuple(r) for r in picked.limit(2 * max_sample).collect()]


def fit(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, max_sample: int = 4000, centroids_per_lang: int = 4, reject_margin: float = 0.6) -> CentroidModel:
    """Learn centroids from the bounded sample of eligible rows.

    ``reject_margin`` times the first percentile of the sample's own scores is
    the distance bound for rejection.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ids = training_ids(docs, eligible, id_col, lang_col, per_lang, max_sample)
    wanted = {i for i, _ in ids}
    rows = docs.where(eligible & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["id"].isin(wanted)]
            b = b[[has_letter(t) for t in b["text"]]]
            if len(b):
                counts = [gram_counts(t) for t in b["text"]]
                at = [np.flatnonzero(c) for c in counts]
                yield pd.DataFrame({"id": b["id"].astype("string"), "lang": b["lang"], "at": [a.astype("<u2").tobytes() for a in at], "n": [c[a].astype("<u4").tobytes() for c, a in zip(counts, at, strict=True)]})

    found = rows.mapInPandas(features, "id string, lang string, at binary, n binary").collect() if wanted else []
    found.sort(key=lambda r: (r[1], r[0] or "", r[2]))
    counts = np.zeros((len(found), DIM), np.float32)
    for i, r in enumerate(found):
        counts[i, np.frombuffer(r[2], "<u2")] = np.frombuffer(r[3], "<u4")
    idf = (np.log((1 + len(found)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    langs, centres, scores = [], [], []
    names = [r[1] for r in found]
    for lang in sorted(set(names)):
        x = unit_vectors(counts[[i for i, v in enumerate(names) if v == lang]], idf)
        c = _kmeans(x, centroids_per_lang)
        langs += [lang] * len(c)
        centres.append(c)
        scores.append((x @ c.T).max(1))
    bound = reject_margin * float(np.quantile(np.concatenate(scores), 0.01)) if scores else 0.0
    return CentroidModel(langs, np.concatenate(centres) if centres else np.zeros((0, DIM), np.float32), idf, bound)


def predictor(spark, model: CentroidModel):
    """A column function: text -> struct(lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)  # fixed size: centroids x DIM floats

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            values = list(texts)
            for at in range(0, len(values), 128):
                rows = [i for i in range(at, min(at + 128, len(values))) if isinstance(values[i], str) and has_letter(values[i])]
                if rows and m.langs:
                    cos = unit_vectors(np.stack([gram_counts(values[i]) for i in rows]), m.idf) @ m.centroids.T
                    best = np.argmax(cos, 1)
                    for i, b, s in zip(rows, best, cos[np.arange(len(rows)), best], strict=True):
                        pred[i], score[i] = m.langs[b], min(1.0, max(0.0, float(s)))
            yield pd.DataFrame({"lang_pred": pred, "score": score, "rejected": [p == UNKNOWN or s < m.reject_below for p, s in zip(pred, score, strict=True)]})

    return predict.asNondeterministic()  # keeps the optimizer from running it twice


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """Every row of docs with a struct column ``out`` added."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, predictor(docs.sparkSession, model)(F.col(text_col)))


def predict_languages(docs: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs."""
    from chronoloom.llm.common import crc_mod

    held = crc_mod(F.col("doc_id"), folds) == held_fold
    model = fit(docs, ~held)
    rows = docs.select("doc_id", "text").withColumn("held_out", held)
    return identify(rows, model).select("doc_id", "held_out", F.col("lang_id.lang_pred").alias("lang_pred"), F.col("lang_id.score").alias("score"), F.col("lang_id.rejected").alias("rejected"))
