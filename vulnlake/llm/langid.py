"""Language identification by nearest centroid: normalised TF-IDF vectors of hashed
character n-grams, several k-means centroids a language, cosine, and a distance limit
beyond which a text is marked as rejected.

N-grams run over the UTF-8 bytes of letters (A-Z lower-cased, everything that is not a
letter as one space), so a text needs no decoding.  Document frequencies cover all
training documents; the centroids are fitted on a bounded sample of them, one task a
language.  Scoring is one map over the documents with the small model (``WIDTH`` floats a
centroid) in the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import batch, grouped, raw_text, rows

WIDTH = 4096
CLUSTERS = 4
SAMPLE = 400
MOST_LANGUAGES = 1_000
UNDETERMINED = "und"

#: A-Z to a-z, a-z and bytes of 0x80 or more as they are, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
OUT_SQL = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def counts(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the whole text."""
    t = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = t[:-1] * np.uint32(0x9E3779B1) ^ t[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ t[2:] * np.uint32(0x27D4EB2F)
    out = np.zeros(width, np.int64)
    for salt, g in ((1, t), (2, two), (3, three)):
        h = (g + np.uint32(salt)) * np.uint32(0x9E3779B1)
        out += np.bincount((h >> np.uint32(7)) % np.uint32(width), minlength=width)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    tf = np.array([counts(t, len(idf)) for t in texts], np.float32).reshape(-1, len(idf))
    return unit(np.log1p(tf) * idf)


def centroids(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means; each start is the row farthest from those before."""
    c = [unit(x.mean(0))]
    for _ in range(min(k, len(x)) - 1):
        c.append(x[np.argmin((x @ np.array(c).T).max(1))])
    c = np.array(c)
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        c = np.array([unit(x[near == j].mean(0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]
    centres: np.ndarray  # one row a centroid
    owner: np.ndarray  # its language
    limit: np.ndarray  # its largest accepted distance

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        """(language, cosine in 0..1, rejected) of each text; ties go to the first language."""
        if not self.names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cos = vectors(texts, self.idf) @ self.centres.T
        best = cos.argmax(1)
        top = cos[np.arange(len(texts)), best]
        return ([self.names[self.owner[b]] for b in best], np.clip(top, 0, 1).astype(float).tolist(),
                (1 - top > self.limit[best]).tolist())


def fit(docs: DataFrame, width: int = WIDTH, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Model of ``docs`` (doc_id, text, lang), all of them training rows.

    Rows without a language or without a letter teach nothing.  At most ``sample`` documents a
    language (smallest id hash) make its centroids."""
    use = docs.where(F.col("lang").isNotNull()).select("doc_id", raw_text().alias("text"), "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(width, np.int64), 0
        for (text,) in rows(batches):
            if has_letter(text):
                df += counts(text, width) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()]), pa.array([n, *df[at].tolist()])], names=["bucket", "n"])
    df = use.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in df}
    idf = np.full(width, np.log1p(seen.get(-1, 0)) + 1, np.float32)
    for b, n in seen.items():
        if b >= 0:
            idf[b] = np.log((1 + seen[-1]) / (1 + n)) + 1

    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    pick = (use.select("doc_id", "lang").where(F.col("doc_id").isNotNull()).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= sample).select("doc_id").distinct())

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf["text"] if has_letter(t)][:sample]
        if not texts:
            return pd.DataFrame({"lang": [], "centre": [], "limit": []})
        x = vectors(texts, idf)
        c = centroids(x, clusters)
        cos = x @ c.T
        near, top = cos.argmax(1), cos.max(1)
        limit = [float(1.25 * (1 - top[near == j]).max()) if (near == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centre": [v.astype("<f4").tobytes() for v in c], "limit": limit})
    found = (use.join(F.broadcast(pick), "doc_id", "left_semi").groupBy("lang")
             .applyInPandas(cluster, "lang string, centre binary, limit double")
             .limit(MOST_LANGUAGES * clusters + 1).collect())
    if len(found) > MOST_LANGUAGES * clusters:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    names = sorted({r["lang"] for r in found})
    return Model(idf, names, np.array([np.frombuffer(r["centre"], "<f4") for r in found], np.float32).reshape(-1, width),
                 np.array([names.index(r["lang"]) for r in found], int), np.array([r["limit"] for r in found]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs`` (doc_id, text,
    held_out).

    ``lang_pred`` is the language of the nearest centroid also where ``rejected`` says that it is
    too far; ``und`` with score 0 where the text is null or has no letter.  The whole text counts,
    however long.  Equally near centroids: the language first in order.  Repeated rows are each
    judged; ids may be null; an empty table gives an empty result; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows(batches), lambda r: len(r[1]) + 40_000, 1 << 24):
            ids, texts, held = zip(*group, strict=True)
            lang, score, far = sent.value.predict(list(texts))
            ok = [has_letter(t) for t in texts]
            yield batch(OUT, ids, held, [x if o else UNDETERMINED for x, o in zip(lang, ok, strict=True)],
                        [x if o else 0.0 for x, o in zip(score, ok, strict=True)], [f or not o for f, o in zip(far, ok, strict=True)])
    return docs.select(F.col("doc_id").cast("long"), raw_text().alias("text"), "held_out").mapInArrow(work, OUT_SQL)
