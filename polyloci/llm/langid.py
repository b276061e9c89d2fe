"""Operator 4, language ID: nearest of several clustered TF-IDF centroids per language, by cosine, with rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passed_through, slices

UNDETERMINED = "und"
#: Hashed n-grams of 1 to MAX_N letters; an n-gram may hold the space between two words.
DIMS, MAX_N = 4096, 3
#: Documents that centroids are clustered on, over all languages. Document frequencies count every training row.
SAMPLE = 1600
CLUSTERS = 4
ROUNDS = 12
#: A text is rejected below this share of the similarity that all but one in a hundred sample documents of about its own
#: number of distinct n-grams (a power of two apart) reach; where under LEAST_SAMPLE such documents, below FAR_SHARE of
#: what all but one in a hundred of all sample documents reach.
REJECT_SHARE, FAR_SHARE, LEAST_SAMPLE = 0.75, 0.2, 20
SIZES = DIMS.bit_length()
#: Texts vectorised at once.
CHUNK_DOCS, CHUNK_CHARS = 256, 1 << 19

_LETTERS: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For code points below 2**16: the lower-case letter, or 32 for what is no letter."""
    if not _LETTERS:
        out = np.full(1 << 16, 32, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()) if len(c.lower()) == 1 else i
        _LETTERS.append(out)
    return _LETTERS[0]


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    codes = np.where(codes < 1 << 16, _lower_letters()[np.minimum(codes, (1 << 16) - 1)], codes)
    for far in np.unique(codes[codes >= 1 << 16]).tolist():
        c = chr(far)
        codes[codes == far] = (ord(c.lower()) if len(c.lower()) == 1 else far) if c.isalpha() else 32
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def _hashed(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1, 2, .. the cell of the n-gram that starts at each place."""
    h = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, MAX_N + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            yield ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(52)).astype(np.int64)


def gram_counts(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Rows of n-gram counts of the texts, some rows at a time; a text without letters has zeros only."""
    group: list[np.ndarray] = []
    size = 0

    def counts() -> np.ndarray:
        out = np.zeros(len(group) * DIMS, np.float32)
        codes = np.concatenate(group)
        doc = np.repeat(np.arange(len(group)), [len(g) for g in group])
        for n, h in enumerate(_hashed(codes), 1):
            ok = doc[: len(h)] == doc[n - 1 :]
            if n == 1:
                ok &= codes != 32
            out += np.bincount(doc[: len(h)][ok] * DIMS + h[ok], minlength=len(out))
        return out.reshape(-1, DIMS)

    for t in texts:
        codes = _letters(t) if t else np.zeros(0, np.uint32)
        if not (codes != 32).any():
            codes = np.zeros(0, np.uint32)
        else:
            codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
        group.append(codes)
        size += len(codes)
        if len(group) >= CHUNK_DOCS or size >= CHUNK_CHARS:
            yield counts()
            group, size = [], 0
    if group:
        yield counts()


@dataclass
class Model:
    """idf, the centroids' unit vectors, their languages, and the least similarity by the bits of a text's number of distinct
    n-grams."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return tf_idf(counts, self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine to the nearest centroid from 0 to 1, and whether it is too far from all centroids."""
        lang, score, rejected = [], [], []
        for counts in gram_counts(texts):
            grams = (counts > 0).sum(1)
            empty = grams == 0
            if not self.langs:
                best, who = np.zeros(len(counts)), np.zeros(len(counts), int)
                empty[:] = True
            else:
                cos = self.vectors(counts) @ self.centroids.T
                at = cos.argmax(1)
                best, who = np.clip(cos[np.arange(len(at)), at], 0, 1), self.owner[at]
            for e, b, w, least in zip(empty, best, who, self.least[size_class(grams)], strict=True):
                lang.append(UNDETERMINED if e else self.langs[w])
                score.append(0.0 if e else float(b))
                rejected.append(bool(e or b < least))
        return lang, score, rejected


def size_class(grams: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(grams + 1)).astype(int)


def least_similarity(cos: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The similarity below which texts are rejected, by size class, from those of sample documents."""
    own = size_class(grams)
    out = np.full(SIZES + 1, FAR_SHARE * float(np.quantile(cos, 0.01)) if len(cos) else 0.0)
    for k in range(SIZES + 1):
        if (own == k).sum() >= LEAST_SAMPLE:
            out[k] = max(out[k], REJECT_SHARE * float(np.quantile(cos[own == k], 0.01)))
    return out


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of a spherical k-means; starts from the first row and then the row farthest from all so far."""
    k = min(k, len(x))
    centres = [x[0]]
    near = x @ x[0]
    for _ in range(1, k):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        new = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the languages of train's labelled rows.

    Document frequencies and label counts are taken over all rows. Centroids are clustered on about `sample` rows in
    all, an equal number from each language, picked by a hash of id and text length: that bound, times DIMS numbers,
    is what reaches the driver. Rows without label or text teach nothing; without any others the model has no languages.
    """
    rows = train.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}

    def frequencies(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for batch in slices(batches):
            for counts in gram_counts(batch.column(0).to_pylist()):
                df[:DIMS] += (counts > 0).sum(0)
                df[DIMS] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], ["cell", "n"])

    total = np.zeros(DIMS + 1)
    for cell, n in rows.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        total[cell] = n
    idf = (np.log((1 + total[DIMS]) / (1 + total[:DIMS])) + 1).astype(np.float32)
    each = max(8, sample // max(1, len(labels)))
    share = F.create_map(*[x for k, c in labels.items() for x in (F.lit(k), F.lit(max(1, int(min(1.0, each / c) * (1 << 40)))))]) if labels else None
    grams: dict[str, list[np.ndarray]] = {}
    if labels:
        picked = rows.filter(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 40)) < share[F.col("lang")])

        def vectors(batches):
            for batch in slices(batches):
                langs, at = batch.column(0).to_pylist(), 0
                for counts in gram_counts(batch.column(1).to_pylist()):
                    keep = np.flatnonzero(counts.sum(1))
                    cells = [np.flatnonzero(counts[i]) for i in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[at + i] for i in keep], pa.string()), pa.array(cells, pa.list_(pa.int64())), pa.array([counts[i][c] for i, c in zip(keep, cells, strict=True)], pa.list_(pa.float32()))], ["lang", "cells", "counts"])
                    at += len(counts)

        for lang, cells, counts in picked.select("lang", "text").mapInArrow(vectors, "lang string, cells array<long>, counts array<float>").collect():
            x = np.zeros(DIMS, np.float32)
            x[cells] = counts
            grams.setdefault(lang, []).append(x)
    langs, centroids, owner, cos, sizes = sorted(grams), [], [], [], []
    for w, lang in enumerate(langs):
        x = np.stack(grams[lang])
        x = tf_idf(x[np.lexsort(x.T[:64])], idf)  # an order that doesn't depend on the order of arrival
        c = cluster(x, CLUSTERS)
        centroids.append(c)
        owner += [w] * len(c)
        cos.append((x @ c.T).max(1))
        sizes.append((x > 0).sum(1))
    least = least_similarity(np.concatenate([*cos, np.zeros(0)]), np.concatenate([*sizes, np.zeros(0, int)]))
    return Model(idf, np.concatenate(centroids) if langs else np.zeros((0, DIMS), np.float32), np.array(owner, int), langs, least)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text and is held out."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score and rejected for every row, in one pass and without a shuffle.

    lang_pred is `und`, score 0 and rejected true where the text is null or has no letter; every other text gets the
    language of its nearest centroid, and rejected tells whether even that one is too far. Only the text is looked at.
    Null and repeated ids are kept as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            lang, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, lang_pred string, score double, rejected boolean")


def keep_known_languages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            _, _, rejected = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return passed_through(docs, run)
