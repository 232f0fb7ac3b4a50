"""Hierarchical language ID: the family first, then one-versus-one linear SVMs within it.

Features are byte trigrams of the lower-cased text (ASCII characters that are no letters count as a
space), hashed to ``DIM`` relative frequencies. The SVMs (MLlib ``LinearSVC``) are fitted on a
bounded sample of labelled rows: about ``PER_LANG`` documents a language, picked by a hash of the id,
each once whole and once as a short piece. Prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import row_slices, store, text_or_empty, utf8_buffers

PER_LANG = 800
DIM = 2048
SHORT = 60  # bytes of the short training piece
_LIMIT = 1 << 20

#: Closely related languages; a code that is not here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = ord(" ")
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """The bin of the byte trigram at each position but the last two."""
    b = _FOLD[raw].astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)).astype(np.int32)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, rows = [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = np.frombuffer(text.encode(), np.uint8)
            at = len(raw) // 2
            for piece in (raw, raw[at : at + SHORT]):
                if len(piece) > 2:
                    rows.append(np.bincount(_trigrams(piece), minlength=DIM) * (100.0 / (len(piece) - 2)))
                    langs.append(lang)
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * DIM), flat)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), lists], names=["lang", "x"])


def _svm(rows: DataFrame, label: str, negative: str, positive: str) -> tuple[np.ndarray, float]:
    data = rows.filter(F.col(label).isin(negative, positive)).select((F.col(label) == positive).cast("double").alias("label"), "features")
    model = LinearSVC(maxIter=40, regParam=1e-3, aggregationDepth=2, standardization=False).fit(data)
    return model.coefficients.toArray(), model.intercept


def learned_langs(labelled: DataFrame) -> list[tuple[str, int]]:
    return [(r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]


def fit_language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> dict:
    """A model: families, their languages, and a weight vector and intercept for each pair of either.

    Rows with a null label or a text without a letter teach nothing; with no row left there is no language to learn.
    """
    labelled = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), text_or_empty(docs, text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = learned_langs(labelled)
    langs = [lang for lang, _ in counts]
    family = {lang: FAMILIES.get(lang, lang) for lang in langs}
    model = {"families": sorted(set(family.values())), "langs": {f: [x for x in langs if family[x] == f] for f in family.values()}, "pairs": {}}
    if len(langs) < 2:
        return model
    steps = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(steps, -(-steps * per_lang // n)))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(steps)) < share[F.col("lang")]).select("lang", "text")
    rows = store(sample.mapInArrow(_feature_batches, "lang string, x array<double>"), "lang-sample")
    rows = rows.withColumn("features", array_to_vector("x")).withColumn("family", F.create_map(*[F.lit(x) for kv in family.items() for x in kv])[F.col("lang")]).drop("x").cache()
    try:
        for a, b in combinations(model["families"], 2):
            model["pairs"]["family", a, b] = _svm(rows, "family", a, b)
        for f, members in model["langs"].items():
            for a, b in combinations(members, 2):
                model["pairs"][f, a, b] = _svm(rows, "lang", a, b)
    finally:
        rows.unpersist()
    return model


def _means(offs: np.ndarray, raw: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Row by row, the mean weight of the text's trigrams under each of the models."""
    out = np.zeros((len(offs) - 1, weights.shape[0]))
    lens = np.diff(offs)
    for lo, hi in row_slices(lens, _LIMIT):
        if hi == lo + 1:  # a long text in pieces that overlap by two bytes
            n = int(lens[lo])
            for at in range(int(offs[lo]), int(offs[lo]) + n - 2, _LIMIT):
                bins = _trigrams(raw[at : min(at + _LIMIT + 2, int(offs[hi]))])
                out[lo] += weights @ np.bincount(bins, minlength=DIM)
            out[lo] *= 100.0 / max(1, n - 2)
            continue
        part = raw[offs[lo] : offs[hi]]
        if len(part) < 3:
            continue
        bins = np.full(len(part), DIM, np.int32)  # the bin of no weight
        bins[:-2] = _trigrams(part)
        starts, rows = offs[lo:hi] - offs[lo], np.flatnonzero(lens[lo:hi] > 2)
        ends = starts + lens[lo:hi]
        for back in (1, 2):
            bins[ends[rows] - back] = DIM
        bins_end = np.flatnonzero((lens[lo:hi] > 0) & (lens[lo:hi] <= 2))
        for r in bins_end:
            bins[starts[r] : ends[r]] = DIM
        for m in range(weights.shape[0]):
            w = np.append(weights[m], 0.0)[bins]
            out[lo + rows, m] = np.add.reduceat(w, starts[rows]) * 100.0 / (lens[lo:hi][rows] - 2) if len(rows) else 0
    return out


def _vote(members: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one votes (ties by summed margins): the winner's position and its weakest probability."""
    votes, chance = np.zeros((n, len(members))), np.ones((n, len(members)))
    for (a, b), m in margins.items():
        i, j, p = members.index(a), members.index(b), 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        votes[:, i] += (m < 0) + 1e-6 * np.tanh(-m)
        votes[:, j] += (m >= 0) + 1e-6 * np.tanh(m)
        chance[:, i], chance[:, j] = np.minimum(chance[:, i], 1 - p), np.minimum(chance[:, j], p)
    best = votes.argmax(axis=1)
    return best, chance[np.arange(n), best]


def _predict(texts: pa.Array, letters: pa.Array, model: dict) -> pa.Array:
    keys = list(model["pairs"])
    weights = np.array([model["pairs"][k][0] for k in keys]).reshape(len(keys), DIM)
    bias = np.array([model["pairs"][k][1] for k in keys])
    n, has = len(texts), letters.to_numpy(zero_copy_only=False).astype(bool)
    margins = _means(*utf8_buffers(texts), weights) + bias
    at = {k: margins[:, i] for i, k in enumerate(keys)}
    pred, score = np.full(n, "und", object), np.zeros(n)
    if model["families"]:
        fam, p_fam = _vote(model["families"], {k[1:]: v for k, v in at.items() if k[0] == "family"}, n)
        for i, f in enumerate(model["families"]):
            lang, p = _vote(model["langs"][f], {k[1:]: v for k, v in at.items() if k[0] == f}, n)
            mine = (fam == i) & has
            pred[mine] = np.array(model["langs"][f], object)[lang[mine]]
            score[mine] = (p_fam * p)[mine]
    return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], names=["lang_pred", "score"])


def language_of(text: Column, model: dict) -> Column:
    """(lang_pred, score) of a text column.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.
    """
    filled = F.coalesce(text.cast("string"), F.lit(""))

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array, letters: pa.Array) -> pa.Array:
        return _predict(texts, letters, model)

    return predict(filled, filled.rlike(r"\p{L}"))


def predict_language(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred (a learned language, or ``und``), score from 0 to 1.

    Of languages with equal votes the one with the larger summed margins wins. Very long texts are read in pieces; repeated rows stay repeated; null ids stay null; other columns are
    ignored; an empty table gives an empty result.
    """
    return docs.select(docs[id_col].alias("doc_id"), language_of(docs[text_col], model).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def drop_unidentified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that have a language: those predicted ``und`` go."""
    return docs.withColumn("__language", language_of(docs[text_col], model)).filter("__language.lang_pred <> 'und'").drop("__language")


def held_out(id_col="doc_id", folds: int = 5):
    """Rows that no model learns from: crc32 of the id as text, modulo ``folds``, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
