"""Importance resampling towards a target distribution, on hashed word n-grams.

1. An untrained Regex ``Split`` of the tokenizers library cuts the text (A-Z lower-cased) into words with
   offsets. A feature is the text between the start of one word and the end of the ``n``-th after it,
   with one space for whatever separates words; windows are pairs of offsets.
2. Each feature falls into the bucket ``crc32 mod buckets``. The corpus is tokenized once: every
   document's buckets are written as a compact table, from which the histogram of the corpus and, with the
   gains of the buckets, the documents' weights are read.
3. A bucket's gain is the scaled log ratio of its share in the target and in the corpus, both smoothed by
   one; a document's weight is the floored mean of its features' gains.
4. Gumbel noise from the document's id makes the highest scores a sample without replacement. Scores are
   numbered by a distributed sort of narrow rows.

Only histograms (``buckets`` numbers) go through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import dense_index
from .support import store, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_PIECE = 1 << 20
_CACHE = 1 << 18


def splitter():
    """The pre-tokenizer: words of lower-cased text, what separates them removed."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(text: str) -> str:
    """A-Z to a-z; no other letter changes."""
    return text.encode().lower().decode()


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about a megabyte, cut after a separator, so that no word is cut."""
    at = 0
    while len(text) - at > _PIECE:
        m = _SEPARATOR.search(text, at + _PIECE)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class _Buckets(dict):
    """Bucket of a word, looked up once while it is remembered."""

    def __init__(self, buckets: int) -> None:
        self.n = buckets

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        b = self[word] = zlib.crc32(word.encode()) % self.n
        return b


def window_features(words: list[str], n: int) -> Iterator[bytes]:
    """Every run of ``n`` consecutive words: the bytes between two offsets of the words joined by one space."""
    raw = [w.encode() for w in words]
    joined = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw], dtype=np.int64) - 1
    starts = np.r_[0, ends[:-1] + 1] if len(raw) else ends
    for s, e in zip(starts[: len(raw) - n + 1].tolist(), ends[n - 1 :].tolist()):
        yield joined[s:e]


class Featurizer:
    """Texts to (number of words, buckets of all features)."""

    def __init__(self, max_n: int, buckets: int) -> None:
        self.split, self.max_n, self.n = splitter().pre_tokenize_str, max_n, buckets
        self.cache = _Buckets(buckets)

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        n_words, found, carry = 0, [], []
        for piece in _pieces(lowered(text)):
            words = [w for w, _ in self.split(piece)]
            n_words += len(words)
            found.append(np.fromiter(map(self.cache.__getitem__, words), np.uint32, len(words)))
            for n in range(2, self.max_n + 1):  # windows may begin in the piece before
                run = carry[max(0, len(carry) - n + 1) :] + words
                found.append(np.array([zlib.crc32(f) % self.n for f in window_features(run, n)], np.uint32))
            carry = (carry + words)[-(self.max_n - 1) :] if self.max_n > 1 else []
        return n_words, np.concatenate(found)


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _feature_batches(batches: Iterator[pa.RecordBatch], max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    work, kind = Featurizer(max_n, buckets), _width(buckets)
    for b in batches:
        n_words, found = [], []
        for t in b.column(1):
            n, f = work(t.as_py())
            n_words.append(n)
            found.append(f.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "found"])


def features(docs: DataFrame, max_n: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, found): the bucket of every feature of a document, as little-endian integers."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    return narrow.mapInArrow(partial(_feature_batches, max_n=max_n, buckets=buckets), "doc_id long, n_words long, found binary")


def _count_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for b in batches:
        for f in b.column(0):
            total += np.bincount(np.frombuffer(f.as_buffer(), _width(buckets)), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; a task hands over its sums only."""
    counts = found.select("found").mapInArrow(partial(_count_batches, buckets=buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    k = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weight_batches(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = _width(len(gain))
    for b in batches:
        n = np.zeros(b.num_rows, np.int64)
        total = np.zeros(b.num_rows, np.int64)
        for i, f in enumerate(b.column(2)):
            at = np.frombuffer(f.as_buffer(), kind)
            n[i], total[i] = len(at), gain[at].sum()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed:id``); a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, ... among the drawn; null for the others), all long.

    Drawn are the highest scores among documents of at least ``min_words`` words, ``percent`` percent of
    them rounded down, ties to the smaller id (null ids last). Null and empty texts have no feature and weight
    0; very long texts are read in pieces; repeated rows are documents of their own, with equal scores and
    different ranks; an empty target gives gains from the corpus alone; an empty table gives an empty
    result; other columns are ignored.
    """
    found = store(features(docs, max_n, buckets, id_col, text_col), "word-buckets", "zstd")
    wanted = histogram(features(target.select(F.lit(None).cast("long").alias("doc_id"), target[target_col].alias("text")), max_n, buckets), buckets)
    gain = gains(histogram(found, buckets), wanted)
    weighed = found.mapInArrow(partial(_weight_batches, gain=gain), "doc_id long, n_words long, n_features long, weight long")
    scored = store(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    eligible = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    numbered, total = dense_index(scored.filter(eligible).withColumn("tie", F.monotonically_increasing_id()), order, "at")
    rank = F.when(F.col("at") < percent * total // 100, F.col("at") + 1)
    cols = ["doc_id", "n_features", "weight", "score"]
    return numbered.select(*cols, rank.alias("rank")).unionByName(scored.filter(~eligible).select(*cols, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, report: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (all columns) that ``resample`` drew; rows with a null id are not matched."""
    return docs.join(report.filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct(), F.col(id_col) == F.col("__drawn"), "left_semi")
