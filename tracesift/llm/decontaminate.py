"""Benchmark decontamination by latent semantic retrieval.

1. Passages: windows of ``2 * STRIDE`` words, ``STRIDE`` apart, over whole documents. Benchmark items
   are cut in parts of at most ``STRIDE`` words, so a part lies whole in some passage.
2. TF-IDF over the benchmark's words: passage frequencies are counted over all documents. Each text is taken
   apart once; its words are kept as term ids, copies of a text once with their number.
3. A randomised SVD gives the latent space. The matrix (the parts, each weighing as much as all
   passages, and the passages of all distinct documents, as counts of benchmark words) stays in a table A;
   a Spark job sums A'A in blocks of terms, and the products with that table are Spark jobs, too. The rank is the
   number of parts and ``CORPUS_RANK`` more, so the space holds the parts' own directions and the leading ones of the corpus.
   Every passage of every document is then projected and searched.
4. Passages with a cosine of ``MIN_COSINE`` or more to a part are its candidates. They are compared word by
   word: longest common subsequence, and the part's answer (its last ``ANSWER`` words). A rewording that
   keeps ``LOOSE`` of the part's words in order counts if the answer is whole.
5. Parts that can be matched by words in more than ``COMMON`` of the passages alone have no direction of
   their own: a passage with the words of ``Queries.needed`` positions is a candidate of such a part, too.

The benchmark is a query set: its distinct parts are taken in blocks of about ``BLOCK_PARTS`` with at most
``MAX_TERMS`` different words, so what a task (terms x terms numbers) or the driver (terms x rank) holds does not grow with the benchmark's rows, the
length of its items, their copies or the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import row_slices, store, text_or_empty, utf8_buffers

STRIDE, CORPUS_RANK, EXTRA = 64, 32, 16
BLOCK_PARTS, MAX_TERMS = 512, 4096
FIT_ROWS, FIT_TASKS = 1 << 18, 32  # a task of the fit sends half of terms x terms numbers, so it has many rows
MIN_COSINE = 0.45
VERBATIM, PARAPHRASE, LOOSE, ANSWER, ANSWER_SHARE, SHORT = 0.8, 0.6, 0.4, 5, 0.8, 8
COMMON, LEAST = 0.05, 0.05  # terms in more than this share of the passages have the least weight
_LIMIT, _BLOCK_TERMS, _GRAM_TERMS, _BLOCK_ROWS = 1 << 20, 512, 64, 128
_ID = np.dtype("<i2")  # MAX_TERMS fits

_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII characters that are no letters or digits stand between words."""
    return text.lower().encode().translate(_FOLD).split()


def _parts(words: list[bytes]) -> list[list[bytes]]:
    n = max(1, -(-len(words) // STRIDE))
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def words_needed(n: int) -> int:
    """How many words of a part of ``n`` any passage has that :func:`matches` it without being near."""
    return n if n < SHORT else next(k for k in range(n + 1) if k / n >= PARAPHRASE)


class Queries:
    """A block of benchmark parts (words between spaces) as term ids, and their masks for the word comparison."""

    def __init__(self, texts: list[bytes]):
        cut = [text.split() for text in texts]
        self.keys = [hashlib.sha256(text).digest() for text in texts]
        self.terms = {w: k for k, w in enumerate(sorted({w for part in cut for w in part}))}
        self.parts = [[self.terms[w] for w in part] for part in cut]
        self.masks = [self._masks(p) for p in self.parts]
        self.answers = [self._masks(p[-ANSWER:]) for p in self.parts]
        self.needed = np.array([words_needed(len(p)) for p in self.parts], np.int64)
        held = np.array([(t, k) for k, p in enumerate(self.parts) for t in p], np.int64).reshape(-1, 2)
        held, self.times = np.unique(held, axis=0, return_counts=True)  # by term: the parts that have it, and how often
        self.holder, self.starts = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.terms) + 1))

    def unweighted(self, common: np.ndarray) -> np.ndarray:
        """Whether the words in ``common`` alone can make up a match of a part, for each part."""
        often = np.isin(np.arange(len(self.terms)), common)
        return np.array([often[p].sum() for p in self.parts], np.int64) >= self.needed

    @staticmethod
    def _masks(part: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, t in enumerate(part):
            out[t] = out.get(t, 0) | 1 << k
        return out

    def text_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term ids of the words (:func:`words_of`) of all texts in a row (-1: no benchmark word), and the words of each text."""
        folded = [t.lower().encode() + b" " for t in texts]
        raw = np.frombuffer(b"".join(folded).translate(_FOLD), np.uint8)
        letter = raw != 32
        begins, ends = np.flatnonzero(letter & np.r_[True, ~letter[:-1]]), np.flatnonzero(~letter & np.r_[False, letter[:-1]])
        letter[ends] = True  # one space stays behind each word
        offsets = np.r_[0, np.cumsum(ends - begins + 1)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])])
        known = pa.array([w + b" " for w in self.terms], pa.binary())  # in the order of their ids
        ids = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(_ID)
        upto = np.searchsorted(ends, np.cumsum(list(map(len, folded))))
        return ids, np.diff(upto, prepend=0)


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and a sequence of ``n`` given by its masks."""
    row = full = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            x = row & m
            row = ((row + x) | (row - x)) & full
    return n - row.bit_count()


def matches(q: Queries, part: int, words: list[int], near: bool = True) -> float:
    """The share of the part that the passage, near to it in the latent space or not, has in order, or 0 where the checks fail."""
    ids = q.parts[part]
    n = len(ids)
    if n < SHORT:  # few words say little unless they stand together
        return float(any(words[i : i + n] == ids for i in range(len(words) - n + 1)))
    share = common_length(q.masks[part], n, words) / n
    if share >= VERBATIM:
        return share
    if share < (LOOSE if near else PARAPHRASE):
        return 0.0
    k = min(ANSWER, n)
    return share if common_length(q.answers[part], k, words) >= (ANSWER_SHARE if share >= PARAPHRASE else 1) * k else 0.0


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, part_key, part): the words of each part between single spaces."""
    for b in batches:
        cut = [(i, b" ".join(p)) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in _parts(words_of(text)) if p]
        cols = [pa.array([i for i, _ in cut], pa.int64()), pa.array([hashlib.sha256(p).digest() for _, p in cut], pa.binary()), pa.array([p for _, p in cut], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "part_key", "part"])


# ---- passages -------------------------------------------------------------------------------------
def _word_batches(batches: Iterator[pa.RecordBatch], queries) -> Iterator[pa.RecordBatch]:
    """Each text as its words' term ids in order."""
    q: Queries = queries.value
    for b in batches:
        offs, _ = utf8_buffers(b.column(1))
        for lo, hi in row_slices(np.diff(offs), _LIMIT):
            part = b.slice(lo, hi - lo)
            ids, sizes = q.text_ids(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), _packed(ids, sizes)], names=["text_key", "ids"])


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of ``sizes`` values as bytes."""
    offsets = np.r_[0, np.cumsum(sizes * values.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending (``np.unique`` hashes, which takes longer than this sort)."""
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) > 0]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: their rows, the term ids of all their words (-1: no benchmark word), the first word and the text of each chunk."""
    for b in batches:
        offs, raw = utf8_buffers(b.column(column))
        for lo, hi in row_slices(np.diff(offs), _LIMIT // 2):
            sizes = np.diff(offs[lo : hi + 1]) // _ID.itemsize
            n = -(-sizes // STRIDE)
            text = np.repeat(np.arange(hi - lo), n)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            ids = raw[offs[lo] : offs[hi]].view(_ID).astype(np.int64)
            yield b.slice(lo, hi - lo), ids, np.repeat(np.cumsum(sizes) - sizes, n) + nth * STRIDE, text


def _frequency_batches(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(terms + 1, np.int64)
    for rows, ids, first, text in _texts(batches, 0):
        if not len(first):
            continue
        copies = rows.column(1).to_numpy()[text]
        use = np.flatnonzero(ids >= 0)
        chunk, term = np.divmod(_distinct((np.searchsorted(first, use, "right") - 1) * terms + ids[use]), terms)  # by chunk: each is counted for the passage it opens
        seen[:-1] += np.bincount(term, copies[chunk], terms).astype(np.int64)
        seen[-1] += copies.sum()
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "n"])


def _row_batches(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """Passages as sparse rows: the benchmark's words in each, ascending, and how often it has them; those without one are left out."""
    for _, ids, first, text in _texts(batches, 0):
        if not len(first):
            continue
        use = np.flatnonzero(ids >= 0)
        joined = np.r_[text[1:] == text[:-1], False]
        own = (np.searchsorted(first, use, "right") - 1) * terms + ids[use]
        before = own - terms
        pairs, times = np.unique(np.r_[own, before[(before >= 0) & joined[before // terms]]], return_counts=True)
        passage, term = np.divmod(pairs, terms)
        sizes = np.bincount(passage)
        sizes = sizes[sizes > 0]
        yield pa.RecordBatch.from_arrays([_packed(term.astype(_ID), sizes), _packed(times.astype(_ID), sizes)], names=["terms", "times"])


# ---- randomised SVD -------------------------------------------------------------------------------
def _gram_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's share of A'A, its upper half in blocks of rows; ``length`` is that of A's rows."""
    terms = len(idf)
    total = np.zeros(terms * terms)
    for whole in batches:
        for lo in range(0, whole.num_rows, _BLOCK_ROWS):
            b = whole.slice(lo, _BLOCK_ROWS)
            offs, raw = utf8_buffers(b.column(0))
            sizes = np.diff(offs) // _ID.itemsize
            ends = np.cumsum(sizes)
            t = raw.view(_ID).astype(np.int64)
            w = utf8_buffers(b.column(1))[1].view(_ID) * idf[t]
            w *= np.repeat(b.column(2).to_numpy() / np.sqrt(np.add.reduceat(w * w, ends - sizes)), sizes)
            after = np.repeat(ends, sizes) - np.arange(len(t))  # a word and those that follow it in its passage
            other = np.arange(after.sum()) + np.repeat(np.arange(len(t)) - np.cumsum(after) + after, after)
            np.add.at(total, np.repeat(t * terms, after) + t[other], np.repeat(w, after) * w[other])
    total = total.reshape(terms, terms)
    for k, lo in enumerate(range(0, terms, _GRAM_TERMS)):
        share = total[lo : lo + _GRAM_TERMS, lo:]
        if share.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([share.tobytes()], pa.binary())], names=["block", "data"])


def _product_batches(batches: Iterator[pa.RecordBatch], right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's share of A'A right, from blocks of rows of the upper half of A'A."""
    total = np.zeros(right.shape)
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1)):
            lo = block * _GRAM_TERMS
            hi = min(lo + _GRAM_TERMS, len(right))
            upper = np.frombuffer(data.as_buffer()).reshape(hi - lo, -1)
            total[lo:hi] += upper @ right[lo:]
            total[lo:] += upper.T @ right[lo:hi]
            total[lo:hi] -= np.diagonal(upper)[:, None] * right[lo:hi]
    at = range(0, len(total), _BLOCK_TERMS)
    yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK_TERMS for i in at], pa.int32()), pa.array([total[i : i + _BLOCK_TERMS].tobytes() for i in at], pa.binary())], names=["block", "data"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x) for x in rows["data"])
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [total.tobytes()]})


def _sums(shares: DataFrame) -> DataFrame:
    return shares.groupBy("block").applyInPandas(_summed, "block int, data binary")


def _product(gram: DataFrame, right: np.ndarray) -> np.ndarray:
    shares = gram.coalesce(FIT_TASKS).mapInArrow(partial(_product_batches, right=right), "block int, data binary")
    blocks = _sums(shares).orderBy("block").collect()  # terms x rank numbers
    return np.concatenate([np.frombuffer(r["data"]) for r in blocks]).reshape(right.shape)


def latent_basis(matrix: DataFrame, idf: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms x rank) of the stored sparse rows, by a randomised range finder with one power step.

    A passage has far fewer words than the space has directions, so the rows are read once, for A'A; the products are with that table.
    """
    width = min(len(idf), rank + EXTRA)
    gram = store(_sums(matrix.mapInArrow(partial(_gram_batches, idf=idf), "block int, data binary")), "gram")
    basis = np.random.default_rng(seed).standard_normal((len(idf), width))
    for _ in range(2):
        basis, _ = np.linalg.qr(_product(gram, basis))
    _, turn = np.linalg.eigh(basis.T @ _product(gram, basis))
    return basis @ turn[:, ::-1][:, :rank]


# ---- search ---------------------------------------------------------------------------------------
def _held(q: Queries, ids: np.ndarray, chunk: np.ndarray, joined: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Passages x ``parts``: how many positions of the part have a word that the passage has (``ids`` lie in ``chunk``)."""
    n, terms = len(joined), len(q.terms)
    column = np.full(len(q.parts), -1)
    column[parts] = np.arange(len(parts))
    wanted = np.zeros(terms, bool)
    for p in parts.tolist():
        wanted[q.parts[p]] = True
    some = wanted[ids]
    pairs = _distinct(chunk[some] * terms + ids[some])
    before = pairs - terms
    passage, term = np.divmod(_distinct(np.r_[pairs, before[(before >= 0) & joined[before // terms]]]), terms)
    sizes = q.starts[term + 1] - q.starts[term]
    at = np.arange(sizes.sum()) + np.repeat(q.starts[term] - np.cumsum(sizes) + sizes, sizes)
    passage, there, times = np.repeat(passage, sizes), column[q.holder[at]], q.times[at]
    asked = there >= 0
    return np.bincount(passage[asked] * len(parts) + there[asked], times[asked], n * len(parts)).reshape(n, len(parts))


def _search_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    q, weighted, latent, common = model.value  # terms x rank, idf included; parts x rank, unit length; terms
    slot = np.full(len(weighted), -1)
    slot[common] = np.arange(len(common))  # fewer than STRIDE / COMMON, so a matrix product sums them
    unweighted = np.flatnonzero(q.unweighted(common))
    for rows, ids, first, text in _texts(batches, 1):
        found: dict[tuple[int, bytes], tuple[float, float]] = {}
        if len(first):
            use = np.flatnonzero(ids >= 0)
            used, chunk = ids[use], np.searchsorted(first, use, "right") - 1
            often = slot[used] >= 0
            times = np.bincount(chunk[often] * len(common) + slot[used[often]], minlength=len(first) * len(common)).reshape(len(first), len(common))
            sums = np.zeros((len(first) + 1, weighted.shape[1]), np.float32)
            if not often.all():
                rare, there = used[~often], chunk[~often]
                starts = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
                for lo in range(0, len(starts), _BLOCK_ROWS):  # a few passages at a time: words x rank numbers
                    at = starts[lo : lo + _BLOCK_ROWS]
                    stop = starts[lo + _BLOCK_ROWS] if lo + _BLOCK_ROWS < len(starts) else len(rare)
                    sums[there[at]] = np.add.reduceat(weighted[rare[at[0] : stop]], at - at[0], axis=0)
            sums[:-1] += times.astype(np.float32) @ weighted[common]
            joined = np.r_[text[1:] == text[:-1], False]
            passage = sums[:-1] + np.where(joined[:, None], sums[1:], 0)
            size = np.sqrt((passage * passage).sum(axis=1))
            ends = np.r_[first[1:], len(ids)]
            ends = np.where(joined, np.r_[ends[1:], 0], ends)
            near = passage @ latent.T
            size = np.maximum(size, 1e-9)
            close = near >= MIN_COSINE * size[:, None]
            candidates = close.copy()
            if len(unweighted):
                candidates[:, unweighted] |= _held(q, used, chunk, joined, unweighted) >= q.needed[unweighted]
            for k, part in np.argwhere(candidates).tolist():
                share = matches(q, part, ids[first[k] : ends[k]].tolist(), close[k, part])
                key = (int(text[k]), q.keys[part])
                if share > found.get(key, (0.0, 0.0))[0]:
                    found[key] = (share, float(near[k, part] / size[k]))
        keys = rows.column(0).take(pa.array([k for k, _ in found], pa.int64()))
        cols = [keys, pa.array([i for _, i in found], pa.binary()), pa.array([x for x, _ in found.values()], pa.float64()), pa.array([x for _, x in found.values()], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=["text_key", "part_key", "lcs", "cosine"])


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _block_hits(texts: DataFrame, queries: Queries) -> DataFrame:
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(queries)
    terms = len(queries.terms)
    read = texts.mapInArrow(partial(_word_batches, queries=sent), "text_key binary, ids binary")
    words = store(read.groupBy("text_key").agg(F.first("ids").alias("ids"), F.count("*").alias("copies")), "words")  # copies come in once
    counted = words.select("ids", "copies").mapInArrow(partial(_frequency_batches, terms=terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(terms + 1)
    for r in counted:  # at most one row a benchmark word
        seen[r["term"]] = r["n"]
    share = seen[:-1] / max(1.0, seen[-1])
    idf = np.where(share > COMMON, 0.0, np.log((1 + seen[-1]) / (1 + seen[:-1]))) + LEAST

    own = spark.createDataFrame([(np.array(p, _ID).tobytes(),) for p in queries.parts], "ids binary")
    rows = lambda df: df.mapInArrow(partial(_row_batches, terms=terms), "terms binary, times binary")
    passages = store(rows(words.select("ids")), "passages")
    count = passages.count()
    weight = max(1.0, float(count)) ** 0.5
    parts = store(rows(own), "parts").withColumn("length", F.lit(weight))
    matrix = passages.withColumn("length", F.lit(1.0)).unionByName(parts).coalesce(min(FIT_TASKS, -(-count // FIT_ROWS) + 1))
    basis = latent_basis(matrix, idf, min(len(queries.parts) + CORPUS_RANK, terms))
    weighted = (basis * idf[:, None]).astype(np.float32)
    latent = np.array([weighted[p].sum(axis=0) for p in queries.parts])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    model = spark.sparkContext.broadcast((queries, weighted, latent.astype(np.float32), np.flatnonzero(share > COMMON)))
    return store(words.select("text_key", "ids").mapInArrow(partial(_search_batches, model=model), "text_key binary, part_key binary, lcs double, cosine double"), "hits")


def _by_terms(parts: list[bytes]) -> Iterator[list[bytes]]:
    """The parts in groups of at most ``MAX_TERMS`` different words."""
    group: list[bytes] = []
    terms: set[bytes] = set()
    for part in parts:
        words = set(part.split())
        if group and len(terms | words) > MAX_TERMS:
            yield group
            group, terms = [], set()
        group.append(part)
        terms |= words
    if group:
        yield group


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_parts: int = BLOCK_PARTS) -> DataFrame:
    """(text_key, item_id, lcs, cosine) for each text that holds a benchmark item."""
    texts = docs.select(_digest(text_or_empty(docs, text_col)).alias("text_key"), text_or_empty(docs, text_col).alias("text")).filter("text <> ''")
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("text IS NOT NULL")
    cut = store(items.distinct().mapInArrow(_part_batches, "item_id long, part_key binary, part binary"), "items")
    parts = cut.select("part").distinct()
    blocks = max(1, -(-parts.count() // block_parts))
    hits = texts.sparkSession.createDataFrame([], "text_key binary, part_key binary, lcs double, cosine double")
    for k in range(blocks):
        block = parts.filter(F.pmod(F.xxhash64("part"), F.lit(blocks)) == k)
        for group in _by_terms(sorted(bytes(r["part"]) for r in block.collect())):  # a block of the query set
            hits = hits.unionByName(_block_hits(texts, Queries(group)))
    best = hits.groupBy("text_key", "part_key").agg(F.max(F.struct("lcs", "cosine")).alias("best"))  # repeated texts and passages: once
    held = cut.select("item_id", "part_key").distinct()
    return best.join(held, "part_key").select("text_key", "item_id", "best.lcs", "best.cosine")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_ids (sorted), lcs and cosine of the best match (null: none).

    Null and empty texts and texts without words are clean; null, empty or wordless items match nothing,
    items under ``SHORT`` words match only where they stand together; repeated rows get the same result;
    null ids stay null; very long texts are searched whole; other columns of either table are ignored; an empty table of either kind works.
    """
    hits = contaminated_texts(docs, benchmark, text_col, **options)
    best = hits.groupBy("text_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.struct("lcs", "cosine")).alias("best"))
    keyed = docs.select(docs[id_col].alias("doc_id"), _digest(text_or_empty(docs, text_col)).alias("text_key"))
    return keyed.join(best, "text_key", "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "best.lcs", "best.cosine"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no benchmark item."""
    gone = contaminated_texts(docs, benchmark, text_col, **options).select(F.col("text_key").alias("__gone")).distinct()
    return docs.join(gone, _digest(text_or_empty(docs, text_col)) == F.col("__gone"), "left_anti")
