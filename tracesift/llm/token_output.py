"""Token-id output: canonical length-limited Huffman coding of ids, in blocks that decode alone.

1. Texts become ids where they are read; a worker tokenizes each distinct space-bounded chunk of a
   batch once. The ids are stored, so the tokenizer reads each text a single time.
2. Global counts of ids (at most one row per vocabulary entry) give the code lengths by
   package-merge; lengths alone, with the canonical order, are the header of the file.
3. The stored ids are range-partitioned by document id and coded in blocks of whole documents; each
   document starts on a byte, and the bit offset of every ``CHECK``-th id is kept.
4. Blocks decode alone: all stretches between checkpoints advance together, one table look-up an id.

A file is a folder with two Parquet tables: ``header`` (id, bits) and ``blocks`` (in ascending order of
documents by part and block number).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .support import row_slices, spelled, text_or_empty, text_sums, word_numbers

CHECK = 128
BLOCK_IDS, SLICE_IDS = 1 << 18, 1 << 15  # of a block at least; coded at a time, in a core's cache
COUNTS = -1
CACHE_WORDS, FIRST_WORDS, CACHED_LEN = 800_000, 50_000, 48
_LIMIT = 1 << 22
#: A space before white space or the end. The same set, as Arrow's regular expressions know ASCII white space only.
_ODD = re.compile(r" (?:\s|$)")
_ODD_ARROW = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
_CUT = re.compile(r" (?=\S)")


# ---- tokenizing -----------------------------------------------------------------------------------
class ChunkTokenizer:
    """Byte-level BPE ids of whole texts, chunk by chunk.

    The tokenizer's own splitting always starts a new piece at a space that a non-space follows, so
    chunks cut there have the same ids alone as in the text. A text with the literal of an added token
    is no such text: :meth:`encode_whole` gives it to the library uncut.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(file)
        literals = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.literal = "|".join(map(re.escape, literals))  # what a text with an added token holds, or empty
        self.tok = Tokenizer.from_file(file)
        self.tok.encode_special_tokens = True
        # the same vocabulary for texts that are cut already: a NUL stands before each piece
        self.cut = Tokenizer.from_file(file)
        self.cut.encode_special_tokens = True
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\0"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache_words = cache_words
        self.kept: dict[str, bytes] = {}  # of words after a space
        self.firsts: dict[str, bytes] = {}  # of words at the start of a text
        self.marks = {m: self._ids(m).astype("<u4").tobytes() for m in ".,"}
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(self.tok.get_vocab_size())])

    def _ids(self, text: str, cut: bool = False) -> np.ndarray:
        return np.array((self.cut if cut else self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _chunks(self, words: list[str]) -> list[bytes]:
        """The ids of `` word`` for each word, many in one call: ids that open with a space tell them apart."""
        if len(words) > 1:
            letters = all(map(str.isalpha, words))  # each is one piece with the space before it
            ids = self._ids("".join(("\0 " if letters else " ") + w for w in words), letters)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(words) and not any(" " in w for w in words):
                raw, cuts = ids.astype("<u4").tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                return [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return [self._ids(" " + w).astype("<u4").tobytes() for w in words]

    def _codes(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word; a word and the full stop or comma after it are pieces of their own."""
        kept, out, alone, cut = self.kept, {}, [], {}
        for w in words:
            core = w[:-1]
            if w[-1:] in self.marks and core.isalpha():
                cut[w] = core
            else:
                alone.append(w)
        wanted = {c for c in cut.values() if c not in kept and c not in words}
        alone += wanted
        alone.sort(key=str.isalpha)
        border = sum(not w.isalpha() for w in alone)
        for group in (alone[:border], alone[border:]):
            for at in range(0, len(group), 128):
                part = group[at : at + 128]
                out.update(zip(part, self._chunks(part)))
        for w, core in cut.items():
            out[w] = (kept.get(core) or out[core]) + self.marks[w[-1]]
        return out

    def _looked_up(self, words: list[str]) -> list[bytes]:
        """The ids of each of the different words, from the store or the tokenizer."""
        kept = self.kept
        codes = list(map(kept.get, words))
        missing = [k for k, c in enumerate(codes) if c is None]
        if missing:
            here = self._codes({words[k] for k in missing})
            for k in missing:
                codes[k] = here[words[k]]
            if room := self.cache_words - len(kept):
                kept.update([(w, c) for w, c in here.items() if len(w) <= CACHED_LEN][:room])
        return codes

    def _first(self, word: str) -> bytes:
        code = self.firsts.get(word)
        if code is None:
            code = self._ids(word).astype("<u4").tobytes()
            if len(self.firsts) < FIRST_WORDS and len(word) <= CACHED_LEN:
                self.firsts[word] = code
        return code

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and the number of each text's; ``end_id`` closes each text.

        No text has a space before white space or its end (see :meth:`encode_odd`), so its chunks are its words.
        """
        words, numbers, counts = word_numbers(texts)
        codes = self._looked_up(words)
        firsts = np.cumsum(counts) - counts
        codes += [self._first(words[k]) for k in numbers[firsts].tolist()]
        numbers[firsts] = np.arange(len(words), len(codes))
        if end_id is not None:
            codes.append(np.array([end_id], "<u4").tobytes())
            numbers, counts = np.insert(numbers, np.cumsum(counts), len(codes) - 1), counts + 1
        ids, sizes = spelled(codes, numbers, "<u4")
        return ids, text_sums(sizes, counts)

    def encode_odd(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for any texts, cut at the spaces that a non-space follows."""
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        rows = []
        for t in texts:
            ws = _CUT.split(t) if _ODD.search(t) else t.split(" ")
            rows.append(self._first(ws[0]) + b"".join(self._looked_up(ws[1:])) + end)
        return np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4

    def encode_whole(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library's default, each text in one piece."""
        end = [] if end_id is None else [end_id]
        rows = [x.ids + end for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in rows for i in x), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows))


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _id_batches(batches: Iterator[pa.RecordBatch], tokenizer_file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if tokenizer_file not in _TOKENIZERS:
        _TOKENIZERS[tokenizer_file] = ChunkTokenizer(tokenizer_file)
    tok = _TOKENIZERS[tokenizer_file]
    counts = np.zeros(max(len(tok.opens), end_id + 1), np.int64)
    kind = np.dtype("<u2" if len(counts) <= 65_536 else "<u4")
    for b in batches:
        sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
        for lo, hi in row_slices(sizes, _LIMIT):
            part = b.slice(lo, hi - lo)
            coded = []
            if tok.literal:
                marked = pc.match_substring_regex(part.column(1), tok.literal)
                if pc.any(marked).as_py():
                    whole, part = part.filter(marked), part.filter(pc.invert(marked))
                    coded.append((whole, tok.encode_whole(whole.column(1).to_pylist(), end_id)))
            odd = pc.match_substring_regex(part.column(1), _ODD_ARROW)
            plain, other = part.filter(pc.invert(odd)), part.filter(odd)
            coded += [(plain, tok.encode(plain.column(1), end_id)), (other, tok.encode_odd(other.column(1).to_pylist(), end_id))]
            for rows, (ids, n) in coded:
                counts += np.bincount(ids, minlength=len(counts))
                offsets = np.r_[0, np.cumsum(n) * kind.itemsize].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), packed], names=["doc_id", "n_tokens", "ids"])
    seen = np.flatnonzero(counts)
    total = np.stack([seen, counts[seen]], axis=1).astype("<i8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([COUNTS], pa.int64()), pa.array([total], pa.binary())], names=["doc_id", "n_tokens", "ids"])


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids with the end id, little-endian, 2 bytes each (4 for vocabularies over 65,536).

    Each task adds a row with ``n_tokens`` = ``COUNTS``: its (id, count) pairs, 8 bytes each number.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    return narrow.mapInArrow(partial(_id_batches, tokenizer_file=tokenizer_file, end_id=end_id), "doc_id long, n_tokens long, ids binary")


def _unpack(ids: pa.Array, counts: np.ndarray) -> np.ndarray:
    _, offsets, data = ids.buffers()
    offs = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), "<u2" if len(raw) == 2 * counts.sum() else "<u4")


# ---- the code -------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``most`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if most < (n - 1).bit_length():
        raise ValueError(f"{n} symbols do not fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    is_leaf, level = [], leaves
    for i in range(most):
        if i:
            even = len(level) // 2 * 2
            packages = level[0:even:2] + level[1:even:2]
            both = np.r_[leaves, packages]
            at = np.argsort(both, kind="stable")
            level = both[at]
            is_leaf.append(at < n)
        else:
            is_leaf.append(np.ones(n, bool))
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):  # the first `take` items hold the lightest leaves; the rest are packages of the level below
        used = int(flags[:take].sum())
        lengths[order[:used]] += 1
        take = 2 * (take - used)
    return lengths


def canonical_codes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Codes in canonical order: by length, then id."""
    codes, code, before = np.zeros(len(ids), np.int64), 0, 0
    for k in np.lexsort((ids, bits)).tolist():
        code <<= int(bits[k]) - before
        before = int(bits[k])
        codes[k] = code
        code += 1
    return codes


class Code:
    """Encoding arrays and the decoding table of a header (id, bits)."""

    def __init__(self, header: list[tuple[int, int]]):
        ids, bits = (np.array(x, np.int64) for x in (zip(*sorted(header)) if header else ([], [])))
        codes = canonical_codes(ids, bits)
        size = int(ids.max()) + 1 if len(ids) else 0
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.bits[ids], self.codes[ids] = bits, codes
        self.width = int(bits.max()) if len(ids) else 1
        self.symbol, self.length = np.zeros(1 << self.width, np.uint32), np.zeros(1 << self.width, np.int64)
        for i, b, c in zip(ids.tolist(), bits.tolist(), codes.tolist()):
            lo = c << (self.width - b)
            self.symbol[lo : lo + (1 << self.width - b)] = i
            self.length[lo : lo + (1 << self.width - b)] = b

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents one after the other, each from a byte on: the bytes, each document's first byte, each id's bit."""
        ids = ids.astype(np.intp)
        lens = self.bits.take(ids)
        ends = np.cumsum(counts)
        total = np.r_[0, np.cumsum(lens)]
        doc_bits = total[ends] - total[ends - counts]
        first = np.r_[0, np.cumsum((doc_bits + 7) // 8)]
        at = total[:-1] + np.repeat(first[:-1] * 8 - total[ends - counts], counts)
        word, byte = self.codes.take(ids) << (32 - lens - (at & 7)), at >> 3
        head = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else np.zeros(0, np.int64)
        sums, where = np.add.reduceat(word, head) if len(head) else word, byte[head]  # the codes' bits are disjoint
        out = np.zeros(int(first[-1]) + 4, np.uint8)
        for k in range(4):
            out[where + k] |= ((sums >> (24 - 8 * k)) & 255).astype(np.uint8)
        return out[: int(first[-1])], first, at

    def decode(self, raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of stretches that start at bit ``at`` and have ``n`` ids, one stretch after the other."""
        b = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint32)
        words = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        out, starts = np.zeros(int(n.sum()), np.uint32), np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        at, to, left = at[order].copy(), starts[order], n[order]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # stretches with more than `step` ids
            here = at[:live]
            key = (words[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - self.width)
            out[to[:live] + step] = self.symbol[key]
            here += self.length[key]
        return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0):
            pairs = np.frombuffer(x.as_py(), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["id", "n"])


_BLOCK = "part int, block long, ids_before long, n_ids long, doc_ids array<long>, doc_tokens array<long>, checks binary, code binary"


def _block_batches(batches: Iterator[pa.RecordBatch], header: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Sorted documents (doc_id, n_tokens, ids) to coded blocks of whole documents."""
    code, part, block, before = Code(header), TaskContext.get().partitionId(), 0, 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        n, parts, checks, size, total = np.concatenate([h[1] for h in held]), [], [], 0, 0
        for _, counts, ids in held:
            raw, _, at = code.encode(ids, counts)
            starts = np.cumsum(counts) - counts
            checks += [at[s : s + k : CHECK] + 8 * size for s, k in zip(starts.tolist(), counts.tolist())]
            parts.append(raw.tobytes())
            size, total = size + len(raw), total + len(ids)
        one = lambda x, t: pa.array([x], t)
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        doc_ids = pa.concat_arrays([h[0] for h in held])
        cols = [one(part, pa.int32()), one(block, pa.int64()), one(before, pa.int64()), one(total, pa.int64()), lists(doc_ids), lists(pa.array(n)), one(np.concatenate(checks).astype("<i8").tobytes(), pa.binary()), one(b"".join(parts), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _BLOCK.split(", ")])

    total = 0
    for b in batches:
        sizes = b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in row_slices(sizes, SLICE_IDS):
            rows = b.slice(lo, hi - lo)
            held.append((rows.column(0), sizes[lo:hi], _unpack(rows.column(2), sizes[lo:hi])))
            total += int(sizes[lo:hi].sum())
            if total >= BLOCK_IDS:
                yield made()
                block, before, total, held = block + 1, before + total, 0, []
    if held:
        yield made()


def write_token_file(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 18) -> None:
    """Write the ids of all documents in ascending order of their ids (null first; equal ids by length, then code)."""
    spark = docs.sparkSession
    stored = shared_dir(spark, "token-ids")
    token_ids(docs, tokenizer_file, end_id, id_col, text_col).write.option("compression", "zstd").parquet(stored)
    rows = spark.read.parquet(stored)
    ids, task_counts = rows.filter(F.col("n_tokens") > 0), rows.filter(F.col("n_tokens") == COUNTS)
    counts = task_counts.select("ids").mapInArrow(_count_batches, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = sorted((r["id"], r["n"]) for r in counts.collect())  # at most the vocabulary
    bits = code_lengths(np.array([n for _, n in seen], np.int64), max(max_bits, len(seen).bit_length()))
    header = [(i, int(b)) for (i, _), b in zip(seen, bits)]
    spark.createDataFrame(header, "id long, bits long").coalesce(1).write.parquet(f"{path}/header")
    dealt = ids.repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")
    dealt.mapInArrow(partial(_block_batches, header=header), _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _decoded(batches: Iterator[pa.RecordBatch], header: list[tuple[int, int]]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    code = Code(header)
    for b in batches:
        for row in b.to_pylist():
            counts = np.array(row["doc_tokens"], np.int64)
            pieces = -(-counts // CHECK)
            n = np.full(int(pieces.sum()), CHECK, np.int64)
            n[np.cumsum(pieces) - 1] = counts - (pieces - 1) * CHECK
            yield row["ids_before"], row["doc_ids"], counts, code.decode(np.frombuffer(row["code"], np.uint8), np.frombuffer(row["checks"], "<i8"), n)


def _read_batches(batches: Iterator[pa.RecordBatch], header: list[tuple[int, int]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for before, doc_ids, counts, ids in _decoded(batches, header):
        ends = np.cumsum(counts)
        rows = [ids[e - n : e].astype("<u4") for e, n in zip(ends.tolist(), counts.tolist())]
        cols = [pa.array(doc_ids, pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in rows], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            cols.append(pa.array([x.tolist() for x in rows], pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the file: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""
    header = [(r["id"], r["bits"]) for r in spark.read.parquet(f"{path}/header").collect()]
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a file part
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(parts.select("part", base.alias("base")), "part").withColumn("ids_before", F.col("base") + F.col("ids_before")).select(*blocks.columns)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.mapInArrow(partial(_read_batches, header=header, with_ids=with_ids), schema)


def token_file_report(docs: DataFrame, tokenizer_file: str, end_id: int, **options) -> DataFrame:
    """Write ``docs`` to a token file in the shared folder and describe each document from the file.

    Null and empty texts are documents of the end id alone; repeated rows are documents of their own,
    next to each other; null ids come first; other columns are ignored; an empty table gives an empty
    file. A block holds whole documents, so a task holds one document of any length at a time.
    """
    path = shared_dir(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer_file, end_id, **options)
    return read_token_file(docs.sparkSession, path)
