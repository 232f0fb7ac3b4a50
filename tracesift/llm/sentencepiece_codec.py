"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a batch (a run of U+2581 and the characters after it; no piece of a
vocabulary goes over such a border) are sorted, which lays them out as the depth-first walk of their
trie. The search keeps one forward state per character of the current word; the next word reuses
the states of the common prefix and goes on from there.

Forward states, by kind of vocabulary:

* ``unigram``: the best score to this position and the last piece on that path.
* ``bpe``: the merges define one path. A piece may follow the last piece of the path to where it
  starts only if merging these two pieces' characters alone yields just these two pieces; by the
  locality of merges, exactly one piece passes at each position, and the path is the library's.

Characters that no piece covers become byte pieces (or the unknown id). No shuffle: texts are encoded
where they are read. A worker keeps at most ``CACHE_WORDS`` words; others are encoded batch by batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .support import row_slices, text_or_empty

MARK = "▁"
CACHE_WORDS, CACHE_PAIRS, CACHED_LEN = 200_000, 300_000, 48
_LIMIT = 1 << 20  # bytes of text whose words a worker holds at once
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary:
    """Pieces and scores; ``special`` are ids that no text yields, ``bytes_at`` the id of byte 0 or None."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, special: set[int], bytes_at: int | None, unk: int = 0):
        self.kind, self.unk, self.bytes_at = kind, unk, bytes_at
        byte_ids = set(range(bytes_at, bytes_at + 256)) if bytes_at is not None else set()
        usable = [(p, i) for i, p in enumerate(pieces) if i not in special and i not in byte_ids]
        self.ids = {p: i for p, i in usable}
        self.score = {p: scores[i] for p, i in usable}
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.low = min(self.score.values(), default=0.0) - 10.0  # an uncovered character, as in unigram models
        self.raw = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for k, i in enumerate(sorted(byte_ids)):
            self.raw[i] = bytes([k])
        if unk < len(self.raw):
            self.raw[unk] = " ⁇ ".encode()
        self.pairs: dict[int, bool] = {}  # by the two pieces' numbers: whether the second may follow the first
        self.count = len(pieces)

    def unknown(self, char: str) -> list[int]:
        return [self.unk] if self.bytes_at is None else [self.bytes_at + b for b in char.encode()]

    def merged(self, text: str) -> list[str]:
        """Plain merging of adjacent symbols, best score first, leftmost among equals."""
        syms, score = list(text), self.score
        while len(syms) > 1:
            best, at = None, -1
            for k in range(len(syms) - 1):
                s = score.get(syms[k] + syms[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            syms[at : at + 2] = [syms[at] + syms[at + 1]]
        return syms

    def number(self, piece: str) -> int:
        """Of a piece its id, of an uncovered character a number above all ids."""
        return self.ids[piece] if piece in self.ids else self.count + ord(piece)

    def may_follow(self, left: str, right: str, key: int) -> bool:
        ok = self.merged(left + right) == ([left, right] if left else [right])
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok


def load_vocabulary(model_file: str, kind: str = "bpe") -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    byte_ids = [i for i in range(n) if sp.is_byte(i)]
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kind, special, byte_ids[0] if byte_ids else None, sp.unk_id())


def encode_sorted(words: list[str], vocab: Vocabulary) -> Iterator[list[int]]:
    """The ids of each of the sorted words, depth first over their trie."""
    tails, ids, scores, bpe = vocab.tails, vocab.ids, vocab.score, vocab.kind == "bpe"
    pairs, may_follow = vocab.pairs, vocab.may_follow
    # by position: last piece of the path, its number, its score; and the word before
    last, number, total, before = [""], [vocab.count + 0x110000], [0.0], ""
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del last[shared + 1 :], number[shared + 1 :], total[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            start, found = end - 1, []
            while start >= 0 and (piece := word[start:end]) in tails:
                if piece in ids:
                    found.append(piece)
                start -= 1
            if bpe:
                chosen = ""
                for piece in reversed(found):
                    at = end - len(piece)
                    key = number[at] << 24 | ids[piece]
                    ok = pairs.get(key)
                    if may_follow(last[at], piece, key) if ok is None else ok:
                        chosen = piece
                        break
                last.append(chosen or word[end - 1])
                number.append(vocab.number(last[end]))
                total.append(0.0)
            else:
                options = [(total[end - len(p)] + scores[p], p) for p in found] or [(total[end - 1] + vocab.low, word[end - 1])]
                best, chosen = max(options, key=lambda x: (x[0], len(x[1])))
                last.append(chosen)
                number.append(0)
                total.append(best)
        out, end = [], len(word)
        while end:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        yield [i for p in reversed(out) for i in ((ids[p],) if p in ids else vocab.unknown(p))]
        before = word


class Encoder:
    """Texts to id arrays, with a bounded store of words already encoded."""

    def __init__(self, vocab: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocab, self.cache_words = vocab, cache_words
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def keys(text: str) -> list[str]:
        """The marked words of a text without their first mark, a dummy one put before the text."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        if text[0] == MARK or MARK + MARK in text:
            return [w[1:] for w in _WORD.findall(MARK + text)]
        return text.split(MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split, kept = [self.keys(t) for t in texts], self.kept
        words = list(chain.from_iterable(split))
        codes = list(map(kept.get, words))  # most words need this one look-up
        missing = [k for k, c in enumerate(codes) if c is None]
        if missing:
            new = sorted({words[k] for k in missing})
            ids = encode_sorted([MARK + w for w in new], self.vocab)
            here = {w: np.array(x, "<i4").tobytes() for w, x in zip(new, ids)}
            for k in missing:
                codes[k] = here[words[k]]
            if room := self.cache_words - len(kept):
                kept.update([(w, here[w]) for w in dict.fromkeys(words[k] for k in missing) if len(w) <= CACHED_LEN][:room])
        ends = list(accumulate(map(len, split)))
        return [np.frombuffer(b"".join(codes[e - len(ws) : e]), "<i4") for e, ws in zip(ends, split)]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of an id sequence: pieces and bytes joined, marks as spaces, the dummy one taken off."""
    text = b"".join(map(vocab.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(model_file: str, kind: str) -> Encoder:
    """One per worker process: reused by the tasks that it runs."""
    if (model_file, kind) not in _ENCODERS:
        _ENCODERS[model_file, kind] = Encoder(load_vocabulary(model_file, kind))
    return _ENCODERS[model_file, kind]


def _int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


def _text_rows(batches: Iterator[pa.RecordBatch], limit: int = _LIMIT) -> Iterator[tuple[pa.Array, list[str]]]:
    for b in batches:
        sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
        for lo, hi in row_slices(sizes, limit):
            part = b.slice(lo, hi - lo)
            yield part.column(0), part.column(1).to_pylist()


def _encode_batches(batches: Iterator[pa.RecordBatch], model_file: str, kind: str) -> Iterator[pa.RecordBatch]:
    enc = _encoder(model_file, kind)
    for ids, texts in _text_rows(batches):
        yield pa.RecordBatch.from_arrays([ids, _int_lists(enc.encode(texts))], names=["doc_id", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], model_file: str, kind: str) -> Iterator[pa.RecordBatch]:
    vocab = _encoder(model_file, kind).vocab
    for b in batches:
        texts = [decode_ids(np.array(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], np.int32), vocab) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _round_trip_batches(batches: Iterator[pa.RecordBatch], model_file: str, kind: str) -> Iterator[pa.RecordBatch]:
    enc = _encoder(model_file, kind)
    for ids, texts in _text_rows(batches):
        coded = enc.encode(texts)
        decoded = [decode_ids(x, enc.vocab) for x in coded]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                _int_lists(coded),
                pa.array([len(x) for x in coded], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                pa.array([t.replace(MARK, " ") == d for t, d in zip(texts, decoded)], pa.bool_()),
            ],
            names=["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"],
        )


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))


def encode(docs: DataFrame, model_file: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each input row.

    Null and empty texts have no ids; very long texts and words are encoded whole; repeated rows stay
    repeated; null ids stay null; other columns are ignored.
    """
    return _narrow(docs, id_col, text_col).mapInArrow(partial(_encode_batches, model_file=model_file, kind=kind), "doc_id long, ids array<int>")


def decode(coded: DataFrame, model_file: str, kind: str = "bpe", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids; null ids give an empty text."""
    narrow = coded.select(coded[id_col].cast("long").alias("doc_id"), coded[ids_col].cast("array<int>").alias("ids"))
    return narrow.mapInArrow(partial(_decode_batches, model_file=model_file, kind=kind), "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model_file: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256, round_trip) for each input row, in one pass over the texts.

    ``round_trip``: decoding the ids gives the text back (U+2581 in a text reads as a space, as in the library).
    An empty table gives an empty result.
    """
    schema = "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    return _narrow(docs, id_col, text_col).mapInArrow(partial(_round_trip_batches, model_file=model_file, kind=kind), schema)
