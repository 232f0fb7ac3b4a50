"""The registered queries on the smallest tables: DuckDB twins, libraries, plain versions, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tracesift.llm import decontaminate, queries, simhash
from tracesift.plans.verify import digest, duck

from ..conftest import SF_SMALL
from .brute import base_spans, components, digest_of_spans, holds_item, plain_words, repeated_bytes


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def _rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF_SMALL).collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_duckdb(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF_SMALL).execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    assert len(rows) == len(theirs) > 0
    assert digest(df.columns, rows)[0] == digest(cols, theirs)[0]


def test_sentencepiece(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = _rows(spark, "op1_sentencepiece")
    for i, d in documents.items():
        assert list(got[i]["ids"]) == sp.encode(d["text"] or "") and got[i]["round_trip"]


def test_suffix(spark, documents):
    got = _rows(spark, "op2_suffix_dedup")
    for (i, d), covered in zip(documents.items(), repeated_bytes([d["text"] for d in documents.values()], 200)):
        raw, cov = (d["text"] or "").encode(), np.array(covered, bool)
        kept = np.frombuffer(raw, np.uint8)[~cov].tobytes() if raw else b""
        spans = int((np.diff(np.r_[0, cov.astype(int)]) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(cov.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_simhash(spark, documents):
    got = _rows(spark, "op3_simhash_neardup")
    prints = {i: simhash.fingerprint(d["text"] or "") for i, d in documents.items()}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_tokens(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got, at = _rows(spark, "op7_token_output"), 0
    for i in sorted(documents):
        ids = [*tok.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_personal_data(spark, documents):
    got = _rows(spark, "op8_pii")
    assert len(got) == len(documents)
    for i, d in documents.items():
        spans = base_spans(d["text"])
        assert got[i]["base_sha256"] == digest_of_spans(spans)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_contexts_find_new_identifiers(spark):
    from tracesift.llm import pii

    rows = [(i, f"some words come first, then Reach me: {chr(97 + i % 26)}x{i}@mail.example.com and more words {i}") for i in range(30)]
    rows += [(100, "some words and then Reach me: jo99-at-mail, please"), (101, "some words come first 77x and more")]
    got = {r["doc_id"]: r for r in pii.personal_data_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "email:30:42" and got[100]["n_email"] == 0 and got[100]["n_added"] == 1
    assert got[101]["n_added"] == 0 and got[3]["n_email"] == 1


def test_slots_are_counted_in_all_documents(spark):
    from tracesift.llm import pii

    rows = [(i, f"please Ask for {chr(97 + i)}x{i}@mail.example.com today") for i in range(8)] + [(50, "you may ask for b52, then")]
    rows += [(100 + i, "they ask for help and leave") for i in range(20)]  # no digit, no @
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["pattern"]: r["slots"] for r in pii.slots(docs, spark.createDataFrame([("ask for",)], "pattern string")).collect()} == {"ask for": 29}
    assert not any(r["n_added"] for r in pii.personal_data_report(docs).collect())


def test_words_before_an_identifier_may_be_identifiers(spark):
    from tracesift.llm import pii

    rows = [(i, f"{'x' * (i * 60)} Desk 7: {chr(97 + i)}x{i}@mail.example.com and on") for i in range(12)]
    rows += [(100, "our Desk 7: jo99-at-mail, please"), (101, "7: b52 x1"), (102, f"Long {'y' * 300} z26"), (103, "  a1\tb2\n c3 "), (104, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = {}
    for r in pii.find_pieces(docs).filter(f"kind = {pii.TOKEN}").orderBy("rid", "start").collect():
        before.setdefault(r["doc_id"], []).append((r["start"], r["match"], r["before"]))
    assert before[100] == [(9, "7:", "our desk"), (12, "jo99-at-mail,", "desk 7:")]
    assert before[101] == [(0, "7:", None), (3, "b52", None), (7, "x1", "7: b52")]
    assert before[102] == [(306, "z26", f"long {'y' * 300}")]
    assert before[103] == [(2, "a1", None), (5, "b2", None), (9, "c3", "a1 b2")]
    got = {r["doc_id"]: r for r in pii.personal_data_report(docs).collect()}
    assert got[100]["spans"] == "email:12:24" and got[100]["n_added"] == 1 and got[101]["n_added"] == 0


def test_contamination(spark, documents):
    got = _rows(spark, "op9_decontaminate")
    items = {r["item_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    found = {(i, k) for i, d in documents.items() for k, item in items.items() if holds_item(item, plain_words(d["text"]))}
    hits = {(i, k) for i, r in got.items() for k in r["item_ids"]}
    assert found and hits <= found and len(hits) >= 0.9 * len(found)
    assert {i for i, r in got.items() if r["contaminated"]} == {i for i, _ in hits}


def test_paraphrases_are_found_by_the_latent_search(spark, documents):
    rnd = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    items += [(1000 + k, " ".join(plain_words(documents[i]["text"])[20 : 20 + n])) for k, (i, n) in enumerate(zip(sorted(documents)[:12], (15, 25, 40, 60) * 3))]
    pool = [w for d in documents.values() for w in plain_words(d["text"])]
    texts, planted = [], []
    for k, (item, text) in enumerate(items):
        words = plain_words(text)
        words[:-5] = [rnd.choice(pool) if rnd.random() < 0.5 else w for w in words[:-5]]  # half of the wording, not the answer
        around = plain_words(documents[sorted(documents)[k + 20]]["text"])
        texts.append((k, " ".join(around[:50] + words + around[50:])))
        if len(words) >= 8 and holds_item(plain_words(text), plain_words(texts[-1][1])):
            planted.append((k, item))
    docs = spark.createDataFrame(texts + [(1000 + i, d["text"]) for i, d in documents.items()], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], i) for r in decontaminate.find_contamination(docs, bench).collect() for i in r["item_ids"]}
    assert len(planted) >= 12 and len(got & set(planted)) >= 0.9 * len(planted)


def test_languages(spark, documents):
    got = _rows(spark, "op10_language_id")
    held = [i for i in documents if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["lang_pred"] == documents[i]["lang"] for i in held)
    assert right >= 0.95 * len(held)


def test_pipeline(spark, documents):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    kept = {i: d["text"] or "" for i, d in documents.items() if any(c.isalpha() for c in d["text"] or "")}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    comps = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    kept = {i: t for i, t in kept.items() if comps[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = {i for i, t in kept.items() if not any(x in t for x in items)}
    assert got == clean
