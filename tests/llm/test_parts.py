"""The methods' parts against plain versions."""

import heapq
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracesift.llm import decontaminate, exact_dedup, language_id, simhash, suffix_dedup, token_output, url_filter
from tracesift.llm import sentencepiece_codec as sp
from tracesift.llm.queries import tokenizer_file

from .brute import components, repeated_bytes


# ---- SentencePiece --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.load_vocabulary(tokenizer_file("piece_bpe_32k.model")), cache_words=500)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aehinorst  ▁\n\t<s>é門😀0.1,"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_bpe_ids_are_the_librarys(library, encoder, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts)


def test_long_runs_and_words(library, encoder):
    texts = [" " * k + "hello" + " " * k for k in range(40)] + ["ab" * 4000, "x" * 3000, "門" * 500, " " * 2000, "a\n" * 900]
    coded = encoder.encode(texts)
    assert [x.tolist() for x in coded] == library.encode(texts)
    assert [sp.decode_ids(x, encoder.vocab) for x in coded] == texts


def test_unigram_search_is_optimal():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab", "aab"]
    scores = [0.0, -2.0, -3.0, -3.5, -4.0, -3.2, -4.1, -5.0, -4.4]
    vocab = sp.Vocabulary(pieces, scores, "unigram", {0}, None, 0)
    words = sorted("▁" + "".join(w) for n in range(1, 7) for w in product("ab", repeat=n))

    def best(word):
        if not word:
            return 0.0
        return max(scores[i] + best(word[len(p) :]) for i, p in enumerate(pieces) if i and word.startswith(p))

    for word, ids in zip(words, sp.encode_sorted(words, vocab)):
        assert "".join(pieces[i] for i in ids) == word
        assert sum(scores[i] for i in ids) == pytest.approx(best(word))


# ---- suffix array ---------------------------------------------------------------------------------
def test_repeated_starts_by_counting():
    rnd = random.Random(5)
    for _ in range(150):
        length, letters = rnd.choice([9, 12, 20, 40]), rnd.choice([b"ab", b"abc ", bytes(range(97, 120))])
        base = bytes(rnd.choice(letters) for _ in range(200))
        texts = set()
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randint(0, 150)
            t = bytearray(base[a : a + rnd.randint(0, 90)] + bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 30))))
            if rnd.random() < 0.5:
                t[rnd.randrange(len(t))] = 120
            texts.add(bytes(t))
        texts = sorted(texts)
        counts = np.array([rnd.choice([1, 1, 2]) for _ in texts])
        seen = {}
        for t, c in zip(texts, counts):
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + c
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, counts, length)] == want


@pytest.mark.parametrize("max_group", [0, 2, 10_000])
def test_repeats_with_groups_of_any_size(spark, max_group):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 40))) + passage[rnd.randint(0, 60) :] + " ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    texts += ["ab" * 300, "x" * 150, "x" * 41, texts[0], texts[0], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, length=40, gram=16, max_group=max_group).collect()}
    for i, covered in enumerate(repeated_bytes(texts, 40)):
        raw = (texts[i] or "").encode()
        spans = sum(c and not p for c, p in zip(covered, [False, *covered]))
        assert bytes(got[i]["kept"]) == bytes(b for b, c in zip(raw, covered) if not c)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(raw), sum(covered), spans)


# ---- SimHash --------------------------------------------------------------------------------------
def _plain_fingerprint(text):
    words, out = text.lower().encode().split(), 0  # ASCII only below
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            out |= 1 << bit
    return out


def test_fingerprints():
    for t in ["", " \n", "one", "one two", "One two\tthree", "a b c a b c a b c d", "x " * 3000, "lorem ipsum dolor " * 900]:
        assert simhash.fingerprint(t) == _plain_fingerprint(t)
    assert simhash.fingerprint("Éa b c") == simhash.fingerprint("Éa B C") != simhash.fingerprint("éa b c")  # A-Z only
    assert simhash.fingerprint("a\u00a0b c d") == simhash.fingerprint("a\u00a0b  c\x0bd")  # no-break space is no space


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(3000)) + " " + "q" * 5000
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_SLICE", 100)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("shard_limit", [1, 4096])
def test_links_lose_no_component(spark, shard_limit):
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(rnd.randint(0, 6)):
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3])):
                v ^= 1 << b
            values.add(v)
    values |= {0, 1, (1 << 64) - 1}
    signed = [simhash._signed(v) for v in sorted(values)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2, shard_limit)).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    want = components(signed, near)
    assert {v: root.get(v, v) for v in signed} == want


def test_bk_tree_finds_all_within():
    rnd = random.Random(4)
    values = list({rnd.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        for radius in (0, 1, 2, 4):
            assert sorted(tree.values[k] for k in tree.within(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


# ---- URLs -----------------------------------------------------------------------------------------
def test_longest_rule_wins_and_digests_decide(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX_HEX", 1)  # many false meetings on the short prefix
    rules = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("a.com", "/x/y", "allow"), ("b.a.com", "/", "block"), ("a.com", "/x/", "allow"), (None, "/", "block"), ("org", None, "block")]
    urls = {
        "http://a.com/x/z": "block", "http://a.com/x/yes": "allow", "https://b.a.com/x/": "block", "http://za.com/x/": "allow",
        "http://a.com": "allow", "http://q.org?x": "block", "http://Q.A.COM/x/#f": "block", "http://org.net/": "allow",
        "a.com/x/": "allow", None: "allow", "": "allow", "x://": "allow", "http://a.com.x/x/": "allow",
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(pages, r).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    none = url_filter.filter_urls(pages, r.limit(0)).collect()
    assert len(none) == len(urls) and all(x["verdict"] == "allow" and x["rule"] is None for x in none)


# ---- Bloom ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_only_possible_repeats_are_sent_on(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "_bits", lambda rows: bits)
    texts = [f"text {i}" for i in range(400)] + ["text 7", "text 7", "text 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    narrow = df.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    maps, n = exact_dedup.repeated_filter(narrow, "digest")
    maybe = {r["doc_id"] for r in exact_dedup.with_candidate_flag(narrow, "digest", maps, n).filter("__maybe").collect()}
    assert {7, 9, 400, 401, 402} <= maybe
    assert len(maybe) < 60 or bits == 64  # a full filter sends all on, with the same result:
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got[7] == (401, 3, False) and got[401] == (401, 3, True) and got[9] == (402, 2, False) and got[0] == (0, 1, True)


# ---- Huffman --------------------------------------------------------------------------------------
def test_code_lengths():
    rnd = random.Random(1)
    for n in (1, 2, 3, 10, 200):
        counts = np.array([rnd.randint(1, 10 ** rnd.randint(0, 6)) for _ in range(n)])
        heap, total = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        free = token_output.code_lengths(counts, 64)
        assert n == 1 or (free * counts).sum() == total  # unlimited lengths are Huffman's
        tight = token_output.code_lengths(counts, max(1, (n - 1).bit_length()))
        assert (2.0 ** -tight.astype(float)).sum() <= 1 and tight.max() <= max(1, (n - 1).bit_length())
    with pytest.raises(ValueError):
        token_output.code_lengths(np.ones(9), 3)


def test_coded_blocks_decode():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 50_000), 9000).astype(np.uint32)
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    code = token_output.Code(list(zip(seen.tolist(), token_output.code_lengths(counts[seen], 15).tolist())))
    n = np.array([1, 127, 128, 129, 20_000, 0, 29_615])
    raw, first, at = code.encode(ids, n)
    starts = np.cumsum(n) - n
    check = token_output.CHECK
    checks = np.concatenate([at[s : s + k : check] for s, k in zip(starts, n)])
    sizes = np.concatenate([np.diff(np.r_[np.arange(0, k, check), k]) for k in n if k])
    assert (code.decode(raw, checks, sizes) == ids).all()


def test_chunk_ids_are_the_librarys():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rnd = random.Random(1)
    letters = "abcdefghilnorstuy   \n\tABéß門梦<|>012.,'-_()=\x1c\x85\xa0 "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", " x", "x ", "  ", "", "don't  \n stop, now. Now, stop.", "a, b. é, 9, x_,"]
    own = token_output.ChunkTokenizer(tokenizer_file("byte_bpe_50k.json"), cache_words=100)
    want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    rows = lambda found: [x.tolist() for x in np.split(found[0], np.cumsum(found[1])[:-1])]
    assert rows(own.encode_odd(texts)) == want
    odd = pc.match_substring_regex(pa.array(texts), token_output._ODD_ARROW).to_pylist()
    assert odd == [bool(token_output._ODD.search(t)) for t in texts] and 100 < sum(odd) < len(texts) - 100
    plain = [(t, w) for t, w, o in zip(texts, want, odd) if not o]
    for _ in range(2):  # the second time with what was kept
        assert rows(own.encode(pa.array([t for t, _ in plain]))) == [w for _, w in plain]
    assert rows(own.encode(pa.array([t for t, _ in plain]), 7)) == [[*w, 7] for _, w in plain]


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)  # with its defaults
    texts = ["old <|endoftext|> new", "<|endoftext|>", "", "no such token", "two  spaces <|endoftext|><|endoftext|>  here ", "<|endof text|>", "x<|endoftext|>y"]
    for some in (texts, texts[1:2], texts[2:4]):
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some)], names=["doc_id", "text"])
        got = {}
        for b in token_output._id_batches(iter([rows]), file, 2):
            got |= {r["doc_id"]: (r["n_tokens"], np.frombuffer(r["ids"], "<u2").tolist()) for r in b.to_pylist() if r["n_tokens"] != token_output.COUNTS}
        want = [[*x.ids, 2] for x in tok.encode_batch(some, add_special_tokens=False)]
        assert got == {i: (len(w), w) for i, w in enumerate(want)}


# ---- retrieval, languages -------------------------------------------------------------------------
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(-1, 5), max_size=30))
def test_common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common_length(decontaminate.Queries._masks(a), len(a), b) == table[-1][-1]


def test_benchmark_in_blocks_and_paraphrases(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    items = [[word() for _ in range(rnd.randint(12, 40))] for _ in range(7)] + [[word() for _ in range(150)], ["two", "words"]]
    noise = lambda n: [word() for _ in range(n)]
    docs = {i: noise(300) for i in range(40)}
    docs[1][100:100] = items[0]
    docs[2][50:50] = [w if k % 6 else word() for k, w in enumerate(items[1])]  # every sixth word changed
    docs[3][0:0] = items[7]
    docs[4] += items[8]
    docs[5][20:20] = ["two", "other", "words"]
    docs[6][10:10] = items[2][: len(items[2]) // 3]  # too little of it
    d = spark.createDataFrame([(i, " ".join(w).upper() if i == 1 else ", ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "?!"), (None, "only once somewhere")], "item_id long, text string")
    for block in (512, 3):
        got = {r["doc_id"]: list(r["item_ids"]) for r in decontaminate.find_contamination(d, b, block_parts=block).collect() if r["contaminated"]}
        assert got == {1: [0], 2: [1], 3: [7], 4: [8]}


def test_votes_and_ties():
    m = {("a", "b"): np.array([-1.0, 1.0, 1.0]), ("a", "c"): np.array([-1.0, 1.0, -2.0]), ("b", "c"): np.array([3.0, -1.0, 1.0])}
    best, p = language_id._vote(["a", "b", "c"], m, 3)
    assert best[:2].tolist() == [0, 1] and best[2] in (0, 1, 2) and ((p > 0) & (p < 1)).all()


def test_margins_of_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"ab", b"abc", bytes(rng.integers(97, 123, 5000, dtype=np.uint8)), b"xyz abc"]
    offs, raw = np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
    w = rng.normal(size=(3, language_id.DIM))
    whole = language_id._means(offs, raw, w)
    monkeypatch.setattr(language_id, "_LIMIT", 64)
    assert np.allclose(language_id._means(offs, raw, w), whole)
    assert (whole[:3] == 0).all()


@pytest.mark.parametrize("n_docs, copies, every", [(60, 30, 30), (6, 1, 3)])
def test_items_of_frequent_words_are_found(spark, n_docs, copies, every):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 8)))
    items = [[word() for _ in range(30)] for _ in range(4)]
    docs = [[rnd.choice(rnd.choice(items[1:])) if k % every == 0 else word() for k in range(150)] for _ in range(n_docs)]
    docs[0][40:70] = docs[1][90:120] = items[0]
    docs += [docs[0]] * copies  # the item's words are in far more than COMMON of the passages
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (list(r["item_ids"]), r["lcs"]) for r in decontaminate.find_contamination(d, b).collect() if r["contaminated"]}
    assert got == {i: ([0], 1.0) for i in (0, 1, *range(n_docs, n_docs + copies))}


def test_words_needed_bound_every_match():
    rnd = random.Random(10)
    q = decontaminate.Queries([" ".join(rnd.choice("abcdefghijkl") for _ in range(n)).encode() for n in (1, 3, 7, 8, 9, 10, 25, 35, 64)])
    for _ in range(300):
        words = [rnd.randrange(-1, len(q.terms)) for _ in range(rnd.choice([4, 20, 128]))]
        for p, ids in enumerate(q.parts):
            assert not decontaminate.matches(q, p, words, near=False) or sum(t in words for t in ids) >= q.needed[p]
            assert decontaminate.matches(q, p, words) >= decontaminate.matches(q, p, words, near=False)


def test_held_positions():
    rnd = random.Random(12)
    q = decontaminate.Queries([" ".join(rnd.choice("abcdefghij") for _ in range(n)).encode() for n in (8, 9, 20, 33)])
    chunks = [[rnd.randrange(len(q.terms)) for _ in range(rnd.randint(1, 9))] for _ in range(30)]
    joined = np.array([k % 7 != 6 and k != 29 for k in range(30)])
    ids, chunk = np.concatenate(chunks), np.repeat(np.arange(30), [len(c) for c in chunks])
    got = decontaminate._held(q, ids, chunk, joined, np.array([1, 3]))
    for k in range(30):
        words = set(chunks[k]) | (set(chunks[k + 1]) if joined[k] else set())
        assert got[k].tolist() == [sum(t in words for t in q.parts[p]) for p in (1, 3)]


def test_latent_search_chooses_the_candidates(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 8)))
    item, docs = [word() for _ in range(40)], [[word() for _ in range(200)] for _ in range(40)]
    half = [w if k % 2 or k >= 35 else word() for k, w in enumerate(item)]
    docs[3][60:60] = half
    docs[4][60:60] = half[:35]  # without the answer
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(item)) for i in (7, 8, 8)], "item_id long, text string")
    got = {r["doc_id"]: (list(r["item_ids"]), r["lcs"]) for r in decontaminate.find_contamination(d, b).collect() if r["contaminated"]}
    assert set(got) == {3} and got[3][0] == [7, 8] and 0.5 <= got[3][1] < 0.6


def test_latent_space_is_fitted_on_the_passages_of_all_documents(spark, monkeypatch):
    from tracesift.llm import decontaminate as dc

    fitted, basis = [], dc.latent_basis
    monkeypatch.setattr(dc, "latent_basis", lambda matrix, *a, **k: fitted.append(matrix.count()) or basis(matrix, *a, **k))
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('alpha beta w', id) AS text")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    assert dc.find_contamination(docs.unionAll(docs), bench).count() == 8000
    assert fitted == [4000 + 1]


@given(st.lists(st.text(alphabet="aBcİßΣ中 ._-\n\x1c\x00é"), min_size=1, max_size=6))
def test_term_ids_of_texts(texts):
    q = decontaminate.Queries([b"a b c", "ab ß σ i̇".encode(), "é 中".encode()])
    ids, sizes = q.text_ids(texts)
    assert ids.tolist() == [q.terms.get(w, -1) for t in texts for w in decontaminate.words_of(t)]
    assert sizes.tolist() == [len(decontaminate.words_of(t)) for t in texts]


def _read(batches, rows):
    for b in batches:
        rows.add(b.num_rows)
        yield b


def test_fit_reads_texts_and_passages_once(spark, monkeypatch):
    from functools import partial

    read, fitted, basis = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), decontaminate.latent_basis
    counted = lambda df, rows: df.mapInArrow(partial(_read, rows=rows), df.schema)
    monkeypatch.setattr(decontaminate, "latent_basis", lambda matrix, *a, **k: basis(counted(matrix, fitted), *a, **k))
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('alpha beta w', id) AS text")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    assert len(decontaminate.find_contamination(counted(docs, read), bench).collect()) == 500
    assert fitted.value == 500 + 1
    assert read.value == 2 * 500  # words, and the rows that get the verdicts


def test_latent_basis_spans_the_leading_directions(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_GRAM_TERMS", 7)  # blocks that do not end where the terms do
    rng = np.random.default_rng(4)
    idf, rows, dense = rng.uniform(0.1, 3, 30), [], []
    for k in range(200):
        terms = np.sort(rng.choice(10 if k % 2 else 30, rng.integers(1, 9), replace=False)).astype("<i2")
        times = rng.integers(1, 5, len(terms)).astype("<i2")
        rows.append((terms.tobytes(), times.tobytes(), 14.0 if k < 3 else 1.0))
        row = np.zeros(30)
        row[terms] = times * idf[terms]
        dense.append(row * rows[-1][2] / np.linalg.norm(row))
    matrix = spark.createDataFrame(rows, "terms binary, times binary, length double").repartition(5)
    got = decontaminate.latent_basis(matrix, idf, 30)
    want, a = np.linalg.svd(np.array(dense))[2].T, np.array(dense)
    assert np.allclose(got.T @ got, np.eye(30))
    for k in (1, 3, 10):
        assert np.linalg.norm(a @ got[:, :k]) >= 0.999 * np.linalg.norm(a @ want[:, :k])


def test_parts_are_grouped_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", 20)
    parts = [b" ".join(b"w%d" % (k * 5 + i) for i in range(12)) for k in range(6)] + [b" ".join(b"v%d" % i for i in range(30))]
    groups = list(decontaminate._by_terms(parts))
    assert [p for g in groups for p in g] == parts and [len(g) for g in groups] == [2, 2, 2, 1]
    docs = spark.createDataFrame([(k, f"before {p.decode()} after") for k, p in enumerate(parts)] + [(9, "before after")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, p.decode()) for k, p in enumerate(parts)], "item_id long, text string")
    got = {r["doc_id"]: list(r["item_ids"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert all(k in got[k] for k in range(7)) and got[9] == []
