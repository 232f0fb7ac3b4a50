"""Personal data: base patterns, and bootstrapped contextual extraction. JVM only.

Base spans come from four regular expressions. They are written without repeated groups (single
separators inside a number and single dots inside a domain are marked first), so that a match over a
very long run needs no deep recursion and each run is scanned once.

The bootstrapping: identifier-like tokens (with a digit or ``@``) are the instances, the two words before
them in the text, identifier-like or not, the patterns. Seeds are the tokens where a base span begins. Round by round, a pattern's confidence
is the weight of the instances in its slots over *all* slots of those two words in all documents; an instance's weight is 1 for a seed, else the confidence of its best
accepted pattern. Patterns with ``MIN_SEEDS`` distinct seeds and ``MIN_CONFIDENCE`` are accepted; tokens
in their slots that no base span touches become spans of the pattern's prevailing kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import store, text_or_empty

KINDS = ["email", "ip", "card", "phone"]  # order among spans that start together
TOKEN = 4  # the kind number of identifier-like tokens
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 3, 0.8, 3
FILTER_BITS = 1 << 18  # of the patterns' hashes, which every task gets: 32 kB

_MARK, _OTHER = "\x01", "\x02"
_LOCAL, _DOMAIN = rf"[A-Za-z0-9._%+{_MARK}-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++{_MARK}[A-Za-z0-9{_MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{_MARK}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _marked(text: Column, pattern: str) -> Column:
    """``text`` with each single character that ``pattern`` finds replaced by the mark; positions stay."""
    free = F.when(F.instr(text, _MARK) > 0, F.translate(text, _MARK, _OTHER)).otherwise(text)
    return F.regexp_replace(free, pattern, _MARK)


def _words(text: Column) -> Column:
    """Lower-cased words; white space at an end of the text makes an empty one there."""
    return F.split(F.lower(text), r"\s+")


def _befores(words: Column) -> Column:
    """The two words before each word with a digit or ``@`` (each identifier is such a word), null where there are fewer."""
    n = F.size(words)
    led = F.concat(F.array(F.lit(""), F.lit("")), words)
    threes = F.arrays_zip(F.slice(led, F.lit(1), n).alias("a"), F.slice(led, F.lit(2), n).alias("b"), words.alias("c"))
    return F.transform(F.filter(threes, lambda x: x["c"].rlike("[0-9@]")), lambda x: F.when((x["a"] != "") & (x["b"] != ""), F.concat_ws(" ", x["a"], x["b"])))


def _pieces(kind: int, text: Column, pattern: str, when: Column, befores: Column | None = None) -> Column:
    """The matches of a pattern in order: (kind, i, characters before it since the last match, match, words before it)."""
    gaps = F.when(when, F.split(text, pattern, -1))
    found = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("gap"), (F.array().cast("array<string>") if befores is None else befores).alias("before"))
    matched = F.slice(zipped, F.lit(1), F.size(found))  # the text after the last match is a gap, too
    made = F.transform(matched, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["m"].alias("match"), x["before"].alias("before")))
    return F.coalesce(made, F.array().cast("array<struct<kind:int,i:int,gap:int,match:string,before:string>>"))


def find_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match, or one of nulls for a document without any: (rid, doc_id, kind, start, end, match, before)."""
    t = F.col("t")
    digit = t.rlike("[0-9]")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("t"))
    rows = rows.withColumn("w", F.when(digit | (F.instr(t, "@") > 0), _words(t)))
    every = F.concat(
        _pieces(0, _marked(t, rf"(?<={_DOMAIN})\.(?={_DOMAIN})"), EMAIL, F.instr(t, "@") > 0),
        _pieces(1, t, IP, digit),
        _pieces(2, _marked(t, r"(?<=[0-9])[\x20-](?=[0-9])"), CARD, digit),
        _pieces(3, t, PHONE, F.instr(t, "+") > 0),
        _pieces(TOKEN, t, IDENTIFIER, digit | (F.instr(t, "@") > 0), _befores(F.col("w"))),
    )
    made = store(rows.select("rid", "doc_id", F.explode_outer(every).alias("x")).select("rid", "doc_id", "x.*"), "pieces")
    so_far = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    # documents without a match need no window
    placed = made.filter("kind IS NOT NULL").withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    none = made.filter("kind IS NULL").withColumn("end", F.lit(None).cast("long")).withColumn("start", F.lit(None).cast("long"))
    cols = ["rid", "doc_id", "kind", "start", "end", "match", "before"]
    return placed.select(cols).unionByName(none.select(cols))


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def passes() -> Column:
    """Whether a base match holds: ip parts up to 255, 12 to 19 card digits with a Luhn sum, 9 to 15 phone digits."""
    ip = F.expr("forall(split(match, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)")
    digit = "cast(substring(d, length(d) - k + 1, 1) AS int)"
    luhn = F.expr(
        "aggregate(transform(array(regexp_replace(match, '[^0-9]', '')), d -> aggregate(sequence(1, greatest(length(d), 1)), 0, (s, k) -> s + "
        f"CASE WHEN k % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)), 0, (s, x) -> s + x) % 10 = 0"
    )
    card = F.when(F.length(_digits()).between(12, 19), luhn).otherwise(F.lit(False))
    return F.when(F.col("kind") == 0, F.lit(True)).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).when(F.col("kind") == 3, F.length(_digits()).between(9, 15))


def _contexts(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens with their pattern, instance, seed kind (null: no seed) and whether a base span touches them."""
    rows = base.select("rid", "start", "end", "kind", F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("before")).unionByName(tokens.select("rid", "start", "end", "kind", "match", "before"))
    at = Window.partitionBy("rid").orderBy("start", F.col("kind").desc())  # a token before the base spans that start with it
    is_base = F.col("kind") < TOKEN
    after, until = at.rowsBetween(0, Window.unboundedFollowing), at.rowsBetween(Window.unboundedPreceding, 0)
    next_start, next_kind = F.min(F.when(is_base, F.col("start"))).over(after), F.first(F.when(is_base, F.col("kind")), ignorenulls=True).over(after)
    covered = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(until) > F.col("start"), F.lit(False))
    marked = rows.withColumn("next", next_start).withColumn("next_kind", next_kind).withColumn("covered", covered).filter(F.col("kind") == TOKEN)
    begins = F.coalesce((F.col("next") < F.col("end")) & ~F.col("covered"), F.lit(False))
    return marked.select(
        "rid", "start", "end", "match",
        F.xxhash64(F.lower("match")).alias("instance"),
        F.col("before").alias("pattern"),
        F.when(begins, F.col("next_kind")).alias("seed"),
        (begins | F.col("covered")).alias("base"),
    ).filter("pattern IS NOT NULL AND (seed IS NOT NULL OR NOT base)")


def _bitmap(patterns: DataFrame) -> bytes:
    """A bit for the hash of each pattern: ``FILTER_BITS`` bits whatever their number."""
    out = bytearray(FILTER_BITS // 8)
    for r in patterns.select(F.pmod(F.xxhash64("pattern"), F.lit(FILTER_BITS)).alias("at")).distinct().collect():
        out[r["at"] // 8] |= 1 << r["at"] % 8
    return bytes(out)


def _has_bit(bits: bytes, pair: Column) -> Column:
    at = F.pmod(F.xxhash64(pair), F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring(F.lit(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def slots(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, slots): how often its two words occur with a word after them, in all documents.

    Word pairs whose hash no pattern has stay inside the document; the others, some by chance, are compared.
    """
    words, bits = _words(text_or_empty(docs, text_col)), _bitmap(patterns)
    pairs = F.expr("transform(sequence(0, size(w) - 3), i -> concat(w[i], ' ', w[i + 1]))")
    held = docs.select(words.alias("w")).filter("size(w) > 2").select(F.explode(F.filter(pairs, lambda x: _has_bit(bits, x))).alias("pattern"))
    return held.join(patterns.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("slots"))


def accepted_patterns(tokens: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, kind, confidence) after the rounds over the pattern-instance graph.

    Slots are counted in all documents, but only for patterns that can be accepted and have a token to add: a pattern's
    hits are never more than its tokens, so one with too many slots in the documents that hold tokens is out already.
    """
    seeded = tokens.filter("seed IS NOT NULL").groupBy("pattern", "seed").agg(F.count("*").alias("n"), F.countDistinct("instance").alias("seeds"))
    support = seeded.groupBy("pattern").agg(F.sum("seeds").alias("seeds"), F.max_by(F.col("seed"), F.struct(F.col("n"), -F.col("seed"))).alias("kind")).filter(F.col("seeds") >= MIN_SEEDS)
    support = store(support, "patterns")
    graph = store(
        tokens.join(support.select("pattern"), "pattern", "left_semi").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max((F.col("seed").isNotNull()).cast("double")).alias("sure")),
        "graph",
    )
    wanted = support.join(tokens.filter("NOT base").select("pattern").distinct(), "pattern", "left_semi")
    most = graph.groupBy("pattern").agg(F.sum("n").alias("most"))
    with_tokens = docs.filter(text_or_empty(docs, text_col).rlike("[0-9@]"))
    at_least = slots(with_tokens, wanted, text_col).withColumnRenamed("slots", "least")
    possible = store(wanted.join(most, "pattern").join(at_least, "pattern").filter(F.col("most") >= MIN_CONFIDENCE * F.col("least")).select(*support.columns), "possible")
    seen = store(slots(docs, possible, text_col).join(possible, "pattern"), "slots")
    weights = graph.groupBy("instance").agg(F.max("sure").alias("weight"))
    for k in range(ROUNDS):
        scored = graph.join(weights, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("weight")).alias("hits"))
        patterns = store(scored.join(seen, "pattern").select("pattern", "kind", F.least(F.lit(1.0), F.col("hits") / F.col("slots")).alias("confidence")), f"scores-{k}")
        best = graph.join(patterns, "pattern", "left").groupBy("instance").agg(F.max("sure").alias("sure"), F.max(F.when(F.col("confidence") >= MIN_CONFIDENCE, F.col("confidence")).otherwise(0.0)).alias("best"))
        weights = best.select("instance", F.greatest("sure", "best").alias("weight"))
    return patterns.filter(F.col("confidence") >= MIN_CONFIDENCE)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans and added.

    ``spans``: array of (start, rank, kind, end), code points, end exclusive, by start, then kind as in
    ``KINDS``; base spans all stay. ``added``: those that the bootstrapping found. Null text counts as
    empty and has no span; repeated rows stay repeated and count as documents of their own; null ids
    stay null; very long texts are read whole; other columns are ignored; an empty table gives an empty result. A
    pattern whose seeds are evenly of two kinds has the kind listed first.
    """
    pieces = store(find_pieces(docs, id_col, text_col), "placed")
    base = pieces.filter(F.col("kind") < TOKEN).filter(passes())
    tokens = store(_contexts(base, pieces.filter(F.col("kind") == TOKEN)), "tokens")
    patterns = accepted_patterns(tokens, docs, text_col)
    lead = F.length(F.regexp_extract("match", r"^[(\[{<\"']*+", 0))
    tail = F.length(F.regexp_extract("match", r"[.,;:!?)\]}>\"']*+$", 0))
    fresh = tokens.filter("NOT base").join(patterns, "pattern").select("rid", (F.col("start") + lead).alias("start"), "kind", (F.col("end") - tail).alias("end"), F.lit(True).alias("added")).filter("start < end")
    spans = base.select("rid", "start", "kind", "end", F.lit(False).alias("added")).unionByName(fresh)
    named = F.array(*[F.lit(k) for k in KINDS])
    entry = F.struct("start", F.col("kind").alias("rank"), F.get(named, F.col("kind")).alias("kind"), "end")
    ids = pieces.select("rid", "doc_id").distinct()
    by_doc = spans.groupBy("rid").agg(F.sort_array(F.collect_list(entry)).alias("spans"), F.sort_array(F.collect_list(F.when(F.col("added"), entry))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return ids.join(by_doc, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"), F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base counts by kind, the digest of the base spans, and all spans as text."""
    found = find_personal_data(docs, id_col, text_col)
    base = F.array_except("spans", "added")
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] != F.lit(k)), True)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))
