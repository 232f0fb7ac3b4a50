"""JSON payload functions (H1-H5, B16, H19). All are JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PAYLOAD_KEYS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def compact_json(col) -> Column:
    """Compact re-serialisation of a JSON text; NULL when the text is not valid JSON."""
    return F.get_json_object(_c(col), "$")


def is_json_object(col) -> Column:
    return F.coalesce(compact_json(col).startswith("{"), F.lit(False))


def json_length(col) -> Column:
    """H1: characters in the compact JSON text (NULL unless a JSON object)."""
    return F.when(is_json_object(col), F.length(compact_json(col))).cast("long")


def json_key_count(col) -> Column:
    """H2: number of top-level keys (duplicates counted), NULL unless a JSON object."""
    return F.when(is_json_object(col), F.size(F.json_object_keys(_c(col)))).cast("long")


def _key_path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def json_has_key(col, key: str, case_insensitive: bool = False) -> Column:
    """H3: 1 when the top-level key exists (a JSON null value counts), else 0."""
    keys = F.json_object_keys(_c(col))
    if case_insensitive:
        hit = F.exists(keys, lambda k: F.lower(k) == key.lower())
    else:
        hit = F.array_contains(keys, key)
    return F.when(is_json_object(col), hit.cast("long"))


def json_value_text(col, key: str, case_insensitive: bool = False) -> Column:
    """Text of a top-level value: strings unquoted, numbers/objects as written compactly."""
    if not case_insensitive:
        return F.get_json_object(_c(col), _key_path(key))
    actual = F.get(F.filter(F.json_object_keys(_c(col)), lambda k: F.lower(k) == key.lower()), 0)
    path = F.concat(F.lit("$['"), actual, F.lit("']"))
    return F.call_function("get_json_object", _c(col), path)


def json_value_length(col, key: str, case_insensitive: bool = False) -> Column:
    """H4: length of the value text; 0 if the key is missing; a JSON null counts as 4 ("null")."""
    has = json_has_key(col, key, case_insensitive)
    text_len = F.length(json_value_text(col, key, case_insensitive))
    return F.when(has == 1, F.coalesce(text_len, F.lit(4))).when(has == 0, F.lit(0)).cast("long")


def payload_feature_columns(col, keys: Sequence[str] = PAYLOAD_KEYS, case_insensitive: bool = False,
                            keys_col=None, compact_col=None, lower_col=None) -> list[Column]:
    """H5: JTotalL, JTotalC, then (E, L) per key, named as in the feature schema.

    ``keys_col`` / ``compact_col`` / ``lower_col`` may name columns already holding
    ``json_object_keys(col)``, ``get_json_object(col, '$')`` and the lower-cased keys (see
    ``with_json_parts``), so each row parses its text for them once.
    """
    j = _c(col)
    keys_arr = _c(keys_col) if keys_col is not None else F.json_object_keys(j)
    compact = _c(compact_col) if compact_col is not None else compact_json(j)
    lower = _c(lower_col) if lower_col is not None else F.transform(keys_arr, lambda k: F.lower(k))
    is_obj = F.coalesce(compact.startswith("{"), F.lit(False))
    out = [
        F.when(is_obj, F.length(compact)).cast("long").alias("JTotalL"),
        F.when(is_obj, F.size(keys_arr)).cast("long").alias("JTotalC"),
    ]
    for key in keys:
        lname = "Position1L" if key == "Position" else f"{key}L"
        if case_insensitive:
            at = F.array_position(lower, key.lower())
            has = at > 0

            def value(actual: Column) -> Column:
                text = F.call_function("get_json_object", j, F.concat(F.lit("$['"), actual, F.lit("']")))
                for spelled in dict.fromkeys((key.capitalize(), key.lower(), key)):  # a constant path is parsed once a task, not once a row
                    text = F.when(actual == spelled, F.get_json_object(j, f"$['{spelled}']")).otherwise(text)
                return text

            # kept out of the generated code: with all keys in it, the method is longer than the 8,000 bytes that the JVM compiles
            text = _let(F.get(keys_arr, (at - 1).cast("int")), value)
        else:
            has = F.array_contains(keys_arr, key)
            text = F.get_json_object(j, _key_path(key))
        out.append(F.when(is_obj, has.cast("long")).alias(f"{key}E"))
        out.append(
            F.when(is_obj, F.when(has, F.coalesce(F.length(text), F.lit(4))).otherwise(F.lit(0))).cast("long").alias(lname)
        )
    return out


def with_json_parts(df, col: str, keys_col: str = "_jk", compact_col: str = "_jc", lower_col: str | None = None):
    """Adds the key list and the compact text of a JSON column (parsed once per row), and the keys in lower case if named."""
    out = df.withColumn(keys_col, F.json_object_keys(F.col(col))).withColumn(compact_col, compact_json(col))
    return out.withColumn(lower_col, F.transform(keys_col, lambda k: F.lower(k))) if lower_col else out


def schema_conformance(col, expected_keys: Sequence[str] = PAYLOAD_KEYS) -> Column:
    """True when the payload misses one of the expected keys (extra keys are ignored).

    The count of distinct known keys present must equal the size of the expected set.
    A text that is not a JSON object is non-conforming.
    """
    expected = F.array(*[F.lit(k) for k in dict.fromkeys(expected_keys)])
    known = F.size(F.array_intersect(F.json_object_keys(_c(col)), expected))
    return F.when(is_json_object(col), known != len(set(expected_keys))).otherwise(F.lit(True))


# --- H19: edits of top-level fields, on the members' own text -------------------------------
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_TOKENS = _STRING + r'|[{}\[\],:]|[^"{}\[\],:]++'  # strings, marks, and whatever lies between


def _nested(levels: int) -> str:
    """Pattern of an object's or array's text in which up to ``levels - 1`` others lie inside each other."""
    inner = f"|{_nested(levels - 1)}" if levels > 1 else ""
    return r'[{\[](?:[^"{}\[\]]++|' + _STRING + inner + r")*+[}\]]"


# Texts nested up to this depth are taken apart by one pattern; any other by a fold over its tokens.
_LEVELS = 6
_HEAD = r"\s*+" + _STRING + r"\s*+:"
_ITEM = r'(?:[^"{}\[\],]++|' + _STRING + "|" + _nested(_LEVELS) + ")++"
_OBJECT = rf"\A\s*+\{{(?:{_HEAD}{_ITEM}(?:,{_HEAD}{_ITEM})*+|\s*+)\}}\s*+\z"
_ARRAY = rf"\A\[(?:{_ITEM})?+(?:,(?:{_ITEM})?+)*+\]\z"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), 0)


def json_string_literal(col) -> Column:
    """JSON string literal of a text column."""
    one = F.to_json(F.array(_c(col).cast("string")))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def json_members(col) -> Column:
    """The object's members in order (duplicates included) as (head, body, key): the text up to the colon, after it, and the key.

    Nothing is parsed to a value and written again, so nested objects, duplicate keys, spaces and numbers stay as they are.
    A pattern finds the members; a text it does not fit, as it is nested more deeply, goes through a fold over its
    tokens, which knows the depth. NULL unless a JSON object.
    """
    text = _c(col)
    part = lambda n: F.regexp_extract_all(text, F.lit(f"({_HEAD})({_ITEM})"), F.lit(n))
    member = lambda head, body: F.struct(head.alias("head"), body.alias("body"), _key(head).alias("key"))
    found = F.when(text.rlike(_OBJECT), F.zip_with(part(1), part(2), member)).otherwise(F.transform(_folded_members(text), lambda m: member(m["head"], m["body"])))
    return F.when(is_json_object(text), found)


def keeps_members(col) -> Column:
    """Whether a text with these members edited has just the edited ones, so that it need not be taken apart again.

    So it is where the pattern finds the members; what a fold finds in a text that is not quite JSON may read otherwise.
    """
    return F.coalesce(_c(col).rlike(_OBJECT), F.lit(False))


def _folded_members(text: Column) -> Column:
    """The (head, body) of an object's members by a fold over the tokens, nested however deeply."""
    none = F.array().cast("array<struct<head:string,body:string>>")
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("head"), F.lit("").alias("body"), F.lit(False).alias("after"), none.alias("members"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        top = s["depth"] == 1
        ends = top & t.isin(",", "}")
        colon = top & (t == ":")
        begins = s["depth"] == 0
        drop = ends | begins | (depth == 0)
        head = F.when(drop, F.lit("")).when(s["after"], s["head"]).otherwise(F.concat(s["head"], t))
        body = F.when(drop, F.lit("")).when(s["after"], F.concat(s["body"], t)).otherwise(s["body"])
        pushed = F.concat(s["members"], F.array(F.struct(s["head"].alias("head"), s["body"].alias("body"))))
        return F.struct(
            depth.cast("int").alias("depth"), head.alias("head"), body.alias("body"), F.when(drop, F.lit(False)).otherwise(s["after"] | colon).alias("after"),
            F.when(ends & s["after"], pushed).otherwise(s["members"]).alias("members"),
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), empty, step)["members"]


def json_elements(col) -> Column:
    """The elements of an array's text, as they stand, whether or not each of them is valid JSON.

    NULL for a text whose brackets and strings do not close as those of one array. As in :func:`json_members`, the
    fold takes what the pattern does not fit.
    """

    def apart(text: Column) -> Column:
        items = F.regexp_extract_all(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(_ITEM), F.lit(0))
        return F.when(text.rlike(_ARRAY), F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")).otherwise(_folded_elements(text))

    return _let(F.trim(_c(col)), apart)


def _folded_elements(text: Column) -> Column:
    """The elements by a fold over the tokens, nested however deeply."""
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("items"), F.lit(True).alias("one"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        ends = ((s["depth"] == 1) & (t == ",")) | (depth == 0)
        now = F.when(ends | (s["depth"] == 0), F.lit("")).otherwise(F.concat(s["now"], t))
        items = F.when(ends & (F.trim(s["now"]) != ""), F.concat(s["items"], F.array(F.trim(s["now"])))).otherwise(s["items"])
        inside = (s["depth"] > 0) | ((t == "[") & (F.size(s["items"]) == 0))
        return F.struct(depth.cast("int").alias("depth"), now.alias("now"), items.alias("items"), (s["one"] & inside).alias("one"))

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    whole = F.array_join(tokens, "") == text
    found = F.aggregate(tokens, empty, step)
    return F.when(whole & text.startswith("[") & (found["depth"] == 0) & found["one"], found["items"])


def _key(head: Column) -> Column:
    """A member's key, however it is written."""
    plain = F.regexp_extract(head, r'"((?:[^"\\]++|\\.)*+)"\s*:$', 1)
    return F.when(plain.contains("\\"), F.get_json_object(F.concat(F.lit('["'), plain, F.lit('"]')), "$[0]")).otherwise(plain)


def set_member(members, key: str, raw_value) -> Column:
    """Members with the value of ``key`` replaced by a raw JSON value wherever it occurs, or added at the end; a NULL value changes nothing."""
    raw = _c(raw_value) if not isinstance(raw_value, str) else F.lit(raw_value)
    space = lambda m, rx: F.regexp_extract(m["body"], rx, 0)
    new = lambda m: F.struct(m["head"].alias("head"), F.concat(space(m, r"^\s*"), raw, space(m, r"\s*$")).alias("body"), m["key"].alias("key"))
    added = F.array(F.struct(F.concat(json_string_literal(F.lit(key)), F.lit(":")).alias("head"), raw.alias("body"), F.lit(key).alias("key")))

    def edited(ms: Column) -> Column:
        changed = F.transform(ms, lambda m: F.when(m["key"] == key, new(m)).otherwise(m))
        return F.when(raw.isNull(), ms).otherwise(F.when(F.exists(ms, lambda m: m["key"] == key), changed).otherwise(F.concat(ms, added)))

    return _let(_c(members), edited)


def remove_member(members, key: str) -> Column:
    return F.filter(_c(members), lambda m: m["key"] != key)


def object_text(members, before) -> Column:
    """The object of the members; ``before`` is the text they were read from, which stays where it is no object."""
    text = F.concat(F.lit("{"), F.array_join(F.transform(_c(members), lambda m: F.concat(m["head"], m["body"])), ","), F.lit("}"))
    return F.coalesce(text, _c(before))


def json_set_field(col, key: str, raw_value) -> Column:
    """Set a top-level key to a raw JSON value: in place when present (all its occurrences), else appended.

    Every other member keeps its text, byte for byte, in its place. A text that is no JSON object, or a NULL value, leaves
    the text as it is; only a NULL text gives NULL.
    """
    return object_text(set_member(json_members(col), key, raw_value), col)


def json_remove_field(col, key: str) -> Column:
    """Remove a top-level field (all its occurrences); the other members keep their text."""
    return object_text(remove_member(json_members(col), key), col)
