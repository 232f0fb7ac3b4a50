"""JSON payload features (H1-H5, B16, H19) on the FIXTURES F2 cases."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracesift.functions.json import (
    json_has_key,
    json_key_count,
    json_length,
    json_remove_field,
    json_set_field,
    json_string_literal,
    json_value_length,
    schema_conformance,
)

_scalars = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(alphabet=st.one_of(st.sampled_from('"\\\\{}[],: kq'), st.characters(exclude_categories=["Cs"])), max_size=8))
_values = st.recursive(_scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["k", "a", '"', "\\\\", "}"]), x, max_size=3)), max_leaves=6)

CASES = [
    ('{"CreditCard":4000123412341234,"Position":"12.50001, 7.25002","Address":"17 Harbour Road",'
     '"Money":"100,00$","username":"ab","password":"pass-word-16char"}'),
    '{"CreditCard":"4000123412341234","Username":"ab","Password":"pass-word-16char"}',
    '{"a": 1, "password": null}',
    '{}',
    '[1,2]',
    'not json',
    None,
    '{"CreditCard": 1, "x": {"y": [1, 2]}}',
]


def _df(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, j string")


def test_lengths_and_keys(spark):
    rows = {r["i"]: r for r in _df(spark).select(
        "i", json_length("j").alias("l"), json_key_count("j").alias("c"),
        json_has_key("j", "password").alias("e"), json_value_length("j", "password").alias("pl"),
        json_value_length("j", "CreditCard").alias("cl"),
    ).collect()}
    assert rows[0]["c"] == 6 and rows[0]["e"] == 1 and rows[0]["pl"] == 16 and rows[0]["cl"] == 16
    assert rows[0]["l"] == len(CASES[0])
    assert rows[1]["e"] == 0 and rows[1]["pl"] == 0  # case-sensitive by default (Q3)
    assert rows[2]["e"] == 1 and rows[2]["pl"] == 4  # JSON null counts as "null"
    assert rows[2]["l"] == len('{"a":1,"password":null}')  # compact re-serialisation
    assert rows[3]["c"] == 0 and rows[3]["l"] == 2
    for i in (4, 5, 6):  # not a JSON object -> NULL features
        assert rows[i]["l"] is None and rows[i]["e"] is None and rows[i]["pl"] is None
    assert rows[7]["l"] == len('{"CreditCard":1,"x":{"y":[1,2]}}')


def test_case_insensitive(spark):
    r = _df(spark).filter("i = 1").select(json_has_key("j", "password", True).alias("e"),
                                          json_value_length("j", "password", True).alias("l")).first()
    assert r["e"] == 1 and r["l"] == 16


def test_schema_conformance(spark):
    rows = {r["i"]: r["bad"] for r in _df(spark).select("i", schema_conformance("j").alias("bad")).collect()}
    assert rows[0] is False
    assert rows[1] is True and rows[3] is True and rows[4] is True and rows[5] is True


def test_set_and_remove(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x","c":3}',), ('{}',), ('{"b":"q\\"x"}',)], "j string")
    out = df.select(
        json_set_field("j", "b", F.lit('"new"')).alias("s"),
        json_set_field("j", "d", F.lit("5")).alias("add"),
        json_remove_field("j", "b").alias("rm"),
    ).collect()
    assert out[0]["s"] == '{"a":1,"b":"new","c":3}'
    assert out[0]["add"] == '{"a":1,"b":"x","c":3,"d":5}'
    assert out[0]["rm"] == '{"a":1,"c":3}'
    assert out[1]["add"] == '{"d":5}'
    assert out[2]["rm"] == '{}'
    assert out[2]["s"] == '{"b":"new"}'


def test_edits_leave_nested_values_alone(spark):
    cases = [
        ('{"CreditCard":{"n":1,"m":2},"x":1}', '{"CreditCard":7,"x":1}', '{"x":1}'),
        ('{"a":{"CreditCard":5},"CreditCard":1}', '{"a":{"CreditCard":5},"CreditCard":7}', '{"a":{"CreditCard":5}}'),
        ('{ "CreditCard" : 1 , "b" : [1, {"c" : "}"}] }', '{ "CreditCard" : 7 , "b" : [1, {"c" : "}"}] }', '{ "b" : [1, {"c" : "}"}] }'),
        ('{"CreditCard":1,"meta":{"k":1,"k":2}}', '{"CreditCard":7,"meta":{"k":1,"k":2}}', '{"meta":{"k":1,"k":2}}'),
        ('{"a":1.10,"b":1e3,"c":-0,"d":12345678901234567890123456789012345678901234567890}', '{"a":1.10,"b":1e3,"c":-0,"d":12345678901234567890123456789012345678901234567890,"CreditCard":7}', '{"a":1.10,"b":1e3,"c":-0,"d":12345678901234567890123456789012345678901234567890}'),
        ('{"z":{"b":1,"a":2},"\\u0043reditCard":"x:y,{","e":[]}', '{"z":{"b":1,"a":2},"\\u0043reditCard":7,"e":[]}', '{"z":{"b":1,"a":2},"e":[]}'),
        (' { } ', '{"CreditCard":7}', '{}'),
        ('{"a":"\\\\","b":"\\"}","c":{"CreditCard":[{"CreditCard":1}]}}', '{"a":"\\\\","b":"\\"}","c":{"CreditCard":[{"CreditCard":1}]},"CreditCard":7}', '{"a":"\\\\","b":"\\"}","c":{"CreditCard":[{"CreditCard":1}]}}'),
        ('{"CreditCard":1,"b":null,"CreditCard":2}', '{"CreditCard":7,"b":null,"CreditCard":7}', '{"b":null}'),
        ('{"k\\"q":"$1\\\\","é":true}', '{"k\\"q":"$1\\\\","é":true,"CreditCard":7}', '{"k\\"q":"$1\\\\","é":true}'),
        ('[1]', '[1]', '[1]'),
        ('no json', 'no json', 'no json'),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(cases)], "i int, j string")
    got = df.select("i", json_set_field("j", "CreditCard", F.lit("7")), json_remove_field("j", "CreditCard")).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [(s, r) for _, s, r in cases]


def test_string_literal_escapes(spark):
    r = spark.createDataFrame([('a"b\\c\n',)], "s string").select(json_string_literal("s")).first()[0]
    assert r == '"a\\"b\\\\c\\n"'


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(max_size=6), _values, max_size=4), min_size=1, max_size=20))
def test_edits_equal_a_plain_rebuild(spark, objects):
    """Whatever the object: the edited text parses to the edited object, and other members keep their text."""
    rows = [(i, json.dumps(o, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "i int, j string")
    got = df.select("i", json_set_field("j", "k", F.lit("[7]")).alias("s"), json_remove_field("j", "k").alias("r")).collect()
    for r in got:
        assert json.loads(r["s"]) == objects[r["i"]] | {"k": [7]}
        assert json.loads(r["r"]) == {k: v for k, v in objects[r["i"]].items() if k != "k"}
        if "k" not in objects[r["i"]] and objects[r["i"]]:
            assert r["r"] == rows[r["i"]][1] and r["s"] == rows[r["i"]][1][:-1] + ',"k":[7]}'


def test_no_payload_is_lost(spark):
    from tracesift.operators.augment import inject_anomalies

    texts = ['{"CreditCard":1,"meta":{"k":1,"k":2}}', "no json", "[1]", None, '{"a":1.10}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "Id long, request string")
    rows = {r["Id"]: r for r in inject_anomalies(df, rate=0.0).collect()}
    assert '"meta":{"k":1,"k":2}' in rows[0]["request"] and rows[0]["edited"]
    assert [rows[i]["request"] for i in (1, 2, 3)] == texts[1:4] and not any(rows[i]["edited"] for i in (1, 2, 3))
    assert rows[4]["request"].startswith('{"a":1.10,')


def test_members_are_found_without_a_fold_unless_deeply_nested(spark):
    """The pattern and the fold over the tokens take a text apart alike; only texts beyond the pattern's depth need the fold."""
    from tracesift.functions import json as js

    deep = '{"a":' + '{"b":[' * 9 + "1" + "]}" * 9 + ',"k":2}'
    texts = ['{"a": [1,{"x":"},"}] ,"k\\"" : "v","a":null}', "{ }", ' {"b":{"c":[[],{}]}} ', deep]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fold = F.transform(js._folded_members(F.col("t")), lambda m: m["head"])
    rows = df.select("t", F.col("t").rlike(js._OBJECT).alias("flat"), F.transform(js.json_members("t"), lambda m: m["head"]).alias("heads"), fold.alias("fold")).collect()
    assert {r["t"]: r["flat"] for r in rows} == {t: t != deep for t in texts}
    assert all(r["heads"] == r["fold"] for r in rows) and [len(r["heads"]) for r in rows if r["t"] == deep] == [2]
    arrays = ["[1,{\"a\":[2,\"],\"]}, \"s\" ]", "[]", "[" * 9 + "]" * 9 + " ", "[1,,2", "[1]x"]
    df = spark.createDataFrame([(t,) for t in arrays], "t string")
    rows = df.select("t", F.trim("t").rlike(js._ARRAY).alias("flat"), js.json_elements("t").alias("e"), js._folded_elements(F.trim("t")).alias("fold")).collect()
    assert all(r["e"] == r["fold"] for r in rows) and [r["flat"] for r in sorted(rows, key=lambda r: arrays.index(r["t"]))] == [True, True, False, False, False]
