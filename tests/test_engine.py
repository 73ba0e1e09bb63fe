"""Contracts on frames: presence, gates, conversion, names, groups, nesting, unions, codecs, plans and streams."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkpact import ContractError, Engine, array_of, field, rules as r, union
from sparkpact.functions.compat import brackets_deep
from sparkpact.operators.rule import Rule
from sparkpact.plans.engine import exploded
from sparkpact.queries import queries
from sparkpact.sources import read_documents, split
from sparkpact.streaming import quarantine_stream


def sealed(cls, **options):
    engine = Engine(**options)
    engine.contract(cls)
    return engine.seal()


def decoded(spark, cls, documents, groups=None, **options):
    """[(value as dict or None, [(path, code)])] of JSON documents."""
    df = spark.createDataFrame([(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in enumerate(documents)], "k int, doc string")
    rows = sealed(cls, **options).decode(df, cls, document="doc", groups=groups).orderBy("k").collect()
    return [(x.value.asDict(True) if x.value is not None else None, [(i.path, i.code) for i in x.issues]) for x in rows]


def issues(spark, cls, documents, **more):
    return [found for _, found in decoded(spark, cls, documents, **more)]


def test_root_must_be_an_object(spark):
    class A:
        v = field(r.is_string, optional=True)

    assert issues(spark, A, [None, "nope", "1", "[]", "null", '"x"', "{}"]) == [[("", "invalidInput")]] * 6 + [[]]


@pytest.mark.parametrize("options, want", [({}, ["isDefined", "isDefined", "", "isString"]), ({"optional": True}, ["", "", "", "isString"]), ({"nullable": True}, ["isDefined", "", "", "isString"]), ({"optional": True, "nullable": True}, ["", "", "", "isString"])])
def test_presence(spark, options, want):
    class A:
        v = field(r.is_string, **options)

    assert [",".join(c for _, c in x) for x in issues(spark, A, [{}, {"v": None}, {"v": "x"}, {"v": 1}])] == want


def test_gate_hides_rules_and_ungated_rules_all_report(spark):
    class A:
        a = field(r.is_string, r.min_length(3), r.is_email())
        b = field(r.min_value(5), r.max_value(1))
        c = field(r.is_in([1]), r.equals(2))
        d = field(r.is_number(), r.is_positive)

    got = issues(spark, A, [{"a": 5, "b": "x", "c": 3, "d": "y"}, {"a": "x", "b": 3, "c": 1, "d": -1}])
    assert got == [[("a", "isString"), ("b", "min"), ("c", "isIn"), ("c", "equals"), ("d", "isNumber")], [("a", "minLength"), ("a", "isEmail"), ("b", "min"), ("b", "max"), ("c", "equals"), ("d", "isPositive")]]


def test_rules_of_two_types_are_refused():
    class A:
        a = field(r.min_length(1), r.min_value(1))

    with pytest.raises(ContractError):
        sealed(A)


def test_conversion(spark):
    class A:
        n = field(r.is_number(), optional=True)
        b = field(r.is_boolean, optional=True)
        d = field(r.is_date, optional=True)
        s = field(r.is_string, optional=True)
        h = field(type=float, optional=True)
        t = field(r.is_number(), transform=r.trim, optional=True)

    documents = [{"n": "25"}, {"n": " 0x1F "}, {"n": ""}, {"n": True}, {"n": "12d"}, {"n": "1e3"}, {"b": "true"}, {"b": 0}, {"b": "yes"}, {"d": "2024-01-02"}, {"d": 86400000}, {"d": "now"}, {"s": 1}, {"s": 1.5}, {"s": {}}, {"h": "7"}, {"h": "x"}, {"t": "5"}]
    got = decoded(spark, A, documents, auto_convert=True)
    values = [next((x for x in v.values() if x is not None), None) if v else [c for _, c in i] for v, i in got]
    assert values == [25.0, 31.0, 0.0, 1.0, ["conversionFailed"], 1000.0, True, False, ["conversionFailed"], datetime(2024, 1, 2), datetime(1970, 1, 2), ["conversionFailed"], "1", "1.5", "[object Object]", 7.0, ["conversionFailed"], ["isNumber"]]


def test_first_error_only(spark):
    class A:
        a = field(r.is_string)
        b = field(r.is_string)

    assert issues(spark, A, [{}], stop_at_first_error=True) == [[("a", "isDefined")]]


def test_message_context_and_constraints(spark):
    class A:
        a = field(r.min_length(3), message="short", context={"x": 1})
        b = field(r.max_value(2), message=lambda name, value, constraints: F.concat(F.lit(f"{name} {constraints.get('max')} "), value.cast("string")))
        c = field(array_of(r.max_value(2)), message=lambda name, value, constraints: value.cast("string"))

    df = spark.createDataFrame([("ab", 5.0, [1.0, 7.0])], "a string, b double, c array<double>")
    got = [tuple(i) for i in sealed(A).check(df, A).first().issues]
    assert got == [("a", "minLength", "short", '{"x":1}', '{"min":3}'), ("b", "max", "b 2 5.0", None, '{"max":2}'), ("c[1]", "max", "7.0", None, '{"max":2}')]


def test_names_exclusion_and_reserved(spark):
    class A:
        a = field(r.is_string, name="in_a")
        b = field(r.is_string, decode_name="x", encode_name="y")
        c = field(r.is_string, exclude=True)
        d = field(r.is_string, exclude="encode")

    (value, found), = decoded(spark, A, [{"in_a": "1", "x": "2", "d": "3", "c": 4, "other": 5}])
    assert found == [] and value == {"a": "1", "b": "2", "d": "3"}
    df = spark.createDataFrame([("1", "2", "3", "4")], "a string, b string, c string, d string")
    assert sealed(A).encode(df, A).first().record.asDict() == {"in_a": "1", "y": "2"}
    for wrong in ({"name": "__proto__"}, {"name": "a", "decode_name": "b"}, {"exclude": "never"}):
        with pytest.raises(ContractError):
            field(r.is_string, **wrong)
    with pytest.raises(ContractError):
        field(r.is_number)

    class Twice:
        a = field(r.is_string) & field(r.min_length(1))

    with pytest.raises(ContractError):
        sealed(Twice)


def test_unknown_keys_come_first_and_in_order(spark):
    class In:
        v = field(r.is_string)

    class A:
        a = field(r.is_string, name="x")
        hidden = field(r.is_string, exclude=True)
        n = field(type=In, optional=True)

    got = issues(spark, A, [{"z": 1, "x": 2, "b": 3, "hidden": 4}, {"x": "s", "n": {"q": 1}}], forbid_unknown=True)
    assert got == [[("z", "whitelistViolation"), ("b", "whitelistViolation"), ("a", "isString")], [("n.q", "whitelistViolation"), ("n.v", "isDefined")]]
    typed = sealed(A, forbid_unknown=True).check(spark.createDataFrame([("s", 1)], "x string, q int"), A).first()
    assert [(i.path, i.code) for i in typed.issues] == [("q", "whitelistViolation")]


def test_groups(spark):
    class A:
        name = field(r.is_string)
        secret = field(r.is_string, groups=["admin"])
        score = field(r.is_number()) & field(r.min_value(0), groups=["create"]) & field(r.max_value(100), groups=["update"])

    document = [{"name": "n", "score": -200}, {"name": "n", "score": 200}]
    got = {g: issues(spark, A, document, groups=[g] if g else None) for g in (None, "create", "update", "admin")}
    assert got[None] == [[("score", "min")], [("score", "max")]]
    assert got["create"] == [[("score", "min")], []] and got["update"] == [[], [("score", "max")]]
    assert got["admin"] == [[("secret", "isDefined")]] * 2
    with pytest.raises(ContractError):
        sealed(A).check(spark.createDataFrame([("n",)], "name string"), A, groups="admin")


def test_when_and_defaults(spark):
    class A:
        kind = field(r.is_string, default="none")
        size = field(r.is_int, when=lambda o: o.child("kind").get("string") == "box")
        color = field(r.is_string, optional=True, default="red")

    got = decoded(spark, A, [{}, {"kind": "box"}, {"kind": "box", "size": 3}, {"kind": None}, {"kind": "bag", "size": "x"}], allow_class_defaults=True)
    assert [x[1] for x in got] == [[], [("size", "isDefined")], [], [("kind", "isDefined")], []]
    assert got[0][0] == {"kind": "none", "size": None, "color": None} and got[4][0]["size"] is None


class Leaf:
    v = field(r.is_number())


class Tree:
    v = field(r.is_number())
    kids = field(type=lambda: [Tree], optional=True)


def test_nested_paths(spark):
    class A:
        one = field(type=Leaf, optional=True)
        many = field(r.array_min_size(2), type=[Leaf], optional=True)
        bag = field(r.array_max_size(3), array_of(r.is_string), type=set, optional=True)
        leaves = field(type=set, set_value=Leaf, optional=True)
        book = field(type=dict, map_value=Leaf, optional=True)
        words = field(array_of(r.min_length(2)), type=dict, optional=True)

    documents = [{"one": 1}, {"one": {"v": "x"}}, {"many": {}}, {"many": [{"v": "x"}]}, {"many": [1, {"v": 2}, None]}, {"bag": "x"}, {"bag": ["a", 1, "a", None]}, {"leaves": [{"v": 1}, {"v": None}]}, {"book": {"k": {"v": "x"}, "l": 3}}, {"book": []}, {"words": {"a": "xx", "b": "y"}}, {"words": 3}]
    assert issues(spark, A, documents) == [
        [("one", "isObject")], [("one.v", "isNumber")], [("many", "isArray")], [("many", "arrayMinSize"), ("many[0].v", "isNumber")], [("many[0].", "invalidInput"), ("many[2].", "invalidInput")], [("bag", "isArray")],
        [("bag", "arrayMaxSize"), ("bag[1]", "isString"), ("bag[3]", "isString")], [("leaves[1].v", "isDefined")], [("book[k].v", "isNumber"), ("book[l].", "invalidInput")], [("book", "isObject")], [("words[1]", "minLength")], [("words", "isObject")],
    ]
    (value, _), = decoded(spark, A, [{"bag": ["b", "a", "b"], "words": {"k": "vv"}, "book": {"k": {"v": 1}}}])
    assert value["bag"] == ["b", "a"] and value["words"] == {"k": "vv"} and value["book"] == {"k": {"v": 1.0}}


def test_element_rules_on_no_array(spark):
    class A:
        a = field(r.is_array, array_of(r.is_string))
        b = field(r.array_min_size(1), array_of(r.is_string))

    assert issues(spark, A, [{"a": 1, "b": 2}]) == [[("a", "isArray"), ("a", "isArray"), ("b", "arrayMinSize"), ("b", "isArray")]]


def test_recursion_of_any_depth(spark):
    def deep(n, last):
        return {"v": 1, "kids": [{"v": 2}, deep(n - 1, last)]} if n else last

    def path(n):
        return "kids[1]." * n

    docs = [deep(2, {"v": "x"}), deep(6, {"v": "x"}), deep(40, {"v": "]}"}), deep(41, {"v": 3, "kids": [{"v": None}, 5, {"v": 1, "kids": {}}]}), deep(39, {"v": 1}), {"v": "y", "kids": [deep(12, {"v": "x"}), {"v": "z"}, deep(9, {})]}]
    want = [
        [(path(2) + "v", "isNumber")], [(path(6) + "v", "isNumber")], [(path(40) + "v", "isNumber")], [(path(41) + "kids[0].v", "isDefined"), (path(41) + "kids[1].", "invalidInput"), (path(41) + "kids[2].kids", "isArray")], [],
        [("v", "isNumber"), ("kids[0]." + path(12) + "v", "isNumber"), ("kids[1].v", "isNumber"), ("kids[2]." + path(9) + "v", "isDefined")],
    ]
    for depth in (2, 4):
        found = decoded(spark, Tree, docs, max_depth=depth)
        assert [x for _, x in found] == want
    assert found[4][0]["kids"][1]["kids"][1]["v"] == 1
    # the first issue alone, and a row's own fault behind a deep tree that has none
    assert issues(spark, Tree, [docs[2], docs[5], {"v": "y", "kids": [deep(9, {"v": 1})]}], max_depth=2, stop_at_first_error=True) == [want[2], want[5][:1], [("v", "isNumber")]]


def test_recursion_through_several_contracts_and_unions(spark):
    def deep(n):
        return {"kind": "leaf", "x": "no"} if n == 0 else {"kind": "fork", "left": {"node": deep(n - 1)}} if n % 2 else {"kind": "fork", "left": {"node": None}, "right": {"node": deep(n - 1)}}

    class Leaf:
        x = field(r.is_number())

    class Fork:
        left = field(type=lambda: Holder, optional=True)
        right = field(type=lambda: Holder, optional=True)

    class Holder:
        node = field(discriminator=union("kind", leaf=Leaf, fork=Fork), optional=True)

    found = issues(spark, Holder, [{"node": deep(n)} for n in (0, 1, 15)] + [{"node": {"kind": "fork", "right": {"node": {"kind": "fork", "left": {"node": {"kind": "odd"}}, "z": 1}}}}], max_depth=3, forbid_unknown=True)
    steps = "node." + "".join("left.node." if n % 2 else "right.node." for n in range(15, 0, -1))
    assert found[:3] == [[("node.x", "isNumber")], [("node.left.node.x", "isNumber")], [(steps + "x", "isNumber")]]
    assert found[3] == [("node.right.node.z", "whitelistViolation"), ("node.right.node.left.node", "invalidDiscriminator")]


def test_what_lies_below_keeps_its_type(spark):
    class Dated:
        day = field(r.is_date)
        kids = field(type=lambda: [Dated], optional=True)

    node = "named_struct('day', date'2020-01-02')"
    for _ in range(7):
        node = f"named_struct('day', date'2020-01-01', 'kids', array({node}))"
    df = spark.sql(f"SELECT to_variant_object({node}) AS doc UNION ALL SELECT to_variant_object({node.replace(chr(39) + '2020-01-02' + chr(39), '').replace('date)', 'true)')})")
    assert [[(i.path, i.code) for i in x.issues] for x in sealed(Dated, max_depth=2).check(df, Dated, document="doc").collect()] == [[], [("kids[0]." * 7 + "day", "isDate")]]


def test_recursion_with_no_compiled_level_below(spark):
    class Link:
        v = field(r.is_number())
        next = field(type=lambda: Link, optional=True)

    doc = {"v": "x"}
    for _ in range(12):
        doc = {"v": 1, "next": doc}
    for depth in (0, 1, 5):
        assert issues(spark, Link, [doc, {"v": 1, "next": 5}], max_depth=depth) == [[("next." * 12 + "v", "isNumber")], [("next", "isObject")]]


def test_issues_below_come_in_the_order_of_the_text(spark):
    def tree(n):
        return {"v": "x", "kids": [tree(n - 1), 5, tree(n - 2)]} if n > 1 else {"v": "y", "kids": 7} if n else {"v": 1}

    def want(t, path=""):
        found = [] if t["v"] == 1 else [(path + "v", "isNumber")]
        if t.get("kids") == 7:
            return [*found, (path + "kids", "isArray")]
        for k, x in enumerate(t.get("kids", ())):
            found += [(f"{path}kids[{k}].", "invalidInput")] if x == 5 else want(x, f"{path}kids[{k}].")
        return found

    assert issues(spark, Tree, [tree(n) for n in range(9)], max_depth=1) == [want(tree(n)) for n in range(9)]


def test_brackets_are_counted(spark):
    texts = ["", "5", '"[["', "[]", "{}", "[[],[]]", '{"a":{"b":[1,{"c":"}}]"}]},"d":[]}', "[[[]],[[[{}]]],[]]", '["\\"[[[", []]', "[" * 300 + "]" * 300]

    def depth(x):
        x, at, most = re.sub(r'"(?:[^"\\]|\\.)*"', "", x), 0, 0
        for c in x:
            at += (c in "[{") - (c in "]}")
            most = max(most, at)
        return most

    found = spark.createDataFrame([(t,) for t in texts], "t string").select(brackets_deep(F.col("t")).alias("n")).collect()
    assert [x.n for x in found] == [depth(t) for t in texts]


def test_exploded_issues_are_judged_once(spark):
    df = sealed(Tree, max_depth=2).check(spark.createDataFrame([(1, '{"v":"x"}'), (2, '{"v":1}'), (3, "{}")], "k long, doc string"), Tree, document="doc")
    found = exploded(df, "k")
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "size(" in x]
    assert sorted((x.k, x.position, x.path, x.code) for x in found.collect()) == [(1, 0, "v", "isNumber"), (3, 0, "v", "isDefined")]


def test_documents_made_from_keys_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(200).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert queries()["recursive_documents"](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_structs_end_by_themselves(spark):
    kind, value = "struct<v:string>", ("x",)
    for _ in range(12):
        kind, value = f"struct<v:double,kids:array<{kind}>>", (1.0, [value])
    df = spark.createDataFrame([(value,)], f"doc {kind}")
    assert [(i.path, i.code) for i in sealed(Tree, max_depth=3).check(df, Tree, document="doc").first().issues] == [("kids[0]." * 12 + "v", "isNumber")]


class Dog:
    breed = field(r.is_string, name="race")


class Cat:
    indoor = field(r.is_boolean)


def test_union_of_no_case_is_an_error_on_encode(spark):
    class Dog2:
        breed = field(r.is_string)

    class Owner:
        pet = field(discriminator=union("type", dog=Dog2), optional=True)

    engine = sealed(Owner)
    schema = "pet struct<tag string, dog struct<breed string>>"
    fine = engine.encode(spark.createDataFrame([(("dog", ("x",)),), (None,)], schema), Owner).select(F.to_json("record").alias("j")).collect()
    assert [json.loads(x.j).get("pet") for x in fine] == [{"breed": "x"}, None]
    with pytest.raises(Exception, match="no case of the union"):
        engine.encode(spark.createDataFrame([(("bird", ("x",)),)], schema), Owner).select(F.to_json("record")).collect()


def test_text_behind_a_document_makes_it_invalid(spark):
    class V:
        v = field(r.is_string)

    engine = sealed(V)
    texts = ['{"v":"a"}', ' {"v":"a"} ', '{"v":"a"} garbage', '{"v":"a"}{"v":1}', '{"v":"a"},"b":1', '{"v":"a"}],[1', "null", "", None]
    got = engine.check(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, doc string"), V, document="doc").orderBy("k").collect()
    assert [x.is_valid for x in got] == [True, True] + [False] * 7
    assert all([i.code for i in x.issues] == ["invalidInput"] for x in got[2:])


def test_first_error_mode_does_not_look_further(spark):
    class F2:
        a = field(r.is_string, r.min_length(3))
        b = field(r.is_string, r.min_length(2))

    first = Engine(stop_at_first_error=True)
    first.contract(F2)
    first.seal()
    rows = spark.createDataFrame([("x", "y"), ("xyz", "y"), ("xyz", "yz")], "a string, b string")
    assert [[i.path for i in x.issues] for x in first.check(rows, F2).collect()] == [["a"], ["b"], []]

    class Loud:
        a = field(r.is_string, r.min_length(3))
        b = field(r.is_string, Rule("loud", lambda v: F.raise_error(F.concat(F.lit("looked at "), v.get("string"))).cast("boolean")))

    first, every = Engine(stop_at_first_error=True), Engine()
    for engine in (first, every):
        engine.contract(Loud)
        engine.seal()
    short = rows.where("length(a) < 3")
    assert [[i.path for i in x.issues] for x in first.check(short, Loud).collect()] == [["a"]]
    with pytest.raises(Exception, match="looked at y"):
        every.check(short, Loud).collect()


def test_unions(spark):
    class A:
        pet = field(discriminator=union("type", dog=Dog, cat=Cat), optional=True)
        pets = field(type=[object], discriminator=union("type", dog=Dog, cat=Cat), keep_discriminator_property=True, optional=True)

    good = {"pet": {"type": "dog", "race": "x"}, "pets": [{"type": "cat", "indoor": True}]}
    got = decoded(spark, A, [good, {"pet": {"type": "cow"}}, {"pet": {}}, {"pet": {"type": "cat", "indoor": 1}}, {"pets": [{"type": "dog"}, {"type": "x"}, 3]}])
    assert [x[1] for x in got] == [[], [("pet", "invalidDiscriminator")], [("pet", "invalidDiscriminator")], [("pet.indoor", "isBoolean")], [("pets[0].breed", "isDefined"), ("pets[1]", "invalidDiscriminator"), ("pets[2]", "invalidDiscriminator")]]
    assert got[0][0]["pet"] == {"tag": "dog", "dog": {"breed": "x"}, "cat": None} and got[0][0]["pets"][0]["cat"] == {"indoor": True, "type": "cat"}
    engine = sealed(A)
    df = spark.createDataFrame([(json.dumps(good),)], "doc string")
    out = engine.encode(engine.decode(df, A, document="doc"), A, column="value").select(F.to_json("record").alias("j")).first().j
    assert json.loads(out) == {"pet": {"race": "x"}, "pets": [{"indoor": True, "type": "cat"}]}


def test_inheritance(spark):
    class Base:
        a = field(r.is_string, r.min_length(5), message="base")
        b = field(r.is_string, optional=True)

    class Child(Base):
        c = field(r.is_string)
        a = field(r.min_length(2), message="child")

    got = issues(spark, Child, [{"a": "x"}, {"a": 1, "c": "c"}])
    assert got == [[("c", "isDefined"), ("a", "minLength")], [("a", "isString")]]

    class Plain(Child):
        pass

    engine = sealed(Child)
    assert engine.check(spark.createDataFrame([("ab", "c")], "a string, c string"), Plain).first().is_valid
    with pytest.raises(ContractError):
        engine.check(spark.createDataFrame([("ab",)], "a string"), Base)


@pytest.mark.parametrize(
    "codec, rule, document, value, back",
    [
        (r.trim, r.is_string, "\xa0 a b﻿\n", "a b", "a b"), (r.to_lower_case, r.is_string, "AbÉ", "abé", "abé"), (r.to_upper_case, r.is_string, "aß", "ASS", "ASS"), (r.round_to(1), r.is_number(), 1.25, 1.3, 1.3),
        (r.round_to(), r.is_number(), -2.5, -2.0, -2.0), (r.unix_seconds, r.is_date, 86400.5, datetime(1970, 1, 2, 0, 0, 0, 500000), 86400.0), (r.unix_millis, r.is_date, -1, datetime(1969, 12, 31, 23, 59, 59, 999000), -1.0),
        (r.iso_string, r.is_date, "2024-02-29T10:00:00+02:00", datetime(2024, 2, 29, 8), "2024-02-29T08:00:00.000Z"), (r.csv("|"), r.is_array, "a||b|", ["a", "", "b", ""], "a||b|"),
        (r.luxon(format="dd.MM.yyyy HH:mm", zone="Europe/Berlin"), r.is_date, "2024-07-01T10:00:00Z", datetime(2024, 7, 1, 10), "01.07.2024 12:00"), (r.moment(format="YYYY/MM/DD"), r.is_date, "2024-07-01", datetime(2024, 7, 1), "2024/07/01"),
        (r.luxon(), r.is_date, "2024-07-01", datetime(2024, 7, 1), "2024-07-01T00:00:00.000Z"),
    ],
)
def test_codecs_round_trip(spark, codec, rule, document, value, back):
    class A:
        v = field(rule, transform=codec)

    engine = sealed(A)
    df = spark.createDataFrame([(json.dumps({"v": document}),)], "doc string")
    out = engine.decode(df, A, document="doc")
    got = out.first().value.v
    got = [json.loads(str(x)) if not isinstance(x, str) else x for x in got] if isinstance(got, list) else got
    assert got == value
    if not isinstance(value, list):
        assert engine.encode(out, A, column="value").first().record.v == back


def test_codecs_leave_other_kinds_alone(spark):
    class A:
        a = field(r.is_date, transform=r.iso_string)
        b = field(r.is_date, transform=r.unix_millis)
        c = field(r.is_object, transform=r.json)
        d = field(r.is_string, transform=[r.trim, r.to_lower_case])

    got = issues(spark, A, [{"a": "soon", "b": "x", "c": "{", "d": 5}, {"a": "2024-01-01", "b": 5, "c": '{"x": 1}', "d": " A "}])
    assert got == [[("a", "isDate"), ("b", "isDate"), ("c", "isObject"), ("d", "isString")], []]


def test_typed_frames_agree_with_documents(spark):
    class A:
        n = field(r.is_number(), r.min_value(0))
        s = field(r.is_string, r.min_length(2), optional=True)
        l = field(array_of(r.is_positive), r.array_min_size(1))  # noqa: E741
        o = field(type=Leaf)

    rng = random.Random(0xC0FFEE)
    rows = [(rng.choice([None, -1.0, 2.5]), rng.choice([None, "a", "abc"]), rng.choice([None, [], [1.0, -1.0], [1.0]]), rng.choice([None, (1.0,), (None,)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "n double, s string, l array<double>, o struct<v: double>")
    both = df.withColumn("doc", F.to_json(F.struct(*df.columns)))
    engine = sealed(A)
    a = [[(i.path, i.code) for i in x.issues] for x in engine.check(df, A).collect()]
    b = [[(i.path, i.code) for i in x.issues] for x in engine.check(both, A, document="doc").collect()]
    assert a == b and any(a) and not all(a)
    c = [[(i.path, i.code) for i in x.issues] for x in engine.decode(df, A).collect()]
    assert a == c


def test_null_as(spark):
    class A:
        v = field(r.is_string, nullable=True)

    df = spark.createDataFrame([(None,)], "v string")
    assert [i.code for i in sealed(A).check(df, A).first().issues] == ["isDefined"]
    assert sealed(A, null_as="null").check(df, A).first().is_valid


def test_python_rules(spark):
    odd = r.create_rule("odd", python=lambda x: x % 2 == 1)

    class A:
        n = field(odd)
        l = field(array_of(odd))  # noqa: E741

    engine = sealed(A)
    assert engine.uses_python(A) and not sealed(Leaf).uses_python(Leaf)
    df = spark.createDataFrame([(1, [1, 2]), (None, [3]), (2, [])], "n long, l array<long>")
    assert [[(i.path, i.code) for i in x.issues] for x in engine.check(df, A).collect()] == [[("l[1]", "odd")], [("n", "isDefined")], [("n", "odd")]]
    assert issues(spark, A, [{"n": "x", "l": [1, "y"]}]) == [[("n", "odd"), ("l[1]", "odd")]]


def test_plan_is_one_projection(spark):
    class A:
        o_orderkey = field(r.is_int)
        o_orderstatus = field(r.is_string, r.length(1, 1))

    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = sealed(A).check(df, A).select("is_valid")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_engine_options_and_isolation(spark):
    class A:
        v = field(r.is_number())

    with pytest.raises(ContractError):
        Engine(nope=True)
    with pytest.raises(ContractError):
        Engine().check(spark.createDataFrame([("1",)], "v string"), A)
    df = spark.createDataFrame([("1",)], "v string")
    assert not sealed(A).check(df, A).first().is_valid and sealed(A, auto_convert=True).check(df, A).first().is_valid
    engine = sealed(A)
    assert engine.seal() is engine and "decode v as v: isNumber" in engine.explain(A)

    class Bad:
        v = field(type=int)
        n = field(type=object)

    with pytest.raises(ContractError):
        sealed(Bad)


def test_many_fields(spark):
    Wide = type("Wide", (), {f"f{k}": field(r.is_number(), r.min_value(1)) for k in range(300)})
    df = spark.createDataFrame([tuple(float(k % 2) for k in range(300))], ", ".join(f"f{k} double" for k in range(300)))
    assert len(sealed(Wide).check(df, Wide).first().issues) == 150


def test_split_and_read(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"v": 1}\n{"v": "x"}\n{\n')
    decoded_rows = sealed(Leaf).decode(read_documents(spark, str(path)), Leaf, document="document")
    good, bad = split(decoded_rows)
    assert [x.v for x in good.collect()] == [1.0] and [x.issues[0].code for x in bad.collect()] == ["isNumber", "invalidInput"]


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")

    class Event:
        event_id = field(r.is_int)
        event_type = field(r.is_in(["click", "view"]))

    stream = spark.readStream.schema("event_id bigint, event_type string").parquet(f"{tmp_path}/in")
    query = quarantine_stream(stream, sealed(Event), Event, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination(120)
    events = spark.read.parquet(f"{tmp_path}/in")
    n = events.where("event_type in ('click', 'view')").count()
    assert spark.read.parquet(f"{tmp_path}/good").count() == n > 0
    assert spark.read.parquet(f"{tmp_path}/bad").count() == events.count() - n > 0


def test_absent_keys_stay_absent(spark):
    class Inner:
        a = field(r.is_number(), optional=True)
        b = field(r.is_string, optional=True, nullable=True)

    class Outer:
        id = field(r.is_int)  # noqa: A003
        x = field(r.is_string, optional=True, nullable=True, decode_name="in", encode_name="ou\"t")
        inner = field(type=Inner)
        many = field(type=[Inner], optional=True)
        hidden = field(r.is_string, optional=True, exclude="encode")
        day = field(r.is_date, transform=r.iso_string, optional=True)

    engine = sealed(Outer)
    texts = [
        '{"id":1,"inner":{}}', '{"id":2,"in":null,"inner":{"b":null,"a":null},"hidden":"h"}', '{"id":3,"in":"q\\"\\n","inner":{"a":1.5,"b":"b"},"many":[{},{"b":null},{"a":-0.25}],"day":"2020-01-02T03:04:05.678Z"}', '{"id":"no"}', "nothing", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "doc string")
    want = ['{"id":1,"inner":{}}', '{"id":2,"ou\\"t":null,"inner":{"b":null}}', '{"id":3,"ou\\"t":"q\\"\\n","inner":{"a":1.5,"b":"b"},"many":[{},{"b":null},{"a":-0.25}],"day":"2020-01-02T03:04:05.678Z"}', None, None, None]
    decoded = engine.decode(df, Outer, document="doc", presence=True)
    assert [x.record for x in engine.encode(decoded, Outer, column="value", presence="presence", form="json").collect()] == want
    # the same from a VARIANT, and out as one
    decoded = engine.decode(df.select(F.try_parse_json("doc").alias("doc")), Outer, document="doc", presence=True)
    out = engine.encode(decoded, Outer, column="value", presence="presence", form="variant").select(F.to_json("record").alias("j"))
    assert [x.j and json.loads(x.j) for x in out.collect()] == [w and json.loads(w) for w in want]
    # without flags: null is absent where it can't have been null
    typed = spark.createDataFrame([(1, None, (None, None), None, None, None)], "id int, x string, inner struct<a:double,b:string>, many array<struct<a:double,b:string>>, hidden string, day timestamp")
    assert engine.encode(typed, Outer, form="json").first().record == '{"id":1,"ou\\"t":null,"inner":{"b":null}}'
    # flags of typed columns follow null_as
    class Plain:
        id = field(r.is_int)  # noqa: A003
        x = field(r.is_string, optional=True, nullable=True)

    for null_as, text in (("missing", '{"id":1}'), ("null", '{"id":1,"x":null}')):
        engine = sealed(Plain, null_as=null_as)
        decoded = engine.decode(typed.select("id", "x"), Plain, presence=True)
        assert engine.encode(decoded, Plain, column="value", presence="presence", form="json").first().record == text
    with pytest.raises(ContractError, match="presence needs"):
        engine.encode(typed, Plain, presence="x")
    with pytest.raises(ContractError, match="is none of"):
        engine.encode(typed, Plain, form="xml")


def test_contracts_without_optional_fields_need_no_flags(spark):
    class A:
        id = field(r.is_int)  # noqa: A003

    engine = sealed(A)
    decoded = engine.decode(spark.createDataFrame([('{"id":1}',)], "doc string"), A, document="doc", presence=True)
    assert engine.encode(decoded, A, column="value", presence="presence", form="json").first().record == '{"id":1}'


def test_engines_of_equal_options_compile_once(spark, monkeypatch):
    from sparkpact.plans.compile import Compiler

    class A:
        x = field(r.is_string)

    class B(A):
        y = field(r.is_string, optional=True)

    compiled, record = [], Compiler.record
    monkeypatch.setattr(Compiler, "record", lambda self, cls, *more: (compiled.append(cls), record(self, cls, *more))[1])
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    for options in ({}, {}, {"null_as": "missing"}, {"forbid_unknown": True}):
        assert sealed(A, **options).check(df, A).count() == 1
    assert compiled == [A, A]
    assert sealed(B).check(df, B).count() == 1 and sealed(A).check(df.select("x"), A).count() == 1
    assert compiled == [A, A, B, A]
    import gc
    import weakref

    gone = weakref.ref(B)
    del B
    compiled.clear()
    gc.collect()
    assert gone() is None
