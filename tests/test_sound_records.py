"""Typed records that one test finds sound come out as those that are looked at rule by rule."""

import random

import pytest

from sparkpact import Engine, array_of, field, rules as r
from sparkpact.operators.rule import create_rule
from sparkpact.plans.compile import Compiler

SCHEMA = "k int, name string, at struct<street:string,zip:int,geo:struct<x:double,y:double>>, items array<struct<name:string,n:double,tags:array<string>>>, pairs array<struct<a:int,b:int>>, size double, late string"


class Geo:
    x = field(r.is_number(), r.min_value(0))
    y = field(r.is_number(), optional=True)


class At:
    street = field(r.is_string, r.min_length(2))
    zip = field(r.is_int, nullable=True)  # noqa: A003
    geo = field(type=Geo, optional=True)


class Item:
    name = field(r.is_string, name="name", message="m")
    n = field(r.is_number(), r.max_value(5), transform=r.round_to(0))
    tags = field(array_of(r.is_string, r.min_length(1)), optional=True, groups=["g"])


class Pair:
    a = field(r.is_int)
    b = field(r.is_in([1, 2]), optional=True)


class Whole:
    who = field(r.is_string, r.is_alpha, name="name")
    at = field(type=At)
    items = field(r.array_min_size(1), type=[Item])
    pairs = field(type=[Pair], nullable=True)
    size = field(r.is_positive, optional=True)
    late = field(r.is_string, when=lambda v: v.child("size").get("number") > 1)


def rows(n=400):
    rng = random.Random(4)
    one = lambda *of: rng.choice(of)
    often = lambda good, *bad: good if rng.random() < 0.93 else rng.choice(bad)
    out = []
    for k in range(n):
        geo = often((one(0.0, 2.5), one(None, 1.0)), None, (-1.0, 1.0), (float("nan"), None), (None, None))
        at = often((often("st", "s", None), one(None, 5), geo), None, (None, None, None))
        items = often([often((often("i", None), often(1.4, 9.0, None), often(["t"], None, [], [""], ["t", None])), None) for _ in range(rng.randrange(1, 4))], [], None)
        pairs = often([(often(1, None), often(2, 3, None)) for _ in range(rng.randrange(3))], None, [None])
        out.append((k, often("ab", "a1", None, ""), at, items, pairs, often(one(None, 0.5, 2.0), -1.0), often("x", None)))
    return out


@pytest.mark.parametrize("options, groups", [({}, ["g"]), ({"null_as": "null"}, None), ({"auto_convert": True}, ["g"]), ({"stop_at_first_error": True}, None), ({"forbid_unknown": True}, None), ({"allow_class_defaults": True}, ["g"])], ids=str)
def test_both_ways_give_the_same(spark, monkeypatch, options, groups):
    df, out, kinds = spark.createDataFrame(rows(), SCHEMA), [], []
    df = df.drop("k") if "forbid_unknown" in options else df
    for quick in (True, False):
        if not quick:
            monkeypatch.setattr(Compiler, "sound", lambda *_: None)
        engine = Engine(**options)
        engine.contract(Whole)
        decoded = engine.seal().decode(df, Whole, groups=groups).select("value", "issues")
        out.append(decoded.collect())
        kinds.append(decoded.schema["value"].dataType.simpleString())
    assert kinds[0] == kinds[1]
    # NaN is not equal to itself
    assert list(map(repr, out[0])) == list(map(repr, out[1]))
    sound = sum(not x.issues for x in out[0])
    assert sound > 20 and sum(bool(x.issues) for x in out[0]) > 20


def test_what_one_test_cannot_tell(spark):
    class Odd:
        at = field(type=At)
        v = field(create_rule("odd", python=lambda x: x % 2 == 1))

    engine = Engine()
    engine.contract(Odd)
    df = spark.createDataFrame([(("st", 1, (1.0, 1.0)), 1), (("st", 1, None), 2)], "at struct<street:string,zip:int,geo:struct<x:double,y:double>>, v int")
    assert [[i.code for i in x.issues] for x in engine.seal().check(df, Odd).collect()] == [[], ["odd"]]


def test_sound_arrays_come_as_they_came(spark):
    class Pairs:
        pairs = field(type=[Pair])

    engine = Engine()
    engine.contract(Pairs)
    df = spark.createDataFrame([([(1, 2), (3, 1)],), ([(1, None)],)], "pairs array<struct<a:int,b:int>>")
    assert [x.value.pairs for x in engine.seal().decode(df, Pairs).collect()] == [x.pairs for x in df.collect()]
    assert engine.uses_python(Pairs) is False
