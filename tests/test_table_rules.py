"""Membership in tables: verdicts joined to rows, without losing or repeating any."""

import json

import pytest
from pyspark.sql import functions as F

from sparkpact import ContractError, Engine, array_of, field, rules as r
from sparkpact.operators import table_rules


def sealed(cls, **options):
    engine = Engine(**options)
    engine.contract(cls)
    return engine.seal()


def found(engine, df, cls, **more):
    return sorted((x.k, x.codes or "") for x in engine.check(df, cls, **more).select("k", F.array_join("issues.code", ",").alias("codes")).collect())


@pytest.fixture(params=["broadcast", "shuffled"])
def way(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(table_rules, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(table_rules, "HOT_SHARE", 20)
    return request.param


def test_typed_columns_with_hot_and_null_values(spark, way):
    listed = spark.createDataFrame([(float(k),) for k in range(0, 60, 3)] * 2 + [(None,), (float("nan"),)], "n double")

    class A:
        n = field(r.is_in_table(listed, "n"), optional=True)
        m = field(r.is_not_in_table(listed, "n"), nullable=True)

    # a third of the rows hold one value, a third none
    rows = [(k, [3, None, k][k % 3] if k < 900 else k % 70, None if k % 5 == 0 else float(k % 50)) for k in range(1200)]
    df = spark.createDataFrame(rows, "k int, n int, m double")
    inside = set(range(0, 60, 3))
    want = [(k, ",".join(c for c, bad in (("isIn", n is not None and n not in inside), ("isNotIn", m is not None and m in inside)) if bad)) for k, n, m in rows]
    got = found(sealed(A, null_as="null"), df, A)
    assert got == want
    plan = sealed(A, null_as="null").check(df, A)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" not in plan and "INSET" not in plan and "Python" not in plan


def test_documents_conversion_and_nested_records(spark, way):
    words = spark.createDataFrame([("1",), ("two",), ("two",), (None,)], "w string")

    class Inner:
        w = field(r.is_string, r.is_in_table(words, "w"))

    class A:
        w = field(r.is_string, r.is_in_table(words, "w"), transform=[r.trim], name="word")
        inner = field(type=Inner, optional=True)

    docs = [{"word": " two "}, {"word": "three"}, {"word": 1}, {}, {"word": "1", "inner": {"w": "two"}}, {"word": "1", "inner": {"w": "2"}}, {"word": None}]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(7, "no json"), (8, None)], "k int, doc string")
    want = ["", "isIn", "isString,isIn", "isDefined", "", "isIn", "isDefined", "invalidInput", "invalidInput"]
    assert found(sealed(A), df, A, document="doc") == list(enumerate(want))

    class B:
        w = field(r.is_string, r.is_in_table(words, "w"))

    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate([{"w": 1}, {"w": 2}])], "k int, doc string")
    assert found(sealed(B, auto_convert=True), df, B, document="doc") == [(0, ""), (1, "isIn")]


def test_kinds_that_do_not_meet_and_empty_lists(spark, way):
    words = spark.createDataFrame([("1",)], "w string")

    class A:
        w = field(r.is_in_table(words, "w"))
        x = field(r.is_not_in_table(words.limit(0), "w"))

    df = spark.createDataFrame([(0, 1, 1), (1, 2, 2)], "k int, w int, x int")
    assert found(sealed(A), df, A) == [(0, "isIn"), (1, "isIn")]
    assert found(sealed(A), df.limit(0), A) == []
    assert sealed(A).decode(df, A).columns == ["k", "w", "x", "issues", "value"]


def test_what_a_join_cannot_judge_is_refused(spark):
    words = spark.createDataFrame([("1",)], "w string")
    one = r.is_in_table(words, "w")

    class Each:
        w = field(array_of(r.is_in_table(words, "w")))

    class Item:
        w = field(r.is_in_table(words, "w"))

    class Many:
        w = field(type=[Item])

    class Twice:
        a = field(one)
        b = field(one)

    df = spark.createDataFrame([(["1"], [("1",)], "1", "1")], "w array<string>, x array<struct<w:string>>, a string, b string")
    for cls, message in ((Each, "can't judge"), (Many, "can't judge"), (Twice, "used once")):
        with pytest.raises(ContractError, match=message):
            sealed(cls).check(df, cls)
    with pytest.raises(ContractError, match="use decode or check"):
        sealed(Twice).columns(Twice, df.schema)
    with pytest.raises(ContractError, match="can't be of type"):
        r.is_in_table(df, "w")


def test_groups_leave_the_join_out(spark):
    class A:
        w = field(r.is_in_table(spark.createDataFrame([("1",)], "w string"), "w"), groups=["g"])

    df = spark.createDataFrame([(0, "2")], "k int, w string")
    assert found(sealed(A), df, A, groups=["g"]) == [(0, "isIn")]
    assert "Join" not in sealed(A).check(df, A, groups=["other"])._jdf.queryExecution().optimizedPlan().toString()
