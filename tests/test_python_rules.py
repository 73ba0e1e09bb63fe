"""Python rules on what arrays, sets, maps and unions hold, against a walk over the documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkpact import Engine, array_of, field, rules as r, union

odd = r.create_rule("odd", python=lambda x: x % 2 == 1)
few = r.create_rule("few", python=lambda x: len(x) < 3)


class Word:
    n = field(odd)
    marks = field(array_of(odd), optional=True)


class Line:
    words = field(few, type=[Word])
    top = field(type=Word, optional=True)


class Text:
    k = field(r.is_number(), odd)
    lines = field(few, type=[Line])


def sealed(cls, **options):
    engine = Engine(**options)
    engine.contract(cls)
    return engine.seal()


def is_odd(x):
    return isinstance(x, (int, float)) and x % 2 == 1


def word_issues(w, at):
    if not isinstance(w, dict):
        return [(at.rstrip("."), "invalidInput")] if w is not None else []
    out = [(at + "n", "isDefined")] if w.get("n") is None else [] if is_odd(w["n"]) else [(at + "n", "odd")]
    return out + [(f"{at}marks[{i}]", "odd") for i, m in enumerate(w.get("marks") or []) if not is_odd(m)]


def text_issues(t):
    out = [] if is_odd(t["k"]) else [("k", "odd")]
    if len(t["lines"]) > 2:
        out.append(("lines", "few"))
    for i, line in enumerate(t["lines"]):
        if len(line["words"]) > 2:
            out.append((f"lines[{i}].words", "few"))
        for j, w in enumerate(line["words"]):
            out += word_issues(w, f"lines[{i}].words[{j}].")
        if line.get("top") is not None:
            out += word_issues(line["top"], f"lines[{i}].top.")
    return out


def texts(n):
    rng = random.Random(7)

    def word():
        w = {"n": rng.choice([1, 2, 3, None])}
        return w | ({"marks": [rng.choice([1, 4, 5]) for _ in range(rng.randrange(3))]} if rng.random() < 0.6 else {})

    def line():
        return {"words": [word() for _ in range(rng.randrange(4))]} | ({"top": word()} if rng.random() < 0.5 else {})

    return [{"k": rng.choice([1, 2]), "lines": [line() for _ in range(rng.randrange(4))]} for _ in range(n)]


SCHEMA = "k long, lines array<struct<words:array<struct<n:long,marks:array<long>>>,top:struct<n:long,marks:array<long>>>>"


@pytest.mark.parametrize("form", ["typed", "text", "variant", "struct"])
def test_arrays_of_arrays_of_records(spark, form):
    made = texts(60)
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(made)], "id int, doc string").repartition(3)
    document = "doc"
    if form == "typed":
        df, document = df.select("id", F.from_json("doc", SCHEMA).alias("d")).select("id", "d.*"), None
    elif form == "struct":
        df = df.withColumn("doc", F.from_json("doc", SCHEMA))
    elif form == "variant":
        df = df.withColumn("doc", F.parse_json("doc"))
    got = {x.id: [(i.path, i.code) for i in x.issues] for x in sealed(Text).check(df, Text, document=document).collect()}
    assert got == {i: text_issues(t) for i, t in enumerate(made)}
    first = {x.id: [(i.path, i.code) for i in x.issues] for x in sealed(Text, stop_at_first_error=True).check(df, Text, document=document).collect()}
    assert first == {i: text_issues(t)[:1] for i, t in enumerate(made)}


def test_one_python_step_and_no_shuffle(spark, capsys):
    df = spark.createDataFrame([], SCHEMA)
    sealed(Text).check(df, Text).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython (") <= 3 and "Exchange" not in plan
    assert sealed(Text).check(df, Text).count() == 0


def test_null_records_wrong_types_and_clashing_columns(spark):
    docs = ['{"k":1,"lines":[{"words":[null,{"n":2}]},{"words":"x"}]}', '{"k":1,"lines":null}', '{"k":1,"lines":{}}', "[]", None, '{"k":3,"lines":[]} x', '{"k":3,"lines":[]}']
    df = spark.createDataFrame([*enumerate(docs)], "value int, doc string")
    df = df.withColumn("issues_", F.lit(1)).withColumn("p0", F.lit("clash"))
    got = {x.value: [(i.path, i.code) for i in x.issues] for x in sealed(Text).check(df, Text, document="doc").collect()}
    assert got[0] == [("lines[0].words[0].", "invalidInput"), ("lines[0].words[1].n", "odd"), ("lines[1].words", "isArray")]
    assert got[1] == [("lines", "isDefined")] and got[2] == [("lines", "isArray")] or got[2] == [("lines", "few"), ("lines", "isArray")]
    assert got[3] == got[4] == got[5] == [("", "invalidInput")] and got[6] == []


class Small:
    kind = field(r.is_string)
    n = field(odd)


class Big:
    kind = field(r.is_string)
    m = field(few)


class Held:
    by_key = field(type=dict, map_value=Word)
    counts = field(array_of(odd), type=dict)
    own = field(type=set, set_value=Word)
    any_of = field(type=[object], discriminator=union("kind", s=Small, b=Big), keep_discriminator_property=True)


def test_maps_sets_and_unions(spark):
    doc = {
        "by_key": {"a": {"n": 1}, "b": {"n": 2, "marks": [1, 2]}},
        "counts": {"x": 1, "y": 2},
        "own": [{"n": 4}, {"n": 5}],
        "any_of": [{"kind": "s", "n": 1}, {"kind": "b", "m": [1, 2, 3]}, {"kind": "s", "n": 2}, {"kind": "b", "m": "ab"}],
    }
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    got = [(i.path, i.code) for i in sealed(Held).check(df, Held, document="doc").first().issues]
    assert got == [("by_key[b].n", "odd"), ("by_key[b].marks[1]", "odd"), ("counts[1]", "odd"), ("own[0].n", "odd"), ("any_of[1].m", "few"), ("any_of[2].n", "odd")]


def test_groups_and_values(spark):
    class Leaf:
        n = field(odd, groups=["admin"])
        s = field(r.is_string)

    class Root:
        leaves = field(type=[Leaf])

    df = spark.createDataFrame([([(2, "a")],), ([(1, "b")],), ([],), (None,)], "leaves array<struct<n:long,s:string>>")
    engine = sealed(Root)
    assert sorted(len(x.issues) for x in engine.check(df, Root).collect()) == [0, 0, 0, 1]
    got = engine.decode(df, Root, groups=["admin"]).collect()
    assert [len(x.issues) for x in got] == [1, 0, 0, 1]
    assert got[1].value.leaves[0].asDict() == {"n": 1, "s": "b"}


def test_what_a_rule_sees(spark):
    """Records as dicts, nulls as None, times without a zone, whatever holds them."""
    from datetime import datetime

    seen = "[{'t': datetime.datetime(2024, 5, 1, 12, 0), 'm': [1, None], 's': None}, None]"

    class Leaf:
        held = field(r.create_rule("asSeen", python=lambda x: repr(x) == seen))

    class Root:
        leaves = field(type=[Leaf])

    row = [(datetime(2024, 5, 1, 12), [1, None], None), None]
    df = spark.createDataFrame([([(row,), (row[:1],)],)], "leaves array<struct<held:array<struct<t:timestamp,m:array<int>,s:string>>>>")
    assert [(i.path, i.code) for i in sealed(Root).check(df, Root).first().issues] == [("leaves[1].held", "asSeen")]
