import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.errors import ParseError, Unsupported
from lodestar.plans.filters import And, Compare, Filter

SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-(1 << 40), 1 << 40), st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), st.text("ab\"\\\n\t\ré ", max_size=4))
NAMES = st.sampled_from(["a", "b", "price", "_x1"])
OPS = ["=", "!=", "<", ">", "<=", ">="]

DOCS = [
    "{}", '{"a":null}', '{"a":1}', '{"a":1.0}', '{"a":"1"}', '{"a":true}', '{"a":"true"}', '{"a":[1,2]}', '{"a":{"b":1}}', "[1]", "1", "null", '"a"',
    '{"a":18446744073709551615}', '{"a":9007199254740993}', '{"a":1,"a":2}', '{"a":-0.0}', '{"a":1e3}', '{"a":""}', '{"b":1}', '{"a":false}', '{"a":2.5}',
]
LITERALS = [None, True, False, 0, 1, 2, 1.0, 2.5, 1000, "1", "true", "", "x", 9007199254740993]


@pytest.mark.parametrize(
    "text,tree",
    [
        ("a = 1", Compare("a", "=", 1)),
        ('a="x y"', Compare("a", "=", "x y")),
        ("a != null", Compare("a", "!=", None)),
        ("a<=-2.5", Compare("a", "<=", -2.5)),
        ("a >= 5.", Compare("a", ">=", 5)),
        ("a > -.5", Compare("a", ">", -0.5)),
        ("a < 1 AND b = true and c = false And d = 2", And((Compare("a", "<", 1), Compare("b", "=", True), Compare("c", "=", False), Compare("d", "=", 2)))),
        (r'a = "q\"\\\n\t\r"', Compare("a", "=", 'q"\\\n\t\r')),
    ],
)
def test_parse(text, tree):
    assert Filter.parse(text) == tree
    assert isinstance(getattr(tree, "value", 0), type(getattr(Filter.parse(text), "value", 0)))


@pytest.mark.parametrize(
    "text", ["", "a", "a =", "= 1", "a = 1 b", "a = 1 5", "a < 1e5", 'a = "oops', 'a = 1 "oops', "a ! 1", "a == 1", "a <> 1", "a = .5", "a = -", "a.b = 1", "a = 1 AND", "AND a = 1", "a = 1 OR b = 2", "(a = 1)", r'a = "\x"', "true = 1", "a = " + "9" * 400, "a = 1.2.3"]
)
def test_parse_errors(text):
    with pytest.raises(ParseError):
        Filter.parse(text)


@given(st.lists(st.builds(Compare, NAMES, st.sampled_from(OPS), SCALARS), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_print_and_parse(terms):
    tree = terms[0] if len(terms) == 1 else And(tuple(terms))
    back = Filter.parse(str(tree))
    docs = [{n: v for n, v in zip("ab", pair)} for pair in ((t.value, t.value) for t in terms)]
    assert [tree.matches(d) for d in docs] == [back.matches(d) for d in docs]


def test_compiler_against_model(spark):
    """Every document with every operator and literal."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = spark.createDataFrame(list(enumerate(DOCS)), "n int, metadata string").withColumn("v", F.parse_json("metadata")).cache()
    cases = [Compare("a", op, x) for op in OPS for x in LITERALS]
    got = rows.select("n", *[c.column(F.col("v")).alias(f"c{k}") for k, c in enumerate(cases)]).orderBy("n").collect()
    for r, text in zip(got, DOCS):
        for k, c in enumerate(cases):
            assert r[f"c{k}"] == c.matches(json.loads(text)), (text, str(c))


def test_random_documents_against_model(spark):
    rnd = random.Random(1)
    value = lambda: rnd.choice([None, True, False, rnd.randint(-5, 5), rnd.random() * 4, "x", str(rnd.randint(0, 3))])
    docs = [{k: value() for k in rnd.sample(["a", "b", "c"], rnd.randint(0, 3))} for _ in range(100)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "n int, metadata string").withColumn("v", F.parse_json("metadata"))
    trees = [Filter.all_of(*(Compare(rnd.choice("abc"), rnd.choice(OPS), value()) for _ in range(rnd.randint(0, 2)))) for _ in range(30)]
    got = rows.select("n", *[t.column(F.col("v")).alias(f"c{k}") for k, t in enumerate(trees)]).collect()
    for r in got:
        assert [r[f"c{k}"] for k in range(len(trees))] == [t.matches(docs[r["n"]]) for t in trees]


def test_deep_equality(spark):
    docs = ['{"a":[1,2]}', '{"a":[1.0,2]}', '{"a":[2,1]}', '{"a":{"x":[]}}', "{}", "3"]
    rows = spark.createDataFrame([(d,) for d in docs], "metadata string").withColumn("v", F.parse_json("metadata"))
    keep = lambda f: [r[0] for r in rows.where(f.column(F.col("v"), F.col("metadata"))).collect()]
    assert keep(Filter.eq("a", [1, 2])) == docs[:1]
    assert keep(Filter.ne("a", [1, 2])) == docs[1:4]
    assert keep(Filter.eq("a", {"x": []})) == docs[3:4]
    with pytest.raises(Unsupported):
        Filter.eq("a", []).column(F.col("v"))


def test_odd_field_names(spark):
    rows = spark.createDataFrame([('{"a b":1,"c.d":2}',)], "metadata string").withColumn("v", F.parse_json("metadata"))
    assert rows.where(Filter.eq("a b", 1).column(F.col("v"))).count() == 1
    assert rows.where(Filter.eq("c.d", 2).column(F.col("v"))).count() == 1
    with pytest.raises(Unsupported):
        Filter.eq("'\"", 1).column(F.col("v"))
