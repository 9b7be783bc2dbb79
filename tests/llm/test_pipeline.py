import os
from collections import Counter

import pytest

from .test_dedup import counts, plain_chunks

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    """Each stage against plain rules over what it was given."""
    import corpus_pipeline as p
    from lodestar.llm.shared import Scratch

    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pieces"]
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in p.STAGES:
        steps.append(scratch.write(stage(spark, steps[-1], DATA), name))
    for s in steps[:-1]:
        assert s.columns == columns
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert sum(labels[i] == 0 for i in gone if i in labels) >= 0.8 * sum(i in gone for i in labels)
    seen = set()
    for i in sorted(rows[1]):
        keep = []
        for c in plain_chunks(rows[1][i].text):
            if counts(c) and c in seen:
                continue
            seen.add(c)
            keep.append(c)
        assert rows[2][i].text == "\n".join(keep)
    assert set(rows[3]) <= set(rows[2]) and set(rows[4]) <= set(rows[3]) and set(rows[5]) == set(rows[4])
    texts = {}
    for i in sorted(rows[2]):
        texts.setdefault(rows[2][i].text.lower(), i)
    assert all(texts[rows[2][i].text.lower()] == i for i in rows[3])  # of equal texts only the first is left


def test_run(spark):
    import corpus_pipeline as p

    out = p.run(spark, DATA)
    assert out.columns == ["doc_id", "ids"] and out.count() > 50


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key int, row string, removed_lines_0 long"


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows, a repeated id; names that the stages use themselves."""
    long = "\n".join(f"line {i} of a very long text with some words more" for i in range(4000))
    texts = [None, "", "  ", "\n\n", "one", "a b c d e f g h", "Tie", "tie", long, long, "x" * 50_000, "é " * 40]
    rows = [(i, t, "en", "s", len(t or ""), i, "r", 5) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (5, "another text under the same id, of its own words", "fr", None, None, None, None, None), (None, "a b c d e f g h", None, None, None, None, None, None), (None,) * 8]


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontaminate", "pieces"])
def test_stages_of_odd_documents(spark, name):
    import corpus_pipeline as p

    stage = dict(p.STAGES)[name]
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    found = stage(spark, docs, DATA)
    assert found.columns == (["doc_id", "ids"] if name == "pieces" else docs.columns)
    got = [tuple(r) for r in found.collect()]
    given = Counter(rows)
    if name == "pieces":
        assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(not r[1] for r in got if r[0] in (0, 1))
    elif name == "line_dedup":
        rest = lambda rs: Counter((r[0], *r[2:4], *r[5:]) for r in rs)
        assert rest(got) == rest(rows) and sum(r[1] is None for r in got) == sum(r[1] is None for r in rows)
        assert all(r[4] == len(r[1]) for r in got if r[0] in (8, 9))
    elif name == "near_dedup":
        assert not Counter(got) - given
        assert sorted((r[0], (r[1] or "")[:8]) for r in got) == [(0, ""), (4, "one"), (5, "a b c d "), (5, "another "), (6, "Tie"), (8, "line 0 o"), (10, "x" * 8), (11, "é é é é ")]
    elif name == "decontaminate":
        assert Counter(got) == given
    else:
        assert not Counter(got) - given
        assert all(c in (0, given[r]) for r, c in Counter(got).items())  # equal rows are judged alike
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_run_leaves_only_its_own_tables(spark):
    import corpus_pipeline as p
    from lodestar.llm.shared import Scratch

    before = len(Scratch.made)
    p.run(spark, DATA)
    assert len(Scratch.made) == before + 1
