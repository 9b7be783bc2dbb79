import hashlib
import math
import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm.chat_windows import TURN_TOKENS, chat_windows, read_back
from lodestar.llm.decontaminate import PUNCT, decontaminate, leaks, masks_of
from lodestar.llm.language_id import language_id, word_counts, words_in
from lodestar.llm.quality import CONTENT, CoTrained, Logistic, _first, _one_hot, _sure, quality

from .conftest import odd_rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    n, right = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right / n > 0.97
    low, high = found.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low and high <= 1


def test_language_of_odd_rows(odd, none):
    got = language_id(odd, F.lit(True)).collect()
    assert len(got) == len(odd_rows())
    langs = {r.lang_pred for r in got}
    assert langs <= {"en", "fr", "und"}
    letterless = sorted(str(r[0]) for r in odd_rows() if not any(c.isalpha() for c in r[1] or ""))
    assert sorted(str(r.doc_id) for r in got if r.lang_pred == "und") == letterless
    assert language_id(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id(odd, F.lit(False)).collect()} == {"und"}


def words_of(text):
    """Runs of letters, lower case."""
    return [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ") if w]


def test_words_are_runs_of_letters():
    texts = ["One two-three", None, "", "x²y ½ a_b ٣ Ⅷ İi", "\u0301e\u0301 日本\n語", "\U00010400A!", "don't"]
    spans = words_in(texts)
    words, edges = spans.words(np.arange(len(spans.first))), [0, *spans.docs.tolist()]
    assert [words[a:b] for a, b in zip(edges, edges[1:])] == [words_of(t) for t in texts]
    assert len(words_in([]).docs) == 0


def test_word_counts_in_small_tables(odd):
    rows = odd.where("lang is not null and text is not null").select("text", "lang").collect()
    want = Counter((r.lang, w) for r in rows for w in words_of(r.text))
    for most in (3, 400_000):
        got = word_counts(odd.where("lang is not null").select("text", "lang"), most).collect()
        assert {(r.lang, r.word): r.n for r in got} == want


def brute_language(train, texts):
    """Word-first backoff said plainly: (language, score) of each text."""
    langs = sorted({lang for t, lang in train if words_of(t)})
    words = {g: Counter(w for t, x in train if x == g for w in words_of(t)) for g in langs}
    grams = {g: Counter(s[i : i + k] for w in words[g] for s in [f"\x02{w}\x03"] for k in range(1, 6) for i in range(len(s) - k + 1)) for g in langs}

    def freq(table, g, key, same):
        of = [n for x, n in table[g].items() if same(x)]
        return math.log(table[g][key] + 0.5) - math.log(sum(of) + 0.5 * len(of) + 1)

    def word(w, g):
        if any(w in words[x] for x in langs):
            return freq(words, g, w, lambda x: True)
        s, out = f"\x02{w}\x03", []
        for e in range(2, len(s) + 1):
            for k in range(min(5, e), 0, -1):
                gram = s[e - k : e]
                if any(gram in grams[x] for x in langs):
                    out.append(freq(grams, g, gram, lambda x: len(x) == k) + (5 - k) * math.log(0.4))  # noqa: B023
                    break
            else:
                out.append(5 * math.log(0.4) - 10)
        return sum(out) / len(out)

    found = []
    for t in texts:
        total = {g: sum(word(w, g) for w in words_of(t)) for g in langs}
        if not words_of(t) or not langs:
            found.append(("und", 0.0))
            continue
        top = max(total.values())
        found.append((min(g for g in langs if total[g] == top), 1 / sum(math.exp(x - top) for x in total.values())))
    return found


@pytest.mark.parametrize("capacity", [0, 30, 1_000_000])
def test_language_against_brute_force(spark, capacity):
    """Known, half-known and unknown words; the cache changes no score."""
    rnd = random.Random(7)
    al = {"en": "abcdefgh", "fr": "éèàbcdij", "zz": "ζηθabcxy"}
    say = lambda x, n: " ".join("".join(rnd.choice(al[x]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, say(x, rnd.randint(1, 12)), x) for i, x in enumerate(rnd.choices(list(al), k=40))]
    rows += [(50 + i, t, "en") for i, t in enumerate([None, "", "12 !", "Q" * 40, "Abc abc ABC abc", "日本 éèqq", "\U00010400a"])]
    rows += [(99, "abc", None), (99, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(language_id(docs, F.col("doc_id") % 3 != 1, capacity=capacity).collect(), key=lambda r: r.doc_id)
    want = brute_language([(t, x) for i, t, x in rows if i % 3 != 1 and x], [t for _, t, _ in sorted(rows, key=lambda r: r[0])])
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert np.allclose([r.score for r in got], [w[1] for w in want])


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x @ [2, -1, 0] + 0.5 > 0).astype(float)
    assert ((Logistic().fit(x, y).logit(x) > 0) == (y > 0)).mean() > 0.97


@needs_data
def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = quality(docs, labels)
    assert found.count() == docs.count()
    seen = found.select("row.doc_id", "keep", "score").join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in seen) / len(seen) > 0.9


@needs_data
def test_quality_held_out(spark):
    """Fitted on half of the labels; the other half is never shown, and each view and their mix do better than the share of the larger class."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    shown = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = quality(docs, labels.where(shown)).select("row.doc_id", "keep", "score", "content_score", "metadata_score").join(labels.where(~shown), "doc_id").collect()
    right = lambda of: sum((of(r) >= 0.5) == (r.quality == 1) for r in found) / len(found)
    larger = max(sum(r.quality == v for r in found) for v in (0, 1)) / len(found)
    assert len(found) > 50 and right(lambda r: r.score) > max(0.95, larger)
    assert right(lambda r: r.content_score) > 0.95 and right(lambda r: r.metadata_score) >= larger - 0.1


def made_up(n, seed):
    """Good and bad texts of one style, told apart by their words and, mostly, by their source."""
    rnd = random.Random(seed)
    words = {y: ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(200)] for y in (0, 1)}
    rows = []
    for i in range(n):
        y = rnd.randrange(2)
        text = " ".join(rnd.choice(words[y if rnd.random() < 0.8 else 1 - y]) for _ in range(rnd.randint(20, 60)))
        rows.append((i, text, "en", f"s{y if rnd.random() < 0.9 else 1 - y}", len(text), y))
    return rows


def test_quality_learns_words_and_calibrates(spark):
    rows = made_up(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, y int")
    labels = docs.where("doc_id < 400").select("doc_id", F.col("y").alias("quality"))
    found = [r for r in quality(docs, labels, confidence=0.8).select("row.doc_id", "row.y", "score", "content_score", "metadata_score").collect() if r.doc_id >= 400]
    assert sum((r.content_score >= 0.5) == r.y for r in found) / len(found) > 0.92
    assert sum((r.score >= 0.5) == r.y for r in found) / len(found) > 0.92
    # calibrated: of the documents that the metadata view gives p, about a share of p is good
    for lo, hi in ((0.0, 0.3), (0.7, 1.0)):
        some = [r for r in found if lo <= r.metadata_score <= hi]
        assert abs(np.mean([r.y for r in some]) - np.mean([r.metadata_score for r in some])) < 0.15


def test_the_first_labelled_rows(spark):
    """The cut by the hash gives the same rows as sorting all, for any number of them."""
    rows = spark.range(9000).select("id", F.xxhash64("id").alias("order"), F.col("id").alias("same"))
    for most in (1, 500, 8999, 9000, 20_000):
        assert [r.id for r in _first(rows, most).collect()] == [r.id for r in rows.orderBy("order").limit(most).collect()]


def test_pseudo_labels_are_distinct_and_new():
    """Of equal rows one is offered, the surest come first, and what was given is not given again."""
    rng = np.random.default_rng(3)
    y = np.arange(60) % 2
    content, meta = rng.normal(size=(60, CONTENT)) + y[:, None], np.column_stack([y, y + 2, y + 4])
    model = CoTrained(Logistic().fit(content, y), Logistic().fit(_one_hot(meta), y))
    same = np.arange(60) // 2 * 2 + y  # pairs of equal features have equal keys
    content, meta = content[same], meta[same]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(same), pa.array(content.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array(meta.tolist(), pa.list_(pa.int32()))], names=["order", "same", "content", "meta"])

    class Sent:
        value = (model, [np.array([1, 3]), np.array([], np.int64)])

    got = pa.Table.from_batches(_sure(Sent, 0.6, 5)([batch.slice(0, 30), batch.slice(30)])).to_pylist()
    scores = model.views(content, meta)
    for view in (0, 1):
        for label in (0, 1):
            mine = [r for r in got if (r["view"], r["label"]) == (view, label)]
            z = {int(k): float(s if label else -s) for k, s in zip(same, scores[view]) if k not in Sent.value[1][view]}
            want = sorted((k for k, s in z.items() if s >= np.log(1.5)), key=lambda k: -z[k])[:5]
            assert len(mine) == len({r["same"] for r in mine}) == len(want)
            if view == 0:
                assert {r["same"] for r in mine} == set(want)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(r[0], i % 2, "x") for i, r in enumerate(odd_rows()) if r[0]] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, keep string")
    got = quality(odd, labels, max_labels=20, per_round=0.2, confidence=0.6)
    assert got.select("row.*").columns == odd.columns
    assert got.count() == len(odd_rows()) and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality(none, labels).count() == 0
    unlabelled = quality(odd, labels.where("false")).select("keep").distinct().collect()
    assert [r.keep for r in unlabelled] == [True]


def tokens(t):
    return [x for w in (t or "").lower().split() if (x := w.strip(PUNCT))]


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        x = tokens(t)
        for i, u in items:
            w = tokens(u)
            if not w:
                continue
            best = max(((sum(0 <= p + k < len(x) and x[p + k] == w[k] for k in range(len(w))), -p) for p in range(-len(w), len(x) + 1)), default=(0, 0))
            if best[0] >= 0.8 * len(w):
                out[d, i] = (best[0], len(w))
    return out


def test_leaks(spark, odd, none):
    rnd = random.Random(2)
    vocab = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 5, 7, 10, 11, 14, 30, 60, 200])] + [(90, None), (91, ""), (92, " -- !"), (None, "u v w x y z")]
    docs = []
    for i, t in items:
        if not t:
            continue
        w = t.split()
        filler = lambda: [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        docs.append((len(docs), " ".join([*filler(), *w, *filler()])))
        docs.append((len(docs), " ".join([*filler(), *(x.upper() + "," for x in w), *filler()])))
        swapped = list(w)
        for k in range(4, len(w), 12):
            swapped[k] = "swap"
        docs.append((len(docs), " ".join([*filler(), *swapped, *filler()])))
        docs.append((len(docs), " ".join([*filler(), *w[: len(w) // 2], *filler()])))
    docs += [(None, items[6][1]), (None, "a clean text"), (None, None), (3, "another text under an id that has a leak")]
    docs.append((0, docs[0][1]))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = leaks(frame, bench).collect()
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in got} == want and len(got) == len(want)
    clean = [(d, t) for d, t in docs if not brute_leaks([(d, t)], items)]
    assert sorted(map(str, map(tuple, decontaminate(frame, bench).collect()))) == sorted(map(str, clean))
    assert (None, "a clean text") in clean and any(d is None and t == items[6][1] for d, t in docs)
    assert leaks(none, bench).count() == 0 and leaks(frame, bench.where("false")).count() == 0
    assert decontaminate(odd, bench).columns == odd.columns


def test_leaks_of_random_substitutions(spark):
    """As many words substituted as the similarity permits, one more too, at random places of items of all lengths."""
    rnd = random.Random(8)
    vocab = [f"t{i}" for i in range(3000)]
    items = [(n, " ".join(rnd.choice(vocab) for _ in range(n))) for n in [*range(5, 41), 59, 60, 61, 150]]
    docs = []
    for n, t in items:
        for k in [n // 5] * 8 + [n // 5 + 1] * 2:
            w = t.split()
            for i in rnd.sample(range(n), k):
                w[i] = f"swap{rnd.randrange(1000)}"
            docs.append((len(docs), " ".join([rnd.choice(vocab) for _ in range(rnd.randint(0, 20))] + w + [rnd.choice(vocab)])))
    w = items[6][1].split()  # 11 words, the one at position 5 changed
    docs.append((len(docs), " ".join([*w[:5], "other", *w[6:]])))
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert len(want) == 8 * len(items) + 1
    assert {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in found} == want


def test_masks_cover_all_substitutions():
    """Every choice of places that the similarity lets differ spares a mask: all of them up to 20 words, by the number of blocks beyond."""
    for n in range(1, 21):
        free = n - -(-4 * n // 5)
        masks = [{at + i for i, c in enumerate(m) if c == "1"} for at, m in masks_of(n, 0.8)]
        assert all(any(not m & set(gone) for m in masks) for gone in combinations(range(n), free))
    for n in range(21, 200):
        masks = masks_of(n, 0.8)
        assert len(masks) > n - -(-4 * n // 5) and "".join(m for _, m in masks) == "1" * n


def conversations():
    rnd = random.Random(4)
    rows = []
    for c in range(12):
        roles = (["system"] if c % 3 == 0 else []) + [r for _ in range(rnd.randint(0, 20)) for r in ("user", "assistant")]
        rows += [(c, t, r, "".join(rnd.choice(["ok ", "</s>", "<s>", "[INST]", "\\", "\\1", "\n", "é", "word "]) for _ in range(rnd.randint(0, 60))), "x") for t, r in enumerate(roles)]
    rows += [(20, 0, None, "a", "x"), (20, 1, "assistant", None, "x"), (20, 1, "assistant", None, "x"), (None, 0, "user", "n", "x"), (None, None, "assistant", "first", None), (21, 0, "system", "alone", "x"), (22, 5, "ro\nle<s>", "b", "x"), (23, 0, "assistant", "y" * 9000, "x")]
    rnd.shuffle(rows)
    return rows


def test_chat(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(3)
    windows = chat_windows(frame, budget=120, history=40)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        under = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    assert got[0].formatted_chars == sum(len(r.formatted) for r in windows.where("conv_id = 0").collect())


def test_chat_budget(spark):
    turns = [(1, 0, "system", "s" * 40)] + [(1, t, "user" if t % 2 else "assistant", "w" * (4 * t)) for t in range(1, 30)]
    windows = chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=150, history=50).orderBy("window").collect()
    cost = lambda seg: -(-len(seg.partition("\n")[2]) // 4) + TURN_TOKENS
    assert len(windows) > 3
    for w in windows:
        segs = w.formatted.split("</s>")[:-1]
        assert segs[0].startswith("<s>system\n")
        new = segs[w.n_repeated :]
        assert sum(map(cost, segs)) <= 150 or len(new) == 1
        assert len(w.loss) == sum(s.startswith("<s>assistant") for s in new)
    assert any(w.n_repeated > 1 for w in windows)


def test_chat_is_native(spark):
    frame = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string, window string")
    plan = read_back(chat_windows(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert read_back(chat_windows(frame.where("false"))).count() == 0
