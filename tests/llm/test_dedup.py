import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestar.llm.components import components
from lodestar.llm.exact_dedup import directory, exact_dedup
from lodestar.llm.line_dedup import chunks, line_dedup
from lodestar.llm.shared import Scratch
from lodestar.llm.simhash import _met, bits, links, masks, near_dedup, shingle_set, similar, simhash, sketch_of, verified, words_of

from .conftest import odd_rows


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("window", [1, 1 << 20])
def test_exact(odd, window):
    got = exact_dedup(odd, window_bytes=window, bucket_bytes=200).collect()
    groups = {}
    for r in odd_rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((r[0], top[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in odd_rows())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)  # one of each group, of repeated rows too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_texts_of_many_windows(spark, hot):
    """A text in every window is compared by several owners first; classes are the same, for lines too."""
    same, lines = "Hot Text", "one line\nand another\nand a third"
    rows = [(i, same if i % 3 else f"text {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup(docs, window_bytes=1, hot=hot).collect()
    of = {}
    for i, t in rows:
        of.setdefault(norm(t), []).append(i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, max(g), len(g), i == max(g)) for g in of.values() for i in g}
    docs = spark.createDataFrame([(i, lines) for i in range(40)], "doc_id long, text string").repartition(5)
    assert sorted(r.text for r in line_dedup(docs, window_bytes=1, hot=hot).collect()) == [""] * 39 + [lines]


def test_directory_of_larger_data(monkeypatch, odd):
    """The directory stays bounded; its buckets grow instead."""
    monkeypatch.setattr("lodestar.llm.exact_dedup.MAX_DEPTH", 2)
    assert exact_dedup(odd, bucket_bytes=1).count() == len(odd_rows())


def test_exact_collisions():
    """With a hash that always collides only the bytes decide."""
    from lodestar.llm import exact_dedup as m

    rows = {"gid": [1, 2, 3, 4], "h": [7, 7, 7, 7], "n": [1, 1, 2, 1], "top": [1, 9, 5, 9], "body": [b"a", b"b", b"a", b"b"]}
    out = pa.Table.from_batches(m._owners([pa.RecordBatch.from_pydict(rows)])).to_pylist()
    assert {(r["gid"], r["keep_id"], r["keep_gid"], r["group_size"]) for r in out} == {(1, 5, 3, 3), (3, 5, 3, 3), (2, 9, 2, 2), (4, 9, 2, 2)}


def test_directory_doubles():
    assert directory([], 4, 10) == (0, [0])
    depth, slots = directory([(0, 8), (1, 8), (15, 3)], 4, 10)
    assert depth == 4 and slots[0] != slots[1] and slots[8:] == [slots[8]] * 8
    assert directory([(3, 100)], 4, 10)[0] == 4  # one prefix can't split further


def test_empty_tables(spark, none):
    assert exact_dedup(none).count() == 0
    assert simhash(none).count() == 0
    assert near_dedup(none).count() == 0
    assert line_dedup(none).columns == none.columns and line_dedup(none).count() == 0


def brute_fingerprint(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", norm(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for r in odd_rows():
        for k in (1, 4):
            assert bits(words_of(r[1]), k)[0] & (1 << 64) - 1 == brute_fingerprint(r[1], k)


@pytest.mark.parametrize("family", [0, 1, 5])
def test_masks_cover(family):
    """Any difference of up to the radius misses some mask altogether."""
    rng = np.random.default_rng(family)
    ms = masks(4, family)
    assert len(ms) == 31
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(m & diff == 0 for m in ms)
    assert all(m.bit_count() >= 30 for m in ms)


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("limit", [20_000, 3])
def test_links_against_brute_force(spark, limit):
    """Chains and balls of near fingerprints; a tiny limit sends buckets through more families."""
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            fps.append(x)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
    fps = list(dict.fromkeys(fps))
    rows = [(f - (1 << 64) if f >> 63 else f, i, 0, 0, 0, 0) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp long, rep long, s0 long, s1 long, s2 long, s3 long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in components(links(nodes, 4, scratch, limit=limit), scratch).collect()}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == want


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_met_keys(size):
    """Rows that share their key, however the batches fall."""
    rng = np.random.default_rng(size)
    key = np.sort(rng.integers(0, 120, 150))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(range(150), pa.int64())], names=["key", "rep"])
    got = [tuple(r.values()) for b in _met(rows.slice(k, size) for k in range(0, 150, size)) for r in b.to_pylist()]
    assert got == [(k, i) for i, k in enumerate(key.tolist()) if (key == k).sum() > 1]
    assert list(_met([])) == []


def test_links_of_one_fingerprint(spark):
    """More nodes of one fingerprint, or of near ones, than a bucket may hold: only the sketches tell them apart."""
    rng = np.random.default_rng(6)
    sks = []
    for _ in range(15):
        x = int.from_bytes(rng.bytes(32), "little")
        for _ in range(12):
            sks.append(x)
            for b in rng.choice(256, rng.integers(20, 70), replace=False):
                x ^= 1 << int(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [7 ^ (1 << i % 5 if i % 3 == 0 else 0) for i in range(len(sks))]
    rows = [(f, i, *(signed(s >> 64 * k & (1 << 64) - 1) for k in range(4))) for i, (f, s) in enumerate(zip(fps, sks))]
    nodes = spark.createDataFrame(rows, "fp long, rep long, s0 long, s1 long, s2 long, s3 long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in components(links(nodes, 5, scratch, 48, limit=40), scratch).collect()}
    want = roots(len(sks), [(i, j) for i in range(len(sks)) for j in range(i) if (sks[i] ^ sks[j]).bit_count() <= 48 and (fps[i] ^ fps[j]).bit_count() <= 5])
    assert [got.get(i, i) for i in range(len(sks))] == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(500, 700)] + [(3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 700)} == {7} and 3 not in got


def test_simhash_rows(odd):
    rows = odd_rows()
    fps = sorted({(brute_fingerprint(r[1], 4), r[0]) for r in rows if r[0] is not None}, key=lambda x: x[1])
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i][0] ^ fps[j][0]).bit_count() <= 4])
    component = {fps[i][1]: fps[w][1] for i, w in enumerate(want)}
    got = simhash(odd).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == component.get(r.doc_id) for r in got)


def test_near_dedup_keeps_one(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150", "other")
    other = " ".join(f"term{i}" for i in range(300))
    docs = spark.createDataFrame([(5, base), (2, near), (9, other), (None, base)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == [2, 9]
    nameless = docs.where("doc_id is null or doc_id = 9").union(docs.where("doc_id is null"))
    assert sorted(str(r.doc_id) for r in near_dedup(nameless).collect()) == ["9", "None"]


def test_near_dedup_goes_by_row(spark):
    """A text under a repeated id is not lost with its namesakes, and exact repeats of a row go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    docs = spark.createDataFrame([(3, a, "x"), (5, a, "x"), (5, b, "y"), (9, c, "z"), (9, c, "z"), (11, None, None), (10, "", "e")], "doc_id long, text string, key string")
    got = near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(3, a, "x"), (5, b, "y"), (9, c, "z"), (10, "", "e")]


def test_near_dedup_of_odd_rows(odd):
    """Nulls, empty and long texts, ties, repeated rows, clashing names: equal texts leave one row, and every row left is one of the input."""
    before, after = [tuple(r) for r in odd.collect()], [tuple(r) for r in near_dedup(odd).collect()]
    assert not Counter(after) - Counter(before)
    assert len({norm(r[1]) for r in after}) == len(after)
    for t in {norm(r[1]) for r in before} & {norm(r[1]) for r in after}:
        ids = [r[0] for r in before if norm(r[1]) == t and r[0] is not None]
        assert [r[0] for r in after if norm(r[1]) == t] == [min(ids)] or len(words_of(t)) < 5 or len(words_of(t)) > 10


def test_similar_is_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 61), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    got = similar(sets, 0.8, columns=7)
    want = [[5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)) for b in map(np.ndarray.tolist, sets)] for a in map(np.ndarray.tolist, sets)]
    assert all(got[i, j] == want[i][j] for i in range(40) for j in range(40) if i != j) and 40 < sum(map(sum, want)) < 1600


@pytest.mark.parametrize("block", [1000, 3])
def test_torn_groups_meet_in_blocks(spark, block):
    """Near copies of one text, many of them below 0.8 of one another: no link between different parts is lost in any block."""
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 4)):
            w[k] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [set(shingle_set(words_of(t), 5).tolist()) for t in texts]
    same = [(i, j) for i in range(40) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    sks = [sketch_of(shingle_set(words_of(t), 5)) for t in texts]
    scratch = Scratch(spark, "t")
    rows = scratch.write(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "rows")
    nodes = scratch.write(spark.createDataFrame([(0, i, *sks[i]) for i in range(40)], "fp long, rep long, s0 long, s1 long, s2 long, s3 long"), "nodes")
    edges = verified(rows, nodes, 2, 256, 5, 0.8, scratch, block=block)
    found = [tuple(r) for r in edges.collect()]
    assert all((max(e), min(e)) in same for e in found)
    want, got = roots(40, same), roots(40, found)
    assert got == want and len(set(want)) > 1


def test_near_dedup_recall(spark):
    """Words replaced at random, around a similarity of 0.8 and above: at least nine in ten pairs are found, none below."""
    rnd = random.Random(9)
    rows, want = [], set()
    for k in range(150):
        w = [f"v{rnd.randrange(20_000)}" for _ in range(rnd.randint(60, 400))]
        v = list(w)
        for i in rnd.sample(range(len(w)), max(1, len(w) * rnd.randint(1, 4) // 200)):
            v[i] = f"n{rnd.randrange(10**6)}"
        a, b = (set(shingle_set([x.encode() for x in t], 5).tolist()) for t in (w, v))
        if 5 * len(a & b) >= 4 * len(a | b):
            want.add(2 * k + 1)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    left = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - left
    assert gone <= want and len(gone) >= 0.9 * len(want) > 60


def test_near_dedup_verifies(spark):
    """Sketches under the limit, similarity on both sides of 0.8: the sets of shingles decide, in chains and beside the forest too."""
    rnd = random.Random(3)
    texts = []
    for _ in range(8):
        w = [f"v{rnd.randrange(5000)}" for _ in range(250)]
        for _ in range(8):
            texts.append(" ".join(w))
            for k in rnd.sample(range(250), rnd.randint(2, 8)):
                w[k] = f"n{rnd.randrange(10**6)}"
    pipes = " ".join("|" * 400)
    texts += [pipes + " " + " ".join(f"p{i}x{j}" for j in range(120)) for i in range(6)]  # one fingerprint and much of a bag, other sets
    sets = [set(shingle_set(words_of(t), 5).tolist()) for t in texts]
    fps = [bits(words_of(t), 1)[0] & (1 << 64) - 1 for t in texts]
    sks = [sum((x & (1 << 64) - 1) << 64 * k for k, x in enumerate(sketch_of(shingle_set(words_of(t), 5)))) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 5 and (sks[i] ^ sks[j]).bit_count() <= 56]
    same = [len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in pairs]
    assert any(same) and not all(same)
    group = roots(len(texts), pairs)  # within a component of candidates every similar pair is a link
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == sorted(set(want))


def plain_chunks(text):
    """The rule of chunks, said again: lists of lines."""
    h = lambda x: xxhash.xxh64(x.encode()).intdigest()
    done, group, above = [], [], None
    for line in text.split("\n"):
        falls = ((0 if above is None else h(above)) * 0x9E3779B97F4A7C15 + h(line) * 0xC2B2AE3D27D4EB4F) % 2**64 // 2**32 % 2 == 0
        above = line
        if len(line.encode()) >= 96:
            done += [g for g in (group, [line]) if g]
            group = []
            continue
        group.append(line)
        if len(group) == 32 or len(group) > 1 and falls:
            done.append(group)
            group = []
    if len(group) == 1 and done and len(done[-1]) > 1:
        done[-1] = done[-1] + group
    elif group:
        done.append(group)
    return ["\n".join(g) for g in done]


def counts(chunk):
    """Is it removed where it repeats?"""
    return bool(chunk.strip(" \n\t\r\x0b\x0c")) and ("\n" in chunk or len(chunk.encode()) >= 96)


def test_chunks_shift():
    lines = [f"line {i} of the text" for i in range(60)]
    a, b = chunks("\n".join(lines).encode()), chunks("\n".join(["new", "two", *lines]).encode())
    assert b"\n".join(a).decode() == "\n".join(lines)
    assert len(set(a) & set(b)) >= len(a) - 3  # boundaries come back after the insertion
    assert all(c.count(b"\n") >= 1 for c in a)


def test_chunks_by_the_rule():
    rnd = random.Random(4)
    for _ in range(300):
        text = "\n".join("word " * rnd.choice([0, 1, 2, 3, 30]) + str(rnd.randrange(9)) * rnd.randint(0, 1) for _ in range(rnd.randint(1, 90)))
        assert [c.decode() for c in chunks(text.encode())] == plain_chunks(text)


def test_passages_of_over_fifty_words_go(spark):
    """Wherever they stand: in one long line, or in two; single short lines stay."""
    rnd = random.Random(6)
    say = lambda n: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))
    one, two = say(55), say(30) + "\n" + say(28)
    rows = [(i, "\n".join([say(5), "short line", p, "another short line", say(40)])) for i, p in enumerate([one, two] * 10)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [one in got[i] for i in range(0, 20, 2)] == [True] + [False] * 9
    assert [any(x in got[i] for x in two.split("\n")) for i in range(1, 20, 2)] == [True] + [False] * 9
    assert all(t.count("\n") >= 3 and "short line" in t for t in got.values())


def test_counted_name_is_free(odd):
    with pytest.raises(ValueError):
        line_dedup(odd, counted="gid")


@pytest.mark.parametrize("window", [1, 1 << 20])
def test_line_dedup(odd, window):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = line_dedup(docs, counted="gone", window_bytes=window)
    assert out.columns == [*docs.columns, "gone"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    seen, want = set(), {}
    for i in sorted(rows):
        if rows[i] is None:
            want[i] = (None, 0)
            continue
        keep, gone = [], 0
        for c in plain_chunks(rows[i]):
            if counts(c) and c in seen:
                gone += c.count("\n") + 1
            else:
                seen.add(c)
                keep.append(c)
        want[i] = ("\n".join(keep), gone)
    assert {r.doc_id: (r.text, r.gone) for r in out.collect()} == want
    assert any(w[1] for w in want.values())


def test_line_dedup_of_repeated_and_nameless_rows(odd):
    """Each text of a repeated chunk survives once, whatever the ids."""
    before, after = odd.collect(), line_dedup(odd).collect()
    assert len(before) == len(after)
    count = lambda rows: Counter(c for r in rows if r.text for c in plain_chunks(r.text) if counts(c))
    have = count(before)
    left = Counter(r.text for r in after)
    assert any(n > 1 for n in have.values()) and left[""] >= 1
