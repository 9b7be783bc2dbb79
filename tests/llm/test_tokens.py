import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import pieces
from lodestar.llm.pieces import decode, encode, vocabulary
from lodestar.llm.range_coder import decode as unpack
from lodestar.llm.range_coder import encode as pack
from lodestar.llm.token_counts import token_counts
from lodestar.llm.token_store import token_store, word_ids
from lodestar.llm.transducer import END, FRESH, Merger, Spans, classes, merger, prefix_scan, state_maps

from lodestar.llm.words import WordTable

from .conftest import odd_rows

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=SP)


ALPHABET = list("aaesstmdrvlL  \n\t''''!1½é中 ǅ_-\U0001f600") + ["<|endoftext|>", "ll", "re", "ve", "\r\n", "  "]


def texts(n, seed=5):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return made + [None, "", " ", "'", "'r", "a'l", "x\n's", "ab" * 900, "=" * 700, " " * 333 + "x", "　\x85\x1c a"]


def test_counts_as_the_library(bpe):
    t = texts(3000)
    want = [len(e.ids) for e in bpe.encode_batch([x or "" for x in t], add_special_tokens=False)]
    assert merger(BPE).counts(t).tolist() == want


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    tok = Tokenizer.from_file(BPE) if not hasattr(test_any_text, "tok") else test_any_text.tok
    test_any_text.tok = tok
    assert merger(BPE).counts([text])[0] == len(tok.encode(text, add_special_tokens=False).ids)


def test_small_limits_change_nothing(bpe):
    t, m = texts(200), Merger(BPE, max_states=50)
    m.table.most = 20
    got = [int(n) for k in range(0, len(t), 10) for n in m.counts(t[k : k + 10])]
    assert got == [len(e.ids) for e in bpe.encode_batch([x or "" for x in t], add_special_tokens=False)]


def test_scan_equals_one_pass():
    """State maps of chunks, composed by the scan, give the states of a plain run."""
    from lodestar.llm.transducer import NEXT

    code = classes()[[ord(c) for x in texts(50) if x for c in x if len(c) == 1]]
    code = code[: len(code) // 16 * 16]
    want, s = [], FRESH
    for i, c in enumerate(code):
        if i % 16 == 0:
            want.append(s)
        s = NEXT[int(c) * 12 + s]
    grid = np.ascontiguousarray(code.reshape(-1, 16).T)
    assert prefix_scan(state_maps(grid)).tolist() == want
    long = classes()[[ord(c) for c in "a'" + "  " * 200 + "'r" + "v" * 110]]  # chunks that remember their beginning
    grid, want, s = np.ascontiguousarray(long[:512].reshape(-1, 64).T), [], FRESH
    for i, c in enumerate(long[:512]):
        if i % 64 == 0:
            want.append(s)
        s = NEXT[int(c) * 12 + s]
    assert prefix_scan(state_maps(grid)).tolist() == want
    assert END == 11


def test_pretokens_join_to_the_text():
    t = texts(300)
    spans = Spans(t, ["<|endoftext|>"])
    words = [w if k < 0 else "<|endoftext|>" for w, k in zip(spans.words(np.arange(len(spans.first))), spans.special)]
    edges = [0, *spans.docs.tolist()]
    assert ["".join(words[a:b]) for a, b in zip(edges, edges[1:])] == [x or "" for x in t]
    assert len(Spans([], ["x"]).docs) == 0 and len(Spans([None, ""], ["x"]).first) == 0


def test_several_special_strings():
    spans = Spans(["a<x><xy>b", "<x>", "c"], ["<x>", "<xy>"])
    assert spans.special.tolist() == [-1, 0, 1, -1, 0, -1] and spans.docs.tolist() == [4, 5, 6]


def test_word_table_is_a_dictionary():
    """Numbers are given in order of first sight, whatever collides; the table grows when it must."""
    table, plain, seen = WordTable(slots=8), {}, []
    for part in (texts(40, 1), texts(40, 2), ["\0", "\0\0", "\0" * 16, "\0" * 17, "a" * 16, "a" * 17, "a" * 16]):
        spans = Spans(part, ["<|endoftext|>"])
        number, new = table.number(spans)
        seen += new
        for w, k, i in zip(spans.words(np.arange(len(number))), spans.special, number.tolist()):
            assert i == -1 if k >= 0 else seen[i] == w and plain.setdefault(w, i) == i
    assert len(set(seen)) == len(seen) == table.n


def test_long_runs_close_into_cycles(bpe):
    """A long unbroken text needs few states, and no state grows with it."""
    m = Merger(BPE)
    assert m.run(b"a" * 50_000) == len(bpe.encode("a" * 50_000).ids)
    assert len(m.states) < 100
    rnd = random.Random(8)
    blob = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert m.run(blob.encode()) == len(bpe.encode(blob).ids)
    assert max(len(s[0]) for s in m.states) < max(map(len, m.vocab))
    small = Merger(BPE, max_states=100)
    assert small.run(blob.encode()) == m.run(blob.encode()) and len(small.states) <= 101


def test_token_count_rows(odd, none, bpe):
    got = sorted(map(tuple, token_counts(odd, BPE, limit=50).collect()), key=str)
    n = lambda t: len(bpe.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 50) for r in odd_rows()), key=str)
    assert token_counts(none, BPE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("size", [16, 256, 1024])
def test_range_coder(n, size):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.minimum(rng.zipf(1.3, n), 65535), np.zeros(n), np.full(n, 65535), np.arange(n)):
        ids = ids.astype(np.uint16)
        tables, blocks, crcs = pack(ids, size)
        assert len(blocks) == len(crcs) == -(-n // size)
        assert (unpack(n, size, tables, blocks, crcs) == ids).all()


def test_every_id_once():
    ids = np.random.default_rng(1).permutation(65536).astype(np.uint16)
    assert (unpack(len(ids), 512, *pack(ids, 512)) == ids).all()


def test_blocks_are_checked_and_stand_alone():
    ids = np.tile(np.arange(50, dtype=np.uint16), 40)
    tables, blocks, crcs = pack(ids, 500)
    assert sum(map(len, blocks)) < len(ids) // 4  # 16 bits an id at first
    with pytest.raises(ValueError):
        unpack(len(ids), 500, tables, blocks, [crcs[0] ^ 1, *crcs[1:]])
    for k in range(4):  # a block needs the tables and itself
        assert (unpack(500, 500, tables, blocks[k : k + 1], crcs[k : k + 1]) == ids[k * 500 : (k + 1) * 500]).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_the_coder_earns_its_keep():
    """Real ids: smaller than zlib on the same blocks and than their order-0 entropy, tables and checksums counted."""
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from read_parquet('/root/testdata/sf0.1/documents.parquet') order by doc_id limit 1500").fetchall()]
    ids, _ = word_ids(BPE).encode(texts, 0)
    size = 1024
    tables, blocks, crcs = pack(ids, size)
    coded = len(tables) + sum(map(len, blocks)) + 4 * len(crcs)
    flat = sum(len(zlib.compress(ids[k : k + size].tobytes(), 9)) for k in range(0, len(ids), size))
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert coded < 0.9 * flat
    assert coded < -(p * np.log2(p)).sum() * len(ids) / 8
    assert (unpack(len(ids), size, tables, blocks, crcs) == ids).all()


def test_ids_as_the_library(bpe):
    """Also where pretokens hold the byte that separates them, and where the table is emptied."""
    words = word_ids(BPE)
    for t in (texts(2000), ["\0", "a\0b", "\0\0 x", "x"], [None, "", "<|endoftext|>"], []):
        ids, n = words.encode(t, 7)
        want = [[*e.ids, 7] for e in bpe.encode_batch([x or "" for x in t], add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))
    small = type(words)(BPE)
    small.known.table.most = 20
    t = texts(200)
    got = [i for k in range(0, len(t), 10) for i in small.encode(t[k : k + 10], 0)[0].tolist()]
    assert got == [i for e in bpe.encode_batch([x or "" for x in t], add_special_tokens=False) for i in [*e.ids, 0]]


def test_token_store(odd, none, bpe):
    got = token_store(odd, BPE).collect()
    assert len(got) == len(odd_rows())
    ids = lambda t: bpe.encode(t or "", add_special_tokens=False).ids + [0]
    want = sorted(((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in odd_rows() for i in [ids(r[1])]), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert token_store(none, BPE).count() == 0


def test_pieces_as_the_library(spark, sp):
    rnd = random.Random(3)
    al = list("aabcdethein  \n▁éñ中\U0001f600.,'12") + ["the", "  ", "▁▁", "ation"]
    rows = [(i, "".join(rnd.choice(al) for _ in range(rnd.randint(0, 90)))) for i in range(400)]
    rows += [(r[0], r[1]) for r in odd_rows()] + [(5002, "x" * 500 + "the" * 200), (5003, " " * 300), (5004, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decode(encode(docs, SP), SP).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), sp.encode(t or "")) for i, t in rows)
    assert sorted(r.text for r in got) == sorted(sp.decode(sp.encode(t or "")) for _, t in rows)


def test_pieces_of_nothing(none):
    assert encode(none, SP).count() == 0


def test_words_and_long_words(sp):
    """Words join to the text, no piece crosses a boundary, and a word of a text is encoded alone as the library encodes it there."""
    voc = vocabulary(SP)
    beside = {p[i : i + 2] for p in voc.rank for i in range(len(p) - 1)}
    for text in ("the end of it.", "a  b", " lead", "x\n\ny z", "é" * 70, "x" * 400 + "ation" * 30, "\U0001f600\U0001f600 a", "1,234.5"):
        spans = voc.words([text, None, "", text])
        words = spans.words(np.arange(len(spans.first)))
        assert "".join(words) == ("▁" + text.replace(" ", "▁")) * 2 and spans.docs.tolist() == [len(words) // 2] * 3 + [len(words)]
        half = words[: len(words) // 2]
        assert all(a[-1] + b[0] not in beside for a, b in zip(half, half[1:])) and all(w[i : i + 2] in beside for w in half for i in range(len(w) - 1))
        assert voc.encode([text])[0].tolist() == sp.encode(text)


def test_small_word_limit(sp):
    voc = pieces.Vocabulary(SP)
    voc.known.table.most = 3
    t = [r[1] or "" for r in odd_rows()]
    for k in range(0, len(t), 4):
        ids, n = voc.encode(t[k : k + 4])
        want = [sp.encode(x) for x in t[k : k + 4]]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))


def test_other_vocabularies_are_refused():
    """Where the library reads a sample differently, nothing is encoded."""
    voc = pieces.Vocabulary(SP)

    class Other:
        def encode(self, text):
            return voc_library.encode(text.upper())

    voc_library, voc.library = voc.library, Other()
    with pytest.raises(ValueError):
        voc.check()


def test_decoding_bytes(sp):
    ids = sp.encode("x \U0001f600\x07 é")
    voc = vocabulary(SP)
    assert voc.decode(ids) == sp.decode(ids) and voc.decode(ids[:4]) == sp.decode(ids[:4]) and voc.decode([]) == ""
