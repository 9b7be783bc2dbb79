"""SentencePiece encoding and decoding on a relational lattice.

Texts fall into words that no merge of the vocabulary crosses: there is a boundary between
two characters that stand side by side in no piece. The lattice of the words of a batch,
each once, is made of relations held as Arrow and numpy columns: the substrings (word,
start, length) of up to the longest piece are exploded length by length and equi-joined to
the piece table on (prefix, next character), so that what is no prefix of a piece drops
out; the pieces found are edges, grouped by word and ordered by rank.

The vocabulary is of the BPE kind. A Viterbi fold over its scores finds the path of the
highest sum, which is not what such a vocabulary means: it merges the best adjacent pair
first. So the fold keeps the set of boundaries of a word as bits and in each step removes
the one inside the best edge that spans exactly two current pieces, leftmost among equals.
That gives the library's pieces. All words of a batch are folded in step.

The README says why the lattice is not made of Spark rows. Nothing is shuffled: a task
encodes its own documents, and keeps the ids of words up to a limit that changes no id
(words.py). Words of over LONGEST characters are merged one by one by the same rule.

Null and empty texts have no pieces. Rows are encoded one by one, equal ones equally, and
very long texts whole. Other columns are not read, so their names can't clash. An empty table
gives an empty result. A vocabulary of another kind, one that normalises texts, or one with
ids of over 16 bits is refused.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import documents, slices, trim
from .words import IdTable, Words

MARK = "▁"
LONGEST = 62
MAX_WORDS = 500_000
#: Texts that normalising vocabularies change, and some that others read differently.
PROBES = ["", " ", "  two  spaces ", "Ａ① ﬁ", "e\u0301 é", "A\tb\nc\r\n", "\u00a0x\u3000y", "the end of the nation's 1234", "\U0001f600 中文 ▁"]
CODED = "doc_id long, ids array<int>"


class Vocabulary:
    """Pieces that merges can make, with the rank of their score, and the ids of all."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in every]
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in every if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        #: What each id spells; marks are spaces.
        self.spelt = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.pieces[i]: order[sp.get_score(i)] for i in plain if len(self.pieces[i]) > 1}
        self.longest = max(map(len, self.ids))
        self.table = PieceTable(self)
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.known = IdTable(self.learn, [], MAX_WORDS)
        # characters of pieces that merges can make, numbered; which two of them stand side by side in one
        chars = sorted({c for p in self.rank for c in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.side = len(chars) + 1
        self.beside = np.zeros(self.side * self.side, bool)
        flat = self.number[np.frombuffer("\n".join(self.rank).encode("utf-32-le"), np.uint32)]
        self.beside[flat[:-1] * self.side + flat[1:]] = True
        self.beside[: self.side] = self.beside[:: self.side] = False
        if len(self.pieces) > 1 << 16 or len(self.bytes) < 256:
            raise ValueError("ids must be below 65536, and there must be a piece for every byte")
        self.library = sp
        self.check()

    def words(self, texts: list[str | None]) -> Words:
        """Texts as words: a mark begins each text and stands for every space."""
        parts = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        code = self.number[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside.take(code[:-1] * self.side + code[1:])
        cut[stops[stops < len(points)]] = True
        return Words(whole, points, np.flatnonzero(cut), np.concatenate([[0], np.cumsum(cut)])[stops])

    def ids_of(self, parts: list[str]) -> bytes:
        """Ids (little-endian 16-bit) of pieces; what is no piece is spelt in bytes."""
        out = []
        for p in parts:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u2").tobytes()

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not known yet, and how many each has."""
        found: list[bytes] = [b""] * len(new)
        short = [k for k, w in enumerate(new) if len(w) <= LONGEST]
        for k, w in enumerate(new):
            if len(w) > LONGEST:
                found[k] = self.ids_of(self.merge(list(w)))
        for at in range(0, len(short), 10_000):
            part = short[at : at + 10_000]
            for k, ids in zip(part, encode_words(self, [new[i] for i in part])):
                found[k] = ids
        return np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and how many each has."""
        return self.known.ids(self.words(texts))

    def merge(self, parts: list[str]) -> list[str]:
        """The same rule for long units: a heap of adjacent pairs over a linked list."""
        import heapq

        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if a >= 0 and b < len(parts) and (r := self.rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = nxt[a]
            if not parts[a] or b >= len(parts) or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            nxt[a] = nxt[b]
            if nxt[b] < len(parts):
                prv[nxt[b]] = a
            if prv[a] >= 0:
                offer(prv[a])
            offer(a)
        return [p for p in parts if p]

    def check(self) -> None:
        """Is it a vocabulary of the kind that is encoded here? Samples of its own pieces and of odd texts must agree with the library."""
        rest = self.pieces[:: max(1, len(self.pieces) // 400)]
        for text in (*PROBES, " ".join(rest).replace(MARK, " "), "".join(rest).replace(MARK, "")):
            if self.encode([text])[0].tolist() != self.library.encode(text):
                raise ValueError(f"this vocabulary is not of the BPE kind, or it normalises texts: {text[:40]!r}")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes decode together, marks are spaces, the first one goes."""
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PieceTable:
    """The piece table by prefixes: (prefix, next character) -> prefix, and the pieces among the prefixes.

    Prefixes are numbered; 0 is the empty one. A relation with one row per prefix, sorted by key.
    """

    def __init__(self, voc: Vocabulary):
        number = {"": 0}
        keys: list[tuple[int, int]] = []
        for p in voc.rank:
            for k in range(1, len(p) + 1):
                if p[:k] not in number:
                    number[p[:k]] = len(number)
                    keys.append((number[p[: k - 1]] << 21 | ord(p[k - 1]), number[p[:k]]))
        keys.sort()
        self.key = np.array([k for k, _ in keys], np.int64)
        self.to = np.array([t for _, t in keys], np.int32)
        self.rank = np.full(len(number), -1, np.int64)
        self.id = np.full(len(number), -1, np.int32)
        for p, r in voc.rank.items():
            self.rank[number[p]], self.id[number[p]] = r, voc.ids[p]

    def join(self, prefix: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a match, and the prefixes they extend to."""
        want = prefix.astype(np.int64) << 21 | char
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        hit = np.flatnonzero(self.key[at] == want)
        return hit, self.to[at[hit]]


def lattice(voc: Vocabulary, chars: np.ndarray, word: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges (position, length, rank, id) of pieces of two or more characters, by word, rank and position.

    chars: the characters of all words in a row; word: the word of each; last: where its word ends.
    """
    table = voc.table
    at, prefix = np.arange(len(chars)), np.zeros(len(chars), np.int32)
    found = []
    for k in range(1, voc.longest + 1):
        fit = at + k <= last[at]  # the substring of length k ends within the word
        at, prefix = at[fit], prefix[fit]
        hit, prefix = table.join(prefix, chars[at + k - 1])
        at = at[hit]
        if not len(at):
            break
        piece = np.flatnonzero(table.rank[prefix] >= 0)
        found.append((at[piece], np.full(len(piece), k), table.rank[prefix[piece]], table.id[prefix[piece]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    pos, length, rank, ids = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((pos, rank, word[pos]))
    return pos[order], length[order], rank[order], ids[order]


def fold(unit: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Boundaries of words as bits, after all merges: in each round every word applies its best edge.

    Edges (unit, start, end) are ordered by unit, then best first; size: characters of each word.
    """
    one = np.uint64(1)
    bounds = (np.uint64(2) << size.astype(np.uint64)) - one
    start, end = start.astype(np.uint64), end.astype(np.uint64)
    ends, middle = (one << start) | (one << end), (one << end) - (np.uint64(2) << start)
    while len(unit):
        now = bounds[unit]
        alive = (now & ends) == ends  # a lost boundary never comes back
        ready = np.flatnonzero(alive & (np.bitwise_count(now & middle) == 1))
        if not len(ready):
            break
        mine = unit[ready]
        first = np.concatenate([[True], mine[1:] != mine[:-1]])
        best = ready[first]
        bounds[unit[best]] &= ~middle[best]
        alive[best] = False
        busy = np.zeros(len(size), bool)
        busy[unit[best]] = True
        alive &= busy[unit]  # words without an edge to apply are done
        unit, ends, middle = unit[alive], ends[alive], middle[alive]
    return bounds


def encode_words(voc: Vocabulary, words: list[str]) -> list[bytes]:
    """Ids of distinct words of at most LONGEST characters."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size)
    begin = stop - size
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    pos, length, _, ids = lattice(voc, chars, word, stop[word])
    start = pos - begin[word[pos]]
    bounds = fold(word[pos], start, start + length, size)
    # a piece of two or more characters is an edge with both ends set and nothing between
    b, one = bounds[word[pos]], np.uint64(1)
    s, e = start.astype(np.uint64), (start + length).astype(np.uint64)
    final = (b >> s & one).astype(bool) & (b >> e & one).astype(bool) & ((b & ((one << e) - (np.uint64(2) << s))) == 0)
    at = voc.single[chars]
    at[pos[final]] = ids[final]
    cut = (bounds[word] >> (np.arange(len(chars)) - begin[word]).astype(np.uint64) & one).astype(bool)
    spelt = np.unique(word[cut & (at < 0)])  # words with characters that are spelt in bytes
    count = np.add.reduceat(cut, begin) if len(words) else np.zeros(0, np.int64)
    flat = at[cut].astype("<u2").tobytes()
    edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int64) * 2
    out = [flat[a:z] for a, z in zip(edges.tolist(), edges[1:].tolist())]
    for i in spelt.tolist():
        marks = [k for k in range(len(words[i]) + 1) if int(bounds[i]) >> k & 1]
        out[i] = voc.ids_of([words[i][a:z] for a, z in zip(marks, marks[1:])])
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>; path names a SentencePiece vocabulary of the BPE kind."""

    def run(batches):
        voc = vocabulary(path)
        for b in slices(batches, 2 << 20):
            ids, n = voc.encode(b.column("text").to_pylist())
            stops, values = np.cumsum([0, *n.tolist()]).astype(np.int32), ids.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(stops), pa.array(values))], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, CODED)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text for encoded rows."""

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            lists = b.column("ids")
            flat, stops = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [voc.decode(flat[a:z].tolist()) for a, z in zip(stops.tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
        trim()

    return coded.mapInArrow(run, "doc_id long, ids array<int>, text string")
