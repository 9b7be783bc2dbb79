"""A byte-level BPE tokenizer compiled to deterministic finite-state transducers.

Two machines run one after the other.

The splitter reads character classes and emits the pretoken boundaries that the
tokenizer's pattern would find; its look-ahead is turned into boundaries that it places
one character back. A batch of texts is cut into chunks; each chunk gets its state map
(the state after it, for every state before it), the maps compose through a parallel
prefix scan, and a second sweep annotates every transition from its now known state.

The merger reads the bytes of a pretoken. Its state is all that later bytes can depend on:
the longest suffix read that begins a vocabulary entry, and for each place in it the last
token there and the count of tokens up to it, relative to the end. The last token after a
byte is the only vocabulary entry that ends there and forms a stable pair with the last
token before it. A transition emits the change in the count. Equal states are one, so that
long runs close into cycles; states are compiled when first needed and kept up to a limit.
The counts of a batch are summed up by a prefix scan over its pretokens.

Pretokens of up to 16 bytes are looked up in a hash table over their packed bytes (equal
bytes, not just equal hashes), all of a batch at once; longer ones in a dictionary. All
tables are emptied over a limit; that bounds memory and never changes a result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

from .words import Words, WordTable

# Character classes: letter, contraction letters, number, space, other white space, apostrophe, other, end.
L, C1, R, V, LL, E, N, S, W, A, O, END = range(12)
# States: fresh, in letters, numbers, others; a white space run of one or more that ends
# in a space or in another white space; an apostrophe that began a token, then with r, v, l.
FRESH, LET, NUM, OTH, S1, SN, W1, WN, AP, AR, AV, AL = range(12)
HERE, BACK = 1, 2
#: White space by the Unicode property of that name (fixed values).
SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 256


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next states and boundary flags, flat by class * 12 + state."""
    letters = (L, C1, R, V, LL, E)
    kind = {**dict.fromkeys(letters, LET), N: NUM, O: OTH, A: AP, S: S1, W: W1, END: FRESH}
    nxt, emit = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    for c in range(12):
        for s in range(12):
            to, flag = kind[c], HERE  # a new token begins here
            if c == END:
                flag |= BACK if s in (AR, AV, AL) else 0
            elif s == LET and c in letters or s == NUM and c == N:
                flag = 0
            elif s == OTH and c in (O, A):
                to, flag = OTH, 0
            elif s in (S1, SN, W1, WN):
                if c in (S, W):
                    to, flag = (SN if c == S else WN), 0
                elif s in (S1, SN):  # the last space goes with what follows
                    to, flag = (OTH if c == A else kind[c]), (BACK if s == SN else 0)
                elif s == WN:  # the last white space stands alone
                    flag = HERE | BACK
            elif s == AP:
                if c == C1:
                    to, flag = FRESH, 0
                elif c in (R, V, LL):
                    to, flag = {R: AR, V: AV, LL: AL}[c], 0
                elif c in (O, A):
                    to, flag = OTH, 0
            elif (s, c) in ((AR, E), (AV, E), (AL, LL)):
                to, flag = FRESH, 0
            elif s in (AR, AV, AL):  # no contraction: the letter began a token
                flag = BACK if c in letters else HERE | BACK
            if s == AP and c in (R, V, LL):
                flag = 0
            nxt[c, s], emit[c, s] = to, flag
    # an apostrophe with r, v or l that is no contraction: the boundary before the letter is placed one step later
    return nxt.ravel(), emit.ravel()


NEXT, EMIT = _machine()
STEP = NEXT | EMIT << 4


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point; those that this Python's tables lack are asked of the tokenizer library."""
    from tokenizers.pre_tokenizers import ByteLevel

    table = np.full(0x110000, O, np.uint8)
    unknown = []
    for cp in range(0x40000):
        g = unicodedata.category(chr(cp))
        if g[0] == "L":
            table[cp] = L
        elif g[0] == "N":
            table[cp] = N
        elif g == "Cn":
            unknown.append(cp)
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for probe, c in (("a", L), ("1", N)):
        begins = {x[1][0] for x in split("\n".join(probe + chr(cp) for cp in unknown))}
        table[[cp for i, cp in enumerate(unknown) if 3 * i + 1 not in begins]] = c
    table[SPACES] = W
    for chars, c in (("stmd", C1), ("r", R), ("v", V), ("l", LL), ("e", E), (" ", S), ("'", A)):
        table[[ord(x) for x in chars]] = c
    return table


def state_maps(codes: np.ndarray) -> np.ndarray:
    """codes (CHUNK, m): for every chunk the state after it by the state before it, (m, 12).

    A few characters make most chunks forget where they began, so the last ones are read
    first; chunks that remember more are read from their beginning.
    """

    def read(part: np.ndarray) -> np.ndarray:
        maps = np.broadcast_to(np.arange(12, dtype=np.uint8), (part.shape[1], 12)).copy()
        for row in part:
            maps = NEXT.take((row.astype(np.intp) * 12)[:, None] + maps)
        return maps

    maps = read(codes[-16:])
    late = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(late):
        maps[late] = read(codes[:, late])
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """State before each chunk: exclusive scan of the maps under composition, by doubling."""
    done, step = maps, 1
    while step < len(done):
        done = np.concatenate([done[:step], np.take_along_axis(done[step:], done[:-step].astype(np.intp), axis=1)])
        step *= 2
    return np.concatenate([[FRESH], done[:-1, FRESH]]).astype(np.uint8)


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Positions at which a pretoken begins, for class codes of texts that each end in END."""
    n = len(codes)
    m = -(-n // CHUNK)
    padded = np.full(m * CHUNK, END, np.uint8)
    padded[:n] = codes
    grid = np.ascontiguousarray(padded.reshape(m, CHUNK).T)
    state = prefix_scan(state_maps(grid))
    moved = np.empty_like(grid)  # next state and flags
    at = grid.astype(np.int16) * 12
    for j in range(CHUNK):
        moved[j] = found = STEP.take(at[j] + state)
        state = found & 15
    flat = (moved >> 4).T.ravel()[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BACK).astype(bool)
    return np.flatnonzero(begins)


class Spans(Words):
    """The pretokens of a batch of texts. Special strings are pretokens of their own wherever they occur, as the library has it."""

    def __init__(self, texts: Iterable[str | None], specials: list[str]):
        split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        number = {s: k for k, s in enumerate(specials)}
        parts, kinds, docs = [], [], []
        for t in texts:
            t = t or ""
            if any(s in t for s in specials):
                pieces = split.split(t)  # texts and special strings in turn
                parts += pieces
                kinds += [number[p] if k % 2 else -1 for k, p in enumerate(pieces)]
            else:
                parts.append(t)
                kinds.append(-1)
            docs.append(len(parts))
        if not parts:
            super().__init__("", np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
            return
        kind = np.array(kinds, np.int64)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        # a separator ends every part, and stands for the part where that is a special string
        whole = "\n".join("" if k >= 0 else p for p, k in zip(parts, kinds)) + "\n"
        length[kind >= 0] = 0
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        code = classes()[points]
        ends = np.cumsum(length + 1) - 1
        code[ends] = END
        begin = boundaries(code)
        at = np.searchsorted(begin, ends)  # every end is a boundary
        keep = np.ones(len(begin), bool)
        keep[at[kind < 0]] = False
        special = np.full(len(begin), -1, np.int64)
        special[at] = kind
        super().__init__(whole, points, begin, np.cumsum(keep)[at[np.asarray(docs, np.int64) - 1]], keep)
        self.special = special[keep]


def specials_of(path: str) -> dict[str, int]:
    """The special strings of a vocabulary file and their ids; only plain ones are known here."""
    added = json.load(open(path, encoding="utf-8"))["added_tokens"]
    if any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special strings of this vocabulary strip or need word ends")
    return {x["content"]: x["id"] for x in added}


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for a byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The second machine; run(pretoken) steps it byte by byte."""

    def __init__(self, path: str, max_states: int = 200_000):
        spec = json.load(open(path, encoding="utf-8"))
        back = byte_alphabet()
        raw = lambda piece: bytes(back[c] for c in piece)
        self.vocab = {raw(k) for k in spec["model"]["vocab"] if all(c in back for c in k)}
        self.begins = {t[:n] for t in self.vocab for n in range(1, len(t))}  # what can still grow
        self.specials = list(specials_of(path))
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = i
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.max_states = max_states
        self.table, self.counted = WordTable(most=1_400_000), np.zeros(0, np.int64)
        self.reset()

    def reset(self) -> None:
        start = (b"", (b"",), (0,))
        self.states = [start]
        self.named = {start: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.stable.clear()

    def merged(self, text: bytes) -> list[bytes]:
        """Merges in rank order; only for pairs of vocabulary entries."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    joined.append(pair[0] + pair[1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def is_stable(self, a: bytes, b: bytes) -> bool:
        """Do a and b stay as they are side by side? With no a: is b what its bytes give?"""
        ok = self.stable.get((a, b))
        if ok is None:
            ok = self.stable[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def compile(self, at: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: the next state, and the tokens that it emits."""
        suffix, last, count = self.states[at]
        text = suffix + bytes([byte])
        for n in range(len(text), 0, -1):
            token = text[-n:]
            if token in self.vocab and self.is_stable(last[-n], token):
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        emitted = count[-n] + 1
        keep = next((k for k in range(len(text), 0, -1) if text[-k:] in self.begins), 0)
        before = len(last) - keep  # the places of the new suffix: `keep` old ones and the end
        state = (text[len(text) - keep :], (*last[before:], token), (*(c - emitted for c in count[before:]), 0))
        to = self.named.get(state)
        if to is None:
            to = self.named[state] = len(self.states)
            self.states.append(state)
        return to, emitted

    def run(self, data: bytes) -> int:
        """Tokens of a pretoken: what its transitions emit."""
        at, total, step = 0, 0, self.step
        for byte in data:
            found = step.get(at << 8 | byte)
            if found is None:
                if len(self.states) > self.max_states:  # the state goes on alone in an empty machine
                    state = self.states[at]
                    self.reset()
                    at = self.named.setdefault(state, len(self.states))
                    if at == len(self.states):
                        self.states.append(state)
                    step = self.step
                found = step[at << 8 | byte] = self.compile(at, byte)
            at = found[0]
            total += found[1]
        return total

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        spans = Spans(texts, self.specials)
        number, new = self.table.number(spans)
        self.counted = np.concatenate([self.counted[: self.table.n - len(new)], np.fromiter((self.run(w.encode()) for w in new), np.int64, len(new))])
        each = np.ones(len(number), np.int64)
        plain = number >= 0
        each[plain] = self.counted[number[plain]]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], spans.docs])])


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)
