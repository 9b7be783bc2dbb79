"""Language identification: known words first, then shorter and shorter character n-grams.

Learning counts the words (runs of letters, lower case) of every labelled training text
by language, and, over the distinct words, the character n-grams of one to LONGEST
characters with word ends marked. The counts cover all training rows, and every word and
n-gram that was seen is known, in all languages.

A known word scores the log of its relative frequency in each language. In an unknown
word, every character takes the longest known n-gram that ends at it, less a penalty for
each step back; the word scores the mean over its characters. The language with the
highest sum wins, the alphabetically first one in a tie; the score is its share after a
softmax.

1. Word and n-gram tables are written to the shared folder, one row a key with the counts
   of all languages. They are as large as the vocabulary and are never broadcast.
2. The commonest words, up to a fixed number of scores, are sent to all tasks as a cache.
   It changes no score, only what must be looked up: a scan of the documents sums up the
   scores of cached words and lists the others.
3. The distinct words not in the cache join the word table; those unknown are cut into
   contexts, whose suffixes join the n-gram table. Their scores come back by a join on the
   word and are summed up by document.

A text that is null, empty or has no letter gets `und` and score 0; so does every text when
no row is labelled. Rows are scored one by one, so ties, repeated rows and ids need no
rule; very long texts and words are scored whole. Other columns are not read, so their
names can't clash. An empty table gives an empty result. More than MAX_LANGS values of the
language column are refused.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, documents, slices
from .words import Growing, Words, WordTable

LONGEST = 5
MAX_LANGS = 1000
STEP_BACK = float(np.log(0.4))


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words_in(texts: list[str | None]) -> Words:
    """Runs of letters of the lower-case texts."""
    lower = [(t or "").lower() for t in texts]
    whole = "".join(t + "\n" for t in lower)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    begin = np.flatnonzero(np.concatenate([[True], is_letter[1:] != is_letter[:-1]])) if len(points) else np.zeros(0, np.int64)
    keep = is_letter[begin]
    stops = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1) - 1
    return Words(whole, points, begin, np.concatenate([[0], np.cumsum(keep)])[np.searchsorted(begin, stops)], keep)


class Named:
    """A table of words that also gives their texts."""

    def __init__(self, most: int):
        self.table, self.names = WordTable(most=most), []

    def full(self) -> bool:
        return self.table.n > self.table.most

    def number(self, spans: Words) -> tuple[np.ndarray, list[str]]:
        if self.full():
            self.names = []
        number, new = self.table.number(spans)
        self.names += new
        return number, new

    def texts(self, number: np.ndarray) -> pa.Array:
        """Numbers, most of them repeated, as texts."""
        some, at = np.unique(number, return_inverse=True)
        return pa.array([self.names[i] for i in some.tolist()], pa.string()).take(pa.array(at))


def _counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    key, n = (np.concatenate(c) for c in zip(*pairs))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def word_counts(labelled: DataFrame, most: int = 400_000) -> DataFrame:
    """(lang, word, n) of documents (text, lang)."""

    def run(batches):
        known, langs, held = Named(most), {}, []

        def flush():
            if held:
                key, n = _counted(held)
                held.clear()
                names = pa.array(list(langs), pa.string()).take(pa.array(key >> 32))
                yield pa.RecordBatch.from_arrays([names, known.texts(key & 0xFFFFFFFF), pa.array(n)], names=["lang", "word", "n"])

        for b in slices(batches, 4 << 20):
            if known.full():
                yield from flush()
            spans = words_in(b.column("text").to_pylist())
            number, _ = known.number(spans)
            lang = np.array([langs.setdefault(x, len(langs)) for x in b.column("lang").to_pylist()], np.int64)
            key = np.repeat(lang, np.diff(np.concatenate([[0], spans.docs]))) << 32 | number
            if len(key):
                held.append(np.unique(key, return_counts=True))
            if sum(len(k) for k, _ in held) > 2 * most:
                held[:] = [_counted(held)]
                if len(held[0][0]) > most:
                    yield from flush()
        yield from flush()

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _emit(held: dict[str, Counter]):
    for lang, c in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) over distinct words."""

    def run(batches):
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist()):
                s = f"\x02{w}\x03"
                held.setdefault(lang, Counter()).update([s[i : i + k] for k in range(1, LONGEST + 1) for i in range(len(s) - k + 1)])
            if sum(map(len, held.values())) > 400_000:
                yield from _emit(held)
                held = {}
        yield from _emit(held)

    return words.select("lang", "word").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Learned:
    """The languages, and the scores by language of every known word and n-gram."""

    langs: list[str]
    words: DataFrame | None = None  # word, n, score array<double>
    grams: DataFrame | None = None  # gram, score


def _scores(counts: DataFrame, key: str, length, langs: list[str], scratch: Scratch) -> DataFrame:
    """(key, n, score): the log of the relative frequency in each language among keys of one length."""
    totals = counts.groupBy("lang", length.alias("len")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v")).collect()  # languages x lengths
    base: dict[int, list[float]] = {}
    for r in totals:
        base.setdefault(r["len"], [0.0] * len(langs))[langs.index(r["lang"])] = float(np.log(r["t"] + 0.5 * r["v"] + 1))
    bases = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    index = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    rows = counts.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(index[F.col("lang")], F.col("n")))).alias("by"))
    rows = rows.withColumn("base", bases[length])
    score = F.expr(f"transform(sequence(0, {len(langs) - 1}), i -> ln(coalesce(by[i], 0L) + 0.5D) - base[i])")
    return scratch.write(rows.select(key, "n", score.alias("score")), f"{key}-scores")


def learn(labelled: DataFrame, scratch: Scratch) -> Learned:
    words = scratch.write(word_counts(labelled), "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return Learned([])
    grams = scratch.write(gram_counts(words), "grams")
    return Learned(langs, _scores(words, "word", F.lit(0), langs, scratch), _scores(grams, "gram", F.char_length("gram"), langs, scratch))


def cache_of(known: Learned, capacity: int) -> tuple[dict[str, int], np.ndarray]:
    """Rows of the commonest words, at most capacity // languages of them, and their scores; the last row is zero."""
    level = F.floor(F.log2("n") * 16).cast("int")  # a thousand levels at most
    room, least = capacity // len(known.langs), None
    for r in sorted(known.words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    if least is None:
        return {}, np.zeros((1, len(known.langs)))
    rows = known.words.where(level >= least).select("word", "score").toArrow()
    table = rows.column("score").combine_chunks().flatten().to_numpy().reshape(-1, len(known.langs))
    return {w: i for i, w in enumerate(rows.column("word").to_pylist())}, np.concatenate([table, np.zeros((1, len(known.langs)))])


SCANNED = "key long, doc_id long, n_words long, sums array<double>, rare array<struct<word:string,times:long>>"
_SCANNED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sums", pa.list_(pa.float64())), ("rare", pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))])


def _scan(sent):
    """Sums of the scores of cached words by document, and the other words of each."""

    def run(batches):
        row, table = sent.value
        known, at_row = Named(600_000), Growing(np.zeros(0, np.int64))
        key = TaskContext.get().partitionId() << 33
        for b in slices(batches, 4 << 20):
            if known.full():
                at_row = Growing(np.zeros(0, np.int64))
            spans = words_in(b.column("text").to_pylist())
            number, new = known.number(spans)
            at_row.append(np.fromiter((row.get(w, -1) for w in new), np.int64, len(new)))
            at = at_row.room.take(number)
            size = np.diff(np.concatenate([[0], spans.docs]))
            sums = np.zeros((len(size), table.shape[1]))
            has = size > 0
            if len(at):
                sums[has] = np.add.reduceat(table[at], (spans.docs - size)[has], axis=0)
            doc = np.repeat(np.arange(len(size)), size)
            late, times = np.unique((doc << 32 | number)[at < 0], return_counts=True)
            stops = pa.array(np.searchsorted(late >> 32, np.arange(len(size) + 1)), pa.int32())
            keys = pa.array(range(key, key + len(size)), pa.int64())
            key += len(size)
            lists = pa.ListArray.from_arrays(stops, pa.StructArray.from_arrays([known.texts(late & 0xFFFFFFFF), pa.array(times)], names=["word", "times"]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * table.shape[1], pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([keys, b.column("doc_id"), pa.array(size), flat, lists], schema=_SCANNED)

    return run


def _sum(weight, n: int) -> list:
    """Sums of weighted scores, a column for each language."""
    return [F.sum(F.col("score")[i] * weight).alias(f"s{i}") for i in range(n)]


def score_words(words: DataFrame, known: Learned, scratch: Scratch) -> DataFrame:
    """(word, score) of distinct words, by the tables."""
    n = len(known.langs)
    looked = scratch.write(words.join(known.words.select("word", "score"), "word", "left"), "looked")
    marked = looked.where("score is null").select("word", F.concat(F.lit("\x02"), "word", F.lit("\x03")).alias("s"))
    ends = F.expr(f"transform(sequence(2, char_length(s)), e -> substring(s, greatest(1, e - {LONGEST - 1}), least({LONGEST}, e)))")
    contexts = scratch.write(marked.select("word", F.explode(ends).alias("context")).groupBy("word", "context").agg(F.count(F.lit(1)).alias("times")), "contexts")
    suffixes = contexts.select("context").distinct().select("context", F.explode(F.expr(f"transform(sequence(1, least({LONGEST}, char_length(context))), k -> substring(context, -k, k))")).alias("gram"))
    held = suffixes.join(known.grams.select("gram", "score"), "gram").groupBy("context").agg(F.max_by(F.struct("gram", "score"), F.char_length("gram")).alias("g"))
    best = held.select("context", F.expr(f"transform(g.score, x -> x + ({LONGEST} - char_length(g.gram)) * {STEP_BACK!r}D)").alias("score"))
    # a character that no known n-gram ends with says nothing
    nothing = F.array(*[F.lit(LONGEST * STEP_BACK - 10.0)] * n)
    each = contexts.join(best, "context", "left").withColumn("score", F.coalesce("score", nothing))
    means = each.groupBy("word").agg(F.sum("times").alias("n"), *_sum(F.col("times"), n))
    return looked.where("score is not null").unionByName(means.select("word", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(n)]).alias("score")))


def predict(docs: DataFrame, known: Learned, scratch: Scratch, capacity: int = 1_000_000) -> DataFrame:
    """doc_id, lang_pred, score of documents (doc_id, text); capacity: scores in the cache of each task."""
    if not known.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    n = len(known.langs)
    sent = docs.sparkSession.sparkContext.broadcast(cache_of(known, capacity))
    scanned = scratch.write(docs.mapInArrow(_scan(sent), SCANNED), "scanned")
    rare = scanned.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.times")
    scored = scratch.write(score_words(rare.select("word").distinct(), known, scratch), "scored")
    late = rare.join(scored, "word").groupBy("key").agg(*_sum(F.col("times"), n))
    whole = scanned.drop("rare").join(late, "key", "left")
    total = F.array(*[F.col("sums")[i] + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)])
    whole = whole.select("doc_id", "n_words", total.alias("total")).withColumn("top", F.array_max("total"))
    langs = F.array(*map(F.lit, known.langs))
    lang = F.element_at(langs, F.array_position("total", F.col("top")).cast("int"))
    share = F.expr("1D / aggregate(total, 0D, (s, x) -> s + exp(x - top))")
    return whole.select("doc_id", F.when(F.col("n_words") > 0, lang).otherwise("und").alias("lang_pred"), F.when(F.col("n_words") > 0, share).otherwise(0.0).alias("score"))


def language_id(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how: int) -> DataFrame:
    """Learn from the rows of docs where train holds and the language is known; predict all rows."""
    scratch = Scratch(docs.sparkSession, "lang")
    labelled = docs.where(train & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return predict(documents(docs, id_col, text_col), learn(labelled, scratch), scratch, **how)
