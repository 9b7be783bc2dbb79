"""Quality classification by co-training.

Two views of a document: what its text is like (content: shares of kinds of characters,
words and lines, and hashed counts of words and word pairs) and what is known of its page
(source, language, length: metadata). A logistic classifier is fitted for each view on the
labelled rows. In each round both score all unlabelled documents, and those that a view is
most sure of, at `confidence` or more, become pseudo-labels for the other view; documents
with equal features count once, no view gives a document twice, and the classes keep the
shares that they have among the labels. At the end each view is
calibrated on labelled rows that no fit has seen (its log-odds against the labels), and the
calibrated log-odds are combined by a small classifier, fitted on other rows of that kind.

Bounds, all parameters: at most `max_labels` labelled rows are fitted on (the first by a
hash of their id); a view gives at most `per_round` of that many pseudo-labels of each
class in a round, and LEAST at least. Both classifiers score every document, in every round
and at the end.

Null and empty texts have neutral content features and are scored like any other; very long
ones are read whole. A document with contradictory labels takes their mean, rounded up from
one half; repeated rows and ids are scored each. Without labels of both classes every score
is 1 and all rows are kept. The columns of the input travel in a struct, so names can't
clash. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, slices

STYLE, LEXICAL, BUCKETS = 17, 256, 256
CONTENT = STYLE + LEXICAL
LEAST = 400
_KIND = np.zeros((256, 8), np.float64)
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = [_ch.isascii() and _ch.islower(), _ch.isascii() and _ch.isupper(), _ch.isascii() and _ch.isdigit(), _c in b" \t\r\x0b\x0c", _c == 10, _c in b".,;:'\"?-", _c in b"!|#$%&*@<>{}[]()=+_/\\~^", _c >= 128]


def style(text: str | None) -> list[float]:
    """Shares and ratios; how long a text is belongs to the other view alone, so that one can teach the other."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, w, m = max(1, len(raw)), max(1, len(words)), len(lines)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count @ _KIND / n
    distinct = len(set(words))
    blank = sum(not x.strip() for x in lines)
    return [
        *share.tolist(),
        (len(raw) - m - len(words)) / w,
        distinct / w,
        distinct / np.sqrt(w),
        len(set(lines)) / m,
        blank / m,
        count[ord("!")] / w,
        count[ord("|")] / w,
        float(count[[ord(c) for c in "#$%&*"]].sum()) / w,
        sum(x[-1:] in b".!?" for x in lines if x) / m,
    ]


class Lexicon(dict):
    """Hashes of lower-case words; emptied over a limit, which changes none."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


def lexical(text: str | None, known: Lexicon) -> np.ndarray:
    """Shares of hashed words and pairs of adjacent words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    both = np.concatenate([h, (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) >> np.uint64(7)]) % np.uint64(LEXICAL)
    return np.bincount(both.astype(np.int64), minlength=LEXICAL) / max(1, len(both))


def content_features(text: str | None, known: Lexicon) -> np.ndarray:
    return np.concatenate([style(text), lexical(text, known)]).astype(np.float32)


def _features(batches):
    known = Lexicon()
    for b in slices(batches):
        feats = np.array([content_features(t, known) for t in b.column("text").to_pylist()], np.float32).reshape(-1, CONTENT)
        spot = lambda kind, v: zlib.crc32(f"{kind}={v}".encode()) % BUCKETS
        meta = [[spot("source", s), spot("lang", x), spot("size", int(np.log2((n or 0) + 1) * 2) if (n or 0) >= 0 else -1)] for s, x, n in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(feats.ravel()), CONTENT).cast(pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), *cols], names=[*(c for c in b.schema.names if c != "text"), "content", "meta"])


def _one_hot(meta: np.ndarray) -> np.ndarray:
    out = np.zeros((len(meta), BUCKETS), np.uint8)
    for k in range(meta.shape[1]):
        out[np.arange(len(meta)), meta[:, k]] = 1
    return out


@dataclass
class Logistic:
    """Logistic regression with L2 on standardised features, by Newton steps."""

    ridge: float = 1.0
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """x may be of any number type; it is widened a block of rows at a time."""
        blocks = [slice(k, k + 4096) for k in range(0, len(x), 4096)]
        self.mean = sum(x[b].sum(axis=0, dtype=float) for b in blocks) / len(x)
        self.scale = np.sqrt(sum(((x[b] - self.mean) ** 2).sum(axis=0) for b in blocks) / len(x)) + 1e-6
        d = x.shape[1] + 1
        w, keep = np.zeros(d), np.full(d, float(self.ridge))
        keep[-1] = 1e-6
        for _ in range(20):
            grad, curve = keep * w, np.diag(keep)
            for b in blocks:
                z = np.column_stack([(x[b] - self.mean) / self.scale, np.ones(len(x[b]))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                grad += z.T @ (p - y[b])
                curve += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
            step = np.linalg.solve(curve, grad)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        self.weight = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        slope = self.weight[:-1] / self.scale
        return np.clip(x @ slope + (self.weight[-1] - self.mean @ slope), -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class CoTrained:
    content: Logistic
    meta: Logistic
    calibration: tuple[Logistic, Logistic] | None = None
    mix: Logistic | None = None

    def views(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of both views, calibrated as soon as they can be."""
        raw = self.content.logit(content), self.meta.logit(_one_hot(meta))
        return raw if self.calibration is None else tuple(c.logit(z[:, None]) for c, z in zip(self.calibration, raw))

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _sigmoid(self.mix.logit(np.column_stack(self.views(content, meta))))


def _flat(b: pa.RecordBatch | pa.Table, name: str, k: int) -> np.ndarray:
    """A column of lists of k numbers as rows."""
    col = b.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _arrays(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _flat(b, "content", CONTENT), _flat(b, "meta", 3)


def _sure(sent, confidence: float, most: int):
    """Of one task the rows of which a view is most sure, `most` for each view and class; of equal rows one."""
    least = float(np.log(confidence / (1 - confidence)))

    def run(batches):
        model, given = sent.value
        best: dict[tuple[int, int], dict] = {}
        for b in batches:
            if not b.num_rows:
                continue
            orders, same = b.column("order").to_numpy(), b.column("same").to_numpy()
            content, meta = _arrays(b)
            for view, z in enumerate(model.views(content, meta)):
                for label in (0, 1):
                    s = z if label else -z
                    found = best.setdefault((view, label), {})
                    at = np.flatnonzero((s >= least) & ~np.isin(same, given[view]))
                    at = at[np.lexsort((orders[at], -s[at]))]
                    at = at[np.sort(np.unique(same[at], return_index=True)[1])][:most]
                    for i in at.tolist():
                        row = (-float(s[i]), int(orders[i]), content[i], meta[i])
                        if (k := int(same[i])) not in found or row[:2] < found[k][:2]:
                            found[k] = row
                    if len(found) > most:
                        best[view, label] = dict(sorted(found.items(), key=lambda r: r[1][:2])[:most])
        rows = [(v, y, -s, o, k, c.tolist(), m.tolist()) for (v, y), found in best.items() for k, (s, o, c, m) in found.items()]
        if rows:
            types = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["view", "label", "sure", "order", "same", "content", "meta"])

    return run


SURE = "view int, label int, sure double, order long, same long, content array<float>, meta array<int>"


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the smallest `order`, a uniform hash; a cut by the hash leaves little more than those to be sorted."""
    n = rows.count()
    if n > most:
        share = min(1.0, (1.1 * most + 1000) / n)
        near = rows.where(F.col("order") <= int(-(1 << 63) + ((1 << 64) - 1) * share)) if share < 1 else rows
        rows = near if near.count() >= most else rows
    return rows.orderBy("order", "same").limit(most)


def fit(feats: DataFrame, labels: DataFrame, scratch: Scratch, rounds: int = 3, max_labels: int = 20_000, per_round: float = 0.1, confidence: float = 0.98) -> CoTrained | None:
    """feats (doc_id, content, meta), labels (doc_id, quality)."""
    spark = feats.sparkSession
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    pool = feats.where("doc_id is not null").join(truth, "doc_id", "left").select("y", F.xxhash64("doc_id").alias("order"), F.xxhash64("content", "meta").alias("same"), "content", "meta")
    pool = scratch.write(pool, "pool")
    told = _first(pool.where("y is not null"), max_labels).select("y", "order", "content", "meta").toArrow()
    y = told.column("y").to_numpy().astype(float) if told.num_rows else np.zeros(0)
    if len(set(y)) < 2:
        return None
    content, meta = _arrays(told)
    hot = _one_hot(meta)
    # a quarter of the ids is held back: half of it calibrates the views, the other half combines them
    part = told.column("order").to_numpy() % 8
    both = lambda mask: len(set(y[mask])) == 2
    held = part % 4 == 0
    if not both(held) or not both(~held):
        held = np.ones(len(y), bool)
    calibrating, combining = held & (part == 0), held & (part != 0)
    if not both(calibrating) or not both(combining):
        calibrating = combining = held
    fitting = np.ones(len(y), bool) if held.all() else ~held
    most = max(LEAST, int(per_round * len(y)))
    # what each view is taught: its own kind of features, and labels
    views = [[content[fitting]], [hot[fitting]]], [[y[fitting]], [y[fitting]]]
    given: list[list[int]] = [[], []]
    model = None
    for k in range(rounds + 1):
        taught = [(np.concatenate(xs), np.concatenate(ys)) for xs, ys in zip(*views)]
        model = CoTrained(Logistic(50.0).fit(*taught[0]), Logistic(10.0).fit(*taught[1]))
        if k == rounds:
            break
        sent = spark.sparkContext.broadcast((model, [np.array(g, np.int64) for g in given]))
        rest = pool.where("y is null").select("order", "same", "content", "meta")
        sure = scratch.write(rest.mapInArrow(_sure(sent, confidence, most), SURE), f"sure{k}")
        share = y[fitting].mean()
        for view in (0, 1):
            tops = []
            for label in (0, 1):
                mine = sure.where((F.col("view") == view) & (F.col("label") == label))
                best = mine.groupBy("same").agg(F.min(F.struct((-F.col("sure")).alias("doubt"), "order")).alias("r")).orderBy("r.doubt", "r.order", "same").limit(most)
                # `most` rows at most; their features follow by a join, so that no task sorts features
                rows = mine.select("same", "content" if view else "meta").join(F.broadcast(best), "same").dropDuplicates(["same"])
                tops.append(rows.orderBy("r.doubt", "r.order", "same").drop("r").toArrow())
            # both classes in the shares that the labels have, so that no class grows over the other
            whole = min(tops[1].num_rows / share, tops[0].num_rows / (1 - share))
            for label, top in enumerate(tops):
                top = top.slice(0, round(whole * (share if label else 1 - share)))
                given[view] += top.column("same").to_pylist()
                # for the other view
                views[0][1 - view].append(_flat(top, "content", CONTENT) if view else _one_hot(_flat(top, "meta", 3)))
                views[1][1 - view].append(np.full(top.num_rows, float(label)))
    raw = model.views(content, meta)
    model.calibration = tuple(Logistic(0.1).fit(z[calibrating][:, None], y[calibrating]) for z in raw)
    model.mix = Logistic(0.1).fit(np.column_stack(model.views(content[combining], meta[combining])), y[combining])
    return model


def _scored(sent, threshold: float):
    def run(batches):
        for b in _features(batches):
            content, meta = _arrays(b)
            m = sent.value
            a, z = (m.views(content, meta)) if m else (np.full(b.num_rows, 30.0),) * 2
            s = m.score(content, meta) if m else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s), pa.array(_sigmoid(a)), pa.array(_sigmoid(z)), pa.array(s >= threshold)], names=["row", "score", "content_score", "metadata_score", "keep"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """All rows of docs with score, content_score, metadata_score, keep; its own columns are in the struct `row`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    parts = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]
    feats = docs.select(*parts).mapInArrow(_features, "doc_id long, source string, lang string, n_chars long, content array<float>, meta array<int>").select("doc_id", "content", "meta")
    model = fit(feats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")), scratch, **how)
    sent = spark.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    whole = docs.select(row, *parts[1:])
    kind = whole.schema["row"].dataType.simpleString()
    out = whole.mapInArrow(_scored(sent, threshold), f"row {kind}, score double, content_score double, metadata_score double, keep boolean")
    back = F.struct(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row")
    return out.select(back, "score", "content_score", "metadata_score", "keep")
