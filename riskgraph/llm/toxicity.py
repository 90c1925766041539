"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

The labels are for whole documents, so tokens are labelled first: in a toxic document those words whose form or
stem is tied to toxic documents (likelihood ratio over documents, near copies counted once) are toxic tokens, all
others are not. A chain with two states learns from these token labels: emissions from hashed word and stem
features, transitions between clean and toxic. The marginals of forward-backward give each token's probability; a
document's score is a logistic curve over their expected number, their maximum and their density, and the tokens
over one half are its offending offsets.

Fitting uses a bounded sample: at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other labelled rows, whole texts. Every
text is scored whole. A null or empty text has the score of a text without toxic tokens. Without labels of both kinds
every score is the share of toxic labels (0 without labels). Repeated rows get equal scores; of several labels of one
id the largest counts. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable

TOXIC_ROWS = 1500
CLEAN_ROWS = 3000
FEATURES = 1 << 18
UNIT_SLOTS = 1 << 22
STEMS = (4, 5, 6, 7)
#: Likelihood ratio (twice the log) from which a word or stem is tied to toxic documents.
TIED = 20.0
#: Jaccard similarity of the words of so many letters from which two sampled texts are near copies.
SAME, LONG = 0.5, 6
ROUNDS = 40
THRESHOLD = 0.7
#: Distinct words remembered by one worker, and tokens run through the chain at a time.
REMEMBERED = 300_000
BLOCK_TOKENS = 200_000

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(word: str) -> list[str]:
    """The word itself and its stems."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


def features(word: str) -> list[int]:
    return [zlib.crc32(u.encode()) % FEATURES for u in units(word)]


def _runs(x: np.ndarray, length: int, pad: float) -> np.ndarray:
    """Steps x runs: column k is the k-th run of the chain."""
    runs = -(-len(x) // length)
    return np.concatenate([x, np.full(runs * length - len(x), pad)]).reshape(runs, length).T


def chain(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward and backward vectors (tokens x 2, each scaled) of documents laid end to end.

    ``first`` marks each document's first token, where nothing of the token before counts. The long chain is cut into
    runs whose 2x2 products are formed side by side, joined run by run, then expanded side by side.
    """
    n = len(emission)
    length = max(1, int(np.sqrt(n)))
    e = _runs(np.exp(np.clip(emission, -30, 30)), length, 1.0)
    new = _runs(first.astype(float), length, 1.0) > 0
    a = np.exp(step)
    s = np.exp(start)
    m = [[np.where(new, s[j], a[i, j]) * (e if j else 1.0) for j in (0, 1)] for i in (0, 1)]
    runs = e.shape[1]
    one, zero = np.ones(runs), np.zeros(runs)
    t = [[one, zero], [zero, one]]
    for k in range(length):
        t = [[t[i][0] * m[0][j][k] + t[i][1] * m[1][j][k] for j in (0, 1)] for i in (0, 1)]
        scale = t[0][0] + t[0][1] + t[1][0] + t[1][1]
        t = [[x / scale for x in row] for row in t]
    into, out = np.empty((runs, 2)), np.empty((runs, 2))
    (p, q), (r, w) = [[x.tolist() for x in row] for row in t]
    x, y = 0.5, 0.5
    for k in range(runs):
        into[k] = x, y
        x, y = x * p[k] + y * r[k], x * q[k] + y * w[k]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(runs - 1, -1, -1):
        out[k] = x, y
        x, y = p[k] * x + q[k] * y, r[k] * x + w[k] * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta = np.empty((2, length, runs)), np.empty((2, length, runs))
    x, y = into.T
    for k in range(length):
        x, y = x * m[0][0][k] + y * m[1][0][k], x * m[0][1][k] + y * m[1][1][k]
        total = x + y
        x, y = x / total, y / total
        alpha[0, k], alpha[1, k] = x, y
    x, y = out.T
    for k in range(length - 1, -1, -1):
        beta[0, k], beta[1, k] = x, y
        x, y = m[0][0][k] * x + m[0][1][k] * y, m[1][0][k] * x + m[1][1][k] * y
        total = x + y
        x, y = x / total, y / total
    return alpha.transpose(2, 1, 0).reshape(-1, 2)[:n], beta.transpose(2, 1, 0).reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each token."""
    if not len(emission):
        return np.zeros(0)
    alpha, beta = chain(emission, first, start, step)
    p = alpha * beta
    return p[:, 1] / p.sum(1)


@dataclass
class Model:
    weights: np.ndarray  # FEATURES
    start: np.ndarray  # 2
    step: np.ndarray  # 2 x 2
    curve: np.ndarray | None  # document score over (1, log expected, most, density); None: the share alone
    share: float
    known: dict[str, float] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            got = float(sum(self.weights[f] for f in features(word)))
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Marginals of every text's tokens."""
        tokens = [words(t) for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        emission = np.fromiter((self.emission(w) for t in tokens for w in t), np.float64, int(sizes.sum()))
        first = np.zeros(len(emission), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        return np.split(marginals(emission, first, self.start, self.step), ends[:-1]) if texts else []

    def score(self, p: np.ndarray) -> float:
        if self.curve is None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(_facts(p) @ self.curve, -30, 30))))


def _facts(p: np.ndarray) -> np.ndarray:
    n = len(p)
    return np.array([1.0, np.log1p(p.sum()), p.max() if n else 0.0, 10 * p.sum() / (n + 10)])


def _once(ids: list[np.ndarray], long: np.ndarray) -> np.ndarray:
    """False for texts whose long words agree with those of an earlier kept text: Jaccard of ``SAME`` or more.

    A text of n words reaches that only with a text that has one of its n - ceil(SAME * n) + 1 rarest words among its own
    so many rarest, so kept texts are listed under those words only, and every text found there is compared in full.
    """
    mine = [t[long[t]] for t in ids]
    times = np.bincount(np.concatenate([*mine, np.zeros(0, np.int64)]).astype(np.int64), minlength=len(long))
    keep, listed, marked = np.ones(len(ids), bool), {}, np.zeros(len(long), bool)
    for i, t in enumerate(mine):
        n = len(t)
        if not n:
            continue
        rare = t[np.lexsort((t, times[t]))][:n - int(np.ceil(SAME * n)) + 1].tolist()
        near = {k for w in rare for k in listed.get(w, ()) if SAME * n <= len(mine[k]) <= n / SAME}
        if near:
            others = [mine[k] for k in near]
            sizes = np.array([len(o) for o in others])
            marked[t] = True
            both = np.add.reduceat(marked[np.concatenate(others)], np.cumsum(sizes) - sizes, dtype=np.int64)
            marked[t] = False
            keep[i] = not (both >= SAME * (n + sizes - both)).any()
        if keep[i]:
            for w in rare:
                listed.setdefault(w, []).append(i)
    return keep


def tied_words(ids: list[np.ndarray], vocabulary: list[str], toxic: np.ndarray) -> np.ndarray:
    """Words that are, or have a stem that is, in toxic documents far more often than their share.

    ``ids`` are the distinct words of each text. Words and stems are counted by hash in ``UNIT_SLOTS`` places.
    """
    rows = [(k, zlib.crc32(u.encode()) % UNIT_SLOTS) for k, w in enumerate(vocabulary) for u in units(w)]
    of_word, of_unit = (np.array(c, np.int32) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int32),) * 2
    bounds = np.searchsorted(of_word, np.arange(len(vocabulary) + 1))
    keep = _once(ids, np.array([len(w) >= LONG for w in vocabulary], bool))
    counts = np.zeros((2, UNIT_SLOTS), np.int32)
    for t, bad, use in zip(ids, toxic, keep, strict=True):
        if use and len(t):
            found = np.unique(np.concatenate([of_unit[bounds[k]:bounds[k + 1]] for k in t]))
            counts[int(bad), found] += 1
    bad, good = int((toxic & keep).sum()), int((~toxic & keep).sum())
    if not bad or not good:
        return np.zeros(len(vocabulary), bool)
    n, t = counts.astype(float)
    q = bad / (bad + good)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (t * np.log(t / ((t + n) * q)) + np.where(n > 0, n * np.log(n / ((t + n) * (1 - q))), 0))
        tied = (t >= 3) & (t > 10 * n * bad / good) & (ratio >= TIED)
    return np.bincount(of_word[tied[of_unit]], minlength=len(vocabulary)) > 0


def _blocks(ids: list[np.ndarray], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many tokens."""
    at, tokens = 0, 0
    for k, t in enumerate(ids):
        tokens += len(t)
        if tokens >= size:
            yield at, k + 1
            at, tokens = k + 1, 0
    if at < len(ids):
        yield at, len(ids)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    first = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    first[(ends - sizes)[sizes > 0]] = True
    return first


def learn(texts: list[str], toxic: list[int]) -> Model:
    """Fit the chain and the document curve."""
    y = np.array(toxic, bool)
    start, step = np.log([0.9, 0.1]), np.log([[0.95, 0.05], [0.7, 0.3]])
    plain = Model(np.zeros(FEATURES), start, step, None, float(y.mean()) if len(y) else 0.0)
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32) for t in texts]
    vocabulary = list(number)
    del number
    is_tied = tied_words([np.unique(t) for t in ids], vocabulary, y)
    if not is_tied.any():
        return plain
    rows = [(k, f) for k, w in enumerate(vocabulary) for f in features(w)]
    of_word, of_feature = (np.array(c, np.int32) for c in zip(*rows, strict=True))
    del rows
    blocks = []
    for a, b in _blocks(ids, BLOCK_TOKENS):
        word, sizes = np.concatenate(ids[a:b]), np.array([len(t) for t in ids[a:b]])
        if len(word):
            blocks.append((word, (is_tied[word] & np.repeat(y[a:b], sizes)).astype(float), _firsts(sizes)))
    times = sum(np.bincount(word, minlength=len(vocabulary)) for word, _, _ in blocks)
    rate = 1 / np.sqrt(np.maximum(np.bincount(of_feature, times[of_word], FEATURES), 1))  # rare ones step farther

    weights, speed = np.zeros(FEATURES), np.zeros(FEATURES)
    for _ in range(ROUNDS):
        per_word = np.bincount(of_word, weights[of_feature], len(vocabulary))
        push, real, expected = np.zeros(len(vocabulary)), np.ones((2, 2)), np.ones((2, 2))
        for word, label, first in blocks:
            emission = per_word[word]
            alpha, beta = chain(emission, first, start, step)
            p = alpha * beta
            push += np.bincount(word, label - p[:, 1] / p.sum(1), len(vocabulary))
            later = np.flatnonzero(~first[1:]) + 1
            np.add.at(real, (label[later - 1].astype(int), label[later].astype(int)), 1)
            into = beta[later] * np.stack([np.ones(len(later)), np.exp(np.clip(emission[later], -30, 30))], 1)
            pair = np.exp(step)[None] * alpha[later - 1][:, :, None] * into[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        grad = np.bincount(of_feature, push[of_word], FEATURES) * rate - 1e-3 * weights
        speed = 0.8 * speed + grad
        weights = np.clip(weights + rate * speed, -12, 12)
        step = step + 0.1 * (np.log(real) - np.log(expected))
    model = Model(weights, start, step, None, plain.share)
    per_word = np.bincount(of_word, weights[of_feature], len(vocabulary))
    x = []
    for a, b in _blocks(ids, BLOCK_TOKENS):
        sizes = np.array([len(t) for t in ids[a:b]])
        p = marginals(per_word[np.concatenate(ids[a:b])], _firsts(sizes), start, step)
        x += [_facts(part) for part in np.split(p, np.cumsum(sizes)[:-1])]
    model.curve = _curve(np.array(x), y.astype(float))
    return model


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(hess, x.T @ (y - p) / len(x) - ridge * beta)
        beta = beta + move / max(1.0, np.abs(move).max() / 5)
    return beta


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learn from texts of ``docs`` and ``labels.toxic`` of learnable rows."""
    known = labels.filter(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    die = F.xxhash64("doc_id", F.lit("toxic"))
    chosen = known.filter("toxic > 0").orderBy(die).limit(toxic_rows).unionByName(
        known.filter("toxic <= 0").orderBy(die).limit(clean_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # toxic_rows + clean_rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic").toArrow().sort_by("doc_id").to_pydict()
    return learn(got["text"], [int(t > 0) for t in got["toxic"]])


SPANS = "array<struct<start: int, stop: int, p: double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and spans: offsets (code points of the text) of tokens over one half."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans, waiting, size = [], [], [], 0

            def flush() -> None:
                for text, p in zip(waiting, model.tag(waiting), strict=True):
                    scores.append(model.score(p))
                    at = np.flatnonzero(p > 0.5)
                    found = []
                    if len(at):
                        places = [m.span() for m in _WORD.finditer(text if len(text.lower()) == len(text) else text.lower())]
                        found = [{"start": places[i][0], "stop": places[i][1], "p": float(p[i])} for i in at]
                    spans.append(found)
                waiting.clear()

            for v in batch.column(1):
                text = v.as_py() or ""
                waiting.append(text)
                size += len(text) // 5
                if size >= BLOCK_TOKENS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, spans {SPANS}")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
