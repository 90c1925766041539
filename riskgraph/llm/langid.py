"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over character n-grams (1 to 3, hashed)
predicts whether the text's language has +1 there: log-odds of the n-grams, averaged over the text and calibrated by
a logistic curve. Decoding takes the codeword with the smallest loss, each bit weighted by how well its classifier
did on rows it hadn't seen, so a few wrong bits are outvoted; a text whose two nearest codewords are about equally
near is flagged as ambiguous.

The classifiers are fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled rows of each language, whole texts.
Everything else covers all rows. A null text or a text without a letter is ``und`` with score 0 and ambiguous, as is
every text if nothing was learned. With one learned language every text with a letter has it. Repeated rows get equal
answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batches, forget, held_out, learnable, stored

#: Labelled rows of each language that the classifiers are fitted on; half weigh n-grams, half calibrate.
PER_LANGUAGE = 3000
BUCKETS = 1 << 15
#: Characters turned into n-grams at a time.
BLOCK = 1 << 17
#: Two nearest languages whose probabilities differ by less are an ambiguous answer.
MARGIN = 0.1
SMOOTHING = 0.5
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the text, block by block; runs of other characters than letters count as word ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), BLOCK):
        c = points[max(0, at - 2):at + BLOCK].astype(np.uint32)
        letter = _letters()[c]
        c = np.where(letter, c, np.uint32(32))
        two = c[:-1] * np.uint32(0x01000193) + c[1:]
        three = two[:-1] * np.uint32(0x01000193) + c[2:]
        both = letter[:-1] | letter[1:]
        found = [c[letter], two[both] ^ np.uint32(0x5BD1E995), three[(both[:-1] | letter[2:])] ^ np.uint32(0x7FEB352D)]
        h = np.concatenate(found)
        yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits of few languages, far-apart random words of many."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if (s >> k) & 1 else -1 for s in splits] for k in range(languages)])
    rng, best, most = np.random.default_rng(languages), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(40):
        m = np.where(rng.random((languages, bits)) < 0.5, 1, -1)
        m[0, np.abs(m.sum(0)) == languages] *= -1
        apart = int(((bits - m @ m.T) // 2 + bits * np.eye(languages, dtype=int)).min())
        if apart > most:
            best, most = m, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def margins(self, text: str) -> np.ndarray | None:
        """Mean log-odds of each bit; None without a letter."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for h in grams(text):
            total += self.weights[h].sum(0, dtype=np.float64)
            n += len(h)
        return total / n if n else None

    def decode(self, margins: np.ndarray) -> tuple[int, float, int, bool]:
        """(nearest, its probability, second nearest, ambiguous)."""
        z = np.clip(self.slope * margins + self.offset, -8, 8)
        loss = (self.trust * np.logaddexp(0, -self.code * z)).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        second = int(order[1]) if len(order) > 1 else int(order[0])
        apart = p[order[0]] - p[second] if len(order) > 1 else 1.0
        return int(order[0]), float(p[order[0]]), second, bool(apart < MARGIN)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most so many learnable rows of each language, by a hash of the id."""
    rows = docs.filter(
        learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.3 * per_language) / F.col("n") + 0.0)
    die = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    near = rows.join(F.broadcast(counts), "lang").filter(die < share * (1 << 30))  # a row per language
    ranked = near.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(die, "doc_id", "text")))
    return ranked.filter(F.col("nth") <= per_language).select(
        "lang", "text", (F.col("nth") % 2).cast("int").alias("half"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``text`` and ``lang`` of learnable rows."""
    learning = docs.select("doc_id", "text", "lang")
    rows = stored(sample(learning, per_language), "language-sample").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for h in grams(text):
                    mine += np.bincount(h, minlength=BUCKETS)
        for lang, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["lang", "bucket", "n"])

    weighing = rows.filter("half = 1").select("lang", "text")
    # at most BUCKETS numbers for each language
    table = by_batches(weighing, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(table["lang"]))
    code = codewords(len(languages))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.zeros(1), np.ones(1))
    seen = np.full((len(languages), BUCKETS), SMOOTHING)
    np.add.at(seen, ([languages.index(x) for x in table["lang"]], table["bucket"]), table["n"])
    share = seen / seen.sum(1, keepdims=True)
    if len(languages) == 1:
        return Model(languages, code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.full(1, 8.0), np.ones(1))
    weights = np.stack(
        [np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])],
        axis=1).astype(np.float32)
    bits = code.shape[1]
    raw = Model(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [raw.margins(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["lang", "margins"])

    # at most per_language / 2 rows for each language
    unseen = rows.filter(F.col("half") == 0).filter(F.col("lang").isin(languages)).select("lang", "text")
    got = by_batches(unseen, margins, "lang string, margins array<double>").toArrow().to_pydict()
    x, y = np.array(got["margins"]).reshape(-1, bits), code[[languages.index(v) for v in got["lang"]]].reshape(-1, bits)
    slope, offset, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        slope[b], offset[b] = logistic(x[:, b], y[:, b] > 0)
        wrong = (np.sign(slope[b] * x[:, b] + offset[b]) != y[:, b]).mean() if len(x) else 0.0
        trust[b] = max(0.05, 1 - 2 * wrong)
    return Model(languages, code, weights, slope, offset, trust)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps."""
    if not len(x):
        return 1.0, 0.0
    scale = float(np.abs(x).mean()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) / len(x) - ridge * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design / len(x) + ridge * np.eye(2)
        beta += np.linalg.solve(hess, grad)
    return float(beta[0] / scale), float(beta[1])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``second`` and ``ambiguous`` to all columns of ``docs``; reads only the text."""
    names = docs.columns
    at = names.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out: list[tuple] = []
            for v in batch.column(at):
                m = model.margins(v.as_py() or "") if model.languages else None
                if m is None:
                    out.append((UNDETERMINED, 0.0, UNDETERMINED, True))
                else:
                    k, p, second, unsure = model.decode(m)
                    out.append((model.languages[k], p, model.languages[second], unsure))
            new = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new], [*(f"c{i}" for i in range(len(names))), "p0", "p1", "p2", "p3"])
        pa.default_memory_pool().release_unused()  # the worker stays while the next step runs

    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    done = by_batches(own, predict, ", ".join([*fields, "p0 string, p1 double, p2 string, p3 boolean"]))
    return done.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("p0").alias("lang_pred"),
        F.col("p1").alias("score"), F.col("p2").alias("second"), F.col("p3").alias("ambiguous"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, second, ambiguous of every document."""
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def accepted(docs: DataFrame, least_letters: int = 0) -> DataFrame:
    """Rows of ``docs`` whose language is known and not ambiguous, columns as they were.

    An ambiguous answer counts only for texts of at least so many letters.
    """
    model = fit(docs)
    names = docs.columns
    marked = docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"own_{i}") for i, c in enumerate(names)))
    short = F.char_length(F.regexp_replace("text", r"\P{L}+", "")) < least_letters
    found = identify(marked, model).filter((F.col("lang_pred") != UNDETERMINED) & (~F.col("ambiguous") | short))
    return found.select(*(F.col(c if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(names)))
