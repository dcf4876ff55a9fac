"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its subwords (runs of three and four
bytes of each lower-cased word with its boundaries, hashed into buckets); a
linear layer and softmax give languages.  Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; a temperature
fitted on a fifth of the sample calibrates the scores, and the score below
which a prediction is marked as rejected is the lowest one at which that fifth
is right often enough.

Since everything up to the softmax is linear, a bucket's part in the logits is
one row of a table, and so is a word's: each task sums every distinct word once.

Cases: null texts and texts without a letter are ``und`` with score 0; without
labelled rows everything is; ties go to the language that sorts first; an empty
table gives an empty result; repeated rows are judged alike; all columns of the
input stay and the new ones take names that are free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, sliced, table

#: The training sample: labelled texts in all, those of a language at most, and those
#: it may have where there are too many languages for that; so at most
#: LABELLED_ROWS / LEAST_ROWS languages are learned, the most frequent ones.
LABELLED_ROWS, SAMPLE_ROWS, LEAST_ROWS = 4000, 400, 16
#: Characters of a text that are learned from, in so many pieces from all over the text.
SAMPLE_CHARS, PIECES = 12_000, 8
BUCKETS, DIM = 1 << 15, 16
EPOCHS, RATE, BATCH = 12, 20.0, 16
#: Share of accepted predictions that must be right on the validation part.
ACCEPT = 0.99
TABLE_ROWS, KEPT_CHARS = 200_000, 64


def has_letter(text: str) -> bool:
    """Whether a text holds a character of the Unicode categories L*."""
    return any(c.isalpha() for c in text)


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of some words, and the index of each one's word."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    found, owners = [], []
    for n in (3, 4):
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros(0, np.int64)])


@dataclass
class Model:
    """``table``: each bucket's part in the logits; ``temperature`` and ``least`` (score to be accepted) come from calibration."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares."""
    out = []
    for t in texts:
        ids, n = np.unique(subwords(t.lower().split())[0], return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(texts: list[str], langs: list[str], seed: int = 1, epochs: int = EPOCHS) -> Model:
    """A calibrated model of labelled texts."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    x = _counted(texts)
    rng = np.random.default_rng(seed)
    check = rng.random(len(x)) < 0.2
    check &= ~(check.all() if len(x) else False)
    rows = np.flatnonzero(~check)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    # rare languages weigh as much as common ones
    balance = (len(y) / (len(names) * np.bincount(y, minlength=len(names)))).astype(np.float32)
    steps, step = epochs * -(-len(rows) // BATCH), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            rate, step = RATE * (1 - step / steps), step + 1
            hidden = np.stack([x[i][1] @ embed[x[i][0]] for i in part])
            logits = hidden @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= balance[y[part], None] / len(part)
            back = p @ weight.T
            weight -= 0.05 * rate * hidden.T @ p
            bias -= 0.01 * rate * p.sum(0)
            for i, g in zip(part, back, strict=True):
                embed[x[i][0]] -= rate * x[i][1][:, None] * g
    model = Model(names, embed @ weight, bias)
    held = np.flatnonzero(check)
    if len(held):
        calibrate(model, np.stack([x[i][1] @ model.table[x[i][0]] + bias for i in held]), y[held])
    return model


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Sets the temperature of least log loss and the score at which predictions are accepted."""
    best = np.inf
    for t in np.geomspace(0.05, 20, 60):
        model.temperature, kept = t, model.temperature
        loss = -np.log(model.probabilities(logits)[np.arange(len(y)), y] + 1e-12).mean()
        best, model.temperature = (loss, t) if loss < best else (best, kept)
    p = model.probabilities(logits)
    scores, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-scores)
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= ACCEPT)
    model.least = float(scores[order][good[-1]]) if len(good) else 1.0


class Words:
    """Logit sums and subword counts of words, each distinct one computed once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs) + 1))

    def _sums(self, words: list[str]) -> np.ndarray:
        ids, owner = subwords(words)
        out = np.empty((len(words), len(self.model.langs) + 1))
        for j in range(len(self.model.langs)):
            out[:, j] = np.bincount(owner, self.model.table[ids, j], len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its language's index and score."""
        if len(self.known) > TABLE_ROWS:
            self._clear()
        split = [t.lower().split() for t in texts]
        new = list({w for ws in split for w in ws if w not in self.known})
        keep, size = self.known, len(self.known)  # rows of longer words lie behind and are written over next time
        short = [w for w in new if len(w) <= KEPT_CHARS]
        rows = [(short, keep)]
        long = {}
        if len(short) < len(new):
            rows.append(([w for w in new if len(w) > KEPT_CHARS], long))
        for words, where in rows:
            need = size + len(words)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((need, self.rows.shape[1]))])
            self.rows[size:need] = self._sums(words)
            where.update(zip(words, range(size, need), strict=True))
            size = need
        get = keep.get if not long else lambda w: keep[w] if w in keep else long[w]
        counts = np.array([len(ws) for ws in split])
        at = np.fromiter((get(w) for ws in split for w in ws), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(owner, self.rows[at, j], len(texts)) for j in range(self.rows.shape[1])], 1)
        logits = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.model.bias
        p = self.model.probabilities(logits)
        return p.argmax(1), p.max(1)


def held_out(key: str) -> Column:
    """Whether a row is kept from learning: the remainder of its key's checksum by four is two."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(text: str, chars: int) -> Column:
    """At most about ``chars`` characters of ``text``: all of a text that isn't longer, else pieces from evenly spaced places, the first and last parts among them."""
    size, part = F.length(text), chars // PIECES
    starts = [F.floor((size - part) * i / (PIECES - 1)).cast("int") + 1 for i in range(PIECES)]
    return F.when(size <= chars, F.col(text)).otherwise(F.concat_ws(" ", *[F.substring(F.col(text), s, F.lit(part)) for s in starts]))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", total: int = LABELLED_ROWS, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of the rows that aren't held out, from at most ``total`` texts and ``rows`` a language, ``chars`` characters of each.

    Where the languages are so many that each would get fewer than LEAST_ROWS
    texts, the most frequent are learned (ties by name).  Prediction reads whole texts.
    """
    spark = df.sparkSession
    open_rows = df.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = open_rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, total // LEAST_ROWS)).collect()
    if not counts:
        return None
    quota = min(rows, max(1, total // len(counts)))
    # by a hash of the key, somewhat more than asked for; the rest is cut below
    shares = spark.createDataFrame([(r.lang, min(1.0, 1.5 * quota / r["count"])) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64("k", F.octet_length("text")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = open_rows.join(F.broadcast(shares), "lang").withColumn("draw", drawn).where("draw < share")
    by_lang: dict[str, list] = {}
    # copies of one row draw alike, so the cut is made in the plan too: what comes to the driver has a bound
    first = sample.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("draw", "k"))).where(F.col("at") <= quota)
    for r in first.select("lang", "draw", "k", _pieces("text", chars).alias("text")).collect():
        by_lang.setdefault(r.lang, []).append((r.draw, str(r.k), r.text))
    chosen = [(x[2], name) for name, xs in sorted(by_lang.items()) for x in sorted(xs) if has_letter(x[2])]
    return train([t for t, _ in chosen], [n for _, n in chosen]) if chosen else None


def identify(df: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with struct ``out``: ``lang``, ``score`` and ``accepted``."""
    at = df.columns.index(text)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    (out,) = fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        words = Words(known) if known else None
        for batch in sliced(batches, at):
            texts = batch.column(at).to_pylist()
            made = [{"lang": "und", "score": 0.0, "accepted": False} for _ in texts]
            seen = [i for i, t in enumerate(texts) if words and t and has_letter(t)]
            if seen:
                best, score = words.predict([texts[i] for i in seen])
                for i, b, s in zip(seen, best.tolist(), score.tolist(), strict=True):
                    made[i] = {"lang": known.langs[b], "score": min(1.0, s), "accepted": s >= known.least}
            arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def op10_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))
