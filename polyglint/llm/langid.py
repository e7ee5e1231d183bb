"""Language identification by error-correcting output codes: op1.

Texts become counts of hashed byte bigrams and trigrams (A-Z lower-cased, ASCII non-letters as blanks), square-rooted and
scaled to length 1. Each language has a codeword; for each bit a logistic classifier predicts on which side a text lies.
Decoding adds up each bit's logistic loss against a codeword's bit, weighted by how well the bit was learned, and takes
the nearest codeword; a text whose runner-up is close is flagged as ambiguous.

The classifiers are fitted on the driver to a sample that is bounded by documented parameters: per_language rows of each
language, of sample_chars characters at most, chosen by a hash of doc_id. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches

BIGRAMS, TRIGRAMS = 1024, 4096
DIMS = BIGRAMS + TRIGRAMS


def _byte_map() -> np.ndarray:
    out = np.full(256, 32, np.uint32)
    out[128:] = np.arange(128, 256)
    for c in range(97, 123):
        out[c] = out[c - 32] = c
    return out


BYTES = _byte_map()


def features(data: np.ndarray) -> np.ndarray:
    """data: the bytes of a text."""
    b = BYTES[np.concatenate([[32], data, [32]])]
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    mix = np.uint32(2654435761)
    x = np.concatenate([np.bincount(two * mix >> np.uint32(22), minlength=BIGRAMS), np.bincount(three * mix >> np.uint32(20), minlength=TRIGRAMS)])
    # blanks alone say nothing
    x = np.sqrt(x.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-6)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all distinct two-way splits of up to five languages; beyond that, from seeded random codes of
    enough bits, the one with the widest least distance."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        bits = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    r, width = np.random.default_rng(0), int(10 * np.ceil(np.log2(n))) + 1
    best, far = None, -1
    for _ in range(200):
        code = r.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T) // 2
        least = int((apart + np.eye(n, dtype=int) * width).min())
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x DIMS
    bias: np.ndarray
    trust: np.ndarray  # of each bit, adding up to the number of bits

    def decode(self, x: np.ndarray) -> tuple[int, float, float]:
        """Place of the nearest codeword, its score, and the runner-up's."""
        if len(self.langs) == 1:
            return 0, 1.0, 0.0
        margin = self.weights @ x + self.bias
        far = (np.logaddexp(0, -self.code * margin) * self.trust).sum(1)
        p = np.exp(far.min() - far)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return int(order[0]), float(p[order[0]]), float(p[order[1]])


def fit(rows: list[tuple[str, str]], rounds: int = 80, seed: int = 0) -> Model:
    """rows: (lang, text). Texts are also learned from as short fragments, as short texts have to be told apart too."""
    langs = sorted({r[0] for r in rows})
    code, r = codewords(len(langs)), np.random.default_rng(seed)
    xs, ys = [], []
    for lang, text in rows:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for n in (len(data), 200, 60, 20):
            if n == len(data) or n < len(data):
                at = int(r.integers(0, len(data) - n + 1))
                xs.append(features(data[at : at + n]))
                ys.append(langs.index(lang))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((0, DIMS), np.float32), np.zeros(0), np.zeros(0))
    x, y = np.array(xs, np.float32), np.array(ys)
    target = code[y].astype(np.float32)  # rows x bits
    balance = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y].astype(np.float32)[:, None]
    held = r.random(len(y)) < 0.2
    w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, step = np.zeros_like(w), np.zeros_like(b), 40.0
    tx, tt, tb = x[~held], target[~held], balance[~held]
    for _ in range(rounds):
        m = tt * (tx @ w + b)
        g = -tt * tb / (1 + np.exp(np.clip(m, -30, 30))) / len(tx)
        vw, vb = 0.9 * vw - step * (tx.T @ g + 1e-6 * w), 0.9 * vb - 0.1 * step * g.sum(0)
        w, b = w + vw, b + vb
    loss = np.logaddexp(0, -target[held] * (x[held] @ w + b)).mean(0) if held.any() else np.ones(code.shape[1])
    trust = 1 / (0.05 + loss)
    return Model(langs, code, np.ascontiguousarray(w.T), b, trust * len(trust) / trust.sum())


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def sample(docs: DataFrame, per_language: int, sample_chars: int) -> list[tuple[str, str]]:
    """At most about per_language rows (in expectation; never over twice that times the languages) of each language. Rows
    over sample_chars are left out, but for languages that have no other: those give a piece of each row, at a place that
    the row's hash picks. This bounds the fit alone; predictions read whole texts."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder() != 2) & (F.length("text") > 0))
    n = {(r[0], r[1]): r[2] for r in rows.groupBy("lang", (F.length("text") <= sample_chars).alias("short")).count().collect()}
    counts = {lang: n.get((lang, True)) or n[lang, False] for lang, _ in n}
    if not counts:
        return []
    short = sorted({lang for lang, s in n if s})
    begin = F.pmod(F.xxhash64("doc_id"), F.length("text") - sample_chars + 1).cast("int") + 1
    rows = rows.filter((F.length("text") <= sample_chars) | ~F.col("lang").isin(short))
    rows = rows.withColumn("text", F.when(F.length("text") <= sample_chars, F.col("text")).otherwise(F.substr(F.col("text"), begin, F.lit(sample_chars))))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(per_language / n))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.filter(place < share[F.col("lang")]).select("lang", "text").limit(2 * per_language * len(counts)).collect()
    return sorted((r[0], r[1]) for r in picked)


def identify(spark: SparkSession, docs: DataFrame, per_language: int = 300, sample_chars: int = 20_000, margin: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, runner_up_score for every row of docs (doc_id, text, lang).

    Null texts, and texts without a letter, are `und` with score 0, as is everything if no row has a language. A null
    doc_id is not held out, and not learned from.
    """
    arrow_batches(spark)
    model = fit(sample(docs, per_language, sample_chars))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            text = batch.column(2)
            if pa.types.is_large_string(text.type):
                text = text.cast(pa.string())
            off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            lang, score, second = [], [], []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = data[a:z]
                plain = BYTES[own]
                letters = ((plain >= 97) & (plain < 123)).any() or ((own >= 128).any() and any(map(str.isalpha, own.tobytes().decode("utf-8", "replace"))))
                if letters and model.langs:
                    k, p, q = model.decode(features(own))
                    lang.append(model.langs[k])
                else:
                    p = q = 0.0
                    lang.append("und")
                score.append(p)
                second.append(q)
            close = np.array(score) - np.array(second) < margin
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close), pa.array(second, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "runner_up_score"])

    rows = docs.select("doc_id", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, runner_up_score double")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return identify(spark, docs.select("doc_id", "text", "lang"))
