"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its character n-grams of 1 to 4 letters, with word borders, hashed to BUCKETS rows of an embedding
table. Their average goes through a linear layer and a softmax. Embeddings and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows. A temperature fitted on held-back sample texts
calibrates the probabilities; a text is rejected if its probability is below a limit that is the `reject` quantile of the
held-back texts that were classified right, and at most 0.5.

The sample: about PER_LANG documents of each language, chosen by a hash of doc_id and text, so that it doesn't depend on
the layout of the data; it is the only thing sent to the driver, as counts of features, which are bounded for each text.
Prediction reads whole texts; embeddings times layer is one table of BUCKETS x languages, which is broadcast (its size is
fixed by BUCKETS and the number of languages).

Null text, or text without a letter: language "und", score 0, rejected. No labelled rows: "und" for all. Null doc_id: never
held out. No documents: an empty result. Very long texts are read in parts of CHUNK characters. Of equal probabilities the
language that comes first counts. Other columns are ignored, whatever their names; repeated rows are predicted each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.common import small_batches

BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3, 4)
PER_LANG = 500
CHUNK = 1 << 17  # characters looked at together

LETTER = re.compile(r"[^\W\d_]")
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points in which each run of other characters than letters is one space, with one around."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[c]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, c, np.uint32(32))[keep]


def features(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of each n-gram of the code points; a space stands only at its ends."""
    at, out = [], []
    space = c == 32
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ok = ~space[:m] if n == 1 else ~(space[:m] & space[1 : m + 1])  # no two spaces: they lie between texts
        for j in range(1, n - 1):
            ok &= ~space[j : j + m]
        where = np.flatnonzero(ok)
        at.append(where)
        out.append((h[where] * np.uint32(0x9E3779B1)) >> np.uint32(16))
    if not out:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    c = code_points(text)
    for k in range(0, len(c), CHUNK):
        total += np.bincount(features(c[k : k + CHUNK])[0], minlength=BUCKETS)
    b = np.flatnonzero(total)
    return b.astype(np.int32), total[b].astype(np.int32)


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, limit: float):
        self.languages, self.table, self.bias, self.temperature, self.limit = languages, table, bias, temperature, limit

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        z = (mean_logits + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        k = 0
        while k < len(texts):  # texts are looked at together up to CHUNK characters; a longer one in parts
            group, size, held = [], 0, []
            while k < len(texts) and (not group or size + len(texts[k] or "") <= CHUNK):
                if texts[k] and LETTER.search(texts[k]):
                    c = code_points(texts[k])
                    group.append(k)
                    held.append(c)
                    size += len(c)
                k += 1
            if not group:
                continue
            # no n-gram crosses from one text to the next: at least four spaces lie between
            gap = np.full(4, 32, np.uint32)
            starts = np.cumsum([0, *[len(c) + 4 for c in held[:-1]]])
            c = np.concatenate([x for h in held for x in (h, gap)])
            for part in range(0, len(c), CHUNK):
                b, at = features(c[part : part + CHUNK + max(ORDERS) - 1])
                keep = at < CHUNK
                b, row = b[keep], np.searchsorted(starts, at[keep] + part, "right") - 1
                for j in range(len(self.languages)):
                    sums[group, j] += np.bincount(row, self.table[b, j], len(group))
                n[group] += np.bincount(row, minlength=len(group))
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        some = np.flatnonzero(n)
        if len(some) and self.languages:
            p = self.probabilities(sums[some] / n[some, None])
            best = p.argmax(1)
            score[some] = p[np.arange(len(some)), best]
            for k, j in zip(some, best):
                found[k] = self.languages[j]
        return found, score


def _sample(docs: DataFrame, text: str, lang: str, learn: Column, per_lang: int) -> list:
    """Feature counts of about per_lang texts of each language, and of a short stretch of each."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64("doc_id", text).alias("h")).where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r.l: r.n for r in d.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, F.lit(per_lang / n)).otherwise(share)
    taken = d.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def run(batches):
        for batch in batches:
            rows = []
            for t, lang, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at = (h % 1000003) % max(1, len(t) - 60)
                for kind, x in ((0, t), (1, t[at : at + 20 + h % 41])):
                    b, n = _counts(x)
                    if len(b) and LETTER.search(x):
                        rows.append((lang, h, kind, b, n))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int32()))], ["lang", "h", "kind", "b", "n"])

    return sorted(taken.mapInArrow(run, "lang string, h bigint, kind int, b array<int>, n array<int>").collect(), key=lambda r: (r.h, r.kind, r.lang))


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, epochs: int = 6, rate: float = 8.0, reject: float = 0.001) -> Model:
    """learn: which rows of docs may be learned from. Every fifth text of the sample only calibrates."""
    rows = _sample(docs, text, lang, learn, per_lang)
    languages = sorted({r.lang for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(7)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages))
    texts = [(number[r.lang], np.array(r.b), (np.array(r.n) / sum(r.n)).astype(np.float32), r.h % 5 == 0) for r in rows]
    fit, held = [x for x in texts if not x[3]] or texts, [x for x in texts if x[3]] or texts
    w += rng.normal(0, 0.1, w.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(fit)):
            y, b, f, _ = fit[k]
            x = f @ e[b]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = w @ p
            w -= 0.1 * step * np.outer(x, p)
            bias -= 0.01 * step * p
            e[b] -= step * np.outer(f, grad).astype(np.float32)
    table = (e @ w).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
    logits = np.array([f @ table[b] for _, b, f, _ in held]).reshape(len(held), len(languages))
    right = np.array([y for y, *_ in held], int)
    model = Model(languages, table, bias, 1.0, 0.0)
    best = np.inf
    for t in np.geomspace(0.25, 8, 41) if len(held) else ():
        model.temperature, was = float(t), model.temperature
        loss = -np.log(np.maximum(model.probabilities(logits)[np.arange(len(held)), right], 1e-12)).mean()
        if loss < best:
            best = loss
        else:
            model.temperature = was
    if len(held):
        p = model.probabilities(logits)
        ok = p.argmax(1) == right
        model.limit = min(0.5, float(np.quantile(p.max(1)[ok], reject))) if ok.any() else 0.5
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = kept.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            found, score = model.predict(batch.column(at).to_pylist())
            rejected = [f == "und" or s < model.limit for f, s in zip(found, score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "rejected"])

    d = docs.select(*kept)
    return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
