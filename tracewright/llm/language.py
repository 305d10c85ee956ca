"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._shared import in_fold, slices, small_batches

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
DIM = 16
#: About how many labelled rows a model is fitted on, at most twice as many; those with the smallest hashes of their id.
SAMPLE = 4000
#: Characters of the longest text that is fitted on, so what the sample may hold is bounded.
LONGEST = 20_000
UNKNOWN = "und"

_at = np.arange(256)
_FOLD = np.where((_at >= 128) | ((_at >= 97) & (_at <= 122)), _at, 32).astype(np.uint32)


def _subwords(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Byte offsets of the texts, and for each order the buckets of all windows and which of them count. Everything but
    letters is a blank; windows of blanks alone do not count."""
    raw = [b" " + t.lower().encode() + b" " if t else b"  " for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    b = np.append(_FOLD[np.frombuffer(b"".join(raw), np.uint8)], np.full(max(ORDERS), 32, np.uint32))
    n, out = int(at[-1]), []
    value, some = b[:n].copy(), b[:n] != 32
    for order in range(2, max(ORDERS) + 1):
        value = (value << np.uint32(8)) | b[order - 1:n + order - 1]
        some = some | (b[order - 1:n + order - 1] != 32)
        if order in ORDERS:
            h = (value + np.uint32(order)) * np.uint32(0x9E3779B1)
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(17), some))
    return at, out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket (one more: nothing), the product of embeddings and softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        at, orders = _subwords(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for h, some in orders:
            total += np.add.reduceat(self.table[np.where(some, h, BUCKETS)], at[:-1], axis=0, dtype=np.float64)
            count += np.add.reduceat(some, at[:-1], dtype=np.int64)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its calibrated probability."""
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 2.0, seed: int = 1) -> Model | None:
    """Every fifth row calibrates: the temperature has the least log loss there, and the rejection threshold lies under
    all but one in a thousand of the right answers (never above 0.5)."""
    if not texts:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rows = []
    for a, b in slices(texts):
        at, orders = _subwords(texts[a:b])
        for i in range(b - a):
            h = np.concatenate([h[at[i]:at[i + 1]][s[at[i]:at[i + 1]]] for h, s in orders])
            u, c = np.unique(h, return_counts=True)
            rows.append((u, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    learn = np.flatnonzero(~held)
    size = 32
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for k in range(0, len(order), size):
            pick = order[k:k + size]
            used = np.unique(np.concatenate([rows[i][0] for i in pick]))
            x = np.zeros((len(pick), len(used)), np.float32)
            for r, i in enumerate(pick):
                x[r, np.searchsorted(used, rows[i][0])] = rows[i][1]
            mean = x @ e[used]
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = p @ w.T
            w -= step * (mean.T @ p)
            bias -= step * 0.1 * p.sum(axis=0)
            e[used] -= step * 20 * (x.T @ back)
    model = Model(languages, np.vstack([e @ w, np.zeros((1, len(languages)), np.float32)]).astype(np.float32), bias.astype(np.float64))
    if held.any():
        check = [i for i in np.flatnonzero(held)]
        z = np.vstack([model.logits([texts[i] for i in check[a:a + 64]]) for a in range(0, len(check), 64)])
        right = y[check]

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(right)), right]))

        model.temperature = min(np.geomspace(0.2, 5, 41), key=loss)
        s = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        good = s.max(axis=1)[s.argmax(axis=1) == right]
        model.threshold = float(min(0.5, np.quantile(good, 0.001))) if len(good) else 0.0
    return model


def train(docs: DataFrame, sample: int = SAMPLE, modulus: int = 4, held_out: int = 2) -> Model | None:
    """Fits on about ``sample`` labelled rows outside the held-out fold (never over twice as many): the share of rows with
    the smallest hashes, of texts of at most LONGEST characters. The rows are counted first, so no task sends more than its
    share. Rows with a null text, lang or doc_id are not fitted on; without any the model is None."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= LONGEST) & F.coalesce(~in_fold("doc_id", modulus, held_out), F.lit(False)))
    share = min(1.0, sample / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    got = sorted(rows.filter(drawn).select("text", "lang").limit(2 * sample).collect())
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (calibrated probability) and ``rejected`` to the columns of ``docs`` (its own columns of
    these names go).

    Null text, text without a letter, or no model: ``und``, score 0, rejected. A known language with a score under the
    model's threshold is rejected too.
    """
    import regex

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*kept)
    small_batches(docs.sparkSession)
    letter = regex.compile(r"\p{L}").search
    place = kept.index("text")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                ok = np.array([bool(model and t and letter(t)) for t in part])
                which, score = model.predict(part) if ok.any() else (np.zeros(len(part), int), np.zeros(len(part)))
                score = np.where(ok, score, 0.0)
                names = [model.languages[w] if o else UNKNOWN for w, o in zip(which, ok, strict=True)]
                low = ~ok if model is None else ~ok | (score < model.threshold)
                chunk = batch.slice(a, b - a)
                yield pa.record_batch([*chunk.columns, pa.array(names, pa.string()), pa.array(score), pa.array(low)], names=[*kept, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(guess, schema)


def predict_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; trained and applied on the same table.

    Null, empty and letterless texts are ``und`` with score 0. Repeated rows give a row each and the same answer; ties go to the
    language that comes first by name; long texts are read whole; an empty table gives no rows; other columns do not matter.
    A null doc_id is in no fold.
    """
    out = identify(docs.select("doc_id", "text"), train(docs, sample))
    return out.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
