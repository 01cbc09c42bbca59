"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its byte n-grams (``orders``) that hold a byte above 0x40, folded to lower case in
ASCII and hashed into ``2 ** bits`` rows of an embedding table. The text's vector is the mean of its rows; a
linear layer and a softmax give the languages. Scoring uses the product of table and layer (one small row of
logits for each hash), which is the same linear map.

The softmax has one class more than there are languages: text that is none of them, trained on the languages' own pieces with
their bytes in random order. Probabilities are calibrated by a temperature fitted (with Platt's smoothed targets, so that it is
determined even where all are right) on documents that training did not use, and on shuffled ones. A text is rejected if its best language's
probability is below a floor midway between what ``reject_rate`` of the calibration documents fall under and what all but one in a hundred of the
shuffled ones do.

The fit uses a bounded sample of labelled rows: the ``sample`` rows with the smallest hash of doc_id (default
1500), of each at most ``pieces`` pieces of ``piece`` bytes, evenly spread over the text; they are cut on the executors, so
``sample * pieces * piece`` bytes (7 MB) reach the driver at most. Everything else covers all rows and whole texts.

Defined cases: null text and text without any letter are ``und`` with score 0 and rejected; rows without a
lang never train; if nothing can be learned from, every text is ``und``; repeated rows are scored alike; a null doc_id counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import byte_slices

HASH = np.uint32(2654435761)


def features(data: np.ndarray, bits: int, orders: tuple[int, ...] = (2, 3, 4)):
    """For each n-gram order: the hash of the n-gram at each byte (shorter at the end) and whether it counts."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    letter = low >= 0x61
    out, h = [], np.zeros(len(low), np.uint32)
    some = np.zeros(len(low), bool)
    for n in range(1, max(orders) + 1):
        m = len(low) - n + 1
        if m <= 0:
            break
        h = (h[:m] + low[n - 1 :] + np.uint32(n)) * HASH
        h ^= h >> np.uint32(15)
        some = some[:m] | letter[n - 1 :]
        if n in orders:
            out.append((h >> np.uint32(32 - bits), some))
    return out


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # one row for each hash; the last column is no language
    bias: np.ndarray
    bits: int
    temperature: float
    floor: float

    def mean_logits(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Mean logits of each text, from the bytes of all texts."""
        n = len(offsets) - 1
        sums, counts = np.zeros((n, self.logits.shape[1])), np.zeros(n)
        for i in range(n):
            for lo in range(int(offsets[i]), int(offsets[i + 1]), step):
                hi = min(int(offsets[i + 1]), lo + step)
                for ids, some in features(data[lo : min(hi + 3, int(offsets[i + 1]))], self.bits):
                    rows = np.bincount(ids[some], minlength=1 << self.bits) if len(ids) > 1 << self.bits else None
                    if rows is None:
                        sums[i] += self.logits.take(ids[some], axis=0).sum(axis=0, dtype=np.float64)
                        counts[i] += np.count_nonzero(some)
                    else:
                        sums[i] += rows @ self.logits
                        counts[i] += rows.sum()
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def grams_of(piece: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a piece and the share of each among its features."""
    found = [x[some] for x, some in features(piece, bits)]
    flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
    ids, counts = np.unique(flat, return_counts=True)
    return ids.astype(np.int64), (counts / max(1, len(flat))).astype(np.float32)


def train(texts: list[list[bytes]], langs: list[str], bits: int = 16, dim: int = 16, epochs: int = 3, rate: float = 0.5, reject_rate: float = 0.001, seed: int = 7, least_steps: int = 600) -> Model:
    """SGD over pieces of the texts (a list of pieces each), in mini-batches; one text in eight is held back for calibration."""
    names = sorted(set(langs))
    other = len(names)
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 8 == 7
    rows, target = [], []
    for parts, y, h in zip(texts, langs, held):
        for t in parts if not h else ():
            data = np.frombuffer(t, np.uint8)
            rows.append(grams_of(data, bits))
            target.append(names.index(y))
            if len(rows) % 5 == 0:  # a fifth of them once more, in disorder
                rows.append(grams_of(data[rng.permutation(len(data))], bits))
                target.append(other)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, other + 1)).astype(np.float32)
    bias = np.zeros(other + 1, np.float32)
    target = np.array(target, np.int64)
    epochs = max(epochs, -(-32 * least_steps // max(1, len(rows)))) if rows else 0  # small tables are seen more often
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            batch = order[lo : lo + 32]
            mean = np.stack([w @ table[ids] for ids, w in (rows[i] for i in batch)])
            z = mean @ layer + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = z / z.sum(axis=1, keepdims=True)
            grad[np.arange(len(batch)), target[batch]] -= 1
            lr = rate * (1 - done / steps)
            back = lr * 8 * (grad @ layer.T)
            layer -= lr * (mean.T @ grad) / len(batch) * 8
            bias -= lr * grad.mean(axis=0)
            for i, g in zip(batch, back):
                ids, w = rows[i]
                table[ids] -= w[:, None] * g
            done += len(batch)
    model = Model(names, (table @ layer).astype(np.float32), bias.astype(np.float64), bits, 1.0, 0.0)
    probe = [b" ".join(parts) for parts, h in zip(texts, held) if h]
    truth = np.array([names.index(y) for y, h in zip(langs, held) if h] + [other] * len(probe), np.int64)
    probe += [d[rng.permutation(len(d))].tobytes() for t in probe for d in [np.frombuffer(t, np.uint8)]]
    if probe:
        calibrate(model, probe, truth, reject_rate)
    return model


def calibrate(model: Model, texts: list[bytes], truth: np.ndarray, reject_rate: float) -> None:
    """Set temperature and floor by texts that training did not use; a truth beyond the languages is none of them."""
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    logits, other = model.mean_logits(data, at), len(model.langs)
    smooth = 1 / (len(texts) + 2)

    def loss(temperature):
        model.temperature = temperature
        p = np.log(np.maximum(model.probabilities(logits), 1e-300))
        own = p[np.arange(len(truth)), truth]
        return -((1 - smooth) * own + smooth * (p.sum(axis=1) - own) / other).mean()

    model.temperature = float(min(np.geomspace(0.005, 5, 140), key=loss))
    score = model.probabilities(logits)[:, :other].max(axis=1)
    good, none = score[truth < other], score[truth == other]
    high = float(np.quantile(good, reject_rate)) if len(good) else 0.5
    low = float(np.quantile(none, 0.99)) if len(none) else 0.0
    model.floor = (low + high) / 2 if low < high else high * 0.999


def fit(docs: DataFrame, sample: int = 1500, pieces: int = 8, piece: int = 600, **options) -> Model | None:
    """Fit on at most ``sample`` labelled rows of ``docs`` (doc_id, text, lang) whose crc32(doc_id) mod 5 is not 0."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # the threshold on the hash comes from a count, so that the sort handles about ``sample`` rows, whatever the table's size
    n = rows.select("doc_id").count()
    if not n:
        return None
    h = F.abs(F.xxhash64("doc_id", F.lit(11)) % F.lit(1 << 40))
    near = rows.where(h <= F.lit(int(min(1, 1.2 * sample / n + 50 / n) * (1 << 40)))).select(h.alias("h"), "doc_id", "lang", F.xxhash64("text").alias("t"), "text")

    def cut(batches):
        for b in batches:
            out = []
            for t in b.column(4):
                raw = t.as_py().encode()
                k = max(1, -(-len(raw) // piece))
                some = range(k) if k <= pieces else sorted({j * (k - 1) // (pieces - 1) for j in range(pieces)} if pieces > 1 else {0})
                out.append([raw[j * piece : (j + 1) * piece] for j in some])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.list_(pa.binary()))], names=["h", "doc_id", "lang", "t", "parts"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    got = near.mapInArrow(cut, f"h long, doc_id {doc_id}, lang string, t long, parts array<binary>").orderBy("h", "doc_id", "lang", "t").limit(sample).collect()
    return train([[bytes(x) for x in r.parts] for r in got], [r.lang for r in got], **options)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` (any columns, text among them) with three more columns; columns of ``docs`` that have their names are replaced."""
    docs = docs.drop(*names)
    import regex
    from pyspark.sql import types as T

    letter = regex.compile(r"\p{L}")

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            lang, score, rejected = [], [], []
            data, at = byte_slices(texts.fill_null(""))
            for lo in range(0, b.num_rows, 256):
                hi = min(b.num_rows, lo + 256)
                p = model.probabilities(model.mean_logits(data, at[lo : hi + 1])) if model else None
                for i in range(lo, hi):
                    t = texts[i].as_py()
                    if p is None or t is None or not letter.search(t):
                        lang.append("und")
                        score.append(0.0)
                        rejected.append(True)
                    else:
                        best = int(p[i - lo][: len(model.langs)].argmax())
                        lang.append(model.langs[best])
                        score.append(float(min(1.0, p[i - lo][best])))
                        rejected.append(score[-1] < model.floor)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names, *names])

    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(run, out)
