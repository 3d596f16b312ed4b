"""Language ID with a byte convolutional network: filters of several widths over byte
embeddings, max pooling and softmax, trained in numpy on labelled text and applied to
fixed-length windows that together cover each whole text."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyfield.llm.common import named, sliced

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"


@dataclass(frozen=True)
class CnnSettings:
    """Bounds and shape. max_docs: labelled rows that training takes at most (a hash order
    picks them); window: bytes of a window; widths, filters: filter widths, filters of each."""

    max_docs: int = 2400
    windows_per_doc: int = 4
    window: int = 256
    embedding: int = 8
    widths: tuple = (2, 3, 4)
    filters: int = 12
    steps: int = 500
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


class ByteCnn:
    """The network; all filters lie in one matrix of the widest filter's size."""

    def __init__(self, labels: list[str], settings: CnnSettings):
        rng = np.random.default_rng(settings.seed)
        self.labels, self.settings = labels, settings
        d, w, f = settings.embedding, max(settings.widths), settings.filters * len(settings.widths)
        self.mask = np.zeros((w * d, f), np.float32)
        for i, width in enumerate(settings.widths):
            self.mask[: width * d, i * settings.filters : (i + 1) * settings.filters] = 1
        self.p = {
            "emb": rng.normal(0, 0.5, (256, d)).astype(np.float32),
            "conv": rng.normal(0, 0.3, (w * d, f)).astype(np.float32) * self.mask,
            "bias": np.zeros(f, np.float32),
            "out": rng.normal(0, 0.1, (f, len(labels))).astype(np.float32),
            "base": np.zeros(len(labels), np.float32),
        }

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(rows, positions, widest filter * embedding) view of the embedded windows."""
        e = self.p["emb"][x]
        d, w = e.shape[2], max(self.settings.widths)
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), x.shape[1] - w + 1, w * d), (s[0], s[1], s[2]))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        c = self.columns(x)
        return (c.reshape(-1, c.shape[2]) @ self.p["conv"]).reshape(len(x), c.shape[1], -1).max(axis=1) + self.p["bias"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x), 0) @ self.p["out"] + self.p["base"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on balanced batches, so that a frequent language isn't favoured."""
        rng, s = np.random.default_rng(self.settings.seed + 1), self.settings
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        w, d = max(s.widths), s.embedding
        for step in range(1, s.steps + 1):
            pick = np.array([rng.choice(by[k]) for k in rng.integers(0, len(by), s.batch)])
            xb, yb = x[pick], y[pick]
            c = self.columns(xb)
            a = (c.reshape(-1, w * d) @ self.p["conv"]).reshape(s.batch, c.shape[1], -1)
            top = a.argmax(axis=1)
            pool = np.take_along_axis(a, top[:, None], axis=1)[:, 0] + self.p["bias"]
            h = np.maximum(pool, 0)
            z = h @ self.p["out"] + self.p["base"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(s.batch), yb] -= 1
            q /= s.batch
            dh = (q @ self.p["out"].T) * (pool > 0)
            at = c[np.arange(s.batch)[:, None], top]  # (batch, filters, w * d)
            g = {"out": h.T @ q, "base": q.sum(axis=0), "bias": dh.sum(axis=0), "conv": np.einsum("bf,bfk->kf", dh, at) * self.mask}
            de = np.einsum("bf,kf->bfk", dh, self.p["conv"]).reshape(s.batch, -1, w, d)
            g["emb"] = np.zeros_like(self.p["emb"])
            np.add.at(g["emb"], xb[np.arange(s.batch)[:, None, None], top[:, :, None] + np.arange(w)], de)
            for k, grad in g.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v2[k] = 0.999 * v2[k] + 0.001 * grad * grad
                self.p[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
                self.p[k] = self.p[k].astype(np.float32)


def windows_of(text: bytes, length: int) -> np.ndarray:
    """Windows that cover the whole text: side by side, the last one set back to the end; a
    shorter text is padded with zeros."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= length:
        return np.pad(b, (0, length - len(b)))[None]
    n = -(-len(b) // length)
    starts = np.minimum(np.arange(n) * length, len(b) - length)
    return b[starts[:, None] + np.arange(length)]


def is_held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id's text leaves 1 when divided by 3 (null: no)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def train_language_model(docs: DataFrame, settings: CnnSettings = CnnSettings()) -> ByteCnn | None:
    """Fit the network on rows with text and language that aren't held out.

    Every language has the same share of ``max_docs``, so that a rare one takes part with all its rows; within a
    language a hash of id and text picks rows, and the language's count sets the hash range that is read, so that
    the choice needs no sort of the texts. Windows are cut where the texts lie: at most ``max_docs`` times
    ``windows_per_doc`` windows come to the driver, and the count of each language. None if no row can be used.
    """
    usable = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    totals = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    labels = sorted(totals)
    quota = max(1, settings.max_docs // max(len(labels), 1))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    bound = F.lit(0)
    for k in labels:
        bound = F.when(F.col("lang") == k, int(min(1.0, 0.9 * quota / totals[k]) * (1 << 30))).otherwise(bound)
    size, most = settings.window, settings.windows_per_doc
    n = F.greatest(F.ceil(F.length("b") / size), F.lit(1))
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.pmod(F.xxhash64("h", i), n)))
    starts = F.when(n <= most, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(some)
    cut = F.transform(starts, lambda k: F.substr("b", (F.greatest(F.least(k * size, F.length("b") - size), F.lit(0)) + 1).cast("int"), F.lit(size)))
    chosen = usable.where(h < bound).select("lang", h.alias("h"), F.encode("text", "UTF-8").alias("b")).select("lang", "h", cut.alias("w"))
    rows = chosen.orderBy("h", "lang", "w").limit(settings.max_docs).collect()
    labels, x, y = sorted({r.lang for r in rows}), [], []
    for r in rows:
        for w in r.w:
            x.append(windows_of(bytes(w), size)[0])
            y.append(labels.index(r.lang))
    if not x:
        return None
    model = ByteCnn(labels, settings)
    model.train(np.stack(x), np.asarray(y))
    return model


def predict_language(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    The mean of the windows' probabilities decides; score is the winner's mean probability.
    Null texts, texts without a letter, and all texts where there is no model, are ``und`` with
    score 0. Ids, languages and sources are never inputs. Other columns are ignored; repeated
    rows give repeated results; an empty table gives no rows. A map over the rows; windows of a
    very long text are taken in blocks.
    """
    settings = model.settings if model else CnnSettings()
    block = 512

    def kernel(batches):
        for batch in sliced(batches):
            n = batch.num_rows
            ids = batch.column(0).to_pylist()
            pred, score = [UNDETERMINED] * n, [0.0] * n
            texts, letters = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            owners, parts, waiting = [], [], 0
            sums = np.zeros((n, len(model.labels) if model else 1))
            counts = np.zeros(n)

            def flush():
                x, who = np.concatenate(parts), np.concatenate(owners)
                for lo in range(0, len(x), block):
                    np.add.at(sums, who[lo : lo + block], model.probabilities(x[lo : lo + block]))
                np.add.at(counts, who, 1)
                parts.clear()
                owners.clear()

            for i, t in enumerate(texts):
                if model and t is not None and letters[i]:
                    w = windows_of(t.encode("utf-8", "surrogatepass"), settings.window)
                    parts.append(w)
                    owners.append(np.full(len(w), i))
                    waiting += len(w)
                    if waiting >= 4 * block:
                        flush()
                        waiting = 0
            if parts:
                flush()
            for i in np.flatnonzero(counts):
                mean = sums[i] / counts[i]
                k = int(mean.argmax())
                pred[i], score[i] = model.labels[k], float(min(1.0, mean[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([is_held_out(d) for d in ids], pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(kernel, SCHEMA)


def keep_determined(docs: DataFrame, model: ByteCnn | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: the text has a letter and the
    winner's mean probability is at least ``least``. Without a model a letter is enough."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    packed = docs.where(text.isNotNull() & text.rlike(r"\p{L}"))
    if model is None:
        return packed
    packed = packed.select(text.alias("text"), F.struct(*named(rest)).alias("rest"))
    schema = StructType().add("text", StringType()).add("rest", packed.schema["rest"].dataType)
    settings = model.settings

    def kernel(batches):
        for batch in sliced(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, t in enumerate(batch.column(0).to_pylist()):
                w = windows_of(t.encode("utf-8", "surrogatepass"), settings.window)
                total = sum(model.probabilities(w[lo : lo + 512]).sum(axis=0) for lo in range(0, len(w), 512))
                keep[i] = total.max() >= least * len(w)
            yield batch.filter(pa.array(keep))

    return packed.mapInArrow(kernel, schema).select(*(F.col("text") if c == "text" else named([c], "rest")[0] for c in docs.columns))
