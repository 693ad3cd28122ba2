"""Language identification with a bidirectional gated recurrent network over bytes.

The network (numpy only) reads the UTF-8 bytes of a text in stretches of
``STRETCH`` bytes, forwards and backwards, labels every position with
probabilities of the languages, and a document's probabilities are the mean
over all its positions: whole texts, no prefixes. It is trained by
backpropagation through time on a sample of at most ``PER_LANGUAGE`` different
labelled texts of each language and about ``SAMPLE_TEXTS`` of all (at least one of each
language), the documented bounds of what comes to the driver. Prediction is a scan with the weights, which are
a few kilobytes, in the function.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without any labelled document everything is ``und``; null ids are carried;
repeated rows are predicted once each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PER_LANGUAGE = 300     # sampled texts of a language
SAMPLE_TEXTS = 300 * 64  # sampled texts of all languages
SAMPLE_BYTES = 2048    # of a sampled text, from a place chosen by hash
HIDDEN = 8
EMBEDDING = 8
STRETCH = 128
TRAIN_STRETCH = 32
STEPS = 250
BATCH = 256
LEARNING_RATE = 0.02
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """True for the documents of the held-out quarter."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, label_ok: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` different labelled texts of each language, chosen by hash of the text, cut to a stretch of each.

    Copies of a text count and are taken once; null and empty texts don't count. The
    languages' counts (one small row each) give a share of hash values that
    holds about twice the limit, so what is shuffled and ranked stays bounded
    however many tasks read the table. A language of up to twice the limit is
    ranked whole. With very many languages each gives fewer texts.
    """
    text = common.text_of(text_col)
    rows = docs.where(label_ok & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h")
    ).where(F.length("text") > 0)
    counts = common.materialise(rows.select("lang", "h").distinct().groupBy("lang").count(), "lang-counts")
    per_language = min(per_language, max(1, SAMPLE_TEXTS // max(1, counts.count())))
    # At least 50 texts are expected, so that no language misses its share by chance.
    share = F.least(F.lit(1.0), F.lit(max(2.0 * per_language, 50.0)) / F.col("count"))
    rows = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(
        F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))
    )
    at = F.expr(f"cast(pmod(h, greatest(length(text) - {SAMPLE_BYTES // 2}, 1)) AS int) + 1")
    cut = rows.select("lang", "h", F.substring("text", at, F.lit(SAMPLE_BYTES)).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return cut.withColumn("n", first).where(F.col("n") <= per_language).drop("n").orderBy("lang", "h")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Bidirectional GRU; ``weights`` is a dict of float32 arrays."""

    def __init__(self, weights: dict[str, np.ndarray], languages: list[str]) -> None:
        self.w, self.languages = weights, languages

    @staticmethod
    def fresh(languages: list[str], seed: int = 7) -> ByteGRU:
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        w = {"emb": draw(256, EMBEDDING, scale=0.5)}
        for d in ("f", "b"):
            w[f"x{d}"] = draw(EMBEDDING, 3 * HIDDEN, scale=EMBEDDING**-0.5)
            w[f"h{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            w[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        w["out"] = draw(2 * HIDDEN, len(languages), scale=HIDDEN**-0.5)
        w["bias"] = np.zeros(len(languages), np.float32)
        return ByteGRU(w, languages)

    def _scan(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of one direction over bytes (time, batch)."""
        table = self.w["emb"] @ self.w[f"x{d}"] + self.w[f"c{d}"]  # input part of each byte's gates
        rec = np.ascontiguousarray(self.w[f"h{d}"])
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        tape = []
        n = HIDDEN
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            gx = table[x[t]]
            zr = _sigmoid(gx[:, :2 * n] + h @ rec[:, :2 * n])
            z, r = zr[:, :n], zr[:, n:]
            rh = r * h
            c = np.tanh(gx[:, 2 * n:] + rh @ rec[:, 2 * n:])
            new = h + z * (c - h)
            if keep:
                tape.append((t, h, z, r, rh, c))
            h = new
            states[t] = h
        return states, tape

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """As ``_scan``, for prediction: contiguous gates, halves folded into the weights, in-place steps."""
        n = HIDDEN
        table = self.w["emb"] @ self.w[f"x{d}"] + self.w[f"c{d}"]
        tz, tr, tc = (np.ascontiguousarray(table[:, i * n:(i + 1) * n] * k) for i, k in ((0, 0.5), (1, 0.5), (2, 1)))
        wz, wr, wc = (np.ascontiguousarray(self.w[f"h{d}"][:, i * n:(i + 1) * n] * 0.5) for i in range(3))
        h = np.zeros((x.shape[1], n), np.float32)
        z, r, c = np.empty_like(h), np.empty_like(h), np.empty_like(h)
        states = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            np.matmul(h, wz, out=z)
            z += tz.take(x[t], axis=0)
            np.tanh(z, out=z)  # sigmoid(2a) = (1 + tanh(a)) / 2
            np.matmul(h, wr, out=r)
            r += tr.take(x[t], axis=0)
            np.tanh(r, out=r)
            r += 1
            r *= h
            np.matmul(r, wc, out=c)
            c += tc.take(x[t], axis=0)
            np.tanh(c, out=c)
            c -= h
            z += 1
            c *= z
            c *= 0.5
            h += c
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(language, time, batch) of bytes (time, batch)."""
        x = x.astype(np.intp)
        logits = self.w["out"][:HIDDEN].T @ self._states(x, "f").reshape(-1, HIDDEN).T
        logits += self.w["out"][HIDDEN:].T @ self._states(x, "b").reshape(-1, HIDDEN).T
        logits += self.w["bias"][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(len(self.languages), *x.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions, and its gradient by backpropagation through time."""
        w, n = self.w, HIDDEN
        sf, tf = self._scan(x, "f", True)
        sb, tb = self._scan(x, "b", True)
        both = np.concatenate([sf, sb], axis=2)
        logits = both @ w["out"] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(x.shape[1])
        loss = -float(np.log(p[:, rows, y] + 1e-9).mean())
        p[:, rows, y] -= 1
        p /= x.size
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = np.einsum("tbh,tbl->hl", both, p, optimize=True)
        g["bias"] = p.sum(axis=(0, 1))
        dstates = p @ w["out"].T
        demb_rows = np.zeros((256, EMBEDDING), np.float32)
        for d, tape, part in (("f", tf, dstates[:, :, :n]), ("b", tb, dstates[:, :, n:])):
            rec, win = w[f"h{d}"], w[f"x{d}"]
            dh = np.zeros((x.shape[1], n), np.float32)
            dtable = np.zeros((256, 3 * n), np.float32)
            for t, h, z, r, rh, c in reversed(tape):
                dh = dh + part[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ rec[:, 2 * n:].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g[f"h{d}"][:, 2 * n:] += rh.T @ dc
                g[f"h{d}"][:, :2 * n] += h.T @ dzr
                np.add.at(dtable, x[t], np.concatenate([dzr, dc], axis=1))
                dh = dh * (1 - z) + drh * r + dzr @ rec[:, :2 * n].T
            g[f"c{d}"] = dtable.sum(axis=0)
            g[f"x{d}"] = w["emb"].T @ dtable
            demb_rows += dtable @ win.T
        g["emb"] = demb_rows
        return loss, g


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> ByteGRU:
    """Train on stretches drawn evenly over the languages (Adam); the same input gives the same weights."""
    languages = sorted(set(labels))
    model = ByteGRU.fresh(languages, seed)
    rng = np.random.default_rng(seed)
    by_lang = [
        np.frombuffer(b"\n".join(t for t, l in zip(texts, labels) if l == lang) + b" " * TRAIN_STRETCH, np.uint8)
        for lang in languages
    ]
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        x = np.empty((TRAIN_STRETCH, BATCH), np.uint8)
        for j, lang in enumerate(y):
            at = rng.integers(0, len(by_lang[lang]) - TRAIN_STRETCH + 1)
            x[:, j] = by_lang[lang][at:at + TRAIN_STRETCH]
        _, g = model.gradients(x, y)
        rate = LEARNING_RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in model.w.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def predict(model: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities (document, language); every byte is labelled once."""
    sums = np.zeros((len(texts), len(model.languages)))
    width = max(1, 1024 * 64 // max(64, len(model.languages)))  # bounds the probabilities in memory
    x = np.full((width, STRETCH), 32, np.uint8)
    owner, length = np.zeros(width, int), np.zeros(width, int)
    used = 0

    def flush() -> None:
        nonlocal used
        if used:
            p = model.probabilities(np.ascontiguousarray(x[:used].T))
            real = np.arange(STRETCH)[:, None] < length[None, :used]
            p *= real
            np.add.at(sums, owner[:used], p.sum(axis=1).T)
            x[:] = 32
            used = 0

    for i, text in enumerate(texts):
        for at in range(0, len(text), STRETCH):
            part = text[at:at + STRETCH]
            x[used, :len(part)] = np.frombuffer(part, np.uint8)
            owner[used], length[used] = i, len(part)
            used += 1
            if used == len(x):
                flush()
    flush()
    return sums / np.maximum(1, [[len(t)] for t in texts]) if texts else sums


def identify(
    docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    common.small_batches(docs.sparkSession)
    keep = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), common.text_of(text_col).alias("text"))
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lettered = [any(map(str.isalpha, t)) for t in batch["text"]]
            if model is None:
                lettered = [False] * len(batch)
            lang, score = [UNKNOWN] * len(batch), [0.0] * len(batch)
            todo = [i for i, ok in enumerate(lettered) if ok]
            if todo:
                texts = batch["text"].tolist()
                p = predict(model, [texts[i].encode() for i in todo])
                for i, row in zip(todo, p):
                    k = int(row.argmax())
                    lang[i], score[i] = model.languages[k], round(min(1.0, max(0.0, float(row[k]))), 6)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": lang, "score": score})

    return rows.mapInPandas(run, schema).select(F.col("id").cast(keep).alias("doc_id"), "lang_pred", "score")


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, label_ok: Column) -> ByteGRU | None:
    """Train on the bounded sample; None if no labelled document is there."""
    sample = training_sample(docs, id_col, text_col, lang_col, label_ok).collect()
    if not sample:
        return None
    return train([r["text"].encode() for r in sample], [r["lang"] for r in sample])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those outside the held-out quarter."""
    docs = common.read_table(spark, sf_dir, "documents")
    model = fit(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id")))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
