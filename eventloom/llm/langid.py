"""Language identification by a byte convolutional network: several widths, max pooling, softmax; trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 4
LENGTH = 256  # bytes of a window; windows overlap by the widest filter less one, so no sequence is cut
SAMPLE, WINDOWS = 600, 6  # training documents a language, about; windows of each
SHORTENED = 0.4  # share of training windows cut to a random length
UNKNOWN = "und"
_FOLD = bytes(range(256)).lower()


@dataclass
class Net:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # (width * EMBED) x FILTERS each
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray, keep: bool = False):
        """Max over positions of every filter, at least 0; with ``keep`` also what training needs."""
        vectors = self.embed[windows]
        parts, kept = [], []
        for width, f, b in zip(WIDTHS, self.filters, self.offsets):
            n = windows.shape[1] - width + 1
            view = np.lib.stride_tricks.sliding_window_view(vectors, width, axis=1)[:, :n].transpose(0, 1, 3, 2)
            columns = view.reshape(len(windows) * n, width * EMBED)
            response = (columns @ f).reshape(len(windows), n, FILTERS)
            if keep:
                at = response.argmax(axis=1)
                parts.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + b)
                kept.append((columns.reshape(len(windows), n, -1), at))
            else:
                parts.append(response.max(axis=1) + b)
        return np.maximum(np.concatenate(parts, axis=1), 0), kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[0] @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(body: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Whole text as overlapping windows padded with zeros, and the bytes that each adds."""
    data = np.frombuffer(body.translate(_FOLD), np.uint8)
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + length, np.uint8)
    padded[:len(data)] = data[:len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)[::step]
    sizes = np.full(n, step, np.float64)
    sizes[-1] = max(1, len(data) - step * (n - 1))
    return windows, sizes


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    k, f32 = len(languages), np.float32
    net = Net(languages, rng.normal(0, 0.5, (256, EMBED)).astype(f32), [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(f32) for w in WIDTHS],
              [np.zeros(FILTERS, f32) for _ in WIDTHS], rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)).astype(f32), np.zeros(k, f32))
    params = [net.embed, *net.filters, *net.offsets, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at:at + batch]].copy(), labels[order[at:at + batch]]
            ends = np.where(rng.random(len(x)) < SHORTENED, rng.integers(8, LENGTH, len(x)), LENGTH)  # some windows hold a short text
            x[np.arange(LENGTH)[None] >= ends[:, None]] = 0
            hidden, kept = net.pooled(x, keep=True)
            z = hidden @ net.out + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (hidden > 0)
            grads = [np.zeros_like(net.embed)]
            filters, offsets = [], []
            for w, (width, f) in enumerate(zip(WIDTHS, net.filters)):
                columns, best = kept[w]
                g = back[:, w * FILTERS:(w + 1) * FILTERS]
                chosen = np.take_along_axis(columns, best[:, :, None], axis=1)  # window x filter x (width * EMBED)
                filters.append(np.einsum("bf,bfc->cf", g, chosen))
                offsets.append(g.sum(axis=0))
                spread = (g[:, :, None] * f.T[None]).reshape(len(x), FILTERS, width, EMBED)
                places = best[:, :, None] + np.arange(width)
                octets = np.take_along_axis(x, places.reshape(len(x), -1), axis=1).reshape(places.shape)
                np.add.at(grads[0], octets, spread)
            grads += [*filters, *offsets, hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g ** 2
                q -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(f32)
    return net


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, windows: int = WINDOWS) -> Net:
    """A network from the rows of ``docs`` with an id, a text and a language, about ``sample`` documents a language (chosen by hash of the
    id) and at most ``windows`` windows of each; only those windows reach the driver. Without such a row the network has no languages,
    and ``predict`` gives ``und`` with score 0."""
    rows = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).cast("binary").alias("body"), (F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)).alias("at"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Net([], np.zeros((256, EMBED), np.float32), [], [], np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    languages = sorted(counts)
    share = F.element_at(F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(min(1.0, sample / counts[c])))]), F.col("lang"))

    def cut(batches):
        for batch in batches:
            names, parts = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got, sizes = windows_of(body)
                got = got[sizes >= min(64, sizes.max())]
                for w in got[np.linspace(0, len(got) - 1, min(windows, len(got))).astype(int)]:
                    names.append(name)
                    parts.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], names=["lang", "window"])

    got = rows.where(F.col("at") < share).select("lang", "body").mapInArrow(cut, "lang string, window binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in got), np.uint8).reshape(-1, LENGTH)
    return train(x, np.array([languages.index(r["lang"]) for r in got]), languages)


def predict(docs: DataFrame, net: Net, text: str = "text", block: int = 512) -> DataFrame:
    """``docs`` with lang_pred and score, replaced where they exist, from the whole text alone.

    Windows of many documents go through the network in blocks of ``block``; a document's score is the mean probability of its best
    language over its windows, weighted by their bytes. Null texts and texts without a letter are ``und`` with score 0, and so are all
    texts if the network has no languages. Rows are independent and nothing is shuffled.
    """
    if not net.languages:
        return docs.select(*[named(c) for c in docs.columns if c not in ("lang_pred", "score")], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("lang_pred string, score double")
    def identify(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        own = Net(**state)
        n, k = len(texts), len(own.languages)
        sums, weights = np.zeros((n, k)), np.zeros(n)
        held: list = []
        count = 0

        def flush():
            nonlocal held, count
            if held:
                who = np.concatenate([np.full(len(w), i) for i, w, _ in held])
                x, sizes = np.concatenate([w for _, w, _ in held]), np.concatenate([s for _, _, s in held])
                for at in range(0, len(x), block):
                    p = own.probabilities(x[at:at + block]) * sizes[at:at + block, None]
                    np.add.at(sums, who[at:at + block], p)
                np.add.at(weights, who, sizes)
            held, count = [], 0

        for i, (t, letters) in enumerate(zip(texts, lettered.to_pylist())):
            if letters:
                got, sizes = windows_of(t.as_buffer().to_pybytes())
                held.append((i, got, sizes))
                count += len(got)
                if count >= 4 * block:
                    flush()
        flush()
        mean = sums / np.maximum(weights, 1e-9)[:, None]
        best = mean.argmax(axis=1)
        known = weights > 0
        return pa.StructArray.from_arrays([pa.array([own.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())], pa.string()),
                                           pa.array(np.clip(np.where(known, mean[np.arange(n), best], 0.0), 0, 1))], names=["lang_pred", "score"])

    state = dict(net.__dict__)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # a filter on the result must not make the network run twice
    out = docs.withColumn("__llm_lang", identify.asNondeterministic()(F.col(text).cast("binary"), letters))
    return out.select(*[named(c) for c in docs.columns if c not in ("lang_pred", "score")], "__llm_lang.lang_pred", "__llm_lang.score")
