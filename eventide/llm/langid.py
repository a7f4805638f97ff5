"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
maximum over the window, and a softmax over the pooled features gives the languages. All windows of a
whole text are scored; a document's probabilities are the mean over its windows, weighted by their bytes.

Training needs a bounded sample of labelled text only: about ``per_label`` windows of each language, or all where there are
fewer. Every window of every labelled row has the same chance within its language, by a hash of its text and place, and is
drawn where it lies; equal windows count once, so copies do not fill the sample, and only windows of fixed length reach
the driver. Every language that labels any text is learned.

Defined results: null, empty and letterless texts are ``und`` with score 0; without labelled rows every
text is ``und``; repeated rows give repeated results; ties go to the first language in sorted order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import buffered, emit, slices

UNDETERMINED = "und"
_WIDTHS = (2, 3, 4)
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class ByteConvNet:
    """Weights: embedding (257, dim; row 256 pads), filters (max width * dim, K), head (K, L), bias (L)."""

    labels: tuple[str, ...]
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray
    window: int

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(codes, bytes in each window): fixed-length windows of the whole text, the last one padded."""
        codes = _codes(data, self.window)
        sizes = np.full(len(codes), self.window, dtype=np.float64)
        sizes[-1] = len(data) - (len(codes) - 1) * self.window
        return codes, sizes

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context rows, filter responses) of a batch of windows: (B, P, width * dim) and (B, P, K)."""
        x = self.embedding[codes]
        b, n, d = x.shape
        w = _WIDTHS[-1]
        flat = x.reshape(b, n * d)
        s = flat.strides
        ctx = np.lib.stride_tricks.as_strided(flat, (b, n - w + 1, w * d), (s[0], d * s[1], s[1]))
        ctx = np.ascontiguousarray(ctx)
        return ctx, (ctx.reshape(-1, w * d) @ self.filters).reshape(b, n - w + 1, -1)

    def probabilities(self, codes: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(codes), len(self.labels)), dtype=np.float64)
        for at in range(0, len(codes), batch):
            _, h = self.pooled(codes[at : at + batch])
            z = np.tanh(h.max(axis=1) + self.filter_bias) @ self.head + self.head_bias
            out[at : at + batch] = _softmax(z.astype(np.float64))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _codes(data: bytes, window: int) -> np.ndarray:
    n = max(1, -(-len(data) // window))
    codes = np.full(n * window, 256, dtype=np.int16)
    codes[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return codes.reshape(n, window)


def fit(windows: list[bytes], labels: list[str], window: int = 256, dim: int = 4, per_width: int = 12, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Adam on the cross-entropy of windows; classes are weighted to equal shares."""
    rng = np.random.default_rng(seed)
    names = tuple(sorted(set(labels)))
    w, k = _WIDTHS[-1], per_width * len(_WIDTHS)
    mask = np.zeros((w * dim, k), dtype=np.float32)  # a filter of width v sees the first v positions
    for i, v in enumerate(_WIDTHS):
        mask[: v * dim, i * per_width : (i + 1) * per_width] = 1
    p = {
        "embedding": rng.normal(0, 0.5, (257, dim)).astype(np.float32),
        "filters": (rng.normal(0, 0.5, (w * dim, k)) * mask).astype(np.float32),
        "filter_bias": np.full(k, -1, dtype=np.float32),
        "head": rng.normal(0, 0.3, (k, len(names))).astype(np.float32),
        "head_bias": np.zeros(len(names), dtype=np.float32),
    }
    net = ByteConvNet(names, p["embedding"], p["filters"], p["filter_bias"], p["head"], p["head_bias"], window)
    if len(names) < 2:
        return net
    number = {name: i for i, name in enumerate(names)}
    codes, target = np.concatenate([_codes(w, window) for w in windows]), np.array([number[label] for label in labels])
    weight = (len(target) / (len(names) * np.maximum(1, np.bincount(target, minlength=len(names)))))[target]
    m = {n: np.zeros_like(v) for n, v in p.items()}
    v2 = {n: np.zeros_like(v) for n, v in p.items()}
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(target)), max(1, len(target) // batch)):
            x, y, g = codes[rows], target[rows], {}
            ctx, h = net.pooled(x)
            at = h.argmax(axis=1)
            a = np.tanh(np.take_along_axis(h, at[:, None, :], 1)[:, 0] + p["filter_bias"])
            dz = _softmax(a @ p["head"] + p["head_bias"])
            dz[np.arange(len(y)), y] -= 1
            dz = (dz * weight[rows, None] / len(y)).astype(np.float32)
            g["head"], g["head_bias"] = a.T @ dz, dz.sum(0)
            da = (dz @ p["head"].T) * (1 - a * a)
            g["filter_bias"] = da.sum(0)
            best = ctx[np.arange(len(y))[:, None], at]  # (B, K, width * dim)
            g["filters"] = np.einsum("bk,bkc->ck", da, best) * mask
            back = (da[:, :, None] * p["filters"].T[None]).reshape(len(y), k, w, dim)
            seen = x[np.arange(len(y))[:, None, None], at[:, :, None] + np.arange(w)]
            g["embedding"] = np.zeros_like(p["embedding"])
            np.add.at(g["embedding"], seen.ravel(), back.reshape(-1, dim))
            step += 1
            lr = rate * (1 - 0.8 * epoch / max(1, epochs - 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n in p:  # in place: net shares these arrays
                m[n] += 0.1 * (g[n] - m[n])
                v2[n] += 0.001 * (g[n] ** 2 - v2[n])
                p[n] -= (lr * m[n] / (np.sqrt(v2[n]) + 1e-8)).astype(np.float32)
    return net


def _draw(share: dict[str, float], window: int):
    """Windows of labelled texts, each with its language's share as its chance."""
    import xxhash

    def run(batches):
        def rows():
            for b in slices(batches, 1024):
                for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    n = -(-len(data) // window)
                    chance = np.random.default_rng(xxhash.xxh64_intdigest(data)).random(n)
                    for i in np.flatnonzero(chance < share[label]).tolist():
                        yield label, data[i * window : (i + 1) * window]

        yield from buffered(rows(), pa.schema([("label", pa.string()), ("window", pa.binary())]))

    return run


def labelled_windows(df: DataFrame, text_col: str, label_col: str, per_label: int, window: int) -> tuple[list[bytes], list[str]]:
    """Distinct windows of labelled texts and their labels: about ``per_label`` of each label, or all where there are fewer."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull() & (F.octet_length("text") > 0))
    counts = rows.groupBy("label").agg(F.sum(F.ceil(F.octet_length("text") / window)).alias("n")).collect()  # one row for each language
    share = {label: min(1.0, per_label / n) for label, n in counts}
    drawn = rows.mapInArrow(_draw(share, window), "label string, window binary").distinct()
    sample = sorted((label, bytes(data)) for label, data in drawn.collect()) if share else []
    return [data for _, data in sample], [label for label, _ in sample]


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", per_label: int = 4500, window: int = 256) -> ByteConvNet | None:
    windows, labels = labelled_windows(df, text_col, label_col, per_label, window)
    return fit(windows, labels, window) if windows else None


def _predict(net: ByteConvNet | None, chunk: int = 256):
    import regex

    letter = regex.compile(r"\p{L}")

    def score_texts(texts):
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush():
            if not held:
                return
            probs = net.probabilities(np.concatenate([c for _, c, _ in held]))
            at = 0
            for k, c, sizes in held:
                mean = (probs[at : at + len(c)] * sizes[:, None]).sum(0) / sizes.sum()
                at += len(c)
                best = int(mean.argmax())
                names[k], scores[k] = net.labels[best], float(min(1.0, mean[best]))
            held.clear()

        waiting = 0
        for k, text in enumerate(texts):
            if net is None or text is None or not letter.search(text):
                continue
            c, sizes = net.windows(text.encode("utf-8", "surrogatepass"))
            held.append((k, c, sizes))
            waiting += len(c)
            if waiting >= chunk:
                flush()
                waiting = 0
        flush()
        return names, scores

    def run(batches):
        for b in slices(batches, 1024):
            names, scores = score_texts(b.column("text").to_pylist())
            yield emit(_OUT, [b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), names, scores])

    return run


def predict(df: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``df``."""
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), flag.alias("held_out"))
    return rows.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, net: ByteConvNet | None, min_score: float, text_col: str = "text") -> DataFrame:
    """Rows of ``df``, columns as they came, whose text has a language with at least ``min_score``.

    Without a model only letterless texts go.
    """
    if net is None:
        return df.where(F.coalesce(F.regexp_like(text_col, F.lit("\\p{L}")), F.lit(False)))
    score = _predict(net)
    schema = df.schema

    def run(batches):
        for b in slices(batches, 1024):
            k = b.schema.get_field_index(text_col)
            flat = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(k), pa.nulls(b.num_rows, pa.bool_())], names=["doc_id", "text", "held_out"])
            (out,) = score(iter([flat]))
            keep = [name != UNDETERMINED and s >= min_score for name, s in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, schema)
