"""Language identification by a byte convolutional network.

Windows of a fixed number of bytes cover the whole text. A window's bytes are embedded, filters of several
widths run over them, each filter's maximum over the window is kept, and a softmax layer gives probabilities; a
document's are the mean over its windows. The network is trained in numpy on the driver, on windows of a
bounded sample of labelled rows (``rows_per_lang`` documents a language, expected).

Embedding and filters are linear, so for prediction they are multiplied out once into tables, one row a pair of
bytes, and a convolution becomes a sum of table rows.

Defined results: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; texts may be of any length, their windows are predicted a bounded number at a time, and a batch's texts leave it ``PIECE`` rows at a time; a language that no training row
has is never predicted; without any training row all texts are ``und``; ties go to the first language by name;
repeated rows are predicted each for itself, and learned from once; ids may be null or come again; other columns, also ones named like the results, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
PIECE = 256  # rows of a batch whose texts are copied out of it together
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Config:
    window: int = 256  # bytes
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width
    embed: int = 8
    rows_per_lang: int = 400  # documents sampled a language, in expectation
    most_langs: int = 200
    windows_per_row: int = 2
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


class ByteConv:
    """Parameters, training and prediction."""

    def __init__(self, langs: list[str], cfg: Config):
        rng = np.random.default_rng(cfg.seed)
        self.langs, self.cfg = langs, cfg
        n = cfg.filters * len(cfg.widths)
        self.p = {"e": rng.normal(0, 0.5, (257, cfg.embed)).astype("f4"), "w": np.zeros((n, len(langs)), "f4"), "b": np.zeros(len(langs), "f4")}
        for k in cfg.widths:
            self.p[f"f{k}"] = rng.normal(0, (k * cfg.embed) ** -0.5, (k * cfg.embed, cfg.filters)).astype("f4")
            self.p[f"c{k}"] = np.zeros(cfg.filters, "f4")
        self.p["w"] = rng.normal(0, n**-0.5, (n, len(langs))).astype("f4")

    # Byte values are 1..256 and 0 pads short windows.

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        kept, pooled = [], []
        for k in self.cfg.widths:
            seen = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - k + 1, -1)
            z = seen @ self.p[f"f{k}"] + self.p[f"c{k}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            kept.append((k, seen, at, top))
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, 1)
        return h, kept, _softmax(h @ self.p["w"] + self.p["b"])

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteConv:
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed + 1)
        share = np.bincount(y, minlength=len(self.langs)).astype("f4")
        weight = (len(y) / (len(self.langs) * np.maximum(share, 1)))[y].astype("f4")  # languages count alike
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(cfg.epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), cfg.batch):
                rows = order[s : s + cfg.batch]
                step += 1
                for name, g in self._gradients(x[rows], y[rows], weight[rows]).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.p[name] -= cfg.rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h, kept, prob = self._forward(x)
        d = prob.copy()
        d[np.arange(len(y)), y] -= 1
        d *= (weight / len(y))[:, None]
        g = {"w": h.T @ d, "b": d.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = d @ self.p["w"].T
        for i, (k, seen, at, top) in enumerate(kept):
            n = self.cfg.filters
            dz = dh[:, i * n : (i + 1) * n] * (top > 0)
            won = np.take_along_axis(seen, at[:, :, None], 1)  # rows, filters, k * embed
            g[f"f{k}"] = np.einsum("rfi,rf->if", won, dz)
            g[f"c{k}"] = dz.sum(0)
            de = np.einsum("rf,if->rfi", dz, self.p[f"f{k}"]).reshape(len(x), n, k, -1)
            where = np.take_along_axis(x[:, :, None], (at[:, :, None] + np.arange(k)).reshape(len(x), -1)[:, :, None], 1).reshape(len(x), n, k)
            np.add.at(g["e"], where.ravel(), de.reshape(-1, self.cfg.embed))
        return g

    def tables(self) -> tuple[float, dict[int, list[tuple[int, np.ndarray]]]]:
        """For each width, tables of two taps each (257 * 257 byte pairs x filters) or of one, as small integers of a common scale."""
        exact: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k in self.cfg.widths:
            taps = [self.p["e"] @ part for part in np.split(self.p[f"f{k}"], k)]
            exact[k] = [(j, (taps[j][:, None] + taps[j + 1][None]).reshape(-1, self.cfg.filters)) for j in range(0, k - 1, 2)]
            exact[k] += [(k - 1, taps[-1])] * (k % 2)
        scale = 32000 / max(sum(float(np.abs(t).max()) for _, t in parts) for parts in exact.values())
        return scale, {k: [(j, np.rint(t * scale).astype("i2")) for j, t in parts] for k, parts in exact.items()}

    def predict(self, x: np.ndarray, tables: tuple) -> np.ndarray:
        """Probabilities of windows (rows x window), a bounded number at a time."""
        scale, by_width = tables
        out = np.empty((len(x), len(self.langs)), "f4")
        for s in range(0, len(x), 64):
            one = x[s : s + 64].astype(np.intp)
            two = one[:, :-1] * 257 + one[:, 1:]
            pooled = []
            for k, parts in by_width.items():
                n = one.shape[1] - k + 1
                z = None
                for j, t in parts:
                    got = t.take((two if len(t) > 257 else one)[:, j : j + n], axis=0, mode="clip")
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(np.maximum(z.max(1) / scale + self.p[f"c{k}"], 0))
            out[s : s + 64] = _softmax(np.concatenate(pooled, 1) @ self.p["w"] + self.p["b"])
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows(raw: bytes, size: int) -> np.ndarray:
    """The text's bytes as rows of a fixed length; the last row is the last ``size`` bytes, or padded if there are fewer."""
    b = np.frombuffer(raw, "u1").astype("u2") + 1
    if len(b) <= size:
        out = np.zeros((1, size), "u2")
        out[0, : len(b)] = b
        return out
    n = len(b) // size
    whole = b[: n * size].reshape(n, size)
    return whole if n * size == len(b) else np.concatenate([whole, b[None, -size:]])


def sample(docs: DataFrame, cfg: Config) -> DataFrame:
    """Windows of about ``rows_per_lang`` labelled rows a language: ``lang, text``.

    Rows are chosen by a hash of id and text against the language's share, so no task gathers a language, and rows without an id, or with one
    that comes again, are drawn like others; of rows that repeat both one counts. Languages beyond the ``most_langs`` with the most rows are not learned."""
    docs = docs.where(F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("lang", F.col("doc_id").cast("string"), "text", F.lit(cfg.seed)).alias("draw"))
    counts = {r[0]: r[1] for r in docs.groupBy("lang").agg(F.count_distinct("draw").alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.most_langs).collect()}
    if not counts:
        return docs.select("lang", "text").limit(0)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, cfg.rows_per_lang / n))).otherwise(share)
    draw = F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30))
    spread = [F.substring("text", F.floor((F.length("text") - cfg.window) * (i + 1) / (cfg.windows_per_row + 1)).cast("int") + 1, F.lit(cfg.window)) for i in range(cfg.windows_per_row)]
    part = F.when(F.length("text") <= cfg.window, F.array("text")).otherwise(F.array(*spread))
    return docs.where(draw < share).dropDuplicates(["draw"]).select("lang", F.explode(part).alias("text"))


def train(docs: DataFrame, cfg: Config = Config()) -> ByteConv | None:
    """Train on labelled ``docs(doc_id, text, lang)``."""
    rows = sample(docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)), cfg).collect()
    if not rows:
        return None
    rows.sort()
    langs = sorted({r[0] for r in rows})
    x = np.concatenate([windows(r[1].encode()[: cfg.window], cfg.window) for r in rows])
    return ByteConv(langs, cfg).fit(x, np.array([langs.index(r[0]) for r in rows]))


def predict(docs: DataFrame, model: ByteConv | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs(keep..., text)`` to ``keep..., lang_pred, score``."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    cfg = model.cfg if model else Config()
    tables = model.tables() if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, PIECE) for whole in batches for s in range(0, whole.num_rows, PIECE)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            raw = [t.encode() if model and t else b"" for t in texts]
            prob = np.zeros((len(raw), max(1, len(model.langs) if model else 1)), "f4")
            held: list[np.ndarray] = []
            of: list[np.ndarray] = []
            n = 0
            for i, b in enumerate([*raw, None]):
                if b:
                    held.append(windows(b, cfg.window))
                    of.append(np.full(len(held[-1]), i))
                    n += len(held[-1])
                if held and (b is None or n >= 512):
                    rows, at = np.concatenate(held), np.concatenate(of)
                    np.add.at(prob, at, model.predict(rows, tables))
                    held, of, n = [], [], 0
            parts = np.array([max(1, -(-len(b) // cfg.window)) for b in raw])
            prob /= parts[:, None]
            best = prob.argmax(1)
            langs = [model.langs[k] if b else UND for k, b in zip(best, raw, strict=True)]
            score = [float(min(1.0, p)) if b else 0.0 for p, b in zip(prob[np.arange(len(raw)), best], raw, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*keep, F.when(F.col("text").rlike(LETTER), F.col("text")).alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose CRC-32 of the id's text leaves 1 of 3; they are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), cfg: Config = Config()) -> DataFrame:
    """Train on the rows that are not held out, predict all."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), cfg)
    return predict(docs, model, keep)
