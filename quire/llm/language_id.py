"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents. It labels every byte of a text (a probability for
each language, from the states that come from the left and from the right), and
a document's probabilities are the mean over its letter bytes.

Long texts are cut into windows of WINDOW bytes that are all read, in batches, so
memory is bounded by the batch and not by the longest text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, slices, small_batches, table

WINDOW = 128
HIDDEN = 8
BATCH = 2048
PAD = 256
UNKNOWN = "und"
#: Texts that are read together.
ROWS = 400

#: Bounds of the sample that is fitted: documents for each language, languages, windows for each document.
DOCS_PER_LANG, MAX_LANGS, WINDOWS_PER_DOC = 400, 100, 6
STEPS, TRAIN_BATCH, TRAIN_WINDOW, RATE = 500, 192, 64, 0.02
SEED = 7

_LETTER = np.zeros(PAD + 1, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1.0


@dataclass
class Model:
    """Weights. Axis 0 is the direction; gates lie in the order update, reset, candidate."""

    langs: list[str]
    into: np.ndarray  # (2, 257, 3H): byte to gates
    back: np.ndarray  # (2, H, 3H): state to gates
    out: np.ndarray  # (2H + 1, languages)


def _start(langs: list[str], rng: np.random.Generator) -> Model:
    h = HIDDEN
    return Model(
        langs,
        rng.normal(0, 0.3, (2, PAD + 1, 3 * h)).astype(np.float32),
        rng.normal(0, 0.5 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32),
        rng.normal(0, 0.3, (2 * h + 1, len(langs))).astype(np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _loss_and_slopes(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross entropy of every letter position of windows x (n, T) with labels y (n), and its slopes."""
    n, t_all = x.shape
    h = m.back.shape[1]
    seen = np.stack([x, x[:, ::-1]])  # each direction reads its own order
    states = np.zeros((t_all + 1, 2, n, h), np.float32)
    keep = []
    for t in range(t_all):
        prev = states[t]
        a = np.stack([m.into[d][seen[d, :, t]] for d in (0, 1)])
        u = prev @ m.back
        z, r = _sigmoid(a[..., :h] + u[..., :h]), _sigmoid(a[..., h : 2 * h] + u[..., h : 2 * h])
        c = np.tanh(a[..., 2 * h :] + r * u[..., 2 * h :])
        states[t + 1] = c + z * (prev - c)
        keep.append((z, r, c, u[..., 2 * h :]))
    both = np.concatenate([states[1:, 0], states[:0:-1, 1]], -1)  # (T, n, 2H)
    logits = both @ m.out[:-1] + m.out[-1]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    weight = _LETTER[x].T
    weight = weight / max(weight.sum(), 1.0)
    loss = -float((weight * np.log(np.take_along_axis(p, y[None, :, None], -1)[..., 0] + 1e-9)).sum())
    d_logits = p.copy()
    d_logits[:, np.arange(n), y] -= 1
    d_logits *= weight[..., None]
    d_out = np.zeros_like(m.out)
    d_out[:-1] = both.reshape(-1, 2 * h).T @ d_logits.reshape(-1, len(m.langs))
    d_out[-1] = d_logits.sum((0, 1))
    d_both = d_logits @ m.out[:-1].T
    d_from_out = np.stack([d_both[..., :h], d_both[::-1, :, h:]], 1)  # (T, 2, n, H)
    d_into, d_back = np.zeros_like(m.into), np.zeros_like(m.back)
    carried = np.zeros((2, n, h), np.float32)
    for t in range(t_all - 1, -1, -1):
        z, r, c, uc = keep[t]
        prev = states[t]
        d = d_from_out[t] + carried
        d_c = d * (1 - z) * (1 - c * c)
        d_z = d * (prev - c) * z * (1 - z)
        d_r = d_c * uc * r * (1 - r)
        gates_in = np.concatenate([d_z, d_r, d_c], -1)
        gates_back = np.concatenate([d_z, d_r, d_c * r], -1)
        d_back += prev.transpose(0, 2, 1) @ gates_back
        carried = d * z + gates_back @ m.back.transpose(0, 2, 1)
        for k in (0, 1):
            np.add.at(d_into[k], seen[k, :, t], gates_in[k])
    return loss, [d_into, d_back, d_out]


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, prior: dict[str, int] | None = None) -> Model | None:
    """Train on windows spread over the whole of each text; None without labelled texts.

    Languages are drawn by the root of their prior (documents of the whole corpus),
    so that rare ones are learned and doubtful short texts lean to frequent ones.
    A third of the windows is cut short at random, as short documents are.
    """
    langs = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    windows, ys = [], []
    for text, lang in zip(texts, labels, strict=True):
        if not text:
            continue
        data = np.frombuffer(text, np.uint8)
        for at in np.linspace(0, max(len(data) - TRAIN_WINDOW, 0), min(WINDOWS_PER_DOC, 1 + len(data) // TRAIN_WINDOW)).astype(int):
            row = np.full(TRAIN_WINDOW, PAD, np.int16)
            part = data[at : at + TRAIN_WINDOW]
            row[: len(part)] = part
            windows.append(row)
            ys.append(langs.index(lang))
    if not windows:
        return None
    x, y = np.stack(windows), np.array(ys)
    share = np.sqrt(np.array([(prior or {}).get(k, 1) for k in langs], float))
    chance = (share / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y]
    chance /= chance.sum()
    model = _start(langs, rng)
    params = [model.into, model.back, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.choice(len(x), min(TRAIN_BATCH, len(x)), p=chance)
        short = np.where(rng.random(len(pick)) < 0.33, rng.integers(4, TRAIN_WINDOW, len(pick)), TRAIN_WINDOW)
        _, slopes = _loss_and_slopes(model, np.where(np.arange(TRAIN_WINDOW) < short[:, None], x[pick], PAD), y[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        rate = RATE * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(params, slopes, first, second, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


class Reader:
    """A model made ready for reading: half of each sigmoid's argument is folded into the weights."""

    def __init__(self, model: Model):
        self.langs, self.h = model.langs, model.back.shape[1]
        scale = np.concatenate([np.full(2 * self.h, 0.5, np.float32), np.ones(self.h, np.float32)])
        self.into, self.back, self.out = model.into * scale, model.back * scale, model.out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, n, languages) of every position of windows x (n, T)."""
        n, t_all = x.shape
        h = self.h
        state = np.zeros((2, n, h), np.float32)
        both = np.empty((t_all, n, 2 * h), np.float32)
        gates = np.empty((2, n, 3 * h), np.float32)
        order = np.ascontiguousarray(x.T.astype(np.intp))
        for t in range(t_all):
            u = np.matmul(state, self.back)
            np.take(self.into[0], order[t], 0, out=gates[0], mode="clip")
            np.take(self.into[1], order[t_all - 1 - t], 0, out=gates[1], mode="clip")
            zr = gates[..., : 2 * h] + u[..., : 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = zr[..., h:] * u[..., 2 * h :]
            c += gates[..., 2 * h :]
            np.tanh(c, out=c)
            state -= c
            state *= zr[..., :h]
            state += c
            both[t, :, :h] = state[0]
            both[t_all - 1 - t, :, h:] = state[1]
        logits = both.reshape(-1, 2 * h) @ self.out[:-1]
        logits += self.out[-1]
        np.exp(np.minimum(logits, 60, out=logits), out=logits)
        logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
        return logits.reshape(t_all, n, -1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages) over the letter bytes of each whole text; zeros without any."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        data = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (np.cumsum(sizes) - sizes)[owner] + inside * WINDOW
        length = np.minimum(sizes[owner] - inside * WINDOW, WINDOW)
        total = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts))
        steps = np.arange(WINDOW)
        for at in range(0, len(owner), BATCH):
            s = slice(at, at + BATCH)
            place = start[s, None] + steps
            x = np.where(steps < length[s, None], data[np.minimum(place, len(data) - 1)], PAD).astype(np.int16)
            weight = _LETTER[x.T]
            sums = np.einsum("tn,tnl->nl", weight, self.positions(x))
            np.add.at(total, owner[s], sums)
            np.add.at(letters, owner[s], weight.sum(0))
        return total / np.maximum(letters, 1)[:, None]


def label_positions(model: Model, text: str) -> list[str]:
    """The language of every byte of text."""
    data = text.encode()
    out = []
    for at in range(0, len(data), WINDOW):
        x = np.full((1, WINDOW), PAD, np.int16)
        part = np.frombuffer(data[at : at + WINDOW], np.uint8)
        x[0, : len(part)] = part
        best = Reader(model).positions(x)[: len(part), 0].argmax(-1)
        out += [model.langs[i] for i in best]
    return out


def held_out() -> F.Column:
    """Whether a document is kept from training; one without a doc_id is."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def train(docs: DataFrame) -> Model | None:
    """Fit on at most DOCS_PER_LANG rows of each of MAX_LANGS languages, in the order of their hash.

    Held-out documents, and those without a text or a language, are never read. Of
    each language only hashes so low that about twice as many rows have one are
    ranked, so a frequent language is no hot key. Repeated rows count one by one.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    prior = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not prior:
        return None
    bound = lambda n: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (2 * DOCS_PER_LANG + 100) // n)
    low = F.coalesce(*(F.when(F.col("lang") == lang, F.xxhash64("doc_id") <= F.lit(bound(n))) for lang, n in prior.items()), F.lit(False))
    # Of each text only the bytes of its training windows travel.
    step = F.greatest((F.octet_length("text") - TRAIN_WINDOW) / float(WINDOWS_PER_DOC - 1), F.lit(0.0))
    binary = F.col("text").cast("binary")
    cuts = F.array(*(F.substring(binary, (F.floor(step * k) + 1).cast("int"), F.lit(TRAIN_WINDOW)) for k in range(WINDOWS_PER_DOC)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "cuts")
    ranked = rows.where(low).select("doc_id", "lang", F.array_distinct(cuts).alias("cuts")).withColumn("n", F.row_number().over(order))
    got = ranked.where(F.col("n") <= DOCS_PER_LANG).select("doc_id", "lang", "cuts").collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], len(r["cuts"]), r["cuts"]))
    return fit([bytes(c) for r in got for c in r["cuts"]], [r["lang"] for r in got for _ in r["cuts"]], prior=prior)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, extra: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score: every column if extra, else doc_id alone beside them.

    Nulls and texts without a letter, and every text if there is no model, give
    UNKNOWN and a score of 0. Only the text is read, all of it however long, in
    windows. Repeated rows repeat; equal texts get equal answers. An empty table
    gives none. With extra, docs must not have columns called as names.
    """
    cols = docs.columns if extra else ["doc_id"]
    source = docs if extra else docs.select("doc_id", "text")
    clash = [c for c in cols if c in names]
    if clash:
        raise ValueError(f"docs has columns {clash} already")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value) if shared.value is not None else None
        # A bounded number of texts, and of their bytes, at a time.
        for b in (part for batch in released(batches) for part in slices(batch, ROWS)):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            readable = [i for i, t in enumerate(texts) if t and _has_letter(t)] if reader else []
            if readable:
                for i, p in zip(readable, reader.pooled([texts[i].encode() for i in readable]), strict=True):
                    k = int(p.argmax())
                    lang[i], score[i] = reader.langs[k], min(1.0, float(p[k]))
            kept = [b.column(b.schema.get_field_index(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*cols, *names])

    schema = source.select(*cols).schema.add(names[0], "string").add(names[1], "double")
    return source.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
