"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input joins a hashed word embedding, the mean of hashed embeddings of its character 3- to 5-grams, and how much
likelier its form and its grams are in toxic texts of the training sample. Two gated recurrent layers read a window of words, one from
each end; attention weighs their states, and the pooled state gives the window's score. All windows of a text are scored, each overlapping the
next by half, and the largest score is the text's.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweave.llm.common import drop_since, mapped, mark, release, stored, unused

#: Words of a window and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Labelled rows of either class that the model is fitted on at most.
SAMPLE_ROWS = 2500
WORD_BUCKETS, GRAM_BUCKETS, PRIOR_BUCKETS = 1 << 13, 1 << 14, 1 << 18
EMBED, HIDDEN, ATTEND = 8, 8, 8
INPUT = 2 * EMBED + 3
EPOCHS, BATCH, RATE = 12, 256, 0.01
#: Distinct words a task keeps the inputs of.
CACHE_WORDS = 200_000
STRIP = string.punctuation + "“”„‘’«»…–—¿¡"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tells a word's own hash from those of grams.
OWN = np.uint64(0x5BD1E995)
#: Parts of the training sample; the first one only sets the cut.
FOLDS = 5


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Forms:
    """Hashes of words and of their character grams; grams of word i are flat[start[i]:start[i + 1]]."""

    words: np.ndarray
    flat: np.ndarray
    start: np.ndarray


def forms(words: list[str]) -> Forms:
    """Every word is at least three characters with its two borders, so that each has a gram of three; no words have no hashes."""
    texts = ["\x02" + (w.strip(STRIP) or w) + "\x03" for w in words]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = ends[owner] - np.arange(len(codes))  # characters from each place to the end of its word
    grams, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 6):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        h = h * np.uint64(1_000_003) + shifted + np.uint64(1)
        if n >= 3:
            at = np.flatnonzero(left >= n)
            grams.append(_spread(h[at] + np.uint64(n)))
            owners.append(owner[at])
    # A word's own hash: a sum of its characters' hashes by place.
    place = np.arange(len(codes)) - begins[owner]
    whole = np.add.reduceat(_spread(codes * np.uint64(2_654_435_761) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), begins) if len(texts) else np.zeros(0, np.uint64)
    owners_, flat = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners_, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(owners_, minlength=len(texts)))])
    return Forms(_spread(whole), flat[order], start)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of rows start[i]:start[i + 1], none of them empty."""
    return np.add.reduceat(values, start[:-1], axis=0) if len(start) > 1 else np.zeros((0, *values.shape[1:]), values.dtype)


class Table(dict):
    """Row numbers of distinct words; new words wait in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = k = len(self)
        return k


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    prior: np.ndarray
    layers: list[dict[str, np.ndarray]] = field(default_factory=list)
    attend: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    def parameters(self) -> dict[str, np.ndarray]:
        out = {"words": self.words, "grams": self.grams}
        for k, layer in enumerate(self.layers):
            out |= {f"{n}{k}": v for n, v in layer.items()}
        return out | self.attend

    def inputs(self, f: Forms) -> np.ndarray:
        """(words, INPUT) inputs of distinct words."""
        n = np.diff(f.start).astype(np.float32)[:, None]
        chars = _sums(self.grams[f.flat % np.uint64(GRAM_BUCKETS)], f.start) / n
        return np.concatenate([self.words[f.words % np.uint64(WORD_BUCKETS)], chars, prior_inputs(f, self.prior)], axis=1).astype(np.float32)


def prior_inputs(f: Forms, prior: np.ndarray) -> np.ndarray:
    """(words, 3) log-odds of distinct words: their own, and the highest and the mean of their grams'."""
    odds = prior[f.flat % np.uint64(PRIOR_BUCKETS)]
    own = prior[(f.words ^ OWN) % np.uint64(PRIOR_BUCKETS)]
    top = np.maximum.reduceat(odds, f.start[:-1]) if len(f.words) else odds[:0]
    mean = _sums(odds, f.start) / np.diff(f.start).astype(np.float32)
    return np.stack([own, top, mean], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(p: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of one layer over (steps, rows, 3 HIDDEN) projected inputs; masked steps keep the state."""
    steps, rows, _ = p.shape
    h, out, kept = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), []
    gates, new = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for t in range(steps):
        g = _sigmoid(p[t, :, : 2 * HIDDEN] + h @ gates)
        z, r = g[:, :HIDDEN] * mask[t], g[:, HIDDEN:]
        rh = r * h
        c = np.tanh(p[t, :, 2 * HIDDEN :] + rh @ new)
        if keep:
            kept.append((h, g, rh, c))
        h = h + z * (c - h)
        out[t] = h
    return out, kept


def _read_back(d_out: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray):
    """Gradients of _read: of its projected inputs and of u."""
    steps, rows, _ = d_out.shape
    d_p, d_u, d_h = np.empty((steps, rows, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, g, rh, c = kept[t]
        z, r, m = g[:, :HIDDEN], g[:, HIDDEN:], mask[t]
        d = d_h + d_out[t]
        d_c = d * z * m * (1 - c * c)
        d_z = d * (c - h) * m * z * (1 - z)
        d_rh = d_c @ u[:, 2 * HIDDEN :].T
        d_r = d_rh * h * r * (1 - r)
        d_g = np.concatenate([d_z, d_r], axis=1)
        d_u[:, : 2 * HIDDEN] += h.T @ d_g
        d_u[:, 2 * HIDDEN :] += rh.T @ d_c
        d_h = d * (1 - z * m) + d_rh * r + d_g @ u[:, : 2 * HIDDEN].T
        d_p[t] = np.concatenate([d_g, d_c], axis=1)
    return d_p, d_u


def _pool(states: np.ndarray, mask: np.ndarray, a: dict[str, np.ndarray]):
    """Logits of windows, and what their gradients need."""
    k = np.tanh(states @ a["key"])
    e = (k @ a["query"]) + np.where(mask[:, :, 0] > 0, 0, -1e9).astype(np.float32)
    e = np.exp(e - e.max(axis=0))
    weight = e / e.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ a["out"] + a["bias"][0], (k, weight, pooled)


def window_logits(model: Model, projected: list[np.ndarray], index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of (steps, windows) rows of words; projected: for each layer, the words' inputs times its input weights."""
    m = mask[:, :, None].astype(np.float32)
    ahead, _ = _read(projected[0][index], model.layers[0]["u"], m)
    back, _ = _read(projected[1][index[::-1]], model.layers[1]["u"], m[::-1])
    return _pool(np.concatenate([ahead, back[::-1]], axis=2), m, model.attend)[0]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these numbers of words, one after the other: each window's first word, its number of words, and its text.

    A text has a window at every STRIDE words until one reaches its end; one without words has a single empty window.
    """
    n = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return first[owner] + nth * STRIDE, np.minimum(WINDOW, lengths[owner] - nth * STRIDE), owner


class Scorer:
    """Scores batches of texts, with the inputs of frequent words kept."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.table = Table()
        self.projected = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in self.model.layers]

    def _learn_new(self) -> None:
        new, self.table.new = self.table.new, []
        if not new:
            return
        size, n = len(self.table), len(new)
        x = self.model.inputs(forms(new))
        for k, layer in enumerate(self.model.layers):
            if size > len(self.projected[k]):
                self.projected[k] = np.concatenate([self.projected[k], np.zeros((size, 3 * HIDDEN), np.float32)])
            self.projected[k][size - n : size] = x @ layer["w"] + layer["b"]

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.table) > CACHE_WORDS:
            self.forget()
        split = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter((k for words in split for k in map(self.table.__getitem__, words)), np.int32, int(lengths.sum()))
        self._learn_new()
        rows = rows if len(rows) else np.zeros(1, np.int32)
        begin, size, owner = windows(lengths)
        place = np.arange(WINDOW)[:, None]
        out = np.full(len(texts), -np.inf, np.float32)
        for lo in range(0, len(owner), 2048):
            part = slice(lo, lo + 2048)
            mask = place < size[part]
            np.maximum.at(out, owner[part], window_logits(self.model, self.projected, rows[np.where(mask, begin[part] + place, 0)], mask))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores, 0.5 at the model's shift. Nothing in a text without words is toxic, so that its score is below that wherever the network puts it."""
        away = self.logits(texts).astype(np.float64) - self.model.shift
        blank_ = np.fromiter((not t or t.isspace() for t in texts), bool, len(texts))
        return _sigmoid(np.where(blank_, np.minimum(away, -1.0), away))


def _half(part: int) -> int:
    """Training texts of a fold are in one of two halves; those of fold 0 aren't trained on."""
    return part % 2


def count_forms(texts: list[str], toxic: list[int], parts: list[int]) -> np.ndarray:
    """(half, class, bucket): how many training texts have a word or gram of the hash bucket; the last bucket counts the texts."""
    counts = np.zeros((2, 2, PRIOR_BUCKETS + 1), np.int32)
    for t, y, part in zip(texts, toxic, parts, strict=True):
        if part:
            counts[_half(part), int(y), PRIOR_BUCKETS] += 1
            f = forms(list(dict.fromkeys(t.lower().split())))
            counts[_half(part), int(y), np.unique(np.concatenate([f.flat, f.words ^ OWN]) % np.uint64(PRIOR_BUCKETS))] += 1
    return counts


def log_odds(counts: np.ndarray) -> np.ndarray:
    """For each hash bucket of (class, bucket) counts, how much likelier a toxic text has it: log-odds, a standard error nearer to 0, at most 4 either way."""
    n = np.maximum(1, counts[:, -1].astype(np.float64))
    c = counts[:, :-1].astype(np.float64) + 0.5
    odds = np.log(c[1] / (n[1] + 1)) - np.log(c[0] / (n[0] + 1))
    sure = np.maximum(0, np.abs(odds) - np.sqrt(1 / c[0] + 1 / c[1]))
    return np.clip(np.sign(odds) * sure, -4, 4).astype(np.float32)


def pick_windows(text: str, toxic: int, prior: np.ndarray) -> list[list[str]]:
    """A whole text's windows to train on: the one of highest log-odds, and of a clean text another one that a digest of it chooses."""
    words = text.lower().split()
    if not words:
        return [[]]
    distinct = list(dict.fromkeys(words))
    f = forms(distinct)
    odds = np.maximum(prior[(f.words ^ OWN) % np.uint64(PRIOR_BUCKETS)], np.maximum.reduceat(prior[f.flat % np.uint64(PRIOR_BUCKETS)], f.start[:-1]))
    worth = dict(zip(distinct, odds.tolist(), strict=True))
    starts = range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE)
    best = max(starts, key=lambda s: sum(sorted((worth[w] for w in words[s : s + WINDOW]), reverse=True)[:3]))
    other = starts[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(starts)]
    return [words[s : s + WINDOW] for s in ([best] if toxic else [best, other])]


def blank(seed: int = 7) -> Model:
    """A model with random weights that scores all texts below 0.5."""
    rnd = np.random.default_rng(seed)
    init = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model(0.1 * rnd.standard_normal((WORD_BUCKETS, EMBED)).astype(np.float32), 0.1 * rnd.standard_normal((GRAM_BUCKETS, EMBED)).astype(np.float32), np.zeros(PRIOR_BUCKETS, np.float32))
    model.layers = [{"w": init(INPUT, 3 * HIDDEN), "u": init(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32)} for _ in range(2)]
    model.attend = {"key": init(2 * HIDDEN, ATTEND), "query": init(ATTEND), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    model.shift = 1e3
    return model


def learn(model: Model, picked: list[tuple[int, list[str], int]], priors: list[np.ndarray], seed: int = 8) -> None:
    """Trains the model's weights on windows (half, words, label), log-odds of each half's texts coming from the other half."""
    rnd = np.random.default_rng(seed)
    picked = picked + [(0, [], 0)] * max(1, len(picked) // 100)
    words = Words(picked, priors)
    params = model.parameters()
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in params.items()}
    target = np.asarray([p[2] for p in picked], np.float32)
    weigh = np.where(target > 0, 0.5 / max(1e-9, target.mean()), 0.5 / max(1e-9, 1 - target.mean())).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(picked))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            step += 1
            grads = _gradients(model, words, rows, target[rows], weigh[rows])
            for n, g in grads.items():
                m, v = moments[n]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[n] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """A model of these labelled texts. With no text of a class, it scores all texts below 0.5.

    Log-odds come from one half of the texts for the other half, so that the network learns what they are worth on texts they haven't seen.
    Each text gives the windows that pick_windows chooses. The score of 0.5 is put where it errs least on a fifth of the texts, which the network isn't trained on.
    """
    model = blank(seed)
    if not any(toxic) or all(toxic):
        return model
    part = (np.random.default_rng(seed).permutation(len(toxic)) % FOLDS).tolist()
    counts = count_forms(texts, toxic, part)
    priors = [log_odds(counts[1 - k]) for k in (0, 1)]
    model.prior = log_odds(counts.sum(axis=0))
    learn(model, [(_half(p), w, int(y)) for t, y, p in zip(texts, toxic, part, strict=True) if p for w in pick_windows(t, y, priors[_half(p)])], priors)
    held = [i for i, p in enumerate(part) if p == 0]
    model.shift = _best_cut(Scorer(model).logits([texts[i] for i in held]).astype(np.float64), np.asarray([toxic[i] for i in held]))
    return model


class Words:
    """Windows as numbers of distinct words, a word of either half being one of its own, with these words' hashes and log-odds."""

    def __init__(self, picked: list[tuple[int, list[str], int]], priors: list[np.ndarray]) -> None:
        tables = [Table(), Table()]
        self.index, self.mask = np.zeros((WINDOW, len(picked)), np.int64), np.zeros((WINDOW, len(picked), 1), np.float32)
        for j, (k, words, _) in enumerate(picked):
            self.index[: len(words), j] = [tables[k][w] * 2 + k for w in words]
            self.mask[: len(words), j] = 1
        # Words of half 1 stand behind those of half 0; masked places read the first word.
        first = len(tables[0])
        self.index = np.where(self.index % 2, first, 0) + self.index // 2
        both = [forms(list(t)) for t in tables]
        self.own = np.concatenate([f.words for f in both]) % np.uint64(WORD_BUCKETS)
        self.flat = np.concatenate([f.flat for f in both]) % np.uint64(GRAM_BUCKETS)
        self.start = np.concatenate([both[0].start, both[0].start[-1] + both[1].start[1:]])
        self.odds = np.concatenate([prior_inputs(f, prior) for f, prior in zip(both, priors, strict=True)])
        if not len(self.own):  # all windows are empty
            one = forms(["x"])
            self.own, self.flat, self.start, self.odds = one.words % np.uint64(WORD_BUCKETS), one.flat % np.uint64(GRAM_BUCKETS), one.start, prior_inputs(one, priors[0])


def _gathered(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranges start[i]:start[i + 1] of these rows, one after the other, and where each begins."""
    n = np.diff(start)[rows]
    begin = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(start[rows] - begin[:-1], n) + np.arange(begin[-1]), begin


def _sum_by(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of values that have the same number in `at`, for numbers below size."""
    return np.stack([np.bincount(at, values[:, c], size) for c in range(values.shape[1])], axis=1).astype(np.float32)


def _gradients(model: Model, words: Words, rows: np.ndarray, target: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
    mask = words.mask[:, rows]
    seen, index = np.unique(words.index[:, rows], return_inverse=True)
    index = index.reshape(mask.shape[:2])
    own, (places, begin) = words.own[seen], _gathered(words.start, seen)
    flat, n = words.flat[places], np.diff(begin)
    inputs = np.concatenate([model.words[own], _sums(model.grams[flat], begin) / n[:, None], words.odds[seen]], axis=1).astype(np.float32)
    l0, l1 = model.layers
    ahead, kept0 = _read((inputs @ l0["w"] + l0["b"])[index], l0["u"], mask, keep=True)
    back, kept1 = _read((inputs @ l1["w"] + l1["b"])[index[::-1]], l1["u"], mask[::-1], keep=True)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    a = model.attend
    logit, (key, weight, pooled) = _pool(states, mask, a)
    d = ((_sigmoid(logit) - target) * weigh / len(target)).astype(np.float32)
    grads = {"out": pooled.T @ d, "bias": np.asarray([d.sum()], np.float32)}
    d_pooled = d[:, None] * a["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=2)
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_key = d_e[:, :, None] * a["query"] * (1 - key * key)
    grads["query"] = (key * d_e[:, :, None]).sum(axis=(0, 1))
    grads["key"] = np.tensordot(states, d_key, axes=([0, 1], [0, 1]))
    d_states += d_key @ a["key"].T
    d_inputs = np.zeros_like(inputs)
    for k, (kept, m, at, d_s) in enumerate(((kept0, mask, index, d_states[:, :, :HIDDEN]), (kept1, mask[::-1], index[::-1], d_states[::-1, :, HIDDEN:]))):
        d_p, d_u = _read_back(d_s, kept, model.layers[k]["u"], m)
        grads[f"u{k}"] = d_u
        per_word = _sum_by((d_p * m).reshape(-1, 3 * HIDDEN), at.ravel(), len(inputs))
        grads[f"w{k}"], grads[f"b{k}"] = inputs.T @ per_word, per_word.sum(axis=0)
        d_inputs += per_word @ model.layers[k]["w"].T
    grads["words"] = _sum_by(d_inputs[:, :EMBED], own.astype(np.int64), WORD_BUCKETS)
    grads["grams"] = _sum_by(np.repeat(d_inputs[:, EMBED : 2 * EMBED] / n[:, None], n, axis=0), flat.astype(np.int64), GRAM_BUCKETS)
    return grads


def _best_cut(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The logit between two texts' that errs least; among such, the middle of the widest gap. Clean and toxic texts' errors weigh alike."""
    if not toxic.any() or toxic.all():
        return 0.0
    order = np.argsort(logits)
    s, y = logits[order], toxic[order].astype(np.float64)
    missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    errors = missed + wrong
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gaps = np.diff(edges)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _spelled(batch: pa.RecordBatch) -> tuple[list[str], list[int], list[int]]:
    return batch.column("text").to_pylist(), batch.column("y").to_pylist(), batch.column("part").to_pylist()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model fitted on at most `rows` labelled rows of either class, chosen by a digest of their keys, none of them held out.

    A key with several labels is toxic if any of them says so, and one with several texts has the smallest. Null keys, labels and texts teach nothing.
    Whole texts are counted, searched for windows and scored by the executors; counts by hash bucket, windows and the logits of a fifth of the texts come to the driver.
    """
    spark, before = docs.sparkSession, mark()
    marks = labels.select(labels[f"`{key}`"].alias("id"), labels[f"`{label}`"].alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("y").cast("long").alias("y"))
    ids = [(r["id"], y, n % FOLDS) for y in (0, 1) for n, r in enumerate(marks.filter(F.col("y") == y).select("id", F.md5(F.col("id").cast("string")).alias("o")).orderBy("o").limit(rows).collect())]
    model = blank()
    if len({y for _, y, _ in ids}) < 2:
        return model
    # At most 2 * rows keys are broadcast.
    chosen = spark.createDataFrame(ids, T.StructType([marks.schema["id"], T.StructField("y", T.LongType()), T.StructField("part", T.IntegerType())]))
    texts = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), "id")
    sample = stored(texts.groupBy("id", "y", "part").agg(F.min("text").alias("text")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros((2, 2, PRIOR_BUCKETS + 1), np.int32)
        for batch in batches:
            counts += count_forms(*_spelled(batch))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["at", "n"])

    found = mapped(sample, count, "at int, n int").groupBy("at").agg(F.sum("n").cast("int").alias("n")).toArrow()
    counts = np.zeros(4 * (PRIOR_BUCKETS + 1), np.int32)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(2, 2, PRIOR_BUCKETS + 1)
    priors = [log_odds(counts[1 - k]) for k in (0, 1)]
    model.prior = log_odds(counts.sum(axis=0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, half, y, words = [], [], [], []
            for name, t, label, part in zip(batch.column("id").cast(pa.string()).to_pylist(), *_spelled(batch), strict=True):
                for w in pick_windows(t, label, priors[_half(part)]) if part else []:
                    ids.append(name)
                    half.append(_half(part))
                    y.append(label)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(half, pa.int32()), pa.array(y, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["id", "half", "y", "words"])

    windows_ = mapped(sample, pick, "id string, half int, y bigint, words array<string>").collect()
    learn(model, [(r["half"], r["words"], r["y"]) for r in sorted(windows_, key=lambda r: (r["id"], r["words"]))], priors)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_in_slices(batch.column("text"), scorer.logits), pa.float64()), batch.column("y")], names=["logit", "y"])

    held = mapped(sample.filter("part = 0"), judge, "logit double, y bigint").toArrow()
    model.shift = _best_cut(held.column("logit").to_numpy(), held.column("y").to_numpy())
    drop_since(spark, before)
    return model


def _in_slices(texts: pa.Array, function) -> np.ndarray:
    """Results of a function of texts, at most 512 of them and about a million characters at a time, whatever their lengths. Null texts count as empty."""
    out = [np.zeros(0)]
    for at in range(0, len(texts), 512):
        some = [t or "" for t in texts.slice(at, 512).to_pylist()]
        lo, sizes = 0, np.cumsum([0, *map(len, some)])
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + 1_000_000)))
            out.append(function(some[lo:hi]).astype(np.float64))
            lo = hi
    return np.concatenate(out)


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5), and without its text column unless keep_text.

    Whole texts are scored, all overlapping windows of them. A null text counts as empty; empty texts and those of white space score below 0.5.
    Repeated rows get equal results; an empty table gives an empty one. Other columns pass through, except those with the names of results, in any case.
    """
    others = [f for f in docs.schema if f.name.lower() not in ("score", "predicted") and (keep_text or f.name != text)]
    (read,) = unused(docs, "text_read")
    source = docs.select(*[docs[f"`{f.name}`"] for f in others], docs[f"`{text}`"].cast("string").alias(read))
    schema = T.StructType([*others, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(model)  # goes with the task, so that workers which other stages use again don't keep it
        for batch in batches:
            s = _in_slices(batch.column(read), scorer.scores)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=schema.names)

    return mapped(source, run, schema)
