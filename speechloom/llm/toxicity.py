"""Toxicity by a bidirectional gated recurrent network over characters and words, written in numpy.

A word is represented by its entry in a learnt word table and by a small bidirectional GRU over its bytes, so misspelt and
unseen words still have a representation. A bidirectional GRU reads every overlapping window of words, attention pools its
states, and the pooled state gives the window's logit. A text's score is a logistic function of how its windows' logits are
distributed (highest, mean, and mean over the windows' probabilities). All windows of all texts are scored; what a word
contributes before the recurrence is worked out once for each distinct word of a batch. Windows have WINDOW words and begin
every STRIDE words, so neighbours share WINDOW - STRIDE words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints as fp
from .samples import bounded_sample

WINDOW, STRIDE = 48, 32
WORD_BYTES = 16  # longer words are read as several
#: Words of fewer texts of the sample have no entry in the word table; their bytes speak for them.
LEAST_TEXTS = 3
SIZES = {"byte": 8, "byte_state": 6, "word": 12, "state": 8}
SAMPLE_PER_LABEL = 1500
#: Steps of fitting, and the windows of each: a text is drawn, any with the same chance, and then any of its windows.
STEPS, STEP_WINDOWS = 400, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART_OF_WORD = np.zeros(256, dtype=bool)
_PART_OF_WORD[[*range(97, 123), *range(128, 256)]] = True


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered and all but letters as spaces, starts, ends, words before each text); at most WORD_BYTES a word."""
    data, offsets = fp.text_buffers(texts)
    data = _LOWER[data]
    data[~_PART_OF_WORD[data]] = 32
    starts, ends, _ = fp.word_spans(data, offsets)
    parts = np.maximum(1, -(-(ends - starts) // WORD_BYTES))
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + nth * WORD_BYTES
    ends = np.minimum(np.repeat(ends, parts), starts + WORD_BYTES)
    return data, starts, ends, np.searchsorted(starts, offsets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sum_rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum of the rows of values that belong to it."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(first):
        out[at[order][first]] = np.add.reduceat(values[order], first)
    return out


class Gru:
    """One direction of a gated recurrent layer over inputs (steps, rows, 3 * size) that are already projected."""

    @staticmethod
    def forward(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
        """All states (steps, rows, size); masked steps leave the state as it was. keep: also what backward() needs."""
        n = u.shape[0]
        states, kept = np.zeros((len(x) + 1, x.shape[1], n), np.float32), []
        for t in range(len(x)):
            h = states[t]
            g = h @ u
            gates = _sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
            z = 1 - (1 - z) * mask[t][:, None]
            states[t + 1] = new + z * (h - new)
            if keep:
                kept.append((z, r, new, g[:, 2 * n :]))
        return states, kept

    @staticmethod
    def backward(d_states: np.ndarray, states: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray):
        """Gradients of the inputs and of u from those of all states but the first."""
        n = u.shape[0]
        dx, du, dh = np.zeros((len(kept), states.shape[1], 3 * n), np.float32), np.zeros_like(u), np.zeros_like(states[0])
        for t in reversed(range(len(kept))):
            z, r, new, g = kept[t]
            h, dh = states[t], dh + d_states[t]
            dz, dn = dh * (h - new), dh * (1 - z)
            before = dn * (1 - new * new)  # of the tanh's argument
            plain = (z - (1 - mask[t][:, None])) / np.maximum(mask[t][:, None], 1e-9) * mask[t][:, None]
            dzx = dz * plain * (1 - plain) * mask[t][:, None]
            drx = before * g * r * (1 - r)
            dx[t] = np.concatenate([dzx, drx, before], 1) * mask[t][:, None]
            dg = np.concatenate([dzx, drx, before * r], 1) * mask[t][:, None]
            du += h.T @ dg
            dh = dh * z + dg @ u.T
        return dx, du


@dataclass
class Network:
    vocabulary: np.ndarray  # sorted fingerprints of the words that have an entry
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    head: np.ndarray = field(default_factory=lambda: np.zeros(4))

    @classmethod
    def random(cls, vocabulary: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        s = SIZES
        normal = lambda *shape, scale=None: (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)
        w = {"bytes": normal(257, s["byte"], scale=0.3), "words": normal(len(vocabulary) + 1, s["word"], scale=0.1)}
        for name, n_in, n in (("c", s["byte"], s["byte_state"]), ("w", 2 * s["byte_state"] + s["word"], s["state"])):
            for d in "fb":
                w |= {f"{name}x{d}": normal(n_in, 3 * n), f"{name}b{d}": np.zeros(3 * n, np.float32), f"{name}u{d}": normal(n, 3 * n)}
        return cls(vocabulary, w | {"attend": normal(2 * s["state"], scale=0.1), "out": normal(2 * s["state"], scale=0.3), "bias": np.zeros(1, np.float32)})

    def words_in(self, data, starts, ends):
        """For the distinct words: bytes (WORD_BYTES, words), lengths and table entries; and which of them each word is."""
        hashes = fp.word_hashes(data, starts, ends)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        length = (ends - starts)[at]
        order = np.argsort(-length, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        length, first = length[order], starts[at][order]
        place = first[None, :] + np.arange(WORD_BYTES)[:, None]
        chars = np.where(np.arange(WORD_BYTES)[:, None] < length[None, :], data[np.minimum(place, len(data) - 1)].astype(np.int32) + 1, 0)
        entry = np.zeros(len(order), np.int64)
        if len(self.vocabulary):
            found = np.minimum(np.searchsorted(self.vocabulary, distinct[order]), len(self.vocabulary) - 1)
            entry = np.where(self.vocabulary[found] == distinct[order], found + 1, 0)
        return chars, length, entry, back[which]

    def represent(self, chars, length, entry, keep=False):
        """(words, inputs of the word layer): both last states of the byte layer, then the table entry. Words lie longest first,
        so each step runs over those long enough."""
        w = self.weights
        steps = int(length[0]) if len(length) else 0
        mask = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
        ends, kept = [], []
        for d in "fb":
            at = chars[:steps] if d == "f" else chars[:steps][::-1]
            m = mask if d == "f" else mask[::-1]
            projected = w["bytes"] @ w[f"cx{d}"] + w[f"cb{d}"]
            states, own = Gru.forward(projected[at], w[f"cu{d}"], m, keep)
            ends.append(states[-1])
            kept.append((states, own, m, at))
        return np.concatenate([*ends, w["words"][entry]], 1), kept

    def project(self, words: np.ndarray) -> dict[str, np.ndarray]:
        return {d: words @ self.weights[f"wx{d}"] + self.weights[f"wb{d}"] for d in "fb"}

    def read(self, x: dict[str, np.ndarray], mask: np.ndarray, keep=False):
        """Logits of windows, from projected inputs by direction (both in reading order) and a mask (steps, rows)."""
        w = self.weights
        forward, kf = Gru.forward(x["f"], w["wuf"], mask, keep)
        backward, kb = Gru.forward(x["b"][::-1], w["wub"], mask[::-1], keep)
        h = np.concatenate([forward[1:], backward[:0:-1]], 2)
        energy = np.where(mask > 0, h @ w["attend"], -1e9)
        weight = np.exp(energy - energy.max(0)) * (mask > 0)
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, h)
        return pooled @ w["out"] + w["bias"][0], (forward, kf, backward, kb, h, weight, pooled)

    def gradients(self, chars, length, entry, ids, mask, target):
        """Loss and gradients over windows; ids (steps, rows) index the distinct words."""
        w, g = self.weights, {k: np.zeros_like(v) for k, v in self.weights.items()}
        words, byte_kept = self.represent(chars, length, entry, True)
        projected = self.project(words)
        logit, (forward, kf, backward, kb, h, weight, pooled) = self.read({d: p[ids] for d, p in projected.items()}, mask, True)
        p = _sigmoid(logit)
        d_logit = ((p - target) / len(target)).astype(np.float32)
        g["bias"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * w["out"]
        dh = weight[:, :, None] * d_pooled
        along = np.einsum("tbh,bh->tb", h, d_pooled)
        d_energy = weight * (along - (weight * along).sum(0))
        g["attend"] = np.einsum("tb,tbh->h", d_energy, h)
        dh += d_energy[:, :, None] * w["attend"]
        n = w["wuf"].shape[0]
        dxf, g["wuf"] = Gru.backward(dh[:, :, :n], forward, kf, w["wuf"], mask)
        dxb, g["wub"] = Gru.backward(dh[::-1, :, n:], backward, kb, w["wub"], mask[::-1])
        d_words = np.zeros_like(words)
        for d, dx in (("f", dxf), ("b", dxb[::-1])):
            at = _sum_rows(ids.ravel(), dx.reshape(-1, dx.shape[2]), len(words))
            g[f"wx{d}"], g[f"wb{d}"] = words.T @ at, at.sum(0)
            d_words += at @ w[f"wx{d}"].T
        c = w["cuf"].shape[0]
        g["words"] = _sum_rows(entry, d_words[:, 2 * c :], len(w["words"]))
        for i, d in enumerate("fb"):
            states, own, m, chars_d = byte_kept[i]
            d_states = np.zeros_like(states[1:])
            d_states[-1] = d_words[:, i * c : (i + 1) * c]
            dx, g[f"cu{d}"] = Gru.backward(d_states, states, own, w[f"cu{d}"], m)
            at = _sum_rows(chars_d.ravel(), dx.reshape(-1, dx.shape[2]), 257)
            g[f"cx{d}"], g[f"cb{d}"] = w["bytes"].T @ at, at.sum(0)
            g["bytes"] += at @ w[f"cx{d}"].T
        loss = -np.mean(target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9))
        return float(loss), g

    def score_windows(self, texts: pa.Array, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of every text, and the text that each belongs to; a text without words has one, empty."""
        data, starts, ends, firsts = read_words(texts)
        at, text = window_starts(firsts)
        chars, length, entry, which = self.words_in(data, starts, ends)
        parts = [self.represent(chars[:, i : i + 65536], length[i : i + 65536], entry[i : i + 65536])[0] for i in range(0, len(length), 65536)]
        projected = self.project(np.concatenate(parts) if parts else np.zeros((1, len(self.weights["wxf"])), np.float32))
        which = which if len(which) else np.zeros(1, np.int64)
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), rows):
            place = at[i : i + rows][None, :] + np.arange(WINDOW)[:, None]
            mask = (place < firsts[1:][text[i : i + rows]][None, :]).astype(np.float32)
            ids = which[np.minimum(place, len(which) - 1)]
            out[i : i + rows] = self.read({d: p[ids] for d, p in projected.items()}, mask)[0]
        return out, text

    def predict(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return _sigmoid(features(*self.score_windows(texts), len(texts)) @ self.head)


def window_starts(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and their texts: every STRIDE words until a window reaches the text's end."""
    size = np.diff(firsts)
    n = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), n)
    return firsts[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, text


def features(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text: 1, the highest logit, the mean logit, and the mean probability of its windows."""
    count = np.bincount(text, minlength=n)
    highest = np.full(n, -np.inf)
    np.maximum.at(highest, text, logits)
    mean = lambda x: np.bincount(text, x, n) / count
    return np.stack([np.ones(n), highest, mean(logits), 4 * mean(_sigmoid(logits))], 1)


def fit(texts: list[str], toxic: np.ndarray, steps: int = STEPS, rows: int = STEP_WINDOWS, rate: float = 0.01, seed: int = 7) -> Network | None:
    """A network fitted to texts and their 0/1 labels; None if one of the labels is missing. Deterministic for a seed.

    Every step draws windows anew, so all windows of all texts may be read, and the work does not depend on the sample's size.
    """
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    data, starts, ends, firsts = read_words(pa.array(texts))
    hashes = fp.word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)], 1), axis=0)
    distinct, spread = np.unique(pairs[:, 0], return_counts=True)
    network = Network.random(distinct[spread >= LEAST_TEXTS], seed)
    chars, length, entry, which = network.words_in(data, starts, ends)
    which = which if len(which) else np.zeros(1, np.int64)
    at, text = window_starts(firsts)
    windows = np.bincount(text, minlength=len(texts))
    begins = np.cumsum(windows) - windows
    first, second = ({k: np.zeros_like(v) for k, v in network.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        drawn = rng.integers(len(texts), size=rows)
        own = begins[drawn] + rng.integers(windows[drawn])
        place = at[own][None, :] + np.arange(WINDOW)[:, None]
        mask = (place < firsts[1:][text[own]][None, :]).astype(np.float32)
        used, ids = np.unique(which[np.minimum(place, len(which) - 1)], return_inverse=True)
        _, gradient = network.gradients(chars[:, used], length[used], entry[used], ids.reshape(place.shape), mask, toxic[text[own]].astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
        for k, g in gradient.items():  # Adam, with a clipped and a falling rate
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.weights[k] -= rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    x = features(*network.score_windows(pa.array(texts)), len(texts))
    head = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method for the logistic function over a text's windows
        p = _sigmoid(x @ head)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(head))
        head -= np.linalg.solve(hessian, x.T @ (p - toxic) + head)
    network.head = head
    return network


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Network | None:
    """A network fitted to a bounded sample of labelled documents: about per_label ids of each label, the label's share kept
    by weight of the final logistic function's prior. Null ids, texts and labels teach nothing; repeats count once and an id
    with both labels counts as toxic."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    known = known.withColumn("h", F.xxhash64("id", F.lit("toxicity")))
    sample = F.broadcast(bounded_sample(known, "toxic", "h", per_label))  # some thousand ids at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(sample, "id")
    got = rows.groupBy("toxic", F.xxhash64("text").alias("key")).agg(F.any_value("text").alias("text")).collect()
    got.sort(key=lambda r: (r["key"], r["toxic"]))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = np.array([r["toxic"] for r in got], dtype=np.int64)
    network = fit([r["text"] for r in got], toxic) if len(got) else None
    if network is not None:  # the sample holds the labels in other shares than the corpus
        network.head[0] += np.log(share[1] / share[0]) - np.log(toxic.sum() / (len(toxic) - toxic.sum()))
    return network


def score_toxicity(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with score double (0 to 1) and predicted int (1 if score >= 0.5); columns of these names
    are replaced. Null, empty and wordless texts are scored as one empty window; without a network every score is 0."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if network is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            values, out = [t if isinstance(t, str) else "" for t in texts], []
            ends = np.cumsum([len(t) for t in values]) // (1 << 20)
            for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(ends)) + 1):
                out.append(network.predict(pa.array([values[i] for i in part], pa.string())))
            yield pd.Series(np.concatenate(out))

    return docs.drop("score", "predicted").withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
