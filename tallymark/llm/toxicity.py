"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word enters as its own vector, if the training
rows hold it, joined with the mean vector of its hashed character trigrams. Two gated recurrences,
one in each direction, read a window; attention weighs its words; a linear layer gives the window's
logit. The largest logit of a text, calibrated on the training rows, is its score, so that a short
insult in a long text counts as much as in a short one.

Fitting uses a bounded sample of the labelled rows (``SAMPLE`` of each label, of least hash, texts of
up to ``SAMPLE_CHARS``), collected to the driver. As labels belong to whole texts, the windows of
highest logit stand for them; vectors start from the log odds of words and trigrams in the sample.
Scoring covers every window of every whole text, in place: nothing is shuffled.

Defined cases: null and empty texts have no words, hence nothing that speaks for label 1: score 0. Rows
of ``labels`` that repeat an id count as toxic if any is; a null label is not used. Without both
labels in the sample the score is their share, or 0. Rows without an id are scored, and are not held
out. Repeated rows score alike. Only the text is an input of a score.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import alnum_words, arrow_map, map_rows

SAMPLE = 1500
SAMPLE_CHARS = 20_000
VOCABULARY = 20_000
TRIGRAMS = 8192
WORD_DIM = 8
CHAR_DIM = 8
HIDDEN = 8
WINDOW = 32
STEP = 24
EPOCHS = 3
CACHE_WORDS = 100_000
BATCH = 128
#: A small sample is gone through as often as it takes.
LEAST_STEPS = 240
HIDDEN_WORDS = 0.3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(word: bytes) -> list[int]:
    """Buckets of the byte trigrams of a word with its ends marked."""
    marked = b"<" + word[:64] + b">" if len(word) <= 64 else b"<" + word + b">"
    return [zlib.crc32(marked[i : i + 3]) % TRIGRAMS for i in range(max(1, len(marked) - 2))]


class WordInputs:
    """Row numbers of words, in order of their coming, and their trigrams laid end to end."""

    def __init__(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.grams: list[int] = []
        self.counts: list[int] = []

    def row(self, word: bytes) -> int:
        found = self.rows.get(word)
        if found is None:
            found = self.rows[word] = len(self.counts)
            grams = trigrams(word)
            self.grams += grams
            self.counts.append(len(grams))
        return found

    def table(self, text: str | None) -> np.ndarray:
        words = alnum_words(text)
        return np.fromiter(map(self.row, words), np.int32, len(words))


def cut_windows(rows: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) row numbers, -1 beyond the end; a text without words has one such window."""
    starts = range(0, max(1, len(rows) - (WINDOW - STEP)), STEP)
    out = np.full((len(starts), WINDOW), -1, np.int32)
    for i, start in enumerate(starts):
        part = rows[start : start + WINDOW]
        out[i, : len(part)] = part
    return out


class GatedNetwork:
    """Parameters, forward pass and gradients. Inputs are word and trigram vectors."""

    def __init__(self, words: int, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        wide = WORD_DIM + CHAR_DIM
        small = lambda *shape: draw.normal(0, 0.3 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {
            "word": draw.normal(0, 0.05, (words, WORD_DIM)).astype(np.float32),
            "gram": draw.normal(0, 0.05, (TRIGRAMS, CHAR_DIM)).astype(np.float32),
            "att": small(2 * HIDDEN, HIDDEN),
            "pick": small(HIDDEN, 1)[:, 0],
            "out": small(2 * HIDDEN, 1)[:, 0],
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p[f"in_{side}"] = small(wide, 3 * HIDDEN)
            self.p[f"in_{side}_0"] = np.zeros(3 * HIDDEN, np.float32)
            self.p[f"rec_{side}"] = small(HIDDEN, 3 * HIDDEN)

    def vectors(self, ids: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The input vectors of words: their ids, trigrams laid end to end, and trigram counts."""
        if not len(ids):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        sums = np.add.reduceat(self.p["gram"][grams], np.cumsum(counts) - counts, axis=0)
        return np.hstack([self.p["word"][ids], sums / counts[:, None].astype(np.float32)])

    def _recur(self, side: str, given: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; ``given``: inputs times weights, in reading order."""
        n = len(given)
        rec = self.p[f"rec_{side}"]
        state = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, WINDOW, HIDDEN), np.float32)
        steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
        for t in steps:
            x, back = given[:, t], state @ rec
            gates = sigmoid(x[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + reset * back[:, 2 * HIDDEN :])
            live = mask[:, t : t + 1]
            following = np.where(live, (1 - update) * new + update * state, state)
            if keep is not None:
                keep.append((t, state, back, update, reset, new, live))
            state = following
            out[:, t] = state
        return out

    def forward(self, table: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``table``: for each side, word vectors times input weights."""
        mask = windows >= 0
        at = np.where(mask, windows, 0)
        states = []
        for i, side in enumerate("fb"):
            given = table[i][at] if len(table[i]) else np.zeros((*at.shape, 3 * HIDDEN), np.float32)
            steps = [] if keep is not None else None
            states.append(self._recur(side, given, mask, steps))
            if keep is not None:
                keep[side] = steps
        hidden = np.concatenate(states, axis=2)
        bent = np.tanh(hidden @ self.p["att"])
        weight = np.where(mask, np.exp(bent @ self.p["pick"]), 0)
        total = np.maximum(weight.sum(axis=1, keepdims=True), 1e-6)
        weight = weight / total
        pooled = (weight[:, None, :] @ hidden)[:, 0]
        if keep is not None:
            keep.update(mask=mask, at=at, hidden=hidden, bent=bent, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def project(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors @ self.p[f"in_{s}"] + self.p[f"in_{s}_0"] for s in "fb"]

    def gradients(self, vectors: np.ndarray, windows: np.ndarray, target: np.ndarray):
        """(loss, gradients, gradient by word vector) of the logistic loss over windows."""
        keep: dict = {}
        logit = self.forward(self.project(vectors), windows, keep)
        chance = sigmoid(logit)
        loss = -np.mean(target * np.log(chance + 1e-9) + (1 - target) * np.log(1 - chance + 1e-9))
        d_logit = ((chance - target) / len(target)).astype(np.float32)
        grad = {"out": keep["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"]
        hidden, weight, bent, mask = keep["hidden"], keep["weight"], keep["bent"], keep["mask"]
        d_hidden = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = (hidden @ d_pooled[:, :, None])[:, :, 0]
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grad["pick"] = (bent * d_score[:, :, None]).sum(axis=(0, 1))
        d_bent = d_score[:, :, None] * self.p["pick"] * (1 - bent**2)
        flat = hidden.reshape(-1, 2 * HIDDEN)
        grad["att"] = flat.T @ d_bent.reshape(-1, HIDDEN)
        d_hidden = d_hidden + d_bent @ self.p["att"].T
        d_vectors = np.zeros_like(vectors)
        for i, side in enumerate("fb"):
            d_given = self._recur_back(side, keep[side], d_hidden[:, :, i * HIDDEN : (i + 1) * HIDDEN], grad)
            d_given[~mask] = 0
            at = keep["at"]
            by_word = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
            np.add.at(by_word, at[mask], d_given[mask])
            grad[f"in_{side}"] = vectors.T @ by_word
            grad[f"in_{side}_0"] = by_word.sum(axis=0)
            d_vectors += by_word @ self.p[f"in_{side}"].T
        return loss, grad, d_vectors

    def _recur_back(self, side: str, steps: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
        rec = self.p[f"rec_{side}"]
        d_given = np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32)
        d_rec = np.zeros_like(rec)
        d_state = np.zeros((d_out.shape[0], HIDDEN), np.float32)
        for t, state, back, update, reset, new, live in reversed(steps):
            d_next = d_state + d_out[:, t]
            d_step = np.where(live, d_next, 0)
            d_new = d_step * (1 - update) * (1 - new**2)
            d_update = d_step * (state - new) * update * (1 - update)
            d_reset = d_new * back[:, 2 * HIDDEN :] * reset * (1 - reset)
            d_back = np.hstack([d_update, d_reset, d_new * reset])
            d_given[:, t] = np.hstack([d_update, d_reset, d_new])
            d_rec += state.T @ d_back
            d_state = np.where(live, d_step * update, d_next) + d_back @ rec.T
        grad[f"rec_{side}"] = d_rec
        return d_given


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.step = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def move(self, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        lift = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, g in grad.items():
            self.first[name] += 0.1 * (g - self.first[name])
            self.second[name] += 0.001 * (g * g - self.second[name])
            self.params[name] -= self.rate * lift * self.first[name] / (np.sqrt(self.second[name]) + 1e-8)


class ToxicityModel:
    """The network, its vocabulary, and the calibration of the largest logit."""

    def __init__(self, vocabulary: dict[bytes, int], network: GatedNetwork) -> None:
        self.vocabulary, self.network = vocabulary, network
        self.scale, self.shift, self.constant = 1.0, 0.0, None
        self._inputs: WordInputs | None = None
        self._table: list[np.ndarray] = []

    def __getstate__(self):
        return self.__dict__ | {"_inputs": None, "_table": []}

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text; minus infinity for a text without words."""
        if self._inputs is None or len(self._inputs.counts) > CACHE_WORDS:
            self._inputs, self._table = WordInputs(), []
        windows = [cut_windows(self._inputs.table(text)) for text in texts]
        owners = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
        self._grow()
        stacked = np.concatenate(windows)
        logits = np.concatenate(
            [
                self.network.forward(self._table, stacked[i : i + 256])
                for i in range(0, len(stacked), 256)
            ]
        )
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owners[stacked[:, 0] >= 0], logits[stacked[:, 0] >= 0])
        return out

    def _grow(self) -> None:
        """Add the words that have come since to the table of projected inputs."""
        done = len(self._table[0]) if self._table else 0
        net, ins = self.network, self._inputs
        counts = np.array(ins.counts[done:], np.int64)
        grams = np.array(ins.grams[len(ins.grams) - int(counts.sum()) :], np.int64)
        fresh = list(ins.rows)[done:]
        ids = np.array([self.vocabulary.get(word, 0) for word in fresh], np.int64)
        more = net.project(net.vectors(ids, grams, counts))
        self._table = [np.concatenate(x) for x in zip(self._table, more)] if self._table else more

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        if self.constant is not None:
            return [self.constant] * len(texts)
        logits = np.clip(self.largest(texts) * self.scale + self.shift, -700, 700)
        return (1 / (1 + np.exp(-logits))).tolist()


def _log_odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Smoothed log odds between labels 1 and 0; ``seen``: how many texts of each label hold it.

    Shrunk where few texts hold it.
    """
    odds = np.log((seen[1] + 0.5) / (texts[1] + 1)) - np.log((seen[0] + 0.5) / (texts[0] + 1))
    return odds * np.minimum(1, seen.sum(axis=0) / 5)


def fit(
    texts: list[str],
    labels: list[int],
    epochs: int = EPOCHS,
    seed: int = 11,
    share: float | None = None,
) -> ToxicityModel:
    """Train on whole texts: vectors from log odds, then gradient steps on windows that stand for them.

    ``share`` of label 1 among all labelled rows corrects for a sample with another share.
    """
    target = np.array(labels, np.float32)
    # Every fifth text of each label is left out of the fit and sets the calibration.
    aside = np.zeros(len(texts), bool)
    for value in (0, 1):
        aside[np.flatnonzero(target == value)[4::5]] = True
    inputs = WordInputs()
    rows = [inputs.table(text) for text in texts]
    counts = np.array(inputs.counts, np.int64)
    grams, starts = np.array(inputs.grams, np.int64), np.cumsum(counts) - counts

    def grams_of(used: np.ndarray) -> np.ndarray:
        """The trigrams of words, laid end to end."""
        many = counts[used]
        return grams[np.repeat(starts[used] - (np.cumsum(many) - many), many) + np.arange(many.sum())]

    held, grams_held, shown = np.zeros((2, len(counts))), np.zeros((2, TRIGRAMS)), np.zeros(2)
    for own, label, out in zip(rows, labels, aside):
        if not out:
            used = np.unique(own)
            held[label, used] += 1
            grams_held[label, np.unique(grams_of(used))] += 1
            shown[label] += 1
    total = held.sum(axis=0)
    names = list(inputs.rows)
    often = [i for i in np.argsort(-total, kind="stable")[:VOCABULARY].tolist() if total[i] > 1]
    vocabulary = {names[r]: i + 1 for i, r in enumerate(often)}
    network = GatedNetwork(len(vocabulary) + 1, seed)
    model = ToxicityModel(vocabulary, network)
    if len(set(labels)) < 2:
        model.constant = float(target.mean()) if len(labels) else 0.0
        return model
    network.p["word"][1:, 0] = 0.5 * _log_odds(held, shown)[often]
    network.p["gram"][:, 0] = np.where(grams_held.sum(axis=0) > 0, 0.25 * _log_odds(grams_held, shown), 0)

    ids = np.zeros(len(counts), np.int64)
    ids[often] = np.arange(1, len(often) + 1)
    windows = [cut_windows(own) for own in rows]
    stacked = np.concatenate(windows)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
    told = np.array([len(own) > 0 for own in rows])
    del names, rows, windows, held
    adam = Adam(network.p, 0.01)
    draw = np.random.default_rng(seed)
    # Before the first epoch, the word of highest log odds tells which window stands for a text.
    start = network.vectors(ids, grams, counts)[:, [0, WORD_DIM]].sum(axis=1)
    logits = np.where(stacked >= 0, start[np.maximum(stacked, 0)], -9).max(axis=1)
    for _ in range(epochs):
        order = np.lexsort((-logits, owner))
        best = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        best = best[~aside[owner[best]]]
        ones = best[target[owner[best]] > 0]
        zeros = best[target[owner[best]] == 0]
        others = np.flatnonzero((target[owner] == 0) & ~aside[owner])
        others = draw.choice(others, min(len(others), max(len(zeros), len(ones))), replace=False)
        zeros = np.concatenate([zeros, others])
        # Both labels weigh alike; the calibration knows their shares.
        chosen = np.concatenate([np.resize(draw.permutation(ones), len(zeros)), zeros])
        passes = max(1, math.ceil(LEAST_STEPS / epochs / math.ceil(len(chosen) / BATCH)))
        queue = np.concatenate([draw.permutation(chosen) for _ in range(passes)])
        for i in range(0, len(queue), BATCH):
            part = queue[i : i + BATCH]
            some = stacked[part]
            used = np.unique(some[some >= 0])
            local = np.where(some >= 0, np.searchsorted(used, some), -1)
            # Some words enter by their characters alone, so that no text is learnt by heart.
            known = np.where(draw.random(len(used)) < HIDDEN_WORDS, 0, ids[used])
            own_grams = grams_of(used)
            vectors = network.vectors(known, own_grams, counts[used])
            _, grad, d_vectors = network.gradients(vectors, local, target[owner[part]])
            grad["word"] = np.zeros_like(network.p["word"])
            np.add.at(grad["word"], known, d_vectors[:, :WORD_DIM])
            grad["word"][0] = 0
            grad["gram"] = np.zeros_like(network.p["gram"])
            place = np.repeat(np.arange(len(used)), counts[used])
            spread = (d_vectors[:, WORD_DIM:] / counts[used][:, None])[place]
            np.add.at(grad["gram"], own_grams, spread)
            adam.move(grad)
        table = network.project(network.vectors(ids, grams, counts))
        logits = np.concatenate(
            [network.forward(table, stacked[i : i + 256]) for i in range(0, len(stacked), 256)]
        )
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, logits)
    if len(set(target[told & aside])) == 2:
        told &= aside
    if len(set(target[told])) == 2:
        model.scale, model.shift = calibrate(best[told], target[told])
        if share is not None:
            odds_of = lambda x: math.log(x / (1 - x))
            model.shift += odds_of(min(max(share, 1e-3), 1 - 1e-3)) - odds_of(float(target[told].mean()))
    return model


def calibrate(logits: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Scale and shift by logistic regression on the largest logits (bounded Newton steps)."""
    a, b = 1.0, 0.0
    center, width = float(logits.mean()), float(logits.std()) + 1e-6
    x = (logits - center) / width
    goal = np.where(target > 0, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
    for _ in range(100):
        chance = sigmoid(a * x + b)
        slope = chance * (1 - chance)
        g = np.array([((chance - goal) * x).sum() + 0.1 * a, (chance - goal).sum()])
        h = np.array([[(slope * x * x).sum() + 0.1, (slope * x).sum()], [(slope * x).sum(), slope.sum()]])
        step = np.clip(np.linalg.solve(h + 1e-6 * np.eye(2), g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    a = max(a, 1e-3)
    return float(a / width), float(b - a * center / width)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    sample: int = SAMPLE,
    epochs: int = EPOCHS,
) -> ToxicityModel:
    """Fit on labelled rows whose fold is not 0, at most ``sample`` of each label."""
    told = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
    told = told.agg(F.max(F.col(label_col)).cast("int").alias("label"))
    told = told.where(~held_out(F.col("key"), folds) & F.col("label").isin(0, 1))
    parts = [
        told.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(2 * sample)
        for value in (0, 1)
    ]
    chosen = reduce(DataFrame.unionByName, parts)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "key").select("key", "label", "text")  # 4 * sample ids
    picked = [
        rows.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key", "text").limit(sample)
        for value in (0, 1)
    ]
    found = reduce(DataFrame.unionByName, picked).collect()
    share = told.agg(F.avg("label")).first()[0]
    return fit([r.text for r in found], [r.label for r in found], epochs, share=share)


def held_out(key, folds: int):
    """Whether crc32 of the id as text leaves no remainder; false for rows without an id."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
) -> DataFrame:
    """(id, held_out, score, predicted), a row per document."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {id_col: rows[id_col], "score": model.scores(rows[text_col])}

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_rows(docs, [id_col, text_col], f"{id_col} {kind}, score double", work)
    return scored.select(
        id_col,
        held_out(F.col(id_col), folds).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that the model does not predict as toxic."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                scores = np.array(model.scores(part.column(at).to_pylist()))
                yield part.filter(pa.array(scores < 0.5, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
