"""Language-model scoring with causal self-attention over subword ids, in numpy.

The tokens of a text are its words and one end. A word comes in by the subword ids of a public
vocabulary that it begins and ends with, and by its class. Its probability is that of its class
given the words before, from a causal self-attention layer with a feed forward layer, times its
share of the class. Shares are corpus counts, with what a Good-Turing estimate leaves for new words
spread over all spellings: by pairs of their subword ids, and by known words with other marks
around them. Shares sum to one at most, so a score is a proper log probability. A text is read in windows that overlap: each token is scored
once, with at least ``CONTEXT`` tokens before it in view (fewer at the beginning); windows of many
texts are worked on together under one mask.

Classes are topics cut into bands of frequency. A pass over all training texts counts each word
and sums, over its places, random signatures of the words around it in its text; Spark adds both
up per word, and the signatures of frequent words are clustered into topics (of this corpus: its
languages). Words beyond those take the topic that their subword ids point to.

The layer starts from a fit to a bounded sample on the driver. Then every task trains a copy of it
on all windows of all its training texts, and the copies are averaged, sixty-four at a time.

The ``TOP_WORDS`` most frequent words of up to ``TOP_BYTES`` bytes travel with the tasks, a bounded
list; the words a text has besides are joined to the counts by a shuffle, for the base and the
score alike. Building runs jobs: counts, classes, the layer, and the scores of texts are written.

Defined cases: a null or empty text is its end alone; texts of any length are read whole. Rows
without an id are training rows, as their remainder is none. Repeated rows count and score each.
Words of equal count are put in order by their bytes. Without training rows counts are zero and the
layer stays at its first values; scores are finite. Extra columns are not read, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bpe import read_ranks, slices, tokens_of
from tallymark.llm.common import _arrow_schema, arrow_map, space_words, store  # noqa: F401
from tallymark.llm.toxicity import Adam

VOCABULARY_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces that merges do not cross: letters, digits, other marks, each with a blank before it.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
TOP_WORDS = 200_000
TOP_BYTES = 64
#: Words a task counts before it hands them on, and words it remembers besides the top ones.
COUNTED, REMEMBERED = 400_000, 200_000
SIGNATURE, TOPICS, BANDS = 8, 6, 8
#: Most frequent words whose signatures are clustered.
CLUSTERED = 20_000
DIM, BUCKETS = 16, 2048
CONTEXT, SCORED = 12, 20
WINDOW = CONTEXT + SCORED
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 20_000
BATCH = 192
#: Bytes of texts worked on together.
TEXT_BYTES = 2 << 20
#: Windows worked on at once, so few that what the layer makes of them stays in a core's cache.
AT_ONCE = 64


#: Pairs of subword ids whose own counts are used; the places of others follow the second id alone.
TOP_PAIRS = 300_000
#: What counts of a pair's first id are raised by, spread as the second ids are.
PAIR_PRIOR = 5.0
#: Marks that may stand around a word.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


@lru_cache(maxsize=2)
def subwords(ranks: bytes):
    """(encoder of text into ids, number of ids)."""
    coder, blank = _coder(ranks)
    return coder.encode_ordinary, len(blank)


#: White space other than a blank, which may stand inside words and would join pieces across them.
ODD_SPACE = re.compile(r"[^\S ]")


@lru_cache(maxsize=2)
def _coder(ranks: bytes):
    """(library encoder, whether each id begins with a blank)."""
    import tiktoken

    tokens = tokens_of(ranks)
    blank = np.zeros(max(tokens.values()) + 1, bool)
    blank[[i for token, i in tokens.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("subwords", pat_str=PIECES, mergeable_ranks=tokens, special_tokens={}), blank


def encoded(ranks: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, ids in each word): each word's as with a blank before it.

    Words are encoded many at a time, as no piece crosses a blank, and cut apart where an id begins
    with one.
    """
    coder, blank = _coder(ranks)
    ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), 256):
        some = words[i : i + 256]
        text = " " + b" ".join(some).decode("utf-8", "replace")
        apart = [text] if ODD_SPACE.search(text) is None else [" " + w.decode("utf-8", "replace") for w in some]
        found = [np.asarray(coder.encode_to_numpy(t, disallowed_special=()), np.int64) for t in apart]
        if len(apart) == 1:
            lengths.append(np.diff(np.flatnonzero(blank[found[0]]), append=len(found[0])))
        else:
            lengths.append(np.array([len(f) for f in found]))
        ids.extend(found)
    return np.concatenate(ids), np.concatenate(lengths)


class Numbered(dict):
    """Numbers of words, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Lexicon:
    """What is known of words without their counts: a row each, the top words first."""

    def __init__(self, ranks: bytes, top: list[bytes], kinds: np.ndarray, topic_of: np.ndarray) -> None:
        self.ranks, self.top, self.topic_of = ranks, top, topic_of
        self.n_top, self.top_kinds = len(top), kinds
        self.spelling: Spelling | None = None
        self.rows: dict[bytes, int] = {}
        self._ready: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"rows": {}}

    def without_spelling(self) -> Lexicon:
        """The same words; what they cost to spell is not worked out."""
        plain = Lexicon(self.ranks, self.top, self.top_kinds, self.topic_of)
        first, last, kinds, _ = self.ready()
        plain._ready = (None, [first, last, kinds, np.zeros(len(first))])
        return plain

    def ready(self) -> list[np.ndarray]:
        """What is known of the top words, worked out once and sent along."""
        if self._ready is None or self._ready[0] is not self.spelling:
            tops = {w: i for i, w in enumerate(self.top)}
            self._ready = (self.spelling, self._made(self.top, self.top_kinds, tops))
        return self._ready[1]

    def places(self, texts: list[list[bytes]]) -> np.ndarray:
        """The rows of all words of the texts, one after the other; words not known yet are added."""
        if not self.rows or len(self.rows) > self.n_top + REMEMBERED:
            self.rows = Numbered(zip(self.top, range(self.n_top)))
            self.first, self.last, self.kind, self.spelled = self.ready()
        known = len(self.rows)
        flat = itertools.chain.from_iterable(texts)
        at = np.fromiter(map(self.rows.__getitem__, flat), np.int64, sum(map(len, texts)))
        if len(self.rows) > known:
            made = self._made(list(itertools.islice(self.rows, known, None)), None, self.rows)
            held = [self.first, self.last, self.kind, self.spelled]
            self.first, self.last, self.kind, self.spelled = (np.concatenate(both) for both in zip(held, made))
        return at

    def _made(self, words: list[bytes], kinds: np.ndarray | None, tops: dict[bytes, int]) -> list[np.ndarray]:
        """(first, last, kind, spelled) of words."""
        ids, lengths = encoded(self.ranks, words)
        stop = np.cumsum(lengths)
        first, last = ids[stop - lengths], ids[stop - 1]
        if kinds is None:
            kinds = (self.topic_of[first] + self.topic_of[last]).argmax(axis=1) * BANDS + BANDS - 1
        spelled = np.zeros(len(words))
        if self.spelling is not None:
            spelled = self.spelling.chances_of(words, ids, lengths, tops)
        return [(first % BUCKETS).astype(np.int16), (last % BUCKETS).astype(np.int16), kinds.astype(np.int16), spelled]


def id_pairs(ids: list[list[int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, word) of neighbours in each word, its beginning and end included, one number a pair."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return pairs_of(np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(lengths.sum())), lengths, size)


def pairs_of(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``id_pairs`` of words whose ids stand one after the other."""
    start = np.cumsum(lengths + 2) - lengths - 2
    flat = np.full(int((lengths + 2).sum()), size, np.int64)
    inside = np.repeat(start + 1, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[inside] = ids
    flat[start + lengths + 1] = size + 1
    kept = np.ones(max(len(flat) - 1, 0), bool)
    kept[start[1:] - 1] = False  # from one word's end to the next one's beginning
    pair = flat[:-1] * (size + 2) + flat[1:]
    return pair[kept], np.repeat(np.arange(len(lengths)), lengths + 1)


class Spelling:
    """log10 chance of a word's spelling, out of all words counted, each once."""

    def __init__(
        self, uses: np.ndarray, pairs: np.ndarray, times: np.ndarray, top: list[bytes], top_c: np.ndarray
    ) -> None:
        # Ids, then a word's beginning and end; what follows an id is an id or the end.
        self.size = len(uses) - 2
        chance = uses + 0.5
        chance[self.size] = 0.0
        self.alone = chance / chance.sum()
        after = uses.copy()
        after[self.size] = uses[self.size + 1]  # words have as many beginnings as ends
        order = np.argsort(pairs)
        self.pairs, self.times = pairs[order], times[order]
        told = np.bincount(pairs // len(uses), times, len(uses))
        self.after, self.rest = after + PAIR_PRIOR, after - told + PAIR_PRIOR
        # Words without marks around them, and the marks of those with some, by side.
        self.word = np.log10(top_c / top_c.sum()) if len(top_c) else top_c
        self.marks = np.zeros((2, 256))
        sides = np.ones((2, 256))
        sides[:, 0] = len(top) + 1.0
        for word in top:
            core = word.strip(MARKS)
            if core and len(core) < len(word):
                at = word.index(core)
                for side, marks in enumerate((word[:at], word[at + len(core) :])):
                    for mark in marks:
                        sides[side, mark] += 1.0
        self.marks = np.log10(sides / sides.sum(axis=1, keepdims=True))

    def chances(self, words: list[bytes], ids: list[list[int]], tops: dict[bytes, int]) -> np.ndarray:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return self.chances_of(words, np.array(list(itertools.chain.from_iterable(ids)), np.int64), lengths, tops)

    def chances_of(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray, tops: dict[bytes, int]) -> np.ndarray:
        pair, owner = pairs_of(ids, lengths, self.size)
        place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        times = np.where(self.pairs[place] == pair, self.times[place], 0.0) if len(self.pairs) else 0.0
        before, then = pair // (self.size + 2), pair % (self.size + 2)
        chance = (times + self.rest[before] * self.alone[then]) / self.after[before]
        by_ids = np.bincount(owner, np.log10(chance), len(lengths))
        by_marks = np.full(len(words), -np.inf)
        for i in [i for i, word in enumerate(words) if word[0] in MARKS or word[-1] in MARKS]:
            word, core = words[i], words[i].strip(MARKS)
            if core and (row := tops.get(core, len(self.word))) < len(self.word):
                at = word.index(core)
                around = self.marks[0, 0] + self.marks[1, 0]
                for side, marks in enumerate((word[:at], word[at + len(core) :])):
                    for mark in marks:
                        around += self.marks[side, mark]
                by_marks[i] = self.word[row] + around
        mixed = np.stack([by_ids, by_marks]) + math.log10(0.5)
        top = mixed.max(axis=0)
        return top + np.log10((10.0 ** (mixed - top)).sum(axis=0))


def windows_of(first: np.ndarray, last: np.ndarray, kind: np.ndarray, lengths: np.ndarray, end: int):
    """(inputs (3, windows, WINDOW), wanted (windows, SCORED), owner) of texts, one after the other.

    Inputs are the words before: their first and last subwords and classes, then marks for the
    beginning and for no word. ``wanted`` holds classes, the ``end`` last, and -1 beyond a text.
    Numbers are short ones, as windows show most words twice.
    """
    tokens = lengths + 1
    counts = -(-tokens // SCORED)
    padded = CONTEXT + counts * SCORED
    start = np.cumsum(padded) - padded
    total = int(padded.sum())
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at += np.repeat(start, lengths) + CONTEXT
    flat = np.empty((3, total), np.int16)
    flat[0], flat[1], flat[2] = BUCKETS + 1, BUCKETS + 1, end + 2
    flat[:, start + CONTEXT] = [[BUCKETS], [BUCKETS], [end + 1]]
    flat[0, at + 1], flat[1, at + 1], flat[2, at + 1] = first, last, kind
    target = np.full(total, -1, np.int16)
    target[at] = kind
    target[start + CONTEXT + lengths] = end
    owner = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = start[owner] + number * SCORED
    inputs = np.stack([sliding_window_view(row, WINDOW)[begin] for row in flat])
    return inputs, sliding_window_view(target, SCORED)[begin + CONTEXT], owner


#: 1 where a scored place may look, at itself and before.
CAUSAL = np.tri(SCORED, WINDOW, CONTEXT, np.float32)
#: Exponents beyond this are cut to it, so that sums of single precision stay finite.
FAR = 60.0


def summed_by(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values' rows that share a number, a row for each number below ``size``."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows.astype(np.int16), kind="stable")  # a radix sort
        ordered = rows[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        out[ordered[start]] = np.add.reduceat(values.take(order, axis=0), start, axis=0)
    return out


def times(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``a @ weights`` as one product of two matrices, not one for each window."""
    return (a.reshape(-1, a.shape[-1]) @ weights).reshape(*a.shape[:-1], weights.shape[1])


class FlatAdam:
    """``Adam`` with all parameters in one array, whose parts take the place of those given."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.names, self.rate, self.step = list(params), rate, 0
        self.flat = np.concatenate([v.ravel() for v in params.values()])
        self.first, self.second, self.spare = (np.zeros_like(self.flat) for _ in range(3))
        at = 0
        for name, v in params.items():
            params[name] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size

    def move(self, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        lift = math.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        g, t = np.concatenate([grad[name].ravel() for name in self.names]), self.spare
        np.subtract(g, self.first, out=t)
        t *= 0.1
        self.first += t
        g *= g
        g -= self.second
        g *= 0.001
        self.second += g
        np.sqrt(self.second, out=t)
        t += 1e-8
        np.divide(self.first, t, out=t)
        t *= self.rate * lift
        self.flat -= t


class AttentionLayer:
    """Causal self-attention and feed forward over windows; predicts the class of each wanted token."""

    def __init__(self, prior: np.ndarray, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        some = lambda *shape: draw.normal(0, 0.5 / np.sqrt(shape[0]), shape).astype(np.float32)
        near = lambda size, *shape: draw.normal(0, size, shape).astype(np.float32)
        classes = len(prior)
        self.p = {
            "first": near(0.1, BUCKETS + 2, DIM),
            "last": near(0.1, BUCKETS + 2, DIM),
            "kind": near(0.3, classes + 2, DIM),
            "place": near(0.1, WINDOW, DIM),
            "query": some(DIM, DIM),
            "key": some(DIM, DIM),
            "value": some(DIM, DIM),
            "mix": some(DIM, DIM),
            "wide": some(DIM, 2 * DIM),
            "wide_0": np.zeros(2 * DIM, np.float32),
            "narrow": some(2 * DIM, DIM),
            "out": some(DIM, classes) * 0.2,
            "out_0": prior.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, v in self.p.items():
            self.p[name] = np.asarray(flat[at : at + v.size], np.float32).reshape(v.shape).copy()
            at += v.size

    def tables(self) -> list[np.ndarray]:
        """Vectors of each input, and what turns a place's into its query, key and value."""
        p = self.p
        turn = np.concatenate([p["query"] * DIM**-0.5, p["key"], p["value"]], axis=1)
        return [*(p[name] for name in ("first", "last", "kind", "place")), turn.astype(p["query"].dtype)]

    def forward(self, inputs: np.ndarray, tables: list[np.ndarray], keep: dict | None = None) -> np.ndarray:
        """Logits of classes (windows, SCORED, classes).

        Exponents are held within ``FAR``, which stands in for taking the largest from them, and
        weights are divided by their sum after they have met the values: fewer passes, same result.
        """
        p, n = self.p, inputs.shape[1]
        x = tables[0].take(inputs[0], axis=0)
        x += tables[1].take(inputs[1], axis=0)
        x += tables[2].take(inputs[2], axis=0)
        x += tables[3]
        turned = times(x, tables[4])
        query, key, value = turned[:, CONTEXT:, :DIM], turned[:, :, DIM : 2 * DIM], turned[:, :, 2 * DIM :]
        weight = query @ key.transpose(0, 2, 1)
        np.clip(weight, -FAR, FAR, out=weight)
        np.exp(weight, out=weight)
        weight *= CAUSAL
        absent = inputs[0][:, :CONTEXT] == BUCKETS + 1
        if absent.any():
            weight[:, :, :CONTEXT] *= ~absent[:, None, :]
        total = weight.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), weight.dtype)
        seen = (weight @ value).reshape(-1, DIM)
        seen /= total
        mixed = seen @ p["mix"]
        mixed += x[:, CONTEXT:].reshape(-1, DIM)
        wide = mixed @ p["wide"]
        wide += p["wide_0"]
        np.maximum(wide, 0, out=wide)
        top = wide @ p["narrow"]
        top += mixed
        if keep is not None:
            keep.update(x=x, query=query, key=key, value=value, weight=weight, total=total)
            keep.update(seen=seen, mixed=mixed, wide=wide, top=top)
        logit = top @ p["out"]
        logit += p["out_0"]
        return logit.reshape(n, SCORED, -1)

    def likelihood(self, logit: np.ndarray, wanted: np.ndarray):
        """(log chance of each wanted class, exponents, their sums), a row a place; ``logit`` is used up."""
        logit = logit.reshape(-1, logit.shape[-1])
        np.clip(logit, -FAR, FAR, out=logit)
        picked = logit[np.arange(len(logit)), np.maximum(wanted.ravel(), 0)]
        np.exp(logit, out=logit)
        total = logit @ np.ones(logit.shape[1], logit.dtype)
        return picked - np.log(total), logit, total

    def gradients(self, inputs: np.ndarray, wanted: np.ndarray):
        """(mean loss, gradients) of the class log likelihood, added up over a few windows at a time."""
        tables, n = self.tables(), max(1, int((wanted >= 0).sum()))
        d_x = np.empty((*inputs.shape[1:], DIM), self.p["query"].dtype)
        loss, grad = 0.0, {}
        for i in range(0, len(wanted), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            gained, part = self._part(inputs[:, some], wanted[some], tables, n, d_x[some])
            loss -= gained
            for name, value in part.items():
                grad[name] = grad[name] + value if i else value
        turn = grad.pop("turn")
        grad["query"] = turn[:, :DIM] * d_x.dtype.type(DIM**-0.5)
        grad["key"], grad["value"] = turn[:, DIM : 2 * DIM], turn[:, 2 * DIM :]
        grad["place"] = d_x.sum(axis=0)
        flat = d_x.reshape(-1, DIM)
        for i, name in enumerate(("first", "last", "kind")):
            grad[name] = summed_by(inputs[i].ravel(), flat, len(self.p[name]))
        return loss, grad

    def _part(self, inputs: np.ndarray, wanted: np.ndarray, tables: list[np.ndarray], n: int, d_x: np.ndarray):
        """(log likelihood over n, gradients) of some windows; those of their inputs go into ``d_x``."""
        k: dict = {}
        p = self.p
        told, d_logit, total = self.likelihood(self.forward(inputs, tables, k), wanted)
        share = ((wanted >= 0).ravel() / n).astype(d_logit.dtype)
        d_logit *= (share / total)[:, None]
        d_logit[np.arange(len(d_logit)), np.maximum(wanted.ravel(), 0)] -= share
        ones = np.ones(len(d_logit), d_logit.dtype)
        grad = {"out": k["top"].T @ d_logit, "out_0": ones @ d_logit}
        d_mixed = d_logit @ p["out"].T
        grad["narrow"] = k["wide"].T @ d_mixed
        d_wide = d_mixed @ p["narrow"].T
        d_wide *= k["wide"] > 0
        grad["wide"], grad["wide_0"] = k["mixed"].T @ d_wide, ones @ d_wide
        d_mixed += d_wide @ p["wide"].T
        grad["mix"] = k["seen"].T @ d_mixed
        d_seen = d_mixed @ p["mix"].T
        d_seen /= k["total"]
        around = np.einsum("ij,ij->i", d_seen, k["seen"]).reshape(*wanted.shape, 1)
        d_seen = d_seen.reshape(*wanted.shape, DIM)
        d_score = d_seen @ k["value"].transpose(0, 2, 1)
        d_score -= around
        d_score *= k["weight"]
        d_turned = np.zeros((*inputs.shape[1:], 3 * DIM), d_logit.dtype)
        d_turned[:, CONTEXT:, :DIM] = d_score @ k["key"]
        d_turned[:, :, DIM : 2 * DIM] = d_score.transpose(0, 2, 1) @ k["query"]
        d_turned[:, :, 2 * DIM :] = k["weight"].transpose(0, 2, 1) @ d_seen
        grad["turn"] = k["x"].reshape(-1, DIM).T @ d_turned.reshape(-1, 3 * DIM)
        d_x[:] = times(d_turned, tables[4].T)
        d_x[:, CONTEXT:] += d_mixed.reshape(*wanted.shape, DIM)
        return float(told @ share), grad

    def train(self, inputs: np.ndarray, wanted: np.ndarray, adam: Adam | FlatAdam, draw: np.random.Generator) -> None:
        """One step for each ``BATCH`` windows, in random order."""
        order = draw.permutation(len(wanted))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            adam.move(self.gradients(inputs[:, part], wanted[part])[1])

    def log10(self, inputs: np.ndarray, wanted: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """log10 probability of the wanted classes, summed over each window."""
        out = np.empty(len(wanted))
        for i in range(0, len(wanted), AT_ONCE):
            some = wanted[i : i + AT_ONCE]
            told = self.likelihood(self.forward(inputs[:, i : i + AT_ONCE], tables), some)[0].reshape(some.shape)
            out[i : i + AT_ONCE] = np.where(some >= 0, told, 0).sum(axis=1, dtype=np.float64)
        return out / math.log(10)


def held_out(key, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``; false for rows without an id."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts are worked on together; a very long text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for part in slices(list(range(batch.num_rows)), sizes, TEXT_BYTES):
        yield batch.slice(part[0], len(part))


def split_texts(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the word at each place, words in each text), words as ``space_words`` has them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)  # none before the first blank and after the last
    words, owner = words.filter(real).dictionary_encode(), owner.filter(real).to_numpy()
    distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return distinct, words.indices.to_numpy().astype(np.int64), np.bincount(owner, minlength=len(texts))


def signs_of(words: list[bytes]) -> np.ndarray:
    """The signature of each word alone: signs by the bits of its CRC32."""
    bits = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return (((bits[:, None] >> np.arange(SIGNATURE)) & 1) * 2 - 1).astype(np.int8)


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, c, s0, s1, ...): places of each word, and the summed mean signatures around them."""
    names = [f"s{j}" for j in range(SIGNATURE)]

    def run(batches):
        rows, signs, sums = Numbered(), np.zeros((SIGNATURE, 0), np.int8), np.zeros((SIGNATURE + 1, 0))
        for batch in batches:
            for part in text_slices(batch, 0):
                distinct, at, lengths = split_texts(part.column(0))
                known = len(rows)
                at = np.fromiter(map(rows.__getitem__, distinct), np.int64, len(distinct)).take(at)
                n = len(rows)
                if n > sums.shape[1]:  # room for half as many again
                    room = ((0, 0), (0, n + n // 2 - sums.shape[1]))
                    signs, sums = np.pad(signs, room), np.pad(sums, room)
                signs[:, known:n] = signs_of(list(itertools.islice(rows, known, None))).T
                owner = np.repeat(np.arange(len(lengths)), lengths)
                share = (1.0 / np.maximum(lengths - 1, 1))[owner]
                for j in range(SIGNATURE):
                    own = signs[j].take(at).astype(np.float64)
                    around = np.bincount(owner, own, len(lengths)).astype(np.float64).take(owner)
                    around -= own
                    around *= share
                    sums[j, :n] += np.bincount(at, around, n)
                sums[SIGNATURE, :n] += np.bincount(at, minlength=n)
                if n >= COUNTED:
                    yield told(rows, sums[:, :n])
                    rows, signs, sums = Numbered(), np.zeros((SIGNATURE, 0), np.int8), np.zeros((SIGNATURE + 1, 0))
        yield told(rows, sums[:, : len(rows)])

    def told(rows: dict[bytes, int], sums: np.ndarray) -> pa.RecordBatch:
        words = pa.array([w.decode("utf-8", "replace") for w in rows], pa.string())
        columns = [pa.array(sums[j].astype(np.float32)) for j in range(SIGNATURE)]
        counts = pa.array(sums[SIGNATURE].astype(np.int64))
        return pa.RecordBatch.from_arrays([words, counts, *columns], names=["word", "c", *names])

    schema = "word string, c long, " + ", ".join(f"{n} float" for n in names)
    counted = arrow_map(texts.select(text_col), run, schema).groupBy("word")
    return counted.agg(F.sum("c").alias("c"), *[F.sum(n).cast("float").alias(n) for n in names])


def cluster(signatures: np.ndarray, counts: np.ndarray, clusters: int) -> np.ndarray:
    """The cluster of each row (most frequent rows first) by direction from the mean."""
    if not len(counts):
        return np.zeros(0, np.int64)
    means = signatures / counts[:, None]
    means = means - np.average(means, axis=0, weights=counts)
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    some, weight = unit[:CLUSTERED], np.sqrt(counts[:CLUSTERED])
    centres = some[:1]
    while len(centres) < min(clusters, len(some)):
        centres = np.concatenate([centres, some[[((some @ centres.T).max(axis=1) * weight - 2 * weight).argmin()]]])
    for _ in range(20):
        near = (some @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(near, weight * some[:, j], len(centres)) for j in range(some.shape[1])], axis=1)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return (unit @ centres.T).argmax(axis=1)


def bands_of(topics: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each row (most frequent first): topic, and band of about equal mass within it."""
    kinds = topics * BANDS
    for topic in range(TOPICS):
        mine = np.flatnonzero(topics == topic)
        mass = np.cumsum(counts[mine].astype(float))
        if len(mine):
            kinds[mine] += np.minimum((mass - counts[mine] / 2) * BANDS // mass[-1], BANDS - 1).astype(np.int64)
    return kinds


def most_frequent(rows: DataFrame, count: str, order: str, n: int) -> pa.Table:
    """The ``n`` rows of the largest ``count`` (1 or more), largest first, equal ones by ``order``.

    Rows are counted by eighths of a doubling first. Only those that reach the last one needed are put
    in order, so that no task holds ``n`` rows of its own for another to merge.
    """
    levels = rows.groupBy(F.floor(F.log2(count) * 8).alias("level")).agg(F.count("*").alias("n"), F.min(count).alias("least"))
    held, least = 0, 1
    for level in sorted(levels.collect(), reverse=True):  # a few hundred
        held, least = held + level.n, level.least
        if held >= n:
            break
    return rows.where(F.col(count) >= least).orderBy(F.desc(count), order).limit(n).toArrow()


def make_lexicon(counts: DataFrame, ranks: bytes, top_words: int) -> tuple[Lexicon, np.ndarray]:
    """The lexicon of the most frequent words, and their counts."""
    short = counts.where(F.octet_length("word") <= TOP_BYTES)
    top = most_frequent(short, "c", "word", top_words)
    words = [w.encode() for w in top.column("word").to_pylist()]
    c = top.column("c").to_numpy().astype(np.float64)
    signatures = np.stack([top.column(f"s{j}").to_numpy() for j in range(SIGNATURE)], axis=1).astype(np.float64)
    topics = cluster(signatures, c, TOPICS)
    weight = np.full((subwords(ranks)[1], TOPICS), 0.5)
    ids, lengths = encoded(ranks, words)
    stop = np.cumsum(lengths)
    for end in (ids[stop - lengths], ids[stop - 1]):
        np.add.at(weight, (end, topics), np.sqrt(c))
    topic_of = np.log(weight / weight.sum(axis=0))
    return Lexicon(ranks, words, bands_of(topics, c), topic_of.astype(np.float32)), c


def corpus_shape(counts: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """(uses, pairs, times, places, new) from all counted words.

    ``uses`` counts each subword id in words, each word once, then beginnings and ends; ``pairs``
    and ``times`` are the ``TOP_PAIRS`` most frequent pairs of neighbours. ``places`` are those of
    words by class, and ``new`` the words that stand in one place, which tell how many new words
    to expect.
    """
    size, classes = subwords(lexicon.ranks)[1], TOPICS * BANDS
    lexicon.ready()

    def run(batches):
        lexicon.rows = {}
        places, new, uses = np.zeros(classes), np.zeros(classes), np.zeros(size + 2)
        pairs, times = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            if not words:
                continue
            c = batch.column(1).to_numpy()
            at = lexicon.places([words])
            kinds = lexicon.kind[at]
            places += np.bincount(kinds, c, classes)
            new += np.bincount(kinds[c == 1], minlength=classes)
            met = pairs_of(*encoded(lexicon.ranks, words), size)[0]
            uses += np.bincount(met % (size + 2), minlength=size + 2)
            found, n = np.unique(met, return_counts=True)
            pairs, back = np.unique(np.concatenate([pairs, found]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, n]))
        for what, (keys, n) in enumerate([
            *((np.flatnonzero(x), x[np.flatnonzero(x)]) for x in (uses, places, new)), (pairs, times),
        ]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), what), pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.float64())],
                names=["what", "key", "n"],
            )

    rows = arrow_map(counts.select("word", "c"), run, "what int, key long, n double")
    rows = store(rows.groupBy("what", "key").agg(F.sum("n").alias("n")), "lm-shape")
    out = (np.zeros(size + 2), np.zeros(classes), np.zeros(classes))
    whole = rows.where("what < 3").toArrow()  # no more than these arrays hold
    what, key, n = (whole.column(c).to_numpy() for c in ("what", "key", "n"))
    for i, found in enumerate(out):
        found[key[what == i]] = n[what == i]
    top = most_frequent(rows.where("what = 3"), "n", "key", TOP_PAIRS)
    return out[0], top.column("key").to_numpy(), top.column("n").to_numpy(), out[1], out[2]


def stacked_windows(texts: pa.Array | list[str | None], lexicon: Lexicon):
    """(rows of all words, words in each text, inputs, wanted, owner) of many texts."""
    distinct, at, lengths = split_texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    at = lexicon.places([distinct]).take(at)
    windows = windows_of(lexicon.first[at], lexicon.last[at], lexicon.kind[at], lengths, TOPICS * BANDS)
    return at, lengths, *windows


def fit_layer(texts: DataFrame, text_col: str, key: str, lexicon: Lexicon, prior: np.ndarray) -> AttentionLayer:
    """The layer, fitted to a bounded sample on the driver and then by averaged copies to all texts."""
    layer, lexicon = AttentionLayer(prior), lexicon.without_spelling()
    rows = texts.select(F.col(text_col).alias("text"))
    order = F.xxhash64(key, text_col)
    sample = texts.where(F.length(text_col) <= SAMPLE_CHARS).orderBy(order, text_col).limit(SAMPLE_TEXTS)
    found = [r[0] for r in sample.select(text_col).collect()]
    if found:
        _, _, inputs, wanted, _ = stacked_windows(found, lexicon)
        adam, draw = FlatAdam(layer.p, 0.01), np.random.default_rng(7)
        for _ in range(3):
            layer.train(inputs, wanted, adam, draw)
    sent = texts.sparkSession.sparkContext.broadcast((lexicon, layer.flat()))

    def run(batches):
        from pyspark import TaskContext

        known, start = sent.value
        own, done = AttentionLayer(prior), 0
        own.load(start)
        adam, draw = FlatAdam(own.p, 0.002), np.random.default_rng(11)
        for batch in batches:
            for part in text_slices(batch, 0):
                _, _, inputs, wanted, _ = stacked_windows(part.column(0), known)
                own.train(inputs, wanted, adam, draw)
                done += len(wanted)
        if done:
            value = (own.flat().astype(np.float64) * done).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([done], pa.int64()), pa.array([value], pa.binary())],
                names=["slot", "n", "value"],
            )

    def added(table: pa.Table) -> pa.Table:
        """The sum of at most sixty-four copies."""
        total = sum(np.frombuffer(v, np.float64) for v in table.column("value").to_pylist())
        return pa.table({
            "slot": pa.array([table.column("slot")[0].as_py() // 64], pa.int64()),
            "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
            "value": pa.array([total.tobytes()], pa.binary()),
        })

    schema = "slot long, n long, value binary"
    copies = store(arrow_map(rows, run, schema), "lm-copies")
    sent.destroy()  # or executors hold it until the driver collects garbage
    for _ in range(4):
        if copies.limit(2).count() < 2:
            break
        copies = store(copies.groupBy(F.expr("slot div 64")).applyInArrow(added, schema), "lm-copies")
    whole = copies.collect()
    if whole:
        layer.load(sum(np.frombuffer(r.value, np.float64) for r in whole) / sum(r.n for r in whole))
    return layer


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    fold: int = 2,
    path: str = VOCABULARY_FILE,
    top_words: int = TOP_WORDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per document."""
    ranks = read_ranks(path)
    aside = held_out(F.col(id_col), folds, fold)
    training = docs.where(~aside)
    counts = store(word_counts(training, text_col), "word-counts")
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    floor = math.log10(total + distinct + 1)

    lexicon, top_c = make_lexicon(counts, ranks, top_words)
    uses, pairs, times, places, new = corpus_shape(counts, lexicon)
    lexicon.spelling, lexicon.rows = Spelling(uses, pairs, times, lexicon.top, top_c), {}
    left = new + 1.0  # what is kept for new words of a class
    whole = places + left
    prior = np.log(np.concatenate([whole, [ends + 1.0]]) / (whole.sum() + ends + 1.0))
    layer = fit_layer(training, text_col, id_col, lexicon, prior)
    lexicon.ready()
    shares = (np.log10(left), np.log10(whole), np.log10(top_c + 1.0))
    # Bounded by top_words, the vocabulary and the layer.
    shipped = docs.sparkSession.sparkContext.broadcast((lexicon, layer, shares, top_c))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"row long, id {kind}, aside boolean, n_tokens long, n_top long, top_sum double, "
        "rare array<struct<word: string, times: long, spelled: double, whole: double>>, score double"
    )
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches):
        lexicon, layer, (left, whole, top_base), top_c = shipped.value
        tables, n_top = layer.tables(), lexicon.n_top
        top_share = None
        for batch in batches:
            for part in text_slices(batch, 1):
                at, lengths, inputs, wanted, owner = stacked_windows(part.column(1), lexicon)
                if top_share is None:
                    k = lexicon.kind[:n_top]
                    top_share = np.log10(top_c + 10.0 ** (left[k] + lexicon.spelled[:n_top])) - whole[k]
                n = len(lengths)
                score = np.bincount(owner, layer.log10(inputs, wanted, tables), n).astype(np.float64)
                text = np.repeat(np.arange(n), lengths)
                common = at < n_top
                score += np.bincount(text[common], top_share[at[common]], n)
                # Without a word there is nothing to add up, and numpy counts in whole numbers.
                base = np.bincount(text[common], top_base[at[common]], n).astype(np.float64)
                size = len(lexicon.rows)
                pairs, times = np.unique(text[~common] * size + at[~common], return_counts=True)
                places, names = pairs % size, list(itertools.islice(lexicon.rows, n_top, None))
                k = lexicon.kind[places]
                words = pa.array([names[i].decode("utf-8", "replace") for i in (places - n_top).tolist()], pa.string())
                told = [words, pa.array(times), pa.array(left[k] + lexicon.spelled[places]), pa.array(whole[k])]
                kind = arrow.field(6).type
                ends = np.searchsorted(pairs // size, np.arange(n + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(
                    pa.array(ends), pa.StructArray.from_arrays(told, fields=list(kind.value_type)), type=kind
                )
                yield pa.RecordBatch.from_arrays([
                    part.column(3), part.column(0).cast(arrow.field(1).type), part.column(2),
                    pa.array(lengths + 1), pa.array(np.bincount(text[common], minlength=n)), pa.array(base),
                    rare, pa.array(score),
                ], schema=arrow)

    numbered = docs.select(id_col, text_col, aside.alias("aside")).withColumn("row", F.monotonically_increasing_id())
    scored = store(arrow_map(numbered, run, schema), "lm-scores")
    shipped.destroy()
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    met = rare.join(counts.select("word", "c"), "word", "left").groupBy("row")
    share = F.when(F.col("c").isNull(), F.col("spelled")).otherwise(F.log10(F.col("c") + F.pow(F.lit(10.0), "spelled")))
    met = met.agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
        F.coalesce(F.sum(F.col("times") * F.log10(F.col("c") + 1)), F.lit(0.0)).alias("rare_sum"),
        F.sum(F.col("times") * (share - F.col("whole"))).alias("rare_score"),
    )
    joined = scored.drop("rare").join(met, "row", "left")
    end_sum = math.log10(ends + 1)
    return joined.select(
        F.col("id").alias(id_col),
        F.col("aside").alias("held_out"),
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("top_sum") + F.coalesce("rare_sum", F.lit(0.0)) + end_sum - F.col("n_tokens") * floor
        ).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
