import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import lm
from tallymark.llm.toxicity import Adam

RANKS = lm.read_ranks(lm.VOCABULARY_FILE)
END = lm.TOPICS * lm.BANDS


def brute_base(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [0] for _, t in rows]
    aside = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    counts = Counter(w for ws, a in zip(tokens, aside) if not a for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for (key, _), ws, a in zip(rows, tokens, aside):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        out.append((key, a, len(ws), sum(counts[w] > 0 for w in ws), total, base))
    return out


@pytest.mark.parametrize("top", [0, 50, 200_000])
def test_base_against_brute_force(spark, sf, top):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r[0]: r for r in brute_base([(r.doc_id, r.text) for r in docs.collect()])}
    for r in lm.score_texts(docs, top_words=top).collect():
        assert tuple(r)[:5] == want[r.doc_id][:5]
        assert abs(r.base_score - want[r.doc_id][5]) < 1e-6 * abs(r.base_score)
        assert math.isfinite(r.score) and r.score < 0


def test_windows_score_each_token_once():
    lengths = np.array([0, 1, 19, 20, 21, 100])
    n = int(lengths.sum())
    kind = np.arange(n) % END
    inputs, wanted, owner = lm.windows_of(np.arange(n), np.arange(n) + 5000, kind, lengths, END)
    at = np.split(np.arange(n), np.cumsum(lengths)[:-1])
    for i in range(len(lengths)):
        mine = owner == i
        assert wanted[mine][wanted[mine] >= 0].tolist() == [*kind[at[i]], END]
        before = [lm.BUCKETS, *at[i]]
        seen = [int(inputs[0, w, lm.CONTEXT + j]) for w in np.flatnonzero(mine) for j in range(lm.SCORED) if wanted[w, j] >= 0]
        assert seen == before
        for w in np.flatnonzero(mine)[1:]:
            # Enough is in view before the first scored token of a later window.
            assert (inputs[0, w, : lm.CONTEXT] != lm.BUCKETS + 1).all()


def small_layer():
    layer = lm.AttentionLayer(np.log(np.full(END + 1, 1 / (END + 1))))
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    return layer


def some_windows(seed, n):
    draw = np.random.default_rng(seed)
    buckets = draw.integers(0, lm.BUCKETS, (2, n))
    return lm.windows_of(*buckets, draw.integers(0, END, n), np.array([n]), END)


def test_forward_against_loops():
    """One head, place by place, without tables or masks."""
    layer, (inputs, wanted, _) = small_layer(), some_windows(1, 50)
    p, logit = layer.p, layer.forward(inputs, layer.tables())
    for w in range(len(inputs[0])):
        x = [p["first"][a] + p["last"][b] + p["kind"][c] + p["place"][j] for j, (a, b, c) in enumerate(inputs[:, w].T)]
        for s in range(lm.SCORED):
            if wanted[w, s] < 0:
                continue
            here = lm.CONTEXT + s
            seen = [j for j in range(here + 1) if inputs[0, w, j] != lm.BUCKETS + 1]
            score = np.array([(x[here] @ p["query"]) @ (x[j] @ p["key"]) / math.sqrt(lm.DIM) for j in seen])
            weight = np.exp(score) / np.exp(score).sum()
            mixed = x[here] + sum(a * (x[j] @ p["value"]) for a, j in zip(weight, seen)) @ p["mix"]
            top = mixed + np.maximum(mixed @ p["wide"] + p["wide_0"], 0) @ p["narrow"]
            assert np.allclose(logit[w, s], top @ p["out"] + p["out_0"])
    log = layer.log10(inputs, wanted, layer.tables())
    chance = np.exp(logit) / np.exp(logit).sum(axis=2, keepdims=True)
    slow = [sum(math.log10(chance[w, s, k]) for s, k in enumerate(wanted[w]) if k >= 0) for w in range(len(wanted))]
    assert np.allclose(log, slow)


def test_gradients_against_differences():
    layer, (inputs, wanted, _) = small_layer(), some_windows(2, 70)
    draw = np.random.default_rng(2)
    _, grad = layer.gradients(inputs, wanted)
    assert set(grad) == set(layer.p)
    for name in layer.p:
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in layer.p[name].shape)
            if name in ("first", "last"):
                at = (inputs[0 if name == "first" else 1].ravel()[at[0] % 60], at[1])
            losses = []
            for step in (1e-4, -2e-4):
                layer.p[name][at] += step
                losses.append(layer.gradients(inputs, wanted)[0])
            layer.p[name][at] += 1e-4
            assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 2e-3


def test_gradients_of_many_windows_add_up():
    """Windows worked on a few at a time give the gradients of all of them."""
    layer, (inputs, wanted, _) = small_layer(), some_windows(3, 3 * lm.AT_ONCE * lm.SCORED)
    assert len(wanted) > 3 * lm.AT_ONCE
    loss, grad = layer.gradients(inputs, wanted)
    n, slow = (wanted >= 0).sum(), {}
    for w in range(len(wanted)):
        own_loss, own = layer.gradients(inputs[:, [w]], wanted[[w]])
        share = (wanted[w] >= 0).sum() / n
        loss -= own_loss * share
        for name, value in own.items():
            slow[name] = slow.get(name, 0) + value * share
    assert abs(loss) < 1e-9
    assert all(np.allclose(grad[name], slow[name], atol=1e-9) for name in layer.p)


def test_flat_steps_equal_adam():
    one, other, (inputs, wanted, _) = small_layer(), small_layer(), some_windows(5, 4000)
    for layer, kind in ((one, Adam), (other, lm.FlatAdam)):
        layer.train(inputs, wanted, kind(layer.p, 0.01), np.random.default_rng(1))
    assert all(np.allclose(one.p[k], other.p[k], atol=1e-9) for k in one.p)
    assert not np.allclose(one.p["out"], small_layer().p["out"])


def test_texts_split_by_column_as_one_by_one():
    texts = ["  The\tTHE\x0b\x0ccat \r\n", None, "", " ", "a\x1cb \xa0c É\u3000é", "the end"]
    distinct, at, lengths = lm.split_texts(pa.array(texts, pa.string()))
    want = [lm.space_words(t) for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert [distinct[i] for i in at] == [w for words in want for w in words] and len(set(distinct)) == len(distinct)
    assert [len(x) for x in lm.split_texts(pa.array([], pa.string()))] == [0, 0, 0]


def test_far_exponents_stay_finite():
    layer, (inputs, wanted, _) = small_layer(), some_windows(4, 60)
    layer.p = {k: (v * 20).astype(np.float32) for k, v in layer.p.items()}
    assert np.isfinite(layer.log10(inputs, wanted, layer.tables())).all()
    loss, grad = layer.gradients(inputs, wanted)
    assert math.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())


def test_words_encoded_together_as_alone():
    """White space inside words, marks and characters of many bytes cut no word elsewhere."""
    some = ["the", "don't", "a\u00a0b", "\u3000", "\u00a0", "x\u2003", "\x1c", "漢字", "\U0001f600!?", "1,000.5", "\ufffd", "é", "-" * 90]
    words = [w.encode() for w in some * 50 + ["plain"] * 300 + ["ê"]]
    ids, lengths = lm.encoded(RANKS, words)
    encode = lm.subwords(RANKS)[0]
    assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == [encode(" " + w.decode()) for w in words]
    assert [len(a) for a in lm.encoded(RANKS, [])] == [0, 0]


def test_top_words_are_encoded_once_not_by_every_task(monkeypatch):
    top = [b"the", b"a", b"cat"]
    lexicon = lm.Lexicon(RANKS, top, np.array([1, 2, 3]), np.zeros((lm.subwords(RANKS)[1], lm.TOPICS), np.float32))
    want = lexicon.places([[b"cat", b"new", b"the"]]).tolist(), lexicon.first.tolist(), lexicon.kind.tolist()
    sent, asked = pickle.dumps(lexicon), []
    whole = lm.encoded
    monkeypatch.setattr(lm, "encoded", lambda ranks, words: asked.extend(words) or whole(ranks, words))
    here = pickle.loads(sent)
    assert (here.places([[b"cat", b"new", b"the"]]).tolist(), here.first.tolist(), here.kind.tolist()) == want
    assert asked == [b"new"]


def test_a_layer_learns_an_order():
    n = 4000
    kind = np.arange(n) % 7
    inputs, wanted, _ = lm.windows_of(kind, kind, kind, np.array([n]), END)
    layer = lm.AttentionLayer(np.log(np.full(END + 1, 1 / (END + 1))))
    adam, draw = Adam(layer.p, 0.01), np.random.default_rng(1)
    for _ in range(40):
        layer.train(inputs, wanted, adam, draw)
    assert layer.log10(inputs, wanted, layer.tables()).sum() / n > math.log10(0.8)


def parts(docs, top_words):
    """The model in parts, and the counts of training words, by the module's own steps."""
    training = docs.where(~lm.held_out(docs.doc_id, 7, 2))
    counts = lm.store(lm.word_counts(training, "text"), "counts")
    lexicon, top_c = lm.make_lexicon(counts, RANKS, top_words)
    uses, pairs, times, places, new = lm.corpus_shape(counts, lexicon)
    lexicon.spelling, lexicon.rows = lm.Spelling(uses, pairs, times, lexicon.top, top_c), {}
    return training, {r.word: r.c for r in counts.collect()}, lexicon, places, new


def test_counts_and_shape_against_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    training, counts, lexicon, places, new = parts(docs, 300)
    texts = [lm.space_words(r.text) for r in training.collect()]
    assert counts == {w.decode(): c for w, c in Counter(w for t in texts for w in t).items()}
    words = [w.encode() for w in counts]
    kinds = lexicon.kind[at] if len(at := lexicon.places([words])) else None
    slow_places, slow_new = np.zeros(END), np.zeros(END)
    for w, k in zip(words, kinds):
        slow_places[k] += counts[w.decode()]
        slow_new[k] += counts[w.decode()] == 1
    assert (places == slow_places).all() and (new == slow_new).all()
    sums = np.zeros(lm.SIGNATURE)
    word = lexicon.top[0]
    for t in texts:
        if word in t:
            signs = lm.signs_of(t)
            own = lm.signs_of([word])[0]
            sums += t.count(word) * (signs.sum(axis=0) - own) / max(len(t) - 1, 1)
    row = lm.word_counts(training, "text").where(F.col("word") == word.decode()).first()
    assert np.allclose([row[f"s{j}"] for j in range(lm.SIGNATURE)], sums, rtol=1e-3, atol=1e-2)


def test_shares_sum_to_one_at_most():
    encode, size = lm.subwords(RANKS)
    words = [b"the", b"then", b"there,", b"(the", b"a", b"an", "ê".encode()]
    uses, met = np.zeros(size + 2), Counter()
    for w in words:
        ids = [size, *encode(" " + w.decode()), size + 1]
        for a, b in zip(ids, ids[1:]):
            uses[b] += 1
            met[a * (size + 2) + b] += 1
    some = sorted(met)[:6]  # the others follow the second id alone
    spelling = lm.Spelling(uses, np.array(some), np.array([float(met[p]) for p in some]), words, np.arange(1.0, 8.0))
    assert abs(spelling.alone.sum() - 1) < 1e-9
    for before in {p // (size + 2) for p in met}:
        told = {p % (size + 2): met[p] for p in some if p // (size + 2) == before}
        whole = sum(told.values()) + spelling.rest[before] * spelling.alone.sum()
        assert abs(whole / spelling.after[before] - 1) < 1e-9
    assert np.allclose((10.0**spelling.marks).sum(axis=1), 1)
    pair, owner = lm.id_pairs([encode(" " + w.decode()) for w in words], size)
    assert Counter(pair.tolist()) == met and owner.tolist() == sorted(owner.tolist())
    # Known words with marks are likelier than strange ones.
    tops = {w: i for i, w in enumerate(words)}
    near, strange = spelling.chances([b"the,", b"xqj,"], [encode(" the,"), encode(" xqj,")], tops)
    assert near > strange


@pytest.mark.parametrize("top", [100, 200_000])
def test_scores_against_a_plain_sum(spark, sf, top):
    """Class by class from the layer, share by share from counts, without the join."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    training, counts, lexicon, places, new = parts(docs, top)
    left, ends = new + 1.0, training.count()
    whole = places + left
    prior = np.log(np.concatenate([whole, [ends + 1.0]]) / (whole.sum() + ends + 1.0))
    layer = lm.fit_layer(training, "text", "doc_id", lexicon, prior)
    got = {r.doc_id: r.score for r in lm.score_texts(docs, top_words=top).collect()}
    for row in docs.limit(40).collect():
        at, lengths, inputs, wanted, _ = lm.stacked_windows([row.text], lexicon)
        want = layer.log10(inputs, wanted, layer.tables()).sum()
        for word, i in zip(lm.space_words(row.text), at):
            k = lexicon.kind[i]
            want += math.log10((counts.get(word.decode(), 0) + left[k] * 10.0 ** lexicon.spelled[i]) / whole[k])
        assert abs(got[row.doc_id] - want) < 1e-4 * abs(want)


def test_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    aside = lm.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert aside[0] / aside[2] > aside[1] / aside[2] + 0.05


def test_every_text_trains_the_layer(spark):
    """Copies of many tasks are averaged by their windows."""
    rows = [(i, " ".join("abcdefg"[(i + j) % 7] * 3 for j in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(130)
    training, _, lexicon, places, new = parts(docs, 100)
    prior = np.log(np.full(END + 1, 1 / (END + 1)))
    layer = lm.fit_layer(training, "text", "doc_id", lexicon, prior)
    _, lengths, inputs, wanted, _ = lm.stacked_windows([r[1] for r in rows[:20]], lexicon)
    assert layer.log10(inputs, wanted, layer.tables()).sum() / lengths.sum() > math.log10(0.5)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted(brute_base(rows), key=str)
    got = sorted((tuple(r) for r in lm.score_texts(odd).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isfinite(g[6]) for g in got)
    assert lm.score_texts(none).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two two"), ("b", None), (None, "three")], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in lm.score_texts(docs).collect()} == {"a": 4, "b": 1, None: 2}
    alone = lm.score_texts(docs.where("doc_id = 'b'").repartition(1)).first()
    assert alone.n_tokens == 1 and math.isfinite(alone.score)


def test_most_frequent_puts_few_rows_in_order(spark):
    """The same rows as by sorting all; rows that cannot be among them are left out before the sort."""
    rows = spark.range(20_000).selectExpr("id", "cast(20000 / (id * 7919 % 20000 + 1) as long) + 1 as c")
    for n in (0, 1, 37, 800, 30_000):
        want = sorted(((r.c, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))[:n]
        got = lm.most_frequent(rows, "c", "id", n)
        assert list(zip(got.column("c").to_pylist(), got.column("id").to_pylist())) == want
    assert lm.most_frequent(rows.limit(0), "c", "id", 5).num_rows == 0


def test_top_words_are_not_sorted_among_all(spark, monkeypatch):
    """What is put in order is cut by count before; else each task holds as many rows as are wanted."""
    sorted_rows = []
    kept = type(spark.range(1)).orderBy
    monkeypatch.setattr(type(spark.range(1)), "orderBy", lambda df, *by: sorted_rows.append(df.count()) or kept(df, *by))
    names = [f"cast(id % 3 as float) as s{j}" for j in range(lm.SIGNATURE)]
    counts = spark.range(5000).selectExpr("concat('w', id) as word", "cast(5000 / (id + 1) as long) + 1 as c", *names)
    lexicon, c = lm.make_lexicon(counts, RANKS, 50)
    assert lexicon.top[0] == b"w0" and len(c) == 50
    assert sorted_rows and max(sorted_rows) < 100


def test_windows_take_little_room():
    """Windows of a million words: two bytes for each of a window's numbers."""
    n = 1_000_000
    word = np.zeros(n, np.int16)
    inputs, wanted, _ = lm.windows_of(word, word, word, np.full(n // 500, 500), END)
    assert inputs.nbytes + wanted.nbytes <= 2 * wanted.shape[0] * (3 * lm.WINDOW + lm.SCORED)
