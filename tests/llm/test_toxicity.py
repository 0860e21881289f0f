import random

import numpy as np

from tallymark.llm import toxicity
from tallymark.llm.toxicity import GatedNetwork, cut_windows, fit, score_toxicity, train, without_toxic


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 300):
        windows = cut_windows(np.arange(n))
        assert set(windows[windows >= 0]) == set(range(n)) and len(windows) >= 1


def test_gradients_against_differences():
    net = GatedNetwork(5, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    draw = np.random.default_rng(0)
    vectors = draw.normal(size=(6, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    windows = np.full((3, toxicity.WINDOW), -1)
    windows[0, :7], windows[1, :32], windows[2, :1] = draw.integers(0, 6, 7), draw.integers(0, 6, 32), 4
    target = np.array([1.0, 0.0, 1.0])
    _, grad, d_vectors = net.gradients(vectors, windows, target)
    for name in ("att", "pick", "out", "in_f", "in_b", "rec_f", "rec_b", "in_b_0"):
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in net.p[name].shape)
            losses = []
            for step in (1e-4, -2e-4):
                net.p[name][at] += step
                losses.append(net.gradients(vectors, windows, target)[0])
            net.p[name][at] += 1e-4
            assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 2e-3
    losses = []
    for step in (1e-4, -2e-4):
        vectors[4, 2] += step
        losses.append(net.gradients(vectors, windows, target)[0])
    assert abs((losses[0] - losses[1]) / 2e-4 - d_vectors[4, 2]) < 2e-3


def invented(draw, toxic, n):
    words = ["".join(draw.choice("etaoin shrd".replace(" ", "")) for _ in range(5)) for _ in range(n)]
    if toxic:
        for _ in range(2):
            words.insert(draw.randrange(n), draw.choice(("blorg", "zzukk", "wexxy")) + draw.choice(("", "en", "s")))
    return " ".join(words)


def test_held_out_accuracy_and_long_texts():
    draw = random.Random(1)
    labels = [i % 2 for i in range(800)]
    model = fit([invented(draw, t, draw.randint(5, 200)) for t in labels], labels)
    told = [i % 2 for i in range(200)]
    scores = np.array(model.scores([invented(draw, t, draw.randint(5, 1500)) for t in told]))
    assert ((scores >= 0.5) == np.array(told)).mean() >= 0.95
    odd = model.scores([None, "", "...", "blorg"])
    assert all(0 <= s <= 1 for s in odd) and odd[0] == odd[1] == odd[2] < 0.5


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(8, 1, 1), (8, 1, 1), (1, 1, 0), (2, 1, 0), (5, 1, None), (None, 1, 1), (7, 0, 0), (6, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = train(odd, labels)
    rows = score_toxicity(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    kept = without_toxic(odd, model)
    assert kept.schema == odd.schema
    assert kept.count() == sum(r.predicted == 0 for r in rows)
    assert score_toxicity(none, train(none, labels)).count() == 0
    plain = train(odd, labels.limit(0))
    assert {r.score for r in score_toxicity(odd, plain).collect()} == {0.0}
