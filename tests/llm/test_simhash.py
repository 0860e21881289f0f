import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from tallymark.llm import simhash
from tallymark.llm.components import connected_components
from tallymark.llm.simhash import BLOCK, block_forest, simhash_groups, within_radius, without_near_copies


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_of(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_groups(rows):
    prints = {}
    for key, text in rows:
        prints.setdefault(key, set()).add(brute_print(text))
    flat = [(p, k) for k, ps in prints.items() for p in ps]
    links = [(a[0], b[0]) for a in flat for b in flat if bin(a[0] ^ b[0]).count("1") <= 2]
    root = groups_of(links, {p for p, _ in flat})
    least = {}
    for p, k in flat:
        if k is not None:
            least[root[p]] = min(k, least.get(root[p], k))
    return {(k, f"{p:016x}"): least.get(root[p]) for p, k in flat}


def test_bit_sliced_distances():
    draw = np.random.default_rng(0)
    for bits, radius, n, noise in ((64, 2, 300, 0.02), (64, 2, 3, 0.02), (64, 5, 130, 0.05), (1024, 159, 150, 0.08)):
        base = draw.integers(0, 2, (10, bits))
        rows = base[draw.integers(0, 10, n)] ^ (draw.random((n, bits)) < noise)
        packed = np.packbits(rows.astype(np.uint8), axis=1, bitorder="little")
        near = np.unpackbits(within_radius(packed, radius).view(np.uint8), axis=1, bitorder="little")
        assert (near[:, :n] == ((rows[:, None] != rows[None]).sum(2) <= radius)).all()


def test_forest_connects_what_is_connected():
    draw = np.random.default_rng(1)
    rows = draw.integers(0, 2, (6, 64))[draw.integers(0, 6, 200)] ^ (draw.random((200, 64)) < 0.015)
    packed = np.packbits(rows.astype(np.uint8), axis=1, bitorder="little")
    links = [(i, j) for i in range(200) for j in range(200) if (rows[i] != rows[j]).sum() <= 2]
    forest = block_forest(packed, 2)
    assert len(forest) < 200
    assert groups_of(links, range(200)) == groups_of(forest, range(200))


def test_groups_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_groups(docs).collect()}
    assert got == brute_groups(rows)


def test_large_bucket_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = list(words)
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(200)] = f"x{draw.random()}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_groups(docs).collect()}
    assert got == brute_groups(rows) and BLOCK == 2048


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = simhash_groups(odd).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    assert all(want[r.doc_id, r.fingerprint] == r.component_id for r in got)
    assert simhash_groups(none).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = groups_of(edges, {x for e in edges for x in e} - set())
    assert {r.node: r.label for r in got} == want


def jaccard(a, b):
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_go_and_others_stay(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, near, far = [], 0, 0
    for i in range(150):
        text = [word() for _ in range(draw.choice((40, 120, 400)))]
        other = list(text)
        edits = draw.choice((1, 2, 12)) if len(text) == 400 else draw.choice((1, 12))
        for _ in range(edits):
            other[draw.randrange(len(other))] = word()
        share = jaccard(text, other)
        if 0.7 < share < 0.88:
            continue
        near, far = near + (share >= 0.88), far + (share <= 0.7)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = without_near_copies(docs).count()
    assert near > 30 and far > 30
    assert abs(len(rows) - kept - near) <= 0.02 * near


def test_near_copies_of_odd_rows(odd, none):
    kept = without_near_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert 1 in ids and 2 not in ids and ids.count(1) == 1
    assert 3 in ids and 4 not in ids  # the empty text, and the null one that equals it
    assert without_near_copies(none).count() == 0


def test_near_copies_are_those_of_exact_similarity(spark, monkeypatch):
    """Similarities about 0.8, texts of 5 to 15 words, hot shingles and chunks against brute force."""
    monkeypatch.setattr(simhash, "CHUNK", 3000)
    monkeypatch.setattr(simhash, "HOT_EVERY", 2)
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts, low, high = [], 0, 0
    while low < 80 or high < 80:
        text = [word() for _ in range(draw.choice((60, 200)))]
        other = list(text)
        for _ in range(draw.randint(1, 5) * len(text) // 60):
            other[draw.randrange(len(other))] = word()
        share = jaccard(text, other)
        if 0.7 <= share < 0.8 and low < 80 or 0.8 <= share < 0.88 and high < 80:
            low, high = low + (share < 0.8), high + (share >= 0.8)
            texts += [text, other]
    for n in range(5, 16):
        for _ in range(6):
            text = [word() for _ in range(n)]
            texts += [text, [*text, word()], [*text[:-1], word()]]
    base = [word() for _ in range(100)]
    for _ in range(60):  # one large group, about 0.8 from each other
        other = list(base)
        other[draw.randrange(100)] = word()
        texts.append(other)
    sets = [{hash(tuple(t[i : i + 5])) for i in range(max(1, len(t) - 4))} for t in texts]
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)
    ]
    want = {i for i, root in groups_of(links, range(len(texts))).items() if i == root}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in without_near_copies(docs).collect()} == want


def test_hot_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_EVERY", 2)
    monkeypatch.setattr(simhash, "HELD", 100)  # so that counts of a hash meet in the shuffle
    least = 2 * simhash.HOT_LEAST
    texts = ["a b c d e" + (" f" if i else "") for i in range(least)] + ["g h i j k"] * (least - 1)
    texts += [f"x{i} y{i} z{i} u{i} v{i} w{i}" for i in range(300)] + [None, ""]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, digest long").repartition(4)
    want = simhash.shingle_hashes("a b c d e", 5)
    assert simhash.hot_shingles(docs, 5).tolist() == want.tolist()
    assert len(simhash.hot_shingles(docs.limit(0), 5)) == 0


def test_filter_misses_none(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PLACES", 1 << 16)
    rows = spark.range(-500, 3000).select("id", F.xxhash64("id").alias("bits"))
    some = rows.where("id % 7 = 0")
    found = simhash.marked(rows, "bits", simhash.marks(some, "bits"), "may")
    assert found.columns == ["id", "bits", "may"]
    may = {r.id for r in found.collect() if r.may}
    want = {i for i in range(-500, 3000) if i % 7 == 0}
    assert want <= may and len(may - want) < 100
    none = simhash.marked(rows, "bits", simhash.marks(some.limit(0), "bits"), "may")
    assert none.where("may").isEmpty() and none.count() == 3500


def test_texts_that_are_alone_are_not_shuffled(spark, tmp_path):
    """Of texts without copies hashes and sketches are shuffled, a part of their size."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " x") for i in range(20)] + [rows[100], (None, rows[101][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    ids = sorted(r.doc_id for r in without_near_copies(docs).select("doc_id", "text").collect() if r.doc_id is not None)
    assert ids == list(range(600))
    assert written() - before < sum(len(t) for _, t in rows) / 2
