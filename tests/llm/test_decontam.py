import random

from tallymark.llm.decontam import SeedIndex, contaminated, greedy_tiles, item_blocks, without_contaminated


def common_runs(item, text, least):
    """All longest common runs, by brute force."""
    out = []
    for a in range(len(item)):
        for b in range(len(text)):
            if item[a] == text[b] and not (a and b and item[a - 1] == text[b - 1]):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n]:
                    n += 1
                if n >= least:
                    out.append((a, b, n))
    return out


def brute_tiles(item, text, least):
    """Greedy string tiling as first published: scan for the longest unmarked match, mark, repeat."""
    marked_item, marked_text, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while (
                    a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n]
                    and a + n not in marked_item and b + n not in marked_text
                ):
                    n += 1
                if n > best[2]:
                    best = (a, b, n)
        a, b, n = best
        if n < least:
            return total
        total += n
        marked_item |= set(range(a, a + n))
        marked_text |= set(range(b, b + n))


def test_tiles_against_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        item = [draw.choice("abc") for _ in range(draw.randint(0, 14))]
        text = [draw.choice("abc") for _ in range(draw.randint(0, 25))]
        tiles = greedy_tiles(common_runs(item, text, 3), len(item), 3)
        assert sum(n for *_, n in tiles) == brute_tiles(item, text, 3)
        index = SeedIndex([(0, " ".join(item))], 3)
        found = index.matches(" ".join(text), 0.01)
        assert (found[0][2] if found else []) == tiles


def test_reordered_passages_are_caught(spark):
    words = [f"q{i}" for i in range(40)]
    turned = [*words[30:], *words[20:30], "break", *words[:20]]
    docs = spark.createDataFrame(
        [(1, " ".join(["start", *turned, "end"])), (2, " ".join(words[:15])), (3, "q1 q2 q3"), (4, None)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, " ".join(words)), (8, None), (9, "q1 q2 q3")], "item_id long, text string")
    got = contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(1, 7, 1.0)]
    assert len(got[0].tiles) == 3
    assert sorted(r.doc_id for r in without_contaminated(docs, items).collect()) == [2, 3, 4]


def test_repeated_words_stay_cheap():
    index = SeedIndex([(0, "the " * 50)], 4)
    assert index.matches("the " * 20_000, 0.5)[0][1] == 1.0


def test_blocks_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {(r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, items).collect()}
    many = {(r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, items, block_words=900).collect()}
    assert one == many and one
    blocks = list(item_blocks(items, "item_id", "text", 900))
    assert len(blocks) > 3 and sum(map(len, blocks)) == items.count()
    clean = without_contaminated(docs, items, block_words=900)
    assert clean.count() == docs.count() - len({d for d, *_ in one})


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, odd.where("doc_id = 1").first().text)], "item_id long, text string")
    got = contaminated(odd, items).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    kept = without_contaminated(odd, items)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 4
    assert contaminated(none, items).count() == 0
    assert contaminated(odd, items.limit(0)).count() == 0
