"""Benchmark decontamination by greedy string tiling.

Windows of ``least`` words of the benchmark are the seeds. A document looks up the Karp-Rabin hash
of each of its windows; hits name the items it may hold, and hits in a row make the runs of words
common to both. For such a pair the longest run that is unmarked in both texts is taken again and
again and marked on both sides, until no run of ``least`` words is left. Tiles may stand in any
order, so reordered passages are caught. The share of the item's words under tiles decides.

The benchmark is the query set. It is read in blocks of items, each block bounded in words, and
every document meets every block in place: nothing is shuffled, and a task holds one batch of texts
and one block. Documents of a third of the source or of thousands of copies change nothing.

Defined cases: null and empty texts match nothing; neither do items of fewer than ``least`` words.
Repeated rows match alike. Items without an id take part in cleaning, and stand with a null id in
the matches. With an empty benchmark nothing matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import alnum_words, arrow_map, map_rows, store

#: Most words of a block, unless a single item is longer.
BLOCK_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every window of ``least`` word ids."""
    count = max(0, len(ids) - least + 1)
    out = np.zeros(count, np.uint64)
    for k in range(least):
        out = out * BASE + ids[k : k + count].astype(np.uint64)
    return out


class SeedIndex:
    """The seeds of one block of items: hash, then (item, place) of each window."""

    def __init__(self, items: list[tuple[object, str | None]], least: int) -> None:
        self.least = least
        self.words: dict[bytes, int] = {}
        self.names: list[object] = []
        self.texts: list[np.ndarray] = []
        hashes, owners, places = [], [], []
        for name, text in items:
            tokens = [self.words.setdefault(w, len(self.words) + 1) for w in alnum_words(text)]
            ids = np.array(tokens, np.int64)
            found = window_hashes(ids, least)
            hashes.append(found)
            owners.append(np.full(len(found), len(self.names)))
            places.append(np.arange(len(found)))
            self.names.append(name)
            self.texts.append(ids)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]
        self.places = (np.concatenate(places) if places else np.empty(0, np.int64))[order]
        #: One byte for each value of the highest hash bits: most windows end here.
        self.bits = max(16, (8 * len(self.hashes)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, float, list]]:
        """(item number, covered share, tiles) of each item that the text covers well enough."""
        words = alnum_words(text)
        if len(words) < self.least or not len(self.hashes):
            return []
        known = self.words.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        found = window_hashes(ids, self.least)
        absent = np.concatenate([[0], np.cumsum(ids == 0)])
        whole = absent[self.least :] == absent[: len(found)]
        at = np.flatnonzero(whole & self.seen[found >> np.uint64(64 - self.bits)])
        low = np.searchsorted(self.hashes, found[at], "left")
        high = np.searchsorted(self.hashes, found[at], "right")
        # Every (place in text, seed) pair; sorted, a run of pairs on one diagonal is a common run.
        many = high - low
        place = np.repeat(at, many)
        seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(place))
        owner, inside = self.owners[seed], self.places[seed]
        order = np.lexsort((inside, place - inside, owner))
        owner, inside, place = owner[order], inside[order], place[order]
        cut = np.flatnonzero(
            (np.diff(owner, prepend=-1) != 0)
            | (np.diff(place - inside, prepend=0) != 0)
            | (np.diff(inside, prepend=-9) != 1)
        )
        ends = np.append(cut[1:], len(owner)) if len(cut) else cut
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for first, n in zip(cut.tolist(), (ends - cut + self.least - 1).tolist()):
            item, a, b = int(owner[first]), int(inside[first]), int(place[first])
            if (self.texts[item][a : a + n] == ids[b : b + n]).all():
                runs[item].append((a, b, n))
        out = []
        for item, common in runs.items():
            tiles = greedy_tiles(common, len(self.texts[item]), self.least)
            share = sum(n for _, _, n in tiles) / len(self.texts[item])
            if share >= coverage:
                out.append((item, share, tiles))
        return sorted(out, key=lambda m: m[0])


def greedy_tiles(
    runs: list[tuple[int, int, int]], item_words: int, least: int
) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words): longest unmarked common runs first, then earliest.

    ``runs`` are all longest common runs. One that is cut by marks comes again as what is left of it.
    """
    in_item: set[int] = set()
    in_text: set[int] = set()
    tiles = []
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b, n in runs:
        by_length[n].append((a, b))
    while by_length and item_words - len(in_item) >= least:
        length = max(by_length)
        for a, b in sorted(by_length.pop(length)):
            free = [a + k not in in_item and b + k not in in_text for k in range(length)]
            if all(free):
                tiles.append((a, b, length))
                in_item.update(range(a, a + length))
                in_text.update(range(b, b + length))
                continue
            start = None
            for k, unmarked in enumerate([*free, False]):
                if unmarked and start is None:
                    start = k
                elif not unmarked and start is not None:
                    if k - start >= least:
                        by_length[k - start].append((a + start, b + start))
                    start = None
    return sorted(tiles)


def item_blocks(
    benchmark: DataFrame, id_col: str, text_col: str, block_words: int
) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items, block after block; a block has at most ``block_words`` words.

    A text has no more words than half its characters and one.

    Blocks are cut by a running sum over item order, written once, and fetched one at a time.
    """
    size = F.length(F.coalesce(text_col, F.lit(""))) / 2 + 1
    rows = benchmark.select(
        F.col(id_col).alias("name"), F.col(text_col).alias("text"), size.alias("size")
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    if total <= block_words:
        yield [(r.name_, r.text) for r in rows.withColumnRenamed("name", "name_").collect()]
        return
    parts = int(total // block_words) * 2 + 1
    dealt = store(
        rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "bench"
    )
    order = W.partitionBy("part").orderBy("text", "name").rowsBetween(W.unboundedPreceding, 0)
    cut = F.floor(F.sum("size").over(order) / block_words)
    dealt = store(dealt.withColumn("block", cut), "bench-blocks")
    for key in dealt.select("part", "block").distinct().orderBy("part", "block").collect():
        one = dealt.where((F.col("part") == key.part) & (F.col("block") == key.block))
        yield [(r.name_, r.text) for r in one.withColumnRenamed("name", "name_").collect()]


MATCH = (
    "{id} {kind}, item_id {item}, coverage double, "
    "tiles array<struct<item_at: long, doc_at: long, words: long>>"
)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 4,
    coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, item_id, coverage, tiles): every document and the items it covers well enough."""
    schema = MATCH.format(
        id=id_col,
        kind=docs.schema[id_col].dataType.simpleString(),
        item=benchmark.schema[item_col].dataType.simpleString(),
    )
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, block_words):

        def work(rows: dict[str, list], items=items, kept: list = []) -> dict[str, list]:
            index = _once(kept, items, least)
            found: dict[str, list] = {id_col: [], "item_id": [], "coverage": [], "tiles": []}
            for name, text in zip(rows[id_col], rows[text_col]):
                for item, share, tiles in index.matches(text, coverage):
                    found[id_col].append(name)
                    found["item_id"].append(index.names[item])
                    found["coverage"].append(share)
                    found["tiles"].append(
                        [{"item_at": a, "doc_at": b, "words": n} for a, b, n in tiles]
                    )
            return found

        part = map_rows(docs, [id_col, text_col], schema, work)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 4,
    coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents, all columns, that cover no item well enough."""
    at = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text_col, block_words):

        def run(batches, items=items):
            index = SeedIndex(items, least)
            for batch in batches:
                clean = [not index.matches(t.as_py(), coverage) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def _once(kept: list, items: list, least: int) -> SeedIndex:
    """The index, built at a task's first batch."""
    if not kept:
        kept.append(SeedIndex(items, least))
    return kept[0]
