"""Byte-level BPE by recursive queries: token positions join the merge table, per partition.

Each task keeps an embedded DuckDB connection (in memory, one thread, no server) with two tables
made from the rank file: ``merges``, every pair of tokens whose bytes together are a token, and
``vocabulary``, the bytes of every id. The words that the pattern cuts a text into are told apart,
and a recursive query starts with a row for each byte of each new word. In every round, neighbours
join the merge table, each word takes its least rank, and the leftmost of its pairs of that rank
that do not overlap are contracted, until no neighbours of a word can merge. Ids are decoded by
joining them to the vocabulary and aggregating its bytes in the order of their positions.

Contracting all pairs of the least rank in one round equals contracting them one by one: a token
that a merge makes can only meet its neighbours at higher ranks, for every token of a BPE
vocabulary is reached from its bytes by merges of ranks no higher than its own
(``out_of_order`` lists the tokens of a rank file for which that fails; none do here).

Words are remembered by the worker, up to a number of bytes, after which it starts anew: that
saves time and changes no result. Rounds of a word grow with the number of its distinct merges,
rows of a round with its length; memory grows with the length.

Defined cases: a null or empty text has no ids and decodes to no bytes; a text of any length is
encoded whole; repeated rows and null ids come out as often as they went in; an empty table gives
none; other columns are not read, whatever their names. No two pairs tie: equal ranks are the same
bytes, and the leftmost is taken. A null list of ids, or one with an id that is null or outside
the vocabulary, decodes to null.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import _arrow_schema, arrow_map

#: Rank files beyond this are refused, since they travel to every task.
MAX_RANK_BYTES = 64 << 20
#: Bytes of texts encoded at a time, bytes of words per recursive query, bytes of words remembered.
TEXT_BYTES, WORD_BYTES, KNOWN_BYTES = 4 << 20, 1 << 18, 24 << 20

ENCODE = """
WITH RECURSIVE token(place, word, id) USING KEY (place) AS (
  SELECT place, word, id FROM bytes_of_words
  UNION ALL (
    WITH neighbour AS (
      SELECT place, word, row_number() OVER along AS n, lead(place) OVER along AS next_place,
             CASE WHEN lead(word) OVER along = word
                  THEN id::BIGINT * 4294967296 + lead(id) OVER along END AS pair
      FROM token WHERE id IS NOT NULL WINDOW along AS (ORDER BY place)),
    mergeable AS (SELECT place, next_place, n, word, rank FROM neighbour JOIN merges USING (pair)),
    least AS (SELECT word, min(rank) AS rank FROM mergeable GROUP BY word),
    chosen AS (
      SELECT place, next_place, n, rank, n - row_number() OVER (ORDER BY n) AS run
      FROM mergeable JOIN least USING (word, rank)),
    contracted AS (
      SELECT place, next_place, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n) AS k FROM chosen)
      WHERE k % 2 = 1),
    changed AS (
      SELECT place, rank AS id FROM contracted
      UNION ALL SELECT next_place, NULL FROM contracted)
    SELECT t.place, t.word, CASE WHEN c.place IS NULL THEN t.id ELSE c.id END
    FROM token t JOIN least USING (word) LEFT JOIN changed c ON t.place = c.place
    WHERE t.id IS NOT NULL))
SELECT word, list(id ORDER BY place) AS ids FROM token WHERE id IS NOT NULL
GROUP BY word ORDER BY word
"""

DECODE = """
SELECT row_no, CASE WHEN count(*) = count(bytes) THEN string_agg(bytes, '' ORDER BY place) END
FROM ids_of_rows LEFT JOIN vocabulary USING (id) GROUP BY row_no
"""


def read_ranks(path: str) -> bytes:
    """The rank file (a line for each token: its bytes in base64, a blank, its id), read by the driver."""
    size = Path(path).stat().st_size
    if size > MAX_RANK_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_RANK_BYTES} travel to the tasks")
    return Path(path).read_bytes()


def tokens_of(ranks: bytes) -> dict[bytes, int]:
    """Id by bytes; every single byte must have one."""
    tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    lacking = [b for b in range(256) if bytes([b]) not in tokens]
    if lacking:
        raise ValueError(f"the rank file lacks the bytes {lacking[:5]}")
    return tokens


def merge_rows(tokens: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """(left id, right id, rank): every way to put a token together from two others."""
    for token, rank in tokens.items():
        for cut in range(1, len(token)):
            left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
            if left is not None and right is not None:
                yield left, right, rank


class Codec:
    """A rank file as tables of an embedded connection."""

    def __init__(self, ranks: bytes):
        tokens = tokens_of(ranks)
        self.tokens = tokens
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        left, right, rank = zip(*merge_rows(tokens), strict=True)
        pairs = np.array(left, dtype=np.int64) * 2**32 + np.array(right, dtype=np.int64)
        made = pa.table({"pair": pairs, "rank": np.array(rank, dtype=np.int32)})
        self._load("merges", made)
        # Bytes as characters 0 to 255, since text is what can be put together in order.
        texts = pa.table({
            "id": pa.array(tokens.values(), pa.int32()),
            "bytes": pa.array([t.decode("latin-1") for t in tokens], pa.string()),
        })
        self._load("vocabulary", texts)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (none empty), as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        rows = pa.table({
            "place": np.arange(len(raw), dtype=np.int32),
            "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "id": self.byte_ids[raw].astype(np.int32),
        })
        self.con.register("bytes_of_words", rows)
        found = self.con.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("bytes_of_words")
        ids = np.asarray(found.flatten(), dtype="<i4")
        ends = np.asarray(found.offsets) - found.offsets[0].as_py()
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of the words."""
        new = sorted(words - self.known.keys())
        size = sum(map(len, new))
        if self.known_bytes + size > KNOWN_BYTES and self.known:
            self.known, self.known_bytes = {}, 0
            new = sorted(words)
            size = sum(map(len, new))
        self.known_bytes += size
        for part in slices(new, [len(w.encode()) for w in new], WORD_BYTES):
            self.known.update(zip(part, self.encode_words([w.encode() for w in part]), strict=True))

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cut = [pattern.findall(t) if t else [] for t in texts]
        self.learn(set(itertools.chain.from_iterable(cut)))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes | None]:
        """The bytes that each list of ids stands for; None where an id is unknown."""
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        every = np.concatenate([*ids, np.zeros(0, dtype=np.int32)]).astype(np.int32)
        rows = pa.table({
            "row_no": np.repeat(np.arange(len(ids), dtype=np.int32), lengths),
            "place": np.arange(len(every), dtype=np.int32),
            "id": every,
        })
        self.con.register("ids_of_rows", rows)
        found = dict(self.con.execute(DECODE).fetchall())
        self.con.unregister("ids_of_rows")
        texts = (found.get(i, "") for i in range(len(ids)))
        return [None if t is None else t.encode("latin-1") for t in texts]


def slices(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """The items in runs of at most ``most`` in size; a larger one alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield items[start:i]
            start, total = i, 0
        total += size
    if start < len(items):
        yield items[start:]


_CODECS: dict[bytes, Codec] = {}


def codec(ranks: bytes) -> Codec:
    """The worker's codec of the rank file, made once."""
    key = hashlib.sha256(ranks).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks)
    return _CODECS[key]


def encode_texts(
    docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", id_col: str = "doc_id",
    decoded: bool = False,
) -> DataFrame:
    """(id, ids): the token ids of every whole text; with ``decoded``, also the bytes they stand for."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>"
    schema += ", decoded binary" if decoded else ""
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = codec(sent.value), regex.compile(pattern)
        for batch in batches:
            lengths = [len(t.as_py() or "") for t in batch.column(1)]
            start = 0
            for rows in slices(list(range(batch.num_rows)), lengths, TEXT_BYTES):
                part = batch.slice(start, len(rows))
                start += len(rows)
                ids = [np.frombuffer(b, "<i4") for b in known.encode(part.column(1).to_pylist(), cut)]
                columns = [part.column(0).cast(arrow.field(0).type), list_array(ids)]
                if decoded:
                    columns.append(pa.array(known.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = arrow_map(docs.select(F.col(id_col), F.col(text)), run, schema)
    return out.withColumnRenamed("id", id_col)


def list_array(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    every = np.concatenate([*ids, np.zeros(0, dtype=np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(every))


def decode_ids(rows: DataFrame, ranks: bytes, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, decoded): the bytes that each list of ids stands for."""
    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, decoded binary"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(sent.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            start = 0
            for part in slices(lists, [4 * len(i or ()) for i in lists], TEXT_BYTES):
                asked = [np.array([-1 if x is None else x for x in i or ()], dtype=np.int32) for i in part]
                found = known.decode(asked)
                found = [None if i is None else d for i, d in zip(part, found, strict=True)]
                same = batch.column(0).slice(start, len(part)).cast(arrow.field(0).type)
                start += len(part)
                yield pa.RecordBatch.from_arrays([same, pa.array(found, pa.binary())], schema=arrow)

    out = arrow_map(rows.select(F.col(id_col), F.col(ids)), run, schema)
    return out.withColumnRenamed("id", id_col)


def out_of_order(tokens: dict[bytes, int]) -> list[bytes]:
    """Tokens that leftmost least-rank merges don't reach by ranks up to their own."""
    wrong = []
    for token, rank in tokens.items():
        parts, highest = [bytes([b]) for b in token], 0
        while len(parts) > 1:
            least, at = min((tokens.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if least == 1 << 40:
                break
            highest = max(highest, least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(token) > 1 and (len(parts) > 1 or highest > rank):
            wrong.append(token)
    return wrong


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded texts."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
