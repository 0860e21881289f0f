"""The Merkle manifest against a loop over the rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.llm import merkle
from tallymark.llm.common import lowered
from tallymark.llm.queries import QUERIES

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """Root, and for each leaf the list of (left, right) on its way up."""
    steps = [[] for _ in digests]
    where = list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(where):
            first = at // 16 * 16
            run = digests[first : first + 16]
            steps[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            where[i] = at // 16
        digests = [sha(*digests[i : i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], steps


def expected(rows):
    """Result rows for (doc_id, text, lang, source, n_chars) rows."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of([doc_id, source, lang, n_chars, text])
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        changed = text.encode().translate(LOWER).decode() if chosen and text is not None else text
        groups[source].append((doc_id is not None, doc_id or 0, leaf, doc_id, leaf_of([doc_id, source, lang, n_chars, changed])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    if not order:
        return []
    root, above = tree([built[s][0] for s in order])
    out = []
    for source, high in zip(order, above, strict=True):
        subroot, paths = built[source]
        for row, low in zip(sorted(groups[source], key=lambda r: r[:3]), paths, strict=True):
            steps, folded = low + high, row[4]
            for left, right in steps:
                folded = sha(left, folded, right)
            proof = sha(*(a + b for a, b in steps))
            out.append((row[3], row[2], subroot, root, proof, folded, folded == root))
    return sorted(map(str, out))


def manifest_of(docs):
    made = merkle.merkle_manifest(
        docs, tampered={"text": lowered(F.col("text"))}, when=merkle.chosen_for_tampering(F.col("doc_id"))
    )
    return sorted(str(tuple(r)) for r in merkle.checked(made).collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_query_against_the_loop(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = QUERIES["op12_merkle"](spark, sf)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 1, 16, 17], [256, 257, 15], [1] * 17, [300, 1, 1] + [2] * 20])
def test_heights_of_trees(spark, sizes):
    rows = [(100 * s + i * 7, f"Text {i}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert manifest_of(docs) == expected(rows)


def test_odd_documents(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert manifest_of(odd) == expected(rows)
    assert manifest_of(none) == []


def test_ties_repeated_rows_and_hot_groups(spark):
    rows = [(5, "Same", "en", "hot", 4)] * 40 + [(5, "Other", None, "hot", None)] * 3
    rows += [(i, f"T{i}", "en", "hot", i) for i in range(700)] + [(i, None, None, None, None) for i in range(20)]
    rows += [(None, "A", "en", "é", 1), (None, "B", "en", "é", 1), (1, "C", "en", "z", 1)]
    assert manifest_of(spark.createDataFrame(rows, SCHEMA).repartition(9)) == expected(rows)


def test_tampering_is_found_and_nothing_else(spark):
    rows = [(i, f"text {i}" if i % 2 else f"Text {i}", "en", "abc"[i % 3], i) for i in range(200)]
    made = merkle.merkle_manifest(
        spark.createDataFrame(rows, SCHEMA), tampered={"text": lowered(F.col("text"))}, when=F.lit(True)
    )
    assert {r.doc_id for r in merkle.checked(made).where("NOT verified").collect()} == set(range(0, 200, 2))
    untouched = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    assert merkle.checked(untouched).where("verified").count() == 200


def test_string_ids(spark):
    rows = [(c, "x", "s") for c in "bca"]
    docs = spark.createDataFrame(rows, "key string, body string, part string")
    made = merkle.merkle_manifest(docs, ["key", "body"], "part", "key").collect()
    leaves = [leaf_of([c, "x"]) for c in "abc"]
    assert {r.subroot for r in made} == {r.root for r in made} == {sha(*leaves)}
