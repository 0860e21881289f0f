import hashlib

from tallymark.llm.linededup import dedup_lines, without_repeated_lines

BLANKS = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    first = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if key is not None and len(k) >= 10:
                first[k] = min(key, first.get(k, key))
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key is None or first.get(key_of(x), key) == key]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_batches_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for batches in (1, 5):
        got = [tuple(r) for r in dedup_lines(docs, batches=batches).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [tuple(r) for r in dedup_lines(odd).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert dedup_lines(none).count() == 0
    hot = "\n".join(["the same long line"] * 3)
    many = spark.createDataFrame([(i, hot + f"\nown line of {i}") for i in range(300)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in dedup_lines(many).collect()}
    assert kept[0].count("same") == 3 and all("same" not in kept[i] for i in range(1, 300))


def test_rows_that_share_an_id(spark):
    """Each text of an id loses its own lines, at its own places."""
    shared = "a line that others hold too"
    rows = [
        (1, f"{shared}\nfirst of one"), (2, f"{shared}\nfirst text of two\n{shared}"), (2, f"only in the second text\n{shared}"),
        (2, f"only in the second text\n{shared}"), (2, None), (3, "only in the second text\nfirst text of two"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    for batches in (1, 3):
        got = [tuple(r) for r in dedup_lines(docs, batches=batches).collect()]
        assert sorted(got, key=str) == brute(rows)
    kept = [r.text for r in without_repeated_lines(docs, length_col=None).where("doc_id = 2").collect()]
    assert sorted(map(str, kept)) == ["None", "first text of two", "only in the second text", "only in the second text"]


def test_string_ids(spark):
    rows = [(f"id-{i % 37:02d}", f"line number {i % 11} of all\nown line of {i}") for i in range(90)] + [(None, "line number 1 of all")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    for batches in (1, 4):
        got = [tuple(r) for r in dedup_lines(docs, batches=batches).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_documents_keep_columns(odd):
    got = without_repeated_lines(odd)
    assert got.schema == odd.schema
    texts = {r.doc_id: r for r in got.collect()}
    assert texts[2].text == "" and texts[2].n_chars == 0
    assert texts[4].text is None
    digest = hashlib.sha256((texts[5].text or "").encode()).hexdigest()
    assert digest == hashlib.sha256(odd.where("doc_id = 5").first().text.encode()).hexdigest()
