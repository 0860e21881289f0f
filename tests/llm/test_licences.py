import random
import re

from tallymark.llm.licences import BASE_PHRASES, licence_scan, matcher


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [
        (i, label)
        for phrase, label in BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(places, default=None), max(places, default=None), labels


def test_base_against_brute_force():
    draw = random.Random(3)
    words = "under the mit license apache version 2 cc by nc é zz".split()
    for _ in range(3000):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))
        assert matcher().scan(text)[:5] == brute(text)


def test_template_with_changes_is_covered():
    text = (
        "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this "
        "software and associated files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute"
    )
    scan = matcher().scan(text)
    assert scan[1] == 0 and scan[5] == "mit" and 0.6 <= scan[6] < 1
    assert matcher().scan("permission to use a copy of the files")[5] == ""


def test_odd_rows(odd, none):
    got = licence_scan(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
            assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert licence_scan(none).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "under the MIT license"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: r.base_labels for r in licence_scan(docs).collect()} == {"a": "mit", None: ""}
