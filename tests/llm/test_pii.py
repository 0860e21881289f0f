import hashlib
import random
import re

from pyspark.sql import functions as F

from tallymark.llm import pii
from tallymark.llm.pii import find_personal_data, personal_data_counts


def luhn(digits):
    turned = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(turned)) % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    told = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]
    counts = [sum(x[2] == k for x in out) for k in ("email", "ip", "card", "phone")]
    return (*counts, hashlib.sha256(",".join(told).encode()).hexdigest()), told


def test_base_against_brute_force(spark):
    draw = random.Random(1)
    parts = ["a", "b1", ".", "@", "-", "+", " ", "1", "23", "4111111111111111", "10.0.0.1", "(", "_",
             "\U0001f600", "é", "555", "256", "@x.y", "\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(1000)]
    texts += ["1" * 50_000, "a@b" + ".c" * 20_000, "1 " * 20_000, "1.1.1.1." * 3000, "+1" * 2000, None, ""]
    texts += ["x" * 50_000 + "@", "a" * 5000 + "@b.c_d@e.f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = personal_data_counts(find_personal_data(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        want, told = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == want
        assert set(told) <= set(r.spans.split(",")) or not told


def test_native_plan_and_added_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = find_personal_data(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = found.select("doc_id", F.explode("spans").alias("s")).where("NOT s.base").collect()
    for r in added:
        assert r.s.kind in pii.KINDS and 0 <= r.s.start < r.s.end <= len(texts[r.doc_id])


def numbers_with_luhn(draw, n):
    out = []
    while len(out) < n:
        digits = "4" + "".join(draw.choice("0123456789") for _ in range(15))
        if luhn(digits):
            out.append(digits)
    return out


def corpus(draw):
    """Strict spans of every kind in telling contexts, some that fail, and numbers that are no data."""
    names = ["john.doe", "ann", "m.k-l", "info", "sales_2"]
    hosts = ["example.com", "corp.org", "mail.firm.net", "x.co.uk"]
    words = "the quick brown fox jumps over lazy dogs near old river banks today".split()
    filler = lambda: " ".join(draw.choice(words) for _ in range(6))
    texts = []
    for card in numbers_with_luhn(draw, 60):
        ip = ".".join(str(draw.randrange(256)) for _ in range(4))
        phone = f"+{draw.randrange(1, 99)} {draw.randrange(100, 999)} {draw.randrange(100, 999)} {draw.randrange(1000, 9999)}"
        texts.append(
            f"{filler()} write to {draw.choice(names)}@{draw.choice(hosts)} or call {phone}. {filler()} pay by card "
            f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]} at host {ip} {filler()}"
        )
        year, month = draw.randrange(1990, 2024), draw.randrange(10, 13)
        texts.append(
            f"{filler()} on {year}-{month}-{draw.randrange(10, 28)} {draw.randrange(10, 24)}.{draw.randrange(10, 60)} "
            f"{filler()} version {draw.randrange(9)}.{draw.randrange(300, 999)}.{draw.randrange(300, 999)}.1 "
            f"sum {draw.randrange(10**5, 10**8)} of {draw.randrange(10**5, 10**8)} {filler()} look (at) home. {filler()}"
        )
    return texts


def test_planted_loose_forms_are_added_and_near_misses_are_not(spark):
    draw = random.Random(4)
    good = numbers_with_luhn(draw, 2)
    dotted = lambda c: ".".join(c[i : i + 4] for i in range(0, 16, 4))
    bad = good[0][:-1] + str((int(good[0][-1]) + 1) % 10)
    planted = [
        ("email", "please write to ", "john.doe [at] example dot com"),
        ("email", "contact ", "jane (at) corp (dot) org"),
        ("ip", "the host ", "10[.]0[.]0[.]1"),
        ("ip", "login at server ", "192 . 168 . 7 . 20"),
        ("phone", "call ", "555-010-9999-12"),
        ("phone", "phone ", "(491) 7012-3456-78"),
        ("card", "pay by card ", dotted(good[0])),
        ("card", "credit card ", dotted(good[1]).replace(".", "/")),
    ]
    misses = [
        ("email", "please write to ", "us (at) home"),
        ("ip", "the host ", "10[.]0[.]0[.]999"),
        ("card", "pay by card ", dotted(bad)),
        ("phone", "call ", "555-010"),
    ]
    texts = corpus(draw)
    spots = {}
    for kind, before, span in planted + misses:
        text = f"the old river bank today {before}{span} and the quick brown fox"
        spots[len(texts)] = (kind, text.index(span), text.index(span) + len(span))
        texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    for i, (kind, start, end) in list(spots.items())[: len(planted)]:
        assert (kind, start, end) in [(s.kind, s.start, s.end) for s in found[i]], texts[i]
    for i in list(spots)[len(planted) :]:
        assert not found[i], (texts[i], found[i])
    # Strict spans stay, and plain numbers and dates are left alone.
    for i, text in enumerate(texts[:120]):
        told = [f"{s.kind}:{s.start}:{s.end}" for s in found[i]]
        assert told == brute(text)[1], (text, told)


def test_plain_forms_and_rewriting(spark):
    rows = [("email", "a.b@c-d.org"), ("ip", "10.2.3.254"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (170) 123-4567")]
    df = spark.createDataFrame(rows, "kind string, match string")
    forms = df.select("kind", "match", F.explode(pii.loose_forms(F.col("kind"), F.col("match"))).alias("form"))
    for r in forms.withColumn("plain", pii.plain(F.col("kind"), F.col("form"))).withColumn(
        "sound", pii.sound(F.col("kind"), F.col("form"))
    ).collect():
        assert re.fullmatch(pii.LOOSE[r.kind][0], r.form) and re.search(pii.LOOSE[r.kind][1], r.form), r
        assert r.sound and r.form != r.match
        if r.kind in ("email", "ip"):
            assert r.plain == r.match


def test_trees_learn_and_thresholds_hold(spark):
    rows = [(i % 7, i % 5, int((i % 7 <= 3) == (i % 5 <= 1)), 1) for i in range(700)]
    sample = spark.createDataFrame(rows, "a int, b int, label int, n long")
    model = pii.fit_trees(sample, ["a", "b"], 12, 0.5)
    score = sum((t.score() for t in model), F.lit(0.0))
    wrong = sample.where((score > 0).cast("int") != F.col("label")).count()
    assert wrong == 0
    one_class = pii.fit_trees(sample.where("a = 0 AND b = 0"), ["a", "b"], 3, 0.5)
    assert one_class == []


def test_odd_rows(odd, none):
    texts = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect() if r.doc_id is not None}
    got = personal_data_counts(find_personal_data(odd)).collect()
    assert len(got) == odd.count()
    assert all(tuple(r)[1:6] == brute(texts[r.doc_id])[0] for r in got if r.doc_id is not None)
    assert find_personal_data(none).count() == 0


def test_every_candidate_reaches_the_trees_and_thresholds(spark, monkeypatch):
    seen = []
    fit = pii.fit_trees

    def counted(sample, *more):
        whole = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in sample.inputFiles()})
        seen.append({r.kind: r.n for r in whole.groupBy("kind").agg(F.sum("n").alias("n")).collect()})
        return fit(sample, *more)

    monkeypatch.setattr(pii, "fit_trees", counted)
    texts = [f"the host 10.{i % 200}.{i // 200}.1 and 10[.]{i % 200}[.]{i // 200}[.]1 here" for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = find_personal_data(docs)
    # Each strict address in four forms, and each loose one.
    assert seen[0][pii.KINDS.index("ip")] == 5 * len(texts)
    assert found.count() == len(texts)
