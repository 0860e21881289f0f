import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as tx
from tallymark.operators import cer as ops


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_window(page, ref):
    if not ref:
        return (0.0 if not page else 1.0), ""
    if ref in page:
        return 0.0, ref
    best, span = 1.0, ""
    for w in range(max(1, len(ref) - 2), len(ref) + 3):
        for i in range(0, len(page) - w + 1):
            d = distance(page[i : i + w], ref) / len(ref)
            if d < best:
                best, span = d, page[i : i + w]
    return best, span


def test_cer_edges(spark):
    rows = [("", "", 0.0), ("x", "", 1.0), ("", "ab", 1.0), ("abcdef", "ab", 2.0), ("é", "e", 1.0), ("ab", "ab", 0.0)]
    df = spark.createDataFrame(rows, "hyp string, ref string, want double")
    for r in df.withColumn("got", tx.cer(F.col("hyp"), F.col("ref"))).collect():
        assert r.got == r.want, r


def window_cases():
    rng = random.Random(1)
    cases = [("", "abc"), ("ab", "abcdef"), ("xyz", ""), ("", ""), ("hello world", "wor"), ("zzzz", "ab"), ("é漢字é", "漢é")]
    for _ in range(60):
        page = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        cases.append((page, "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))))
    for _ in range(30):
        # A distorted copy of the reference somewhere on a longer page.
        ref = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 25)))
        near = "".join(c for c in ref if rng.random() > 0.1)
        around = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 90))) for _ in range(2)]
        cases.append((near.join(around), ref))
    return [(i, p, r) for i, (p, r) in enumerate(cases)]


@pytest.mark.parametrize("stride", [3, 16, 512])
def test_page_window_equals_brute_force(spark, stride, monkeypatch):
    monkeypatch.setattr(tx, "WINDOW_STRIDE", stride)
    cases = window_cases()
    df = spark.createDataFrame(cases, "id int, page string, ref string")
    out = {r.id: r for r in ops.page_window_rows(df).collect()}
    for i, page, ref in cases:
        assert (out[i].cer, out[i].hyp) == best_window(page, ref), (page, ref)


def test_few_windows_of_a_long_page_are_compared(spark):
    rng = random.Random(2)
    page = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000))
    ref = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))
    near = ref[:7] + "#" + ref[8:19] + ref[20:]
    df = spark.createDataFrame([(page[:40_000] + near + page[40_000:], ref)], "page string, ref string")
    found = df.select(tx.window_search(F.col("page"), F.col("ref")).alias("f")).select("f.*").first()
    assert (found.best.edits, found.best.start) == (2, 40_001) and found.best.width == 23
    # Of 300,000 windows.
    assert found.calls < 3_000


def test_error_rates_take_one_pass(spark):
    df = records(spark, [("r", {"a": "abcd"}, {}, "xabcx")])
    rows = ops.field_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in rows and rows.count("Scan ") == 1
    items = ops.record_items(df)._jdf.queryExecution().executedPlan().toString()
    assert items.count("Exchange hash") == 1 and items.count("Scan ") == 1


def records(spark, rows):
    return spark.createDataFrame(
        rows, "id string, gt_fields map<string,string>, hyp_fields map<string,string>, page string"
    )


def test_field_lookup_order(spark):
    df = records(
        spark,
        [
            ("exact", {"a": "x"}, {"a": "x", "A": "y"}, "zz"),
            ("case", {"a": "x"}, {"A": "x"}, "zz"),
            ("blank", {"a": "xy"}, {}, "..xz.."),
            ("page", {"a": "xy"}, {}, "..xy.."),
            ("nothing", {"a": "xy"}, {}, ""),
            ("null", {"a": None, "b": "q"}, {"b": "q"}, ""),
        ],
    )
    # The first key equal in lower case is blank: its successor is not tried.
    blank_first = F.create_map(F.lit("a"), F.lit(""), F.lit("A"), F.lit("xy"))
    df = df.withColumn("hyp_fields", F.when(F.col("id") == "blank", blank_first).otherwise(F.col("hyp_fields")))
    rows = {(r.id, r.field): (r.cer, r.hyp, r.match) for r in ops.field_rows(df).collect()}
    assert rows[("exact", "a")] == (0.0, "x", "fields")
    assert rows[("case", "a")] == (0.0, "x", "fields")
    assert rows[("blank", "a")] == (0.5, "x", "page_window")
    assert rows[("page", "a")] == (0.0, "xy", "page_window")
    assert rows[("nothing", "a")] == (1.0, "", "fields")
    assert ("null", "a") not in rows and len(rows) == 6


def test_micro_weights_and_missing_fields(spark):
    df = records(spark, [("r", {"a": "abcd", "b": ""}, {"a": "abcx", "b": "z"}, ""), ("none", {}, {}, "")])
    rows = ops.field_rows(df)
    items = {r.id: r.cer_field for r in ops.record_cer(df.select("id"), rows).collect()}
    assert items["r"] == pytest.approx((0.25 * 4 + 1.0) / 5)
    assert items["none"] is None
    assert {r.id: (r.cer_field, r.n_fields) for r in ops.record_items(df).collect()} == {
        "r": (items["r"], 2), "none": (None, 0),
    }
    macro = ops.cer_macro(ops.record_cer(df.select("id"), rows)).first()
    assert (macro.n, macro.n_with_gt_fields) == (2, 1)
    assert ops.cer_macro(ops.record_cer(df.where("id = 'none'").select("id"), rows)).first().cer_field is None


def test_breakdown_and_running(spark):
    df = spark.createDataFrame(
        [(0, "latin", "alb", 0.5), (1, "greek", "grc", None), (2, "latin", "alb", 0.1), (3, None, None, 0.3)],
        "row_index long, script string, country string, cer_field double",
    )
    rows = {(r.level, r.key): r for r in ops.cer_breakdown(df, {"grc": "el"}).collect()}
    assert rows[("overall", "")].n == 4 and rows[("overall", "")].n_with_gt_fields == 3
    assert rows[("country", "grc")].lang_code_used == "el"
    assert rows[("country", "alb")].script == "latin"
    assert rows[("script", "unknown")].cer_field == 0.3
    running = ops.running_cer(df, chunk_rows=2).orderBy("row_index").collect()
    assert [round(r.running_cer_field, 6) for r in running] == [0.5, 0.5, 0.3, 0.3]


def test_scope(spark):
    df = spark.createDataFrame(
        [("1", "alb_id", None), ("2", "GRC_x", None), ("3", "zzz", "Latin"), ("4", "zzz", None)],
        "id string, doc_type string, script string",
    )
    assert {r.id for r in ops.scope_filter(df, ["LATIN"]).collect()} == {"1", "3"}
    assert {r.id for r in ops.scope_filter(df, None, ["grc", "unknown"]).collect()} == {"2", "3", "4"}
    with pytest.raises(ops.EmptyScopeError):
        ops.require_rows(ops.scope_filter(df, ["hebrew"]))


def test_gt_text(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"m": "9", "n": "8"})], "f map<string,string>, s map<string,string>")
    assert df.select(tx.gt_text_join(F.col("f"))).first()[0] == "a: 1\nb: 2"
    nested = df.select(tx.gt_text_nested(F.map_concat("f", F.create_map(F.lit("subjects"), F.lit("{}"))), "subjects", F.col("s")))
    assert nested.first()[0] == "1\n2\nm: 9\nn: 8"


def test_field_maps(spark):
    from tallymark.functions import fields as fl

    df = spark.sql(
        """SELECT map('a', named_struct('value', 'x', 'bbox', array(0D, 0D, 1D, 1D), 'confidence', 0.5D),
                      'b', named_struct('value', 'y', 'bbox', cast(null AS array<double>), 'confidence', 0.5D),
                      'c', named_struct('value', cast(null AS string), 'bbox', array(0D, 0D, 1D, 1D), 'confidence', 0.5D)) AS f,
                  map('a', 'x', 'b', cast(null AS string)) AS bare"""
    )
    row = df.select(
        fl.unwrap_fields(F.col("f")).alias("located"),
        fl.unwrap_bare(F.col("bare")).alias("bare"),
        fl.bbox_fields(F.col("bare")).alias("boxless"),
        fl.bbox_backed_text(F.col("f"), F.lit("page")).alias("text"),
        fl.bbox_backed_text(fl.bbox_fields(F.col("bare")), F.lit("page")).alias("kept"),
    ).first()
    assert row.located == {"a": "x"} and row.bare == {"a": "x"}
    assert set(row.boxless) == {"a", "b"} and row.boxless["a"].value is None and row.boxless["a"].bbox is None
    assert (row.text, row.kept) == ("x", "page")
