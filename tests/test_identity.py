import pytest
from pyspark.sql import functions as F

from tallymark.functions import handles as hd
from tallymark.operators import identity as idn


def score(spark, resume, supplied, statuses, weights=None):
    h = "person string, source string, handle string"
    resolved = idn.identity_resolve(
        spark.createDataFrame([("p", s, v) for s, v in resume.items()], h),
        spark.createDataFrame([("p", s, v) for s, v in supplied.items()], h),
        spark.createDataFrame([("p", s, v) for s, v in statuses.items()], "person string, source string, status string"),
        weights,
    )
    row = idn.identity_score(spark.createDataFrame([("p",)], "person string"), resolved).first()
    return row.score, [(d.source, d.type) for d in row.discrepancies]


def test_all_confirmed_scores_100_every_time(spark):
    runs = {
        score(spark, {"github": "a", "leetcode": "b"}, {"github": "A"}, {"github": "ok", "leetcode": "ok"}, {"github": 2.0})[0]
        for _ in range(3)
    }
    assert runs == {100}


def test_half_rounds_to_even(spark):
    handles = {f"s{i}": "x" for i in range(8)}
    statuses = {f"s{i}": ("ok" if i == 0 else "unsupported") for i in range(8)}
    assert score(spark, handles, {}, statuses) == (12, [])  # 12.5
    statuses = {f"s{i}": ("ok" if i < 3 else "unsupported") for i in range(8)}
    assert score(spark, handles, {}, statuses) == (38, [])  # 37.5


def test_mismatch_keeps_its_weight_and_is_not_looked_up(spark):
    got = score(spark, {"github": "a", "leetcode": "l"}, {"github": "b"}, {"github": "ok", "leetcode": "ok"})
    assert got == (50, [("github", "handle_mismatch")])


def test_outcomes(spark):
    got = score(
        spark,
        {"a": "x", "b": "x", "c": "x", "d": "x", "e": "x"},
        {},
        {"a": "not_found", "b": "timeout", "c": "not_provided", "e": "ok"},
    )
    assert got == (20, [("a", "profile_not_found"), ("b", "source_unavailable"), ("d", "source_unavailable")])
    assert score(spark, {}, {}, {"a": "ok"}) == (0, [(None, "no_profile_handle")])


@pytest.mark.parametrize(
    "text,urls,want",
    [
        ("see github.com/octo-cat.", [], {"github": "octo-cat"}),
        ("https://www.GitHub.com/Octo?tab=1", [], {"github": "Octo"}),
        ("GitHub: dev_1)", [], {"github": "dev_1"}),
        ("mygithub: nope", [], {}),
        ("", ["https://leetcode.com/u/zed/", "https://leetcode.com/@abe"], {"leetcode": "abe"}),
        ("codeforces.com/profile/a%2Bb+c", [], {"codeforces": "a+b+c"}),
        ("codeforces.com/profile/100%zz", [], {"codeforces": "100%zz"}),
        ("stackoverflow.com/users/42/jane-doe", [], {"stackoverflow": "jane-doe"}),
        ("stackoverflow.com/users/42", [], {"stackoverflow": "42"}),
        ("github.com/... LeetCode @ joe", [], {"leetcode": "joe"}),
        ("github.com/%C3%A9ric", [], {"github": "éric"}),
    ],
)
def test_extract_handles(spark, text, urls, want):
    df = spark.createDataFrame([(text, urls)], "t string, u array<string>")
    assert df.select(hd.extract_handles(F.col("t"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Jane  Doe\nx", "Jane Doe"),
        ("a@b.c\nhttp://x\nGitHub fan\nJ\nReal Name", "Real Name"),
        ("\r\n\x0bX Y", "X Y"),
        ("\n" * 8 + "Too Late", None),
        ("n" * 81 + "\nok then", "ok then"),
        ("", None),
    ],
)
def test_extract_name(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(hd.extract_name(F.col("t"))).first()[0] == want


def test_supplied_and_merged(spark):
    df = spark.createDataFrame(
        [({"github": "r", "leetcode": "l"}, {"profile_github": " s ", "profile_leetcode": " ", "profile_x": "y", "z": "q"})],
        "resume map<string,string>, form map<string,string>",
    )
    row = df.select(
        hd.supplied_profiles(F.col("form")).alias("s"),
        hd.merge_handles(F.col("resume"), hd.supplied_profiles(F.col("form"))).alias("m"),
    ).first()
    assert row.s == {"github": "s"} and row.m == {"github": "s", "leetcode": "l"}
