import pytest

from vacantia.llm import survivors as S


@pytest.fixture()
def frames(spark):
    groups = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (4, 40), (4, 40), (5, 50), (5, 51)], "group_id bigint, job_id bigint")
    jobs = spark.createDataFrame([(10, "TBD", "x"), (11, "Data Engineer", "x"), (20, None, "x"), (40, "QA Engineer", "x"), (50, "A role", "x"), (51, "B role", "x")], "id bigint, title string, source string")
    posts = [
        # id, job, source, group, date, confidence
        (100, 10, "feed", "g", "2025-01-05T00:00:00Z", 0.5),
        (101, 11, "chat", "g", "2025-01-09T00:00:00Z", 0.9),
        (102, 11, "feed", "g", "2025-01-07T00:00:00Z", 0.5),
        (103, 11, "feed", "g", None, 0.5),
        (200, 20, "other", "g", "yesterday", None),
        (201, 20, "other", "g", "", float("nan")),
        (400, 40, "chat", "zoned", "2025-07-01 00:00:00", 0.1),
        (401, 40, "chat", "g", "2025-06-30T23:00:00Z", 0.1),
        (500, 50, "chat", "g", "soon", 0.1),
        (501, 51, "feed", "g", "soon", 0.1),
        (900, 99, "feed", "g", "2025-01-05T00:00:00Z", 0.5),
    ]
    postings = spark.createDataFrame(posts, "id bigint, job_id bigint, source string, source_group string, message_date string, parse_confidence double")
    trust = spark.createDataFrame([("feed", 1), ("chat", 2)], "source string, trust_rank int")
    zones = spark.createDataFrame([("zoned", "Europe/Berlin", "DMY")], "source_group string, tz_name string, date_order string")
    return groups, jobs, postings, trust, zones


def test_choices(spark, frames):
    got = {r.group_id: (r.title_job_id, r.source_posting_id, r.latest_posting_id) for r in S.survivors(S.group_rows(*frames)).collect()}
    assert got == {1: (11, 102, 101), 2: (0, 200, 0), 3: (0, 0, 0), 4: (40, 401, 401), 5: (51, 501, 0)}


def test_reasoned_order(spark):
    schema = "group_id bigint, job_id bigint, posting_id bigint, source string, title string, instant bigint"
    learned = [(g, g, 10 * g + k, s, "t", 1000 * g + k) for g in range(1, 4) for k, s in enumerate(["a", "b", "c"])]
    rows = spark.createDataFrame([*learned, (7, 7, 70, "b", "t", None), (7, 7, 71, "a", "t", None), (8, 8, 80, None, None, None), (9, 9, 90, "c", "t", 5), (9, 9, 91, "a", "t", None)], schema)
    order = S.learn_precedence(rows, "source")
    assert sorted(tuple(r) for r in order.collect()) == [("a", "b", 3), ("b", "c", 3)]
    got = {r.group_id: (r.value, r.reasoned) for r in S.latest_values(rows, "source", order).collect()}
    assert got[1] == ("c", False) and got[7] == ("b", True) and got[8] == (None, None) and got[9] == ("c", False)


def test_undated_values_beside_dated_ones_and_over_other_values(spark):
    order = spark.createDataFrame([("a", "b", 3), ("b", "c", 3), ("c", "d", 2), ("x", "y", 2), ("y", "x", 2)], "earlier string, later string, votes bigint")
    groups = {
        1: [("a", None), ("c", None)],  # only b, which isn't here, links them
        2: [("a", 5), ("c", None)],  # follows the latest dated value
        3: [("c", 5), ("a", None)],
        4: [("a", 5), ("q", None)],  # can't be compared
        5: [("a", 5), ("d", None), ("c", None)],
        6: [("c", 1), ("a", 5), ("b", None)],  # between dated values in both directions: time decides
        7: [("a", 5), ("c", 1), ("c", None)],  # dated as well, so not reasoned
        8: [("x", None), ("y", None)],  # circular
        9: [("a", None), ("q", None), ("d", None), ("d", None)],
    }
    rows = [(g, g, 10 * g + k, v, "t", i) for g, values in groups.items() for k, (v, i) in enumerate(values)]
    df = spark.createDataFrame(rows, "group_id bigint, job_id bigint, posting_id bigint, source string, title string, instant bigint")
    got = {r.group_id: (r.value, r.reasoned) for r in S.latest_values(df, "source", order).collect()}
    assert got == {1: ("c", True), 2: ("c", True), 3: ("c", False), 4: ("a", False), 5: ("d", True), 6: ("a", False), 7: ("a", False), 8: ("x", True), 9: ("d", True)}


def test_empty(spark, frames):
    empty = [f.limit(0) for f in frames]
    assert S.fused(S.group_rows(*empty)).count() == 0
