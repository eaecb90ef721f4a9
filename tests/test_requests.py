import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweir.functions.decode import parse_events
from logweir.operators import auth, metrics
from logweir.schema import API_KEYS, REQUESTS
from logweir.sources.requests import explode_requests

NOW = dt.datetime(2024, 2, 1)
LINE = '{"message": "line %d"}'


@pytest.fixture(scope="module")
def keys(spark):
    rows = [
        ("good", "", True, NOW, None), ("later", "", True, NOW, NOW + dt.timedelta(seconds=1)),
        ("now", "", True, NOW, NOW), ("off", "", False, NOW, None), ("", "", True, NOW, None),
    ]
    return spark.createDataFrame(rows, API_KEYS)


def requests(spark, *cases):
    rows = [
        (n, NOW, method, "/ingest", "addr", key, media, None if body is None else bytearray(body.encode()))
        for n, (method, key, media, body) in enumerate(cases)
    ]
    return spark.createDataFrame(rows, REQUESTS)


JSON, NDJSON = "application/json", "application/x-ndjson"


GOOD_KEY = [
    (("POST", "good", JSON, '{"message": "hello"}'), (202, "accepted")),
    (("POST", "good", NDJSON, f"{LINE % 1}\n{LINE % 2}"), (202, "accepted")),
    (("GET", "good", JSON, "{}"), (405, "method_not_allowed")),
    (("POST", "good", "text/plain", "hello"), (415, "error_media_type")),
    (("POST", "good", JSON, '{"message": "hello"'), (400, "error_parse")),
    (("POST", "good", NDJSON, f'{LINE % 1}\n{{"message": "bad'), (202, "accepted")),
    (("POST", "good", JSON, ""), (400, "error_parse")),
    (("POST", "good", JSON, None), (400, "error_parse")),
    (("POST", "good", NDJSON, ""), (202, "accepted")),
    (("POST", "", JSON, "{}"), (401, "unauthorized")),
    (("POST", None, JSON, "{}"), (401, "unauthorized")),
    (("POST", "off", JSON, "{}"), (401, "unauthorized")),
    (("POST", "now", "text/plain", "{}"), (401, "unauthorized")),
    (("POST", "later", JSON, "{}"), (202, "accepted")),
    (("GET", "off", "text/plain", ""), (405, "method_not_allowed")),
]


def outcomes(spark, keys, cases, **limits):
    rows = auth.request_outcome(requests(spark, *cases), keys, F.lit(NOW), **limits).collect()
    return {r["request_id"]: (r["status"], r["label"]) for r in rows}


def test_outcomes(spark, keys):
    got = outcomes(spark, keys, [case for case, _ in GOOD_KEY], max_bytes=1024)
    assert got == {n: want for n, (_, want) in enumerate(GOOD_KEY)}


def test_too_large(spark, keys):
    cases = [
        ("POST", "good", JSON, '{"message": "%s"}' % ("x" * 56)),
        ("POST", "good", NDJSON, "\n".join(LINE % n for n in range(9))),
    ]
    assert outcomes(spark, keys, cases, max_bytes=50) == {0: (413, "error_size"), 1: (413, "error_size")}


def test_over_long_line_comes_before_size(spark, keys):
    body = f"{LINE % 1}\n" + "x" * 200
    case = [("POST", "good", NDJSON, body)]
    assert outcomes(spark, keys, case, max_bytes=100, line_limit=64) == {0: (400, "error_line")}
    assert outcomes(spark, keys, case, max_bytes=60, line_limit=500) == {0: (413, "error_size")}
    assert outcomes(spark, keys, case, line_limit=None) == {0: (202, "accepted")}


def payloads(spark, body, media=NDJSON, **limits):
    rows = explode_requests(requests(spark, ("POST", "good", media, body)), **limits)
    found = rows.orderBy("line_no").collect()
    return [r["raw_event"] for r in found], [r["raw_event"] for r in found if not r["past_limit"]]


def test_lines_of_a_request(spark):
    assert payloads(spark, "a\r\n\n\r\nb\r\r\nc\n")[0] == ["a", "b\r", "c"]
    assert payloads(spark, "a\nb", media=JSON) == (["a\nb"], ["a\nb"])
    assert payloads(spark, "a", media="text/plain") == ([], [])


def test_limits_mark_lines_and_cut_none(spark):
    assert payloads(spark, "abcdef", media=JSON, max_bytes=3) == (["abcdef"], [])
    assert payloads(spark, "ab\ncdef", max_bytes=5) == (["ab", "cdef"], ["ab"])
    assert payloads(spark, "ab\ncdef\ng", max_bytes=7) == (["ab", "cdef", "g"], ["ab", "cdef"])
    assert payloads(spark, "ab\ncdef", max_bytes=3) == (["ab", "cdef"], ["ab"])
    assert payloads(spark, "ab\nabcd\nef", line_limit=4) == (["ab", "abcd", "ef"], ["ab"])
    assert payloads(spark, "ab\nabc\nef", line_limit=4) == (["ab", "abc", "ef"], ["ab", "abc", "ef"])


def test_line_limit_boundary(spark):
    fits, long = "x" * 65_535, "x" * 65_536
    assert payloads(spark, f"a\n{fits}\nb")[1] == ["a", fits, "b"]
    assert payloads(spark, f"a\n{long}\nb") == (["a", long, "b"], ["a"])


def test_counters(spark, keys):
    good = '{"message":"m"}'
    cases = [
        ("POST", "good", JSON, good), ("POST", "good", JSON, "[]"), ("POST", "good", JSON, "x" * 200),
        ("POST", "good", NDJSON, f"{good}\nbad\n\n{good}\r\n"), ("POST", "good", "text/plain", good),
        ("POST", "off", JSON, good), ("GET", "good", JSON, good),
        # Over the limit: two lines are within it, the others past it; none of them counts.
        ("POST", "good", NDJSON, "\n".join([good] * 20)),
        # An over-long line: what came before it is not counted either.
        ("POST", "good", NDJSON, f"{good}\n" + "y" * 35),
    ]
    limits = {"max_bytes": 40, "line_limit": 20}
    rows = metrics.events_by_status(requests(spark, *cases[:7]), keys, F.lit(NOW), max_bytes=100).collect()
    assert {r["status"]: r["events"] for r in rows} == {
        "accepted": 3, "error_parse": 2, "error_size": 1, "error_media_type": 1,
    }
    rows = metrics.events_by_status(requests(spark, *cases[7:]), keys, F.lit(NOW), **limits).collect()
    assert {r["status"]: r["events"] for r in rows} == {"error_size": 1}
    rows = metrics.ingest_rows(requests(spark, *cases[7:]), keys, F.lit(NOW), **limits)
    found = {(r["request_id"], r["event_status"]): r["count"] for r in rows.groupBy("request_id", "event_status").count().collect()}
    assert found == {(0, "uncounted"): 2, (0, "past_limit"): 18, (0, "error_size"): 1, (1, "uncounted"): 1, (1, "past_limit"): 1}
    total = metrics.bytes_total(requests(spark, *cases), keys, F.lit(NOW)).first()["bytes"]
    assert total == sum(len(c[3]) for c in cases if c[0] == "POST" and c[1] == "good")


def test_keys_split_the_requests(spark, keys):
    cases = [("POST", key, JSON, "{}") for key in ("good", "now", "later", "off", "", None, "unknown")]
    df = requests(spark, *cases)
    admitted = {r["api_key"] for r in auth.authenticate(df, keys, F.lit(NOW)).collect()}
    refused = {(r["api_key"], r["reason"]) for r in auth.reject_unauthenticated(df, keys, F.lit(NOW)).collect()}
    assert admitted == {"good", "later"}
    assert refused == {
        ("now", "invalid"), ("off", "invalid"), ("unknown", "invalid"), ("", "missing"), (None, "missing"),
    }


def test_payload_of_a_request_decodes(spark):
    rows = parse_events(explode_requests(requests(spark, ("POST", "good", NDJSON, LINE % 1 + "\n" + LINE % 2))))
    assert [r["message"] for r in rows.orderBy("line_no").collect()] == ["line 1", "line 2"]


def test_summary_and_access_log(spark):
    rows = [(NOW + dt.timedelta(seconds=n), 202 if n % 4 else 400) for n in range(9)]
    summary = metrics.request_summary(
        spark.createDataFrame(rows, "request_received_at timestamp, status int")
    ).first()
    assert (summary["requests"], summary["succeeded"], summary["failed"]) == (9, 6, 3)
    assert summary["requests_per_second"] == pytest.approx(9 / 8)
    log = spark.createDataFrame(
        [("POST", "/ingest", 202, ms) for ms in range(1, 201)] + [("POST", "/ingest", 400, 7)],
        "method string, path string, status int, duration_ms long",
    )
    got = {r["status"]: (r["requests"], r["p50_ms"], r["p95_ms"], r["p99_ms"]) for r in metrics.access_log(log).collect()}
    assert got == {202: (200, 100, 190, 198), 400: (1, 7, 7, 7)}
