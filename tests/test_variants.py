import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from logweir.functions.redact import redact
from logweir.functions.variants import at_path, redact_variant, whole, with_variant

TEXTS = [
    '{"email": "x", "k": 1}', '{"email": null}', '{"a": {"email": "x"}}', '{"Email": "x"}', "[1]", '"s"', "null", "{}",
    '{"ssn": [1, {"email": 2}], "password": true, "n": 12345678901234567890}', None, '{"cut": ', "",
    '{"": 1, "credit_card": "4000"}',
]


def test_variant_redaction_agrees_with_that_of_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, metadata string")
    want = {r["n"]: (r["metadata"], r["pii_redacted"]) for r in redact(rows).collect()}
    got = redact_variant(with_variant(rows)).select("n", F.to_json(whole()).alias("metadata"), "pii_redacted")
    for r in got.collect():
        text, hit = want[r["n"]]
        try:
            parsed = None if text is None else json.loads(text)
        except ValueError:
            parsed = None  # not JSON: NULL as a variant
        assert (None if r["metadata"] is None else json.loads(r["metadata"])) == parsed
        assert r["pii_redacted"] == (hit and parsed is not None)


def test_paths_and_given_fields(spark):
    rows = with_variant(spark.createDataFrame([('{"a": {"b": 5}, "t": "x"}',), ('{"a": 7}',), ("[]",)], "metadata string"))
    paths = rows.select(at_path(F.col("metadata"), "$.a.b", "bigint").alias("b")).collect()
    assert [r["b"] for r in paths] == [5, None, None]
    masked = redact_variant(rows, ["a"]).select(F.to_json(whole()).alias("m"), "pii_redacted").collect()
    assert [(r["m"], r["pii_redacted"]) for r in masked] == [
        ('{"a":"[REDACTED]","t":"x"}', True), ('{"a":"[REDACTED]"}', True), ("[]", False)]
    assert not any(r["pii_redacted"] for r in redact_variant(rows, []).collect())


def test_a_path_filter_reads_a_column_of_the_file(spark, tmp_path):
    rows = spark.range(3_000).select(F.format_string('{"user": %d, "plan": "p%d"}', "id", F.col("id") % 3).alias("metadata"))
    mixed = rows.unionAll(spark.createDataFrame([("[1]",), ('"s"',)], "metadata string"))
    with_variant(mixed).coalesce(1).write.parquet(str(tmp_path / "v"))
    schema = str(pq.ParquetFile(next((tmp_path / "v").glob("*.parquet"))).schema)
    assert "typed_value" in schema and " user " in schema
    found = spark.read.parquet(str(tmp_path / "v")).where(at_path(F.col("metadata"), "$.user", "bigint") == 77)
    assert found.count() == 1
    assert "metadata#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "DataFilters: [isnotnull(metadata" in plan
