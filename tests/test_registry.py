"""Every registered query is checked by SQL, or stands on the short list that cannot be."""

import re

from __spark_entry__ import oracle_sql, queries

ROWS_ONLY = {"audit_sections", "redaction_violations", "sla_report_rows"}


def test_every_query_has_an_oracle():
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries())


def test_percentiles_are_nearest_rank(spark):
    from pyspark.sql import functions as F

    from quietwatch.functions.percentiles import nearest_rank_struct

    for n in (1, 2, 19, 20, 21, 100):
        row = nearest_rank_struct(spark.range(1, n + 1), F.col("id"), bucket_width=3.0).first().percentiles
        assert (row.p50, row.p95, row.p99) == (-(-n // 2), -(-95 * n // 100), -(-99 * n // 100))
    empty = nearest_rank_struct(spark.range(0), F.col("id")).first().percentiles
    assert (empty["count"], empty.p50) == (0, None)
