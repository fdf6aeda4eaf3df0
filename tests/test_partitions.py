"""Order-sensitive queries give the same rows whatever the number of input and shuffle partitions."""

import pytest

import __spark_entry__ as entry

NAMES = [
    "a1_read_examples", "b6_running_progress", "b10_error_budget", "d3_attempt_progress", "d9_minibatches", "d13_knn_demos",
    "e7_duration_percentiles", "e10_backlog", "f1_upsert_dims", "f6_allocate", "g8_diff_manifests", "h7_dataset_digest", "i3_trace_tree",
    "l3_lease_intervals", "l7_sequence_gaps",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_on_any_partitioning(spark, sf_dir, name):
    query = entry.queries()[name]
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    got = []
    try:
        for values in (("1", "128m", "true"), ("17", "16k", "false")):
            for k, v in zip(keys, values):
                spark.conf.set(k, v)
            df = query(spark, sf_dir)
            got.append(sorted(map(repr, df.select(*sorted(df.columns)).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == got[1]
