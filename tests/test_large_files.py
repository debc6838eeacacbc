"""A table in one large file: no task reads all of its rows."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamina.plans.registry import QUERIES
from lamina.sources import position, with_file_pos

SMALL = Path("/root/testdata/sf0.001")
#: As for large tables: their sides are too large for Spark to broadcast, and scans have several tasks a file.
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture
def large(spark):
    were = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in were.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_read(spark, run):
    """The most rows that one task of run read from a shuffle."""
    sc = spark.sparkContext._jsc.sc()
    sc.setJobGroup("largest", "largest", False)
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("largest"))
    run()
    sc.clearJobGroup()
    sc.listenerBus().waitUntilEmpty(30_000)
    tracker, most = spark.sparkContext.statusTracker(), 0
    for job in set(tracker.getJobIdsForGroup("largest")) - before:
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = sc.statusStore().taskList(stage, 0, 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return most


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_rows_of_a_file_stay_apart(large, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(position, "BROADCAST_FILES", broadcast, raising=False)
    monkeypatch.setattr(position, "BLOCK_ROWS", 500, raising=False)
    (tmp_path / "t").mkdir()
    for name, begin, end in (("a", 0, 1), ("b", 1, 20_001), ("c", 20_001, 20_001), ("d", 20_001, 22_501)):
        pq.write_table(pa.table({"value": pa.array(range(begin, end), pa.int64())}), tmp_path / "t" / f"{name}.parquet", row_group_size=1000)
    got = with_file_pos(large.read.parquet(str(tmp_path / "t")))
    assert got.columns == ["value", "pos"] and got.schema["pos"].dataType.simpleString() == "bigint"
    assert largest_read(large, lambda: got.write.format("noop").mode("overwrite").save()) < 11_250
    assert got.where("not (pos <=> value)").isEmpty() and got.agg(F.count_distinct("pos")).first()[0] == 22_501 == got.count()


@pytest.mark.skipif(not SMALL.exists(), reason="no sample tables")
@pytest.mark.parametrize("name", ["multi_sort", "join_miss", "join_unique", "range_scan"])
def test_no_task_reads_a_whole_table(large, tmp_path, name):
    for t in ("lineitem", "orders"):
        pq.write_table(pq.read_table(SMALL / f"{t}.parquet"), tmp_path / f"{t}.parquet", row_group_size=500)
    # Half of lineitem's 6,000 rows; a join adds an eighth of the orders, more or less.
    assert largest_read(large, lambda: QUERIES[name][0](large, str(tmp_path)).write.format("noop").mode("overwrite").save()) < 3_000
