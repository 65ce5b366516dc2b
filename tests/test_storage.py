import os

from kinsift import storage


def test_tables_come_back(spark):
    frame = spark.range(5)
    table = storage.materialize(frame, "t")
    assert sorted(r.id for r in table.collect()) == list(range(5)) and table.dtypes == frame.dtypes
    empty = storage.materialize(frame.limit(0), "t")
    assert empty.count() == 0 and empty.dtypes == frame.dtypes
    path = storage.local_path(table._kinsift_path)
    assert path is None or os.path.isdir(path)
    storage.discard(table)
    storage.discard(frame)  # was never written
    assert path is None or not os.path.exists(path)


def test_clean_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}/app")
    assert storage.materialize(spark.range(1)).count() == 1 and os.listdir(tmp_path) == ["app"]
    storage.clean_up(spark)
    assert not os.listdir(tmp_path)


def test_no_process_for_modes_of_checksum_files(spark):
    table = storage.materialize(spark.range(20, numPartitions=3), "t")
    path = storage.local_path(table._kinsift_path)
    assert path is None or not [f for f in os.listdir(path) if f.endswith(".crc")]
    assert table.count() == 20
    storage.discard(table)


def test_local_paths():
    assert storage.local_path("file:///a/b") == storage.local_path("file:/a/b") == storage.local_path("/a/b") == "/a/b"
    assert storage.local_path("hdfs://h/a") is None
