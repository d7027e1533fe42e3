"""A scan above last ids opens only files that can hold something."""

from tidewire.operators import zones

FEED = "channel string, message_id bigint, text string"


def test_files_below_the_last_ids_are_not_opened(frame, spark, tmp_path):
    path = str(tmp_path / "feed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for low in (0, 1000):
            zones.write_clustered(frame([(f"@{c}", low + k, "x") for c in "abc" for k in range(200)], FEED), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = spark.read.parquet(path).inputFiles()
    last = frame([("@a", 1199), ("@b", 1150), ("@c", 1199), ("@c", 3)], "channel string, last_id bigint")
    opened = zones.files_above(spark, path, last)
    tops = zones.read_zones(spark, path).filter("channel = '@b' and top > 1150").select("file").distinct().collect()
    assert len(every) == 8 and sorted(opened) == sorted(r.file for r in tops) and 0 < len(opened) < 3
    got = zones.read_above(spark, path, last)
    assert {f.rpartition("/")[2] for f in got.inputFiles()} == set(opened)
    assert sorted(r.message_id for r in got.collect()) == list(range(1151, 1200))
    assert zones.read_above(spark, path, last.filter("channel != '@b'")).count() == 400  # a channel without last id is read whole
    all_read = frame([(f"@{c}", 5000) for c in "abc"], "channel string, last_id bigint")
    assert zones.files_above(spark, path, all_read) == [] and zones.read_above(spark, path, all_read).count() == 0


def test_files_without_zones_are_opened(frame, spark, tmp_path):
    path = str(tmp_path / "feed")
    zones.write_clustered(frame([("@a", 1, "x")], FEED), path)
    frame([("@a", 2, "x"), (None, 9, "x")], FEED).coalesce(1).write.mode("append").parquet(path)
    last = frame([("@a", 1)], "channel string, last_id bigint")
    assert sorted(r.message_id for r in zones.read_above(spark, path, last).collect()) == [2, 9]
    zones.update_zones(spark, path)
    assert len(zones.files_above(spark, path, last)) == 1 and zones._without_zones(spark, path) == []
    assert sorted(r.message_id for r in zones.read_above(spark, path, last).collect()) == [2, 9]
