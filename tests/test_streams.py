"""The change source, debouncing, errors on show, and watching."""

import os
import time

from pyspark.sql import functions as F

from graphloom.sources import store
from graphloom.streaming import source, watch


def test_differences_of_listings(tmp_path):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src/a.ts").write_text("a")
    (root / "node_modules/b.ts").write_text("b")
    one = source.listing(str(root))
    assert set(one) == {"src/a.ts"}
    (root / "src/a.ts").write_text("ab")
    (root / "c.ts").write_text("c")
    two = source.listing(str(root))
    assert source.difference(one, two) == [("c.ts", "added"), ("src/a.ts", "modified")]
    (root / "src/a.ts").unlink()
    assert source.difference(two, source.listing(str(root))) == [("src/a.ts", "deleted")]
    assert source.difference({}, {}) == []


def test_a_changed_a_deleted_and_a_returned_file_are_events(spark, tmp_path):
    root, seen = tmp_path / "r", []
    root.mkdir()
    (root / "a.ts").write_text("1")
    (root / "d.ts").write_text("1")
    collect = lambda df, _: seen.append(sorted((r["path"], r["change"]) for r in df.collect()))

    def start():
        return source.change_events(spark, str(root), str(tmp_path / "state")).writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "cp")).start()

    query = start()
    query.processAllAvailable()
    assert seen.pop() == [("a.ts", "added"), ("d.ts", "added")] and not seen
    (root / "a.ts").write_text("22")
    query.processAllAvailable()
    assert seen.pop() == [("a.ts", "modified")]
    (root / "d.ts").unlink()
    query.processAllAvailable()
    assert seen.pop() == [("d.ts", "deleted")]
    query.stop()
    # what happens between two runs is seen by the next
    (root / "d.ts").write_text("again")
    query = start()
    query.processAllAvailable()
    query.stop()
    assert seen == [[("d.ts", "added")]]
    assert len(os.listdir(tmp_path / "state")) <= 2


def test_errors_repeat_the_one_last_shown(spark, tmp_path):
    rows = [("s", "open", "no", float(t)) for t in (0, 2, 4)] + [("u", "a", "x", 0.0), ("u", "b", "x", 1.0), ("u", "a", "x", 2.0), ("u", "a", "x", 2.5), (None, None, None, 0.0), (None, None, None, 1.0)]
    schema = "session string, operation string, message string, at double"
    want = {("s", 0.0), ("s", 4.0), ("u", 0.0), ("u", 1.0), ("u", 2.0), (None, 0.0)}
    errors = spark.createDataFrame(rows, schema)
    assert {(r["session"], r["at"]) for r in watch.fresh_errors(errors).collect()} == want
    assert watch.fresh_errors(errors.limit(0)).count() == 0
    errors.where("session is not null").coalesce(1).write.parquet(str(tmp_path / "in"))
    shown = []
    query = watch.fresh_errors(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, _: shown.extend((r["session"], r["at"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    # the state lives on between batches: 6 is within the window of 4, which was shown
    spark.createDataFrame([("s", "open", "no", 6.0), ("s", "open", "no", 7.5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert set(shown) == {w for w in want if w[0]} | {("s", 7.5)}


def test_bursts_by_event_time(spark):
    times = spark.createDataFrame([("src/a.ts", 0), ("src/b.ts", 100), ("node_modules/x.ts", 150), ("src/a.ts", 900)], "path string, ms long").select("path", F.timestamp_millis("ms").alias("ts"))
    assert sorted(r["n"] for r in watch.bursts(watch.relevant(times)).collect()) == [1, 2]


def test_each_change_of_a_repository_is_one_sync(spark, tmp_path):
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "package.json").write_text("{}")
    (root / "src/a.ts").write_text("export const a = 1;\n")
    (root / "src/d.ts").write_text("export const d = 1;\n")
    results, index = [], str(tmp_path / "index")
    query = watch.watch(spark, str(root), index, results.append, str(tmp_path / "cp"), "1 second")

    def after(n):
        until = time.time() + 240
        while len(results) < n and time.time() < until and query.isActive:
            time.sleep(0.3)
        assert len(results) == n, query.exception()
        return results[-1]

    try:
        assert after(1)["filesAdded"] == 3
        (root / "src/a.ts").write_text("export const a = 22;\n")
        assert after(2)["filesModified"] == 1
        (root / "src/d.ts").unlink()
        assert after(3)["filesDeleted"] == 1
    finally:
        query.stop()
    assert store.manifest_of(spark, index)["scannedFileCount"] == 2
