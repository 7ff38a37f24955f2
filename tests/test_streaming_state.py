import datetime

from foliospark.streaming import events as E


def test_cache_with_ttl_hits_and_expires(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(5)), ("b", at(6)), ("a", at(9)), ("a", at(10)), ("b", at(17)), ("a", at(19)), ("a", at(25))]
    spark.createDataFrame(rows, "word string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("word string, ts timestamp").parquet(str(tmp_path / "in"))
    query = E.cache_with_ttl(stream, "word", 10).writeStream.format("memory").queryName("ttl_cache").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.word, r.ts.second, r.hit) for r in spark.table("ttl_cache").collect())
    assert got == [("a", 0, False), ("a", 5, True), ("a", 9, True), ("a", 10, False), ("a", 19, True), ("a", 25, False), ("b", 6, False), ("b", 17, False)]


def test_new_files_are_streamed(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("one.pdf", "two.PDF", "three.txt"):
        (folder / name).write_bytes(name.encode())
    query = E.new_files(spark, str(folder)).selectExpr("length", "cast(content as string) as text").writeStream.format("memory").queryName("new_files").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.text for r in spark.table("new_files").collect()) == ["one.pdf", "two.PDF"]
