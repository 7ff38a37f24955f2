import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import predicates as P
from foliospark.functions import scores as S
from foliospark.functions.portable import SPARK
from foliospark.operators import grouping as G
from foliospark.operators import layout as L
from foliospark.operators import similarity as M
from foliospark.sources import tables as T
from foliospark.streaming import events as E


def _apply(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in rows.select("i", F.expr(fn(SPARK, "text")).alias("v")).orderBy("i").collect()]


def test_skip_content(spark):
    texts = ["All rights reserved", "Copyright 2020 X", "page 12", "42", "xiv", "def f(x): pass", "# note", "ab", "12 34 !! a", "A plain sentence of words."]
    assert _apply(spark, P.skip_content, texts) == [True] * 9 + [False]


def test_page_numbers_and_artifacts(spark):
    assert _apply(spark, P.page_number, ["7", "Page 3", "p. 4", "3 of 9", "- 5 -", "chapter"]) == [True] * 5 + [False]
    assert _apply(spark, P.processing_artifact, ["[missing_page]", r"\begin{x}", "text"]) == [True, True, False]


def test_captions_and_headings(spark):
    assert _apply(spark, P.likely_caption, ["Figure 3: A map", "(a) left part", "Diagram showing flow", "It was a long day and we went home again. Then nothing happened. The end of this story."]) == [True, True, True, False]
    assert _apply(spark, P.likely_heading, ["Introduction", "Related Work Items", "this is only a normal text line without end of words"]) == [True, True, False]


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "page long, seq long, x0 double, y0 double, x1 double, y1 double, confidence double, label string")


def test_reading_order_by_bands(spark):
    rows = [(1, 0, 300.0, 101.0, 400.0, 121.0, 0.5, "text"), (1, 1, 10.0, 104.0, 90.0, 124.0, 0.5, "text"), (1, 2, 10.0, 10.0, 90.0, 30.0, 0.5, "text"), (1, 3, 10.0, 300.0, 90.0, 320.0, 0.5, "text")]
    got = [r.seq for r in L.reading_order(_boxes(spark, rows)).orderBy("position").collect()]
    assert got == [2, 1, 0, 3]


def test_suppression_is_maximal_and_apart(spark):
    rng = random.Random(3)
    rows = []
    for page in range(6):
        for seq in range(14):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            rows.append((page, seq, x, y, x + rng.uniform(5, 40), y + rng.uniform(5, 40), rng.random(), "text"))
    kept = {(r.page, r.seq) for r in L.suppress(_boxes(spark, rows)).collect()}

    def clash(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return max(0, w) * max(0, h) >= 0.5 * min((a[4] - a[2]) * (a[5] - a[3]), (b[4] - b[2]) * (b[5] - b[3]))

    want = set()
    for page in range(6):
        chosen = []
        for row in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[6], r[1])):
            if not any(clash(row, c) for c in chosen):
                chosen.append(row)
        want |= {(r[0], r[1]) for r in chosen}
    assert kept == want


def test_smart_groups_equal_a_plain_fold(spark, sf_dir):
    lines = T.lines(T.read(spark, sf_dir, "documents"))
    got = {(r.doc_id, r.seq): r.group_id for r in G.smart_groups(lines, 8, 900).collect()}
    last, want = None, {}
    for r in lines.orderBy("doc_id", "seq").collect():
        if r.doc_id != last:
            group, count, size, page, kind = 0, 0, 0, None, None
        early = r.page_num <= 10
        heads = ("h1", "h2", "h3")
        turn = (kind in ("image", "table") or r.block_type in ("image", "table")) if early else (kind in heads and r.block_type not in heads)
        cut = count > 0 and (count >= 8 or size + len(r.text) > (1350 if early else 900) or turn or (count > (5 if early else 3) and page != r.page_num))
        if cut:
            group, count, size = group + 1, 0, 0
        count, size, page, kind, last = count + 1, size + len(r.text) + 18, r.page_num, r.block_type, r.doc_id
        want[r.doc_id, r.seq] = group
    assert got == want


def test_sentence_chunks_equal_a_loop(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").where("text is not null")
    got = {}
    for r in G.sentence_chunks(docs, F.expr(S.sentences(SPARK, "text")), 700).collect():
        got.setdefault(r.doc_id, {})[r.chunk] = r.size
    for r in docs.collect():
        sizes, count, size, tail = [], 0, 0, ""
        for s in [x for x in re.split("\x01", re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\x01", r.text)) if x]:
            if count and size + len(s) > 700:
                sizes.append(size)
                count, size = 2, len(tail) + len(s)
            else:
                count, size = count + 1, size + len(s)
            tail = s
        if count:
            sizes.append(size)
        assert list(dict(sorted(got.get(r.doc_id, {}).items())).values()) == sizes


def test_fuzzy_lookup_equals_a_loop(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(5, 60))) for _ in range(40)]
    noisy = [b[: rng.randint(3, len(b))] + rng.choice(["", "x", "yy"]) for b in base]
    q = spark.createDataFrame(list(enumerate(noisy)), "key long, text string").withColumn("lang", F.lit("en"))
    c = spark.createDataFrame(list(enumerate(base)), "cache_key long, text string").withColumn("lang", F.lit("en"))
    got = {r.key: round(r.ratio, 9) for r in M.fuzzy_lookup(q, c).collect()}
    want = {i: round(max(M.ratio(n, b) for b in base), 9) for i, n in enumerate(noisy) if max(M.ratio(n, b) for b in base) >= 0.85}
    assert got == want


def test_containment_beyond_the_broadcast_limit(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    parts = T.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("part"))
    key = lambda f: sorted((r.doc_id, r.item_id) for r in f.distinct().collect())
    want = key(M.containing(docs, parts, "part"))
    assert want and key(M.containing(docs, parts, "part", limit=0)) == want


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_filename_is_safe(text):
    import duckdb

    from foliospark.functions.portable import CHECK

    made = duckdb.connect().execute(f"select {S.safe_filename(CHECK, 'x')} from (select ?::varchar as x)", [text.replace("\x00", "")]).fetchone()[0]
    assert not re.search(r'[<>:"/\\|?*]', made) and len(made) <= 100


def test_json_sources(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{"k1": "hola", "k2": {"original_text": "a", "translated_text": "b", "target_language": "es", "model_name": "m", "usage_count": 3}}')
    rows = {r.cache_key: (r.translated_text, r.target_language, r.usage_count) for r in T.read_json_cache(spark, str(tmp_path / "cache.json")).collect()}
    assert rows == {"k1": ("hola", "unknown", 1), "k2": ("b", "es", 3)}
    (tmp_path / "g.json").write_text('{"term": "Begriff"}')
    assert [tuple(r) for r in T.read_glossary(spark, str(tmp_path / "g.json")).collect()] == [("term", "Begriff")]
    (tmp_path / "coco.json").write_text('{"images": [{"id": 1, "file_name": "a", "width": 2, "height": 3}], "annotations": [{"image_id": 1, "category_id": 4, "bbox": [1, 2, 3, 4]}]}')
    images, boxes = T.read_coco(spark, str(tmp_path / "coco.json"))
    assert images.count() == boxes.count() == 1
    (tmp_path / "A.PDF").write_bytes(b"x")
    assert T.scan_files(spark, str(tmp_path)).count() == 1


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    events = T.read(spark, sf_dir, "events")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = E.read_events(spark, str(tmp_path / "events"), 10)
    query = E.request_rate(stream, "1 day", 5, "60 days").writeStream.outputMode("update").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.user_id, r.start): r.requests for r in spark.sql("select * from rates").collect()}
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "user_id").agg(F.count("*").alias("n")).collect()
    assert got == {(r.user_id, r.window.start): r.n for r in batch}
    dead = E.quarantine(E.read_events(spark, str(tmp_path / "events"), 10), str(tmp_path / "dead"), str(tmp_path / "cp")).start()
    dead.processAllAvailable()
    dead.stop()
    want = {r.user_id for r in events.where("event_type = 'error'").groupBy("user_id").count().where("count >= 3").collect()}
    assert {r.user_id for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == want
