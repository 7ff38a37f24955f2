import os

import corpus_pipeline as pipeline


def test_run_leaves_the_last_stage_alone(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))] and sum(n for _, n in items) <= 2048
    folder = os.path.dirname(out.inputFiles()[0]).removeprefix("file:")
    assert os.path.basename(folder) == "4-best_fit_packing" and os.listdir(os.path.dirname(folder)) == ["4-best_fit_packing"]
