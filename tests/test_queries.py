import pytest

from foliospark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, check):
    check(catalog.QUERIES[name], catalog.SQL.get(name))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_conversations_are_merged(spark, sf_dir):
    got = catalog.QUERIES["u01_merge_pairs"](spark, sf_dir).collect()
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = []
    for conv, mine in turns.items():
        shift = max((t for t, _ in turns.get(conv - 1, [])), default=-1) + 1 if conv % 2 else 0
        want += [(conv // 2, t + shift, text) for t, text in mine]
    assert sorted((r.pair, r.turn, r.text) for r in got) == sorted(want)
