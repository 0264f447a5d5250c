import pytest

from intentloom.llm import scratch, sharding
from intentloom.llm.sharding import Shard, Store

from .common import SCHEMA


def numbered(spark, a, b, parts=1):
    return spark.range(a, b, 1, parts).selectExpr("id", "nullif(repeat(cast(id AS string), 50), '') AS text")


def store(spark, **kw):
    return Store(spark, scratch.new_path(spark, "test"), **kw)


def test_append_compact_read_versions(spark):
    s = store(spark, target=1 << 20, fan_in=3)
    for i in range(7):
        s.append(numbered(spark, i * 100, i * 100 + 100))
    before = s.manifest()
    assert before.version == 7 and len(before.shards) == 7
    after = s.compact()
    assert after.version > 7 and len(after.shards) < 3 and sum(x.rows for x in after.shards) == 700
    assert sorted(r[0] for r in s.read().collect()) == list(range(700))
    assert sorted(r[0] for r in s.read(3).collect()) == list(range(300))
    assert s.vacuum() > 0 and s.read().count() == 700 and s.manifest(3) is None
    assert s.compact().version == after.version


def test_merged_files_reach_target(spark):
    s = store(spark, target=60_000, fan_in=2)
    s.append(spark.range(0, 20_000, 1, 16).selectExpr("id", "sha2(cast(id AS string), 256) AS text"))
    sizes = [x.size for x in s.compact().shards]
    assert s.read().distinct().count() == 20_000
    assert sum(2 * x < 60_000 for x in sizes) < 2


def test_lost_race_is_retried_and_conflicting_merge_refused(spark):
    s = store(spark)
    s.append(numbered(spark, 0, 10))
    stale = s.manifest()
    s.append(numbered(spark, 10, 20))
    assert not s._publish(type(stale)(stale.version + 1, stale.schema, ()))
    assert s.read().count() == 20
    with pytest.raises(RuntimeError):
        s._commit(stale.schema, [], {"shards/none.parquet"})
    assert s._commit(stale.schema, [Shard("shards/x.parquet", 1, 1)]).version == 3


def test_schema_is_checked_and_empty_store(spark):
    s = store(spark)
    with pytest.raises(ValueError):
        s.read()
    assert s.compact() is None
    s.append(spark.createDataFrame([], SCHEMA))
    assert s.read().count() == 0 and s.read().columns[0] == "doc_id"
    with pytest.raises(ValueError):
        s.append(numbered(spark, 0, 1))
    with pytest.raises(ValueError):
        store(spark, fan_in=1)


def test_two_writers_at_once(spark):
    """Each commit takes in what the other has committed."""
    from threading import Thread

    s, wrong = store(spark), []

    def write(first):
        try:
            for i in range(4):
                Store(spark, s.path).append(numbered(spark, first + 10 * i, first + 10 * i + 10))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [Thread(target=write, args=(k,)) for k in (0, 1000)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and s.manifest().version == 8 and s.read().distinct().count() == 80


def test_arrivals_are_merged(spark, tmp_path):
    numbered(spark, 0, 3000, 12).write.parquet(str(tmp_path / "in"))
    out = sharding.shard(spark.read.parquet(str(tmp_path / "in")), target=1 << 20, small=4000, arrival=3)
    assert sorted(r[0] for r in out.collect()) == list(range(3000)) and len(out.inputFiles()) < 6


def test_tier_that_cannot_shrink_does_not_end_compaction(spark, monkeypatch):
    s = store(spark, target=30_000, fan_in=2)
    monkeypatch.setattr(sharding, "LEAST", 1000)
    for i in range(2):
        s.append(spark.range(i * 150, i * 150 + 150, 1, 1).selectExpr("id", "nullif(sha2(cast(id AS string), 512), '') AS text"))
    for i in range(4):
        s.append(numbered(spark, 1000 + i, 1001 + i))
    sizes = sorted(x.size for x in s.manifest().shards)
    assert len(s.compact().shards) < len(sizes) and s.read().count() == 304
    assert s.vacuum() > 0 and s.read().count() == 304
