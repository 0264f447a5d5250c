import datetime

import duckdb
from pyspark.sql import functions as F

from intentloom import corpus, queries

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_returnflag string",
    "events": "event_id bigint, user_id bigint, event_type string",
}


def rows_of(orders: int) -> dict[str, list[tuple]]:
    """Sales with repeated and unknown keys, a nation without a region and brands that have the same name."""
    day, some = datetime.datetime(2020, 1, 1), lambda i: i * 7919 % 104729
    out = {
        "region": [(0, "a"), (1, "b")],
        "nation": [(0, "x", 0), (1, "y", 1), (2, "z", None)],
        "customer": [(c, c % 3, -1.0) for c in range(40)] + [(3, 0, 1.0), (4, 2, 1.0), (None, 1, 0.0), (99, None, 0.0)],
        "supplier": [(s, s % 3) for s in range(9)] + [(2, 2)],
        "part": [(p, f"Brand{'#' * (p % 2)}{p // 2 % 5}") for p in range(30)] + [(3, "Brand#9")],
        "orders": [(o, some(o) % 45, day + datetime.timedelta(days=some(o) % 90), ("1-URGENT", "2-HIGH")[o % 2]) for o in range(orders)] + [(None, 1, day, "2-HIGH")],
        "events": [(e, some(e) % 45, f"t{e % 3}") for e in range(200)] + [(900, None, "t1")],
    }
    out["lineitem"] = [(i // 4, some(i) % 32, some(i) % 10, float(45 + i % 6), 0.08, "RAN"[i // 6 % 3]) for i in range(orders * 4)] + [(None, 1, 1, 50.0, 0.1, "R"), (1, None, 1, 50.0, 0.1, None)]
    return out


def saved(spark, folder, orders: int) -> corpus.Tables:
    for name, rows in rows_of(orders).items():
        spark.createDataFrame(rows, TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return corpus.Tables(spark, str(folder))


def test_edges_against_sql(spark, tmp_path):
    t = saved(spark, tmp_path, 300)
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = db.execute(f"{queries._WITH} SELECT src, dst, kind, layer FROM edges").fetchall()
    got = [tuple(r) for r in corpus.edges(t).select("src", "dst", "kind", "layer").collect()]
    assert sorted(got) == sorted(want) and {k for _, _, k, _ in want} == {"Affects", "Reads", "Calls", "Triggers", "DependsOn", "Emits", "Handles"}
    some = corpus.edges(t).filter("kind IN ('DependsOn', 'Emits')").select("src", "dst", "kind", "layer")
    assert sorted(tuple(r) for r in some.collect()) == sorted(w for w in want if w[2] in ("DependsOn", "Emits"))


def test_rows_of_a_task_stay_the_same_as_tables_grow(spark, tmp_path, monkeypatch):
    """Four times the orders: four times the tasks, though there are few bytes and a setting of four partitions."""
    monkeypatch.setattr(corpus, "ROWS", 100, raising=False)
    for k, orders in enumerate((300, 1200)):
        t = saved(spark, tmp_path / str(k), orders)
        for kinds, tasks in (("'Affects', 'Reads'", orders * 4 // 100), ("'Calls'", orders // 100)):
            df = corpus.edges(t).filter(f"kind IN ({kinds})")
            assert df.withColumn("p", F.spark_partition_id()).agg(F.max("p")).first()[0] + 1 > tasks / 2
