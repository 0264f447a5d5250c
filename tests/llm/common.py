"""Small tables with what is awkward: nulls, empty and long texts, copies, ties, clashing column names."""

import random

import duckdb
import pyarrow as pa

#: names that the operators use themselves
CLASHING = "host__ removed__ kept__ bucket key doc tile kind part offset words df group_id page piece score row".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeiouklmnrst", k=rng.randint(2, 8))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    long = prose(1, 30_000)
    shared = prose(2, 80)
    near = prose(3, 200).split()
    texts = [None, "", " \n\t", "one", long, long, f"{prose(4, 30)} {shared} {prose(5, 40)}", f"{shared}\n{prose(6, 20)}", " ".join(near), " ".join(near[:190] + ["x"] * 10), "ÀÉ Ünï ß 你好 " + prose(7, 70), "x" * 5000, shared, shared]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, shared, None, None, None), (None, None, None, None, None), (8, prose(8, 60), "en", "s1", None)]
    rows += [(100 + i, f"menu home about\n{prose(100 + i, 60)}\nfooter {i} of 2024", "en", "hot", None) for i in range(12)]
    rows += [(200, "menu home about\nx", "en", "hot", 17), (201, "menu home about", "en", "hot", 15)]
    return rows


def awkward(spark, extra: bool = True):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    for c in CLASHING if extra else ():
        df = df.selectExpr("*", f"'{c}' AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def oracle(sql: str, rows: list[tuple]) -> list[tuple]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    documents = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})
    with duckdb.connect() as db:
        db.register("documents", documents)
        cursor = db.execute(sql)
        columns = [c[0] for c in cursor.description]
        return sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cursor.fetchall()), key=str)


def collected(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
