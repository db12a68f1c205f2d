"""Every query with SQL beside it, against DuckDB on the smallest tables."""

import glob
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from blockloom.functions import columns as C
from blockloom.functions import kernels as K
from blockloom.functions import strict
from blockloom.operators import archive as A
from blockloom.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in core.ORACLES:
        assert got
        return
    want = duck.execute(core.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_member_headers_reads_every_part(spark, duck):
    rows = core.QUERIES["member_headers"](spark, FOLDER).select("p_partkey", "level").collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM part").fetchone()[0]
    assert {r.level for r in rows} == set(range(1, 10)) and all(r.level == 1 + r.p_partkey % 9 for r in rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, blanks and keys that are null or come twice, and DuckDB over them."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").limit(4)
    extra = [(1, "again"), (1, None), (2, ""), (2, ""), (900, None), (901, ""), (None, "no id"), (None, None), (None, ""), (902, "long " * 30_000), (903, "long é" * 60_000)]
    langs = ["en", None, "", "xx"]
    docs.union(spark.createDataFrame([(i, t, langs[k % 4]) for k, (i, t) in enumerate(extra)], docs.schema)).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    names = [(1, "Customer#1"), (1, "Customer#2"), (2, None), (None, "no key"), (3, "é" * 300), (4, "x" * 700)]
    spark.createDataFrame(names, "c_custkey bigint, c_name string").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    c = duckdb.connect()
    for table in ("documents", "customer"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return folder, c


@pytest.mark.parametrize("name", ["block_inventory", "parallel_decode_by_lang", "parallel_encode_decode", "roundtrip_documents"])
def test_query_on_odd_rows(spark, odd, name):
    folder, duck = odd
    df = core.QUERIES[name](spark, folder)
    want = duck.execute(core.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_strict_encoder_keeps_every_name(spark, odd):
    """All but the checksum, for which SQL takes a letter for a byte."""
    folder, duck = odd
    got = core.QUERIES["strict_encoder_names"](spark, folder)
    want = duck.execute("SELECT c_custkey, c_name AS name, 1::BIGINT AS blocks FROM customer")
    assert rows(["c_custkey", "name", "blocks"], got.drop("crc").collect()) == rows([d[0] for d in want.description], want.fetchall())
    assert {r.name: r.crc for r in got.collect()} == {n: K.crc32(n.encode()) if n else 0 for n, in duck.execute("SELECT c_name FROM customer").fetchall()}


@pytest.mark.parametrize("name", ["strict_encoder_names", "member_headers"])
def test_a_small_file_is_dealt_out(spark, name):
    assert core.QUERIES[name](spark, FOLDER).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_level_may_be_a_column(spark):
    df = spark.createDataFrame([("hello", 1), ("hello", 9), (None, 2), ("", 3), ("hello", None)], "t string, n int")
    got = [r.p and bytes(r.p) for r in df.select(C.bz2_compress("t", df.n).alias("p")).collect()]
    assert got == [K.compress(b"hello", 1), K.compress(b"hello", 9), None, K.compress(b"", 3), None]


@pytest.mark.parametrize("name", ["roundtrip_documents", "roundtrip_pages", "roundtrip_conversations"])
def test_round_trips_take_one_python_worker_a_task(spark, name):
    plan = core.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("most", [1, 500, 1 << 20])
def test_per_row_in_pieces_of_any_size(spark, most):
    df = spark.createDataFrame([(i % 3, None if i % 7 == 0 else "x" * (i % 50)) for i in range(300)], "k int, t string")
    got = A.per_row(df, "t", lambda v: (None if v is None else len(v),), {"n": "bigint"}, most)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.selectExpr("k", "cast(length(t) as bigint) n").collect()))


@pytest.mark.parametrize("part", [7, 1000, 1 << 22])
def test_members_of_joined_values(spark, tmp_path, part):
    """Whatever the parts' size and the number of tasks, the members are those of the whole text and one archive."""
    made = [(k, i, None if i % 5 == 0 else f"{k}{i}é" * (i % 9)) for k in ("a", "b:c", "") for i in range(40)]
    want = {k: "\n".join(t or "" for j, _, t in made if j == k).encode() for k in ("a", "b:c", "")}
    df = spark.createDataFrame(made[::-1], "k string, i int, t string").repartition(3)
    got: dict[str, list] = {}
    for r in sorted(A.encode_joined(df, "k", ["i"], "t", f"file://{tmp_path}/joined", level=1, part=part).collect(), key=lambda r: r.part):
        got.setdefault(r.k, []).append(bytes(r.content))
    assert got == {k: [K.compress(v[i : i + part], 1) for i in range(0, len(v), part)] for k, v in want.items()}
    assert {k: strict.decompress(b"".join(v)) for k, v in got.items()} == want
    rows_ = [(k, i, bytearray(v[i : i + part]), None) for k, v in want.items() for i in range(0, len(v), part)] + [("a", 10**6, None, "bad")]
    sums = A.digests(spark.createDataFrame(rows_, "k string, i int, bytes binary, error string"), ["k"], ["i"]).collect()
    assert {r.k: (r.digest, r.n_bytes, r.defects) for r in sums} == {k: (hashlib.md5(v).hexdigest(), len(v), int(k == "a")) for k, v in want.items()}
