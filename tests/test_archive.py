import bz2
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from blockloom.functions import columns as C
from blockloom.functions import kernels as K
from blockloom.operators import archive as A
from blockloom.operators import relational as R
from blockloom.operators import stats
from blockloom.sources import strict as source


@pytest.fixture(scope="module")
def raw():
    return {"big": random.Random(4).randbytes(300_000), "empty": b"", "text": b"hello " * 200}


@pytest.fixture(scope="module")
def packed(spark, raw):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "path string, content binary")
    return {r.path: bytes(r.content) for r in A.encode(df, level=1).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, content binary")


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.seq):
        if r.bytes is not None:
            out[r.path] = out.get(r.path, b"") + bytes(r.bytes)
    return out


def test_encoding_does_not_depend_on_tasks(spark, raw, packed):
    for k, v in raw.items():
        assert bz2.decompress(packed[k]) == v and packed[k] == K.compress(v, 1)


@pytest.mark.parametrize(("concurrency", "whole"), [(1, 0), (3, 0), (3, 1 << 18)])
def test_decode(spark, raw, packed, concurrency, whole):
    bad = bytearray(packed["big"])
    bad[-500] ^= 4
    every = {**packed, "bad": bytes(bad), "two": packed["text"] + packed["big"]}
    rows = A.decode(frame(spark, every), concurrency=concurrency, whole_below=whole).collect()
    out = joined(rows)
    assert out["big"] == raw["big"] and out["text"] == raw["text"] and out["two"] == raw["text"] + raw["big"]
    assert [(r.path, r.error.code) for r in rows if r.error] == [("bad", "BLOCK_CRC_MISMATCH")]
    assert raw["big"].startswith(out["bad"])


def test_false_markers_are_mended(spark, raw, packed):
    fake = spark.createDataFrame([("big", 8 * 3000 + 5, "block"), ("big", 8 * (len(packed["big"]) - 40) + 1, "end")], "key string, bit bigint, kind string")
    assert joined(A.decode(frame(spark, {"big": packed["big"]}), concurrency=3, fake_markers=fake, whole_below=0).collect())["big"] == raw["big"]


def test_regular_archives(packed):
    good = packed["big"]
    found = K.markers(good)
    assert A.regular(good, found) and A.regular(packed["empty"], K.markers(packed["empty"]))
    flip = lambda at: good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    for bad in (good + b"x", good[:-1], good * 2, flip(0), flip(10), b"", b"BZh9"):
        assert not A.regular(bad, K.markers(bad))
    assert not A.regular(good, sorted([*found, (8 * 3000 + 5, "block")]))


def test_defects_in_parallel_and_in_sequence(spark, packed):
    """Wherever a bit is flipped, the parallel reader gives what the one in sequence gives."""
    rnd = random.Random(12)
    damaged = {}
    for k in range(24):
        data = bytearray(packed["big"])
        data[rnd.choice([0, 3, 4, 10, 20, len(data) - 3, len(data) - 10, rnd.randrange(len(data))])] ^= 1 << rnd.randrange(8)
        damaged[f"d{k}"] = bytes(data)
    key = lambda rows: sorted((r.path, r.error and (r.error.code, r.error.member, r.error.block, r.error.byte_offset), joined(rows).get(r.path)) for r in rows if r.error)
    a, b = (A.decode(frame(spark, damaged), concurrency=c, whole_below=0).collect() for c in (1, 3))
    assert key(a) == key(b) and len(key(a)) >= 20


def test_validate_modes(spark, packed):
    df = frame(spark, {"good": packed["text"], "bad": packed["text"][:-1]})
    assert {r.path: r.error and r.error.code for r in A.validate(df).collect()} == {"good": None, "bad": "UNEXPECTED_EOF"}
    assert [r.path for r in A.validate(df, "DROPMALFORMED").collect()] == ["good"]
    with pytest.raises(Exception, match="UNEXPECTED_EOF"):
        A.validate(df, "FAILFAST").collect()


def test_sql_names(spark):
    C.register(spark)
    row = spark.sql("SELECT bzip2_crc32(b) AS c, cast(bz2_decompress(bz2_compress(b)) AS string) AS t, bz2_validate(b) AS e FROM (SELECT cast('123456789' AS binary) AS b)").first()
    assert (row.c, row.t, row.e) == (0xFC891918, "123456789", "INVALID_MAGIC")
    spark.createDataFrame([(bytearray(K.compress(b"abc")),)], "c binary").createOrReplaceTempView("a")
    assert spark.sql("SELECT b.raw_len FROM a, LATERAL bz2_blocks(a.c) b WHERE b.block IS NOT NULL").first()[0] == 3


def test_source_reads_whole_and_in_ranges(spark, raw, packed, tmp_path):
    source.register(spark)
    for k, v in packed.items():
        (tmp_path / f"{k}.bz2").write_bytes(v)
    whole = spark.read.format("bz2strict").load(str(tmp_path))
    ranged = spark.read.format("bz2strict").option("splitBytes", 50_000).load(str(tmp_path))
    for df in (whole, ranged):
        rows = sorted(df.where("path like '%big%'").collect(), key=lambda r: r.start_bit)
        assert b"".join(bytes(r.content) for r in rows) == raw["big"]
    (tmp_path / "bad.bz2").write_bytes(packed["text"] + b"xx")
    with pytest.raises(Exception, match="TRAILING_DATA"):
        spark.read.format("bz2strict").load(str(tmp_path / "bad.bz2")).collect()
    assert spark.read.format("bz2strict").option("trailingData", "ignore").load(str(tmp_path / "bad.bz2")).count() == 1


def test_ranges_report_a_defective_block(spark, packed, tmp_path):
    source.register(spark)
    data = bytearray(packed["big"])
    blocks = [bit for bit, kind in K.markers(bytes(data)) if kind == "block"]
    assert len(blocks) > 2
    data[(blocks[1] + blocks[2]) // 16] ^= 0x5A
    (tmp_path / "hurt.bz2").write_bytes(data)
    read = spark.read.format("bz2strict").option("splitBytes", 50_000)
    with pytest.raises(Exception, match="the block at bit"):
        read.load(str(tmp_path / "hurt.bz2")).collect()
    lenient = read.option("mode", "PERMISSIVE").load(str(tmp_path / "hurt.bz2")).collect()
    assert len(lenient) == len(blocks) and [r.start_bit for r in lenient if r.error] == [blocks[1]]
    assert read.option("mode", "DROPMALFORMED").load(str(tmp_path / "hurt.bz2")).count() == len(blocks) - 1


def test_modes_of_whole_files(spark, raw, packed, tmp_path):
    """Of a damaged file: the good blocks and the defect's code, nothing, or an error; by both ways to read."""
    source.register(spark)
    (tmp_path / "a.bz2").write_bytes(packed["big"])
    (tmp_path / "b.bz2").write_bytes(packed["text"] + packed["big"][:-1])
    n = sum(kind == "block" for _, kind in K.markers(packed["big"]))
    ways = [lambda mode: spark.read.format("bz2strict").option("mode", mode).load(str(tmp_path)), lambda mode: source.read(spark, str(tmp_path / "*.bz2"), mode)]
    for way in ways:
        rows = way("PERMISSIVE").collect()
        assert [r.error for r in rows if r.error] == ["UNEXPECTED_EOF"] and len(rows) == 2 * n + 2
        assert {os.path.basename(r.path) for r in way("DROPMALFORMED").collect()} == {"a.bz2"} and way("DROPMALFORMED").count() == n
        with pytest.raises(Exception, match="UNEXPECTED_EOF"):
            way("FAILFAST").collect()
    with pytest.raises(ValueError):
        source.read(spark, str(tmp_path), "LENIENT")


def test_overwrite_replaces_a_folder(spark, raw, tmp_path):
    source.register(spark)
    out = str(tmp_path / "out")
    for text in ("one", "two"):
        rows = spark.createDataFrame([(bytearray(text.encode()),)], "content binary").selectExpr("'' path", "0 member", "0 block", "0L start_bit", "0L crc", "content", "'' error")
        rows.coalesce(1).write.format("bz2strict").mode("overwrite").option("path", out).save()
    assert [bz2.decompress(open(os.path.join(out, f), "rb").read()) for f in os.listdir(out)] == [b"two"] and os.listdir(tmp_path) == ["out"]


def test_sink(spark, raw, tmp_path):
    source.register(spark)
    rows = frame(spark, {"a": raw["text"]}).selectExpr("path", "cast(null as int) member", "cast(null as int) block", "0L start_bit", "0L crc", "content", "cast(null as string) error")
    out = str(tmp_path / "out")
    rows.coalesce(1).write.format("bz2strict").mode("append").option("path", out).save()
    files = [f for f in os.listdir(out) if f.endswith(".bz2")]
    assert bz2.decompress(open(os.path.join(out, files[0]), "rb").read()) == raw["text"]
    with pytest.raises(Exception, match="exists"):
        rows.write.format("bz2strict").mode("append").option("path", out).save()
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]


def test_relational_stages(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "aaaaaaabbb"), (3, "mississippi")], "id int, t string")
    coded = R.bwt(df, "id", "t")
    assert {r.id: (r.last_column, r.origin) for r in coded.collect()}[1] == ("nnbaaa", 3)
    assert {r.id: r.content for r in R.inverse_bwt(coded, "id").collect()} == {1: "banana", 2: "aaaaaaabbb", 3: "mississippi"}
    assert {r.id: r.encoded for r in R.rle1(R.runs(df, "id", "t"), "id").collect()}[2] == "aaaa<3>bbb"
    long = spark.createDataFrame([(1, "z" * 600)], "id int, t string")
    assert sorted(r.length for r in R.runs(long, "id", "t").collect()) == [82, 259, 259]
    for r in R.mtf(df, "id", "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("x")).collect():
        text = {1: "banana", 2: "aaaaaaabbb", 3: "mississippi"}[r.id]
        recent, expected = sorted(set(text)), []
        for c in text:
            expected.append(recent.index(c))
            recent.insert(0, recent.pop(recent.index(c)))
        assert [x.rank for x in r.x] == expected


def test_folds_agree(spark):
    rows = spark.range(200).selectExpr("id % 3 as k", "id as i", "(id * 2654435761) & 4294967295 as crc")
    a = {r.k: r.combined for r in A.crc_fold(rows, ["k"], "i").collect()}
    b = {r.k: r.combined for r in A.crc_fold_xor(rows, ["k"], "i").collect()}
    assert a == b == {k: K.fold([i * 2654435761 & 0xFFFFFFFF for i in range(200) if i % 3 == k]) for k in range(3)}


def test_medians(spark):
    df = spark.createDataFrame([(float(x),) for x in (40, 10, 30, 20)], "x double")
    assert tuple(df.agg(stats.median("x"), stats.upper_median("x")).first()) == (25.0, 30.0)


@pytest.mark.parametrize("few", [0, stats.FEW])
def test_order_statistics_are_those_of_the_whole(spark, monkeypatch, few):
    """Small, tied, null and far apart values, nulls as keys; many groups go another way."""
    monkeypatch.setattr(stats, "FEW", few)
    rnd = random.Random(3)
    made = [(k, rnd.choice([None, 1.5, rnd.gauss(0, 1), rnd.random() * 1e9])) for k in [None, "a", "a", "b", "c"] for _ in range(300)]
    made += [("one", 2.0), ("two", 2.0), ("two", 5.0), ("none", None), ("same", 7.0), ("same", 7.0), ("inf", math.inf), ("inf", -math.inf), ("inf", 3.0)]
    df = spark.createDataFrame(made, "k string, x double")
    points = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = stats.order_statistics(df, ["k"], "x", {**points, "upper": None}).select("k", *points, "upper").collect()
    want = df.groupBy("k").agg(*stats.percentiles("x"), stats.upper_median("x").alias("upper")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_no_task_gathers_a_group_for_its_median(spark):
    plan = stats.summary(spark.range(99).selectExpr("1 as k", "id as a", "id * 1.0D as x", "id as b"), ["k"], "a", "x", "b")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "percentile_disc" not in plan and "_part" in plan


def test_command_line(tmp_path):
    run = lambda *a, **k: subprocess.run([sys.executable, "-m", "blockloom.cli", *a], capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), **k)
    plain, packed, back = tmp_path / "a", tmp_path / "a.bz2", tmp_path / "b"
    plain.write_bytes(b"hello\n" * 50_000)
    assert run("compress", str(plain), "-o", str(packed), "-b", "1", "--concurrency", "2").returncode == 0
    assert run("test", str(packed)).returncode == 0
    assert run("decompress", str(packed), "-o", str(back)).returncode == 0 and back.read_bytes() == plain.read_bytes()
    assert run("decompress", str(packed), "-o", str(back)).returncode == 1
    assert run("decompress", str(packed), "-o", str(back), "-f").returncode == 0
    assert run("decompress", str(packed), "-o", str(packed), "-f").returncode == 2
    assert run("compress", "--no-such").returncode == 2 and run("--version").stdout.startswith(b"blockloom ")
    for extra in (("--backend", "strict"), ("--concurrency", "3"), ()):
        made = run("compress", "-", "-b", "2", *extra, input=plain.read_bytes()).stdout
        assert bz2.decompress(made) == plain.read_bytes()
        assert run("decompress", "-", *extra, input=made * 2).stdout == plain.read_bytes() * 2
        assert run("test", "-", *extra, input=made[:-1]).returncode == 1
    said = run("decompress", "--concurrency", "2", "--max-output-bytes", "9", input=bz2.compress(b"x" * 9))
    assert said.stdout == b"x" * 9 and b"no effect" in said.stderr
    packed.write_bytes(packed.read_bytes()[:-1])
    assert run("test", str(packed)).returncode == 1
    assert run("decompress", input=bz2.compress(b"x")).stdout == b"x"
    assert sorted(os.listdir(tmp_path)) == ["a", "a.bz2", "b"]


def test_trials(spark, tmp_path):
    from blockloom import trials as T

    assert [n for _, n in T.rotated(["a", "b", "c"], 3)] == ["a", "b", "c", "b", "c", "a", "c", "a", "b"]
    text = T.corpus()["text"][:5000]
    assert T.corpus() == T.corpus()
    rows = T.run(spark, {"pack": [*T.CODER, "compress", "-b", "1"], "wrong": [*T.CODER, "decompress"]}, text, rounds=2)
    got = {(r.name, r.round): r for r in rows.collect()}
    assert len(got) == 4 and got["pack", 0].sha256 == got["pack", 1].sha256 and got["pack", 0].output_bytes < 5000 and got["pack", 1].peak_kb > 1000
    assert {r.status for (n, _), r in got.items() if n == "wrong"} == {1}
    assert [(r.name, r.same_sha256) for r in T.summarised(rows).collect()] == [("pack", True)]
    assert T.trial([sys.executable, "-c", "import time; time.sleep(60)"], b"", timeout=1)["status"] < 0
    report = str(tmp_path / "report.json")
    for key, value in (("CPU a", {"x": 1}), ("other", {"x": 2}), ("cpu A", {"x": 3})):
        T.save(report, key, value)
    assert __import__("json").load(open(report)) == {"cpu A": {"x": 3}, "other": {"x": 2}}
