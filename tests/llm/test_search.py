"""Operator 6 and the pipeline."""

import math
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from blockloom.llm import ball_tree as B

KIND = "vec_id bigint, embedding array<float>"


def brute(rows, k=10, every=100):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(math.floor(1024 * float(np.float32(x))) for x in v))
    out = []
    for q in good:
        if q % every == 0:
            own = min(good[q])
            found = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, vs in good.items() if i != q for v in vs if len(v) == len(own))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 10_000])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(B, "SHARD_ROWS", shard)
    monkeypatch.setattr(B, "QUERY_ROWS", 2)
    monkeypatch.setattr(B, "SAMPLE", 100)
    monkeypatch.setattr(B, "LEAF", 8)
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(400)] + [(500 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(700, None), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1100, []), (1200, [2.0, 3.0]), (1300, [1.0, 1.0]), (1301, [5.0, 5.0])]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as shard", "2 as dim", "3 as score")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in B.top_k(df).collect()) == brute(rows)
    assert B.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], KIND)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in B.top_k(few).collect()) == brute(rows[:4])


def test_large_components(spark):
    """Products beyond doubles and beyond 64 bits inside, exact or an error and never wrong."""
    big = [(100, [3e9, 1.0, 0.5]), (1, [2000.0, 7.0, 3.0]), (2, [2000.0, 7.0, 4.0]), (3, [-500.0, 1.0, 1.0]), (200, [1.5, 2.5, 1e5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in B.top_k(spark.createDataFrame(big, KIND)).collect()) == brute(big)
    a, b = np.array([[2**40, 2**40]]), np.array([[2**40, 3 - 2**40], [5, -7]])
    assert B._products(a, b, np.array([[False, False]])).tolist() == [[3 * 2**40, -(2**41)]]
    assert B._products(a, a, np.array([[True]])).tolist() == [[B.NO_SCORE]]
    with pytest.raises(OverflowError):
        B._products(a, a, np.array([[False]]))
    with pytest.raises(Exception, match="too large"):
        B.top_k(spark.createDataFrame([(100, [1e30]), (1, [1.0])], KIND)).collect()


def test_tree_bounds_hold():
    rnd = np.random.default_rng(2)
    v = rnd.integers(-500, 500, (1000, 8))
    order, nodes, centres, radii = B.build(v)
    assert sorted(order.tolist()) == list(range(1000))
    q = rnd.integers(-500, 500, 8)
    for (lo, hi, _, _), c, r in zip(nodes.tolist(), centres, radii, strict=True):
        assert (v[order[lo:hi]] @ q).max() <= q @ c + np.sqrt((q * q).sum()) * r + 1e-6


def simhash_brute(t):
    w = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, _key string")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and out.columns == none.columns
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on its own input, then all together."""
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("äoux") + str(rnd.randrange(500))
    rows, labels = [], []
    for i in range(300):
        t = [word() for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            t[3] = "zorkface"
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(400, rows[1][1].replace(" ", "  ", 3), "en", "s", 1), (401, "mail to me 4041894974608795 now", "en", "s", 1), (402, None, None, None, None), (403, "", "en", "s", 0)]
    base = rows[2][1]
    rows += [(410, base + " extra", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "pseudonyms", "packing"]
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    assert len(ids & set(range(0, 300, 6))) <= 2 and {i for i in range(300) if i % 6} <= ids and {402, 403} <= ids
    single = stages["exact_dedup"](spark, docs, str(tmp_path))
    assert {r[0] for r in rows} - {r.doc_id for r in single.collect()} == {400, 403}
    near = stages["near_dedup"](spark, docs, str(tmp_path))
    left = {r.doc_id for r in near.collect()}
    assert 400 not in left and 1 in left and near.columns == docs.columns
    private = {r.doc_id: r for r in stages["pseudonyms"](spark, docs, str(tmp_path)).collect()}
    assert "4041894974608795" not in private[401].text and private[1].text == rows[1][1] and len(private) == len(rows)
    packed = pipeline.run(spark, str(tmp_path)).collect()
    # all stages behind the classifier against brute force
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    from blockloom.llm.pseudonyms import pseudonymise

    stay = {}
    for i, t in sorted((r.doc_id, r.text or "") for r in clean.collect()):
        stay.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    left_ids = sorted(stay.values())
    prints = {i: simhash_brute(t) for i, t in left_ids}
    root = {i: i for i in prints}
    for _ in prints:
        root = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    want = {i for i in prints if root[i] == i}
    texts = {r.doc_id: r.text or "" for r in pseudonymise(docs).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in packed} == want
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(lib.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want}
    assert {401, 402} <= {r.doc_id for r in packed} and 400 not in {r.doc_id for r in packed}
