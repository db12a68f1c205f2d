"""Operators 2, 3, 9 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from blockloom.llm import exact_dedup as E
from blockloom.llm import fuzzy_lines as L
from blockloom.llm import graph
from blockloom.llm import simhash as S
from blockloom.llm import substring_dedup as D
from blockloom.llm import words as W

ODD = [(1, "a b"), (2, "a  b"), (3, "a\t\nb"), (4, ""), (5, None), (6, " "), (7, "a b"), (7, "a b"), (None, "a b"), (None, "only null"), (8, "x" * 40_000), (9, "x" * 40_000), (10, "é ü " * 9000)]


def text(rnd, n, words=400):
    return " ".join(rnd.choice("abcdefgh") + rnd.choice("äöxyz") + str(rnd.randrange(words)) for _ in range(n))


def test_fingerprints_compose():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(60_000)), rnd.randbytes(rnd.randrange(60_000))
        for w in (0, 1):
            whole = E.fingerprint(a + b, w)
            assert whole == E.combine(E.fingerprint(a, w), E.fingerprint(b, w), len(b), w)
            naive = 0
            for byte in (a + b)[:2000]:
                naive = (naive * E.BASES[w] + byte) % E.PRIMES[w]
            assert naive == E.fingerprint((a + b)[:2000], w)


def exact_brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        known = [x for x in groups[t] if x is not None]
        out.append((i, min(known, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("primes", [E.PRIMES, (3, 5)])
def test_exact(docs, primes):
    """With tiny primes many fingerprints collide, and only the comparison tells texts apart."""
    rnd = random.Random(2)
    rows = ODD + [(20 + k, rnd.choice(["aa", "ab", "ba", "bb", "abab", "baba", "c d", "d c"])) for k in range(60)]
    out = E.exact_classes(docs(rows, extra=True), primes=primes).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex())) for r in out) == exact_brute(rows)
    for keep in {r.sha for r in out}:
        assert sum(r.kept for r in out if r.sha == keep) == 1
    clash = docs(rows, extra=True).selectExpr("*", "'k' as key_", "'q' as _key", "7 as gone")
    kept = E.exact_dedup(clash)
    assert kept.count() == len({r.sha for r in out}) and kept.columns == clash.columns and {(r.key_, r._key) for r in kept.collect()} == {("k", "q")}
    # long texts in chunks have the fingerprints of whole ones
    cut_up = E.exact_classes(docs(rows, extra=True), primes=primes, long=7).collect()
    assert sorted(map(repr, cut_up)) == sorted(map(repr, out))


@pytest.mark.parametrize("primes", [E.PRIMES, (3, 5)])
def test_exact_without_ids(docs, primes):
    """Classes of rows without an id are compared too: different texts never become one group."""
    rows = [(None, t) for t in ("aa", "ab", "ba", "bb", "aa", "abab", "baba", "cc dd", "dd cc", "cc\tdd")]
    out = E.exact_classes(docs(rows), primes=primes).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex())) for r in out) == exact_brute(rows)
    assert sum(r.kept for r in out) == 8 and E.exact_dedup(docs(rows)).count() == 8


def test_empty_tables(docs):
    none = docs([])
    assert E.exact_classes(none).count() == 0 and S.near_classes(none).count() == 0
    assert D.remove_repeats(none).count() == 0 and L.fuzzy_lines(none).count() == 0
    assert E.exact_dedup(none).count() == 0 and S.near_dedup(none).count() == 0 and L.without_lines(none, L.fuzzy_lines(none)).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["", None, "a b  c", "ab", "cd", " x ", "é\tü\x0b日本", "w" * 100 + " z"]
    raw, offsets = W.flat(pa.array(texts))
    starts, ends, first = W.spans(raw, offsets)
    data = raw.tobytes()
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in (t or "").encode().split()]
    buffer, s, e = W.single_spaced(raw, starts, ends)
    assert [int(h) for h in W.xxh64(buffer, s, e)] == [xxhash.xxh64_intdigest(buffer[a:b].tobytes(), 42) for a, b in zip(s, e, strict=True)]
    assert len(W.window_hashes(np.arange(3, dtype=np.uint64), 20)) == 0


def simhash_brute(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_classes(docs):
    rnd = random.Random(4)
    rows = list(ODD)
    for k in range(60):
        base = text(rnd, 60).split()
        for c in range(4):
            copy = list(base)
            if c:
                copy[rnd.randrange(60)] = f"new{k}{c}"
            rows.append((100 + 4 * k + c, " ".join(copy).replace("a", "A") if c == 1 else " ".join(copy)))
    out = S.near_classes(docs(rows, extra=True)).collect()
    want = {(i, simhash_brute(t)) for i, t in rows}
    assert {(r.doc_id, r.print & (2**64 - 1)) for r in out} == want and len(out) == len(rows)
    ids = [i for i, _ in rows]
    prints = np.array([simhash_brute(t) for _, t in rows], np.uint64)
    label, near = np.arange(len(rows)), np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    least = {c: min((ids[i] for i in np.flatnonzero(label == c) if ids[i] is not None), default=None) for c in set(label)}
    assert sorted(map(repr, ((ids[i], least[label[i]]) for i in range(len(rows))))) == sorted(repr((r.doc_id, r.component_id)) for r in out)


def test_golay_keys_meet_within_two_bits():
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 2**64, 3000, np.uint64)
    flips = rnd.integers(0, 64, (3000, 2)).astype(np.uint64)
    b = a ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1])
    b[:500] = a[:500] ^ (np.uint64(1) << flips[:500, 0])
    for x, y in zip(a[:, None], b[:, None], strict=True):
        assert set(S.bucket_keys(x)[0].tolist()) & set(S.bucket_keys(y)[0].tolist())


@pytest.mark.parametrize("size", [5, 40, 700])
def test_links_inside_a_bucket_connect_what_pairs_connect(size):
    rnd = np.random.default_rng(size)
    prints = np.unique(rnd.integers(0, 2**64, 8, np.uint64)[rnd.integers(0, 8, size)] ^ (np.uint64(1) << rnd.integers(0, 64, size).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, size).astype(np.uint64)))
    left, right = S.linked(np.zeros(len(prints), np.int64), prints)
    place = {int(p): i for i, p in enumerate(prints)}
    mine, want = np.arange(len(prints)), np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    for _ in range(30):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            m = min(mine[place[a]], mine[place[b]])
            mine[place[a]] = mine[place[b]] = m
        want = np.array([want[n].min() for n in near])
    assert (mine == want).all()


def repeats_brute(rows, size=20):
    seen, out = set(), []
    mark = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, mark(r[1]))):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block_bytes", [1000, 1 << 22])
def test_repeated_passages(docs, block_bytes):
    rnd = random.Random(6)
    shared = [text(rnd, 60) for _ in range(3)]
    rows = [(k, text(rnd, rnd.randrange(80)) + " " + rnd.choice([*shared, ""]) + "\n" + text(rnd, 30)) for k in range(60)]
    rows += [(200, shared[0]), (201, shared[0] + " " + shared[0]), (202, "w " * 500), (203, None), (204, ""), (200, shared[0]), (None, shared[1]), (205, "one two")]
    rows += [(206, shared[2] + f" {k}") for k in range(9)] + [(None, f"{k} " + shared[1]) for k in range(9)]
    out = D.remove_repeats(docs(rows, extra=True), block_bytes=block_bytes, shard_windows=500).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in out) == repeats_brute(rows)


def test_words_that_polynomials_confuse(docs):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever its base."""
    words = ["a"]
    for _ in range(12):
        words.append(words[-1] + words[-1].translate(str.maketrans("ab", "ba")))
    odd = words[-1]
    rows = [(1, "w " * 19 + odd), (2, "w " * 19 + odd.translate(str.maketrans("ab", "ba"))), (3, "w " * 19 + odd)]
    out = {r.doc_id: r.n_removed for r in D.remove_repeats(docs(rows)).collect()}
    assert out == {1: 0, 2: 0, 3: 20}


def test_names_of_words():
    import pyarrow as pa

    rnd = random.Random(11)
    words = list({"".join(rnd.choice("ab") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 40) for _ in range(300)})
    raw, offsets = W.flat(pa.array([" ".join(words), " ".join(reversed(words))]))
    starts, ends, _ = W.spans(raw, offsets)
    for which in (0, 1):
        names = W.word_names(raw, starts, ends, which).tolist()
        assert len(set(names)) == len(words) and names[: len(words)] == names[len(words) :][::-1]


def test_sketch_never_counts_too_low():
    rnd = np.random.default_rng(7)
    s, total = D.Sketch(), {}
    for _ in range(3):
        cells, times = np.unique(rnd.integers(0, 1 << D.CELL_BITS, 2000) // 1000 * 1000, return_counts=True)
        assert (D._cells(*D._steps(cells.astype(np.uint64))) == cells).all()
        s.add(cells, times > 1)
        for x, n in zip(cells.tolist(), times.tolist(), strict=True):
            total[x] = total.get(x, 0) + n
    cells = np.array(sorted(total))
    assert s.repeated(cells).tolist() == [total[c] >= 2 for c in cells.tolist()]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_lines(spark, docs):
    rnd = random.Random(8)
    base = [text(rnd, 14) for _ in range(6)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(4):
            w = rnd.choice(base).split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "changed"
            lines.append("  ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
        rows.append((k, "\n".join([*lines, "", text(rnd, 3)])))
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, base[0]), (3, rows[3][1])]
    df = docs(rows, extra=True)
    out = L.fuzzy_lines(df).collect()
    assert len(out) == len(rows)
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    distinct = sorted({norm(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                parent[find(a)] = find(b)
    per_root = {}
    for r in out:
        t = next(x for i, x in rows if i == r.doc_id) if r.doc_id is not None else base[0]
        lines = t.split("\n") if t is not None else []
        assert r.n_lines == len(lines) and r.n_removed == len(r.removed)
        for i, line in enumerate(lines):
            if norm(line):
                per_root.setdefault(find(norm(line)), []).append((r.doc_id, i, i in r.removed))
            else:
                assert i not in r.removed
    for places in per_root.values():
        kept = [(d, i) for d, i, gone in places if not gone]
        assert len(kept) == 1 and kept[0] == min(((d, i) for d, i, _ in places if d is not None), default=kept[0])
    unique = docs([(i, t) for i, t in rows if i is not None and i != 3])
    texts = {r.doc_id: r.text for r in L.without_lines(unique.selectExpr("*", "1 as gone", "2 as _gone"), L.fuzzy_lines(unique)).collect()}
    assert texts[92] == "\n\n" and texts[90] is None

def test_fuzzy_lines_recall(docs):
    """Pairs of short and medium lines that differ in one word: at least 97 % of those whose edit similarity is
    0.8 or more are met, and no others."""
    rnd = random.Random(9)
    pairs = []
    for k in range(240):
        w = text(rnd, 3 + k % 24).split()
        v = list(w)
        at = rnd.randrange(len(v))
        v[at] = v[at][:-1] + "q" if k % 2 else "changed"
        pairs.append((" ".join(w), " ".join(v)))
    similar = [edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    out = {r.doc_id: r.removed for r in L.fuzzy_lines(docs([(i, "\n".join(p)) for i, p in enumerate(pairs)])).collect()}
    met = [out[i] == [1] for i in range(len(pairs))]
    short = [i for i, (a, _) in enumerate(pairs) if similar[i] and a.count(" ") < 10]
    assert len(short) > 50 and sum(similar) > 180
    assert not any(m and not s for m, s in zip(met, similar, strict=True))
    assert sum(m for m, s in zip(met, similar, strict=True) if s) >= 0.97 * sum(similar)
    assert sum(met[i] for i in short) >= 0.95 * len(short)


def test_edit_check_against_brute_force(spark):
    """Lines of all lengths, with edits up to the bound and beyond, also in nearly every word."""
    rnd = random.Random(12)
    pairs = [("", ""), ("abcd", "abce"), ("abcde", "abcdf"), ("x" * 300, "x" * 240), ("x" * 300, "x" * 239)]
    for n in (2, 9, 15, 40, 60, 400):
        for k in range(8):
            w = text(rnd, n).split()
            v = [x + "!" if k % 4 == 0 else "other" if rnd.random() < k / 24 else x for x in w]
            if k % 4 == 1:
                v = v[n // 3 :] + v[: n // 3]
            pairs.append((" ".join(w), " ".join(v)))
    pairs += [("thor " * 500 + "a b", "thor " * 480 + "thore " * 20 + "b a")]
    df = spark.createDataFrame(pairs, "x string, y string")
    out = df.selectExpr("x", "y", L._similar("x", "y", 0.8) + " as met").collect()
    right = [edit(r.x, r.y) <= int(0.2 * max(len(r.x), len(r.y)) + 1e-9) for r in out]
    assert [r.met for r in out] == right and 10 < sum(right) < len(right) - 5


def test_fuzzy_lines_keys(docs):
    """All similar pairs of fewer than 20 characters are met, and long ones whose words all get punctuation or
    lose three of the four longest."""
    rnd = random.Random(13)
    pairs = [("and ornd.", "and!! ornd."), ("eding enin.", "eding in."), ("a b c d e", "a b c d f"), ("abcd", "abcde")]
    for k in range(150):
        a = "".join(rnd.choice("abcdefgh ij") for _ in range(5 + k % 15)).strip() or "abcde"
        b = list(a)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(b))
            b[at] = rnd.choice(["", "z", b[at] + "y"])
        if max(len(a), len(b := re.sub(" +", " ", "".join(b)).strip())) < 20:
            pairs.append((re.sub(" +", " ", a), b))
    base = "tre abcde reç eaureê trementé aieauquetion rereelle fghij abc tre ètionellepa"
    pairs.append((base, " ".join(w + "!" for w in base.split())))
    many = "aaaaaaaaaaaa bbbbbbbbbbb cccccccccc ddddddddd eeeeeeee fffffff " + " ".join(f"w{i}" for i in range(60))
    pairs.append((many, many.replace("aaaaaaaaaaaa", "x").replace("bbbbbbbbbbb", "y").replace("cccccccccc", "z")))
    similar = [a != b and "" not in (a, b) and edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    out = {r.doc_id: r.removed for r in L.fuzzy_lines(docs([(i, "\n".join(p)) for i, p in enumerate(pairs)])).collect()}
    assert sum(similar) > 60 and similar[0] and similar[1] and similar[2] and similar[-2] and similar[-1]
    assert [pairs[i] for i, s in enumerate(similar) if s and 1 not in out[i]] == []


def test_letters_leave_a_least_distance(spark):
    """The bound by letters is never above the distance, with any characters, and settles strangers of other letters."""
    rnd = random.Random(14)
    pairs = [("", ""), ("", "aé"), ("aab", "abb"), ("x" * 300, "y" * 290), ("ééü", "éa "), ("日本語 z", "日本 zz"), ("🙂a", "a🙂🙂"), ("A\\'b", "'%_")]
    for k in range(200):
        a = "".join(rnd.choice("abcdefgh éü.7日") for _ in range(rnd.randrange(60)))
        b = list(a) if k % 2 else [rnd.choice("abc xyz.é") for _ in range(len(a))]
        for _ in range(rnd.randrange(8)):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice("aé z"))
            del b[rnd.randrange(len(b))]
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string").selectExpr("x", "y", L._letters("x") + " as u", L._letters("y") + " as v")
    out = df.selectExpr("x", "y", "u", L._least("u", "v") + " as least", L._similar("x", "y", 0.8, "u", "v") + " as met").collect()
    assert len(out) == len(pairs) and all(sum(r.u) == len(r.x) for r in out)
    assert [(r.x, r.y) for r in out if r.least > edit(r.x, r.y)] == []
    assert [(r.x, r.y) for r in out if r.met != (edit(r.x, r.y) <= int(0.2 * max(len(r.x), len(r.y)) + 1e-9))] == []
    assert next(r.least for r in out if r.x == "x" * 300) == 300 and sum(r.least > 0.2 * max(len(r.x), len(r.y)) for r in out) > 60


def test_proof_word_by_word(spark):
    """Texts of as many words are proved near by the sum of their words' distances; never where the distance is more."""
    rnd = random.Random(15)
    pairs = [("", "", 0), ("a b", "a", 9), ("ab cd", "ab ce", 1), ("ab cd", "ab ce", 0)]
    for k in range(120):
        w = text(rnd, 4 + k % 30).split()
        v = [rnd.choice([x, x, x, x[:-1], x + "é", "other"]) for x in w]
        pairs.append((" ".join(w), " ".join(v[k % 5 == 0 :]), rnd.randrange(40)))
    out = spark.createDataFrame(pairs, "x string, y string, k int").selectExpr("x", "y", "k", L._by_words("x", "y", "k") + " as proved").collect()
    for r in out:
        v, w = r.x.split(" "), r.y.split(" ")
        assert r.proved == (len(v) == len(w) and sum(map(edit, v, w)) <= r.k) and (not r.proved or edit(r.x, r.y) <= r.k)
    assert 20 < sum(r.proved for r in out) < 100


def test_fuzzy_lines_of_a_shared_passage(docs, monkeypatch):
    """Strangers that share a passage at different places are not compared in the second round, and similar lines
    among them are still met."""
    rnd = random.Random(16)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = [word(12) for _ in range(5)]
    lines = []
    for k in range(60):
        w = [word(rnd.randrange(2, 9)) for _ in range(70)]
        at = k * 70 // 60
        lines.append(w[:at] + passage + w[at:])
    rows = [" ".join(w) for w in lines] + [" ".join(w[:at] + ["other"] + w[at + 1 :]) for w in lines[20:40:5] for at in (0, 74)]
    met, check = [], L._verified

    def counted(pairs, texts, similar):
        met.append(pairs.count())
        return check(pairs, texts, similar)

    monkeypatch.setattr(L, "_verified", counted)
    out = {r.doc_id: r.n_removed for r in L.fuzzy_lines(docs(list(enumerate(rows)))).collect()}
    assert {i: n for i, n in out.items() if n} == {i: 1 for i in range(60, len(rows))}
    assert len(met) == 2 and met[1] < len(rows) * (len(rows) - 1) / 2 * 0.4


def test_words_left_alone_are_in_place(spark):
    """A key's places never rule out lines whose edits leave its words alone, wherever the edits are and whatever they are."""
    from pyspark.sql import functions as F

    rnd = random.Random(17)
    longest = ["abcdefghijklmnopq", "éeabcdefghijklmn", "qwertzuiopasdfgh", "yxcvbnmasdfghjkl", "mnbvcxzlkjhgfdsa"]
    rows, far = [], 0
    for k in range(120):
        w = text(rnd, 6 + k).split()
        for x in longest:
            w.insert(rnd.randrange(len(w) + 1), x)
        a = " ".join(w)
        left, v, most = int(0.2 * len(a) + 1e-9), list(w), k % 4 * 0.25
        for i in sorted(range(len(w)), key=lambda i: i if k % 2 else -i):  # all at one end, in whole words
            cost = len(w[i]) + 1
            if w[i] not in longest and cost <= left and rnd.random() >= most:
                v[i], left = None, left - cost
        b = " ".join(x for x in v if x is not None)
        assert edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        rows += [(2 * k, a), (2 * k + 1, b)]
        far += abs(a.index(longest[0]) - b.index(longest[0])) > 0.1 * len(a)
    lines = spark.createDataFrame(rows, "line bigint, norm string")
    found = L._keyed(lines).join(L._places(lines), "line").select("key", "line", F.expr(L._size("spot")).alias("size"), F.expr(L._placed("spot", "places")).alias("at"))
    left, right = found.toDF("key", "a", "m", "u"), found.toDF("key", "b", "n", "v")
    both = left.join(right, "key").where("a % 2 = 0 and b = a + 1").selectExpr("a", f"{L._in_place('u', 'v', 'm', 'n', 0.8)} as fits", f"u <> {L.ANYWHERE * 257} as placed").collect()
    assert len(both) == 1200 and all(r.fits and r.placed for r in both) and far > 10
