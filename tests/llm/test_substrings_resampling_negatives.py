"""Substring dedup, importance resampling and hard negatives against brute force; edge cases."""

import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from loanlens.llm import hard_negatives, importance, substring_dedup  # noqa: E402
from loanlens.llm.joins import counted_join  # noqa: E402
from loanlens.llm.rolling import word_hashes  # noqa: E402

DOC = "doc_id long, text string"
VEC = "vec_id long, embedding array<float>, label int"

CLASH = ("row", "at", "h", "c", "n", "first", "last", "sure", "open", "many", "spans", "kept", "anchor", "score", "rank", "above",
         "wanted", "n_words", "weight", "bucket", "chunk", "block", "tops", "key", "id", "vec", "_salt", "_salts")


def clash(df):
    """Extra columns with the names that the operators use themselves."""
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


# ---- 11 substring dedup ----------------------------------------------------------

def brute_substring(rows, length):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split, strict=True):
        if i is not None:
            for k in range(len(w) - length + 1):
                win = tuple(w[k:k + length])
                first[win] = min(first.get(win, i), i)
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k:k + length])] < i:
                    gone[k:k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_substring(df, length):
    out = substring_dedup.remove_repeats(df, length).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]),
                    hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out), key=str)


def passages(length, seed=1):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    common = [text(length), text(length + 1), text(3 * length), text(length - 1), text(5 * length)]
    rows = [(None, common[2]), (10_000, None), (10_001, ""), (10_002, " \t\n "), (10_003, "x " * (4 * length)),
            (10_004, "x " * (2 * length)), (7, common[4]), (7, common[4]), (7, "other text " + common[2])]
    for i in range(60):
        parts = [text(int(rng.integers(0, 2 * length)))]
        for _ in range(int(rng.integers(0, 4))):
            p = common[int(rng.integers(0, len(common)))].split()
            lo = int(rng.integers(0, 3))
            if rng.random() < 0.4:
                p[int(rng.integers(0, len(p)))] = "changed"
            parts += [" ".join(p[lo:]), text(int(rng.integers(0, 30)))]
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, rows[20][1]) for i in range(5)] + [(200 + i, rows[21][1] + " tail") for i in range(3)]
    return rows


@pytest.mark.parametrize("length", [2, 5, 20, 50, 90])
def test_substring_dedup_equals_brute_force(spark, length):
    rows = passages(length, length)
    df = spark.createDataFrame(rows, DOC).repartition(4)
    assert got_substring(clash(df), length) == brute_substring(rows, length)


def test_substring_dedup_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 256)      # in this process: the pieces themselves
    rng = np.random.default_rng(3)
    words = rng.integers(0, 10**6, 4000)
    raw = " ".join(map(str, words)).encode()
    from loanlens.llm import rolling
    whole = word_hashes(raw)
    monkeypatch.setattr(rolling, "PIECE", 100)
    assert (word_hashes(raw) == whole).all() and len(whole) == 4000
    assert len(word_hashes(b"")) == len(word_hashes(b" \n\x0b")) == 0
    long = " ".join(map(str, words)) * 40
    rows = [(1, long), (2, " ".join(map(str, words[500:900]))), (3, long + " end")]
    assert got_substring(spark.createDataFrame(rows, DOC), 50) == brute_substring(rows, 50)


def test_anchor_pieces_equal_one_piece(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 50, 3000)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text])], names=["doc", "row", "text"])
    rows = lambda f: sorted(r for b in f(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    whole = rows(substring_dedup._anchor_rows(50))
    monkeypatch.setattr(substring_dedup, "BLOCK", 200)
    assert rows(substring_dedup._anchor_rows(50)) == whole


def test_substring_dedup_empty_and_refused(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOC)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.cover_for(1)


def test_covers_meet_every_shift():
    for period, residues in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def test_counted_join_deals_out_frequent_keys(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = counted_join(rows, table, ["k"], parts=64)
    assert got.columns == ["k", "v", "top"]
    want = {(r["k"], r["v"], r["top"]) for r in rows.join(table, "k").select("k", "v", "top").collect()}
    out = [tuple(r) for r in got.collect()]
    assert len(out) == 20_000 and set(out) == want


# ---- 12 importance resampling ----------------------------------------------------

def brute_importance(rows, bench, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    def feats(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    docs = [(i, *feats(t)) for i, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for x in bench:
        for b in feats(x)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log(((b + 1) * (big_s + buckets)) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, n, f in docs:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = {id(x): k + 1 for k, x in enumerate(able[:percent * len(able) // 100])}
    return sorted(((x[0], x[1], x[2], x[3], ranks.get(id(x))) for x in out), key=str)


def importance_rows():
    rng = np.random.default_rng(9)
    vocab = ["Word%d" % i for i in range(300)] + ["naïve", "数据", "it's", "A-B", "x" * 300, "ÉTÉ"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    rows = [(i, text(int(rng.integers(0, 80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, text(30)), (1002, "__ -- !"), (1003, "one " * 40_000)]
    return rows, [text(25) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("runs,percent", [(1, 10), (1, 100), (3, 35)])
def test_importance_equals_brute_force(spark, runs, percent):
    rows, bench = importance_rows()
    df = clash(spark.createDataFrame(rows, DOC).repartition(3))
    target = clash(spark.createDataFrame([(t,) for t in bench], "text string"))
    out = importance.resample(df, target, runs=runs, percent=percent).collect()
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out), key=str)
    assert got == brute_importance(rows, bench, runs, percent=percent)


def test_importance_ties_and_repeated_rows(spark):
    rows = [(1, "a b " * 15)] * 3 + [(2, "c d " * 15)] * 3
    out = importance.resample(spark.createDataFrame(rows, DOC), spark.createDataFrame([("a b",)], "text string"), percent=50).collect()
    assert len(out) == 6 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]


def test_importance_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    some = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(20)], DOC)
    assert importance.resample(none, some).count() == 0
    assert {r["rank"] for r in importance.resample(some, none).collect()} == {1, 2, None}


def test_crc_matrices_equal_zlib():
    rng = np.random.default_rng(1)
    words = [rng.bytes(int(n)) for n in rng.integers(0, 40, 500)] + [b"", b"x" * 5000]
    assert importance.crc32s(words).tolist() == [zlib.crc32(w) for w in words]
    assert len(importance.crc32s([])) == 0


def test_features_in_pieces(monkeypatch):
    raw = " ".join(f"w{i}" for i in range(500)).encode()
    whole = sorted(x for _, p in importance.features(raw, 3) for x in p)
    monkeypatch.setattr(importance, "PIECE", 37)
    parts = list(importance.features(raw, 3))
    assert len(parts) > 10 and sum(n for n, _ in parts) == 500
    assert sorted(x for _, p in parts for x in p) == whole


# ---- 13 hard negatives -----------------------------------------------------------

def brute_negatives(rows, every=100, k=5, m=5, pct=80):
    ok = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = sorted({(i, lab, tuple(v)) for i, lab, v in ok if i % every == 0})
    out = []
    for ai, al, av in anchors:
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=False)), i, lab) for i, lab, v in ok if i != ai)
        for ps, pi, _ in [x for x in scored if x[2] == al][:k]:
            neg = [x for x in scored if x[2] != al and pct * -ps <= 100 * -x[0] <= 100 * -ps][:m]
            out += [(ai, pi, r + 1, ni, -ps, -ns) for r, (ns, ni, _) in enumerate(neg)]
    return sorted(out)


def vec_rows(n=900, dim=6, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, 0.3, dim).astype("float32").tolist(), int(rng.integers(0, 4))) for i in range(n)]
    for i in range(300, 600):                       # a third of the rows: one vector, ties everywhere
        rows[i] = (i, [0.5] * dim, i % 3)
    rows += [(2000, None, 1), (2100, [0.1] * dim, None), (2200, [0.1, None] + [0.0] * (dim - 2), 1), (None, [0.5] * dim, 2),
             (2300, [float("nan")] * dim, 1), (2400, [float("inf")] * dim, 0), (2500, [0.5, 0.4], 2), (2600, [], 1),
             rows[5], rows[5], rows[100], (2700, [0.0] * dim, 3), (2800, [-0.4] * dim, 9)]
    return rows


@pytest.mark.parametrize("chunk,block", [(1 << 16, 512), (64, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vec_rows()
    df = clash(spark.createDataFrame(rows, VEC).repartition(5))
    out = hard_negatives.mine(hard_negatives.vectors(df))
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows)


def test_hard_negatives_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 18 + i), 3.0 * i], i % 2) for i in range(0, 300)]
    out = hard_negatives.mine(hard_negatives.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows)


def test_hard_negatives_empty_table(spark):
    assert hard_negatives.mine(hard_negatives.vectors(spark.createDataFrame([], VEC))).count() == 0
    one = spark.createDataFrame([(100, [0.1], 1)], VEC)
    assert hard_negatives.mine(hard_negatives.vectors(one)).count() == 0
