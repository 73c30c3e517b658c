"""Category dictionaries, sparse one-hot vectors and correlations by column blocks."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators import encode as EN
from loanlens.operators.categories import CategoryDictionary, positions


def brute(rows, columns):
    values = [(i, v) for i in range(len(columns)) for v in sorted({r[i + 1] for r in rows if r[i + 1] is not None})]
    return {v: k for k, v in enumerate(values)}, Counter((i, r[i + 1]) for r in rows for i in range(len(columns)) if r[i + 1] is not None)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        town = "hot" if k % 3 == 0 else f"t{rng.integers(0, 90)}"
        rows.append((k, None if k % 11 == 0 else town, None if k % 7 == 0 else f"ü{rng.integers(0, 4)}", None))
    rows.append((600, "", "ü0", None))
    return rows, spark.createDataFrame(rows, "k long, town string, plan string, nothing string").repartition(5)


def test_dictionary_numbers_values_in_order(people):
    rows, df = people
    d = CategoryDictionary.fit(df, ["town", "plan", "nothing"], partitions=4)
    index, n = brute(rows, d.columns)
    got = d.named().collect()
    assert {(r["feature"], r["value"]): (r["index"], r["n"]) for r in got} == {
        (d.columns[i], v): (k, n[i, v]) for (i, v), k in index.items()}
    assert d.dimension == len(index) and d.sizes[2] == 0


@pytest.mark.parametrize("impute", [True, False])
def test_vectors_equal_brute_force(people, impute):
    rows, df = people
    columns = ["nothing", "town", "plan"]
    d = CategoryDictionary.fit(df, columns)
    order = [(r[0], r[3], r[1], r[2]) for r in rows]
    index, n = brute(order, columns)
    mode = {i: min((v for c, v in n if c == i), key=lambda v: (-n[i, v], v), default=None) for i in range(3)}
    want = {}
    for r in order:
        cells = [(i, v if v is not None or not impute else mode[i]) for i, v in enumerate(r[1:])]
        want[r[0]] = sorted(index[c] for c in cells if c[1] is not None)
    out = d.encode(df, "k", impute)
    got = out.select("k", positions("features").alias("p"), "features").collect()
    assert {r["k"]: r["p"] for r in got} == want and len(got) == len(rows)
    assert all(r["features"].size == d.dimension for r in got)


def test_unknown_values_and_empty_tables(spark, people):
    _, df = people
    d = CategoryDictionary.fit(df, ["town", "plan"])
    other = spark.createDataFrame([(1, "elsewhere", "ü0"), (2, "elsewhere", "none")], "k long, town string, plan string")
    got = {r["k"]: r["p"] for r in d.encode(other, "k").select("k", positions("features").alias("p")).collect()}
    assert len(got[1]) == 1 and got[2] == []
    assert d.encode(df.limit(0), "k").count() == 0
    none = CategoryDictionary.fit(df.limit(0), ["town", "plan"])
    assert none.dimension == 0 and none.table.count() == 0
    assert [r["features"].size for r in none.encode(other, "k").collect()] == [0, 0]


def test_a_million_categories(spark):
    """Half the rows share one value; nothing but a number a column reaches the driver."""
    df = spark.range(2_000_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("c"))
    d = CategoryDictionary.fit(df, ["c"])
    assert d.dimension == 1_000_001
    s = d.table.agg(F.countDistinct("index").alias("u"), F.min("index").alias("lo"), F.max("index").alias("hi")).first()
    assert (s["u"], s["lo"], s["hi"]) == (1_000_001, 0, 1_000_000)
    some = d.encode(df.where("id < 5000"), "id").select(F.size(positions("features")).alias("n"), positions("features")[0].alias("p"))
    got = some.agg(F.sum("n").alias("n"), F.countDistinct("p").alias("u")).first()
    assert (got["n"], got["u"]) == (5000, 2501)


def test_blocks_of_columns_give_the_same_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11)) + 1000.0
    x[:, 4] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c.{i}" for i in range(11)]
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for v in r) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(3)
    whole = {(r["i"], r["j"]): r["r"] for r in EN.pair_correlations(df, names).collect()}
    split = {(r["i"], r["j"]): r["r"] for r in EN.pair_correlations(df, names, block=2).collect()}
    assert set(whole) == set(split) == {(i, j) for i in range(11) for j in range(i + 1, 11)}
    for (i, j), r in whole.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 4 in (i, j):
            assert r is None and split[i, j] is None
        else:
            want = np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert abs(r - want) < 1e-9 and abs(split[i, j] - want) < 1e-9


def test_correlations_of_more_columns_than_a_block(spark):
    k = EN.BLOCK + 90
    df = spark.range(50).select(*[F.sin(F.col("id") * (1 + c % 7) + F.lit(c // 7)).alias(f"x{c}") for c in range(k)])
    names = [f"x{c}" for c in range(k)]
    v = np.array([[np.sin(i * (1 + c % 7) + c // 7) for c in range(k)] for i in range(50)])
    want = np.corrcoef(v.T)
    pairs = EN.correlated_pairs(df, names, 0.85).collect()
    got = {(r["i"], r["j"]) for r in pairs}
    sure = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.abs(want) > 0.85 + 1e-9, 1)))}
    maybe = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.abs(want) > 0.85 - 1e-9, 1)))}
    assert sure <= got <= maybe and len(sure) > 100
