"""Queries on small tables that are odd: keys far apart, few orders."""

import random
from collections import Counter

import pytest

from cladespark import catalogue
from cladespark.operators import likelihood as lk

TOP = 7_000_000_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Order keys up to TOP, so that a region has more sites than an array holds; the orders as {key: {line: part}}."""
    rng = random.Random(4)
    orders = {key: {line: rng.randrange(200) for line in range(1, rng.randint(2, 8))} for key in (1, 2, 3, 500, 65_536, 4_000_000_001, TOP - 1, TOP)}
    return write(spark, tmp_path_factory.mktemp("far"), orders), orders


def write(spark, folder, orders):
    rows = [(key, line, part, part % 9) for key, lines in orders.items() for line, part in lines.items()]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_partition_bind(spark, far):
    sf, orders = far
    parts = [[k for k in orders if (k + 2) % 3 == p] for p in range(3)]
    want = [(p, len(x), min(x), max(x)) for p, x in enumerate(parts)]
    assert sorted(map(tuple, catalogue.partition_bind(spark, sf).collect())) == want


def test_partition_loglik(spark, far):
    sf, _ = far
    each = lk.site_loglik(catalogue.columns(spark, sf), catalogue.TREE, catalogue.GTR4, ("site",)).collect()
    want = {p: sum(r.lnl for r in each if (r.site + 2) % 3 == p) for p in range(3)}
    assert {r.partition: r.lnl for r in catalogue.partition_loglik(spark, sf).collect()} == pytest.approx(want, abs=1e-3)


def test_partition_patterns(spark, far):
    sf, orders = far
    want = Counter(((k + 2) % 3, *(1 << lines[i] % 4 if i in lines else 15 for i in range(1, 8))) for k, lines in orders.items())
    got = catalogue.partition_patterns(spark, sf).collect()
    assert {tuple(r)[:-1]: r.w for r in got} == want and len(got) == len(want)


def test_partition_shares(spark, far):
    sf, orders = far
    n = Counter((k + 2) % 3 for k in orders)
    assert sorted(map(tuple, catalogue.partition_shares(spark, sf).collect())) == [(p, n[p], round(n[p] / len(orders), 9)) for p in sorted(n)]


@pytest.mark.parametrize("top", [50, 500])
def test_partition_validate(spark, tmp_path, top):
    """Of 50 sites the second region ends before it begins; every third site is missing."""
    sites = [k for k in range(1, top + 1) if k % 3 != 1 or k == top]
    times = Counter([*range(1, top // 2 + 1), *range(top // 3, top - 99)])
    want = sum(n > 1 for n in times.values()), sum(k not in times for k in sites), len(times.keys() - set(sites))
    assert tuple(catalogue.partition_validate(spark, write(spark, tmp_path, {k: {1: k, 2: k} for k in sites})).first()) == want


def test_kept_patterns_use_all_cores(spark, far):
    kept = catalogue.kept_patterns(spark, far[0])
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, catalogue.patterns(spark, far[0]).collect()))
    sizes = [len(x) for x in kept.rdd.glom().collect()]
    kept.unpersist()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= sum(sizes) / len(sizes) + 2


def test_regions_are_dealt_to_tasks(spark, far):
    for query in (catalogue.align_regions, catalogue.align_all_taxa):
        assert query(spark, far[0]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
