"""Every query with an independent DuckDB query gives the same rows on the smallest tables."""

from collections import Counter

import pytest

import docketlens.operators
from docketlens.plans.registry import ORACLE, QUERIES

docketlens.operators.load()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(name, spark, duck, small):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = Counter(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert got == expected, (list((got - expected))[:3], list((expected - got))[:3])


#: The smallest tables may hold no two articles that are alike; test_names_articles.py has some that are.
SCARCE = ("agg_37_dedup_stats", "fed_7_groups", "fed_8_duplicate_kinds")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, small):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns) > 0
    assert df.count() >= (name not in SCARCE)
