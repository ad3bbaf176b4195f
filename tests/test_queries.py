from __future__ import annotations

import pytest

from seqmill import oracle, queries
from tests.oracle import SMALL, both

SQL = oracle.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = both(spark, queries.queries()[name], SQL[name])
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


def test_posterior_lines_lose_no_grid_point(spark):
    lines = queries.posterior_lines(spark, SMALL).collect()
    best = {(r.chrom, r.sample, r.pos): r for r in queries.map_frequency(spark, SMALL).collect()}
    assert len(lines) == len(best) and {len(r.log_post) for r in lines} == {queries.POINTS}
    for r in lines:
        want = best[r.chrom, r.sample, r.pos]
        assert float(r.best_freq) == want.best_freq and float(r.log_post[want.best_k]) == max(map(float, r.log_post))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())
