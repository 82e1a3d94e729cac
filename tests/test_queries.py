import comparing
import pytest

from quartzite import queries


#: Queries without rows on the smallest tables, whose dates have fewer names than they ask for.
MAY_BE_EMPTY = {"newey_west", "residual_on_controls", "missing_keys", "fama_macbeth"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    rows = comparing.assert_same(queries.QUERIES[name](spark, comparing.DATA), queries.ORACLE[name])
    assert rows > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["rank_ic", "group_test", "performance", "factors_broker", "intraday_factors", "market_residual", "processed_signal", "minute_forward_returns", "tensor_features", "smart_money", "page_rank"])
def test_full_precision(spark, name):
    """The values as the operators return them, without the cut that the hashed comparison needs."""
    run, sql = queries.FULL[name]
    df = run(spark, comparing.DATA)
    keys = [c for c in ("symbol", "td", "day", "slot", "grp", "node") if c in df.columns]
    assert comparing.assert_close(df, sql, keys) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, comparing.DATA).count() > 0
