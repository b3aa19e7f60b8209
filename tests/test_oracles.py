"""Every query against its SQL, value by value."""

import math

import pandas as pd
import pytest

import __spark_entry__ as contract


def _canonical(frame):
    columns = sorted(frame.columns)

    def plain(value):
        if pd.api.types.is_scalar(value) and pd.isna(value):
            return None
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, float):
            return 0.0 if value == 0 else int(value) if math.isfinite(value) and value == int(value) else value
        return value

    rows = [tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    result = contract.queries()[name](spark, sf_dir).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(result)
        return
    expected = duck.execute(sql).df()
    assert _canonical(result) == _canonical(expected)


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
