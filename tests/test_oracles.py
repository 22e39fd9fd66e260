"""Every registered query of the grid engine: against its SQL, or, where there is none, that it runs."""

from __future__ import annotations

import pytest

from tessera.plans import catalog
from tests.compare import versus_sql

ENTRIES = catalog.entries()


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, sf_dir, name):  # noqa: ANN001, ANN201
    e = ENTRIES[name]
    if e.sql:
        assert versus_sql(spark, e.run, e.sql, sf_dir) is None
    else:
        assert e.run(spark, sf_dir).columns
        e.run(spark, sf_dir).collect()
