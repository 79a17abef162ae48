"""Every registered query of the engine against its SQL in an independent engine."""

from __future__ import annotations

import pytest
from compare import differences, engine

from loomspark import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return engine(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(name, spark, sf_dir, con):
    assert not differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
