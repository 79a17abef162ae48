"""Queries that SQL can express, against an independent engine."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences, engine

from loomspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(name, spark, sf_dir):
    assert not differences(registry.QUERIES[name](spark, sf_dir), engine(sf_dir), registry.ORACLE[name])
