"""Names of the engine's queries, with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from loomspark import submit
from loomspark.functions import scalar, vector
from loomspark.operators import relational
from loomspark.plans import bdb, programs, subqueries, tpch
from loomspark.sources import csv, sealed
from loomspark.streaming import windows

CATALOGUES = [m.CATALOGUE for m in (relational, scalar, vector, subqueries, bdb, programs, csv, sealed, windows, submit)]
QUERIES = dict(tpch.QUERIES)
ORACLE = dict(tpch.ORACLE)
for _c in CATALOGUES:
    QUERIES |= _c.queries
    ORACLE |= _c.oracle
