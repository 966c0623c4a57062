"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import lectern.queries  # noqa: F401
from lectern.registry import ORACLE, QUERIES
from tools.compare import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    said = compare(spark, sf, name, QUERIES, ORACLE)
    assert said.startswith("equal" if name in ORACLE else "rows only"), said
