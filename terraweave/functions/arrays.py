"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def elements(c: Column | str) -> Column:
    """Input of ``explode``/``inline`` for an array that is costly to compute.

    Given a bare column, the optimizer infers ``size(column) > 0``, pushes that
    filter below the projection and so computes the array twice (quadratically
    inside lambdas). A conditional expression is left alone; empty and null
    arrays give no rows either way.
    """
    return F.when(F.size(col(c)) > 0, col(c))
