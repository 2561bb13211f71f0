"""Confidence intervals of proportions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score bounds of k successes in n; NULL when n = 0."""
    total = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / total
    denom = F.lit(1.0) + F.lit(z * z) / total
    centre = (p + F.lit(z * z) / (total * 2.0)) / denom
    half = F.sqrt(p * (F.lit(1.0) - p) / total + F.lit(z * z) / (total * total * 4.0)) * F.lit(z) / denom
    return centre - half, centre + half


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """p1 - p2 with the hybrid score interval built from the two Wilson intervals."""
    p1, p2 = k1 / F.nullif(n1.cast("double"), F.lit(0.0)), k2 / F.nullif(n2.cast("double"), F.lit(0.0))
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    square = lambda c: c * c
    return (p1 - p2, p1 - p2 - F.sqrt(square(p1 - l1) + square(u2 - p2)),
            p1 - p2 + F.sqrt(square(u1 - p1) + square(p2 - l2)))
