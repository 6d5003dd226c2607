"""Remediation priority P = importance * gap * urgency (fixed steps)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def importance_weight(importance: Column) -> Column:
    return F.when(importance == 1, 0.4).when(importance == 2, 0.7).otherwise(1.0)


def gap_size(status: Column, completeness: Column) -> Column:
    partial = F.greatest(F.lit(0.1), F.round(1 - completeness, 3))
    return F.when(status == "supported", 0.0).when(status == "not_found", 1.0).when(status == "conflicting", 0.8).when(status == "human_review", 0.5).otherwise(partial)


def urgency(days: Column) -> Column:
    return F.when(days.isNull(), 0.5).when(days <= 30, 1.0).when(days <= 90, 0.8).when(days <= 180, 0.6).otherwise(0.4)


def priority(importance: Column, status: Column, completeness: Column, days: Column) -> Column:
    return F.round(importance_weight(importance) * gap_size(status, completeness) * urgency(days), 3)
