"""Versioned tables, queries and data services on Apache Spark."""

from tarnlake.functions import avg, col, count, dense_rank, lag, lead, lit, max, min, rank, row_number, sum, when
from tarnlake.session import AsyncLake, Federation, Lake

__all__ = ["AsyncLake", "Federation", "Lake", "avg", "col", "count", "dense_rank", "lag", "lead", "lit", "max", "min", "rank", "row_number", "sum", "when"]
