"""A stated query set against all rows, in blocks: what the operators over ``embeddings`` that answer queries share.

Queries are dealt into blocks of bounded size and rows into stripes; each cell
(block, stripe) is one task's work. A task holds the queries of its cell and
what it has found for each of them, while rows stream past in small tables, so
its memory doesn't grow with the number of rows. Every query meets every row once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import many, ship

#: Of a vector's components: all are there and finite.
FINITE = "forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"


def stripes_for(queries: DataFrame, n_queries: int, n_rows: int, per_block: int, least: int) -> tuple[int, int]:
    """Blocks of queries and stripes of rows: about as many cells as partitions, no stripe under ``least`` rows."""
    blocks = max(1, math.ceil(n_queries / per_block))
    return blocks, max(1, min(math.ceil(many(queries) / blocks), math.ceil(n_rows / least)))


def cells(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, blocks: int, stripes: int) -> DataFrame:
    """Queries (even ``cell``) and rows (odd ``cell``) of each cell side by side, queries first; either side's other columns are null."""
    ship(rows.sparkSession)
    asked = queries.selectExpr("*", f"pmod(xxhash64({query_key}), {blocks}) AS _b", f"explode(sequence(0, {stripes - 1})) AS _s", "0 AS _side")
    there = rows.selectExpr("*", f"explode(sequence(0, {blocks - 1})) AS _b", f"pmod(xxhash64({row_key}, 7), {stripes}) AS _s", "1 AS _side")
    both = asked.unionByName(there, allowMissingColumns=True).withColumn("cell", F.expr(f"2 * (_b * {stripes} + _s) + _side")).drop("_b", "_s", "_side")
    return both.repartitionById(blocks * stripes, F.expr("CAST(cell DIV 2 AS int)")).sortWithinPartitions("cell")


def pieces(batches: Iterable[pa.RecordBatch], at_once: int) -> Iterator[tuple[int, pa.Table]]:
    """(cell, table) in the order of cells: a cell's queries in one table, its rows in tables of at least ``at_once`` but for the last."""
    held: list[pa.RecordBatch] = []
    of, n = -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if held and cell[s] != of:
                yield of, pa.Table.from_batches(held)
                held, n = [], 0
            of = int(cell[s])
            held.append(batch.slice(s, e - s))
            n += e - s
            if of % 2 and n >= at_once:
                yield of, pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield of, pa.Table.from_batches(held)


def scan(both: DataFrame, begin, take, end, schema: str, at_once: int) -> DataFrame:
    """For each cell: state = begin(queries), take(state, rows) for its rows piece by piece, then the record batches of end(state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = None, -1
        for cell, tab in pieces(batches, at_once):
            if cell % 2 == 0:
                if state is not None:
                    yield from end(state)
                state, of = begin(tab), cell
            elif state is not None and cell == of + 1:
                take(state, tab)
        if state is not None:
            yield from end(state)

    return both.mapInArrow(run, schema)


def by_length(column: pa.ChunkedArray, dtype) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of list: the rows that have it, and their values as a matrix."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    ends = ends - ends[0]
    lengths = np.diff(ends)
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = rows, values[ends[rows][:, None] + np.arange(d)].astype(dtype).reshape(len(rows), int(d))
    return out
