"""Numbers of many rows in blocks, for training that passes over them again and again.

A block is one row of binary columns, the bytes of one numpy array each (features by rows where it has two dimensions), and
holds the rows of one Arrow batch. A pass reads whole arrays; no row is handled on its own in Python, or in the JVM after
the first pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def pack(rows: DataFrame, make: Callable[[list[np.ndarray]], Sequence[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """Blocks of the arrays that ``make`` gives for the columns of a batch of rows; columns hold no nulls."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in made], list(names))

    return rows.mapInArrow(task, ", ".join(f"{n} binary" for n in names))


def arrays(batches: Iterator[pa.RecordBatch], kinds: Sequence[type]) -> Iterator[list[np.ndarray]]:
    """The arrays of each block, flat."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(c[i].as_buffer(), dtype=k) for c, k in zip(batch.columns, kinds, strict=True)]


#: So many of a tree's first inner nodes are compared for all rows at once; below them each row looks up its own node.
TOP = 31


def descend(values: np.ndarray, root: int, feature: np.ndarray, bound: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node of a tree that each row of values (rows by features) ends in: left up to a node's bound, else its right neighbour; leaves have feature -1."""
    columns, n = np.ascontiguousarray(values.T), len(values)
    top, reached, ends, end, inside = [root], {root: np.ones(n, dtype=bool)}, [], np.zeros(n, dtype=np.int8), 0
    for node in top:  # grows: a node's children come behind it
        here = reached.pop(node)
        if feature[node] >= 0 and inside < TOP:
            inside += 1
            right, child = columns[feature[node]] > bound[node], int(left[node])
            reached[child], reached[child + 1] = here > right, here & right
            top += (child, child + 1)
        else:
            end += here.view(np.int8) * np.int8(len(ends))
            ends.append(node)
    at = np.array(ends, dtype=np.int64).take(end)
    inner = feature >= 0
    if not inner.take(at).any():
        return at
    f, go = np.where(inner, feature, 0) * n, np.where(inner, left, np.arange(len(feature)))
    most = np.where(inner, bound, np.inf if bound.dtype.kind == "f" else np.iinfo(bound.dtype).max)
    flat, row = columns.ravel(), np.arange(n)
    while inner.take(at).any():
        at = go.take(at) + (flat.take(f.take(at) + row) > most.take(at))
    return at
