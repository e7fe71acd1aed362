"""Pixels and their neighbours: one shuffle by square blocks, each with a margin of the pixels around it."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

BLOCK = 64
DENSE = 64          # positions a row for which a table of all positions is built, else they are searched


def over_blocks(df: DataFrame, sample: str, reach_y: tuple[int, int], reach_x: tuple[int, int], fn: Callable, schema: str, from_zero: bool = False,
                block: int = BLOCK) -> DataFrame:
    """Run ``fn`` on whole blocks of ``block`` x ``block`` pixels; ``df`` holds ``sample``, y, x and further columns.

    A pixel goes to its own block and to those that need it: block rows from y - reach_y[1] to y - reach_y[0], columns likewise.
    ``fn(table)`` takes an Arrow table of complete blocks, ordered by block, with the columns of ``df``, the block position ``_yb``
    and ``_xb`` and ``_block``, a number for each block of the table, and returns the rows of its own pixels only. Blocks are the
    partitioning key and are read one after the other, so a task holds one batch and one block. ``from_zero`` leaves out blocks at
    negative positions. Pixels with a NULL sample or
    position have no neighbours and are left out.
    """
    def reached(pos: str, reach: tuple[int, int]):
        lo, hi = (F.floor((F.col(pos) - F.lit(r)) / block).cast("int") for r in (max(reach[1], 0), min(reach[0], 0)))
        return F.explode(F.filter(F.sequence(lo, hi), lambda b: b >= 0) if from_zero else F.sequence(lo, hi))

    placed = df.dropna(subset=[sample, "y", "x"]).withColumn("_yb", reached("y", reach_y)).withColumn("_xb", reached("x", reach_x))
    keys = [sample, "_yb", "_xb"]

    def blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def starts(table):
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in keys:
                col = table.column(c).combine_chunks()
                new[1:] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, max(len(col) - 1, 0))), False).to_numpy(zero_copy_only=False)
            return new

        def done(table):
            number = np.cumsum(starts(table)) - 1
            return fn(table.append_column("_block", pa.array(number, pa.int64()))).to_batches()

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = int(np.nonzero(starts(table))[0][-1])
            if last:
                yield from done(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(blocks, schema)


def _places(table):
    """Block number, y and x as integers of numpy."""
    import numpy as np
    return [table.column(c).to_numpy().astype(np.int64) for c in ("_block", "y", "x")]


def differing(table, value: str, offsets: Sequence[tuple[int, int]], block: int | None):
    """Row numbers (pixel, neighbour) and offset number of the pixels of a table of blocks whose neighbour has another value.

    With ``block`` only the own pixels of each block are compared, else those of its margin too.
    """
    import numpy as np
    import pyarrow.compute as pc
    b, y, x = _places(table)
    own = np.arange(len(y)) if block is None else np.nonzero((y // block == table.column("_yb").to_numpy()) & (x // block == table.column("_xb").to_numpy()))[0]
    reach = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    y, x = (p - table.column(c).to_numpy().astype(np.int64) * (block or BLOCK) for p, c in ((y, "_yb"), (x, "_xb")))      # from the corner of the block
    y0, x0 = y.min() - reach, x.min() - reach
    high, wide = y.max() + reach + 1 - y0, x.max() + reach + 1 - x0
    code = (b * high + (y - y0)) * wide + (x - x0)
    values = table.column(value).combine_chunks()
    pixels, others, which = [], [], []
    size, at = int((b.max() + 1) * high * wide), None
    if size <= DENSE * len(code) + DENSE:
        at = np.full(size, -1, np.int32)                       # the row at each position
        at[code] = np.arange(len(code), dtype=np.int32)
        if not np.array_equal(at[code], np.arange(len(code))):
            at = None                                          # rows of one position may repeat
    if at is None:
        order = np.argsort(code, kind="stable")
        ranked = code[order]
    for i, (dy, dx) in enumerate(offsets):
        want = code[own] + dy * wide + dx
        if at is not None:
            found = at[want]
            has = found >= 0
            pixels.append(own[has])
            others.append(found[has])
        else:
            lo, hi = np.searchsorted(ranked, want, "left"), np.searchsorted(ranked, want, "right")
            n = hi - lo
            pixels.append(np.repeat(own, n))
            others.append(order[np.repeat(lo, n) + np.arange(len(pixels[-1])) - np.repeat(np.cumsum(n) - n, n)])
        which.append(np.full(len(pixels[-1]), i))
    pixels, others, which = np.concatenate(pixels), np.concatenate(others), np.concatenate(which)
    unlike = pc.not_equal(values.take(pixels), values.take(others)).to_numpy(zero_copy_only=False)
    return pixels[unlike], others[unlike], which[unlike]


def dilated(b, y, x, lo: int, hi: int):
    """Distinct positions (block number, y, x) of every mark moved by lo..hi in both directions."""
    import numpy as np
    if not len(b):
        return np.empty((3, 0), np.int64)
    b0, y0, x0 = b.min(), y.min() + lo, x.min() + lo
    high, wide = y.max() + hi + 1 - y0, x.max() + hi + 1 - x0
    code = ((b - b0) * high + (y - y0)) * wide + (x - x0)
    moves = [dy * wide + dx for dy in range(lo, hi + 1) for dx in range(lo, hi + 1)]
    size = int((b.max() + 1 - b0) * high * wide)
    if size <= DENSE * len(code) + DENSE:
        mark = np.zeros(size, bool)
        for move in moves:
            mark[code + move] = True
        grown = np.flatnonzero(mark)
    else:
        grown = np.unique(np.concatenate([code + move for move in moves]))
    return np.stack([grown // (high * wide) + b0, grown // wide % high + y0, grown % wide + x0])
