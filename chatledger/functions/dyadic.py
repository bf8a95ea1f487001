"""Power-of-two blocks of the number line, to turn range conditions into equality joins.

A block of level ``k`` is ``[n * 2^k, (n + 1) * 2^k)``. Every interval is a disjoint union of at most two
blocks per level, and a point lies in exactly one block of each level, so a point meets an interval in
exactly one block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "array<struct<level: int, node: bigint>>"


def cover(start: str, end: str) -> Column:
    """Blocks whose disjoint union is ``[start, end)``; both must be non-negative and finite."""
    return F.expr(f"""
        cast(filter(flatten(transform(sequence(0, length(bin({end} - {start})) - 1), k -> array(
            if(shiftright({start} + shiftleft(1L, k) - 1, k) < shiftright({end}, k)
               and shiftright({start} + shiftleft(1L, k) - 1, k) % 2 = 1,
               named_struct('level', k, 'node', shiftright({start} + shiftleft(1L, k) - 1, k)), null),
            if(shiftright({start} + shiftleft(1L, k) - 1, k) < shiftright({end}, k)
               and shiftright({end}, k) % 2 = 1,
               named_struct('level', k, 'node', shiftright({end}, k) - 1), null)
        ))), b -> b is not null) as {BLOCK})
    """)


def levels(start: str, end: str) -> Column:
    """The highest level a block of ``[start, end)`` can have."""
    return F.expr(f"length(bin({end} - {start})) - 1")


def path(point: str, top: str) -> Column:
    """The blocks of levels 0 to ``top`` that hold ``point``."""
    return F.expr(
        f"cast(transform(sequence(0, {top}), k -> named_struct('level', k, 'node', shiftright({point}, k))) as {BLOCK})"
    )


def ones(number: str) -> Column:
    """For each one bit of ``number``: its level and the number's higher bits."""
    return _bits(number, f"length(bin({number})) - 1", 1)


def zeros(number: str, top: str) -> Column:
    """For each zero bit of ``number`` up to level ``top``: its level and the number's higher bits.

    For non-negative numbers, ``a > b`` exactly if ``ones(a)`` and ``zeros(b)`` share one element.
    """
    return _bits(number, top, 0)


def _bits(number: str, top: str, bit: int) -> Column:
    return F.expr(f"""
        cast(transform(
            filter(sequence(0, cast({top} as int)), k -> shiftright({number}, k) % 2 = {bit}),
            k -> named_struct('level', k, 'node', shiftright({number}, k + 1))
        ) as {BLOCK})
    """)
