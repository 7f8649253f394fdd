"""How often hashed items occur over a corpus, by count-min sketches that are merged in ranges of slots.

A block of documents makes a partial sketch of its items, one count per document, split into ranges. The partial sketches
of a range are added up, and each block is told the sums in its own slots. Nothing is broadcast and no task holds more
than one range. A level, the least sum over the rows of the sketch, is never below the true number of documents (levels
stop at 255).

A message carries the items of one block in one range, as compressed gaps. Blocks and ranges grow with the input (see
``layout``), so that messages keep many items: about a byte an item on gigabytes, some three bytes at 100 TB.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import mix64

#: Rows of the sketch; slots for each item of a range (so one slot in eight is in use).
DEPTH, SPREAD = 2, 8
#: Bytes of text of a block and items of a range: the usual ones and the most, which bound a task's memory (a range is a
#: byte per slot, 256 MB at most).
BLOCK_BYTES, MOST_BLOCK = 8 << 20, 64 << 20
RANGE_ITEMS, MOST_RANGE = 1 << 21, 1 << 25
#: Items that a message should hold on average; text bytes per item, about.
MESSAGE_ITEMS, ITEM_BYTES = 64, 6
PARTIAL = "row int, range int, block int, n int, slots binary, counts binary"
REPLY = "row int, range int, block int, n int, levels binary"


class Ranges(NamedTuple):
    """Ranges of a sketch, and the bits of a slot's number within one."""

    count: int
    bits: int


def layout(total: int) -> tuple[int, int]:
    """(bytes of a block, items of a range) for that many bytes of text: ranges first, then blocks double until a message
    holds MESSAGE_ITEMS items or the memory of a task is the limit."""
    block, items = BLOCK_BYTES, RANGE_ITEMS
    while block // ITEM_BYTES * items < MESSAGE_ITEMS * (total // ITEM_BYTES):
        if items < MOST_RANGE:
            items *= 2
        elif block < MOST_BLOCK:
            block *= 2
        else:
            break
    return block, items


def in_blocks(docs: DataFrame, block_bytes: int | None = None, range_items: int | None = None) -> tuple[DataFrame, Ranges]:
    """(``docs`` with a column block, dealt by it; the ranges of a sketch of its items).

    Blocks are chosen by id and text. Rows without an id, which take no part in any sketch, are dealt anyhow."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    usual, items = layout(total)
    blocks = max(1, -(-total // (block_bytes or usual)))
    parts = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that no consumer deals it anew
    spread = F.coalesce("doc_id", F.monotonically_increasing_id())
    base = docs.withColumn("block", F.pmod(F.xxhash64(spread, "text"), F.lit(blocks)).cast("int")).repartition(parts, "block")
    items = range_items or items
    return base, Ranges(max(1, -(-(total // ITEM_BYTES) // items)), (items * SPREAD - 1).bit_length())


def _squeeze(a: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, size: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed byte planes of their gaps."""
    return _squeeze(np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_expand(data, 4 * n).reshape(4, -1).T).view(np.uint32)[:, 0], dtype=np.uint32)


def _slots(h: np.ndarray, ranges: Ranges):
    """Per row of the sketch: range and slot of each item as one number, sorted and without repeats; where each item is
    among them; how often each comes; where ranges start."""
    mask = np.uint64((1 << ranges.bits) - 1)
    for row in range(DEPTH):
        x = mix64(h + np.uint64((row + 1) * 0xA24BAED4963EE407 % (1 << 64)))
        keys = ((x >> np.uint64(32)) % np.uint64(ranges.count)) << np.uint64(32) | (x & mask)
        keys, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        yield row, keys, back, counts, np.searchsorted(keys, np.arange(ranges.count + 1, dtype=np.uint64) << np.uint64(32))


def partial_sketch(block: int, h: np.ndarray, ranges: Ranges):
    """Rows PARTIAL of one block's items ``h`` (64-bit hashes, each once per document)."""
    import pyarrow as pa

    out = []
    for row, keys, _, counts, cuts in _slots(h, ranges):
        for r in np.flatnonzero(np.diff(cuts)):
            k, c = keys[cuts[r] : cuts[r + 1]] & np.uint64(0xFFFFFFFF), counts[cuts[r] : cuts[r + 1]]
            out.append((row, int(r), block, len(k), _pack(k), _squeeze(np.minimum(c, 255).astype(np.uint8))))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["row", "range", "block", "n", "slots", "counts"])


def merged_replies(partial: DataFrame, ranges: Ranges) -> DataFrame:
    """Rows REPLY from rows PARTIAL."""
    import pyarrow as pa

    def merge(table: pa.Table) -> pa.Table:
        messages = [table.column(c) for c in ("n", "slots", "counts")]
        sums = np.zeros(1 << ranges.bits, np.uint8)
        for n, packed, counts in zip(*messages, strict=True):
            at = _unpack(packed.as_py(), n.as_py())
            sums[at] = np.minimum(sums[at].astype(np.uint16) + _expand(counts.as_py(), n.as_py()), 255)
        levels = [_squeeze(sums[_unpack(p.as_py(), n.as_py())]) for n, p in zip(*messages[:2], strict=True)]
        return pa.table([*(table.column(c) for c in ("row", "range", "block", "n")), pa.array(levels, pa.binary())], ["row", "range", "block", "n", "levels"])

    return partial.groupBy("row", "range").applyInArrow(merge, REPLY)


def levels_of(h: np.ndarray, replies, ranges: Ranges) -> np.ndarray:
    """Level of each of the block's items, from the block's replies."""
    told = {(row, r): (n, data) for row, r, n, data in zip(*(replies.column(c).to_pylist() for c in ("row", "range", "n", "levels")), strict=True)}
    out = np.full(len(h), 255, np.uint8)
    for row, keys, back, _, cuts in _slots(h, ranges):
        level = np.zeros(len(keys), np.uint8)
        for r in np.flatnonzero(np.diff(cuts)):
            n, data = told[row, int(r)]
            assert n == cuts[r + 1] - cuts[r], "a block read other rows the second time"
            level[cuts[r] : cuts[r + 1]] = _expand(data, n)
        out = np.minimum(out, level[back])
    return out
