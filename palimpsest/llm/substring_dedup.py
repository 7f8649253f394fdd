"""Substring dedup: word windows that also start in a document with a smaller id are removed.

1. Documents are dealt into blocks. Each block makes a partial count-min sketch of its windows (one count per document),
   split into ranges of slots.
2. The partial sketches of a range are merged by addition. Each block learns, one bit per slot of its own, which slots
   reached two: an estimate is never below the true count, so no repeated window is lost. Nothing is broadcast.
3. Each block sends only the windows whose least estimate over all rows of the sketch is two or more, and of a window's
   documents within the block only the smallest. They are grouped by a 128-bit BLAKE2b digest of their words themselves;
   the block is told which of its windows start in a smaller document elsewhere. Larger documents of the same block
   need no message. The fast hashes that fill the sketch decide nothing: a collision there only sends a window more.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, windows_of, words_of
from palimpsest.llm.repeat_sketch import PARTIAL, in_blocks, levels_of, merged_replies, partial_sketch

#: Words of a window.
WINDOW = 13


class Block:
    """Words and windows of the documents of one block, always in the same order: by id, then text."""

    def __init__(self, table, window: int):
        import pyarrow as pa

        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        column = self.table.column("text")
        self.texts = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        ids = self.table.column("doc_id")
        known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.n_words, self.window = np.zeros(len(self.ids), np.int64), window
        texts, hashes, at, starts, stops, chars, base, lead = [], [], [], [], [], [], 0, 0
        for first, end, data, ends in slices(self.texts) if len(self.texts) else ():
            start, stop, text, (word,) = words_of(data, ends)
            self.n_words[first:end] = np.bincount(text, minlength=end - first)
            a, (h,) = windows_of(text, [word], window)
            at.append(a + base)
            texts.append(text[a] + first)
            hashes.append(h)
            starts.append(start + lead)
            stops.append(stop + lead)
            chars.append(data)
            base, lead = base + len(text), lead + len(data)
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)])
        self.at, self.text, self.h = join(at, np.int64), join(texts, np.int64), join(hashes, np.uint64)
        self.start, self.stop, self.chars = join(starts, np.int64), join(stops, np.int64), join(chars, np.uint8)
        use = known[self.text]
        if not use.all():  # documents without an id neither lose words nor make others lose some
            self.at, self.text, self.h = self.at[use], self.text[use], self.h[use]

    def once_per_document(self) -> np.ndarray:
        order = np.lexsort((self.ids[self.text], self.h))
        h, t = self.h[order], self.ids[self.text[order]]
        first = np.ones(len(order), bool)
        first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        return order[first]

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BLAKE2b of the words of each window, a space after each word."""
        size = self.stop - self.start
        first = np.cumsum(size + 1) - (size + 1)
        spaced = np.full(int((size + 1).sum()), 32, np.uint8)
        inside = np.ones(len(spaced), bool)
        inside[first + size] = False
        spaced[inside] = self.chars[np.repeat(self.start - (first - np.arange(len(first))), size) + np.arange(int(size.sum()))]
        data, end = spaced.tobytes(), np.append(first, len(spaced))
        a = self.at[which]
        raw = b"".join([blake2b(data[x:y], digest_size=16).digest() for x, y in zip(end[a].tolist(), end[a + self.window].tolist(), strict=True)])
        both = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def grouped(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(windows ``which`` sorted by digest and id, both halves of their digests, whether a digest starts there)."""
        x, y = self.digests(which)
        order = np.lexsort((self.ids[self.text[which]], y, x))
        which, x, y = which[order], x[order], y[order]
        first = np.ones(len(which), bool)
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return which, x, y, first

    def repeats(self) -> np.ndarray:
        """Windows whose hash occurs more than once in the block."""
        order = np.argsort(self.h, kind="stable")
        h = self.h[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:].copy()
        return np.sort(order[same])


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, range_items: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text per row.

    Words are runs of characters outside ASCII white space. Each word is removed that a window covers whose words also
    start in a document with a smaller id; kept words are joined by one space. Windows are judged on the input. Null
    and empty texts have no words. Rows without an id keep all words and don't count as occurrences; rows that share
    an id are one document. Ids are taken as longs. Further columns are ignored, whatever their names; an empty table
    gives an empty result. A block holds its texts and some 40 bytes per word of them; a text larger than a block is a
    block of its own, so the longest text decides the memory of its task.
    """
    import pyarrow as pa

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base, ranges = in_blocks(docs, block_bytes, range_items)

    def sketch(table: pa.Table) -> pa.Table:
        b = Block(table, window)
        return partial_sketch(table.column("block")[0].as_py(), b.h[b.once_per_document()], ranges)

    def pick(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["d1", "d2", "doc_id", "place"]
        b = Block(table, window) if len(table) else None
        if b is None or not len(b.at):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        which, x, y, first = b.grouped(np.flatnonzero(levels_of(b.h, replies, ranges) > 1))
        which = which[first]  # of a window's documents here, the smallest
        place = which | np.int64(table.column("block")[0].as_py()) << np.int64(32)
        return pa.table([pa.array(x[first]), pa.array(y[first]), pa.array(b.ids[b.text[which]]), pa.array(place)], names)

    def larger(batches):
        """Of rows sorted by window and id: the places of those whose window came with a smaller id."""
        last, lowest = None, 0
        for b in batches:
            d1, d2, ids, place = (b.column(i).to_numpy() for i in range(4))
            if not len(ids):
                continue
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            fresh[0] = last != (d1[0], d2[0])
            low = np.concatenate([[lowest], ids[np.flatnonzero(fresh)]])[np.cumsum(fresh)]
            last, lowest = (d1[-1], d2[-1]), low[-1]
            place = place[ids > low]
            yield pa.RecordBatch.from_arrays([pa.array((place >> 32).astype(np.int32)), pa.array((place & 0xFFFFFFFF).astype(np.int32))], ["block", "at"])

    def strip(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        if not len(table):
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], names)
        b = Block(table, window)
        hit = np.zeros(len(b.at), bool)
        hit[told.column("at").to_numpy()] = True
        which, _, _, first = b.grouped(b.repeats())
        if len(which):
            group, ids = np.cumsum(first) - 1, b.ids[b.text[which]]
            # larger documents than the smallest here, and all if the smallest has a smaller one elsewhere
            hit[which] |= (ids > ids[first][group]) | np.logical_or.reduceat(hit[which], np.flatnonzero(first))[group]
        cover = np.zeros(len(b.start) + 1, np.int32)
        np.add.at(cover, b.at[hit], 1)
        np.add.at(cover, b.at[hit] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])
        ends = np.cumsum(b.n_words)
        n_removed = upto[ends] - upto[ends - b.n_words]
        kept = []
        for i, text in enumerate(b.texts):
            words = (text.as_py() or "").encode().split()
            if n_removed[i]:
                stay = np.flatnonzero(~gone[ends[i] - b.n_words[i] : ends[i]])
                words = [words[j] for j in stay]
            kept.append(b" ".join(words).decode())
        return pa.table([b.table.column("doc_id"), pa.array(b.n_words), pa.array(n_removed), pa.array(kept, pa.string())], names)

    replies = merged_replies(base.groupBy("block").applyInArrow(sketch, PARTIAL), ranges)
    seen = base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(pick, "d1 long, d2 long, doc_id long, place long")
    told = seen.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "doc_id").mapInArrow(larger, "block int, at int")
    return base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string")
