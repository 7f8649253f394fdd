"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder stands in for it in local mode (tests, a single machine); on a
    cluster there is no folder that all can read, and an error says so.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return f"file://{_OWN_DIRS[app]}"


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that the innermost ``scratch`` (``keep``: the one around it) owns, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for own in _SCRATCH[: len(_SCRATCH) - keep][-1:]:
        own.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Paths taken inside are deleted on leaving, but for those taken with ``keep``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    Outside of any ``scratch`` the table stays, as results that haven't run yet read it; the folder's owner clears it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in this many rows is hot; so there are at most as many hot keys.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, n_rows: int, count: str) -> DataFrame:
    """``rows`` left-joined with ``table``, one row per key with the number of rows of that key in ``count``.

    Rows of hot keys aren't dealt by key: the table's rows for these, at most HOT_SHARE, are broadcast."""
    limit = max(1, n_rows // HOT_SHARE)
    marked = rows.join(F.broadcast(table.where(F.col(count) > limit)), key, "left")
    rest = marked.where(F.col(count).isNull()).select(*rows.columns)
    cold = rest.join(table.where(F.col(count) <= limit), key, "left")
    return marked.where(F.col(count).isNotNull()).unionByName(cold)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that no training row comes from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def hashed_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the id, in that order (column ``_h``).

    A threshold on the hash leaves about twice as many rows, so tasks send no more than that between them."""
    n, h = rows.count(), F.xxhash64(id_col)
    if n > 4 * most:
        rows = rows.where(h < int(2 * most / n * 2**64) - 2**63)
    return rows.withColumn("_h", h).orderBy("_h").limit(most)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Seeds of the two word hashes; words of more than LONG_WORD bytes are hashed by BLAKE2b, one by one.
SEEDS = (0xB4C7D1F3A95E6A2D, 0x9D3F5E2BC16A8475)
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _hash_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: int) -> list[np.ndarray]:
    """64-bit hashes of data[start:stop]: eight bytes at a time are mixed into the state, which starts from the length."""
    size = stop - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = [mix64(size.astype(np.uint64) + np.uint64(seed)) for seed in SEEDS[:hashes]]
    todo, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        chunk = eight[start[todo] + done] & _LOW_BYTES[np.minimum(size[todo] - done, 8)]
        for h in out:
            h[todo] = mix64(h[todo] ^ chunk)
        done += 8
        todo = todo[size[todo] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        digest = np.frombuffer(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=16).digest(), np.uint64)
        for h, x in zip(out, digest, strict=False):
            h[i] = x
    return out


def words_of(data: np.ndarray, ends: np.ndarray, lower: bool = False, hashes: int = 1):
    """Words of texts that lie end to end in ``data`` (UTF-8 bytes).

    ``ends[i]`` is where text i ends. A word is a maximal run of bytes outside ASCII white space and lies within
    one text. Returns (start, stop, text index, [hash, ...]) of every word, all as arrays. Hashes choose candidates;
    equality of words is decided on the words (or a cryptographic digest of them).
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, [np.zeros(0, np.uint64) for _ in range(hashes)]
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[ends[ends < n]] = True  # a text starts here
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    start = np.flatnonzero(begin)
    close = word.copy()
    close[:-1] &= ~word[1:] | edge[1:n]
    stop = np.flatnonzero(close) + 1
    text = np.searchsorted(ends, start, side="right")
    return start, stop, text, _hash_words(data, start, stop, hashes)


def windows_of(text: np.ndarray, hashes: list[np.ndarray], k: int):
    """Every k consecutive words of one text: (index of the first word, [hash per base])."""
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in hashes]
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    out = []
    for h in hashes:
        acc = np.zeros(len(at), np.uint64)
        for j in range(k):
            acc = (acc + h[at + j]) * np.uint64(0xF1357AEA2E62A9C5)
            acc ^= acc >> np.uint64(31)
        out.append(mix64(acc))
    return at, out


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column of an Arrow batch, end to end, and where each value ends (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return d, o[1:] - o[0]


def slices(column, most: int = 2_000_000):
    """(first row, end row, bytes, ends) of consecutive parts of an Arrow string column; a part holds at most ``most``
    bytes or a single value, so the arrays built over it stay bounded."""
    data, ends = arrow_bytes(column)
    first, base = 0, 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield first, end, data[base : ends[end - 1]], ends[first:end] - base
        first, base = end, int(ends[end - 1])


def runs_of(mask: np.ndarray, ends: np.ndarray, least: int):
    """Maximal runs of ``mask`` within one text and of at least that length: (start, stop, text index)."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[ends[ends < n]] = True
    begin, close = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:n]
    close[:-1] &= ~mask[1:] | edge[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(close) + 1
    long = stop - start >= least
    start, stop = start[long], stop[long]
    return start, stop, np.searchsorted(ends, start, side="right")
