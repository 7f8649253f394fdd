"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

Encoding reads a text in chunks. Words are cut off as soon as no later character can change them, and the tokens of a
word are emitted as soon as no later byte can: for each prefix of a word the transducer keeps the last token of that
prefix's encoding (the one token that ends there and stands the neighbouring token beside it), and a boundary is stable
once the encodings of all prefixes that a later token could start from share it. How many bytes that takes at most
follows from the merge list (``sufficient_lookahead``). Words of more than OPEN_WORD characters are fed to the transducer
as they come, so memory beyond the row itself does not grow with the length of a word or text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose tokens are kept per Python worker; the results don't depend on it.
CACHED_WORDS = 500_000
#: Bytes of a chunk; characters after which an unfinished word is encoded as it comes.
CHUNK, OPEN_WORD = 1 << 16, 1 << 12

# The letters and numbers that Unicode 16.0 added to 15.1. The tokenizers library classifies by 16.0.
ADDED = {
    "L": "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3"
    " 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}


@cache
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@cache
def classes(top: int = sys.maxunicode) -> dict[str, str]:
    """Letters, numbers and white space among the characters up to ``top``, as the inside of a bracket expression."""
    added = {}
    for kind, ranges in ADDED.items():
        for r in ranges.split():
            first, _, last = r.partition("-")
            added |= dict.fromkeys(range(int(first, 16), int(last or first, 16) + 1), kind)
    found: dict[str, list[str]] = {"L": [], "N": []}
    kind, first = "", 0
    for code in range(top + 2):
        k = added.get(code) or unicodedata.category(chr(code))[0] if code <= top else ""
        if k != kind:
            if kind in found:
                found[kind].append(f"\\U{first:08x}-\\U{code - 1:08x}")
            kind, first = k, code
    white = "\t-\r \x85\xa0" + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" * (top > 255)
    return {"L": "".join(found["L"]), "N": "".join(found["N"]), "S": white}


@cache
def word_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """Contractions, letters, digits, other characters (each with a space before it at most), white space.

    Holds for texts of characters up to ``top``; the fewer character ranges, the faster it is.
    """
    letters, digits, white = classes(top).values()
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{white}{letters}{digits}]+|[{white}]+(?![^{white}])|[{white}]+")


@cache
def run_patterns() -> dict[str, re.Pattern]:
    """Runs of letters, numbers, white space, and (O) of all else."""
    c = classes()
    return {k: re.compile(f"[{v}]+") for k, v in c.items()} | {"O": re.compile(f"[^{''.join(c.values())}]+")}


def split_words(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return word_pattern().findall(text)
    return word_pattern(255).findall(text)


class Merges:
    """A vocabulary with its merge list, from the JSON text of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        model = json.loads(text)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda token: bytes(byte[c] for c in token)
        self.ids: dict[bytes, int] = {raw(t): i for t, i in model["model"]["vocab"].items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.born, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            new, a, b = self.ids[a + b], self.ids[a], self.ids[b]
            self.rank[a, b] = rank
            if self.born[new] < 0:
                self.born[new], self.left[new], self.right[new] = rank, a, b
        self.longest = max(map(len, self.ids))
        self.fitting: dict[int, bool] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes after a boundary that can still decide whether it stands.

        A merge (u, v) can be undone from its right by an earlier merge that takes v, or the piece at v's right end,
        as its left part; that one by a still earlier merge, and so on. The longest such chain, in bytes.
        """
        best: dict[int, int] = {}
        most = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            reach, piece = 0, b
            while True:
                reach = max(reach, best.get(piece, 0))
                if self.born[piece] < 0:
                    break
                piece = self.right[piece]
            reach += len(self.bytes[b])
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
        return most + self.longest

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is just (a, b): merges across the seam are looked for
        while the later-born of the two pieces at the seam is taken apart again and again."""
        key = a << 32 | b
        found = self.fitting.get(key)
        if found is None:
            x, y, limit = a, b, len(self.rank) + 1
            while found is None:
                if self.rank.get((x, y), limit) < limit:
                    found = False
                elif self.born[x] > self.born[y]:
                    limit, x = self.born[x], self.right[x]
                elif self.born[y] < 0:
                    found = True
                else:
                    limit, y = self.born[y] + 1, self.left[y]
            if len(self.fitting) > 500_000:
                self.fitting.clear()
            self.fitting[key] = found
        return found


class WordTransducer:
    """Tokens of one word, fed in pieces."""

    def __init__(self, merges: Merges, lookahead: int):
        self.m, self.lookahead = merges, lookahead
        self.data, self.last, self.start = b"", [-1], [0]

    def feed(self, piece: bytes) -> Iterator[int]:
        """Take bytes; yields the tokens that have become stable."""
        for at in range(0, len(piece), 4 * self.lookahead):
            self._extend(piece[at : at + 4 * self.lookahead])
            if len(self.data) >= 4 * self.lookahead:
                yield from self._emit(len(self.data))

    def _extend(self, piece: bytes) -> None:
        m, last, start, first = self.m, self.last, self.start, len(self.data) + 1
        token_of, known, fits = m.ids.get, m.fitting.get, m.fits
        self.data = data = self.data + piece
        for end in range(first, len(data) + 1):
            begin = end - 1
            while True:  # one token that ends here fits its neighbour; single bytes are tokens
                token = token_of(data[begin:end])
                if token is not None:
                    before = last[begin]
                    if before < 0:
                        break
                    ok = known(before << 32 | token)
                    if ok or (ok is None and fits(before, token)):
                        break
                begin -= 1
            last.append(token)
            start.append(begin)

    def _emit(self, end: int) -> Iterator[int]:
        """Emit up to the last boundary that all prefixes a later token could start from have in common."""
        live = set(range(max(0, end - self.m.longest), end + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.start[top])
        (stable,) = live
        yield from self._back(stable)
        if stable:
            self.data = self.data[stable:]
            self.last = [self.last[stable], *self.last[stable + 1 :]]
            self.start = [0, *(s - stable for s in self.start[stable + 1 :])]

    def _back(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end])
            end = self.start[end]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._back(len(self.data))


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, text: str):
        self.m = Merges(text)
        self.lookahead = self.m.sufficient_lookahead()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.m.special, key=len, reverse=True))) + ")") if self.m.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.names = list(map(str, range(len(self.m.bytes))))

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of one word. Words of ordinary length are remembered."""
        found = self.words.get(word)
        if found is None:
            data = word.encode()
            t = WordTransducer(self.m, self.lookahead)
            found = (*t.feed(data), *t.finish())
            if len(data) <= 64:
                if len(self.words) >= CACHED_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def words_of(self, found: list[str]) -> list[int]:
        words, missing = self.words, self.word
        return list(chain.from_iterable([words[w] if w in words else missing(w) for w in found]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_stream([text])))

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Tokens of a text that comes in chunks, in parts as they become stable."""
        encoder = TextTransducer(self)
        for c in chunks:
            yield from encoder.feed(c)
        yield from encoder.finish()

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self)
        return d.feed(ids) + d.finish()


class TextTransducer:
    """Tokens of one text, fed in chunks.

    Held back are what could begin a special token, the last word, and an apostrophe before it (it may become a
    contraction). A long last word is open: its characters go to a transducer of its own as they come."""

    def __init__(self, codec: Codec):
        self.codec, self.specials = codec, codec.specials
        self.keep = max(map(len, codec.m.special), default=1) - 1
        self.rest, self.tail = "", ""
        self.open: WordTransducer | None = None
        self.kind, self.white = "", ""

    def feed(self, chunk: str) -> Iterator[list[int]]:
        self.rest += chunk
        yield from self._until_special()
        cut = len(self.rest) - self.keep
        if cut > 0:
            piece, self.rest = self.rest[:cut], self.rest[cut:]
            yield from self._text(piece, False)

    def finish(self) -> Iterator[list[int]]:
        yield from self._until_special()
        yield from self._text(self.rest, True)
        self.rest = ""

    def _until_special(self) -> Iterator[list[int]]:
        while self.specials is not None and (found := self.specials.search(self.rest)):
            yield from self._text(self.rest[: found.start()], True)
            yield [self.codec.m.special[found[0]]]
            self.rest = self.rest[found.end() :]

    def _text(self, piece: str, last: bool) -> Iterator[list[int]]:
        """Take more of a text without special tokens; ``last``: nothing follows."""
        if self.open is not None:
            run = run_patterns()[self.kind].match(piece)
            end = run.end() if run else 0
            yield from self._into_open(piece[:end])
            if end == len(piece) and not last:
                return
            piece = piece[end:]
            if self.kind == "S" and piece:  # the last white space before a word belongs to it or stands alone
                piece = self.white + piece
            elif self.white:
                yield list(self.open.feed(self.white.encode()))
            yield self.open.finish()
            self.open, self.white = None, ""
        words = split_words(self.tail + piece)
        self.tail = ""
        if not last and words:
            held = words.pop()
            if len(held) > OPEN_WORD:
                yield self.codec.words_of(words)
                self.kind = next(k for k, r in run_patterns().items() if r.match(held[-1]))
                self.open = WordTransducer(self.codec.m, self.codec.lookahead)
                yield from self._into_open(held)
                return
            if words and words[-1] == "'":
                held = words.pop() + held
            self.tail = held
        yield self.codec.words_of(words)

    def _into_open(self, piece: str) -> Iterator[list[int]]:
        if self.kind == "S" and piece:
            piece = self.white + piece
            piece, self.white = piece[:-1], piece[-1]
        for at in range(0, len(piece), CHUNK):
            yield list(self.open.feed(piece[at : at + CHUNK].encode()))


class Decoder:
    """Bytes to text, token by token; incomplete characters wait, invalid ones become U+FFFD."""

    def __init__(self, codec: Codec):
        self.bytes = codec.m.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


_CODECS: dict[str, Codec] = {}


def codec_of(text: str) -> Codec:
    """The codec of a tokenizer file's text, built once per Python worker."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def _shared(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # one vocabulary file, on the driver; its size doesn't depend on the data
        return docs.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) per row. Null text: as empty, no ids. The ids of a row are held together, as a row is."""
    import pyarrow as pa

    model = _shared(docs, path)

    def run(batches):
        codec = codec_of(model.value)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text per row of ids. Null ids: empty text."""
    import pyarrow as pa

    model = _shared(encoded, path)

    def run(batches):
        codec = codec_of(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    encoded = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def chunks_of(value, size: int = CHUNK) -> Iterator[str]:
    """A string value of an Arrow column in pieces of about that many bytes (null: none), without a copy of the whole."""
    data, state = memoryview(value.as_buffer() or b""), codecs.getincrementaldecoder("utf-8")()
    for at in range(0, len(data), size):
        yield state.decode(data[at : at + size])


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256: encodes, then decodes the ids.

    Each text streams through the encoder, its tokens through the decoder, and both into running digests. One row per
    row, repeated rows included; null text as empty (no tokens); further columns are ignored; an empty table gives an
    empty result.
    """
    import pyarrow as pa

    model = _shared(docs, path)

    def run(batches):
        codec = codec_of(model.value)
        for b in batches:
            out = []
            for text in b.column(1):
                n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(codec)
                for ids in codec.encode_stream(chunks_of(text)):
                    if ids:
                        ids_sha.update(("," * (n > 0) + ",".join(map(codec.names.__getitem__, ids))).encode())
                        text_sha.update(decoder.feed(ids).encode())
                        n += len(ids)
                text_sha.update(decoder.finish().encode())
                out.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            n, i, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
