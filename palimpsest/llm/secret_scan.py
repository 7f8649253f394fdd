"""Secret scans: patterns for known forms, and character Markov models for the rest.

Two Markov chains of order 2 over the characters of tokens are trained from labelled samples, one from random strings and
one from ordinary identifiers. Of each run of token characters the part with the greatest sum of log-likelihood ratios is
judged, so a key within a path or dotted name counts by itself; it is reported, up to the next separators, where that
sum, and the mean per character, exceeds thresholds set on a held-out part of the samples.
"""

from __future__ import annotations

import base64
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import hashed_sample, runs_of, slices

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Shortest token that the models judge.
LEAST = 16
#: Most documents of the corpus, the longest of them in bytes, and most words, that serve as further ordinary samples.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_WORDS = 1000, 1 << 16, 20_000

# Parts of ordinary identifiers, from which labelled samples are joined.
PARTS = """
    access account action active address admin agent alert api app archive array async auth backup base batch begin block
    body buffer build button byte cache call callback cancel cell channel char check child class clean clear client clock
    close cloud cluster code collect color column command comment commit config connect console content context control
    convert copy core count create current cursor data date debug decode default delete depth device dialog digest
    directory disk display document domain download driver dump edit element email enable encode engine entry error event
    export extend factory fetch field file filter find flag float folder format frame function gateway generate global
    graph group handle hash header height helper history host html image import index info init input insert instance
    integer item iterator join json kernel keyword label language layout length level library limit line link list load
    local lock logger login manager map mask master match matrix member memory menu merge message meta method metric
    minimum mode model module monitor mount name network node normal notify null number object offset open option order
    output owner package packet page panel param parent parse
""".split()

_CODE = np.full(256, -1, np.int16)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in "+/_.=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def labelled_samples(seed: int = 7, n: int = 12000) -> list[tuple[str, int]]:
    """(token, 1 if random): generated keys of usual alphabets, and names joined the usual ways."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size = rng.randint(LEAST, 64)
        kind = rng.randrange(5)
        if kind == 0:
            token = "".join(rng.choices("0123456789abcdef", k=size))
        elif kind == 1:
            token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=size))
        elif kind == 2:
            token = base64.b64encode(rng.randbytes(size * 3 // 4)).decode()
        elif kind == 3:
            token = base64.urlsafe_b64encode(rng.randbytes(size * 3 // 4)).decode().rstrip("=")
        else:
            token = "".join(rng.choices(SYMBOLS[:62], k=size))
        out.append((token, 1))
        words = rng.choices(PARTS, k=rng.randint(3, 6))
        style = rng.randrange(7)
        if style == 0:
            token = "_".join(words)
        elif style == 1:
            token = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 2:
            token = "_".join(words).upper()
        elif style == 3:
            token = rng.choice("-./").join(words).lower()
        elif style == 4:
            token = f"{words[0]}-{words[1]}-{rng.randint(0, 40)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}-20{rng.randint(10, 29)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        elif style == 5:
            token = "".join(words).lower()
        else:
            token = rng.choice(SYMBOLS) * size  # rules and fillers
        out.append((token, 0))
    return out


def corpus_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """Ordinary samples from the corpus: alphabetic words of 8 to 64 letters that at least two of at most SAMPLE_DOCS
    documents have, taken by the order of a hash of the id. A secret that stands in one document is none of them.
    Training samples only; every text is scanned whole."""
    rows = docs.where(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    words = hashed_sample(rows, "id", SAMPLE_DOCS).select("id", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(t, '\\b[A-Za-z]{8,64}\\b', 0)"))).alias("w"))
    usual = words.groupBy("w").agg(F.countDistinct("id").alias("n")).where("n > 1")
    return sorted(r["w"] for r in usual.orderBy(F.xxhash64("w")).limit(SAMPLE_WORDS).collect())


def best_part(upto: np.ndarray, start: int, stop: int) -> tuple[int, int]:
    """The part of start:stop, of at least LEAST places if there are as many, with the greatest sum; of equal ones the first
    to end, and of these the longest. ``upto[i]`` is the sum before place i."""
    least = min(LEAST, stop - start)
    lowest = np.minimum.accumulate(upto[start : stop - least + 1])
    gain = upto[start + least : stop + 1] - lowest
    end = int(gain.argmax())
    begin = int(upto[start : start + end + 1].argmin())
    return start + begin, start + least + end


class MarkovPair:
    """Log-likelihood ratios of order-2 chains, as one table over (two characters before, character)."""

    def __init__(self, samples: list[tuple[str, int]], smoothing: float = 1.0, lean: float = 12.0):
        k = len(SYMBOLS)
        train, rest = samples[: len(samples) * 4 // 5], samples[len(samples) * 4 // 5 :]
        flat = [[], []]
        for token, y in train:
            code = np.concatenate([[k, k], _CODE[np.frombuffer(token.encode(), np.uint8)]]).astype(np.int64)
            flat[y].append((code[:-2] * (k + 1) + code[1:-1]) * k + code[2:])
        log_p = []
        for part in flat:
            counts = np.bincount(np.concatenate([*part, np.zeros(0, np.int64)]), minlength=(k + 1) ** 2 * k).reshape(k + 1, k + 1, k).astype(float)
            # a context seldom seen leans on the one character before, and that one on single characters
            p = counts.sum((0, 1)) + smoothing
            for c in (counts.sum(0), counts):
                p = (c + lean * p / p.sum(-1, keepdims=True)) / (c.sum(-1, keepdims=True) + lean)
            log_p.append(np.log(p).reshape(-1, k))
        self.table = (log_p[1] - log_p[0]).astype(np.float32)
        found = [[self.best(t) for t, label in rest if label == y] or [(0.0, 1)] for y in (0, 1)]
        sums, means = (np.array([f(x, n) for x, n in found[0]]) for f in (lambda x, n: x, lambda x, n: x / n))
        self.least_sum = float(max(6.0, np.quantile(sums, 0.999)))
        self.least_mean = float(max(0.35, np.quantile(means[sums > 0.5 * self.least_sum], 0.9) if (sums > 0.5 * self.least_sum).any() else 0))
        self.caught = float(np.mean([self.random(x, n) for x, n in found[1]]))

    def random(self, total: float, size: int) -> bool:
        return total > self.least_sum and total > self.least_mean * size

    def best(self, token: str) -> tuple[float, int]:
        """(sum of ratios, characters) of the best part of a token."""
        data = np.frombuffer(token.encode(), np.uint8)
        upto = np.concatenate([[0], np.cumsum(self.ratios(data, np.zeros(1, np.int64)), dtype=np.float64)])
        a, b = best_part(upto, 0, len(data))
        return float(upto[b] - upto[a]), b - a

    def ratios(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The ratio at every byte; a token that begins at one of ``starts`` has no characters before it."""
        k = len(SYMBOLS)
        code = _CODE[data].astype(np.int64)
        one, two = np.full(len(data), k), np.full(len(data), k)
        one[1:], two[2:] = code[:-1], code[:-2]
        one[starts] = k
        two[starts] = k
        after = starts[starts + 1 < len(data)] + 1
        two[after] = k
        outside = (code < 0) | (one < 0) | (two < 0)
        r = self.table[np.where(outside, 0, two * (k + 1) + one), np.where(outside, 0, code)]
        r[outside] = 0
        return r


def train(extra_ordinary: list[str] = ()) -> MarkovPair:
    samples = labelled_samples() + [(w, 0) for w in extra_ordinary]
    random.Random(2).shuffle(samples)
    return MarkovPair(samples)


def base_spans(text: str, maybe_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the patterns' matches, leftmost and without overlaps per kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if maybe_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def find_secrets(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score), by start and kind; offsets in characters, end exclusive.

    One row per row. Null and empty texts have no spans; repeated rows are scanned each; columns besides the two are
    ignored; an empty table gives an empty result. A text takes some 40 bytes of memory a byte while it is scanned. Kinds assign, access and hex come from patterns (score null); markov
    spans are tokens the models call random and that touch no other span.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def part(texts, data, ends):
        found: list[list[tuple]] = [[] for _ in ends]
        hexed = set(runs_of(_HEX[data], ends, 24)[2].tolist())
        for i, t in enumerate(texts):
            if t:
                found[i] = [(s, k, e, None) for s, k, e in base_spans(t, i in hexed)]
        starts, stops, at = runs_of(_CODE[data] >= 0, ends, LEAST)
        if len(starts):
            r = model.ratios(data, starts)
            upto = np.concatenate([[0], np.cumsum(r, dtype=np.float64)])
            most = np.concatenate([[0], np.cumsum(np.maximum(r, 0), dtype=np.float64)])
            maybe = np.flatnonzero(most[stops] - most[starts] > model.least_sum)
            if len(maybe):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                first = chars[np.concatenate([[0], ends[:-1]])]
                for s, e, i in zip(starts[maybe].tolist(), stops[maybe].tolist(), at[maybe].tolist(), strict=True):
                    x, y = best_part(upto, s, e)
                    score = float(upto[y] - upto[x])
                    if not model.random(score, y - x):
                        continue
                    while x > s and not _SEPARATOR[data[x - 1]]:
                        x -= 1
                    while y < e and not _SEPARATOR[data[y]]:
                        y += 1
                    a, b = int(chars[x] - first[i]), int(chars[y] - first[i])
                    if all(b <= z[0] or z[2] <= a for z in found[i]):
                        found[i].append((a, 3, b, score))
        return [[{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(f, key=lambda y: y[:2])] for f in found]

    def run(batches):
        for b in batches:
            spans: list = []
            for first, end, data, ends in slices(b.column(1)):
                spans += part(b.column(1).slice(first, end - first).to_pylist(), data, ends)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,`end`:bigint,score:double>>"
    return docs.mapInArrow(run, schema)
