"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text with a probability per language; a document's probabilities are the mean over the
bytes of its letters. Texts are read in windows that overlap by a margin on either side, and each byte is labelled
in the window where it has the margin around it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from palimpsest.llm.common import held_out, slices
from palimpsest.llm.gru import Adam, BiGRU, one_thread

#: Most labelled documents that the network learns from, taken by the order of a hash of the id within each language, and
#: the longest text (in bytes) among them, so at most 40 MB come to the driver.
TRAIN_DOCS, TRAIN_BYTES = 1200, 1 << 15
HIDDEN = 8
#: Bytes of a window that are labelled, and the margin on either side.
CORE, MARGIN = 224, 16
PAD = 256

_LETTER = np.zeros(257, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True


class ByteTagger:
    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, k = labels, HIDDEN
        self.table = (rng.standard_normal((2, 3 * k, 257)) * 0.5).astype(np.float32)
        self.table[:, :, PAD] = 0
        self.gru = BiGRU(k, rng)
        self.w = (rng.standard_normal((len(labels), 2 * k)) * 0.3).astype(np.float32)
        self.b = np.zeros((len(labels), 1), np.float32)

    def _logits(self, states: np.ndarray) -> np.ndarray:
        """(label, step, batch) from states (step, direction, unit, batch)."""
        steps, _, k, batch = states.shape
        out = np.empty((steps, len(self.labels), batch), np.float32)
        np.matmul(self.w[:, :k], states[:, 0], out=out)
        out += np.matmul(self.w[:, k:], states[::-1, 1])
        out += self.b
        return out.transpose(1, 0, 2)

    def fit(self, texts: list[bytes], y: list[int], steps: int = 500, batch: int = 96, length: int = 64, seed: int = 6) -> None:
        """Adam on the cross-entropy of every position of random windows of the sample."""
        rng = np.random.default_rng(seed)
        use = [(np.frombuffer(t, np.uint8), label) for t, label in zip(texts, y, strict=True) if t]
        by_label = [[t for t, label in use if label == i] for i in range(len(self.labels))]
        present = [i for i, t in enumerate(by_label) if t]
        if not present:
            return
        adam, k = Adam([self.table, self.gru.u, self.w, self.b], 0.02), HIDDEN
        for step in range(steps):
            idx, target = np.full((length, batch), PAD, np.int64), np.empty(batch, np.int64)
            for j in range(batch):
                target[j] = present[j % len(present)]
                pool = by_label[target[j]]
                t = pool[rng.integers(len(pool))]
                at = rng.integers(max(1, len(t) - length + 1))
                piece = t[at : at + length]
                idx[: len(piece), j] = piece
            both = np.stack([idx, idx[::-1]], 1)
            x = np.stack([self.table[d][:, both[:, d]].transpose(1, 0, 2) for d in (0, 1)], 1)
            hs, kept = self.gru.train_run(x)
            p = self._softmax(self._logits(hs[1:]).copy())
            mask = _LETTER[idx]
            p[target, :, np.arange(batch)] -= 1
            p *= mask / max(1, mask.sum())
            flat = p.reshape(len(p), -1)
            f, r = hs[1:, 0], hs[:0:-1, 1]
            dw = np.concatenate([flat @ f.transpose(0, 2, 1).reshape(-1, k), flat @ r.transpose(0, 2, 1).reshape(-1, k)], 1)
            dout = np.stack([np.einsum("ltb,lk->tkb", p, self.w[:, :k]), np.einsum("ltb,lk->tkb", p[:, ::-1], self.w[:, k:])], 1)
            dx, du = self.gru.backward(hs, kept, dout.astype(np.float32))
            dt = np.zeros_like(self.table)
            for d in (0, 1):
                hot = np.zeros((length * batch, 257), np.float32)
                hot[np.arange(length * batch), both[:, d].ravel()] = 1
                dt[d] = dx[:, d].transpose(1, 0, 2).reshape(3 * k, -1) @ hot
            dt[:, :, PAD] = 0
            adam.step([dt, du, dw.astype(np.float32), flat.sum(1, keepdims=True)], 1 - 0.9 * step / steps)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    def label_bytes(self, idx: np.ndarray) -> np.ndarray:
        """Probabilities (label, position, window) of the bytes ``idx`` (position, window)."""
        both = (idx, np.ascontiguousarray(idx[::-1]))

        def inputs(t, out):
            for d in (0, 1):
                np.take(self.table[d], both[d][t], axis=1, out=out[d], mode="clip")

        return self._softmax(self._logits(self.gru.run(inputs, *idx.shape)).copy())

    def pooled(self, data: np.ndarray, ends: np.ndarray, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean probabilities over the bytes of letters (text, label), and how many such bytes there are."""
        starts = np.concatenate([[0], ends[:-1]])
        n = -(-(ends - starts) // CORE)
        text = np.repeat(np.arange(len(ends)), n)
        core = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * CORE
        total, count = np.zeros((len(ends), len(self.labels))), np.zeros(len(ends), np.int64)
        offset = np.arange(-MARGIN, CORE + MARGIN)
        for a in range(0, len(text), batch):
            c, doc = core[a : a + batch], text[a : a + batch]
            at = c[None, :] + offset[:, None]
            inside = (at >= starts[doc]) & (at < ends[doc])
            idx = np.where(inside, data[np.clip(at, 0, len(data) - 1)], PAD)
            last = inside.any(1).nonzero()[0].max() + 1
            p = self.label_bytes(idx[:last])[:, MARGIN : MARGIN + CORE]
            mask = _LETTER[idx[MARGIN : min(last, MARGIN + CORE)]]
            p = p * mask
            np.add.at(total, doc, p.sum(1).T)
            np.add.at(count, doc, mask.sum(0))
        return total / np.maximum(count, 1)[:, None], count


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = TRAIN_DOCS) -> ByteTagger | None:
    """Learn from at most ``most`` labelled rows outside the held-out fold, of TRAIN_BYTES at most; None if there are none.

    One pass counts the rows of each language, another takes those whose hash is small enough."""
    label, h = F.col(label_col), F.xxhash64(id_col)
    rows = docs.where(label.isNotNull() & (F.octet_length(text_col) <= TRAIN_BYTES) & ~held_out(id_col)).select(label.alias("y"), F.col(text_col).alias("t"), h.alias("h"))
    counts = dict(rows.groupBy("y").count().collect())  # a row per language
    labels = sorted(counts)
    if not labels:
        return None
    each = -(-most // len(labels))
    few = F.lit(False)
    for name, n in counts.items():  # about twice as many as are wanted
        few = few | ((F.col("y") == name) & (F.lit(True) if n <= 4 * each else F.col("h") < int(2 * each / n * 2**64) - 2**63))
    first = F.row_number().over(W.partitionBy("y").orderBy("h", "t"))
    taken = rows.where(few).withColumn("k", first).where(F.col("k") <= each).collect()
    at = {name: i for i, name in enumerate(labels)}
    sample = [(r["t"].encode(), at[r["y"]]) for r in sorted(taken, key=lambda r: (r["y"], r["k"]))]
    model = ByteTagger(labels)
    with one_thread():
        model.fit([t for t, _ in sample], [y for _, y in sample])
    return model


def identify(docs: DataFrame, model: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (``whole``: and the row itself, as a struct ``row``) per row: the likeliest language of the whole text and its pooled probability.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learnt. Of languages with equal
    probability the first by name is given. Repeated rows get equal results, columns besides the two are never read, an
    empty table gives an empty result. A text takes some 20 bytes of memory a byte while it is labelled.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names, scores = [], []
            for first, end, data, ends in slices(b.column(1)):
                p, count = model.pooled(data, ends) if model is not None and len(data) else (np.zeros((end - first, 1)), np.zeros(end - first))
                best = p.argmax(1)
                for i in range(end - first):
                    piece = data[(ends[i - 1] if i else 0) : ends[i]]
                    known = count[i] > 0 and (bool((_LETTER[piece] & (piece < 128)).any()) or any(map(str.isalpha, b.column(1)[first + i].as_py())))
                    names.append(model.labels[best[i]] if known else "und")
                    scores.append(float(p[i, best[i]]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *passed, "lang_pred", "score"])

    rest = [c for c in docs.columns if c != text_col] if whole else []
    passed = ["text", *["rest"][: len(rest)]]
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.struct(*rest).alias("rest")][: len(rest)])
    schema = T.StructType([*given.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = given.mapInArrow(run, schema)
    if not whole:
        return out.select("doc_id", "lang_pred", "score")
    return out.select("doc_id", "lang_pred", "score", F.struct(*[(F.col("text") if c == text_col else F.col("rest")[c]).alias(c) for c in docs.columns]).alias("row"))
