"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word (a run of letters, A-Z lower-cased) enters as the sum of two hashed embeddings: one of the whole word and the mean
of those of its character n-grams. The network reads overlapping windows of words, attention pools the states of a window
into one logit, and a document's logit is the log-sum-exp over all its windows, so one bad passage suffices however long
the rest is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import hashed_sample, held_out, mix64, runs_of, slices, words_of
from palimpsest.llm.gru import Adam, BiGRU, one_thread

#: Most labelled documents per label that the network learns from, by the order of a hash of the id, and the longest text
#: (in bytes) among them, so at most 105 MB come to the driver.
TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_BYTES = 900, 2400, 1 << 15
HIDDEN, EMBED = 12, 12
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 24
WORD_SLOTS, GRAM_SLOTS = 1 << 13, 1 << 14
GRAM = 4
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, ends: np.ndarray):
    """(word slots, gram slots of all words end to end, first gram of each word, windows as (text, first word, words)).

    Grams are all GRAM bytes in a row of a word with a mark before and after it."""
    data = _LOWER[data]
    start, stop, text = runs_of(_LETTER[data], ends, 1)
    n = len(start)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, (z, z, z)
    # the words again, each with a space on either side
    size = stop - start
    first = np.cumsum(size + 2) - (size + 2)
    marked = np.full(int((size + 2).sum()), 32, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    marked[at + np.repeat(first + 1, size)] = data[at + np.repeat(start, size)]
    words = words_of(marked, np.array([len(marked)]))[3][0]
    code = marked.astype(np.uint64)
    gram = code[: 1 - GRAM].copy() if len(code) >= GRAM else np.zeros(0, np.uint64)
    for j in range(1, GRAM):
        gram = gram * np.uint64(257) + code[j : len(code) - GRAM + 1 + j]
    grams = np.maximum(size + 2 - GRAM + 1, 1)
    g_first = np.cumsum(grams) - grams
    g_at = np.repeat(first - g_first, grams) + np.arange(int(grams.sum()))
    slots = (mix64(gram[np.minimum(g_at, len(gram) - 1)]) % np.uint64(GRAM_SLOTS)).astype(np.int64) if len(gram) else np.zeros(len(g_at), np.int64)
    count = np.bincount(text, minlength=len(ends))
    windows = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    w_text = np.repeat(np.arange(len(ends)), windows)
    nth = np.arange(len(w_text)) - np.repeat(np.cumsum(windows) - windows, windows)
    w_first = (np.cumsum(count) - count)[w_text] + nth * STRIDE
    w_size = np.minimum(WINDOW, count[w_text] - nth * STRIDE)
    return (words % np.uint64(WORD_SLOTS)).astype(np.int64), slots, g_first, (w_text, w_first, w_size)


class WindowScorer:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        k = HIDDEN
        self.word = (rng.standard_normal((WORD_SLOTS, EMBED)) * 0.1).astype(np.float32)
        self.gram = (rng.standard_normal((GRAM_SLOTS, EMBED)) * 0.3).astype(np.float32)
        self.into = (rng.standard_normal((EMBED, 6 * k)) * 0.6).astype(np.float32)
        self.gru = BiGRU(k, rng)
        self.att = (rng.standard_normal((2 * k, 1)) * 0.3).astype(np.float32)
        self.out = (rng.standard_normal((2 * k, 1)) * 0.3).astype(np.float32)
        self.bias = np.full((1, 1), -4.0, np.float32)
        self.constant: float | None = 0.0  # the score of all texts where there was nothing to tell apart

    def embed(self, words, grams, g_first):
        size = np.diff(np.append(g_first, len(grams)))
        return self.word[words] + np.add.reduceat(self.gram[grams], g_first) / size[:, None].astype(np.float32)

    def inputs(self, e: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """(step, direction, 3 * unit, window) for the words ``at`` (step, window); 0 outside a window."""
        p = e @ self.into
        k3 = self.into.shape[1] // 2
        x = np.empty((len(at), 2, k3, at.shape[1]), np.float32)
        x[:, 0] = (p[:, :k3][at] * inside[..., None]).transpose(0, 2, 1)
        x[:, 1] = (p[:, k3:][at[::-1]] * inside[::-1][..., None]).transpose(0, 2, 1)
        return x

    def pool(self, states: np.ndarray, inside: np.ndarray):
        """Attention over the words of each window: (logits, weights, states (step, window, 2 * unit))."""
        s = np.concatenate([states[:, 0], states[::-1, 1]], 1).transpose(0, 2, 1)
        a = (s @ self.att)[..., 0]
        a = np.exp(np.where(inside, a - np.where(inside, a, -1e9).max(0), -1e9))
        a /= a.sum(0)
        return np.einsum("tw,tw->w", a, (s @ self.out)[..., 0]) + self.bias[0, 0], a, s

    @staticmethod
    def places(first: np.ndarray, size: np.ndarray):
        step = np.arange(WINDOW)[:, None]
        inside = step < size[None, :]
        return np.where(inside, first[None, :] + step, 0), inside

    def logits(self, data: np.ndarray, ends: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Log-sum-exp over all windows of each text; -inf without words."""
        words, grams, g_first, (text, first, size) = features(data, ends)
        out = np.full(len(ends), -np.inf)
        if not len(words):
            return out
        p = self.embed(words, grams, g_first) @ self.into
        k3, step = p.shape[1] // 2, np.arange(WINDOW)[:, None]
        p = np.concatenate([p, np.zeros((1, 2 * k3), np.float32)])
        halves = p[:, :k3].copy(), p[:, k3:].copy()
        each = np.empty(len(text))
        for a in range(0, len(text), batch):
            f, n = first[a : a + batch], size[a : a + batch]
            inside = step < n[None, :]
            at = np.where(inside, f[None, :] + step, len(p) - 1)

            def inputs(t, x, at=at):
                x[0] = halves[0][at[t]].T
                x[1] = halves[1][at[WINDOW - 1 - t]].T

            each[a : a + batch] = self.pool(self.gru.run(inputs, WINDOW, len(f)), inside)[0]
        np.logaddexp.at(out, text, each)
        return out

    def fit(self, texts: list[bytes], y: list[int], epochs: int = 5, docs: int = 24, seed: int = 4) -> None:
        rng, k = np.random.default_rng(seed), HIDDEN
        use = [i for i, t in enumerate(texts) if t]
        y = np.array(y, np.float32)
        seen = set(y[use].tolist())
        self.constant = None if len(seen) > 1 else max(seen, default=0.0)
        if self.constant is not None:
            return
        epochs = max(epochs, min(40, 5000 // len(use)))
        adam, total = Adam([self.word, self.gram, self.into, self.gru.u, self.att, self.out, self.bias], 0.01), epochs * -(-len(use) // docs)
        for epoch in range(epochs):
            order = rng.permutation(use)
            for b in range(0, len(order), docs):
                pick = order[b : b + docs]
                ends = np.cumsum([len(texts[i]) for i in pick])
                words, grams, g_first, (text, first, size) = features(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), ends)
                if not len(words):
                    continue
                e = self.embed(words, grams, g_first)
                at, inside = self.places(first, size)
                hs, kept = self.gru.train_run(self.inputs(e, at, inside))
                logit, a, s = self.pool(hs[1:], inside)
                doc = np.full(len(pick), -np.inf)
                np.logaddexp.at(doc, text, logit)
                prob = 1 / (1 + np.exp(-np.clip(doc, -30, 30)))
                share = np.exp(logit - doc[text])
                dlogit = ((prob - y[pick])[text] * share / len(pick)).astype(np.float32)
                value = (s @ self.out)[..., 0]
                da = a * (value - (a * value).sum(0)) * dlogit
                ds = (a * dlogit)[..., None] * self.out[:, 0] + da[..., None] * self.att[:, 0]
                flat = s.reshape(-1, 2 * k)
                d_out, d_att = flat.T @ (a * dlogit).reshape(-1, 1), flat.T @ da.reshape(-1, 1)
                ds = ds.transpose(0, 2, 1)
                dx, du = self.gru.backward(hs, kept, np.stack([ds[:, :k], ds[::-1, k:]], 1).astype(np.float32))
                d_in = np.concatenate([dx[:, 0].transpose(0, 2, 1), dx[::-1, 1].transpose(0, 2, 1)], 2) * inside[..., None]
                dp = self._gather(at.ravel(), d_in.reshape(-1, 6 * k), len(words))
                de = dp @ self.into.T
                sizes = np.diff(np.append(g_first, len(grams)))
                dg = np.repeat(de / sizes[:, None], sizes, axis=0)
                grads = [self._gather(words, de, WORD_SLOTS), self._gather(grams, dg, GRAM_SLOTS), e.T @ dp, du, d_att, d_out, dlogit.sum().reshape(1, 1)]
                adam.step([g.astype(np.float32) for g in grads], 1 - 0.95 * adam.t / total)

    @staticmethod
    def _gather(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        """Sums of the rows of each place."""
        out = np.zeros((size, rows.shape[1]), np.float32)
        order = np.argsort(at, kind="stable")
        at, rows = at[order], rows[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        if len(first):
            out[at[first]] = np.add.reduceat(rows, first)
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> WindowScorer:
    """Learn from at most TRAIN_POSITIVE and TRAIN_NEGATIVE labelled rows outside the held-out fold, of TRAIN_BYTES at most.

    Of ids that occur more than once the rows count one by one, within the same bounds. Labels other than 0 and 1 are
    left out."""
    labels = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.octet_length("_t") <= TRAIN_BYTES)
    rows = []
    for y, most in ((1, TRAIN_POSITIVE), (0, TRAIN_NEGATIVE)):
        part = hashed_sample(labels.where(F.col("_y") == y), "_id", most)
        found = short.join(F.broadcast(part), "_id")  # at most ``most`` rows
        rows += [(r["_h"], r["_t"], y) for r in found.orderBy("_h", "_t").limit(most).collect()]
    rows.sort()
    model = WindowScorer()
    with one_thread():
        model.fit([t.encode() for _, t, _ in rows], [y for _, _, y in rows])
    return model


def score_toxicity(docs: DataFrame, model: WindowScorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) per row, over every window of the whole text.

    Texts that are null or without letters get 0. Where no row was labelled every score is 0, and where all labels were
    equal it is that label. Repeated rows get equal scores, columns besides the two are never read, an empty table
    gives an empty result. A text takes some 100 bytes of memory a word while it is scored.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            scores = []
            for _, _, data, ends in slices(b.column(1)):
                if model.constant is not None:
                    scores.append(np.full(len(ends), model.constant))
                    continue
                logits = model.logits(data, ends) if len(data) else np.full(len(ends), -np.inf)
                scores.append(np.where(np.isfinite(logits), 1 / (1 + np.exp(-np.clip(logits, -700, 700))), 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["doc_id", "score"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
