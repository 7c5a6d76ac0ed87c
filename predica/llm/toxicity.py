"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters by two learned channels and by evidence. The word channel is an embedding of the whole word (one of its
own for words of MIN_DOCS training documents or more, at most MAX_WORDS; a shared one for the others); the character channel
is the mean of the embeddings of its character n-grams (3 to 6 bytes, with marks at the word's ends), in a hashed table.
Evidence is what the labels say of the word and of its n-grams (the largest, mean and least): the signed log of the root of
the log-likelihood ratio of a feature's presence in toxic against other documents, in hashed tables; it makes up for
embeddings where there is little to learn them from. Two GRUs read a window of words in either direction, attention pools
their states, and a logistic output scores the window: nothing but the states reaches it. All windows of a text are scored,
each overlapping the next; the text's score is that of its highest window, calibrated for the number of windows.

Training sees labelled rows whose crc32(id as text) mod 4 isn't 2, at most MAX_TOXIC and MAX_CLEAN documents of each
class, those least by a hash of the id, one text for each id, and of these the texts of at most MAX_CHARS characters; the
bounds hold before texts are collected. Evidence for a training document comes from the other folds, so the network never
sees a document's own label in it. Only documents are labelled: a toxic document's examples are the window of most evidence
at first, later the one that scores highest; a clean one's are that window and another. Words are at times hidden in
training, so that their characters are learned too; a window's embeddings or its evidence are, so that either does alone.

Scale: labels are cut to the bounded sample before they meet the texts; scoring is one map. The model is a few MB at any
size. Defined cases: null text is empty; a text without words is one window of padding and so gets a score; null labels
and null ids aren't trained on; a document with several labels is toxic if one says so, one with several texts is trained
on by the least; without any toxic or clean training document every score is the share of toxic ones (0 without any); an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 20_000
WINDOW, STRIDE = 48, 32
HIDDEN = 8
EPOCHS = 10
GRAMS = range(3, 7)
#: Width of the embeddings of words and of n-grams; number of the latter.
WORD_DIM, GRAM_DIM, GRAM_BITS = 8, 8, 15
LEARNED, EVIDENCE = WORD_DIM + GRAM_DIM, 4
INPUTS = LEARNED + EVIDENCE
MIN_DOCS, MAX_WORDS = 3, 1 << 16
#: Evidence tables have 2**TABLE_BITS entries; training documents are in FOLDS parts.
TABLE_BITS, FOLDS = 18, 4
#: Shares of the known words, of the windows' embeddings and of their evidence that training hides.
HIDDEN_WORDS, HIDDEN_WINDOWS, HIDDEN_EVIDENCE = 0.4, 0.65, 0.2
#: Batches that an epoch has at least.
LEAST_BATCHES = 16
THRESHOLD = 0.3
#: So many words' inputs are remembered between batches; windows of a text that are read, and windows that are scored, together.
CACHE_WORDS, BLOCK_WINDOWS, BATCH = 200_000, 1 << 12, 1 << 10
#: Words whose n-grams are made together.
PART = 20_000
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint32(2654435761)) ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - TABLE_BITS)


class _Grams:
    """Character n-grams of words, as buckets of the evidence tables; the first GRAM_BITS bits are those of embeddings."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.bytes = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        powers = np.cumprod(np.full(64, 16777619, np.uint32), dtype=np.uint32)
        at = np.arange(len(self.bytes)) - np.repeat(self.starts, self.lengths)
        #: Each word's own bucket.
        self.words = _bucket(np.add.reduceat((self.bytes + np.uint32(1)) * powers[at % 64] ^ (at // 64).astype(np.uint32), self.starts, dtype=np.uint32) if words else np.zeros(0, np.uint32))
        self.room = np.repeat(self.ends, self.lengths) - np.arange(len(self.bytes))  # bytes from here to the word's end

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, bucket) of the n-grams of each length."""
        h = np.zeros(len(self.bytes), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if n > len(self.bytes):
                return
            h = h[: len(self.bytes) - n + 1] * np.uint32(16777619) + self.bytes[n - 1 :]
            if n in GRAMS:
                at = np.flatnonzero(self.room[: len(h)] >= n)
                yield at, _bucket(h[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))

    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all words' n-grams, word after word; number of each word's)."""
        found = list(self)
        at = np.concatenate([a for a, _ in found])
        order = np.argsort(at, kind="stable")
        number = np.add.reduceat(np.bincount(at, minlength=len(self.bytes)), self.starts)
        return np.concatenate([b for _, b in found])[order].astype(np.int32), number


def _parts(words: list[bytes], size: int = PART) -> Iterator[tuple[int, _Grams]]:
    for at in range(0, len(words), size):
        yield at, _Grams(words[at : at + size])


def _evidence(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Signed log(1 + root of the log-likelihood ratio) of counts in toxic and clean documents."""
    share = toxic.sum() / max(1.0, toxic.sum() + clean.sum())
    both = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0)
    return (np.sign(toxic - both * share) * np.log1p(np.sqrt(np.maximum(0, 2 * g)))).astype(np.float32)


def _said(tables: tuple[np.ndarray, np.ndarray], words: np.ndarray, buckets: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(words, EVIDENCE): of the word, and the largest, mean and least of its n-grams."""
    value, begins = tables[1][buckets], np.cumsum(number) - number
    return np.stack([tables[0][words], np.maximum.reduceat(value, begins), np.add.reduceat(value, begins) / number, np.minimum.reduceat(value, begins)], axis=1).astype(np.float32)


class Inputs:
    """The embeddings of words and n-grams, and the evidence tables."""

    def __init__(self, known: list[bytes], tables: tuple[np.ndarray, np.ndarray], seed: int):
        rng = np.random.default_rng(seed)
        self.known, self.tables = {w: i + 1 for i, w in enumerate(known)}, tables
        self.words = rng.normal(0, 0.2, (len(known) + 1, WORD_DIM)).astype(np.float32)
        self.grams = rng.normal(0, 0.2, (1 << GRAM_BITS, GRAM_DIM)).astype(np.float32)

    def means(self, buckets: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Mean embedding of the n-grams of each word; buckets are those of embeddings."""
        return np.add.reduceat(self.grams[buckets], np.cumsum(number) - number, axis=0) / number[:, None].astype(np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """(words, INPUTS) network inputs."""
        out = []
        for at, g in _parts(words):
            grams = g.by_word()
            means = self.means(grams[0] >> TABLE_BITS - GRAM_BITS, grams[1])
            out.append(np.concatenate((self.words[[self.known.get(w, 0) for w in words[at : at + len(g.lengths)]]], means, _said(self.tables, g.words, *grams)), axis=1))
        return np.concatenate(out) if out else np.zeros((0, INPUTS), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two GRUs, attention and a logistic output. Arrays are (time, window, ...); mask is 1 for words, 0 for padding."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN, inputs: int = INPUTS):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.35, s).astype(np.float32)
        h = self.hidden = hidden
        self.p = {"att": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(inputs, 3 * h), f"u{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        # At first, one state in either direction follows the evidence of the word and of its strongest n-gram.
        for unit, d in ((0, "f"), (h, "b")):
            self.p[f"w{d}"][:, 2 * h] = self.p[f"u{d}"][:, 2 * h] = 0
            self.p[f"w{d}"][inputs - EVIDENCE : inputs - EVIDENCE + 2, 2 * h] = 0.4
            self.p[f"c{d}"][0] = -2
            self.p["att"][unit] = self.p["out"][unit] = 2

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray | None, keep: bool):
        """States in order of time; gates are kept for training."""
        p, h, (t, n, _) = self.p, self.hidden, x.shape
        projected = (x.reshape(t * n, -1) @ p[f"w{d}"] + p[f"c{d}"]).reshape(t, n, 3 * h)
        u_gates, u_new = np.ascontiguousarray(p[f"u{d}"][:, : 2 * h]), np.ascontiguousarray(p[f"u{d}"][:, 2 * h :])
        states, now, saved = np.empty((t, n, h), np.float32), np.zeros((n, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            gates = now @ u_gates
            gates += projected[i, :, : 2 * h]
            gates = _sigmoid(gates)
            z, r = gates[:, :h], gates[:, h:]
            back = now @ u_new
            new = np.tanh(projected[i, :, 2 * h :] + r * back)
            after = new + z * (now - new)
            if mask is not None:
                after = np.where(mask[i, :, None] > 0, after, now)
            if keep:
                saved.append((i, now, z, r, back, new))
            states[i] = now = after
        return states, saved

    def _pool(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        forward, a = self._run("f", x, mask, keep)
        backward, b = self._run("b", x, mask, keep)
        states = np.concatenate((forward, backward), axis=2)
        scores = states @ self.p["att"]
        if mask is not None:
            scores = np.where(mask > 0, scores, -1e9)
        weights = np.exp(scores - scores.max(axis=0))
        weights /= weights.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weights, states)
        return states, weights, pooled, (a, b)

    def logits(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        pooled = self._pool(x, mask)[2]
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(of the parameters, of the inputs)."""
        p, h = self.p, self.hidden
        states, weights, pooled, saved = self._pool(x, mask, True)
        error = ((_sigmoid(pooled @ p["out"] + p["bias"]) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["out"]
        d_weights = np.einsum("nh,tnh->tn", d_pooled, states)
        d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", d_scores, states)
        d_states = weights[:, :, None] * d_pooled + d_scores[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        for d, own, part in (("f", saved[0], d_states[:, :, :h]), ("b", saved[1], d_states[:, :, h : 2 * h])):
            u, d_now = p[f"u{d}"], np.zeros_like(states[0, :, :h])
            d_proj = np.zeros((*x.shape[:2], 3 * h), np.float32)
            g[f"u{d}"] = np.zeros_like(u)
            for i, before, z, r, back, new in reversed(own):
                d_after = d_now + part[i]
                live = mask[i, :, None]
                d_masked = d_after * live
                d_new = d_masked * (1 - z) * (1 - new * new)
                d_z = d_masked * (before - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                gates = np.concatenate((d_z, d_r), axis=1)
                d_back = d_new * r
                d_proj[i] = np.concatenate((gates, d_new), axis=1)
                g[f"u{d}"][:, : 2 * h] += before.T @ gates
                g[f"u{d}"][:, 2 * h :] += before.T @ d_back
                d_now = d_after * (1 - live) + d_masked * z + gates @ u[:, : 2 * h].T + d_back @ u[:, 2 * h :].T
            flat = d_proj.reshape(-1, 3 * h)
            g[f"w{d}"], g[f"c{d}"] = x.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
            d_x += (flat @ p[f"w{d}"].T).reshape(x.shape)
        return g, d_x


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 2.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.99 * self.v[k] + 0.01 * x * x
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


class _Adagrad:
    """Steps of the rows of a table that a batch reads."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate, self.seen = table, rate, np.full(table.shape, 1e-6, np.float32)

    def step(self, rows: np.ndarray, gradient: np.ndarray, scale: float) -> None:
        """rows may repeat."""
        size = len(self.table)
        touched = np.flatnonzero(np.bincount(rows, minlength=size))
        total = np.stack([np.bincount(rows, c, size)[touched] for c in gradient.T], axis=1).astype(np.float32)
        self.seen[touched] += total * total
        self.table[touched] -= self.rate * scale * total / np.sqrt(self.seen[touched])


def window_starts(n: int) -> list[int]:
    """First words of the overlapping windows that cover n words; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _windows(firsts: np.ndarray, lengths: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(rows, mask) of windows that begin at `firsts`; where a window has ended, the row is `padding`."""
    width = int(max(1, lengths.max()))
    at = firsts[None, :] + np.arange(width)[:, None]
    if (lengths == width).all():
        return at, None
    mask = (np.arange(width)[:, None] < lengths[None, :]).astype(np.float32)
    at = np.where(mask > 0, at, padding)
    mask[0] = 1  # a text without words is one word of nothing
    return at, mask


def _cuts(lengths: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """Windows in parts: whole windows, then the others; order is by length."""
    full = int((lengths == WINDOW).sum())
    cuts = [*range(0, full, BATCH), *range(full, len(order), BATCH), len(order)]
    return (order[a:b] for a, b in zip(cuts, cuts[1:]) if b > a)


class Model:
    """A trained scorer; a few MB."""

    def __init__(self, inputs: Inputs | None, network: Network | None, calibration: np.ndarray, share: float):
        self.inputs, self.network, self.calibration, self.share = inputs, network, calibration, share
        self._forget()

    def _forget(self) -> None:
        """Empties the cache. Words are numbered from 1; row 0 is padding."""
        self.cache: dict[bytes, int] = {}
        self.rows, self.ready = np.zeros((1, INPUTS), np.float32), 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "rows", "ready")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        return np.fromiter((cache.setdefault(w, len(cache) + 1) for w in words), np.int32, len(words))

    def _read(self) -> None:
        """Makes the rows of new words."""
        n = len(self.cache)
        if n > self.ready:
            new = list(itertools.islice(reversed(self.cache), n - self.ready))[::-1]
            if n >= len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((n + 1, INPUTS), np.float32)))
            self.rows[self.ready + 1 : n + 1] = self.inputs(new)
            self.ready = n

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(highest window's logit, number of windows) of each text."""
        highest, numbers = np.full(len(texts), -np.inf, np.float32), np.zeros(len(texts), np.int64)
        block: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if block:
                self._read()
                self._score(block, highest)
                block.clear()
            if len(self.cache) > CACHE_WORDS:
                self._forget()

        held = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            starts = np.array(window_starts(len(words)))
            numbers[i] = len(starts)
            for a in range(0, len(starts), BLOCK_WINDOWS):  # a very long text goes in blocks of its windows
                own = starts[a : a + BLOCK_WINDOWS]
                part = words[own[0] : own[-1] + WINDOW]
                block.append((i, self._numbers(part), own - own[0]))
                held += len(part)
                if held > STRIDE * BLOCK_WINDOWS or len(self.cache) > CACHE_WORDS:
                    flush()
                    held = 0
        flush()
        return highest, numbers

    def _score(self, block: list[tuple[int, np.ndarray, np.ndarray]], highest: np.ndarray) -> None:
        rows = np.concatenate([*(ids for _, ids, _ in block), [0]])
        sizes, count = (np.array([len(b[k]) for b in block]) for k in (1, 2))
        firsts = np.repeat(np.cumsum(sizes) - sizes, count) + np.concatenate([own for _, _, own in block])
        lengths, owners = np.repeat(np.minimum(sizes, WINDOW), count), np.repeat([i for i, _, _ in block], count)
        for own in _cuts(lengths, np.argsort(-lengths, kind="stable")):
            at, mask = _windows(firsts[own], lengths[own], len(rows) - 1)
            np.maximum.at(highest, owners[own], self.network.logits(self.rows[rows[at]], mask))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self._calibrated(*self.logits(texts))

    def _calibrated(self, logits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        scores = _sigmoid(np.stack([np.ones(len(logits)), logits, np.log(numbers)], axis=1).astype(float) @ self.calibration)
        return np.round(scores, 6)  # what differs with the other texts of a batch is rounding below that


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        q = _sigmoid(x @ beta)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q) + 1e-9)[:, None]) + penalty + 1e-6 * np.eye(len(beta)), x.T @ (y - q) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if abs(step).max() < 1e-6:
            break
    return beta


def _vocabulary(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """(distinct words, each text as numbers of them)."""
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    return list(vocabulary), docs


def _tables(tallies: np.ndarray, without: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of words and of n-grams, without the documents of a fold."""
    kept = [k for k in range(FOLDS) if k != without]
    return tuple(_evidence(*(t[kept, c].sum(axis=0, dtype=np.float64) for c in (1, 0))) for t in tallies)


def _told(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(embedding buckets of all words' n-grams, number of each word's, evidence for (fold, word), tables of all folds).

    counts: documents by fold, class and word. N-grams are made in parts of the vocabulary, so that they take little memory.
    """
    size, buckets, number = 1 << TABLE_BITS, [], []
    tallies = np.zeros((2, FOLDS, 2, size), np.float32)
    for at, g in _parts(words):
        own, (b, n) = counts[:, :, at : at + len(g.lengths)], g.by_word()
        buckets.append((b >> TABLE_BITS - GRAM_BITS).astype(np.uint16))
        number.append(n.astype(np.int32))
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        for k in range(FOLDS):
            for c in range(2):
                tallies[0, k, c] += np.bincount(g.words, own[k, c], size)
                tallies[1, k, c] += np.bincount(b, own[k, c][owner], size)
    folds = [_tables(tallies, k) for k in range(FOLDS)]
    said = np.zeros((FOLDS, len(words) + 1, EVIDENCE), np.float32)  # the last is padding
    for at, g in _parts(words):
        grams = g.by_word()
        for k in range(FOLDS):
            said[k, at : at + len(g.lengths)] = _said(folds[k], g.words, *grams)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(buckets, np.uint16), join(number, np.int32), said, _tables(tallies, None)


def train(texts: list[str | None], labels: list[int], share: float | None = None, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """share: of toxic ones among all documents, where the sample's is another."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if share is None and len(y) else share or 0.0
    if not len(y) or y.min() == y.max():
        return Model(None, None, np.zeros(3), share)
    words, docs = _vocabulary(texts)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(docs)) % FOLDS
    counts = np.zeros((FOLDS, 2, len(words)), np.int32)
    for ids, k, label in zip(docs, fold, y):
        counts[k, int(label), np.unique(ids)] += 1
    seen = counts.sum(axis=(0, 1))
    often = np.flatnonzero(seen >= MIN_DOCS)
    often = np.sort(often[np.argsort(-seen[often], kind="stable")[:MAX_WORDS]])
    buckets, number, said, tables = _told(words, counts)
    inputs, network = Inputs([words[i] for i in often], tables, seed), Network(seed)
    model = Model(inputs, network, np.array([0.0, 1.0, 0.0]), share)
    words = len(words)
    del counts, seen
    begin = np.cumsum(number) - number
    known = np.zeros(words + 1, np.int32)
    known[often] = np.arange(1, len(often) + 1)
    sizes = np.array([len(d) for d in docs])
    rising = np.concatenate([[0.0], *(said[k, ids, :2].sum(axis=1) for ids, k in zip(docs, fold))]).cumsum()
    flat = np.concatenate([*docs, np.array([words], np.int32)])  # the last is padding
    del docs
    starts = [np.array(window_starts(n)) for n in sizes]
    offset, count = np.concatenate(([0], np.cumsum(sizes))), np.array([len(s) for s in starts])
    first = np.concatenate([o + s for o, s in zip(offset, starts)])
    owner, begins = np.repeat(np.arange(len(starts)), count), np.cumsum(count) - count
    length = np.minimum(np.repeat(sizes, count), WINDOW)
    steps = _Adam(network.p, 0.02), _Adagrad(inputs.words, 0.1), _Adagrad(inputs.grams, 0.1)

    def logits_of_all() -> np.ndarray:
        table = np.zeros((words + 1, LEARNED), np.float32)
        table[:-1, :WORD_DIM] = inputs.words[known[:-1]]
        for a in range(0, words, PART):
            own = slice(a, min(a + PART, words))
            grams = slice(begin[a], begin[own.stop] if own.stop < words else len(buckets))
            table[own, WORD_DIM:] = inputs.means(buckets[grams], number[own])
        out = np.zeros(len(first), np.float32)
        for own in _cuts(length, np.argsort(-length, kind="stable")):
            at, mask = _windows(first[own], length[own], len(flat) - 1)
            ids = flat[at]
            out[own] = network.logits(np.concatenate((table[ids], said[fold[owner[own]], ids]), axis=2), mask)
        return out

    def learn(own: np.ndarray, target: np.ndarray, weight: np.ndarray, scale: float) -> None:
        at, mask = _windows(first[own], length[own], len(flat) - 1)
        ids = flat[at]
        distinct, place = np.unique(ids, return_inverse=True)
        there = distinct[distinct < words]
        table = np.zeros((len(distinct), LEARNED), np.float32)
        rows = np.where(rng.random(len(there)) < HIDDEN_WORDS, 0, known[there])
        table[: len(there), :WORD_DIM] = inputs.words[rows]
        many = number[there]
        grams = buckets[np.repeat(begin[there] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        if len(there):
            table[: len(there), WORD_DIM:] = inputs.means(grams, many)
        draw = rng.random(len(own))
        shown, told = ((draw >= HIDDEN_WINDOWS).astype(np.float32)[None, :, None], (draw < 1 - HIDDEN_EVIDENCE).astype(np.float32)[None, :, None])
        x = np.concatenate((table[place.reshape(at.shape)] * shown, said[fold[owner[own]], ids] * told), axis=2)
        g, d_x = network.gradients(x, np.ones(at.shape, np.float32) if mask is None else mask, target, weight)
        flat_x, at_x = (d_x[:, :, :LEARNED] * shown).reshape(-1, LEARNED), place.ravel()
        d = np.stack([np.bincount(at_x, c, len(distinct))[: len(there)] for c in flat_x.T], axis=1)
        steps[0].step(g)
        if len(there):
            steps[1].step(rows, d[:, :WORD_DIM], scale)
            steps[2].step(grams, np.repeat(d[:, WORD_DIM:] / many[:, None], many, axis=0), scale)

    toxic, clean = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    # The first choice of windows: where the evidence is.
    logits = rising[first + length] - rising[first]
    for epoch in range(epochs):
        if epoch and epoch % 4 == 0:
            logits = logits_of_all()
        top = np.lexsort((-logits, owner))[begins]
        other = begins[clean] + (rng.random(len(clean)) * count[clean]).astype(np.int64)
        chosen = np.concatenate((top[toxic], top[clean], other))
        target = np.repeat([1.0, 0.0], [len(toxic), 2 * len(clean)]).astype(np.float32)
        weight = np.where(target > 0, len(target) / (2 * target.sum()), 1).astype(np.float32)
        scale = 1 - 0.9 * epoch / epochs
        steps[0].rate = 0.02 * scale
        for own in np.array_split(rng.permutation(len(chosen)), max(LEAST_BATCHES, len(chosen) // 128)):
            if len(own):
                learn(chosen[own], target[own], weight[own], scale)
    highest = np.full(len(y), -np.inf, np.float32)
    np.maximum.at(highest, owner, logits_of_all())
    x = np.stack([np.ones(len(y)), highest, np.log(count)], axis=1).astype(float)
    model.calibration = _logistic(x, y)
    sampled = float(y.mean())
    if 0 < share < 1:
        model.calibration[0] += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str | None], list[int], float | None]:
    """(texts, labels, share of toxic ones) of the bounded sample."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    counts = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    order = F.xxhash64("id")
    part = lambda label, n: own.where(F.col("label") == label).orderBy(order, "id").limit(n)
    sample = part(1, MAX_TOXIC).union(part(0, MAX_CLEAN))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.char_length("text"), F.lit(0)) <= MAX_CHARS)
    found = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).toArrow()
    rows = sorted(zip(found.column("id").to_pylist(), found.column("text").to_pylist(), found.column("label").to_pylist()), key=lambda r: (r[0], r[1] or ""))
    total = sum(counts.values())
    return [r[1] for r in rows], [r[2] for r in rows], counts.get(1, 0) / total if total else None


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (default: the id) of each row with its score, under `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]
    at = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = np.concatenate([own.scores(batch.column(at).slice(a, 256).to_pylist()) for a in range(0, max(1, batch.num_rows), 256)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=names)

    names = [f"c{i}" for i in range(len(keep))] + ["score"]
    chosen = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), *([F.col(text_col).alias("words")] * (at == len(keep))))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)) + ", score double"
    return chosen.mapInArrow(run, schema).toDF(*keep, name)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents; what its training took of the driver's memory is given back."""
    model = train(*training_sample(docs, labels))
    give_back()
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = trained(docs, labels)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
