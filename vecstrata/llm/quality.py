"""Quality classifier: a byte-level convolutional network in numpy.

Each byte enters as one of ``CLASSES`` classes and a flag that its four-byte group began also at one
of the last ``LAGS`` bytes of its document.  ``FILTERS`` learned filters span ``WIDTH`` bytes; their rectified responses
are averaged over chunks of ``2 * HOP`` bytes that overlap by half and cover the whole text, each
filter's largest chunk is kept, and one logistic unit turns these maxima into a probability.

The network is fitted on the driver on a bounded sample: at most ``SAMPLE`` labelled training rows
of at most ``SAMPLE_BYTES`` each, the first by a hash of their id.  Scoring is a projection of whole
texts, without a shuffle; a slice of text bounds the memory of a task.

Only the text is scored, and each text alone: its score is the same whatever stands beside it.  NULL
and empty texts have zero responses and get the score of the unit's bias; a very long text is one slice
and is scored whole.  Repeated rows get equal scores each.  Without any labelled row the score is 0.5.
An empty table gives no rows.  Other columns pass, but one of the name of the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import with_made
from .tokens import small_batches, text_slices

WIDTH, FILTERS, HOP, LAGS = 4, 8, 64, 24
SAMPLE, SAMPLE_BYTES = 3000, 20_000
STEPS, BATCH, RATE, SEED = 96, 250, 0.03, 5


def byte_classes() -> tuple[np.ndarray, int]:
    """Class of each byte: small letters and ASCII marks alone; capitals, digits, controls and the
    lead and continuation bytes of UTF-8 in one class each."""
    out, used = np.zeros(256, np.int32), 5
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 0
        elif b >= 0x80:
            out[b] = 1
        elif "A" <= c <= "Z":
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif b < 32 and c not in "\n\t" or b == 127:
            out[b] = 4
        else:
            out[b], used = used, used + 1
    return out, used


CLASS_OF, CLASSES = byte_classes()
TOKENS = 2 * CLASSES


#: Four bytes that no UTF-8 text holds.
NOTHING = np.uint32(0xFFFFFFFF)


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class and repeat flag of each byte, as one number.

    A flag looks at the bytes of its own document only: documents are laid out with ``LAGS`` empty
    groups between them, and the last three bytes of each have no group.
    """
    out = CLASS_OF[data]
    n = len(data)
    if n < 4:
        return out
    group = np.full(n, NOTHING, np.uint32)
    group[: n - 3] = data[: n - 3].astype(np.uint32) | data[1 : n - 2].astype(np.uint32) << 8 | data[2 : n - 1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
    size = np.diff(offsets)
    ends = offsets[1:][size > 0]
    group[np.maximum(0, ends[:, None] - np.arange(1, 4))] = NOTHING  # a shorter document's neighbour loses its end too, which has none
    full = np.flatnonzero(size)
    room = size[full] + LAGS
    start = np.cumsum(room) - room
    at = np.arange(n) + np.repeat(start - offsets[full], size[full])
    wide = np.full(int(room.sum()), NOTHING, np.uint32)
    wide[at] = group
    again = np.zeros(len(wide), bool)
    for lag in range(1, min(LAGS, len(wide) - 1) + 1):
        again[lag:] |= wide[lag:] == wide[:-lag]
    out += CLASSES * (again[at] & (group != NOTHING))
    return out


@dataclass
class Layout:
    """Blocks of HOP bytes of some documents; a chunk is a block and its successor in the document."""

    tokens: np.ndarray
    starts: np.ndarray  # of blocks
    chunk_size: np.ndarray  # bytes of each chunk
    follows: np.ndarray  # whether the next block is in the same document
    first: np.ndarray  # first block of each document with text
    full: np.ndarray  # documents with text
    tail: np.ndarray  # positions without a whole filter

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Layout:
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        blocks = -(-size[full] // HOP)
        first = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(full)), blocks)
        starts = offsets[full][doc] + HOP * (np.arange(first[-1]) - first[doc])
        ends = np.minimum(starts + HOP, offsets[full + 1][doc])
        follows = np.zeros(len(starts), bool)
        follows[:-1] = doc[1:] == doc[:-1]
        chunk_size = ends - starts
        chunk_size[:-1] += np.where(follows[:-1], ends[1:] - starts[1:], 0)
        tail = np.unique(np.concatenate([np.maximum(offsets[full], offsets[full + 1] - 1 - i) for i in range(WIDTH - 1)])) if len(full) else np.zeros(0, np.int64)
        return cls(byte_tokens(data, offsets), starts, chunk_size, follows, first[:-1], full, tail)


class Network:
    def __init__(self, taps: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.taps, self.bias, self.weights, self.offset = taps, bias, weights, offset
        self.tables = None

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)
        return cls(rng.normal(0, 0.15, (WIDTH, TOKENS, FILTERS)).astype(np.float32), np.full(FILTERS, 0.05, np.float32), rng.normal(0, 0.5, FILTERS).astype(np.float32), 0.0)

    def pair_tables(self) -> list[np.ndarray]:
        """Two neighbouring taps in one lookup."""
        return [(self.taps[i][:, None, :] + self.taps[i + 1][None, :, :]).reshape(-1, FILTERS) for i in range(0, WIDTH, 2)]

    def responses(self, tokens: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        n = len(tokens)
        out = np.zeros((n, FILTERS), np.float32)
        if n >= WIDTH:
            pair = tokens[:-1] * TOKENS + tokens[1:]
            m = n - WIDTH + 1
            total = tables[0][pair[:m]]
            for i, table in enumerate(tables[1:], 1):
                total += table[pair[2 * i : 2 * i + m]]
            total += self.bias
            np.maximum(total, 0, out=out[:m])
        return out

    def chunks(self, x: Layout, tables: list[np.ndarray]) -> np.ndarray:
        r = self.responses(x.tokens, tables)
        r[x.tail] = 0
        block = np.add.reduceat(r, x.starts, axis=0)
        total = block.copy()
        total[:-1] += np.where(x.follows[:-1, None], block[1:], 0)
        return total / x.chunk_size[:, None]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = self.pair_tables()
        x = Layout.of(data, offsets)
        top = np.zeros((len(offsets) - 1, FILTERS), np.float64)
        if len(x.full):
            top[x.full] = np.maximum.reduceat(self.chunks(x, self.tables), x.first, axis=0)
        return 1.0 / (1.0 + np.exp(-np.clip(top @ self.weights.astype(np.float64) * 10 + self.offset, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on the log loss; gradients flow through each filter's largest chunk."""
    net = Network.fresh()
    if not len(labels) or labels.min() == labels.max():
        net.weights[:] = 0
        net.offset = 0.0 if not len(labels) else (3.0 if labels[0] else -3.0)
        return net
    rng = np.random.default_rng(SEED)
    rare = max(1e-3, min(labels.mean(), 1 - labels.mean()))
    weight = np.where(labels == (labels.mean() < 0.5), 0.5 / rare, 0.5 / (1 - rare))
    weight = np.minimum(weight, 4.0)
    params = [net.taps, net.bias, net.weights, np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batches = [rng.permutation(len(texts))[i : i + BATCH] for i in range(0, len(texts), BATCH)]
    laid = []
    for b in batches:
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in b])]).astype(np.int64)
        laid.append(Layout.of(np.frombuffer(b"".join(texts[i] for i in b), np.uint8), offsets))
    epochs = -(-STEPS // len(batches))
    for epoch in range(epochs):
        for at in rng.permutation(len(batches)):
            b, x = batches[at], laid[at]
            if not len(x.full):
                continue
            chunk = net.chunks(x, net.pair_tables())
            top = np.maximum.reduceat(chunk, x.first, axis=0)
            ends = np.append(x.first[1:], len(chunk))
            y, w = labels[b][x.full], weight[b][x.full]
            z = top @ net.weights * 10 + params[3][0]
            err = (w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(b)).astype(np.float32)
            g_top = np.outer(err, net.weights * 10)
            grads = [np.zeros_like(p) for p in params]
            grads[2][:] = 10 * err @ top
            grads[3][0] = err.sum()
            spread = np.minimum(np.arange(2 * HOP), 2 * HOP)
            for f in range(FILTERS):
                best = np.array([a + int(np.argmax(chunk[a:z, f])) for a, z in zip(x.first, ends, strict=True)])
                pos = x.starts[best][:, None] + spread[None, :]
                ok = spread[None, :] < x.chunk_size[best][:, None]
                ok &= pos + WIDTH <= len(x.tokens)
                share = np.broadcast_to((g_top[:, f] / x.chunk_size[best])[:, None], pos.shape)[ok]
                pos = pos[ok]
                total = net.bias[f] + sum(net.taps[j, x.tokens[pos + j], f] for j in range(WIDTH))
                live = total > 0
                pos, share = pos[live], share[live]
                grads[1][f] = share.sum()
                for j in range(WIDTH):
                    grads[0][j, :, f] = np.bincount(x.tokens[pos + j], share, TOKENS)
            step += 1
            rate = RATE * (1 - epoch / epochs) + 0.002
            for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-6)
    net.offset = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, where) -> Network:
    """Fit on a bounded sample of the labelled rows that ``where`` (a Column over doc_id) admits."""
    known = labels.where("quality is not null").select("doc_id", "quality").dropDuplicates(["doc_id"]).where(where)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
    small = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = small.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()  # a bounded sample
    return fit([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.float64))


def classify(docs: DataFrame, net: Network, to: str = "score") -> DataFrame:
    """Add the score to every row; other columns pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        net = shared.value
        return lambda column: ((lo, hi, pa.array(net.scores(data, offsets))) for lo, hi, data, offsets in text_slices(column))

    return with_made(docs, "text", to, T.DoubleType(), start)


def fold(modulus: int = 3):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def documents_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = train(docs, labels, fold() != 1)
    scored = classify(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
