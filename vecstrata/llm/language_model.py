"""LM scoring by online logistic context mixing.

A text is its lower-cased words and one end.  Training counts every word of every training text, and
every word after the classes of the words before it.

* A word that training knows is coded as ``LEAF_BITS`` hashed bits and its share of the words with the
  same bits.  Each bit is foretold by four predictors: how often it is set at this place of the code in
  all training words, after the hashed word before, after the two hashed words before, and in the text
  so far.  Their stretched predictions are combined by weights that a gate picks (how much the two
  contexts have seen); after every bit the weights of its gate follow the gradient, so the order of the
  words counts, and a text is mixed by what it has taught.  Weights and memory of the text begin anew every
  ``SEGMENT`` words, so segments are read side by side, and a score does not depend on its neighbours.
* A word that training does not know is spelled bit by bit: predictors with hashed contexts (the last 1,
  2, 3 and 4 bytes and the bits so far), counted over all distinct training words, are mixed by gated
  weights, fitted to all of those words by ``SPELL_ROUNDS`` Newton steps.  Words spelled before
  in a text come again by an urn, and so do known and unknown words; an urn gives the same product in any
  order, so counts are enough.

Scores are log10 probabilities of whole texts; ``bits_per_byte`` is the same per byte.

Dataflow: each part of the input sends its distinct training words to buckets by hash, and asks the
buckets for its own words; a bucket holds its share of the counts, spells what it does not know, and
answers the part.  What is gathered (words and counts) grows with the corpus; only tables of fixed size
are added up and broadcast.  A word that a third of all texts hold is one entry for each part.

NULL and empty texts are one end; rows without a doc_id have no result, repeated rows get a row each.
Very long texts are one slice and many segments.  Without training texts all words are spelled by untrained
predictors.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .tokens import SPACED, U, Words, binaries, heads_of, mix, release, small_batches, spread, text_bytes, text_slices, words

GATES, ROUNDS, GATE_TRUST = 4, 2, 2.0
LEAF_BITS, CONTEXT_BITS, SEGMENT = 8, 13, 256
LEAVES, CONTEXTS = 1 << LEAF_BITS, 1 << CONTEXT_BITS
HALF = LEAF_BITS // 2
#: The place of the code at each of a row's numbers: those of the first half, then for each of its ends those of the second
#: half, so that a code touches two short runs of memory.
PLACES = np.concatenate([np.arange(1 << HALF), *[np.concatenate([[0], *[(end << k) + np.arange(1 << k) for k in range(HALF)]]) for end in range(1 << HALF, 2 << HALF)]])
PRIOR, OWN_PRIOR, RATE_OF_TEXT = 1.0, 0.5, 0.04
FIRST_WEIGHTS = (0.15, 0.5, 0.45, 0.2)
ESCAPE_TRUST, NEW_WORD, LEAF_TRUST = 20.0, 2.0, 4.0
SPELL_ROUNDS, FIRST_WEIGHT = 2, 0.3
TABLE_BITS = (16, 17, 19, 19)
ORDERS = len(TABLE_BITS)
PAIRS = [(i, j) for i in range(ORDERS) for j in range(i, ORDERS)]
LEVELS = 8
STEP, LANES = 1 / 4096, 2048
END, START = mix(np.array([0x656E64, 0x626567], U))
FOLD_BYTE = np.arange(256, dtype=np.uint8)
FOLD_BYTE[ord("A") : ord("Z") + 1] += 32
SPACE = 0x20


# Gates ------------------------------------------------------------------------------------------


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the byte shares of each text, without case and without spaces."""
    at = offsets.tolist()
    n = np.empty((len(at) - 1, 256), np.float32)
    for i in range(len(n)):
        n[i] = np.bincount(data[at[i] : at[i + 1]], minlength=256)
    upper = np.flatnonzero(FOLD_BYTE != np.arange(256))
    n[:, FOLD_BYTE[upper]] += n[:, upper]
    n[:, upper] = 0
    n[:, SPACE] = 0
    return np.sqrt(n / np.maximum(1, n.sum(axis=1, keepdims=True)))


def nearest_gate(h: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(h @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)


def fit_gates(train: DataFrame) -> np.ndarray:
    """Centers over all training texts; sums of each round are added up before they travel."""
    rng = np.random.default_rng(3)
    sc = train.sparkSession.sparkContext

    def sums(assign):
        def run(batches):
            total, count = np.zeros((GATES, 256)), np.zeros(GATES)
            for batch in batches:
                for _, _, data, offsets in text_slices(batch.column("text")):
                    h = histograms(data, offsets)
                    g = assign(h)
                    for i in range(GATES):
                        total[i] += h[g == i].sum(axis=0)
                        count[i] += (g == i).sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.float64()))], names=["g", "n", "v"])

        made = train.select("text").mapInArrow(run, "g int, n double, v array<double>")
        added = made.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(256)])
        return {r["g"]: (r["n"], np.array([r[f"v{i}"] for i in range(256)])) for r in added.collect()}  # one row a gate

    # first split: by random directions from the mean of all texts
    n, v = sums(lambda h: np.zeros(len(h), int)).get(0, (0, np.zeros(256)))
    mean = (v / max(1.0, n)).astype(np.float32)
    planes = rng.standard_normal((256, GATES)).astype(np.float32)
    got = sums(lambda h: np.argmax((h - mean) @ planes, axis=1))
    centers = np.zeros((GATES, 256), np.float32)
    for step in range(ROUNDS):
        for g, (n, v) in got.items():
            if n:
                centers[g] = v / n
        if step < ROUNDS - 1:
            b = sc.broadcast(centers.copy())
            got = sums(lambda h, b=b: nearest_gate(h, b.value))
    return centers


def spaced(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 18) -> Words:
    """Words of texts, found in runs of texts of about ``limit`` bytes, which stay near the processor."""
    cuts = np.unique(np.concatenate([np.searchsorted(offsets, np.arange(0, offsets[-1], limit)), [0, len(offsets) - 1]])).tolist()
    runs = [words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACED) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    base = offsets[cuts[:-1]].tolist()
    start, end = (np.concatenate([getattr(r, c) + b for r, b in zip(runs, base, strict=True)]) for c in ("start", "end"))
    return Words(data, start, end, np.searchsorted(start, offsets), np.concatenate([r.hash for r in runs]), offsets)


# Order of words ---------------------------------------------------------------------------------


@dataclass
class Sequence:
    """Tokens of some texts in order: word hashes with an end after each text, and hashed contexts."""

    hash: np.ndarray
    first: np.ndarray
    leaf: np.ndarray
    one: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, w) -> "Sequence":
        docs = len(w.first) - 1
        first = w.first + np.arange(docs + 1)
        h = np.full(len(w.hash) + docs, END, U)
        h[np.arange(len(w.hash)) + w.doc] = w.hash
        before = np.full(len(h), START, U)
        before[1:] = h[:-1]
        before[first[:-1]] = START
        before2 = np.full(len(h), START, U)
        before2[1:] = before[:-1]
        before2[first[:-1]] = START
        with np.errstate(over="ignore"):
            two = mix(before + mix(before2, 46), 47)
        context = lambda x: (x >> U(64 - CONTEXT_BITS)).astype(np.int32)
        return cls(h, first, leaf_of(h), context(mix(before, 43)), context(two))


def leaf_of(h: np.ndarray) -> np.ndarray:
    return (mix(h, 41) >> U(64 - LEAF_BITS)).astype(np.int32)


@dataclass
class Order:
    """For each context and place of the code: stretched chance of a one, and how much was seen.

    A place of a context is one number, so that it is one access to memory: its gate's share above 16 bits, and
    the stretched chance in steps of ``STEP`` below.  Places lie as ``PLACES`` says."""

    chance: np.ndarray
    prior: np.ndarray
    contexts: list[np.ndarray]

    @classmethod
    def of(cls, leaves: np.ndarray, tables: list[np.ndarray]) -> "Order":
        """From counts of leaves in each gate (GATES, LEAVES) and of leaves after each context (CONTEXTS, LEAVES)."""
        every = leaves.sum(axis=0, keepdims=True) + 0.5
        ones, seen = places(np.concatenate([leaves + GATE_TRUST * LEAVES * every / every.sum(), every]))
        chance = np.clip(ones / np.maximum(seen, 1e-9), 1e-3, 1 - 1e-3).astype(np.float32)
        contexts = []
        for i, t in enumerate(tables):
            ones, seen = places(t)
            p = (ones + np.float32(PRIOR) * chance[-1]) / (seen + np.float32(PRIOR))
            level = np.minimum(LEVELS - 1, np.log2(seen + 1)).astype(np.int32) * LEVELS ** (1 - i)
            steps = np.rint(np.clip(np.log(p / (1 - p)), -7.9, 7.9) / STEP).astype(np.int32)
            contexts.append((level << 16 | steps + 32768)[:, PLACES].ravel())
        return cls(chance[:-1, PLACES].ravel(), np.log(chance / (1 - chance))[:-1, PLACES].ravel(), contexts)

    def bits(self, q: Sequence, gate_of: np.ndarray) -> np.ndarray:
        """Bits that the code of every token takes, by the gate of its text; segments of texts are lanes that are
        read side by side."""
        size = np.diff(q.first)
        pieces = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), pieces)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        length = np.minimum(SEGMENT, size[text] - begin)
        order = np.argsort(-length, kind="stable")
        start, length, group = (q.first[:-1][text] + begin)[order], length[order], (gate_of[text] * len(PLACES))[order]
        out = np.zeros(len(q.hash), np.float32)
        for lo in range(0, len(start), LANES):  # as many lanes as stay near the processor
            self.read(q, start[lo : lo + LANES], length[lo : lo + LANES], group[lo : lo + LANES], out)
        return out

    def read(self, q: Sequence, start: np.ndarray, length: np.ndarray, group: np.ndarray, out: np.ndarray) -> None:
        """Price the tokens of lanes, the longest first, into ``out``.

        A code is known before it is priced, so all its bits find their predictions at once; only weights go bit by bit."""
        lanes, f4 = len(start), np.float32
        w = np.tile(np.array(FIRST_WEIGHTS, f4), (lanes * LEVELS * LEVELS, 1))
        rows = w.view(np.complex128).ravel()  # four weights of 4 bytes as one number of 16, moved at once
        own = np.zeros(lanes * len(PLACES), np.int32)  # for each place of a lane: seen above 16 bits, ones below
        one, two = self.contexts
        trust, rate, step, middle, unit, most = f4(OWN_PRIOR), f4(RATE_OF_TEXT), f4(STEP), f4(32768 * STEP), f4(1), f4(40)
        lane, gates = np.arange(lanes) * len(PLACES), np.arange(lanes) * (LEVELS * LEVELS)
        down = np.arange(HALF, 0, -1)[:, None]
        for t in range(int(length[0])):
            n = int(np.searchsorted(-length, -t, "left"))
            at = start[:n] + t
            leaf = q.leaf[at].astype(np.int64)
            high, low = leaf >> HALF | 1 << HALF, leaf & (1 << HALF) - 1 | 1 << HALF
            node = np.concatenate([high >> down, (low >> down) + (high - (1 << HALF) + 1 << HALF)])  # (bits, lanes), as all that follows
            bit = np.concatenate([high >> down - 1, low >> down - 1]) & 1
            v1, v2 = one.take(q.one[at].astype(np.int64) * len(PLACES) + node), two.take(q.two[at].astype(np.int64) * len(PLACES) + node)
            here = group[:n] + node
            mine = lane[:n] + node
            both, p0 = own.take(mine), trust * self.chance.take(here)
            own[mine.ravel()] = (both + (0x10000 + bit)).ravel()
            ones, seen = (both & 0xFFFF).astype(f4), (both >> 16).astype(f4)
            gate = gates[:n] + ((v1 >> 16) + (v2 >> 16))
            x = np.empty((LEAF_BITS, 4, n), f4)
            x[:, 0] = self.prior.take(here)
            x[:, 1] = (v1 & 0xFFFF).astype(f4) * step - middle
            x[:, 2] = (v2 & 0xFFFF).astype(f4) * step - middle
            x[:, 3] = np.log((ones + p0) / (seen - ones + (trust - p0)))
            x *= (1 - 2 * bit).astype(f4)[:, None]  # against the bit that came
            chance, u, moved, dot = np.empty((LEAF_BITS, n), f4), np.empty((4, n), f4), np.empty((4, n), f4), np.empty(n, f4)
            for k in range(LEAF_BITS):
                picked = rows.take(gate[k])
                held, p = picked.view(f4).reshape(n, 4).T, chance[k]
                np.copyto(u, held)
                np.multiply(u, x[k], out=moved)
                np.add.reduce(moved, axis=0, out=dot)
                np.minimum(dot, most, out=dot)
                np.exp(dot, out=dot)
                np.add(dot, unit, out=dot)
                np.divide(unit, dot, out=p)  # of the bit that came
                np.subtract(unit, p, out=dot)
                np.multiply(dot, rate, out=dot)
                np.multiply(x[k], dot, out=moved)
                np.subtract(u, moved, out=held)
                rows[gate[k]] = picked
            out[at] = -np.log2(np.multiply.reduce(chance, axis=0, dtype=np.float64))


def places(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ones and all seen at the inner nodes of the code, (contexts, LEAVES) in heap order, from counts of leaves."""
    ones, seen = np.zeros(leaves.shape, np.float32), np.zeros(leaves.shape, np.float32)
    level = leaves.astype(np.float32)
    for k in range(LEAF_BITS - 1, -1, -1):
        ones[:, 1 << k : 2 << k] = level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
        seen[:, 1 << k : 2 << k] = level
    return ones, seen


PIECE, SALTS = 1 << 18, 64


class Contexts:
    """Counts of leaves after each context: tables of fixed size, that a task sends in pieces to be added up."""

    def __init__(self):
        self.tables = [np.zeros(CONTEXTS * LEAVES, np.uint32) for _ in range(2)]

    def add(self, q: Sequence) -> None:
        for t, c in zip(self.tables, (q.one, q.two), strict=True):
            cell, n = np.unique(c << LEAF_BITS | q.leaf, return_counts=True)
            t[cell] += n.astype(np.uint32)

    def sent(self, task: int) -> pa.RecordBatch:
        """Rows of ``PART`` with homes below zero, so that they travel with the words; each piece goes to ``SALTS`` homes."""
        rows = [(o * 64 + lo // PIECE, t[lo : lo + PIECE]) for o, t in enumerate(self.tables) for lo in range(0, len(t), PIECE)]
        rows = [(-1 - (i * SALTS + task % SALTS), packed(t)) for i, t in rows if t.any()]
        none = pa.nulls(len(rows), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([task] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), *[none] * 5], names=NAMES)


def packed(t: np.ndarray) -> bytes:
    return pa.compress(t.tobytes(), "zstd", asbytes=True)


def opened(t: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(t, PIECE * 4, "zstd"), np.uint32)


def added_up(pieces: list[bytes]) -> bytes:
    total = np.zeros(PIECE, np.uint64)
    for t in pieces:
        total += opened(t)
    return packed(np.minimum(total, 2**32 - 1).astype(np.uint32))


def context_counts(sums: DataFrame) -> list[np.ndarray]:
    """The tables of all tasks, from rows ``home, hashes`` of pieces that were added up once."""

    def added(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([table.column("piece")[0].as_py()], pa.int32()), pa.array([added_up(table.column("t").to_pylist())], pa.binary())], names=["piece", "t"])

    pieces = sums.select(F.floor((-1 - F.col("home")) / SALTS).cast("int").alias("piece"), F.col("hashes").alias("t")).groupBy("piece").applyInArrow(added, "piece int, t binary")
    tables = [np.zeros(CONTEXTS * LEAVES, np.uint32) for _ in range(2)]
    for r in cut(pieces, "contexts").toLocalIterator():  # a fixed number of pieces of fixed size
        lo = r["piece"] % 64 * PIECE
        tables[r["piece"] // 64][lo : lo + PIECE] = opened(r["t"])
    return [t.reshape(CONTEXTS, LEAVES) for t in tables]


# Bits of words ----------------------------------------------------------------------------------


class Spelling:
    """Bit tables (zeros and ones seen in each hashed context) and mixing weights."""

    def __init__(self, tables: list[np.ndarray] | None = None, weights: np.ndarray | None = None):
        self.tables = tables or [np.zeros((2, 1 << b), np.float32) for b in TABLE_BITS]
        self.weights = np.full((LEVELS * LEVELS, ORDERS), FIRST_WEIGHT, np.float32) if weights is None else weights
        self.ready = None

    def prepare(self) -> None:
        if self.ready is None:
            stretch = [np.log((t[1] + 0.4) / (t[0] + 0.4)).astype(np.float32) for t in self.tables]
            level = [np.minimum(LEVELS - 1, np.log2(t.sum(axis=0) + 1)).astype(np.uint8) for t in self.tables]
            self.ready = stretch, level

    @staticmethod
    def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For every byte of all words and their ends the four bytes before it and the byte, as one number."""
        pos = np.arange(int(size.sum()) + len(size)) - np.repeat(starts_of(size + 1), size + 1)
        byte = np.full(len(pos), SPACE, U)
        byte[pos < np.repeat(size, size + 1)] = FOLD_BYTE[gather(data, start, size)]
        out = byte.copy()
        for j in range(1, 5):
            before = np.full(len(pos), SPACE, U)
            before[j:] = byte[:-j]
            before[pos < j] = SPACE
            out |= before << U(8 * j)
        return out

    @staticmethod
    def walk(keys: np.ndarray):
        """Yield (firsts of runs, slots of each order, bit) for every bit of sorted keys; keys that agree up to a bit are a run."""
        for k in range(7, -1, -1):
            head = heads_of(keys >> U(k))
            key = keys[head]
            h, byte = (key >> U(8)).astype(np.uint32), (key & U(255)).astype(np.uint32)
            node = np.uint32(1 << 7 - k) | byte >> np.uint32(k + 1)
            slots = []
            for o, b in enumerate(TABLE_BITS):
                r = ((h & np.uint32((1 << 8 * (o + 1)) - 1) if o < 3 else h) + np.uint32(o + 1)) * np.uint32(0x9E3779B1)
                r = (r ^ (r >> np.uint32(15))) * np.uint32(0x85EBCA77)
                slots.append(((r + node * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - b)).astype(np.int64))
            yield head, slots, (byte >> np.uint32(k) & np.uint32(1)).astype(np.uint8)

    @classmethod
    def runs(cls, keys: np.ndarray, times: np.ndarray, limit: int = 1 << 15):
        """Yield (slots of each order, bit, times) for every bit of distinct sorted keys that occur so many times."""
        for lo in range(0, len(keys), limit):
            n = times[lo : lo + limit]
            for head, slots, bit in cls.walk(keys[lo : lo + limit]):
                yield slots, bit, np.add.reduceat(n, head)

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        held = [([], []) for _ in range(ORDERS)]
        for slots, bit, n in self.runs(*np.unique(self.keys(data, start, size), return_counts=True)):
            for (cells, times), s in zip(held, slots, strict=True):
                cells.append((s * 2 + bit).astype(np.int32))
                times.append(n)
        for t, (cells, times) in zip(self.tables, held, strict=True):
            if cells:
                t += np.bincount(np.concatenate(cells), np.concatenate(times), 2 * t.shape[1]).reshape(-1, 2).T

    def bits(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, limit: int = 1 << 15) -> np.ndarray:
        """Bits that each word takes."""
        self.prepare()
        stretch, level = self.ready
        if not len(start):
            return np.zeros(0)
        keys, back = np.unique(self.keys(data, start, size), return_inverse=True)
        cost = np.zeros(len(keys), np.float64)
        w = [np.ascontiguousarray(self.weights[:, o]) for o in range(ORDERS)]
        for lo in range(0, len(keys), limit):
            own = cost[lo : lo + limit]
            for head, slots, bit in self.walk(keys[lo : lo + limit]):
                x = [st[s] for st, s in zip(stretch, slots, strict=True)]
                gate = level[-1][slots[-1]].astype(np.intp) * LEVELS + level[-2][slots[-2]]
                dot = w[0][gate] * x[0]
                for o in range(1, ORDERS):
                    dot += w[o][gate] * x[o]
                np.clip(dot, -20, 20, out=dot)
                own += np.repeat(np.log1p(np.exp(np.where(bit, -dot, dot))), np.diff(np.append(head, len(own))))
        return np.add.reduceat(cost[back], starts_of(size + 1)) / np.log(2.0)

    def slopes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each gate the gradient of the log probability of the words by its weights, and the curvature (``PAIRS``).
        A word's own count is left out of its contexts."""
        out = np.zeros((LEVELS * LEVELS, ORDERS + len(PAIRS)))
        w = [np.ascontiguousarray(self.weights[:, o]) for o in range(ORDERS)]
        own = np.float32(0.4)
        for slots, bit, n in self.runs(*np.unique(self.keys(data, start, size), return_counts=True)):
            one = bit.astype(np.float32)
            zeros = [np.maximum(t[0][s] - (1 - one), 0) for t, s in zip(self.tables, slots, strict=True)]
            ones = [np.maximum(t[1][s] - one, 0) for t, s in zip(self.tables, slots, strict=True)]
            x = [np.log((b + own) / (a + own)) for a, b in zip(zeros, ones, strict=True)]
            top, below = (np.minimum(LEVELS - 1, np.log2(zeros[o] + ones[o] + 1)).astype(np.intp) for o in (-1, -2))
            gate = top * LEVELS + below
            dot = w[0][gate] * x[0]
            for o in range(1, ORDERS):
                dot += w[o][gate] * x[o]
            p = 1 / (1 + np.exp(-np.clip(dot, -20, 20)))
            err, bend = n * (one - p), n * (p * (1 - p))
            for o in range(ORDERS):
                out[:, o] += np.bincount(gate, err * x[o], len(out))
            for c, (i, j) in enumerate(PAIRS):
                out[:, ORDERS + c] += np.bincount(gate, bend * x[i] * x[j], len(out))
        return out

    def step(self, slopes: np.ndarray) -> None:
        """A Newton step of the weights of each gate towards the most probable ones; ``FIRST_WEIGHT`` weighs as one bit."""
        bend = np.zeros((len(slopes), ORDERS, ORDERS))
        for c, (i, j) in enumerate(PAIRS):
            bend[:, i, j] = bend[:, j, i] = slopes[:, ORDERS + c]
        pull = slopes[:, :ORDERS] - (self.weights - FIRST_WEIGHT)
        move = np.linalg.solve(bend + np.eye(ORDERS), pull[:, :, None])[:, :, 0]
        self.weights = (self.weights + move.clip(-0.5, 0.5)).astype(np.float32)


# Words of parts ------------------------------------------------------------------------------------


def starts_of(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, one after the other."""
    total = int(size.sum())
    return data[np.repeat(start - starts_of(size), size) + np.arange(total)] if total else np.zeros(0, np.uint8)


PART = "home int, part long, hashes binary, sizes binary, bytes binary, counts binary, mixed binary, docs binary"
NAMES = [x.split()[0] for x in PART.split(", ")]


class Part:
    """Words of consecutive slices of one task: distinct words, and which texts hold them how often."""

    def __init__(self):
        self.docs, self.held, self.spelled, self.n, self.base, self.words = [], [], [], 0, 0, 0

    def add(self, ids, held_out, gates, w, bits: np.ndarray | None) -> None:
        docs = len(w.first) - 1
        q_doc = np.repeat(np.arange(docs), np.diff(w.first) + 1)
        at_word = np.arange(len(w.hash)) + w.doc
        h = np.full(len(q_doc), END, U)
        h[at_word] = w.hash
        size, start = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        size[at_word], start[at_word] = w.end - w.start, w.start
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], q_doc[order]
        new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
        head = np.flatnonzero(new | np.concatenate([[True], ds[1:] != ds[:-1]])) if len(hs) else np.zeros(0, np.int64)
        tf = np.diff(np.append(head, len(hs)))
        cost = np.add.reduceat(bits[order].astype(np.float64), head) if bits is not None else np.zeros(len(head))
        word = np.cumsum(new)[head] - 1 + self.words
        by = np.argsort(ds[head].astype(np.min_scalar_type(docs)), kind="stable")  # by text, then by word
        self.held.append((word[by].astype(np.int32), (ds[head][by] + self.base).astype(np.int32), tf[by].astype(np.int32), cost[by].astype(np.float32)))
        # bytes of the distinct words of this slice
        at = order[new]
        self.spelled.append((hs[new], size[at], gather(w.data, start[at], size[at])))
        self.docs.append((ids, held_out, gates, np.diff(w.first) + 1))
        self.n += len(h)
        self.base += docs
        self.words += len(at)

    def finish(self):
        """(ids, held, gates, n, owner, word index, tf, bits, hashes, starts, sizes, bytes): pairs sorted by text."""
        ids, held, gates, n = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        word, owner, tf, cost = (np.concatenate(x) for x in zip(*self.held, strict=True))
        every, sizes, data = (np.concatenate(x) for x in zip(*self.spelled, strict=True))
        u, at, back = np.unique(every, return_index=True, return_inverse=True)
        return ids, held, gates, n, owner, back[word], tf, cost, u, starts_of(sizes)[at], sizes[at], data


class Distinct:
    """Distinct words of consecutive slices of one task, with counts in the training texts of each gate."""

    def __init__(self):
        self.held, self.n, self.base = [], 0, 0

    def add(self, ids, held_out, gates, w, bits=None) -> None:
        docs = len(w.first) - 1
        h = np.concatenate([w.hash, np.full(docs, END, U)])
        order = np.argsort(h)
        hs = h[order]
        head = heads_of(hs)
        at = order[head]
        size = np.concatenate([w.end - w.start, np.zeros(docs, np.int64)])[at]
        start = np.concatenate([w.start, np.zeros(docs, np.int64)])[at]
        # held-out texts count in a place beyond the gates
        place = np.where(held_out, GATES, gates)[np.concatenate([w.doc, np.arange(docs)])[order]]
        word = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(hs))))
        counts = np.bincount(word * (GATES + 1) + place, minlength=len(head) * (GATES + 1)).reshape(-1, GATES + 1)[:, :GATES].astype(np.uint32)
        self.held.append((hs[head], size, gather(w.data, start, size), counts))
        self.n += len(h)
        self.base += docs

    def finish(self):
        """(hashes, starts, sizes, bytes, counts): sorted by hash."""
        every, sizes, data, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(every, kind="stable")
        head = heads_of(every[order])
        at = order[head]
        return every[at], starts_of(sizes)[at], sizes[at], data, np.add.reduceat(counts[order], head, axis=0)


def parts(docs: DataFrame, entries: int, emit, centers: np.ndarray, kind, order=None, contexts: bool = False) -> DataFrame:
    """Run ``emit(part number, part)`` for parts of a kind and of bounded size of each task; with ``order``, a broadcast
    ``Order``, the codes of all tokens are priced; with ``contexts`` the leaves after each context are counted, too."""
    gates = docs.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        task = TaskContext.get().partitionId()
        part, number, after = kind(), task << 24, Contexts() if contexts else None
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                w = spaced(data, offsets)
                gate = nearest_gate(histograms(data, offsets), gates.value)
                if after is not None:
                    after.add(Sequence.of(w))
                part.add(np.asarray(ids[lo:hi]), held[lo:hi], gate, w, order.value.bits(Sequence.of(w), gate) if order is not None else None)
                if part.n >= 3 * entries // 2:  # tokens, so that parts of both kinds end alike
                    yield emit(number, part)
                    part, number = kind(), number + 1
                    release()
        if part.base:
            yield emit(number, part)
        if after is not None:
            yield after.sent(task)
        part = after = None
        release()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, PART)


def by_home(number: int, u: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray, counts: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that some of the words belong to."""
    home = (mix(u, 31) % U(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    home = home[order]
    head = heads_of(home)
    n = np.diff(np.append(head, len(home)))
    size = sizes[order]
    spelled = np.add.reduceat(size, head) if len(head) else np.zeros(0, np.int64)
    none = pa.nulls(len(head), pa.binary())
    cols = [
        pa.array(home[head], pa.int32()), pa.array(np.full(len(head), number), pa.int64()), binaries(u[order], n * 8), binaries(size.astype("<u4"), n * 4),
        binaries(gather(data, starts[order], size), spelled), none if counts is None else binaries(counts[order].astype("<u4").ravel(), n * 4 * GATES), none, none,
    ]
    return pa.RecordBatch.from_arrays(cols, names=NAMES)


def counting(buckets: int):
    """Rows of the distinct training words of a part with a count for each gate."""

    def emit(number: int, part: Distinct) -> pa.RecordBatch:
        u, starts, sizes, data, counts = part.finish()
        known = np.flatnonzero(counts.any(axis=1))
        return by_home(number, u[known], starts[known], sizes[known], data, counts[known], buckets)

    return emit


TYPES = "home int, hashes binary, sizes binary, bytes binary, counts binary, stats array<double>, leaves binary"


def merged(sent: DataFrame) -> DataFrame:
    """One row for each bucket: its distinct words with their counts, sums over them, and its counts of leaves.  Homes
    below zero hold counts of contexts, which are added up."""
    names, kinds = [x.split()[0] for x in TYPES.split(", ")], (pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64()), pa.binary())

    def run(table: pa.Table) -> pa.Table:
        home = table.column("home")[0].as_py()
        if home < 0:
            return pa.table([pa.array(c, k) for c, k in zip(([home], [added_up(table.column("hashes").to_pylist())], *[[None]] * 5), kinds, strict=True)], names=names)
        cols = {c: b"".join(table.column(c).to_pylist()) for c in ("hashes", "sizes", "bytes", "counts")}
        h, sizes = np.frombuffer(cols["hashes"], "<u8"), np.frombuffer(cols["sizes"], "<u4").astype(np.int64)
        data, counts = np.frombuffer(cols["bytes"], np.uint8), np.frombuffer(cols["counts"], "<u4").reshape(-1, GATES)
        order = np.argsort(h, kind="stable")
        head = heads_of(h[order])
        at = order[head]
        total = np.add.reduceat(counts[order].astype(np.int64), head, axis=0)
        every = total.sum(axis=1)
        stats = [float(every.sum()), float(len(every)), float((every == 1).sum())]
        leaf = leaf_of(h[at])
        leaves = np.stack([np.bincount(leaf, total[:, g], LEAVES) for g in range(GATES)])
        row = [[home], [h[at].tobytes()], [sizes[at].astype("<u4").tobytes()], [gather(data, starts_of(sizes)[at], sizes[at]).tobytes()], [total.astype("<u8").tobytes()], [stats], [leaves.astype("<f8").tobytes()]]
        return pa.table([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=names)

    return sent.groupBy("home").applyInArrow(run, TYPES)


def leaf_counts(types: DataFrame) -> np.ndarray:
    """Sums of the buckets' counts of leaves: added up in each task, one row of fixed size a task to the driver."""

    def run(batches):
        total = np.zeros(GATES * LEAVES)
        for batch in batches:
            for x in batch.column("leaves").to_pylist():
                total += np.frombuffer(x, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array(range(GATES * LEAVES), pa.int32()), pa.array(total)], names=["leaf", "n"])

    out = np.zeros(GATES * LEAVES)
    for r in types.select("leaves").mapInArrow(run, "leaf int, n double").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        out[r["leaf"]] = r["n"]
    return out.reshape(GATES, LEAVES)


def known_words(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), "<u4").astype(np.int64)
    return np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8), starts_of(sizes), sizes


def in_groups(size: np.ndarray, limit: int = 1 << 19):
    """Words in batches of about ``limit`` bytes, or of one longer word."""
    cuts = np.append(heads_of(np.cumsum(size + 1) // limit), len(size)).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield slice(lo, hi)


def fit_spelling(types: DataFrame) -> Spelling:
    """Count all bit contexts, then fit the weights to all distinct training words by Newton steps."""
    chunk = 1 << 16

    def counted(batches):
        s = Spelling()
        for batch in batches:
            data, start, size = known_words(batch)
            for at in in_groups(size):
                s.count(data, start[at], size[at])
        rows = []
        for o, t in enumerate(s.tables):
            for lo in range(0, t.shape[1], chunk):
                rows.append((o * 64 + lo // chunk, t[:, lo : lo + chunk].tobytes()))
        salt = [TaskContext.get().partitionId() % 64] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(salt, pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["piece", "salt", "t"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t, np.float32).astype(np.float64) for t in table.column("t").to_pylist())
        return pa.table([pa.array([table.column("piece")[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["piece", "t"])

    spelling = Spelling()
    # added up in two levels, so that no task reads the tables of all tasks
    made = types.select("sizes", "bytes").mapInArrow(counted, "piece int, salt int, t binary")
    pieces = made.groupBy("piece", "salt").applyInArrow(added, "piece int, t binary").groupBy("piece").applyInArrow(added, "piece int, t binary")
    for r in cut(pieces, "spelling").collect():  # the tables have a fixed size
        o, lo = r["piece"] // 64, r["piece"] % 64 * chunk
        spelling.tables[o][:, lo : lo + chunk] = np.frombuffer(r["t"], np.float32).reshape(2, -1)
    fixed = types.sparkSession.sparkContext.broadcast(spelling.tables)
    for _ in range(SPELL_ROUNDS):

        def sloped(batches, weights=spelling.weights):
            s, total = Spelling(fixed.value, weights), 0
            for batch in batches:
                data, start, size = known_words(batch)
                for at in in_groups(size):
                    total = total + s.slopes(data, start[at], size[at])
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["gate", "v"])

        made = types.select("sizes", "bytes").mapInArrow(sloped, "gate int, v array<double>")
        total = np.zeros((LEVELS * LEVELS, ORDERS + len(PAIRS)))
        for r in made.groupBy("gate").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(total.shape[1])]).collect():  # one row a gate
            total[r["gate"]] = r[1:]
        spelling.step(total)
    return spelling


# Asking and answering ----------------------------------------------------------------------------


def asking(buckets: int):
    """Rows of the distinct words of a part; bytes only for words that no training text of the part holds."""

    def emit(number: int, part: Distinct) -> pa.RecordBatch:
        u, starts, sizes, data, counts = part.finish()
        return by_home(number, u, starts, np.where(counts.any(axis=1), 0, sizes), data, None, buckets)

    return emit


DOC = np.dtype([("id", "<i8"), ("held", "<u1"), ("gate", "<u1"), ("n", "<i8"), ("pairs", "<u4"), ("bytes", "<i8")])


def telling(number: int, part: Part) -> pa.RecordBatch:
    """One row for each part: its texts, and the (word, times, bits of its codes) of each."""
    ids, held, gates, n, owner, word, tf, cost, u, _, sizes, _ = part.finish()
    docs = np.zeros(len(ids), DOC)
    docs["id"], docs["held"], docs["gate"], docs["n"], docs["pairs"] = ids, held, gates, n, np.bincount(owner, minlength=len(ids))
    docs["bytes"] = np.bincount(owner, tf * (sizes[word] + 1), len(ids)).astype(np.int64) - 1
    row = [[0], [number], [u.tobytes()], [None], [word.astype("<u4").tobytes()], [tf.astype("<u4").tobytes()], [cost.astype("<f4").tobytes()], [docs.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=NAMES)


ANSWER = "part long, hashes binary, counts binary, logs binary"


def answered(asked: DataFrame, types: DataFrame, spelling, leaves: np.ndarray) -> DataFrame:
    """For each part: counts of its words, and bits for each gate: of a known word's share of its leaf, or of the spelling."""
    every = leaves.sum(axis=0)
    names = [x.split()[0] for x in ANSWER.split(", ")]
    kinds = (pa.int64(), *[pa.binary()] * 3)

    def run(ask: pa.Table, have: pa.Table) -> pa.Table:
        if not len(ask):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        h, c = (np.frombuffer(have.column("hashes")[0].as_py(), "<u8"), np.frombuffer(have.column("counts")[0].as_py(), "<u8").reshape(-1, GATES)) if len(have) else (np.zeros(0, U), np.zeros((0, GATES), U))
        asked_n = [len(x) // 8 for x in ask.column("hashes").to_pylist()]
        q = np.frombuffer(b"".join(ask.column("hashes").to_pylist()), "<u8")
        q_data, q_start, q_size = known_words(ask)
        place = np.minimum(np.searchsorted(h, q), max(0, len(h) - 1))
        known = h[place] == q if len(h) else np.zeros(len(q), bool)
        times, bits = np.zeros(len(q), np.uint64), np.zeros((len(q), GATES))
        own, leaf = c[place[known]], leaf_of(q[known])
        times[known] = own.sum(axis=1)
        # counts of the gate, and those of all gates as GATE_TRUST more
        share = (own + GATE_TRUST * (times[known] / every[leaf])[:, None]) / (leaves[:, leaf].T + GATE_TRUST)
        bits[known] = -np.log2(share)
        # each unknown word is spelled once
        fresh, first, back = np.unique(q[~known], return_index=True, return_inverse=True)
        first = np.flatnonzero(~known)[first]
        spelled = np.zeros(len(fresh))
        for at in in_groups(q_size[first]):
            spelled[at] = spelling.value.bits(q_data, q_start[first][at], q_size[first][at])
        bits[~known] = spelled[back][:, None]
        size = np.array(asked_n, np.int64)
        cols = [ask.column("part").combine_chunks(), binaries(q, size * 8), binaries(times.astype("<u8"), size * 8), binaries(bits.astype("<f4").ravel(), size * 4 * GATES)]
        return pa.table([x.cast(k) for x, k in zip(cols, kinds, strict=True)], names=names)

    return asked.groupBy("home").cogroup(types.groupBy("home")).applyInArrow(run, ANSWER)


def log2_gamma(x: np.ndarray) -> np.ndarray:
    """log2 of the gamma function for x > 0, by Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    z = x + 8
    return ((z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)) / np.log(2.0)


def urns(known: np.ndarray, unknown: np.ndarray, distinct: np.ndarray, repeats: np.ndarray, escape: float) -> np.ndarray:
    """log2 probability of which tokens of a text are unknown and which of these come again, in any order.

    ``repeats`` is the sum of log2 gamma(times) over the distinct unknown words."""
    a, b = ESCAPE_TRUST * escape, ESCAPE_TRUST * (1 - escape)
    g = lambda x: log2_gamma(np.asarray(x, np.float64))
    flags = g(a + unknown) - g(a) + g(b + known) - g(b) - g(a + b + known + unknown) + g(a + b)
    again = g(NEW_WORD) - g(NEW_WORD + unknown) + distinct * np.log2(NEW_WORD) + repeats
    return flags + again


def shares(text: np.ndarray, leaf: np.ndarray, bits: np.ndarray, tf: np.ndarray, known: np.ndarray, texts: int) -> np.ndarray:
    """log2 probability of the known words of each text given their leaves: an urn for each leaf holds
    ``LEAF_TRUST`` balls dealt by the words' shares, and one more of a word each time the text uses it."""
    text, leaf, bits, tf = text[known], leaf[known], bits[known], tf[known]
    share = LEAF_TRUST * np.exp2(-bits)
    # gamma(share) is gamma(share + 1) / share, so that a share too small for a double counts by its log
    value = np.log2(LEAF_TRUST) - bits
    more = tf > 1
    value[more] += log2_gamma(share[more] + tf[more]) - log2_gamma(share[more] + 1)
    drawn, place = np.unique(text * LEAVES + leaf, return_inverse=True)
    n = np.bincount(place, tf, len(drawn))
    urn = log2_gamma(np.array([LEAF_TRUST])) - log2_gamma(LEAF_TRUST + n)
    return np.bincount(text, value, texts) + np.bincount(drawn // LEAVES, urn, texts)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def scored(answers: DataFrame, told: DataFrame, n: int, v: int, escape: float) -> DataFrame:
    def run(reply: pa.Table, docs: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        if not len(docs):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        held = {c: docs.column(c)[0].as_py() for c in ("hashes", "bytes", "counts", "mixed", "docs")}
        u, word = np.frombuffer(held["hashes"], "<u8"), np.frombuffer(held["bytes"], "<u4")
        tf, mixed = np.frombuffer(held["counts"], "<u4").astype(np.float64), np.frombuffer(held["mixed"], "<f4").astype(np.float64)
        d = np.frombuffer(held["docs"], DOC)
        at = np.searchsorted(u, np.frombuffer(b"".join(reply.column("hashes").to_pylist()), "<u8"))
        c, bits = np.zeros(len(u)), np.zeros((len(u), GATES))
        c[at] = np.frombuffer(b"".join(reply.column("counts").to_pylist()), "<u8")
        bits[at] = np.frombuffer(b"".join(reply.column("logs").to_pylist()), "<f4").reshape(-1, GATES)
        text = np.repeat(np.arange(len(d)), d["pairs"])
        bits = bits[word, d["gate"][text]]
        head = starts_of(d["pairs"].astype(np.int64))
        add = lambda x: np.add.reduceat(x, head)  # noqa: E731  every text has its end, so no range is empty
        base, known = add(tf * np.log10((c + 1) / (n + v + 1))[word]), (c > 0)[word]
        n_known, distinct = add(tf * known), add((~known).astype(np.float64))
        cost = add(np.where(known, mixed, bits))
        cost -= shares(text, leaf_of(u)[word], bits, tf, known, len(d))
        cost -= urns(n_known, d["n"] - n_known, distinct, add(np.where(known, 0.0, log2_gamma(tf))), escape)
        cols = [d["id"], d["held"].astype(bool), d["n"], n_known.astype(np.int64), np.full(len(d), n), base, -cost * np.log10(2.0), cost / np.maximum(1, d["bytes"])]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

    return answers.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, RESULT)


def score(docs: DataFrame, held_out) -> DataFrame:
    """Score all rows of ``doc_id, text``, learning from those where ``held_out`` (a Column) is false."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where("not held_out")
    buckets, entries = spread(text_bytes(docs))
    centers = fit_gates(train)
    both = cut(merged(parts(train, entries, counting(buckets), centers, Distinct, contexts=True)), "words")
    types = both.where("home >= 0")
    n, v, once = (x or 0.0 for x in types.agg(*[F.sum(F.col("stats")[i]) for i in range(3)]).first())
    leaves = leaf_counts(types)
    order = sc.broadcast(Order.of(leaves, context_counts(both.where("home < 0"))))
    spelling = sc.broadcast(fit_spelling(types))
    escape = min(0.999, max(1e-4, (once + 1) / (n + 2)))  # the share of words seen once foretells that of unknown ones
    answers = answered(parts(rows, entries, asking(buckets), centers, Distinct), types.select("home", "hashes", "counts"), spelling, leaves)
    return scored(answers, parts(rows, entries, telling, centers, Part, order), int(n), int(v), escape)


def fold(modulus: int = 7, held: int = 2):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held


def documents_query(docs: DataFrame) -> DataFrame:
    return score(docs, fold())
