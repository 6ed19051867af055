"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text runs through two stages in constant memory.

* The splitter finds pieces (letters, digits, others, spaces) with a lookahead of
  ``SPLIT_LOOKAHEAD`` characters: a piece that ends so far before the end of the buffer is final.
* A closed piece is encoded by the merge list.  A longer one is fed byte by byte to ``PairStream``.
  It keeps, for each position, the last token of the encoding of the bytes so far; a token may
  follow another exactly when the two encode as themselves side by side.  No token is longer than
  ``lookahead`` bytes, so all later encodings pass through one of the last ``lookahead``
  positions, and what all of those have in common is stable and emitted.

Decoding joins token bytes and turns them into text with an incremental UTF-8 machine, which holds
back at most three bytes of an unfinished character.

NULL and empty texts have no tokens and decode to an empty text.  Added tokens in a text
(``<|endoftext|>``) are one id, as the file lists them.  A very long text is streamed, repeated rows get a
row each, an empty table gives no rows.  ``digests`` reads ``doc_id`` and ``text`` alone; ``encode`` and
``decode`` pass other columns and replace one of the name they write to.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import with_made
from .tokens import release, small_batches

#: Fixed pattern of the public byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_LOOKAHEAD = 3
CHUNK = 1 << 18
LONG_PIECE = 96
CACHE_PIECES = 150_000
_NONE = 1 << 30


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        symbol = byte_symbols()
        as_bytes = lambda s: bytes(symbol[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes.update({i: s.encode() for s, i in self.added.items()})
        self.byte_id = [0] * 256
        for c, b in symbol.items():
            self.byte_id[b] = vocab[c]
        self.rank, self.made = {}, []
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((vocab[a] << 20) | vocab[b], k)
            self.made.append(vocab[a + b])
        self.id_of = {b: i for i, b in self.bytes.items() if i not in self.added.values()}
        self.lookahead = max(map(len, self.id_of))

    def merge(self, piece: bytes) -> list[int]:
        """The merge list applied to one closed piece: lowest rank first, leftmost first."""
        ids = [self.byte_id[x] for x in piece]
        get, made = self.rank.get, self.made
        ranks = [get((a << 20) | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            new = made[low]
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1] << 20) | new, _NONE)
            if i < len(ranks):
                ranks[i] = get((new << 20) | ids[i + 1], _NONE)
        return ids


class PairStream:
    """Encodes one piece of any length, fed in parts, with memory bounded by the lookahead."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.fits = vocab, {}
        self.buffer, self.last = bytearray(), [(-1, 0)]  # last[i]: (token, length) that ends at i
        self.root = -1  # the token before the buffer

    def _fit(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.v.merge(self.v.bytes[b]) == [b] if a < 0 else self.v.merge(self.v.bytes[a] + self.v.bytes[b]) == [a, b]
            self.fits[a, b] = known
        return known

    def push(self, part: bytes) -> list[int]:
        out: list[int] = []
        for x in part:
            self.buffer.append(x)
            n = len(self.buffer)
            for size in range(min(n, self.v.lookahead), 0, -1):
                token = self.v.id_of.get(bytes(self.buffer[n - size : n]))
                if token is not None and self.last[n - size] is not None and self._fit(self.last[n - size][0] if n > size else self.root, token):
                    self.last.append((token, size))
                    break
            else:
                self.last.append(None)  # no encoding ends here; longer ones pass over it
            if n >= 8 * self.v.lookahead:
                out += self._stable()
        return out

    def _chain(self, at: int) -> list[int]:
        """Boundaries from the start of the buffer to ``at``."""
        ends = []
        while at > 0:
            ends.append(at)
            at -= self.last[at][1]
        return ends[::-1]

    def _emit(self, upto: int) -> list[int]:
        tokens = [self.last[e][0] for e in self._chain(upto)]
        if upto:
            self.root = tokens[-1]
            del self.buffer[:upto]
            self.last = [(self.root, 0), *self.last[upto + 1 :]]
        return tokens

    def _stable(self) -> list[int]:
        n = len(self.buffer)
        live = [i for i in range(n - self.v.lookahead + 1, n + 1) if self.last[i] is not None]
        shared = set(self._chain(live[0])).intersection(*(self._chain(i) for i in live[1:]))
        return self._emit(max(shared, default=0))

    def close(self) -> list[int]:
        return self._emit(len(self.buffer))


class Pieces(dict):
    """Packed ids of closed pieces, computed once; emptied when it grows over its bound."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) > LONG_PIECE:
            s = PairStream(self.vocab)
            return np.array(s.push(raw) + s.close(), "<u4").tobytes()
        packed = np.array(self.vocab.merge(raw), "<u4").tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = packed
        return packed


class Encoder:
    def __init__(self, source: str):
        self.vocab = Vocabulary(source)
        self.pieces = Pieces(self.vocab)
        self.split = regex.compile(PATTERN)
        self.added = regex.compile("|".join(regex.escape(s) for s in sorted(self.vocab.added, key=len, reverse=True))) if self.vocab.added else None
        self.table = [self.vocab.bytes.get(i, b"") for i in range(max(self.vocab.bytes) + 1)]

    def _plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without added tokens, chunk by chunk."""
        get, findall = self.pieces.__getitem__, self.split.findall
        if len(text) <= CHUNK:
            yield b"".join(map(get, findall(text)))
            return
        held, at = "", 0
        while at < len(text) or held:
            held += text[at : at + CHUNK]
            at += CHUNK
            last = at >= len(text)
            found = findall(held)
            if last:
                yield b"".join(map(get, found))
                return
            size, keep = len(held), len(found)
            while keep and size > len(held) - SPLIT_LOOKAHEAD:
                keep -= 1
                size -= len(found[keep])
            if keep:
                yield b"".join(map(get, found[:keep]))
                held = held[size:]
            elif len(found) == 1 or len(found[0]) > CHUNK // 2:
                piece, held, at = self._endless(held, text, at)
                yield from piece

    def _endless(self, held: str, text: str, at: int) -> tuple[list[bytes], str, int]:
        """One piece longer than a chunk: streamed until its class of characters ends."""
        lead = 1 if held[0] == " " and len(held) > 1 and not held[1].isspace() else 0
        kind = next(k for k in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+") if regex.match(k, held[lead:]))
        stream, out, run = PairStream(self.vocab), [], regex.compile(kind)
        first = True
        while True:
            m = run.match(held, lead if first else 0)
            end = m.end() if m else 0
            open_end = end == len(held) and at < len(text)
            if kind == r"\s+" and end and (open_end or end < len(held)):
                end -= 1  # the last space belongs to what follows
            if end:
                out.append(np.array(stream.push(held[:end].encode()), "<u4").tobytes())
            held, first = held[end:], False
            if not open_end:
                out.append(np.array(stream.close(), "<u4").tobytes())
                return out, held, at
            held, at = held + text[at : at + CHUNK], at + CHUNK

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of a text, part by part."""
        if self.added is None or not any(s in text for s in self.vocab.added):
            yield from self._plain(text)
            return
        at = 0
        for m in self.added.finditer(text):
            if m.start() > at:
                yield from self._plain(text[at : m.start()])
            yield np.array([self.vocab.added[m[0]]], "<u4").tobytes()
            at = m.end()
        if at < len(text):
            yield from self._plain(text[at:])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text)), "<u4")

    def decode_parts(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids, part by part; an ill-formed sequence becomes U+FFFD."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.table
        for part in parts:
            yield machine.decode(b"".join(map(table.__getitem__, np.frombuffer(part, "<u4").tolist())))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_parts([np.array(list(ids), "<u4").tobytes()]))


_encoders: dict[int, Encoder] = {}


def encoder_of(source: str) -> Encoder:
    """One encoder for each tokenizer file in a worker process."""
    key = hash(source)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source)
    return _encoders[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """Add ``to``, the token ids (array<int>), to every row; NULL text has no ids."""
    source = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # one file of fixed size

    def start():
        e = encoder_of(source.value)

        def work(column):
            for lo in range(0, len(column), 256):
                ids = [e.encode(t or "").astype(np.int32) for t in column.slice(lo, 256).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield lo, lo + len(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))

        return work

    return with_made(df, column, to, T.ArrayType(T.IntegerType()), start)


def decode(df: DataFrame, path: str, column: str = "ids", to: str = "text") -> DataFrame:
    """Add ``to``, the text of the ids; NULL ids give an empty text."""
    source = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def start():
        e = encoder_of(source.value)

        def work(values):
            for lo in range(0, len(values), 256):
                out = [e.decode(x or ()) for x in values.slice(lo, 256).to_pylist()]
                yield lo, lo + len(out), pa.array(out, pa.string())

        return work

    return with_made(df, column, to, T.StringType(), start)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: tokens, a digest of the ids and one of the text decoded from them again."""
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        e = encoder_of(source.value)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n, ids, back = [], [], []
                for text in part.column("text").to_pylist():
                    count, h, g = 0, hashlib.sha256(), hashlib.sha256()

                    def passing(text=text, h=h):
                        nonlocal count
                        for packed in e.stream(text or ""):
                            count += len(packed) // 4
                            h.update(packed)
                            yield packed

                    for s in e.decode_parts(passing()):
                        g.update(s.encode())
                    n.append(count)
                    ids.append(h.hexdigest())
                    back.append(g.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
