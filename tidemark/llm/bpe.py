"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load

#: Pre-tokens and pairs of tokens kept by a worker; beyond that they are dropped and made anew.
MEMO, PAIRS = 400_000, 1_000_000
#: Bytes of a pre-token between two looks for tokens that are certain.
LOOK = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State:
    """A set of open tokens, told by the longest stretch of bytes that begins one; ends: the tokens that stop here, longest first."""

    __slots__ = ("at", "ends", "open")

    def __init__(self, open_: bytes, ends: tuple):
        self.at, self.ends, self.open = {}, ends, open_


class Transducer:
    """Reads bytes and emits tokens once no continuation can change them.

    A sequence of tokens is the merges' result if no merge across two neighbours would have come before those inside
    them; so each prefix has one possible last token, and a prefix's encoding is that of a shorter prefix and that
    token.  States (subsets of open tokens), moves and pairs are determinised when first met.  Only places where an open
    token starts can be part of the final result; what their encodings share is emitted, so the lookahead is bounded by
    LOOK and the longest token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.states: dict[bytes, State] = {}
        self.start = State(b"", ())

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge is t; None for a byte, and (-1, -1) for a token that merges never reach."""
        if t not in self.halves:
            whole = self.bytes[t]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= t:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[t] = None if len(parts) == 1 else tuple(self.ranks[x] for x in parts) if len(parts) == 2 else (-1, -1)
        return self.halves[t]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b can be neighbours: undoes the later of the last merges on both sides of the border, and
        looks whether the pieces at the border would have merged before that."""
        limit, x, y = 1 << 60, a, b
        while True:
            rank = self.ranks.get(self.bytes[x] + self.bytes[y], 1 << 60)
            if rank < limit:
                return False
            sx, sy = self.split(x), self.split(y)
            # of equal ranks the left one merges first, so a merge on the right of the border allows one of its own rank before it
            if sx and (not sy or x > y):
                limit, x = x, sx[1]
            elif sy:
                limit, y = y + 1, sy[0]
            else:
                return True

    def pair(self, a: int, b: int) -> bool:
        ok = self.pairs.get(a << 32 | b)
        if ok is not None:
            return ok
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = a < 0 or self.fits(a, b)
        return ok

    def move(self, s: State, x: int) -> State:
        tail = s.open + bytes((x,))
        while tail and tail not in self.prefixes:
            tail = tail[1:]
        nxt = self.states.get(tail)
        if nxt is None:
            ends = ((self.ranks.get(tail[i:]), len(tail) - i) for i in range(len(tail)))
            nxt = self.states[tail] = State(tail, tuple((t, k) for t, k in ends if t is not None and self.split(t) != (-1, -1)))
        s.at[x] = nxt
        return nxt

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)  # a pre-token that is a token is never split
        if whole is not None:
            return (whole,)
        if len(piece) > LOOK:
            return self._long(piece)
        s, last, size, i, known = self.start, [-1], [0], 0, self.pairs.get
        for x in piece:
            s = s.at.get(x) or self.move(s, x)
            i += 1
            for t, k in s.ends:
                before = last[i - k]
                ok = known(before << 32 | t)
                if ok is None:
                    ok = self.pair(before, t)
                if ok:
                    break
            last.append(t)
            size.append(k)
        way = []
        while i:
            way.append(last[i])
            i -= size[i]
        way.reverse()
        return tuple(way)

    def _long(self, piece: bytes) -> tuple[int, ...]:
        """The same with tokens emitted on the way; keeps what follows the last certain place."""
        s, last, size, sure, out, look = self.start, [-1], [0], 0, [], LOOK
        for i, x in enumerate(piece, 1):
            s = s.at.get(x) or self.move(s, x)
            t, k = next((t, k) for t, k in s.ends if self.pair(last[i - k - sure], t))
            last.append(t)
            size.append(k)
            if i - sure >= look:
                cut = self._certain(s, size)
                look = LOOK if cut else look * 2
                if cut:
                    out += self._back(last, size, cut)
                    last, size, sure = last[cut:], [0, *size[cut + 1 :]], sure + cut
        return (*out, *self._back(last, size, len(size) - 1))

    def _certain(self, s: State, size: list[int]) -> int:
        """The last place that the encodings of all prefixes with an open token behind them share."""
        end = len(size) - 1
        paths = []
        for i in range(end, max(0, end - len(s.open)) - 1, -1):
            path = set()
            while i > 0:
                path.add(i)
                i -= size[i]
            paths.append(path)
        return max(set.intersection(*paths), default=0)

    @staticmethod
    def _back(last: list[int], size: list[int], i: int) -> list[int]:
        way = []
        while i > 0:
            way.append(last[i])
            i -= size[i]
        return way[::-1]


class Encoder(dict):
    """Maps pre-tokens to tokens; those not met lately go through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer, self.find = Transducer(ranks), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        out = self[piece] = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


class Utf8Stream:
    """Incremental decoder: the state is the unfinished character's bytes, three at most."""

    #: Bytes of a character by its first byte.
    NEED = bytes([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)

    def __init__(self):
        self.rest = b""

    def feed(self, block: bytes) -> str:
        """The characters that are whole by now; invalid bytes come out as U+FFFD."""
        data = self.rest + block
        cut = len(data)
        for k in range(1, min(3, cut) + 1):
            b = data[cut - k]
            if b >= 0xC0:
                if self.NEED[b] > k:
                    cut -= k
                break
            if b < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], token: dict[int, bytes], block: int = 1 << 16) -> Iterator[str]:
    """Text pieces of a stream of tokens."""
    machine, part = Utf8Stream(), []
    for t in ids:
        part.append(token[t])
        if len(part) == block:
            yield machine.feed(b"".join(part))
            part = []
    yield machine.feed(b"".join(part)) + machine.close()


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for a worker and vocabulary."""
    if shared.value[2] not in _encoders:
        _encoders.clear()
        _encoders[shared.value[2]] = Encoder(*shared.value[:2])
    return _encoders[shared.value[2]]


def _share(spark: SparkSession, path: str | None, pattern: str | None):
    """Ranks and pattern for the workers: a fixed vocabulary, about 1 MB."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern, hash((path, pattern, len(ranks)))))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): a row per document, in any order; a null or empty text has no ids."""
    shared = _share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.encode(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = _share(tokens.sparkSession, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {v: k for k, v in shared.value[0].items()}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(decode_stream(x or (), token)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and streams its ids through the decoder.

    Null texts count as empty.  Rows are independent: repeats and ties give equal rows, an empty table none.
    """
    shared = _share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        token = e.transducer.bytes
        names = {v: str(v) for v in token}
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for text in b.column(1):
                ids = e.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                digest, machine = hashlib.sha256(), Utf8Stream()
                for k in range(0, len(ids), 1 << 16):
                    digest.update(machine.feed(b"".join(map(token.__getitem__, ids[k : k + (1 << 16)]))).encode())
                digest.update(machine.close().encode())
                out_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"))
