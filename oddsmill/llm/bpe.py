"""Byte-level BPE encoding and decoding from a table of ranks.

Texts are cut into pieces by the scans of ``pretokens``; each distinct piece
is merged once and remembered (in a cache bounded in bytes that each Python
worker keeps between tasks); identifiers and byte offsets of tokens leave as
arrays.  New pieces are merged all at once: in each round the pair of least
rank of every piece, the leftmost of equals, becomes one token.  Decoding
gathers the tokens' bytes to their offsets in one vectorised step.

Defined results: null text is an empty text, which has no tokens and decodes
to no bytes; special tokens are ordinary text; repeated rows are encoded like
any other; an empty table gives an empty result; columns of the input pass
through ``encode`` and ``decode``, but one that bears the name of an output is
replaced.  A long text is scanned in bounded parts; what grows with it is
its own row.  The vocabulary travels as the bytes of its file, so executors
need no path of the driver's.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches
from .pretokens import Coder, classes, tiktoken_edges

#: Bytes of one of the two generations of remembered pieces, and the longest piece that is remembered.
CACHE_BYTES, CACHE_LONGEST = 16 << 20, 64
#: Pieces longer than this are merged with a heap, others together, so many bytes at once.
_LONG, _TOGETHER = 200, 1 << 18


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def ranks(path: str) -> dict[bytes, int]:
    """Rank by token from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return _ranks(f.read())


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Identifiers of one piece: the pair of least rank is merged first, the leftmost of equals."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > _LONG:
        return _merge_long(piece, rank)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list: n log n for a piece of n bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # the part that starts at i is piece[i:end[i]]; end 0 means it is gone
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := rank.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


class Merger(Coder):
    """Identifiers from ranks."""

    def __init__(self, rank: dict[bytes, int], kinds: np.ndarray | None = None):
        super().__init__(classes(*tiktoken_edges()) if kinds is None else kinds, CACHE_BYTES, CACHE_LONGEST)
        self.rank, self.size = rank, max(rank.values()) + 1
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        joined = {rank[t[:i]] * self.size + rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        self.pairs = np.array(sorted(joined), np.int64)  # two identifiers in one number
        self.joined = np.array([joined[k] for k in self.pairs.tolist()], np.int64)

    def learn(self, missing: list[bytes]) -> list[bytes]:
        out = [array("I", (r,)).tobytes() if r is not None else b"" for r in map(self.rank.get, missing)]
        held, size = [], 0
        for i, ids in enumerate(out):
            if ids:
                continue
            if len(missing[i]) > _LONG:
                out[i] = array("I", merge(missing[i], self.rank)).tobytes()
                continue
            held.append(i)
            size += len(missing[i])
            if size >= _TOGETHER:
                self._merge_into(out, missing, held)
                held, size = [], 0
        if held:
            self._merge_into(out, missing, held)
        return out

    def _merge_into(self, out: list[bytes], missing: list[bytes], places: list[int]) -> None:
        ids, counts = self.merged([missing[i] for i in places])
        raw, at = ids.astype("<u4").tobytes(), 0
        for i, stop in zip(places, (np.cumsum(counts) * 4).tolist(), strict=True):
            out[i] = raw[at:stop]
            at = stop

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each two tokens become; ``size`` where they become nothing."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], self.size)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all pieces end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # rank of each token with the next one of its piece
        rank = np.full(len(token), self.size)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self._joins(token[inner], token[inner + 1])
        done_piece, done_token = [], []
        while len(token):
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            over = least == self.size
            if over.any():
                gone = np.repeat(over, sizes)
                done_piece.append(piece[gone])
                done_token.append(token[gone])
                token, piece, rank, sizes, least = token[~gone], piece[~gone], rank[~gone], sizes[~over], least[~over]
                if not len(token):
                    break
            found = np.flatnonzero(rank == np.repeat(least, sizes))
            own = piece[found]
            at = found[np.concatenate(([True], own[1:] != own[:-1]))]  # the leftmost of each piece
            token[at] = least
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            token, piece, rank, sizes = token[stays], piece[stays], rank[stays], sizes - 1
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):  # the new token with the next, and the one before with it
                inside = i + 1 < len(piece)
                inside[inside] = piece[i[inside]] == piece[i[inside] + 1]
                rank[i[~inside]] = self.size
                i = i[inside]
                rank[i] = self._joins(token[i], token[i + 1])
        numbers = np.concatenate(done_piece) if done_piece else np.empty(0, np.int64)
        order = np.argsort(numbers, kind="stable")
        ids = np.concatenate(done_token)[order] if done_token else np.empty(0, np.int64)
        return ids, np.bincount(numbers, minlength=len(pieces))


class Vocabulary:
    """Bytes of all tokens end to end, and the merger."""

    def __init__(self, raw: bytes, kinds: np.ndarray):
        rank = _ranks(raw)
        n = max(rank.values()) + 1
        tokens = [b""] * n
        for token, r in rank.items():
            tokens[r] = token
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.merger = Merger(rank, kinds)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return self.merger.encode(texts)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the text's bytes."""
        lengths = self.lengths[ids]
        return (np.cumsum(lengths) - lengths).astype(np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The bytes of all tokens, gathered to their offsets, a bounded number of tokens at once."""
        for at in range(0, len(ids), _DECODED):
            own, first = ids[at : at + _DECODED], offsets[at]
            lengths = self.lengths[own]
            out = np.repeat(self.starts[own] - (offsets[at : at + _DECODED] - first), lengths)
            out += np.arange(len(out), dtype=np.int32)
            yield self.bytes[out].tobytes()


class Shipped:
    """A vocabulary's file as executors get it."""

    def __init__(self, spark, path: str, kinds: tuple[bytes, bytes]):
        with open(path, "rb") as f:
            raw = f.read()
        self.key, self.kinds = hashlib.sha256(raw).hexdigest(), kinds
        self.raw = spark.sparkContext.broadcast(raw)

    def read(self, kind=Vocabulary):
        """The vocabulary, made once a worker."""
        if (kind, self.key) not in _made:
            _made[kind, self.key] = kind(self.raw.value, classes(*self.kinds))
        return _made[kind, self.key]


_made: dict = {}


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of this machine."""
    with open(path, "rb") as f:
        return Vocabulary(f.read(), classes(*tiktoken_edges()))


#: Tokens decoded at once.
_DECODED = 1 << 16


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, kind))


def _without(df: DataFrame, *outputs: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in outputs])


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType(df.schema.fields + T.StructType.fromDDL(more).fields)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``token_offsets`` (byte offsets), both array<int>."""
    docs = _without(docs, "token_ids", "token_offsets")
    small_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, path, tiktoken_edges())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.read()
        for batch in batches:
            ids = list(v.encode(batch.column(at).to_pylist()))
            offsets = [v.offsets(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids, pa.int32()), _lists(offsets, pa.int32())], [*batch.schema.names, "token_ids", "token_offsets"])

    schema = _with(docs, "token_ids array<int>, token_offsets array<int>")
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (with token_ids and token_offsets) with ``decoded``, the bytes of the tokens."""
    tokens = _without(tokens, "decoded")
    small_batches(tokens.sparkSession)
    shipped = Shipped(tokens.sparkSession, path, tiktoken_edges())
    a, b = tokens.columns.index("token_ids"), tokens.columns.index("token_offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.read()
        for batch in batches:
            out = [b"".join(v.decode(x, y)) for x, y in zip(_arrays(batch.column(a)), _arrays(batch.column(b)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, _with(tokens, "decoded binary"))


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column; null is empty."""
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False).astype(np.int32) if x.is_valid else np.empty(0, np.int32)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``token_ids`` and ``decoded``: both directions in one pass, so that identifiers cross to Python once."""
    small_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, path, tiktoken_edges())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.read()
        for batch in batches:
            ids = list(v.encode(batch.column(1).to_pylist()))
            decoded = [b"".join(v.decode(x, v.offsets(x))) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, pa.int32()), pa.array(decoded, pa.binary())], ["doc_id", "token_ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 as ``digests`` of a ``round_trip``, hashed where that is made: identifiers and bytes are not sent back."""
    small_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, path, tiktoken_edges())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.read()
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for ids in v.encode(batch.column(1).to_pylist()):
                decoded = hashlib.sha256()
                for part in v.decode(ids, v.offsets(ids)):
                    decoded.update(part)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                of_bytes.append(decoded.hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
