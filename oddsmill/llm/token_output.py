"""Token identifiers as ORC files.

Documents are range-partitioned and sorted by id, encoded, and written as ORC:
integer runs are run-length encoded by the format, every stripe carries row
indexes, and ids have Bloom filters, so stripes are read in parallel and whole
stripes and row groups are skipped when documents are looked up.  Each file
also holds, for each document, the identifiers before it in that file; the
place of a document in the whole stream is that plus the totals of the files
before, which come from two narrow columns and one row a file.

The tokenizer is the ``tokenizers`` library.  Its byte-level model encodes
each piece of the public pattern for itself, so each distinct piece is given
to the library once and remembered (bounded, in each Python worker).  Texts are
cut first at the added tokens of the tokenizer's file (leftmost, longest), as
the library does; each stands for its identifier wherever a text holds it.

Defined results: null text is an empty text and has the end identifier only;
documents with equal ids follow each other in the order of their text's hash;
null ids come first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, small_batches, work_path
from .bpe import CACHE_LONGEST, Shipped, _lists
from .pretokens import Coder, classes, edges

END_ID = 2
#: Bytes of one of the two generations of remembered pieces.
CACHE_BYTES = 64 << 20
#: Words strung together for one call of the library.
STRING = 2000
#: Rows between two entries of a row index, and bytes of a stripe before compression.
INDEX_ROWS, STRIPE_BYTES = 1000, 16 << 20


class Pieces(Coder):
    """Identifiers from the library; ``source`` is a path or what a tokenizer's file holds."""

    def __init__(self, source: str | bytes, kinds: np.ndarray | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(source) if isinstance(source, bytes) else Tokenizer.from_file(source)
        super().__init__(classes(*_edges_of(self.tokenizer)) if kinds is None else kinds, CACHE_BYTES, CACHE_LONGEST)
        self.added: dict[str, int] = {}
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.single_word or token.lstrip or token.rstrip or token.normalized:
                raise ValueError(f"added token {token.content!r} is not matched as it stands")
            self.added[token.content] = i
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # byte-level: one character stands for one byte

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Identifiers of each text in order, added tokens among them."""
        if self.cut is None or not any(x and self.cut.search(x) for x in texts):
            yield from super().encode(texts)
            return
        parts = [self.cut.split(x or "") for x in texts]  # every second part is an added token
        between = super().encode([y for x in parts for y in x[::2]])
        for x in parts:
            ids = [next(between)]
            for token in x[1::2]:
                ids += [np.array([self.added[token]], np.int32), next(between)]
            yield np.concatenate(ids)

    def learn(self, missing: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(missing)
        plain, other = [], []
        for i, piece in enumerate(missing):
            word = piece[1:]
            (plain if piece[0] == 0x20 and (word.isalpha() or word.decode("utf-8", "replace").isalpha()) else other).append(i)
        # words led by a blank stay pieces when strung together, so one call encodes many
        for at in range(0, len(plain), STRING):
            own = plain[at : at + STRING]
            for i, ids in zip(own, self._string([missing[i] for i in own]), strict=True):
                out[i] = ids
        found = self.tokenizer.encode_batch_fast([missing[i].decode("utf-8", "replace") for i in other], add_special_tokens=False)
        for i, x in zip(other, found, strict=True):
            out[i] = array("I", x.ids).tobytes()
        return out

    def _string(self, words: list[bytes]) -> Iterator[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w) for w in words])) + 1
        raw, at = ids.tobytes(), 0
        for stop in (stops * 4).tolist():
            yield raw[at:stop]
            at = stop


def _edges_of(tokenizer) -> tuple[bytes, bytes]:
    """Letters and numbers as the tokenizer's pre-tokenizer sees them."""

    def joins(first: str, points: str) -> np.ndarray:
        spans = np.array([span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"{first}{c}\n" for c in points))])
        ends = np.zeros(3 * len(points) + 1, bool)
        ends[spans[:, 1]] = True
        return ~ends[1::3]

    return edges(joins, lambda text: len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1)


@cache
def library_edges(path: str) -> tuple[bytes, bytes]:
    from tokenizers import Tokenizer

    return _edges_of(Tokenizer.from_file(path))


def write_tokens(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write (doc_id, shard, local_start, n_tokens, ids) in ascending order of ids; one file a shard."""
    small_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, tokenizer, library_edges(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, before = shipped.read(Pieces), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(x, np.int32(end_id)) for x in encoder.encode(batch.column(1).to_pylist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            columns = [batch.column(0), pa.array(np.full(len(ids), shard, np.int32)), pa.array(starts), pa.array(sizes), _lists(ids, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "local_start", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(F.col(id_col), F.xxhash64(text_col))
    tokens = ordered.mapInArrow(run, f"doc_id {kind}, shard int, local_start long, n_tokens long, ids array<int>")
    (
        tokens.write.option("compression", "snappy")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(out)
    )


def placed(tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (with shard, local_start, n_tokens) with ``start``, the identifiers of all documents before."""
    files = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    return tokens.join(files, F.col("shard") == F.col("_shard")).withColumn("start", F.col("_base") + F.col("local_start")).drop("_shard", "_base")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ``start`` (identifiers of all documents before it) and ``ids``."""
    return placed(spark.read.orc(path)).select("doc_id", "start", "ids")


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents; Bloom filters and row indexes keep the read to their row groups."""
    return spark.read.orc(path).where(F.col("doc_id").isin([int(i) for i in ids]))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit identifiers) of the files in a folder.

    Sums are made where the files are read; only they meet the files' totals.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    stored = spark.read.orc(path).select("doc_id", "shard", "local_start", "ids")
    kind = stored.schema["doc_id"].dataType.simpleString()
    sums = materialize(stored.mapInArrow(run, f"doc_id {kind}, shard int, local_start long, n_tokens long, ids_crc32 long"), "token-sums")
    return placed(sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    out = work_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, tokenizer_path())
    return checksums(spark, out)
