"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit set where over half of its shingles' hashes
have it.  Fingerprints are made distinct first.  Each is split into six
blocks; two that differ in three bits or fewer agree on at least three of the
six, so they meet under one of the twenty choices of three blocks (about 32
bits each); whoever meets is verified by the Hamming distance.

A choice under which more than ``HOT`` distinct fingerprints meet is not
joined with itself.  Its members go another, equally exact way: two values at
distance three or less have a value between them within two bits of one and
one bit of the other.  Each member names the 65 values within one bit and each
such value elects its least member; each member then links to the elected of
the 2,081 values within two bits.  The links are true ones, they connect what
the pairs would, and their number is linear in the members.

Groups are the connected components of the links.

Defined results: null, empty and blank texts have fingerprint zero, which
links like any other; texts of fewer than three words are one shingle; a
component's id is its least doc_id, null ids last; repeated rows share a
component; an empty table gives an empty result; other columns pass through
``deduplicate`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, materialize, same, small_batches, with_free_names
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Distinct fingerprints under one choice of blocks beyond which pairs cost more than elections.
HOT = 512
#: Bytes of a text that are cut into words at once.
PART_BYTES = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8) * 256


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in parts cut at white space."""
    at = 0
    while len(raw) - at > PART_BYTES:
        cut = at + PART_BYTES
        while cut < len(raw) and raw[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins, digest = (ends - lengths).tolist(), xxhash.xxh64_intdigest
    stops = ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, len(stops))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint."""
    counts, n, held = np.zeros((8, 256), np.int64), 0, []
    for words in _parts((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        held = held + words
        if len(held) < width:
            continue
        h = _hashes(held, width)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
        n += len(h)
        held = held[len(held) - width + 1 :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    bits = (counts @ _BITS).reshape(64) * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``text_key`` (a hash that tells rows of one id apart) and ``fp`` (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _meetings(nodes: DataFrame) -> DataFrame:
    """(choice, key, fp): the twenty choices of three blocks of each distinct fingerprint."""
    masks = [_signed(sum(((1 << w) - 1) << at for at, w in three)) for three in combinations(BLOCKS, 3)]
    options = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(options).alias("o")).select("o.choice", "o.key", "fp")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def elected_links(members: DataFrame) -> DataFrame:
    """(u, v) links that connect all ``members`` (fp) within the distance, linear in their number."""
    one = [0, *(_signed(1 << i) for i in range(64))]
    two = one + [_signed((1 << i) | (1 << j)) for i, j in combinations(range(64), 2)]
    around = lambda flips: members.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))
    chosen = around(one).groupBy(F.col("z").alias("_z")).agg(F.min("fp").alias("head"))
    return around(two).join(chosen, F.col("z") == F.col("_z")).where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct()


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) links between distinct fingerprints that connect exactly what lies within the distance."""
    met = _meetings(nodes)
    sizes = materialize(met.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("choice").alias("_c"), F.col("key").alias("_k"), "n"), "simhash-sizes")
    on = (F.col("choice") == F.col("_c")) & (F.col("key") == F.col("_k"))
    few = materialize(met.join(sizes.where(F.col("n") <= hot), on, "left_semi"), "simhash-meetings")
    other = few.select(F.col("choice").alias("_c"), F.col("key").alias("_k"), F.col("fp").alias("other"))
    pairs = few.join(other, on & (F.col("fp") < F.col("other")) & _near(F.col("fp"), F.col("other")))
    found = pairs.select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()
    many = sizes.where(F.col("n") > hot)
    if not many.isEmpty():
        members = materialize(met.join(many, on, "left_semi").select("fp").distinct(), "simhash-hot")
        found = found.unionByName(elected_links(members))
    return materialize(found, "simhash-links")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    members = components(links(nodes, hot)).select(F.col("node").alias("_fp"), "root")
    joined = nodes.join(members, F.col("fp") == F.col("_fp"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "simhash-roots")
    ids = materialize(joined.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id")), "simhash-ids")
    labels = materialize(joined.join(ids, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id"), "simhash-labels")
    return rows.join(labels, F.col("fp") == F.col("_fp")).drop("_fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of least id (null last, then least text hash).

    Rows repeated whole leave one.
    """
    return heads_of(docs, grouped(docs, id_col, text_col), id_col, text_col)


def heads_of(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of ``docs`` of each root; ``rows`` has doc_id, text_key and root."""
    names, docs = docs.columns, with_free_names(docs)
    id_col, text_col = free_name(names, id_col), free_name(names, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    heads = materialize(rows.groupBy("root").agg(best.alias("b")).select(F.col("b.id").alias("_id"), F.col("b.key").alias("_key")), "simhash-heads")
    keyed = docs.withColumn("_text_key", F.xxhash64(text_col))
    on = same([F.col(id_col), F.col("_text_key")], [F.col("_id"), F.col("_key")])
    kept = keyed.join(heads, on, "left_semi")
    again = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again.drop("n"), "simhash-repeated")
    if not again.isEmpty():
        once = kept.join(again, on, "left_semi").dropDuplicates([id_col, "_text_key"])
        kept = kept.join(again, on, "left_anti").unionByName(once)
    return kept.select(*docs.columns).toDF(*names)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    rows = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
