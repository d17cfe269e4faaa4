"""SimHash near-duplicates by five-word shingles, for the pipeline.

Two texts are near copies when the Jaccard similarity of their sets of
shingles is ``LEAST`` or more; groups are the connected components.  Texts of
one set are one node.  A node's SimHash has a bit set where over half of its
shingles' hashes have it.  At similarity 0.8 two fingerprints differ in 15 %
of their bits, beyond what blocks of 64 bits can select, so the fingerprint is
``WORDS`` words long: ``TABLES`` keys of ``BITS`` bits each select, the 128 bits
of the sketch are compared by Hamming distance, and every candidate link is
verified on the whole sets.  At similarity 0.8 two texts share no key with
probability (1 - 0.8485^14)^112, seven in a million, and differ in more than
``FAR`` bits of the sketch with less; above, less.  Sets of few shingles
differ from that law: four shingles and the same four with a fifth differ in
19 % of the bits and share no key with probability 0.2 %.

Keys are short, so most nodes under one are strangers.  A semi-join first
keeps of each key the nodes with a near neighbour under it, by size and sketch.
Each of those is held against the least and the greatest node under the key,
then all pairs under a key are compared, unless they are in one component
already.  What leaves these joins are pairs alike in size, as similar sets must
be, near by their sketches, and near by parities: for each of ``CELLS`` cells,
whether it holds an odd number of the set's shingles.  Two sets differ in at
least as many shingles as these bits differ, so no link is lost by it, and
little else passes while a set is not many times ``CELLS``.
Where more than ``HOT`` nodes share a key they are dealt into parts of about
``HOT``, and every two parts meet under a key of their own: the same pairs,
over more tasks.

Defined results: words and white space are as in ``simhash``, ASCII letters
compare without case; texts of fewer than five words are one shingle; null,
empty and blank texts share the empty set; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, small_batches
from .components import components
from .simhash import _LOWER, SEED, _hashes, _parts, heads_of

WIDTH, LEAST = 5, 0.8
#: Keys of a fingerprint, and bits of each.
TABLES, BITS = 112, 14
#: Words of 64 bits of a fingerprint: two of the sketch, the others for the keys.
WORDS = 2 + -(-TABLES * BITS // 64)
#: Nodes of a part: more under one key are dealt into parts, of which every two meet.
HOT = 512
#: Bits of 128 in which the sketches of a candidate pair may differ.
FAR = 40
#: Cells whose counts' parity a set keeps.
CELLS = 1024
#: Shingles that are counted at once, in bytes.
CHUNK = 255

_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.arange(TABLES, dtype=np.int32) << BITS
_PLACES = 1 << np.arange(BITS, dtype=np.int32)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found, held = [], []
    for words in _parts((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        held = held + words
        if len(held) < width:
            continue
        found.append(_hashes(held, width))
        held = held[len(held) - width + 1 :]
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)] if held else [], np.uint64)
    return np.unique(np.concatenate(found))


def fingerprint(marks: np.ndarray) -> np.ndarray:
    """The bits of a set's SimHash: 1 where over half of the shingles have it."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(marks), CHUNK):
        x = marks[at : at + CHUNK, None] * _TIMES
        x ^= x >> np.uint64(31)
        x *= _MIX
        x ^= x >> np.uint64(32)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * counts > len(marks)).astype(np.uint8)


def keys(bits: np.ndarray) -> np.ndarray:
    """One int a table: its number, then its bits."""
    return bits[128 : 128 + TABLES * BITS].reshape(TABLES, BITS) @ _PLACES + _TABLE


def sketch(bits: np.ndarray) -> list[int]:
    """The first 128 bits in two signed longs."""
    return np.packbits(bits[:128]).view(np.int64).tolist()


def parities(marks: np.ndarray) -> list[int]:
    """Whether each cell holds an odd number of the set, in signed longs."""
    odd = np.bincount((marks % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _key(raw: bytes) -> int:
    x = xxhash.xxh64_intdigest(raw, SEED)
    return x - (1 << 64) if x >= 1 << 63 else x


#: Columns of ``signatures`` and their types.
COLUMNS = {"doc_id": "", "text_key": "long", "node": "long", "size": "int", "keys": "array<int>", "sketch": "array<long>", "odd": "array<long>", "marks": "array<long>"}


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """doc_id, text_key (tells rows of one id apart), node (hash of the set), size, keys (of the tables), sketch, odd (parities), marks (the set)."""
    small_batches(docs.sparkSession)
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(2)]
            bits = [fingerprint(s) for s in sets]
            made = {
                "doc_id": lambda: batch.column(0),  # noqa: B023
                "text_key": lambda: batch.column(1),  # noqa: B023
                "node": lambda: pa.array([_key(s.tobytes()) for s in sets], pa.int64()),  # noqa: B023
                "size": lambda: pa.array([len(s) for s in sets], pa.int32()),  # noqa: B023
                # the empty set is a single node and has no keys
                "keys": lambda: pa.array([keys(x) if len(s) else [] for s, x in zip(sets, bits)], pa.list_(pa.int32())),  # noqa: B023
                "sketch": lambda: pa.array([sketch(x) for x in bits], longs),  # noqa: B023
                "odd": lambda: pa.array([parities(s) for s in sets], longs),  # noqa: B023
                "marks": lambda: pa.array([s.view(np.int64) for s in sets], longs),  # noqa: B023
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in columns], list(columns))

    kinds = COLUMNS | {"doc_id": docs.schema[id_col].dataType.simpleString()}
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col))
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _alike(a: Column, b: Column) -> Column:
    """Whether two sizes allow similar sets."""
    return F.least(a, b) >= F.lit(LEAST) * F.greatest(a, b) - 1e-9


def _apart(a: list[Column], b: list[Column]) -> Column:
    """In how many bits two lists of longs differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def _may_link(a: str, b: str) -> Column:
    """Whether the sets behind two prefixes of size, sketch and odd may be similar."""
    of = lambda x, name, n: [F.col(f"{x}{name}")[i] for i in range(n)]
    size = [F.col(f"{x}size") for x in (a, b)]
    few = _apart(of(a, "odd", CELLS // 64), of(b, "odd", CELLS // 64)) <= (size[0] + size[1]) * F.lit((1 - LEAST) / (1 + LEAST)) + 1e-9
    return _alike(*size) & (_apart(of(a, "sketch", 2), of(b, "sketch", 2)) <= FAR) & few


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(f"_{x}"), F.col("marks").alias(f"_m{x}")) for x in "uv")
    both = F.size(F.array_intersect("_mu", "_mv"))
    near = both >= F.lit(LEAST) * (F.size("_mu") + F.size("_mv") - both) - 1e-9
    return pairs.join(a, F.col("u") == F.col("_u")).join(b, F.col("v") == F.col("_v")).where(near).select("u", "v")


def candidates(apart: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct (u, v) that share a key, are in two components and may be similar, from (band, key, n, root, node, size, sketch, odd)."""
    parts = F.ceil(F.col("n") / F.lit(hot))
    dealt = apart.withColumn("part", F.pmod(F.xxhash64("node", "band"), parts)).withColumn("last", parts - 1)
    # the parts i <= j meet under (i, j); part p is the left one with all j from p on and the right one with all i up to p
    left = dealt.select("*", F.col("part").alias("i"), F.explode(F.sequence("part", "last")).alias("j"))
    right = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "part")).alias("i"), F.col("part").alias("j"))
    a = left.select("band", "key", "i", "j", "node", "root", "size", "sketch", "odd")
    b = right.select(*[F.col(x).alias(f"_{x}") for x in a.columns])
    met = [F.col(x) == F.col(f"_{x}") for x in ("band", "key", "i", "j")]
    once = (F.col("i") < F.col("j")) | (F.col("node") < F.col("_node"))
    near = once & (F.col("root") != F.col("_root")) & _may_link("", "_")
    pairs = a.join(b, met[0] & met[1] & met[2] & met[3] & near)
    return pairs.select(F.least("node", "_node").alias("u"), F.greatest("node", "_node").alias("v")).distinct()


def _merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the components ``first`` (node, root) joined by the links ``more`` (u, v).

    Each component is one node of the graph that is left, whose links are few.
    """
    a, b = (first.select(F.col("node").alias(f"_{x}"), F.col("root").alias(f"_r{x}")) for x in "uv")
    ends = more.join(a, F.col("u") == F.col("_u"), "left").join(b, F.col("v") == F.col("_v"), "left")
    left = ends.select(F.coalesce("_ru", "u").alias("u"), F.coalesce("_rv", "v").alias("v"))
    later = components(left).select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    moved = first.join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    alone = later.join(first.select("node"), F.col("_n") == F.col("node"), "left_anti")
    return moved.unionByName(alone.select(F.col("_n").alias("node"), F.col("_root").alias("root")))


def neighbours(nodes: DataFrame) -> DataFrame:
    """(key, node) of the nodes that have under a key another one of like size and near sketch; nodes has node, size, keys, sketch."""
    s = [F.col("sketch")[i].alias(f"s{i}") for i in range(2)]
    met = nodes.select("node", "size", *s, F.explode("keys").alias("key"))
    a, b = met.alias("a"), met.alias("b")
    of = lambda x: [F.col(f"{x}.s{i}") for i in range(2)]
    near = (F.col("a.node") != F.col("b.node")) & _alike(F.col("a.size"), F.col("b.size")) & (_apart(of("a"), of("b")) <= FAR)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & near, "left_semi").select("key", "node")


def roots(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """(node, root) of every node with a verified link to another; ``rows`` has text_key, node, size, keys, sketch of ``docs``."""
    nodes = materialize(rows.select("node", "size", "keys", "sketch").dropDuplicates(["node"]), "near-nodes")
    near = materialize(neighbours(nodes), "near-neighbours")
    # whole sets only of nodes with neighbours, from their texts once more: all sets would outweigh the texts
    wanted = near.select(F.col("node").alias("_n")).distinct()
    texts = rows.join(wanted, F.col("node") == F.col("_n"), "left_semi").select(F.col("text_key").alias("_key")).distinct()
    again = docs.select(id_col, text_col).join(texts, F.xxhash64(text_col) == F.col("_key"), "left_semi")
    sets = signatures(again, id_col, text_col, ("node", "size", "sketch", "odd", "marks")).dropDuplicates(["node"])
    sets = materialize(sets, "near-sets")
    marked = sets.select(F.col("node").alias("_n"), "size", "sketch", "odd")
    met = near.join(marked, F.col("node") == F.col("_n")).select(F.shiftright("key", BITS).alias("band"), "key", "node", "size", "sketch", "odd")
    met = materialize(met, "near-meetings")

    on = (F.col("band") == F.col("_b")) & (F.col("key") == F.col("_k"))
    one = F.struct("node", "size", "sketch", "odd")
    ends = met.groupBy(F.col("band").alias("_b"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.array(F.min(one), F.max(one)).alias("ends"))
    ends = materialize(ends, "near-ends")
    heads = ends.select("_b", "_k", F.explode("ends").alias("e")).select("_b", "_k", *[F.col(f"e.{x}").alias(f"_{x}") for x in ("node", "size", "sketch", "odd")])
    pairs = met.join(heads, on & (F.col("node") != F.col("_node")) & _may_link("", "_"))
    pairs = pairs.select(F.least("node", "_node").alias("u"), F.greatest("node", "_node").alias("v")).distinct()
    first = materialize(components(_verified(pairs, sets)), "near-first")

    known = first.select(F.col("node").alias("_n"), "root")
    apart = met.join(known, F.col("node") == F.col("_n"), "left").drop("_n").withColumn("root", F.coalesce("root", "node"))
    apart = materialize(apart.join(ends.select("_b", "_k", "n"), on).drop("_b", "_k"), "near-apart")
    pairs = materialize(candidates(apart, hot), "near-pairs")
    out = materialize(_merged(first, _verified(pairs, sets)), "near-roots")
    discard(nodes, near, sets, met, ends, first, apart, pairs)
    return out


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, text_key, root (the same for all documents of a group)."""
    rows = materialize(signatures(docs, id_col, text_col, ("doc_id", "text_key", "node", "size", "keys", "sketch")), "near-rows")
    members = roots(rows, docs, id_col, text_col, hot).select(F.col("node").alias("_n"), "root")
    joined = rows.select("doc_id", "text_key", "node").join(members, F.col("node") == F.col("_n"), "left")
    out = materialize(joined.select("doc_id", "text_key", F.coalesce("root", "node").alias("root")), "near-groups")
    discard(rows)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row of least id, as in ``simhash.deduplicate``."""
    return heads_of(docs, grouped(docs, id_col, text_col), id_col, text_col)
