"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is reduced to its characters outside white space and cut into
chunks whose ends depend on the characters around them.  Chunks are
deduplicated by their full characters and verified: a 64-bit address stands
for a chunk only if no other chunk has it, and every further chunk at a shared
address gets an ordinal of its own.  A document becomes the ordered list of
its chunks' identifiers (8 bytes for about a thousand characters); documents
are equal when the lists are equal.  Long texts move once, inside the
deduplication of chunks, and there only once per distinct chunk and task.

Defined results: null text counts as empty; all empty or blank texts are one
group; repeated rows are members like any other; of rows tied in length the
smallest doc_id stays and a null doc_id comes last; if the row that stays is
repeated whole, exactly the rows equal in doc_id, length and text are kept
together; a long text is cut into as many chunks as it needs, and its list
grows with it; ids may be of any type that has an order; an empty table gives
an empty result; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, free_name, materialize, with_free_names

#: Least and most characters of a chunk, and the two sets whose succession ends one.
CHUNK_MIN, CHUNK_MAX = 512, 4096


#: First and last code point of stretches of scripts, and how many neighbours are of one kind there: one
#: where alphabets are, more among ideographs, syllables and pictures.
_STRETCHES = (
    (0x100, 0x7FF, 1), (0x800, 0xFFF, 1), (0x1000, 0x17FF, 1), (0x1800, 0x1FFF, 1), (0x2000, 0x33FF, 8), (0x3400, 0x9FFF, 64), (0xA000, 0xABFF, 8), (0xAC00, 0xD7FF, 64),
    (0xF900, 0xFFFF, 8), (0x10000, 0x10FFF, 2), (0x11000, 0x11FFF, 2), (0x12000, 0x1DFFF, 16), (0x1E000, 0x1EFFF, 2), (0x1F000, 0x1FFFF, 8), (0x20000, 0x33FFF, 64),
)


def _marks(residue: int) -> str:
    """Class of an eighth of the characters of every script: those whose kind has this residue modulo 8.

    A stretch's own list is only looked at for its own characters.
    """
    plain = "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x100) if c % 8 == residue)
    parts = []
    for a, b, width in _STRETCHES:
        own = "".join(f"\\x{{{c:x}}}" + (f"-\\x{{{c + width - 1:x}}}" if width > 1 else "") for c in range(a, b + 1, width) if c // width % 8 == residue)
        parts.append(f"[[\\x{{{a:x}}}-\\x{{{b:x}}}]&&[{own}]]")
    return f"[{plain}{''.join(parts)}]"


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    """A chunk ends after two marks in a row once it has ``least`` characters, at ``most`` or at the end of the text."""
    return f"(?s).{{{least - 2},{most - 2}}}?{_marks(5)}{_marks(2)}|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    return F.regexp_extract_all(norm, F.lit(chunk_pattern(least, most)), F.lit(0))


def distinct_chunks(cut: DataFrame) -> DataFrame:
    """(address, chunk) once each, from a table of (address, chunk)."""
    return cut.groupBy("address", "chunk").agg(F.lit(1).alias("seen")).drop("seen")


def collisions(pieces: DataFrame) -> DataFrame | None:
    """(address, chunk, nth): the chunks that share an address with a smaller one, numbered from 1.

    An address with one chunk is verified and needs no row here.  Chunks move
    once to find shared addresses; only where there are some are the chunks at
    those addresses read again.  None if all addresses are verified.
    """
    counted = distinct_chunks(pieces).groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(counted.where("n > 1").select(F.col("address").alias("_a")), "chunk-shared")
    if shared.isEmpty():
        return None
    rows = materialize(distinct_chunks(pieces.join(shared, F.col("address") == F.col("_a"), "left_semi")), "chunk-clashes")
    other = rows.select(F.col("address").alias("_a"), F.col("chunk").alias("_c"))
    pairs = rows.join(other, (F.col("address") == F.col("_a")) & (F.col("_c") < F.col("chunk")))
    return materialize(pairs.groupBy("address", "chunk").agg(F.count(F.lit(1)).alias("nth")), "chunk-ordinals")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    address: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: id, ``_chars``, ``_sha`` (normalised text), ``_recipe``, ``keep_id``, ``group_size``, ``kept``.

    ``address`` maps a chunk to a long; it may collide, results don't change.
    """
    norm = docs.select(
        F.col(id_col).alias("_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"),
        normalised(F.col(text_col)).alias("_norm"),
    )
    cut = norm.select("_id", "_chars", "_norm", chunks(F.col("_norm")).alias("_chunks"))
    pieces = cut.select(F.explode("_chunks").alias("chunk")).select(address(F.col("chunk")).alias("address"), "chunk")
    clashes = collisions(pieces)

    recipe = F.transform("_chunks", lambda c: F.struct(address(c).alias("a"), F.lit(0).cast("long").alias("n")))
    lists = cut.select("_id", "_chars", F.sha2("_norm", 256).alias("_sha"), recipe.alias("_recipe"), "_chunks")
    if clashes is None:
        lists = lists.drop("_chunks")
    else:
        lists = _with_ordinals(lists, clashes)
    lists = materialize(lists, "recipes")

    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id")))
    groups = lists.groupBy("_recipe").agg(
        best["id"].alias("keep_id"),
        F.max("_chars").alias("_most"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # a table of its own, so that the join below deals rows anew and can split a hot list
    shared = materialize(groups.where("group_size > 1").withColumnRenamed("_recipe", "_r"), "recipe-groups")
    out = lists.join(shared, F.col("_recipe") == F.col("_r"), "left")
    single = F.col("group_size").isNull()
    return out.select(
        F.col("_id"),
        F.col("_chars"),
        F.col("_sha"),
        F.when(single, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("_most")))).alias("kept"),
    )


def _with_ordinals(lists: DataFrame, clashes: DataFrame) -> DataFrame:
    """Number the identifiers of chunks that share an address; only documents that hold one are touched."""
    keyed = lists.withColumn("_key", F.struct("_id", "_chars", "_sha", "_recipe"))
    parts = keyed.select("_key", F.posexplode("_chunks").alias("_p", "_c"))
    addressed = parts.withColumn("_at", F.col("_key._recipe")[F.col("_p")]["a"])
    hit = addressed.join(clashes, (F.col("_at") == F.col("address")) & (F.col("_c") == F.col("chunk")))
    # equal texts have equal fixes, so a fix is kept once for each text
    fixes = hit.groupBy("_key._sha", "_key._recipe").agg(F.map_from_entries(F.collect_set(F.struct(F.col("_p"), F.col("nth")))).alias("_fix"))
    fixes = fixes.select(F.col("_sha").alias("_s"), F.col("_recipe").alias("_r"), "_fix")
    joined = lists.join(fixes, (F.col("_sha") == F.col("_s")) & (F.col("_recipe") == F.col("_r")), "left")
    numbered = F.transform(
        "_recipe",
        lambda x, i: F.struct(x["a"].alias("a"), F.coalesce(F.try_element_at(F.col("_fix"), i), F.lit(0).cast("long")).alias("n")),
    )
    return joined.select("_id", "_chars", "_sha", F.when(F.col("_fix").isNull(), F.col("_recipe")).otherwise(numbered).alias("_recipe"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept.

    Rows repeated whole leave one row.  The decision travels as (id, length,
    hash of the normalised text), so texts are not shuffled for the filter.
    """
    names, docs = docs.columns, with_free_names(docs)
    id_col, text_col = free_name(names, id_col), free_name(names, text_col)
    gone = exact_groups(docs, id_col, text_col).where("group_size > 1").groupBy("_id", "_chars", "_sha").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_times"))
    gone = gone.select(F.col("_id").alias("_i"), F.col("_chars").alias("_n"), F.col("_sha").alias("_s"), "_kept", "_times")
    marked = docs.withColumn("_len", F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")).withColumn("_hash", F.sha2(normalised(F.col(text_col)), 256))
    on = F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_len") == F.col("_n")) & (F.col("_hash") == F.col("_s"))
    kept = marked.join(gone, on, "left").where(F.col("_kept").isNull() | F.col("_kept"))
    once = kept.where(F.coalesce("_times", F.lit(1)) == 1).select(*docs.columns)
    again = kept.where("_times > 1").dropDuplicates([id_col, "_hash"]).select(*docs.columns)
    return once.unionByName(again).toDF(*names)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256")
    )


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256
FROM r
"""
