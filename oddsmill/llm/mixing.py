"""Mixing sources to target weights (DataFrame functions only).

Words of each source are packed into blocks of fixed length.  The output has
as many slots as the quotas of all sources together, cut into shards of fixed
length.  Every slot draws a source with the quotas as weights, from a hash of
seed, shard and slot, so the counts of the sources in a shard are a
multinomial draw.  A plain draw misses the quotas by its own noise and would
let a source at its limit go over it; so what a source has drawn beyond its
quota is given to the sources that have drawn less, slot for slot (``drawn``
and ``blocks`` in ``shard_counts`` tell the draw from what became of it).
The t-th slot of a source with n blocks reads block p(t mod n) of epoch
t div n, where p is a pseudorandom permutation of the source's block numbers
keyed by source and epoch; slots and blocks are then joined by (source, block
number).  Everything is a pure function of rows, parameters and seed: reruns
agree.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 are returned with ``taken`` 0; repeated rows
are packed one after the other; an empty table gives empty results; other
columns are ignored, and kept by ``mixed_texts`` whatever their names.  A long
text is cut over as many blocks as it fills.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE_CHARS, WORD, free_name, materialize, permuted, running, same, with_free_names


@dataclass
class Mixture:
    """``sources``: one row each; ``slots``: what fills the output; ``segments``: which words of which document a block holds; ``documents``: narrow input rows with their place in the packed stream."""

    sources: DataFrame
    documents: DataFrame
    segments: DataFrame
    slots: DataFrame

    def shard_counts(self) -> DataFrame:
        """(shard, sid, drawn, blocks): the multinomial draw of each output shard, and the blocks it holds after the quotas are met."""
        drawn = self.slots.groupBy("shard", F.col("drawn_sid").alias("sid")).agg(F.count(F.lit(1)).alias("drawn"), F.lit(0).cast("long").alias("blocks"))
        held = self.slots.groupBy("shard", "sid").agg(F.lit(0).cast("long").alias("drawn"), F.count(F.lit(1)).alias("blocks"))
        return drawn.unionByName(held).groupBy("shard", "sid").agg(F.sum("drawn").alias("drawn"), F.sum("blocks").alias("blocks"))

    def used_segments(self) -> DataFrame:
        """Segments joined to the slots by source and block number, with ``uses``."""
        uses = self.slots.groupBy(F.col("sid").alias("_s"), F.col("block").alias("_b")).agg(F.count(F.lit(1)).alias("uses"))
        joined = self.segments.join(uses, (F.col("sid") == F.col("_s")) & (F.col("block") == F.col("_b")), "left")
        return joined.drop("_s", "_b").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def n_words(text: Column) -> Column:
    """Words, counted by what is left when each becomes one character together with the white space before it."""
    trimmed = F.rtrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.char_length(F.regexp_replace(trimmed, rf"[\x20\x09-\x0D]*+{WORD}", "x")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, sid, weight, target) from a table of (source, size).

    The target is min(most * size, level * weight) for the one level at which
    targets sum to all sizes: the fixed point of resharing the excess by
    weight.  Capped sources are a prefix in the order of limit over weight, so
    the level follows from running sums over the table of sources, which has
    one row a source.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("sid", F.row_number().over(by_code_point).cast("long") - 1)
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    own = own.withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
    ordered = Window.orderBy(F.col("_limit") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("_level", left / weight_left)
    fits = F.col("_level") * F.col("weight") <= F.col("_limit")
    first = F.min(F.when(fits, F.struct((F.col("_limit") / F.col("weight")).alias("ratio"), "sid", F.col("_level").alias("level")))).over(everything)
    own = own.withColumn("target", F.least(F.col("_limit"), F.coalesce(first["level"], F.lit(0.0)) * F.col("weight")))
    return own.select("source", "source_size", "sid", "weight", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    block_words: int = 128,
    shard_blocks: int = 1024,
    seed: int = 42,
) -> Mixture:
    """Plan a mixture in which no block, so no document, is used more than ``most`` times.

    A source's quota is its target over its mean block length, rounded, so it
    is met to within half a block.
    """
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
        ),
        "mix-sizes",
    )
    rows = sizes.count()
    targets = source_targets(sizes, weights, most)
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.lit(most) * F.col("n_blocks"), F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("n_blocks", blocks).withColumn("quota", quota)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    targets = materialize(targets.withColumn("first_slot", F.coalesce(F.sum("quota").over(before), F.lit(0).cast("long"))), "mix-sources")

    named = targets.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    placed = sizes.join(named, same([F.col("source")], [F.col("_source")])).drop("_source")
    placed = materialize(running(placed, ["sid"], ["doc_id", "text_key", "size"], "start", rows, "size"), "mix-documents")

    b = F.lit(block_words)
    span = placed.where("size > 0").select("doc_id", "text_key", "sid", "size", "start", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    segments = span.withColumn("word_from", F.greatest(F.col("block") * b - F.col("start"), F.lit(0)))
    segments = segments.withColumn("word_to", F.least((F.col("block") + 1) * b - F.col("start"), F.col("size")))
    return Mixture(targets, placed, segments, _slots(targets, shard_blocks, seed))


def _owners(places: DataFrame, of: DataFrame, length: str, first: str, width: int, *keep: str) -> DataFrame:
    """``places`` with the row of ``of`` whose interval [first, first + length) holds ``_place``, by an equi-join on ranges of places."""
    last = f"({first} + {length} - 1) div {width}"
    ranges = of.where(f"{length} > 0").select(*keep, F.col(first).alias("_first"), F.col(length).alias("_length"), F.explode(F.expr(f"sequence({first} div {width}, {last})")).alias("_range"))
    inside = (F.expr(f"_place div {width}") == F.col("_range")) & (F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_first") + F.col("_length"))
    return places.join(ranges, inside).drop("_range", "_length")


def _slots(targets: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, slot, drawn_sid, sid, epoch, block): every slot of the output once."""
    spark = targets.sparkSession
    total = int(targets.agg(F.sum("quota")).first()[0] or 0)
    width = max(1, min(4096, total // 4096 + 1))
    shard = F.expr(f"id div {shard_blocks}")
    draw = F.pmod(F.xxhash64(F.lit(seed).cast("long"), shard, F.col("id")), F.lit(max(total, 1)).cast("long"))
    slots = spark.range(total).select(shard.alias("shard"), F.col("id").alias("slot"), draw.alias("_place"))
    drawn = materialize(_owners(slots, targets, "quota", "first_slot", width, "sid").select("shard", "slot", "sid"), "mix-drawn")

    # the number of a slot among those of its source: a shard holds a bounded number of them
    counts = running(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("_n")), ["sid"], ["shard"], "_first_t", max(1, total // shard_blocks), "_n")
    counts = counts.select(F.col("shard").alias("_shard"), F.col("sid").alias("_sid"), "_first_t")
    within = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")).cast("long") - 1
    numbered = drawn.withColumn("_within", within).join(counts, same([F.col("shard"), F.col("sid")], [F.col("_shard"), F.col("_sid")]))
    numbered = numbered.select("shard", "slot", "sid", (F.col("_first_t") + F.col("_within")).alias("_t"))

    # sources over their quota give up their last slots, in line, to those under it
    had = drawn.groupBy(F.col("sid").alias("_sid")).agg(F.count(F.lit(1)).alias("_had"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    balance = targets.select("sid", "quota", "n_blocks").join(had, F.col("sid") == F.col("_sid"), "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    balance = balance.withColumn("_over", F.greatest(F.col("_had") - F.col("quota"), F.lit(0))).withColumn("_under", F.greatest(F.col("quota") - F.col("_had"), F.lit(0)))
    for name in ("_over", "_under"):
        balance = balance.withColumn(f"{name}_first", F.coalesce(F.sum(name).over(before), F.lit(0)))
    balance = materialize(balance.drop("_sid"), "mix-balance")
    own = balance.select(F.col("sid").alias("_sid"), "quota", "n_blocks", "_over_first")
    joined = numbered.join(own, F.col("sid") == F.col("_sid")).drop("_sid")
    kept = joined.where("_t < quota").select("shard", "slot", F.col("sid").alias("drawn_sid"), "sid", "n_blocks", "_t")
    freed = joined.where("_t >= quota").select("shard", "slot", F.col("sid").alias("drawn_sid"), (F.col("_over_first") + F.col("_t") - F.col("quota")).alias("_place"))
    given = _owners(freed, balance, "_under", "_under_first", width, "sid", "n_blocks", "_had")
    given = given.select("shard", "slot", "drawn_sid", "sid", "n_blocks", (F.col("_had") + F.col("_place") - F.col("_first")).alias("_t"))
    owned = kept.unionByName(given).withColumn("epoch", F.expr("_t div n_blocks")).withColumn("_u", F.col("_t") % F.col("n_blocks"))
    return owned.select("shard", "slot", "drawn_sid", "sid", "epoch", F.expr(permuted("_u", "n_blocks", "sid", "epoch", f"{seed}")).alias("block"))


def taken(mixture: Mixture) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and the words the mixture takes of it."""
    used = mixture.used_segments().groupBy("sid", "start", "doc_id", "text_key", "size").agg(F.sum((F.col("word_to") - F.col("word_from")) * F.col("uses")).alias("taken"))
    own = mixture.sources.select("sid", "source", "source_size", "target")
    none = mixture.documents.where("size = 0").select("sid", "start", "doc_id", "text_key", "size", F.lit(0).cast("long").alias("taken"))
    both = used.unionByName(none)
    return both.join(own, "sid").select("doc_id", "source", "text_key", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The mixture as rows of ``docs``: copy k of a document holds the words used k times or more.

    A whole copy is the text as it is; where only some blocks are used once
    more, that copy holds their words, joined by blanks.  Rows equal in id,
    source and text are read as one document seen that often: they are
    collapsed here and their copies numbered on.  Documents of size 0 hold
    nothing that could be taken, so they appear in no copy.
    """
    used = mixture.used_segments().where("uses > 0")
    own = mixture.sources.select(F.col("sid").alias("_sid"), F.col("source").alias("_source"))
    plan = F.array_sort(F.collect_list(F.struct("word_from", "word_to", "uses")))
    plans = used.groupBy("sid", "start", "doc_id", "text_key", "size").agg(plan.alias("_plan")).join(own, F.col("sid") == F.col("_sid"))
    plans = plans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_source", F.col("size").alias("_size"), "_plan")
    taken_names, docs = docs.columns, with_free_names(docs)
    id_col, text_col, source_col, chars_col = (free_name(taken_names, c) for c in (id_col, text_col, source_col, chars_col))
    text = F.col(text_col)
    keys = [F.col(id_col), F.col("_text_key"), F.col(source_col)]
    keyed = docs.withColumn("_text_key", F.xxhash64(text))
    again = mixture.documents.groupBy("doc_id", "text_key", "sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(own, F.col("sid") == F.col("_sid"))
    again = materialize(again.select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"), F.col("_source").alias("_s")), "mix-repeated")
    if not again.isEmpty():  # rows repeated whole: one row meets the plans of all of them
        on = same(keys, [F.col("_i"), F.col("_k"), F.col("_s")])
        once = keyed.join(again, on, "left_semi").dropDuplicates([id_col, "_text_key", source_col])
        keyed = keyed.join(again, on, "left_anti").unionByName(once)
    one = keyed.join(plans, same(keys, [F.col("_id"), F.col("_key"), F.col("_source")]))
    one = one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.col("_plan.uses")))))
    part = F.filter("_plan", lambda r: r["uses"] >= F.col("_copy"))
    one = one.withColumn("_part", part)
    total = F.aggregate("_part", F.lit(0).cast("long"), lambda a, r: a + r["word_to"] - r["word_from"])
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pieces = F.flatten(F.transform("_part", lambda r: F.slice(F.col("_words"), (r["word_from"] + 1).cast("int"), (r["word_to"] - r["word_from"]).cast("int"))))
    one = one.withColumn("_whole", total == F.col("_size")).withColumn("_words", F.when(~F.col("_whole"), words))
    new_text = F.when(F.col("_whole"), text).otherwise(F.array_join(pieces, " "))
    out = one.withColumn("_new", new_text)
    columns = [F.col("_new").alias(text_col) if c == text_col else (F.char_length("_new").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"`{c}`")) for c in docs.columns]
    return out.select(*[c.alias(name) for c, name in zip(columns, taken_names, strict=True)])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken(mix(docs)).select("doc_id", "size", "source_size", "target", "taken")
