"""Sharding by balanced label propagation.

Documents are linked when their texts are equal.  They start on shards by
hash, and a group's members vote for the shards they are on.  Round after
round each group that has no shard yet aims at the shard with the most votes
times free quota among those that have room for all of it, or, where none of
its own has, at any shard, drawn in proportion to room.  Who finds the shard
full moves on together in the next round.  A group is one row, its votes at
most one entry a shard.  Groups of a ``LARGE``-th of a shard or more, of which
there are at most ``LARGE`` times as many as shards, choose first, largest
first.  Unlinked documents have no neighbours and fill what is left, which
makes counts exact.

Rounds go on until every group has a shard or none of them finds room.

The law is ``rows``: counts of shards differ by at most one.  A large group no
shard has room for takes the shards with most room, so a group larger than a
shard is split over as few shards as its turn allows.  What has no shard after
the last round fills the gaps in one line, cut only where a gap ends.

Defined results: null text has no bytes (size 16) and is linked with empty
texts; repeated rows are documents of their own; null ids are ordered last
where order matters; texts are equal when 128 bits of their SHA-256 are; a long
text is read once, only its size and hashes move; an empty table gives an
empty result; other columns are ignored.  The result is a function of rows and parameters: reruns agree.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialize, running

LAW = "rows"
#: Groups of this part of a shard, or more, choose their shards first.
LARGE = 4


def _choices(groups: list, room: list[int]) -> list[tuple]:
    """(g1, g2, shard, n) of large groups, largest first; takes from ``room``."""
    out = []
    for g in sorted(groups, key=lambda g: (-g["m"], g["g1"], g["g2"])):
        votes, left = {v["shard"]: v["n"] for v in g["votes"]}, g["m"]
        while left:
            fits = [s for s in range(len(room)) if room[s] >= left]
            if fits:
                at = max(fits, key=lambda s: (votes.get(s, 0) * room[s], room[s], -s))
            else:
                at = max(range(len(room)), key=lambda s: (room[s], votes.get(s, 0), -s))
            n = min(left, room[at])
            room[at] -= n
            left -= n
            out.append((g["g1"], g["g2"], at, n))
    return out


def _group(text: Column) -> list[Column]:
    """g1 and g2: 128 bits of the SHA-256 of a text, by which texts are told apart."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for name, at in (("g1", 1), ("g2", 17))]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _ends(room: list[int]) -> list[int]:
    return [sum(room[: i + 1]) for i in range(len(room))]


def _round(pending: DataFrame, room: list[int], k: int) -> tuple[DataFrame, DataFrame]:
    """One round: (g1, g2, shard, n) of the groups that found room, and the groups that wait; takes from ``room``."""
    free, ends = _longs(room), _longs(_ends(room))
    score = lambda v: F.when(F.element_at(free, v["shard"] + 1) >= F.col("m"), v["n"] * F.element_at(free, v["shard"] + 1)).otherwise(F.lit(0).cast("long"))
    voted = F.array_max(F.transform("votes", lambda v: F.struct(score(v).alias("score"), F.xxhash64("g1", "g2", v["shard"]).alias("h"), v["shard"].alias("shard"))))
    drawn = F.size(F.filter(ends, lambda e: e <= F.pmod(F.xxhash64(F.lit(k), "g1", "g2"), F.lit(sum(room)))))
    asks = pending.withColumn("_v", voted).withColumn("_to", F.when(F.col("_v.score") > 0, F.col("_v.shard")).otherwise(drawn)).drop("_v")
    asks = materialize(asks, "shard-asks")
    queued = running(asks, ["_to"], ["g1", "g2"], "_before", asks.count(), "m")
    queued = materialize(queued.withColumn("_in", F.col("_before") + F.col("m") <= F.element_at(free, F.col("_to") + 1)), "shard-queued")
    placed = queued.where("_in").select("g1", "g2", F.col("_to").alias("shard"), F.col("m").alias("n"))
    for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        room[r["shard"]] -= r["n"]
    discard(asks)
    return placed, queued.where(~F.col("_in")).select("g1", "g2", "m", "votes")


def _in_gaps(pending: DataFrame, room: list[int]) -> DataFrame:
    """(g1, g2, shard, n): groups one after another over what is free, cut only where a shard's room ends."""
    line = running(pending, [], ["g1", "g2"], "_from", pending.count(), "m").withColumn("_to", F.col("_from") + F.col("m"))
    gaps = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(e - r).cast("long").alias("a"), F.lit(e).cast("long").alias("b")) for s, (r, e) in enumerate(zip(room, _ends(room), strict=True))])
    cut = line.select("g1", "g2", "_from", "_to", F.explode(F.filter(gaps, lambda x: (x["a"] < F.col("_to")) & (x["b"] > F.col("_from")) & (x["a"] < x["b"]))).alias("x"))
    return cut.select("g1", "g2", "x.shard", (F.least("x.b", "_to") - F.greatest("x.a", "_from")).alias("n"))


def propagate(cells: DataFrame, total: int, shards: int, rounds: int | None = None) -> DataFrame:
    """Cells (g1, g2, shard, n) of all linked documents, within the quotas.

    Rounds go on until every group has a shard or none finds room in a round,
    or until there were ``rounds``.
    """
    spark = cells.sparkSession
    room = [total // shards + (s < total % shards) for s in range(shards)]
    votes = F.collect_list(F.struct("shard", "n")).alias("votes")
    groups = materialize(cells.groupBy("g1", "g2").agg(F.sum("n").alias("m"), votes), "shard-votes")
    is_large = F.col("m") * LARGE >= total // shards
    large = _choices(groups.where(is_large).collect(), room)  # rows and votes are bounded by the number of shards
    held = spark.createDataFrame(large, "g1 long, g2 long, shard int, n long")
    pending = groups.where(~is_large)
    for k in count() if rounds is None else range(rounds):
        before = sum(room)
        if pending.isEmpty():
            break
        placed, pending = _round(pending, room, k)
        held = held.unionByName(placed)
        if sum(room) == before:
            break
    if not pending.isEmpty():
        held = held.unionByName(_in_gaps(pending, room))
    return materialize(held, "shard-held")


def shard(docs: DataFrame, shards: int = 40, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, g1 and g2 (the group), shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *_group(text),
    )
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    start = F.pmod(F.xxhash64("doc_id", "g1"), F.lit(shards)).cast("int")
    cells = rows.withColumn("shard", start).groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "shard-cells")
    groups = cells.groupBy(F.col("g1").alias("_g1"), F.col("g2").alias("_g2")).agg(F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    groups = materialize(groups, "shard-groups")
    in_group = (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2"))
    linked_cells = materialize(cells.join(groups, in_group, "left_semi"), "shard-cells")
    held = propagate(linked_cells, total, shards, rounds)
    used = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard

    over = Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # at most one row a shard
    places = held.withColumn("_to", F.sum("n").over(over)).groupBy(F.col("g1").alias("_g1"), F.col("g2").alias("_g2")).agg(F.collect_list(F.struct("_to", "shard")).alias("_places"))
    places = materialize(places, "shard-places")
    linked = rows.join(groups, in_group, "left_semi")
    n_linked = linked.count()
    ranked = running(linked, ["g1", "g2"], ["doc_id"], "_r", n_linked)
    found = F.array_min(F.filter("_places", lambda p: p["_to"] > F.col("_r")))["shard"]
    placed = ranked.join(places, in_group, "left").select("doc_id", "size", "text_crc32", "g1", "g2", found.alias("shard"))
    placed = materialize(placed, "shard-linked")

    pool = rows.join(groups, in_group, "left_anti").unionByName(placed.where("shard is null").drop("shard"))
    pool = running(pool, [], ["doc_id", "g1", "g2"], "_r", total)
    gaps, ends, at = [total // shards + (s < total % shards) - used.get(s, 0) for s in range(shards)], [], 0
    for gap in gaps:
        at += gap
        ends.append(at)
    pool = pool.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("_r"))).cast("int"))
    both = placed.where("shard is not null").unionByName(pool.drop("_r"))
    return running(both, ["shard"], ["doc_id", "g1", "g2"], "slot", total)


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: linked documents, and those apart from the shard that holds most of their group."""
    cells = sharded.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("g1", "g2").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("all") > 1)
    return groups.agg(F.sum("all").alias("linked"), F.sum(F.col("all") - F.col("most")).alias("apart"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
