"""Balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Every document starts in the shard that
its id hashes to. In each round the linked documents of one group in one shard
(a cell) look at their neighbours' shards and ask to move where most of them
are, among the shards that have room. A shard admits requests up to its quota, whole
cells at a time, by a hash of the cell and round, so no ranking of requests is needed.
Cells and not documents are joined and counted: a group has at most as many cells as
there are shards, so a group of any size is a few rows. A group that found no room in
the rounds is gathered after them where most of it is, and the rest gives way in the cut.

The law is `rows`: after the last round the documents are put in order of label, group
and id, unlinked rows at both ends of their label, and cut into shards whose counts are at most one apart; only groups
larger than a shard, or at a cut that no unlinked rows cover, stay apart, and those in adjacent shards, one more than they fill at
most. The order's ranks come from counts of small bins, and a large group has bins of its
own, so no bin grows with a group.

Size is the text's UTF-8 bytes (null: none) plus 8. Null texts are linked with empty ones. Null ids
are allowed, as are repeated rows: each row has a slot of its own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.runtime import save

SHARDS = 24
ROUNDS = 5
#: How far a shard may exceed the even share while labels move.
SLACK = 1.05
#: Bins of groups per label, and rows beyond which a group has bins of its own (more if there are more than BIN_ROWS * 100,000 rows,
#: fewer if that is over a thousandth of the rows).
BINS, BIN_ROWS = 1024, 10_000


def _nodes(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("grp"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).cast("int").alias("start"),
        # rows of one id, or without, are told apart; the number is written before it is used
        F.monotonically_increasing_id().alias("row"),
    )


def propagate(cells: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """cells (grp, start, n, load) with their final label; load counts the unlinked rows of shard `start`.

    Linked cells have n > 0 and load 0; one cell per shard with grp null carries its unlinked rows.
    After any rounds all cells of a group have one label, whether or not that shard had room.
    """
    cap = SLACK * rows / shards
    state = cells.withColumn("label", F.col("start"))
    for turn in range(rounds):
        held = state.groupBy("label").agg(F.sum(F.col("n") + F.col("load")).alias("held"))
        # one row per shard: as many as there are shards
        room = F.broadcast(held.select("label", F.greatest(F.lit(cap) - F.col("held"), F.lit(0.0)).alias("room")))
        linked = state.where("grp is not null")
        votes = linked.groupBy("grp", "label").agg(F.sum("n").alias("votes")).join(room, "label", "left").withColumn("room", F.coalesce("room", F.lit(cap)))
        whole = votes.groupBy("grp").agg(F.sum("votes").alias("all"), F.max_by(F.struct("label", "votes", "room"), F.struct(F.col("room") + F.col("votes") > 0, "votes", F.xxhash64("grp", "label"))).alias("top"))
        # a group asks for its top shard if that could hold it, else each of its cells stays
        asked = whole.where(F.col("all") - F.col("top.votes") <= F.col("top.room")).select("grp", F.col("top.label").alias("goal"))
        moves = linked.join(asked, "grp", "left").withColumn("goal", F.coalesce("goal", "label"))
        wants = moves.where("goal <> label").groupBy(F.col("goal").alias("label")).agg(F.sum("n").alias("wants"))
        quota = F.broadcast(wants.join(room, "label", "left").select(F.col("label").alias("goal"), F.least(F.coalesce("room", F.lit(cap)) / F.col("wants"), F.lit(1.0)).alias("quota")))
        luck = F.pmod(F.xxhash64("grp", "goal", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        settled = moves.join(quota, "goal", "left").withColumn("label", F.when((F.col("goal") != F.col("label")) & (luck < F.col("quota")), F.col("goal")).otherwise(F.col("label")))
        state = save(settled.select(*state.columns).unionByName(state.where("grp is null")))
    if not rounds:
        return state
    linked = state.where("grp is not null")
    votes = linked.groupBy("grp", "label").agg(F.sum("n").alias("votes"))
    home = votes.groupBy("grp").agg(F.max_by("label", F.struct("votes", F.xxhash64("grp", "label"))).alias("home"))
    gathered = linked.join(home, "grp").withColumn("label", F.col("home"))
    return gathered.select(*state.columns).unionByName(state.where("grp is null"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every row of docs with its shard and its slot there."""
    nodes = save(_nodes(docs, shards))
    rows = nodes.count()
    groups = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    counted = nodes.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n")).join(groups, "grp")
    linked = counted.where("members > 1").select("grp", "start", "n", F.lit(0).cast("long").alias("load"))
    single = counted.where("members = 1").groupBy("start").agg(F.sum("n").alias("load")).select(F.lit(None).cast("long").alias("grp"), "start", F.lit(0).cast("long").alias("n"), "load")
    cells = save(linked.unionByName(single))
    final = propagate(cells, rows, shards, rounds).where("grp is not null").select("grp", "start", "label")
    # nodes of unlinked groups keep their start
    # a gathered group's rows share a label, so its bins are small beside the rows: some thousands of bins, or rows / large
    large = F.lit(min(max(BIN_ROWS, rows // 100_000), max(rows // 1000, 100)))
    wide = groups.where("members > 1").join(final, "grp").select("grp", "start", "label", "members")
    placed = nodes.join(wide, ["grp", "start"], "left").withColumn("label", F.coalesce("label", "start"))
    own = F.col("members") > large
    placed = placed.withColumns(
        {
            "bin": F.pmod("grp", F.lit(BINS)),
            "big": F.when(own, F.col("grp")),
            "sub": F.when(own, F.pmod(F.xxhash64("row"), F.ceil(F.col("members") / large))).otherwise(F.lit(0)),
        }
    )
    # unlinked rows stand at both ends of their label, so that the cuts fall among them
    placed = placed.withColumn("side", F.when(F.col("members").isNull(), 2 * (F.col("bin") % 2)).otherwise(F.lit(1)))
    placed = save(placed.select("doc_id", "size", "crc", "grp", "row", "label", "side", "bin", "big", "sub"))
    order = ["label", "side", "bin", "big", "sub"]
    bins = placed.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    # at most twice shards * BINS bins and rows / large more: bounded, whatever the input
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(bins.select("label", "side", "bin", F.col("big").alias("_big"), "sub", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")))
    within = Window.partitionBy(*order).orderBy("grp", "doc_id", "row")
    same = [placed[c] == before[c] for c in ("label", "side", "bin", "sub")]
    ranked = placed.withColumn("within", F.row_number().over(within) - 1).join(before, [*same, placed["big"].eqNullSafe(before["_big"])])
    ranked = ranked.select("doc_id", "size", "crc", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div {max(rows, 1)}").cast("int"))
    return ranked.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
