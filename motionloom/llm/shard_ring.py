"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in SQL only.

The ring has 2**RING_BITS positions, or as many more as give each virtual node 32 of them.  Each shard owns
``virtual_nodes``; one whose position is taken moves on to the next free one, so none is lost.  A row belongs
to the first virtual node at or clockwise after the position of its hashed id.  Without ``slack`` a
shard takes ``rows div shards`` rows, and the first ``rows mod shards`` shards one more, so counts are
at most one apart (law ``rows``); with it each takes up to (1 + slack) times its even part (law
``bounded``).  Rows at home are taken first, in ring order; those beyond a full shard continue
clockwise to the next shard that has room.  So only the overflow moves: the more slack, the fewer
rows change places when a shard is added.

Where each row goes depends only on how many rows each arc of the ring holds: the arcs' counts
(shards x virtual_nodes of them, whatever the input) are folded into ranges of ranks, and a row
finds its shard by its rank in its arc.  Ranks are taken for each ring position; a position that
holds far more than its part of the rows (one id, or null, many times) is dealt into SALTS cells by
the row's number in the work table, so no id is one task's work.  Rows are written once and shuffled
once, without their text.

Null and empty texts have size 1.  Equal ids, and null ids, share a ring position; rows equal in id
and text differ only in their slots.  An empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_of

RING_BITS = 14
SALTS = 256


def ring_bits(shards: int, virtual_nodes: int) -> int:
    """The ring's size as a power of two: it depends on the virtual nodes alone."""
    return max(RING_BITS, (32 * shards * virtual_nodes - 1).bit_length())


def ring_positions(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """pos, arc, owner of every ring position."""
    bits, n = ring_bits(shards, virtual_nodes), shards * virtual_nodes
    nodes = spark.sql(f"""
        SELECT shard, hash, cast(shiftrightunsigned(hash, {64 - bits}) AS int) AS pos
        FROM (SELECT shard, xxhash64(shard, node, 'node') AS hash FROM (SELECT cast(id % {shards} AS int) AS shard, cast(id div {shards} AS int) AS node FROM range({n})))""")
    order = Window.orderBy("pos", "hash", "shard")
    placed = nodes.withColumn("arc", F.row_number().over(order) - 1)
    # The next free position is the largest lead over the own place so far; the last nodes stay inside the ring.
    lead = F.max(F.col("pos") - F.col("arc")).over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    arcs = placed.select(F.least(lead + F.col("arc"), F.lit((1 << bits) - n) + F.col("arc")).alias("pos"), "shard", "arc")
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("pos")).join(arcs, "pos", "left")
    onward = Window.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one pass, unlike a frame to the end
    whole = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c: F.coalesce(F.last(c, True).over(onward), F.first(c, True).over(whole))
    return every.select("pos", at("arc").alias("arc"), at("shard").alias("owner"))


def placement(arcs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """(arc, owner, n) of every arc -> (arc, shard, lo, hi, slot): ranks lo..hi-1 of the arc go to that shard."""
    one = arcs.agg(F.sort_array(F.collect_list(F.struct("arc", "owner", "n"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = f"cast(ceil((1 + {slack}D) * total / {shards}) AS bigint)" if slack else f"total div {shards} + if(s < total % {shards}, 1L, 0L)"
    one = one.selectExpr("arcs", "transform(arcs, a -> a.owner) AS owners", f"transform(sequence(0, {shards - 1}), s -> {room}) AS room")
    taken = "named_struct('room', transform(st.room, (v, k) -> v - if(k = a.owner, least(a.n, st.room[a.owner]), 0L)), 'home', array_append(st.home, least(a.n, st.room[a.owner])))"
    one = one.selectExpr("arcs", "owners", f"aggregate(arcs, named_struct('room', room, 'home', cast(array() AS array<bigint>)), (st, a) -> {taken}) AS st")
    one = one.selectExpr(
        "st.room AS room",
        """transform(arcs, (a, i) -> named_struct('arc', a.arc, 'owner', a.owner, 'home', st.home[i], 'over', a.n - st.home[i],
             'onward', array_distinct(concat(slice(owners, i + 2, size(owners)), slice(owners, 1, i + 1))))) AS arcs""",
    )
    piece = "named_struct('arc', a.arc, 'shard', s, 'lo', t.at, 'hi', t.at + least(t.left, t.room[s]))"
    inner = f"""aggregate(a.onward,
        named_struct('room', st.room, 'out', st.out, 'at', a.home, 'left', a.over),
        (t, s) -> named_struct(
          'room', transform(t.room, (v, k) -> v - if(k = s, least(t.left, t.room[s]), 0L)),
          'out', if(least(t.left, t.room[s]) > 0, array_append(t.out, {piece}), t.out),
          'at', t.at + least(t.left, t.room[s]), 'left', t.left - least(t.left, t.room[s])),
        t -> named_struct('room', t.room, 'out', t.out))"""
    none = "cast(array() AS array<struct<arc:int,shard:int,lo:bigint,hi:bigint>>)"
    one = one.selectExpr(
        f"""concat(transform(arcs, a -> named_struct('arc', a.arc, 'shard', a.owner, 'lo', 0L, 'hi', a.home)),
              aggregate(filter(arcs, a -> a.over > 0), named_struct('room', room, 'out', {none}), (st, a) -> {inner}).out) AS pieces"""
    )
    before = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    return one.selectExpr("inline(pieces)").where("hi > lo").withColumn("slot", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before), F.lit(0)))


def _cells(rows: DataFrame, hot_rows: int, bits: int) -> DataFrame:
    """``rows`` with the salt of their cell: 0, or one of SALTS where a position holds very many rows.

    At most one position in 64 can hold 64 times the mean, so there are few cells beyond the positions.
    """
    per_pos = rows.groupBy("pos").agg(F.count("*").alias("n"))
    every = per_pos.agg(F.sum("n").alias("total"))
    many = F.greatest(F.lit(hot_rows), F.expr(f"64 * total / {1 << bits}"))
    hot = per_pos.join(F.broadcast(every), F.col("n") > many).select("pos", F.lit(True).alias("hot"))
    return rows.join(F.broadcast(hot), "pos", "left").withColumn("salt", F.when(F.col("hot"), F.expr(f"cast(pmod(row, {SALTS}) AS int)")).otherwise(0))


def shard_rows(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.0, hot_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under these laws) of every row."""
    spark = docs.sparkSession
    bits = ring_bits(shards, virtual_nodes)
    # The ring positions depend on the virtual nodes alone, so they and the ranges are broadcast.
    ring = F.broadcast(ring_positions(spark, shards, virtual_nodes))
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text_of(text_col)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text_of(text_col), "UTF-8")).alias("text_crc32"),
        key.alias("key"),
        F.shiftrightunsigned(key, 64 - bits).cast("int").alias("pos"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written, so that a row keeps its number whenever a task is run again.
    rows = _cells(materialise(rows, "shard-rows"), hot_rows, bits)
    per_cell = rows.groupBy("pos", "salt").agg(F.count("*").alias("n"))
    in_ring = per_cell.join(ring, "pos", "right").select("pos", F.coalesce("salt", F.lit(0)).alias("salt"), "arc", "owner", F.coalesce("n", F.lit(0)).alias("n"))
    before = Window.partitionBy("arc").orderBy("turn", "pos", "salt").rowsBetween(Window.unboundedPreceding, -1)
    # Positions after the last virtual node wrap round to arc 0 and come first in it.
    turned = in_ring.withColumn("turn", F.when((F.col("arc") == 0) & (F.col("pos") > F.lit(1 << (bits - 1))), 0).otherwise(1))
    starts = turned.select("pos", "salt", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranges = placement(in_ring.groupBy("arc", "owner").agg(F.sum("n").alias("n")), shards, slack)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pos", "salt").orderBy("key", "doc_id", "text_crc32", "size")) - 1)
    placed = ranked.join(F.broadcast(starts), ["pos", "salt"]).withColumn("rank", F.col("rank") + F.col("start"))
    held = placed.join(F.broadcast(ranges), (placed.arc == ranges.arc) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return held.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bounded" if slack else "rows").alias("law"),
        "shard",
        (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
