"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard stands on the ring at ``replicas`` virtual nodes. A row belongs to the first
virtual node clockwise of its key's position. Each shard may hold floor or ceil of
rows/shards (so that counts differ by one at most), and spreads that quota over its own
virtual nodes in proportion to what arrives there; rows beyond a node's quota continue
clockwise to the next node with room. Only what overflows moves.

What passes each node follows from the counts at the nodes alone (a queue's recursion:
a running minimum of prefix sums), so the sequential walk becomes window functions over
a table of ``shards * replicas`` rows. Rows are numbered at their node without texts: equal
rows (id, size and checksum) are one with a count, and a node of over RANKED rows is numbered
in that many pieces, dealt by a hash of the whole row, so that no id makes a task large.

Null ids hash like any value (all to one position), repeated rows are placed one by one,
null text has size ``overhead``, an empty table gives an empty result, and further
columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

#: Positions on the ring; the tables over it are broadcast and have at most so many rows.
CELLS = 1 << 16
#: Rows that are numbered in one piece, about.
RANKED = 100_000


def _cell(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(CELLS)).cast("int")


def nodes(spark, shards: int, replicas: int) -> DataFrame:
    """Virtual nodes: node (0.. in ring order), shard, cell. Equal cells are ordered by shard and replica."""
    if shards < 1 or shards * replicas > CELLS:
        raise ValueError("shards * replicas must be between 1 and the number of cells")
    points = spark.range(shards * replicas).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica"))
    points = points.withColumn("cell", _cell(F.lit("node"), "shard", "replica"))
    order = Window.orderBy("cell", "shard", "replica")
    return points.select((F.row_number().over(order) - 1).alias("node"), "shard", "cell")


def owners(ring: DataFrame) -> DataFrame:
    """The first node clockwise of every cell (of several on one cell, the last takes it)."""
    spark = ring.sparkSession
    heads = ring.groupBy("cell").agg(F.max("node").alias("node"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(heads, "cell", "left")
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    first = ring.agg(F.min("cell").alias("cell")).join(heads, "cell").select(F.col("node").alias("first"))
    return cells.select("cell", F.last("node", ignorenulls=True).over(ahead).alias("node")).crossJoin(F.broadcast(first)).select("cell", F.coalesce("node", "first").alias("node"))


def flow(ring: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """Which ranks of each node's arrivals are served where: node, lo, hi, shard, slot of rank lo.

    ``arrivals`` has node and n. All tables here have one row per node, or two per node
    at most, whatever the input.
    """
    whole = Window.partitionBy()
    near = ring.join(arrivals, "node", "left").select("node", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    by_shard = Window.partitionBy("shard")
    here = by_shard.orderBy("node")
    t = near.withColumn("total", F.sum("n").over(whole)).withColumn("mine", F.sum("n").over(by_shard))
    t = t.withColumn("cap", F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)"))
    # The quota of a shard's first i nodes: in proportion to their arrivals, rounded down; the last gets the rest.
    upto = F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("k", F.row_number().over(here)).withColumn("nodes", F.count(F.lit(1)).over(by_shard)).withColumn("upto", upto)
    share = F.expr("if(mine = 0, cap * k div nodes, cast(cast(upto as decimal(20,0)) * cast(cap as decimal(18,0)) div cast(mine as decimal(20,0)) as bigint))")
    t = t.withColumn("share", share)
    t = t.withColumn("quota", F.col("share") - F.lag("share", 1, 0).over(here))
    # A node's own rows come first; only what is over its quota walks on, into the room that others have.
    t = t.withColumn("own", F.least("n", "quota")).withColumns({"over": F.col("n") - F.col("own"), "room": F.col("quota") - F.col("own")})
    # The walk starts behind the node where the running surplus is least: nothing is carried into there.
    ring_order = Window.orderBy("node")
    t = t.withColumn("surplus", F.sum(F.col("over") - F.col("room")).over(ring_order.rowsBetween(Window.unboundedPreceding, 0)))
    t = written(t, "ring-quota")
    least = t.agg(F.min(F.struct("surplus", "node")).alias("m")).select(F.col("m.node").alias("cut"))
    t = t.crossJoin(F.broadcast(least)).withColumn("step", F.expr("if(node > cut, 0, 1)"))
    walk = Window.orderBy("step", "node").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("a1", F.sum("over").over(walk)).withColumn("a0", F.col("a1") - F.col("over"))
    # Quotas add up to the rows, so all the room is taken and nothing waits at the end.
    t = t.withColumn("q", F.sum("room").over(walk)).withColumn("slack", F.greatest(F.lit(0), F.max(F.col("q") - F.col("a1")).over(walk)))
    t = t.withColumn("d1", F.col("q") - F.col("slack")).withColumn("d0", F.coalesce(F.lag("d1").over(Window.orderBy("step", "node")), F.lit(0)))
    t = t.withColumn("base", F.sum(F.col("own") + F.col("d1") - F.col("d0")).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    t = written(t.select("node", "shard", "own", "a0", "a1", "d0", "d1", F.coalesce("base", F.lit(0)).alias("base")), "ring-flow")
    a = t.filter("a1 > a0").select("node", F.col("own").alias("from"), "a0", "a1")
    d = t.filter("d1 > d0").select("shard", "d0", "d1", (F.col("base") + F.col("own")).alias("base"))
    stay = t.filter("own > 0").select("node", F.lit(0).cast("bigint").alias("lo"), F.col("own").alias("hi"), "shard", F.col("base").alias("at"))
    pieces = a.join(F.broadcast(d), (F.col("d0") < F.col("a1")) & (F.col("d1") > F.col("a0")))
    lo, hi = F.greatest("a0", "d0"), F.least("a1", "d1")
    move = pieces.select("node", (lo - F.col("a0") + F.col("from")).alias("lo"), (hi - F.col("a0") + F.col("from")).alias("hi"), "shard", (F.col("base") + lo - F.col("d0")).alias("at"))
    return stay.unionByName(move)


def shard(docs: DataFrame, shards: int = 40, replicas: int = 128, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null)."""
    ring = written(nodes(docs.sparkSession, shards, replicas), "ring-nodes")
    owner = F.broadcast(written(owners(ring), "ring-owners"))
    ident = F.coalesce(docs[id_col].cast("string"), F.lit("\0null"))
    counts = docs.select(_cell(F.lit("key"), ident).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    arrivals = counts.join(owner, "cell").groupBy("node").agg(F.sum("n").alias("n"))
    pieces = written(flow(ring, arrivals, shards), "ring-pieces")
    body = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(F.lit("key"), ident).alias("key"))
    alike = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("copies"))
    cuts = F.broadcast(written(arrivals.select("node", F.ceil(F.col("n") / RANKED).alias("cuts")), "ring-cuts"))  # a row per node
    dealt = alike.withColumn("cell", F.pmod("key", F.lit(CELLS)).cast("int")).join(owner, "cell").join(cuts, "node")
    dealt = written(dealt.withColumn("piece", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("cuts"))), "ring-rows")
    # A row for each piece: the input's rows over RANKED, and one a node.
    sizes = dealt.groupBy("node", "piece").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("node").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("node", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("node", "piece").orderBy("cell", "key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("copies").over(order)).join(starts, ["node", "piece"]).withColumn("first", F.col("start") + F.col("upto") - F.col("copies"))
    placed = ranked.join(F.broadcast(pieces), "node").withColumns({"x": F.greatest("first", "lo"), "y": F.least(F.col("first") + F.col("copies"), "hi")}).filter("x < y")
    placed = placed.withColumn("r", F.explode(F.sequence("x", F.col("y") - 1)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("r") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
