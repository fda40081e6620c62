"""Balanced label propagation: documents move towards the shard of their linked neighbours.

Links are memberships (node, link, strength): all nodes of a link are neighbours through it, so a link of any
size costs one row per member and no pairs. Equal texts are one link; texts that share a sentence, one of the SENTENCES of
each with the least hashes, another. Every step is a join or an aggregate of DataFrames; a
link held by a large share of all rows is summed per (link, shard) before it is joined, and its
join can be split because its other side has a row per link and shard.

The law is `rows`: shard sizes differ by one at most. Each round half of the nodes, those of equal texts together, ask for the shard
whose shares of their links add up to most; of the wishes from shard a to shard b as many are granted as stand
against them from b to a, plus what b's quota has free, plus one for every row of b without a link, which goes
to a in return; longest lead first. Rounds end when two in a row leave the cut no smaller. A last step moves the
surplus of overfull shards, members of no link first, so the quotas hold exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop_table, materialise, table

ORDERS, TASK_ROWS = 64, 200_000
#: Strength of the link of equal texts; a sentence's is 1. Sentences have LONG characters or more.
EQUAL, SENTENCES, LONG = 8.0, 4, 30
#: A sentence that more than this share of a shard's rows have is no link: no shard could hold it.
COMMON = 1 / 8


def _numbered(df: DataFrame, group: list[str], order: Column, name: str, spread: int) -> DataFrame:
    """Adds a number from 0 within `group`, ascending by `order`, an integer from 0 to ORDERS - 1.

    Each (group, order) is cut into `spread` buckets by a hash of the node, row_number counts within a
    bucket (by `_tie`, then node) and the sizes of the buckets before are added, so no task holds a whole
    group however large it is.
    """
    return _placed(df.withColumn("_bucket", order * spread + F.pmod(F.xxhash64("node"), F.lit(spread)).cast("int")), group, name)


def _placed(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds a number from 0 within `group`, ascending by _bucket, _tie and node. No bucket may be larger than a task."""
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_tie", "node")
    return df.withColumn("_at", F.row_number().over(inside)).join(sizes, [*group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_bucket", "_before", "_at")


def _by_link(nodes: DataFrame, where: Column, spread: int) -> DataFrame:
    """Adds _n, the number of a node by the hash `where` of its link, then node hash, then node.

    Buckets are ranges of `where`; a link of more than TASK_ROWS rows has buckets of its own inside its range,
    by node hash, between those of the links before and after it.
    """
    ranges = lambda w: F.floor(F.shiftrightunsigned(w, 33) * F.lit(ORDERS * spread) / F.lit(1 << 31)).cast("int")
    df = nodes.withColumn("_where", where).withColumn("_range", ranges(F.col("_where")))
    large = nodes.filter("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_ROWS).select(F.xxhash64("link").alias("w"))
    large = large.groupBy(ranges(F.col("w")).alias("_range")).agg(F.collect_set("w").alias("_large"))
    df = df.join(F.broadcast(large), "_range", "left").withColumn("_large", F.coalesce("_large", F.array().cast("array<long>")))
    is_large = F.array_contains("_large", F.col("_where")) & F.col("link").isNotNull()
    part = 2 * F.size(F.filter("_large", lambda x: x < F.col("_where"))) + is_large.cast("int")
    piece = F.when(is_large, F.pmod(F.xxhash64("node"), F.lit(ORDERS * spread)).cast("int")).otherwise(0)
    df = df.withColumn("_bucket", F.struct(F.col("_range").alias("r"), part.alias("p"), piece.alias("h")))
    df = df.withColumn("_tie", F.struct(F.col("_where").alias("w"), F.xxhash64("node").alias("h"))).withColumn("_all", F.lit(0))
    return _placed(df.drop("_range", "_large", "_where"), ["_all"], "_n")


def propagate(nodes: DataFrame, shards: int, rounds: int = 6, slack: float = 0.0, others: DataFrame | None = None) -> DataFrame:
    """node, link, shard of every row of `nodes` (node unique, link long or null).

    `others` (node, link, strength) are further links of the same nodes; `link` has strength EQUAL.
    Rows begin in an even split by link order; a node without links has no neighbours. Ties between shards go
    to the smaller number. During the rounds a shard may hold `slack` more than its quota. No nodes give
    no rows.
    """
    total = nodes.count()
    base, extra = divmod(total, shards)
    quota = F.lit(base) + F.when(F.col("shard") < extra, 1).otherwise(0)

    spread = max(1, total // (ORDERS * TASK_ROWS))

    # Start: the number of a node in hashed link order, cut into equal runs.
    where = F.when(F.col("link").isNotNull(), F.xxhash64("link")).otherwise(F.xxhash64(F.lit("node"), "node"))
    started = _by_link(nodes, where, spread)
    cut = extra * (base + 1)
    shard = F.when(F.col("_n") < cut, F.floor(F.col("_n") / (base + 1))).otherwise(F.lit(extra) + F.floor((F.col("_n") - cut) / max(base, 1)))
    state = materialise(started.select("node", "link", shard.cast("int").alias("shard")), "shards-start")

    members = nodes.filter("link is not null").select("node", F.xxhash64(F.lit("equal"), "link").alias("link"), F.lit(EQUAL).alias("strength"))
    if others is not None:
        members = members.unionByName(others.select("node", F.xxhash64(F.lit("other"), "link").alias("link"), F.col("strength").cast("double")))
    members = materialise(members, "members")
    linked = members.select("node").distinct()
    least, since = None, 0
    for number in range(rounds):
        held = materialise(_held(members, state), "held")
        now = cut_of(held)
        since = 0 if least is None or now < least else since + 1
        least = now if least is None else min(least, now)
        if now == 0 or since == 2:
            break
        active = F.pmod(F.xxhash64(F.coalesce(F.xxhash64("link"), F.xxhash64(F.lit("node"), "node")), F.lit(number // 2)), F.lit(2)) == number % 2
        wishes = materialise(_wishes(members, held, state.filter(active)), "wishes")
        free = state.groupBy("shard").agg(F.count(F.lit(1)).alias("held")).select("shard", (F.floor(quota * (1 + slack)) - F.col("held")).alias("free"))
        granted = _granted(wishes, free, state.join(linked, "node", "left_anti").select("node", "shard"), spread)
        moved = state.join(granted, "node", "left").select("node", "link", F.coalesce("to", "shard").alias("shard"))
        after = materialise(moved, f"shards-{number}")
        for done in (state, held, wishes):
            drop_table(done)
        state = after
    drop_table(members)
    return _settle(state, quota, shards, spread)


def _held(members: DataFrame, state: DataFrame) -> DataFrame:
    """link, shard, n, total, strength: a link's members in each shard where it has some, and in all."""
    held = members.join(state.select("node", "shard"), "node").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("strength"))
    sizes = held.groupBy("link").agg(F.sum("n").alias("total"))
    return held.join(sizes, "link")


def cut_of(held: DataFrame) -> float:
    """What the propagation lowers: the members of each link outside the shard that has most of them, times its strength."""
    apart = held.groupBy("link").agg((F.max("total") - F.max("n")).alias("n"), F.max("strength").alias("strength"))
    return apart.agg(F.sum(F.col("n") * F.col("strength"))).first()[0] or 0.0


def _wishes(members: DataFrame, held: DataFrame, state: DataFrame) -> DataFrame:
    """node, shard, to, lead, link of the nodes of `state` that another shard pulls more than their own."""
    mine = members.select("node", "link").join(state.select("node"), "node")
    pulls = mine.join(held.select("link", F.col("shard").alias("to"), (F.col("strength") * F.col("n") / F.col("total")).alias("pull")), "link")
    pulls = pulls.groupBy("node", "to").agg(F.round(F.sum("pull"), 6).alias("pull")).join(state, "node")
    best = pulls.groupBy("node").agg(
        F.first("shard").alias("shard"), F.first("link").alias("link"), F.max(F.struct("pull", (-F.col("to")).alias("minus"))).alias("best"), F.max(F.when(F.col("to") == F.col("shard"), F.col("pull"))).alias("own"),
    )
    lead = F.round(F.col("best.pull") - F.coalesce("own", F.lit(0.0)), 6)
    return best.select("node", "shard", (-F.col("best.minus")).alias("to"), lead.alias("lead"), "link").filter("to != shard and lead > 0")


def _granted(wishes: DataFrame, free: DataFrame, loose: DataFrame, spread: int) -> DataFrame:
    """node, to: per (from, to) the wishes that stand against each other, and what `to` has free and then its
    `loose` rows (node, shard; of no link) dealt to the sources in shard order. A loose row goes to the source that its
    place was granted to, so a shard is as full as before."""
    flows = wishes.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n"))
    back = flows.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("n").alias("against"))
    earlier = Window.partitionBy("to").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    both = flows.join(back, ["shard", "to"], "left").withColumn("swap", F.least("n", F.coalesce("against", F.lit(0))))
    both = both.withColumn("more", F.col("n") - F.col("swap")).withColumn("asked", F.coalesce(F.sum("more").over(earlier), F.lit(0)))
    room = free.select(F.col("shard").alias("to"), F.greatest("free", F.lit(0)).alias("free"))
    trade = loose.groupBy(F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("loose"))
    both = both.join(room, "to", "left").join(trade, "to", "left").fillna(0, ["free", "loose"])
    # Of the places 0 .. free + loose - 1 of `to` a flow gets asked .. asked + more - 1; those from `free` on are traded.
    end = F.least(F.col("asked") + F.col("more"), F.col("free") + F.col("loose"))
    limits = both.withColumn("end", F.greatest(end, F.col("asked"))).select(
        "shard", "to", (F.col("swap") + F.col("end") - F.col("asked")).alias("most"), (F.greatest("asked", "free") - F.col("free")).alias("first"), (F.greatest("end", "free") - F.col("free")).alias("end"),
    )
    lead_bucket = F.greatest(F.lit(0), ORDERS - 1 - F.floor(F.col("lead") * 4).cast("int"))
    ranked = _numbered(wishes.withColumn("_tie", F.struct(-F.col("lead"), F.coalesce("link", F.lit(0)))), ["shard", "to"], lead_bucket, "_n", spread)
    moved = ranked.join(F.broadcast(limits), ["shard", "to"]).filter("_n < most").select("node", "to")
    given = _numbered(loose.withColumn("_tie", F.lit(0)), ["shard"], F.lit(0), "_n", ORDERS * spread)
    trades = limits.filter("end > first").select(F.col("to").alias("shard"), F.col("shard").alias("goes"), "first", "end")
    returned = given.join(F.broadcast(trades), "shard").filter("_n >= first and _n < end").select("node", F.col("goes").alias("to"))
    return moved.unionByName(returned)


def _settle(state: DataFrame, quota: Column, shards: int, spread: int) -> DataFrame:
    """Moves the rows beyond each quota, small links first, into the places that are free."""
    held = state.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
    every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    gap = every.join(held, "shard", "left").select("shard", (F.coalesce("held", F.lit(0)) - quota).alias("over"))
    sizes = state.filter("link is not null").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("together"))
    rows = state.join(sizes, ["link", "shard"], "left").withColumn("together", F.coalesce("together", F.lit(1)))
    size_bucket = F.least(F.lit(ORDERS - 1), F.floor(F.log2("together")).cast("int"))
    surplus = rows.join(F.broadcast(gap.filter("over > 0")), "shard").withColumn("_tie", F.struct("together", F.coalesce("link", F.lit(0))))
    surplus = _numbered(surplus, ["shard"], size_bucket, "_n", spread).filter("_n < over").select("node", "shard", F.lit(0).alias("_all"), F.col("_n").alias("_tie"))
    leaving = _numbered(surplus, ["_all"], F.lit(0), "_n", ORDERS * spread)
    places = gap.filter("over < 0").select(F.col("shard").alias("to"), (-F.col("over")).alias("n"))
    before = Window.orderBy("to").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("to", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")
    moves = leaving.join(F.broadcast(places), (F.col("_n") >= F.col("first")) & (F.col("_n") < F.col("first") + F.col("n"))).select("node", "to")
    return state.join(moves, "node", "left").select("node", "link", F.coalesce("to", "shard").alias("shard"))


def sentence_links(docs: DataFrame, most: float) -> DataFrame:
    """node, link, strength: the SENTENCES sentences of each text (node, home, text) with the least hashes, where texts that are not equal share
    them and no more than `most` rows have them."""
    pieces = F.filter(F.split(F.lower("text"), r"[.!?\n]+\s*"), lambda x: F.char_length(x) >= LONG)
    least = F.slice(F.array_sort(F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))), 1, SENTENCES)
    rows = materialise(docs.select("node", "home", F.explode(least).alias("link")), "sentences")
    shared = rows.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.min("home").alias("a"), F.max("home").alias("b")).filter((F.col("a") != F.col("b")) & (F.col("n") <= most))
    return rows.join(shared.select("link"), "link").select("node", "link", F.lit(1.0).alias("strength"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the link of every row of `docs`.

    Documents with equal texts are linked, and those that share a sentence. Null texts count as empty, have size 1 and are linked to
    empty texts. A row is known by its doc_id, where those are unique and not null, else by doc_id, text hash and a number
    among rows with the same two, so the result does not depend on how the rows are stored. A very long text is
    split like others; no rows give none. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    link = F.xxhash64(text)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
    if repeated:
        slim = docs.select("doc_id", F.col("text"), F.row_number().over(Window.partitionBy("doc_id", link).orderBy("doc_id")).alias("_again"))
        node = F.struct("doc_id", link.alias("text"), F.col("_again").alias("again"))
    else:
        slim, node = docs.select("doc_id", "text"), F.col("doc_id")
    slim = slim.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), link.alias("link"), node.alias("node"), "text")
    total = docs.count()
    others = materialise(sentence_links(slim.withColumnRenamed("link", "home"), max(2.0, COMMON * total / shards)), "sentence-links")
    slim = materialise(slim.drop("text"), "sizes")
    # a text of one row has no equal ones
    linked = slim.groupBy("link").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("link", F.lit(True).alias("linked"))
    nodes = materialise(slim.join(linked, "link", "left").select("node", F.when(F.col("linked"), F.col("link")).alias("link")), "links")
    placed = materialise(propagate(nodes, shards, rounds, others=others).select("node", "shard"), "placed")
    spread = max(8, total // (shards * TASK_ROWS))
    slot = _numbered(placed.withColumn("_tie", F.lit(0)), ["shard"], F.lit(0), "slot", spread).select("node", "shard", "slot")
    out = slim.join(slot, "node")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "link")


def op8_balanced_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of `documents` under the law `rows`."""
    return shard_documents(table(spark, sf_dir, "documents"))
