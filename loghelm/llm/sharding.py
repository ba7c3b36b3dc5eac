"""Sharding by balanced label propagation.

Documents are nodes, links join them, labels are shards. In each round linked documents ask for the shard that most of
their neighbours are in; a shard takes what its quota has room for, and swaps with others. Labels, votes and moves are
joins and aggregates of rows (id, label); the driver sees loads and flows between shards only.
At the end every shard gets exactly its quota of rows: rows beyond it, unlinked ones first, fill the gaps of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, materialize, unit_interval

#: Rows of a group that share one bucket of the ranking, at least; larger groups are spread over several.
GROUP_ROWS = 64
#: Buckets of the ranking in a shard, at least, and the rows that one bucket should have at most.
BUCKETS, BUCKET_ROWS = 512, 20_000


def _accepted(wanted: dict[tuple[int, int, int], int], load: dict[int, int], quota: int, shards: int) -> dict:
    """(i, j, tier) -> the share of the wanted moves i -> j that keeps shard j within its quota. Small tiers come first,
    since a small group finds room as a whole. Moves both ways between two shards are swaps and need no room."""
    share, tiers = {}, sorted({tier for *_, tier in wanted})
    swaps = {}
    for i in range(shards):
        for j in range(shards):
            ways = [sum(wanted.get((*way, t), 0) for t in tiers) for way in ((i, j), (j, i))]
            swaps[i, j] = min(ways) if i != j else 0
    for j in range(shards):
        room = max(0, quota - load.get(j, 0))
        for tier in tiers:
            for i in range(shards):
                if n := wanted.get((i, j, tier), 0):
                    swap = min(n, swaps[i, j])
                    swaps[i, j] -= swap
                    free = min(n - swap, room)
                    room -= free
                    share[i, j, tier] = (swap + free) / n
    return share


def spark_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def propagate_labels(
    nodes: DataFrame, links: DataFrame, shards: int, quota: int, rounds: int = 5, seed: int = 5
) -> DataFrame:
    """Labels of linked nodes. nodes: distinct id, weight. links: a, b, each way once or both. Returns id, label.

    In every second round a node listens only to neighbours with a smaller id, so that two nodes don't swap places; in
    the others a random half of the nodes moves. Links to ids that aren't nodes are ignored. A move's tier is the number
    of binary digits in the degree of the least connected neighbour it follows.
    """
    label = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).cast("int").alias("label")
    labels = materialize(nodes.select("id", "weight", label), "labels")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    degrees = materialize(
        both.groupBy("a").agg(F.length(F.bin(F.count(F.lit(1)))).alias("tier")).select(F.col("a").alias("b"), "tier"), "degrees"
    )
    both = materialize(both.join(degrees, "b"), "links")
    for turn in range(rounds):
        load = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
        asking = both.where("b < a") if turn % 2 == 0 else both.where(unit_interval(F.lit(turn), F.col("a")) < 0.5)
        votes = (
            asking.join(labels.select(F.col("id").alias("b"), F.col("label").alias("theirs")), "b")
            .groupBy("a", "theirs").agg(F.count(F.lit(1)).alias("n"), F.min("tier").alias("tier"))
        )
        own = labels.select(F.col("id").alias("a"), "label", "weight")
        best = F.max(F.struct("n", F.xxhash64("theirs", "a").alias("tie"), "theirs", "tier"))
        wants = (
            votes.join(own, "a").groupBy("a", "label", "weight")
            .agg(best.alias("best"), F.sum(F.when(F.col("theirs") == F.col("label"), F.col("n")).otherwise(0)).alias("here"))
            .where("best.theirs != label and best.n > here")
            .select("a", "weight", "label", F.col("best.theirs").alias("to"), "best.tier")
        )
        wants = materialize(wants, "wants")
        flows = wants.groupBy("label", "to", "tier").agg(F.sum("weight").alias("n")).collect()
        flows = {(r["label"], r["to"], r["tier"]): r["n"] for r in flows}
        if not flows:
            break
        shares = spark_map({f"{i}:{j}:{t}": share for (i, j, t), share in _accepted(flows, load, quota, shards).items()})
        limit = F.element_at(shares, F.concat_ws(":", "label", "to", "tier"))
        moved = wants.where(unit_interval(F.lit(seed), F.lit(turn), F.col("a")) < limit).select(F.col("a").alias("id"), "to")
        labels = materialize(
            labels.join(moved, "id", "left").select("id", "weight", F.coalesce("to", "label").alias("label")), "labels"
        )
    return labels.select("id", "label")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """A gapless rank from 0 in the groups of ``by``, ordered by bucket: ranks inside buckets plus the buckets' offsets."""
    counts = rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "bucket").orderBy("text_hash", "order", "doc_id")
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, [*by, "bucket"])
        .withColumn("rank", F.col("_place") + F.col("_offset")).drop("_place", "_offset", "_n")
    )


def assign_shards(rows: DataFrame, shards: int = 8, rounds: int = 5, seed: int = 5) -> DataFrame:
    """``rows`` (doc_id, text_hash, and what else is to be kept) with shard and slot. Rows should be light: they are
    shuffled twice. They are stored with a number each, so that rows that repeat, null ids included, are ranked in many
    tasks as well."""
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = materialize(rows.select(*names, F.monotonically_increasing_id().alias("row_number")), "shard-rows")
    light = rows.select("doc_id", "text_hash")
    groups = materialize(
        light.groupBy("text_hash").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1"),
        "shard-groups",
    )
    total = rows.count()
    quota, more = divmod(total, shards)

    node = lambda name: F.concat_ws(":", F.col("text_hash"), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    linked = light.join(groups, "text_hash").select(node("doc_id").alias("id"), node("hub").alias("hub"))
    nodes = materialize(linked.groupBy("id").agg(F.count(F.lit(1)).alias("weight"), F.min("hub").alias("hub")), "shard-nodes")
    links = nodes.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    labels = propagate_labels(nodes.select("id", "weight"), links, shards, quota, rounds, seed)
    labels = materialize(
        labels.join(nodes.select("id", "hub"), "id").withColumn("text_hash", F.substring("id", 1, 32))
        .join(groups.select("text_hash", "members"), "text_hash").select("id", "label", "members"),
        "shard-labels",
    )

    # Linked rows come first in the ranking of a shard, group by group; large groups take several buckets.
    buckets = max(BUCKETS, total // (shards * BUCKET_ROWS))
    order = F.xxhash64(F.lit(seed), "text_hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row_number")
    spread = F.ceil(F.col("members") / F.lit(max(GROUP_ROWS, total // (shards * buckets))))
    near = F.pmod(F.xxhash64("text_hash") + F.pmod(order, spread), F.lit(buckets))
    rows = rows.withColumn("id", node("doc_id")).join(labels, "id", "left")
    placed = rows.select(
        *names,
        F.coalesce("label", F.pmod(order, F.lit(shards)).cast("int")).alias("label"),
        order.alias("order"),
        F.coalesce(near, F.pmod(F.xxhash64("text_hash"), F.lit(buckets))).alias("near"), F.col("label").isNotNull().alias("linked"),
    ).withColumn("bucket", F.col("near") + F.when(F.col("linked"), 0).otherwise(buckets))
    placed = materialize(_ranked(placed, ["label"]), "shard-ranks")

    counts = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [quota + (s < more) for s in range(shards)]
    full: Column = F.lit(False)
    for s in range(shards):
        full = full | ((F.col("label") == s) & (F.col("rank") >= quotas[s]))
    stay = placed.where(~full).select(*names, F.col("label").alias("shard"), F.col("rank").cast("long").alias("slot"))
    # What is left of a group moves on together, as far as the gaps are wide enough.
    over = _ranked(placed.where(full).drop("rank").withColumn("bucket", F.col("near")).withColumn("all", F.lit(0)), ["all"])
    shard, slot, passed = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        have = min(counts.get(s, 0), quotas[s])
        room = quotas[s] - have
        here = (F.col("rank") >= passed) & (F.col("rank") < passed + room)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("rank") - F.lit(passed) + F.lit(have)).otherwise(slot)
        passed += room
    return stay.unionByName(over.select(*names, shard.alias("shard"), slot.cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 5, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: its columns, text_hash, shard and slot (gapless from 0 in a shard).

    Equal texts are linked. Row counts of any two shards differ by one at most. Null texts count as empty and equal; rows
    that repeat another (id included) share a node and are still placed one by one; an empty table gives an empty result.
    Columns named shard, slot or text_hash, in any case, are replaced. Rows are stored once with a number, and only numbers, ids and
    hashes take part in the placement; texts are shuffled once, to meet their place.
    """
    own = Columns(docs, "shard", "slot", "text_hash")
    stored = materialize(
        own.frame.select(
            *own.kept, own["doc_id"].alias("doc_id"), F.md5(F.coalesce(own["text"], F.lit(""))).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        ), "shard-documents",
    )
    placed = assign_shards(stored.select("row", "doc_id", "text_hash"), shards, rounds, seed)
    return own.restored(stored.join(placed.select("row", "shard", "slot"), "row"), "text_hash", "shard", "slot")


def op9_sharding(documents: DataFrame) -> DataFrame:
    """The contract's columns for shards 0 to 7 under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = documents.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("text_hash"),
    )
    out = assign_shards(light)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
