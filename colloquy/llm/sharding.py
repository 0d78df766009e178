"""Sharding by a hierarchical weighted hash tree, with DataFrame operations only.

Shards stand in racks and racks in regions. A row descends the tree: at each level every child
draws -ln(u) / weight, where u is a hash of the row's key and the child's name, and the
smallest draw wins, so a child gets a share in proportion to its weight. A weight that changes
moves rows only between the subtrees on its path and the rest: a draw depends on nothing but
the key, the child and the child's own weight.

``shard_tree(n, base)`` lays ``base`` shards out in full regions and gives each shard
beyond a region of its own. So one more shard adds one child at the top and changes no other draw: rows move
into it and nowhere else. (A shard added inside a rack would also raise its rack's weight, and
rows drawn to the rack would be dealt over all of its shards.) Folding added shards into full regions is a
re-sharding, done by raising ``base``.

The law is `key`: the id and the number of shards decide, so copies of a text with different
ids may part. Slots number the rows of a shard in blocks of a hash, so no shard is ordered in one task.

Cases: a null id is a key of its own (all null ids in one shard); a null text has 16 bytes and
checksum 0; repeated rows share a shard and get different slots; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import unsigned_share, whole_text
from colloquy.plans.runtime import materialize

SHARDS = 40
RACKS, WIDTH = 2, 4  # racks in a region, shards in a rack
BLOCKS = 4096  # blocks that number the slots of a shard

_LEAF = "name string, weight double, shard int"
_RACK = f"name string, weight double, children array<struct<{_LEAF}>>"
TREE = f"array<struct<name string, weight double, children array<struct<{_RACK}>>>>"


def shard_tree(shards: int, base: int | None = None, weights: dict[int, float] | None = None) -> list[dict]:
    """Regions of racks of shards; a node weighs what its shards weigh (1 each unless given)."""
    base = min(shards, shards if base is None else base)
    weight = lambda s: float((weights or {}).get(s, 1))
    per_region = RACKS * WIDTH
    groups = [list(range(r * per_region, min(base, (r + 1) * per_region))) for r in range(ceil(base / per_region))]
    regions = []
    for r, members in enumerate(groups + [[s] for s in range(base, shards)]):
        racks = []
        for k in range(ceil(len(members) / WIDTH)):
            own = members[k * WIDTH:(k + 1) * WIDTH]
            leaves = [{"name": f"s{s}", "weight": weight(s), "shard": s} for s in own]
            racks.append({"name": f"r{r}k{k}", "weight": sum(x["weight"] for x in leaves), "children": leaves})
        regions.append({"name": f"r{r}", "weight": sum(x["weight"] for x in racks), "children": racks})
    return regions


def _winner(children: Column, key: Column) -> Column:
    draws = F.transform(children, lambda c: F.struct(
        (-F.log(unsigned_share(F.xxhash64(key, c["name"]))) / c["weight"]).alias("draw"), c.alias("child")))
    return F.array_min(draws)["child"]


def shard_of(key: Column, tree: list[dict]) -> Column:
    """The shard that ``key`` reaches: region, then rack, then shard."""
    regions = F.from_json(F.lit(json.dumps(tree)), TREE)
    rack = _winner(_winner(regions, key)["children"], key)
    return _winner(rack["children"], key)["shard"]


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more) for every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    narrow = docs.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(whole_text(F.col(text))) + 16).cast("bigint").alias("size"),
                         F.crc32(whole_text(F.col(text))).cast("bigint").alias("text_crc32"))
    placed = materialize(narrow.select(
        "*", shard_of(key, shard_tree(shards)).alias("shard"),
        shard_of(key, shard_tree(shards + 1, base=shards)).alias("grown_shard"), F.xxhash64(key).alias("h")))
    placed = placed.withColumn("block", F.shiftrightunsigned("h", 64 - BLOCKS.bit_length() + 1).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("h", "doc_id", "size", "text_crc32")
    return (placed.withColumn("place", F.row_number().over(inside)).join(bases, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard"))
