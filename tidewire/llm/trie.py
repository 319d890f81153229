"""Conversation prefix trie, built level by level.

At each depth the live conversations are grouped by (node they are at, next turn); the
smallest conversation of a group names the new node. A conversation alone in its node
leaves the live set: what follows of it is a chain of its own, made in one pass at the
end. Reverse joins then carry leaves and savings from each level to the one above.
A node is known by its depth and its smallest conversation.

Groups may hold a third of all conversations: they are counted by (node, turn, salt)
before (node, turn), and a group's name returns to its conversations by the salts that
it has. Each level is a table in the shared folder. There are as many levels as the
longest prefix that two conversations share.

Defined results: turns are ordered by number, nulls first, then role and text; a null
role or text is empty; equal rows are turns of their own; rows without a conversation
take no part; an empty table has no root and no nodes. Turns are told apart by the
SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shared import mapped, new_folder, written

#: parts that a group of one level is counted in before it is counted whole
SALTS = 256
#: levels whose turns have a folder of their own; deeper ones share one with all up to twice the depth
OWN_SLABS = 32
#: bytes of joined ids that are one row
CHUNK_BYTES = 1 << 20

_SLAB = f"if(depth <= {OWN_SLABS}, depth, {OWN_SLABS} + int(log2(depth)))"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, size): turns numbered from 0 in each conversation, by digest and bytes of the text.

    Rows are sorted over all tasks and numbered by partition, so no task has to hold a whole conversation.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("conv_id", "part", (F.col("first") - earlier).alias("zero"))
    return written(rows.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("zero")).alias("at"), "key", "size"), "numbered")


def _levels(turns: DataFrame, lengths: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(members of every level down to the last that conversations share, turns as laid out by depth)."""
    spark = turns.sparkSession
    folder = new_folder(spark, "slabs")
    laid = turns.select("conv_id", "depth", "key", "size", F.expr(_SLAB).cast("int").alias("slab")).repartitionByRange("slab", "depth", "conv_id")
    laid.write.partitionBy("slab").parquet(folder)
    turns = spark.read.schema(laid.schema).parquet(folder)
    root = lengths.agg(F.min("conv_id"), F.count("*")).first()
    top = lengths.select("conv_id", "length", F.lit(None).cast("long").alias("parent"), F.lit(root[0]).cast("long").alias("node"), F.lit(root[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))
    levels = [written(top, "level")]
    while True:
        depth = len(levels)
        live = levels[-1].where((F.col("n_convs") > 1) & (F.col("length") >= depth))
        if live.isEmpty():
            return levels, turns
        slab = depth if depth <= OWN_SLABS else OWN_SLABS + depth.bit_length() - 1
        step = live.select("conv_id", "length", F.col("node").alias("parent")).join(turns.where((F.col("slab") == slab) & (F.col("depth") == depth)).select("conv_id", "key", "size"), "conv_id")
        group = ["parent", "key", "salt"]
        dealt = step.withColumn("salt", F.expr(f"int(pmod(xxhash64(conv_id), {SALTS}))")).repartition(*group)
        parts = dealt.groupBy(*group).agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
        groups = parts.groupBy("parent", "key").agg(F.min("node").alias("node"), F.sum("n").alias("n_convs"), F.collect_list("salt").alias("salts"))
        named = groups.select("parent", "key", "node", "n_convs", F.explode("salts").alias("salt"))
        levels.append(written(dealt.join(named, group).select("conv_id", "length", "parent", "node", "n_convs", "size"), "level"))


def _rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """Nodes of every level with children, leaves and savings of their subtrees, from the deepest level up."""
    above: list[DataFrame] = []
    children = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].where("conv_id = node").select(F.col("node").alias("conv_id"), "parent", "n_convs", "length", "size")
        if children is None:
            nodes = nodes.select("*", *(F.lit(None).cast("long").alias(c) for c in ("below", "leaves", "saved")))
        else:
            nodes = nodes.join(children, "conv_id", "left")
        own = (F.col("n_convs") - 1) * F.col("size")
        chained = F.when((F.col("n_convs") == 1) & (F.col("length") > depth), 1)
        nodes = nodes.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            F.coalesce(chained, "below", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.when((F.col("n_convs") == 1) & (F.col("length") == depth), F.col("conv_id")).alias("only_end"),
        )
        nodes = written(nodes, "nodes")
        above.append(nodes)
        children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return above


def joined_digests(ends: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of the comma-joined ids of each (node, depth), ascending.

    Ids are sorted over all tasks and joined to chunks of bounded bytes. A digest goes over its bytes in order,
    so the chunks of one node then stream through one task, one at a time.
    """
    order = ["node", "depth", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids, size = None, None, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": [at[0]], "depth": [at[1]], "first": [first], "ids": [",".join(ids).encode()]})

        for batch in batches:
            for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if at != (node, depth) or size >= chunk_bytes:
                    if ids:
                        yield chunk()
                    at, first, ids, size = (node, depth), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"node": [at[0]], "depth": [at[1]], "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if at != (node, depth):
                    if at:
                        yield row()
                    at, state = (node, depth), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if at:
            yield row()

    chunks = mapped(ends.repartitionByRange(*order).sortWithinPartitions(*order), join, "node long, depth long, first long, ids binary")
    return mapped(chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "first"), digest, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node of the trie of conversations.

    ``turns`` has conv_id, depth (from 1), key and size; ``lengths`` has every conv_id once, with its number of turns.
    """
    levels, turns = _levels(turns, lengths)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    at_depth = [level.withColumn("depth", F.lit(d).cast("long")) for d, level in enumerate(levels)]
    singles = union(at_depth).where("n_convs = 1").select("conv_id", "length", F.col("depth").alias("top"))
    tails = turns.select("conv_id", F.col("depth").cast("long").alias("depth")).join(singles, "conv_id").where("depth > top")
    tails = tails.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.expr("if(depth < length, 1L, 0L)").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.expr("if(depth = length, conv_id, null)").alias("only_end"),
    )
    ends = union(at_depth).where("n_convs > 1 and length = depth").select("node", "depth", "conv_id")
    digests = joined_digests(ends).withColumnRenamed("node", "conv_id")
    shared = union(_rolled_up(levels)).join(digests, ["conv_id", "depth"], "left")
    nodes = shared.unionByName(tails.withColumn("ends_sha256", F.lit(None).cast("string")))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.coalesce(F.col("only_end").cast("string"), F.lit("")), 256))).drop("only_end")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = ordered_turns(conversations).withColumn("depth", F.col("at") + 1)
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) with the first turns of conversation c - c % 5 before the rest of each conversation c."""
    turns = ordered_turns(conversations)
    whole = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    plan = whole.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9).withColumn("base", F.expr("conv_id - conv_id % 5"))
    plan = plan.join(whole.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = plan.select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("k"), "n")
    plan = written(plan.select("conv_id", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "plan")
    own = turns.join(plan, "conv_id").where("at >= h").select("conv_id", F.expr("at - h + k + 1").alias("depth"), "key", "size")
    heads = turns.where("at < 8 and conv_id % 5 = 0").select(F.explode(F.expr("if(conv_id < 0, sequence(conv_id - 4, conv_id), if(conv_id > 0, sequence(conv_id, conv_id + 4), sequence(-4L, 4L)))")).alias("conv_id"), "at", "key", "size")
    heads = heads.join(plan.select("conv_id", "h"), "conv_id").where("at < h").select("conv_id", F.expr("at + 1").alias("depth"), "key", "size")
    return own.unionByName(heads), plan.select("conv_id", "length")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda bits, step: xor(bits >> 1, 3988292384 * (bits & 1)))), 4294967295)"""

OP12_SQL = f"""
with t as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as at,
        coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null),
c as (select conv_id, count(*) as n from t group by conv_id),
h as (select conv_id, n, {_CRC} % 9 as h from c),
plan as (select h.conv_id, h.h, least(h.h, coalesce(b.n, 0)) as k, h.conv_id - h.conv_id % 5 as base from h left join c b on b.conv_id = h.conv_id - h.conv_id % 5),
turns as (
    select p.conv_id, t.at as place, t.role, t.text from plan p join t on t.conv_id = p.base and t.at < p.h
    union all
    select p.conv_id, t.at - p.h + p.k, t.role, t.text from plan p join t on t.conv_id = p.conv_id and t.at >= p.h),
paths as (
    select p.conv_id, coalesce(q.path, []) as path from plan p
    left join (select conv_id, list({{'role': role, 'text': text}} order by place) as path from turns group by conv_id) q using (conv_id)),
members as (select conv_id, depth, path[1:depth] as prefix, len(path) = depth as ends from paths, lateral (select unnest(range(len(path) + 1)) as depth)),
nodes as (
    select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) as ends,
        (count(*) - 1) * coalesce(octet_length(encode(prefix[depth].text)), 0) as saved
    from members group by prefix, depth),
childless as (select n.* from nodes n where not exists (select 1 from nodes m where m.depth = n.depth + 1 and m.prefix[1:n.depth] = n.prefix)),
ancestry as (select n.prefix[1:d] as prefix, d as depth, n.saved, n.conv_id, n.depth as below from nodes n, lateral (select unnest(range(n.depth + 1)) as d)),
sums as (
    select a.prefix, a.depth, sum(a.saved)::bigint as saved_tokens, count(*) filter (a.below = a.depth + 1) as n_children,
        count(*) filter (exists (select 1 from childless x where x.conv_id = a.conv_id and x.depth = a.below)) as n_leaves
    from ancestry a group by a.prefix, a.depth)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join sums s on s.depth = n.depth and s.prefix = n.prefix
left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
"""
