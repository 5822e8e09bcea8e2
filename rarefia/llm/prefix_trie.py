"""Conversation prefix trie by fixed-length block hashing: which conversations share which first turns, and what sharing saves.

1. A turn is the MD5 of its role and text. Its place in its conversation and the running exclusive-or of 128 hashed bits of
   (place, turn) are running values over sampled ranges, so a very long conversation is spread over tasks, too. The running
   value after d turns tells the sequence of these turns.
2. ``BLOCK`` turns are a block. Conversations are grouped by the digests at the ends of successive blocks, which makes the nodes at
   those depths. Within a block turns are grouped only where siblings diverge: the conversations that share its start don't all
   share its end. Where all do, the block is a chain, and its nodes are read off the least conversation alone; what follows
   a node of one conversation is read off that conversation.
3. Sums over a subtree need no walk. A node's cost is charged to the node's least member at the node's depth; what a member is charged
   from a depth on is a running value, too, and a node's sum is that of its members. A node without children is charged to its least
   member likewise, which counts leaves. So every aggregation is over (conversation, turn) rows and combines within tasks.
4. The conversations that end at a node are joined in pieces of ``PIECE`` ids; where a node has several, they stream in order through
   one SHA-256, which can't be split but holds a piece at a time.

Defined results: null roles and texts count as empty; rows without a conv_id belong to none and are left out; turns of a
conversation go by turn (null first), and those with one turn number by the MD5 of their role's length, role and text; rows that
repeat are turns of their own; very long texts are hashed and counted whole; a conversation may have lost all its turns
(it is a member of the root); the remainder by 20 has the sign of the conv_id, as in SQL; extra columns are not read; an empty table
has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, columns_or_null, range_of, splitters, table, written
from .mixing import word_count

#: Turns in a block; ids that are joined at a time; conversations whose first one lends its head; heads are shorter than this.
BLOCK, PIECE, FAMILY, HEADS = 4, 1_000, 20, 4
NODE = ["d", "x1", "x2"]


def running(df: DataFrame, group: list[str], order: list[str], **values: tuple[str, str]) -> DataFrame:
    """Add running values (``sum`` or ``xor`` of a column, the row's own included) of each group's rows in order, nulls first.

    Sampled splitters cut the rows of all groups into ranges, a window runs within each range and group, and what a group
    has before a range is added. A group goes on in another range only if a splitter is one of its rows, so what
    reaches the driver and is sent back is a row or two per range.
    """
    apply = {"sum": F.sum, "xor": F.bit_xor}
    keys, spark = [*group, *order], df.sparkSession
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(df.withColumn("_one", F.lit(1)), keys, "_one", parts, unique=True)
    ranged = df.withColumn("_range", range_of(df, keys, cuts))
    within = Window.partitionBy("_range", *group).orderBy(*[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({name: apply[kind](c).over(within) for name, (kind, c) in values.items()})
    torn = sorted({c[: len(group)] for c in cuts})
    if not torn:
        return out.drop("_range")
    kinds = [df.schema[g].dataType.simpleString() for g in group]
    wanted = spark.createDataFrame(torn, ", ".join(f"_{g} {t}" for g, t in zip(group, kinds)))  # fewer than there are ranges
    same = lambda left, right: [left[g] == right[f"_{g}"] for g in group]
    some = ranged.join(F.broadcast(wanted), same(ranged, wanted), "left_semi")
    sums: dict[tuple, list] = {}
    for r in some.groupBy("_range", *group).agg(*[apply[kind](c).alias(name) for name, (kind, c) in values.items()]).orderBy("_range").collect():
        sums.setdefault(tuple(r[g] for g in group), []).append(r)
    before = []
    for key, rows in sums.items():
        held = [0] * len(values)
        for r in rows:
            before.append((r["_range"], *key, *held))
            held = [h + (r[n] or 0) if kind == "sum" else h ^ (r[n] or 0) for h, (n, (kind, _)) in zip(held, values.items())]
    schema = "_r int, " + ", ".join([f"_{g} {t}" for g, t in zip(group, kinds)] + [f"_{n} long" for n in values])
    held = spark.createDataFrame(before, schema)
    out = out.join(F.broadcast(held), [out["_range"] == held["_r"], *same(out, held)], "left")
    add = lambda n, kind: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) if kind == "sum" else F.col(n).bitwiseXOR(F.coalesce(f"_{n}", F.lit(0)))
    return out.withColumns({n: add(n, kind) for n, (kind, _) in values.items()}).select(*df.columns, *values)


def own_turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, k, w, pos): the turns of each conversation with their digest, words and place from 1, without their texts."""
    rows = columns_or_null(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = written(rows.select(F.col("conv_id").alias("c"), "turn", digest.alias("k"), word_count(text).alias("w"), F.lit(1).cast("long").alias("one")))
    return written(running(turns, ["c"], ["turn", "k"], pos=("sum", "one")))


def lengths(own: DataFrame) -> DataFrame:
    """(c, base, h, head, len): the conversation whose first turns come first, how many of one's own go, how many come, and all."""
    convs = own.groupBy("c").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    convs = written(convs.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % FAMILY))
    found = convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("nb")), "base", "left").withColumn("head", F.least("h", F.coalesce("nb", F.lit(0))))
    return written(found.select("c", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))


def rebuilt(own: DataFrame, sizes: DataFrame) -> DataFrame:
    """(c, d, w, len, p1, p2, x1, x2): the turns of the rebuilt conversations, their hashes and the digests of all turns up to them."""
    lent = own.where((F.col("pos") < HEADS) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("base"), "pos", "k", "w")
    heads = sizes.where("head > 0").join(lent, "base").where("pos <= head").select("c", F.col("pos").alias("d"), "k", "w", "len")
    tails = own.join(sizes, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "k", "w", "len")
    rows = heads.union(tails).select("c", "d", "w", "len", F.xxhash64("d", "k").alias("p1"), F.xxhash64(F.lit(1), "d", "k").alias("p2"))
    return written(running(written(rows), ["c"], ["d"], x1=("xor", "p1"), x2=("xor", "p2")))


def by_blocks(turns: DataFrame, sizes: DataFrame, convs: int, least: int) -> DataFrame:
    """Turns with what is known of their block: ``b``, ``n_start`` and ``rep_start`` (the conversations that share its start, and the least
    of them; null where there is one alone), and ``chain``, whether all these share its end."""
    ends = turns.where(F.col("d") % BLOCK == 0).select("c", F.expr(f"d div {BLOCK}").alias("b"), "x1", "x2")
    shared = written(ends.groupBy("b", "x1", "x2").agg(F.count("*").alias("n"), F.min("c").alias("rep")).where("n > 1"))
    members = written(ends.join(shared, ["b", "x1", "x2"]).select("c", "b", "n", "rep"))
    starts = members.select("c", "b", F.col("n").alias("n_start"), F.col("rep").alias("rep_start"))
    if convs > 1:
        starts = starts.union(sizes.where("len > 0").select("c", F.lit(0).cast("long"), F.lit(convs).cast("long"), F.lit(least).cast("long")))
    known = starts.join(members.select("c", (F.col("b") - 1).alias("b"), F.col("n").alias("n_end")), ["c", "b"], "left")
    known = written(known.select("c", "b", "n_start", "rep_start", (F.coalesce("n_end", F.lit(0)) == F.col("n_start")).alias("chain")))
    return written(turns.withColumn("b", F.expr(f"(d - 1) div {BLOCK}")).join(known, ["c", "b"], "left"))


#: Turns whose node is one conversation's from the block's start on, those within chains, and those that are grouped.
LONE, CHAINED, GROUPED = "n_start is null", f"chain and d % {BLOCK} <> 0", f"n_start is not null and not (chain and d % {BLOCK} <> 0)"


def joined_ids(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, ends): the SHA-256 of each node's ids, ascending and joined by commas, of rows (d, x1, x2, c)."""
    placed = running(written(ends.withColumn("one", F.lit(1).cast("long"))), NODE, ["c"], i=("sum", "one"))
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = written(placed.groupBy(*NODE, F.expr(f"(i - 1) div {PIECE}").alias("piece")).agg(piece.alias("ids")))
    last = written(pieces.groupBy(*NODE).agg(F.max("piece").alias("last"), F.max(F.when(F.col("piece") == 0, F.col("ids"))).alias("ids")))
    few = last.where("last = 0").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in now], pa.array([digest.hexdigest()])], names=[*NODE, "ends"])

        for batch in batches:
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if node != now:
                    if now:
                        yield made()
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if now:
            yield made()

    many = pieces.join(last.where("last > 0").select(*NODE), NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return few.union(many.select(*NODE, "ids").mapInArrow(stream, "d long, x1 long, x2 long, ends string"))


def _grouped(turns: DataFrame) -> DataFrame:
    """The nodes that are grouped: members, least member, members that end, and the node above by its digest."""
    above = [F.first(F.col(f"x{i}").bitwiseXOR(F.col(f"p{i}"))).alias(f"y{i}") for i in (1, 2)]
    ends = F.sum((F.col("len") == F.col("d")).cast("long")).alias("n_ends")
    return written(turns.where(GROUPED).groupBy(*NODE).agg(F.count("*").alias("n"), F.min("c").alias("rep"), *above, F.first("w").alias("w"), ends, F.first("b").alias("b"), F.first("chain").alias("chain"), F.first("rep_start").alias("rep_start")))


def _charged(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """The turns that aren't lone, with ``leaf`` (the conversation stands for a node without children) and ``t``, all that it is
    charged from this turn on."""
    leaves = nodes.where("n_ends = n").select(F.col("rep").alias("c")).union(turns.where(LONE).where("d = len").select("c"))
    leaves = written(leaves.withColumn("leaf", F.lit(1).cast("long")))
    costs = nodes.where("n > 1").select(F.col("rep").alias("c"), "d", ((F.col("n") - 1) * F.col("w")).alias("cost"))
    within = F.when(F.expr(CHAINED) & (F.col("c") == F.col("rep_start")), (F.col("n_start") - 1) * F.col("w"))
    rows = turns.where("n_start is not null").join(costs, ["c", "d"], "left").join(leaves, "c", "left")
    rows = rows.select("c", "d", "w", "len", "x1", "x2", "b", "n_start", "rep_start", "chain", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"), F.coalesce("cost", within, F.lit(0)).cast("long").alias("cost"), (-F.col("d")).alias("back"))
    return written(running(written(rows), ["c"], ["back"], t=("sum", "cost")))


def _row(conv: Column, depth: Column, parent: Column, n: Column, children: Column, leaves: Column, saved: Column, ends: Column) -> list[Column]:
    named = {"conv_id": conv, "depth": depth, "parent_conv_id": parent, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return [*[c.cast("long").alias(k) for k, c in named.items()], F.coalesce(ends, none).alias("ends_sha256")]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations."""
    with Scratch(conversations.sparkSession) as scope:
        out = written(_nodes(conversations))
        scope.keep(out)
    return out


def _nodes(conversations: DataFrame) -> DataFrame:
    col, zero, one, null = F.col, F.lit(0), F.lit(1), F.lit(None)
    own = own_turns(conversations)
    sizes = lengths(own)
    all_ = sizes.agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("len").alias("longest")).head()
    turns = by_blocks(rebuilt(own, sizes), sizes, all_["n"], all_["least"] or 0)
    nodes = _grouped(turns)
    charged = _charged(turns, nodes)
    sums = charged.where(GROUPED).groupBy(*NODE).agg(F.sum("t").alias("saved"), F.sum("leaf").alias("leaves"))
    kids = written(nodes.groupBy((col("d") - 1).alias("d"), col("y1").alias("x1"), col("y2").alias("x2")).agg(F.count("*").alias("kids")))
    root_key = [zero.cast("long").alias("d"), zero.cast("long").alias("x1"), zero.cast("long").alias("x2")]
    ends = joined_ids(turns.where(GROUPED).where("d = len").select(*NODE, "c").union(sizes.where("len = 0").select(*root_key, "c")))
    above = nodes.select((col("d") + 1).alias("d"), col("x1").alias("y1"), col("x2").alias("y2"), col("rep").alias("up"))
    full = nodes.join(sums, NODE).join(kids, NODE, "left").join(ends, NODE, "left").join(above, ["d", "y1", "y2"], "left")
    first = (col("d") - 1 == col("b") * BLOCK) | col("chain")
    full = written(full.withColumn("parent", F.when(first, col("rep_start")).otherwise(col("up"))))
    grouped = full.select(*_row(col("rep"), col("d"), col("parent"), col("n"), F.coalesce("kids", (col("n_ends") < col("n")).cast("long")), col("leaves"), col("saved"), col("ends")))
    # chains: the block's end has the leaves, and the saving up to what the least conversation is charged before it
    last = full.where(f"chain and d % {BLOCK} = 0").select(col("rep").alias("c"), "b", "saved", "leaves")
    reached = charged.where(f"chain and d % {BLOCK} = 0 and c = rep_start").select("c", "b", col("t").alias("t_end"))
    chained = charged.where(CHAINED).where("c = rep_start").join(last, ["c", "b"]).join(reached, ["c", "b"])
    chained = chained.select(*_row(col("c"), col("d"), col("c"), col("n_start"), one, col("leaves"), col("saved") + col("t") - col("t_end"), null.cast("string")))
    own_end = F.when(col("d") == col("len"), F.sha2(col("c").cast("string").cast("binary"), 256))
    lone = turns.where(LONE).select(*_row(col("c"), col("d"), col("c"), one, (col("d") < col("len")).cast("long"), one, zero, own_end))
    # the root: one row of sums; its children are the first turns that occur
    tops = F.lit(1 if all_["n"] == 1 and all_["longest"] else 0)
    sums0 = charged.agg(F.coalesce(F.sum("cost"), zero).alias("saved"), F.coalesce(F.sum(F.when(col("d") == 1, col("leaf"))), zero).alias("leaves"))
    root = sums0.join(kids.where("d = 0").groupBy().agg(F.coalesce(F.sum("kids"), tops).alias("kids"))).join(ends.where("d = 0").agg(F.max("ends").alias("ends")))
    root = root.where(F.lit(all_["n"] > 0)).select(*_row(F.lit(all_["least"]), zero, null, F.lit(all_["n"]), col("kids"), F.greatest(col("leaves"), one), col("saved"), col("ends")))
    return grouped.union(chained).union(lone).union(root)


def op12(spark, sf_dir: str) -> DataFrame:
    """The query: every node of the trie."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: An unsigned CRC-32 by bits: bytes are put in, and -1 is one step of the shift register (the polynomial is a fixed value).
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint],
   flatten(list_transform(string_split(cc::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda a, e: case when e >= 0 then xor(a, e) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))"""

OP12_SQL = rf"""
with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, k) as pos, k, w from (
   select conv_id, turn, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w from conversations where conv_id is not null)),
 c0 as (select c, count(*) as n, c - c % {FAMILY} as base from o group by c),
 h as (select c, n, base, crc as hh from c0 join (select c as cc, {_CRC} % {HEADS} as crc from c0) on c = cc),
 r as (select h.c, o.pos as d, o.k, o.w from h join o on o.c = h.base and o.pos <= h.hh
       union all select h.c, o.pos - h.hh + least(h.hh, coalesce(b.n, 0)), o.k, o.w from h join o on o.c = h.c and o.pos > h.hh left join c0 b on b.c = h.base),
 p as (select c, d, w, string_agg(k, '') over (partition by c order by d) as s from r),
 m as (select c, d, w, s from p union all select c, 0, 0, '' from c0),
 ln as (select c, max(d) as len from m group by c),
 n as (select s, d, min(m.c) as conv_id, count(*) as n_convs, max(w) as w,
        sha256(coalesce(string_agg(m.c::varchar, ',' order by m.c) filter (where len = d), '')) as ends_sha256 from m join ln on m.c = ln.c group by s, d),
 k as (select left(s, 32 * (d - 1)::int) as s, count(*) as n_children from n where d > 0 group by 1),
 a as (select n.*, coalesce(n_children, 0) as n_children from n left join k on n.s = k.s),
 u as (select left(s, 32 * j) as s, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * w) as saved_tokens
       from (select s, n_children, n_convs, w, unnest(range(0, d + 1))::int as j from a) group by 1)
select a.conv_id, a.d::bigint as depth, q.conv_id as parent_conv_id, a.n_convs, a.n_children, u.n_leaves, u.saved_tokens::bigint as saved_tokens, a.ends_sha256
from a join u on a.s = u.s left join n q on a.d > 0 and q.s = left(a.s, 32 * (a.d - 1)::int)
"""
