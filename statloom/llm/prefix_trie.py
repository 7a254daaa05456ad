"""The prefix trie of conversations, for sharing what has been computed for common beginnings.

Turns are encoded by a dictionary of their distinct contents. The conversations, as sequences of ids, are parted from
the first turn on (radix partitioning, most significant digit first): each round splits every large bucket by its next
id. A bucket with little work left goes to one task, where multikey quicksort parts it further and each of its equal
parts is a node; a bucket of one conversation is a chain, which needs no sorting. Sums over subtrees then go up from
the deepest round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.base import dealt, join_hot, stash

#: A bucket with at most so many turns left is sorted in one task.
LOCAL_TURNS = 512
#: Turns of a conversation that lie in one row.
CHUNK = 64
#: Length of the steps in which long chains and sequences of ends are written.
STEP = 4096
LENDER, MOST_LENT = 5, 9
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = [c.split()[0] for c in NODE.split(", ")]
_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos from 0, turn_id and the UTF-8 bytes of the text, of every turn with a conv_id.

    Turns are ordered by turn, null first; equal ones by role and text. The order is found by ranges of the whole table,
    so a conversation of any length is spread over tasks.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed, _ = stash(ordered.select("conv", F.monotonically_increasing_id().alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    told = placed.groupBy("digest").agg(F.count("*").alias("n"))
    words, _ = stash(told.select("digest", "n", F.monotonically_increasing_id().alias("turn_id")), "dictionary")
    encoded = join_hot(placed, words, "digest", "n", placed.count())
    part = F.shiftright(F.col("place"), 33)
    runs = placed.groupBy("conv", part.alias("part")).agg(F.min("place").alias("low"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the table
    starts = runs.select("conv", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    found = encoded.withColumn("part", part).join(starts, ["conv", "part"])
    return found.select("conv", (F.col("place") + F.col("shift")).alias("pos"), "turn_id", "bytes")


def _lent(conv):
    return F.crc32(conv.cast("string").cast("binary")) % MOST_LENT


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their places in the rebuilt conversations, and (conv, total) of every conversation.

    Conversation c begins with the first h turns of c - c % 5 (all, if it has fewer) and goes on with its own after its
    first h; h is crc32 of c in decimal, modulo 9.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    base = F.col("conv") - F.col("conv") % LENDER
    known = sizes.withColumn("base", base).withColumn("h", _lent(F.col("conv")))
    lenders = sizes.where(F.col("conv") % LENDER == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    known = known.join(lenders, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_own", F.lit(0))))
    total = F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    known, _ = stash(known.select("conv", "own", "h", "lent", total.alias("total")), "conversations")
    others = F.explode(F.array(*[F.lit(k) for k in range(1 - LENDER, LENDER)]))
    first = turns.where((F.col("conv") % LENDER == 0) & (F.col("pos") < MOST_LENT)).withColumn("other", others).withColumn("to", F.col("conv") + F.col("other"))
    first = first.where((F.col("to") - F.col("to") % LENDER == F.col("conv")) & (F.col("pos") < _lent(F.col("to"))))
    lent = first.select(F.col("to").alias("conv"), "pos", "turn_id", "bytes").join(known.select("conv"), "conv", "left_semi")
    own = join_hot(turns, known.select("conv", "h", "lent", "own"), "conv", "own", turns.count()).where("pos >= h")
    return lent.unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_id", "bytes")), known.select("conv", "total")


def _chunks(turns: DataFrame) -> DataFrame:
    """(conv, chunk) with the ids and byte counts of up to CHUNK turns in order."""
    rows = turns.groupBy("conv", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("t"))
    return rows.select("conv", "chunk", F.col("t.turn_id").alias("ids"), F.col("t.bytes").alias("sizes"))


def quicksorted(members: list[tuple[int, list[int], list[int]]], depth: int, parent: int) -> list[list]:
    """The nodes of a bucket, its top first, as rows of NODE. members: conv, and ids and bytes from the top's turn on.

    The members agree in their first id. Multikey quicksort: a part is split by its next id into smaller, equal and
    larger; the equal ones are a node. A stack stands in for recursion, as conversations may be long.
    """
    nodes, above, todo = [], [], [(members, 0, -1)]

    def node(part: list, d: int, at: int) -> None:
        """Members that agree up to place d."""
        ended = sorted(m[0] for m in part if len(m[1]) == d + 1)
        ends = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else _NOTHING
        nodes.append([min(m[0] for m in part), depth + d, parent if at < 0 else nodes[at][0], len(part), 0, 0, (len(part) - 1) * part[0][2][d], ends])
        above.append(at)
        if at >= 0:
            nodes[at][4] += 1
        longer = [m for m in part if len(m[1]) > d + 1]
        if longer:
            todo.append((longer, d + 1, len(nodes) - 1))

    while todo:
        part, d, at = todo.pop()
        low, mid, high = sorted((part[0][1][d], part[len(part) // 2][1][d], part[-1][1][d]))
        smaller, equal, larger = [], [], []
        for m in part:
            (equal if m[1][d] == mid else smaller if m[1][d] < mid else larger).append(m)
        todo += [(rest, d, at) for rest in (smaller, larger) if rest]
        node(equal, d, at)
    for k in range(len(nodes) - 1, -1, -1):  # a node comes after its parent
        nodes[k][5] = nodes[k][5] or 1
        if above[k] >= 0:
            nodes[above[k]][5] += nodes[k][5]
            nodes[above[k]][6] += nodes[k][6]
    return nodes


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, depth, parent, conv, chunk, ids, sizes), sorted by bucket, conv and chunk; one bucket is held at a time."""
    out: list[list] = []
    held: tuple | None = None
    members: list[tuple[int, list[int], list[int]]] = []

    def written() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.bool_() if n == "top" else pa.int64()) for c, n in zip(columns, [*_NODE, "top"], strict=True)], [*_NODE, "top"])

    def close() -> None:
        out.extend([*row, k == 0] for k, row in enumerate(quicksorted(members, held[1], held[2])))

    for batch in batches:
        for bucket, depth, parent, conv, _, ids, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held[0] != bucket:
                if held is not None:
                    close()
                held, members = (bucket, depth, parent), []
            if members and members[-1][0] == conv:
                members[-1][1].extend(ids)
                members[-1][2].extend(sizes)
            else:
                members.append((conv, ids, sizes))
        if len(out) > 10_000:
            yield written()
            out = []
    if held is not None:
        close()
    if out:
        yield written()


def _end_digests(ends: DataFrame) -> DataFrame:
    """node, depth and ends_sha256, from (node, depth, conv).

    Ranges of the table write the ids of a node as strings, in order; one task then feeds a node's strings to SHA-256 one
    after another, as that digest can only be taken in order, and holds one of them at a time.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            cuts = [k for k in range(len(rows)) if not k or rows[k][:2] != rows[k - 1][:2]] + [len(rows)]
            told = [(*rows[a][:3], ",".join(str(r[2]) for r in rows[a:b])) for low, high in zip(cuts[:-1], cuts[1:], strict=True) for a in range(low, high, STEP) for b in [min(high, a + STEP)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), (pa.int64(),) * 3 + (pa.string(),), strict=True)], ["node", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, out = None, None, []
        for batch in batches:
            for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (node, depth):
                    if held:
                        out.append((*held, sha.hexdigest()))
                    held, sha = (node, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if held:
            out.append((*held, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "depth", "ends_sha256"])

    order = ["node", "depth", "conv"]
    told = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(strings, "node long, depth long, first long, ids string")
    return told.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digests, "node long, depth long, ends_sha256 string")


def _sums(parts: list[DataFrame]) -> DataFrame:
    """Leaves and savings by parent, over (parent, leaves, saved)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("parent").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of NODE, from (conv, pos, turn_id, bytes) and (conv, total) of each conversation, those without turns too."""
    spark: SparkSession = turns.sparkSession
    chunks, _ = stash(_chunks(turns), "chunks")
    top = conversations.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], NODE)
    # the state of a round: conversations in large buckets, node: the bucket's smallest conversation, left: turns to come
    state = conversations.join(chunks.where("chunk = 0").drop("chunk"), "conv", "left").select("conv", F.lit(top["conv"]).alias("node"), "ids", "sizes", F.col("total").alias("left"))
    large = [spark.createDataFrame([(top["conv"], None, top["n"], 0)], "conv long, parent long, n long, bytes long")]
    kids, singles, locals_, ends = [], [], [], []
    depth, total = 0, top["n"]
    while True:
        place = depth % CHUNK
        ends.append(state.where("left = 0").select("node", F.lit(depth).cast("long").alias("depth"), "conv"))
        going = state.where("left > 0").withColumn("turn_id", F.col("ids")[place])
        split = going.groupBy("node", "turn_id").agg(F.count("*").alias("n"), F.min("conv").alias("child"), F.sum("left").alias("work"), F.first(F.col("sizes")[place]).alias("bytes"))
        kind = F.when(F.col("n") == 1, "single").when(F.col("work") <= LOCAL_TURNS, "local").otherwise("large")
        split, _ = stash(split.withColumn("kind", kind), "split")
        kids.append(split)
        told = split.select("node", "turn_id", "n", "child", "kind")
        parted, _ = stash(join_hot(going, told, ["node", "turn_id"], "n", total).drop("turn_id"), "parted")
        depth += 1
        singles.append(parted.where("kind = 'single'").select("conv", F.col("node").alias("parent"), F.lit(depth).cast("long").alias("depth"), "left"))
        # a bucket's turns from its top on: what is left of this row, and the rows behind it
        local = parted.where("kind = 'local'").select(F.col("child").alias("bucket"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "conv", "ids", "sizes", "left")
        chunk = (depth - 1) // CHUNK
        rest = [F.slice(c, place + 1, CHUNK).alias(c) for c in ("ids", "sizes")]
        locals_.append(local.select("bucket", "depth", "parent", "conv", F.lit(chunk).cast("long").alias("chunk"), *rest))
        behind = local.where(F.col("left") > CHUNK - place).select("bucket", "depth", "parent", "conv").join(chunks.where(F.col("chunk") > chunk), "conv")
        locals_.append(behind.select("bucket", "depth", "parent", "conv", "chunk", "ids", "sizes"))
        found = split.where("kind = 'large'").select(F.col("child").alias("conv"), F.col("node").alias("parent"), "n", "bytes")
        if found.isEmpty():
            break
        large.append(found)
        state = parted.where("kind = 'large'").select("conv", F.col("child").alias("node"), "ids", "sizes", (F.col("left") - 1).alias("left"))
        if depth % CHUNK == 0:
            state = state.drop("ids", "sizes").join(chunks.where(F.col("chunk") == depth // CHUNK).drop("chunk"), "conv", "left").select("conv", "node", "ids", "sizes", "left")
        state, _ = stash(state, "state") if depth % CHUNK == 0 else (state, "")
        total = parted.count()

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    by_bucket = union(locals_).repartition("bucket").sortWithinPartitions("bucket", "conv", "chunk")
    sorted_nodes, _ = stash(by_bucket.mapInArrow(_sort_buckets, f"{NODE}, top boolean"), "sorted")

    chains = dealt(union(singles), "conv").withColumn("last", F.col("depth") + F.col("left") - 1)
    steps = chains.withColumn("from", F.explode(F.sequence(F.col("depth"), F.col("last"), F.lit(STEP).cast("long"))))
    links = steps.withColumn("at", F.explode(F.sequence(F.col("from"), F.least("last", F.col("from") + STEP - 1))))
    one, ended = F.lit(1).cast("long"), F.col("at") == F.col("last")
    chain_nodes = links.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ended, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    )

    digests, _ = stash(_end_digests(union(ends)), "ends")
    done: list[DataFrame] = []
    below: DataFrame | None = None
    for d in range(len(large) - 1, -1, -1):
        parts = [kids[d].where("kind = 'single'").select(F.col("node").alias("parent"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))]
        parts.append(sorted_nodes.where(F.col("top") & (F.col("depth") == d + 1)).select(F.col("parent_conv_id").alias("parent"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        if below is not None:
            parts.append(below.select(F.col("parent_conv_id").alias("parent"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        children = kids[d].groupBy("node").agg(F.count("*").alias("n_children"))
        rows = large[d].join(_sums(parts).withColumnRenamed("parent", "node"), F.col("conv") == F.col("node"), "left").drop("node").join(children, F.col("conv") == F.col("node"), "left").drop("node")
        told = digests.where(F.col("depth") == d).select("node", "ends_sha256")
        rows = rows.join(told, F.col("conv") == F.col("node"), "left")
        zero = F.lit(0).cast("long")
        below, _ = stash(rows.select(
            F.col("conv").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce("leaves", one).alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
        ), "large")
        done.append(below)
    return union([*done, sorted_nodes.drop("top"), chain_nodes])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the textless root at depth 0 among them.

    Columns as in NODE: conv_id is the node's smallest member, which names it together with depth. A null role or text
    is empty; rows without a conv_id take no part; turns that share a number are ordered by role and text, null numbers
    first; repeated rows are turns of their own. Equal conversations share all nodes. A table without conversations
    gives no rows. Further columns are ignored, whatever their names.
    """
    turns, _ = stash(numbered_turns(conversations), "numbered")
    rebuilt, known = rebuilt_turns(turns)
    return build(rebuilt, known)
