"""The trie of conversation prefixes, from the LCP array of the sorted conversations.

Every turn becomes a 16-byte symbol. Conversations are sorted by their symbols, and next to each stands the length of its
longest common prefix (LCP) with the one before. The Cartesian tree over these lengths, with equal lengths merged, is the
trie without its unary nodes: a node ends where the nearest smaller value stands on either side. Inside a block of the
sorted order a stack finds those values; between blocks the falling minima of each block and what it leaves open are
enough, and they are small: a common prefix of v turns needs v turns, so k falling steps need some k * k / 2 turns.
Depths between a node and its parent are put in last, with the turns of the node's first conversation.

No conversation is ever held whole: it goes in pieces of ``PIECE`` turns, and longer ones are ordered by naming pieces,
pairs of pieces, pairs of pairs and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, saved

#: Turns in a piece of a conversation.
PIECE = 64
#: Bytes of a turn's symbol: the first half of the SHA-256 of role and text.
SYMBOL = 16
#: Ids in one string on the way to a node's digest.
IDS = 1 << 16


def head_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first one of its five."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(conv_id, n, total)`` and their rebuilt turns ``(conv_id, pos, size, before, symbol)``.

    ``most``: the largest value of :func:`head_turns`. ``before``: the bytes of all earlier turns.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    symbol = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SYMBOL))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("size"), symbol.alias("symbol"))
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "symbol").withColumn("part", F.spark_partition_id())
    numbered = saved(ordered.select("conv_id", "part", "size", "symbol").mapInArrow(_number, "conv_id long, part int, size long, symbol binary, pos long, before long"), "trie-turns")
    # a conversation may go on in the next partition: a row for each partition at most
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("k"), F.sum("size").alias("b"))
    moved = pieces.select("conv_id", "part", F.sum("k").over(earlier).alias("k"), F.sum("b").over(earlier).alias("b")).where("k IS NOT NULL")
    own = numbered.join(F.broadcast(moved), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("k", F.lit(0))).alias("pos"), "size", (F.col("before") + F.coalesce("b", F.lit(0))).alias("before"), "symbol"
    )

    taken = head_turns(F.col("conv_id"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.coalesce(F.sum(F.when(F.col("pos") < taken, F.col("size"))), F.lit(0)).alias("left_out"))
    turn = F.struct("pos", "size", "before", "symbol")
    heads = own.where((F.col("conv_id") % 5 == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    given = F.slice(F.col("head"), F.lit(1), taken)
    convs = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "first", "left")
    convs = convs.withColumn("given", F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(given))
    convs = convs.withColumn("given_bytes", F.aggregate("given", F.lit(0).cast("long"), lambda a, t: a + t["size"])).select(
        "conv_id",
        "given",
        (F.size("given") + F.greatest(F.col("n") - taken, F.lit(0))).cast("long").alias("n"),
        (F.col("given_bytes") + F.col("b") - F.col("left_out")).alias("total"),
        (F.size("given") - taken).alias("shift"),
        (F.col("given_bytes") - F.col("left_out")).alias("byte_shift"),
    )
    convs = saved(convs, "trie-conversations")
    front = convs.select("conv_id", F.explode("given").alias("t")).select("conv_id", "t.pos", "t.size", "t.before", "t.symbol")
    rest = own.where(F.col("pos") >= taken).join(convs.select("conv_id", "shift", "byte_shift"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "size", (F.col("before") + F.col("byte_shift")).alias("before"), "symbol")
    return convs.select("conv_id", "n", "total"), front.unionByName(rest)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn, and the bytes before it, in what this partition has of its conversation."""
    held, at, before = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        new = np.ones(len(conv), dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = held is None or conv[0] != held
        row = np.arange(len(conv))
        start = np.maximum.accumulate(np.where(new, row, -1))
        ahead = np.cumsum(size) - size
        pos = np.where(start >= 0, row - start, row + at)
        so_far = np.where(start >= 0, ahead - ahead[start], ahead + before)
        held, at, before = conv[-1], int(pos[-1]) + 1, int(so_far[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64()), pa.array(so_far, pa.int64())], ["conv_id", "part", "size", "symbol", "pos", "before"])


def pieces_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, piece, key, befores)``: the symbols of at most PIECE turns in a row, and the bytes before each of them."""
    turn = F.struct("pos", "before", "symbol")
    grouped = turns.groupBy("conv_id", F.expr(f"pos div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    key = F.aggregate("turns", F.lit(b""), lambda a, t: F.concat(a, t["symbol"]))
    return grouped.select("conv_id", "piece", key.alias("key"), F.transform("turns", lambda t: t["before"]).alias("befores"))


def distinct_sequences(convs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(rep, n, total, members, ends_sha256)`` of each distinct sequence of turns; ``rep`` is its smallest conversation."""
    # hashes of (place, piece), joined by xor: no order and no overflow
    hashed = pieces.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("piece", "key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "key", "piece")).alias("y"))
    rows = convs.join(hashed, "conv_id", "left").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"), "n", "total", "conv_id")
    kinds = "x long, y long, n long, total long, first long, k long, ids string"
    chunks = rows.repartitionByRange("x", "y", "n", "conv_id").sortWithinPartitions("x", "y", "n", "conv_id").mapInArrow(_join_ids, kinds)
    whole = chunks.repartition("x", "y", "n").sortWithinPartitions("x", "y", "n", "first").mapInArrow(_digest, "rep long, n long, total long, members long, ends_sha256 string")
    return saved(whole, "trie-sequences")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of the ids of one sequence, with commas; rows are sorted by sequence and id."""
    for batch in batches:
        for begin in range(0, batch.num_rows, IDS):
            part = batch.slice(begin, IDS)
            x, y, n, total, conv = (c.to_numpy() for c in part.columns)
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (n[1:] != n[:-1])
            at = np.append(np.flatnonzero(new), len(x))
            ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
            at, k = at[:-1], np.diff(at)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (x, y, n, total, conv)), pa.array(k, pa.int64()), pa.array(ids, pa.string())], ["x", "y", "n", "total", "first", "k", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence; its ids go through SHA-256 string by string."""
    key, row, state = None, None, None
    for batch in batches:
        out = []
        for x, y, n, total, first, k, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (x, y, n) != key:
                if key is not None:
                    out.append((*row, state.hexdigest()))
                key, row, state = (x, y, n), [first, n, total, 0], hashlib.sha256()
            else:
                state.update(b",")
            row[3] += k
            state.update(ids.encode())
        yield _rows(out, _SEQUENCES)
    if key is not None:
        yield _rows([(*row, state.hexdigest())], _SEQUENCES)


_SEQUENCES = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("members", pa.int64()), ("ends_sha256", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _tails(pieces: DataFrame) -> DataFrame:
    """``(rep, tail)``: a number that orders conversations of more than PIECE turns by all that follows their first piece."""
    level = pieces.where("piece > 0").select(F.col("conv_id").alias("rep"), (F.col("piece") - 1).alias("at"), F.col("key").alias("a"), F.lit(0).cast("long").alias("b"))
    old = []
    while True:
        # names in the order of what they stand for; ids of a sorted table rise with it
        names = saved(level.select("a", "b").distinct().orderBy("a", "b").withColumn("name", F.monotonically_increasing_id() + 1), "trie-names")
        named = saved(level.join(names, ["a", "b"]).select("rep", "at", "name"), "trie-level")
        dropped(names, *old)
        old = [named]
        if not (named.agg(F.max("at")).first()[0] or 0):
            return named.select("rep", F.col("name").alias("tail"))
        left, right = F.when(F.col("at") % 2 == 0, F.col("name")), F.when(F.col("at") % 2 == 1, F.col("name"))
        level = named.groupBy("rep", F.expr("at div 2").alias("at")).agg(F.max(left).alias("a"), F.coalesce(F.max(right), F.lit(0)).alias("b"))


def _common(a: bytes, b: bytes) -> int:
    """Symbols that both keys begin with."""
    m = min(len(a), len(b))
    differ = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return (m - (differ.bit_length() + 7) // 8) // SYMBOL


_ORDERED = "block int, at long, rep long, n long, total long, members long, lcp long, before long, prev long, edge_key binary, edge_befores array<long>, edge_n long"


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The LCP of each sorted sequence with the one before; unknown in a partition's first row and where a whole piece agrees.

    The first row, and an extra last row without a ``rep``, carry their keys for the neighbouring partitions.
    """
    schema = pa.schema([("block", pa.int32()), *((x, pa.int64()) for x in ("at", "rep", "n", "total", "members", "lcp", "before", "prev")), ("edge_key", pa.binary()), ("edge_befores", pa.list_(pa.int64())), ("edge_n", pa.int64())])
    at, last = 0, None
    for batch in batches:
        out = []
        for block, rep, n, total, members, key, befores in zip(*(c.to_pylist() for c in batch.columns)):
            key, befores = key or b"", befores or []
            lcp = before = prev = None
            if last is not None:
                prev, k = last[1], _common(last[2], key)
                if k < PIECE:
                    lcp, before = k, befores[k] if k < len(befores) else total
            first = last is None
            out.append((block, at, rep, n, total, members, lcp, before, prev, key if first else None, befores if first else None, n if first else None))
            last, at = (block, rep, key, n), at + 1
        yield _rows(out, schema)
    if last is not None:
        block, rep, key, n = last
        yield _rows([(block, at, None, None, None, None, None, None, rep, key, None, n)], schema)


def _deep(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(rep, lcp, before)`` for sequences that share the whole first piece with the one before (``rep, prev, total``)."""
    late = pieces.where("piece > 0")
    mine = pairs.join(late.withColumnRenamed("conv_id", "rep"), "rep").select("rep", "total", "prev", "piece", "key", "befores")
    theirs = pairs.select("rep", F.col("prev").alias("conv_id")).join(late, "conv_id").select("rep", "piece", F.col("key").alias("other"))
    differ = mine.join(theirs, ["rep", "piece"], "left").where(~F.col("key").eqNullSafe(F.col("other")))
    # of two different sequences the later isn't a prefix of the earlier, so a piece of the later one always differs
    first = differ.groupBy("rep").agg(F.min_by(F.struct("piece", "key", "other", "befores", "total"), "piece").alias("d")).select("rep", "d.*")
    kinds = pa.schema([("rep", pa.int64()), ("lcp", pa.int64()), ("before", pa.int64())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, piece, key, other, befores, total in zip(*(c.to_pylist() for c in batch.columns)):
                k = _common(key, other or b"")
                out.append((rep, piece * PIECE + k, befores[k] if k < len(befores) else total))
            yield _rows(out, kinds)

    return first.mapInArrow(measured, "rep long, lcp long, before long")


# A node on the stack: how deep it is; its first sequence, and the bytes that this one shares with the sequence before it;
# children; members, smallest member, leaves; bytes of all members' turns; bytes of the turns that are new in their sequence.
DEPTH, REP, BEFORE, CHILDREN, MEMBERS, LEAST, LEAVES, ALL, NEW = range(9)
_NODE = pa.schema([("block", pa.int32()), ("at", pa.int64()), *((x, pa.int64()) for x in ("depth", "rep", "before", "children", "members", "least", "leaves", "all_bytes", "new_bytes")), ("parent_rep", pa.int64()), ("parent_depth", pa.int64())])
_NODE_DDL = "block int, at long, depth long, rep long, before long, children long, members long, least long, leaves long, all_bytes long, new_bytes long, parent_rep long, parent_depth long"
_NOBODY = (1 << 63) - 1


def _node(depth: int, rep: int | None, before: int | None, children: int = 0) -> list:
    return [depth, rep, before, children, 0, _NOBODY, 0, 0, 0]


def _add(node: list, other: list) -> None:
    node[MEMBERS] += other[MEMBERS]
    node[LEAST] = min(node[LEAST], other[LEAST])
    node[LEAVES] += other[LEAVES]
    node[ALL] += other[ALL]
    node[NEW] += other[NEW]


def close(stack: list[list], lcp: int, done: Callable[[list, list | None], None] | None = None) -> None:
    """Ends all nodes deeper than ``lcp``: their nearest smaller value to the right is here, the one to the left below them."""
    while stack and stack[-1][DEPTH] > lcp:
        node = stack.pop()
        if not node[CHILDREN]:
            node[LEAVES] = 1
        if lcp >= 0 and (not stack or stack[-1][DEPTH] < lcp):
            stack.append(_node(lcp, node[REP], node[BEFORE], children=1))
        if done:
            done(node, stack[-1] if stack else None)
        if stack:
            _add(stack[-1], node)


def arrive(stack: list[list], rep: int, n: int, total: int, members: int, lcp: int, before: int, done=None) -> None:
    """The next sequence of the sorted order."""
    close(stack, lcp, done)
    if n > lcp:
        stack[-1][CHILDREN] += 1
        stack.append(_node(n, rep, before))
    _add(stack[-1], [0, 0, 0, 0, members, rep, 0, members * total, total - before])


def summary(sequences: Iterator[tuple]) -> list[list]:
    """What a block does to any stack: its falling minima (nodes without ``rep``), then the nodes that it leaves open."""
    minima: list[list] = []
    stack: list[list] = []
    for sequence in sequences:
        lcp = sequence[4]
        if not stack:
            stack = [_node(lcp, None, None)]
        elif lcp < stack[0][DEPTH]:
            close(stack, stack[0][DEPTH])
            minima.append(stack[0])
            stack = [_node(lcp, None, None)]
        arrive(stack, *sequence)
    return minima + stack


def apply(stack: list[list], block: list[list]) -> None:
    """Brings a stack from before a block to after it, by the block's summary."""
    for node in block:
        if node[REP] is None:
            close(stack, node[DEPTH])
            stack[-1][CHILDREN] += node[CHILDREN]
            _add(stack[-1], node)
        else:
            stack.append(list(node))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The rows of each block, one block after another; rows are sorted by block."""
    import itertools

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for block, own in itertools.groupby(rows(), key=lambda r: r[0]):
        yield block, own


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in _blocks(batches):
        found = summary(r[2:8] for r in rows)
        yield _rows([(block, k, *node, None, None) for k, node in enumerate(found)], _NODE)


def _sweep(last: int):
    """Nodes that end in each block. A block's first rows, with negative places, are the stack that it begins with."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            stack: list[list] = []
            out: list[tuple] = []

            def done(node: list, below: list | None) -> None:
                out.append((block, 0, *node, below and below[REP], below and below[DEPTH]))

            for row in rows:
                if row[1] < 0:
                    stack.append(list(row[8:]))
                else:
                    arrive(stack, *row[2:8], done)
                if len(out) > 10_000:
                    yield _rows(out, _NODE)
                    out.clear()
            if block == last:
                close(stack, -1, done)
            yield _rows(out, _NODE)

    return sweep


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, a row for each node.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. ``conv_id``: smallest member; ``depth``;
    ``parent_conv_id``; ``n_convs``: members; ``n_children``; ``n_leaves``; ``saved_tokens``: over the subtree, each node's
    members but one times the bytes of its last text; ``ends_sha256``: SHA-256 of the ids of the members that end here.

    Turns go by ``turn``, nulls first; equal turns by the SHA-256 of role and text, so repeated rows are turns of their own.
    Null or empty roles and texts are one and the same. Rows without a conv_id belong to no conversation and are left out.
    An empty table has no nodes, not even a root. Of a very long text only its hash and size are carried; a conversation
    of very many turns, or one sequence that very many conversations have, is dealt over tasks.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    pieces = saved(pieces_of(turns), "trie-pieces")
    sequences = distinct_sequences(convs, pieces)
    kept = pieces.join(sequences.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    rows = sequences.join(kept.where("piece = 0").select(F.col("conv_id").alias("rep"), "key", "befores"), "rep", "left")
    tail = _tails(kept) if not kept.where("piece > 0").isEmpty() else None
    rows = rows.withColumn("tail", F.lit(0).cast("long")) if tail is None else rows.join(tail, "rep", "left")
    rows = rows.orderBy(F.coalesce("key", F.lit(b"")), F.coalesce("tail", F.lit(0))).withColumn("block", F.spark_partition_id())
    ordered = saved(rows.select("block", "rep", "n", "total", "members", "key", "befores").mapInArrow(_adjacent, _ORDERED), "trie-ordered")

    # the first row of each block against the last of the block before: two rows for each block
    edges = ordered.where("edge_key IS NOT NULL").orderBy("block", "at").collect()
    if not edges:
        return ordered.where("false").select(*(F.lit(0).cast("long").alias(x) for x in _RESULT[:-1]), F.lit("").alias("ends_sha256"))
    first, fixes, deep = edges[0].rep, [(edges[0].rep, 0, 0)], []
    for before, after in zip(edges[1::2], edges[2::2]):
        k = _common(bytes(before.edge_key), bytes(after.edge_key))
        if k < PIECE:
            fixes.append((after.rep, k, after.edge_befores[k] if k < len(after.edge_befores) else after.total))
        else:
            deep.append((after.rep, before.prev, after.total))
    known = spark.createDataFrame(fixes, "rep long, fix long, fix_before long")
    if tail is not None:
        pairs = ordered.where("rep IS NOT NULL AND lcp IS NULL AND prev IS NOT NULL").select("rep", "prev", "total")
        pairs = pairs.unionByName(spark.createDataFrame(deep, "rep long, prev long, total long"))
        known = known.unionByName(_deep(pairs, kept).toDF("rep", "fix", "fix_before"))
    stacks = "block int, at long, rep long, n long, total long, members long, lcp long, before long"
    swept = ordered.where("rep IS NOT NULL").join(known, "rep", "left").select("block", "at", "rep", "n", "total", "members", F.coalesce("lcp", "fix").alias("lcp"), F.coalesce("before", "fix_before").alias("before"))
    swept = saved(swept, "trie-lcp")

    found = swept.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_summaries, _NODE_DDL)
    of_block: dict[int, list[list]] = {}
    for r in sorted(found.collect(), key=lambda r: r[:2]):
        of_block.setdefault(r.block, []).append(list(r[2:11]))
    stack, starts = [_node(0, first, 0)], []
    for block in sorted(of_block):
        starts += [(block, k - len(stack), *[None] * 6, *node) for k, node in enumerate(stack)]
        apply(stack, of_block[block])
    columns = ", ".join(f"{x} long" for x in ("depth", "s_rep", "s_before", "children", "s_members", "least", "leaves", "all_bytes", "new_bytes"))
    starts = spark.createDataFrame(starts, f"{stacks}, {columns}")
    both = swept.select("*", *(F.lit(None).cast("long").alias(x) for x in starts.columns[8:])).unionByName(starts)
    nodes = saved(both.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_sweep(max(of_block)), _NODE_DDL).drop("block", "at"), "trie-nodes")

    parents = nodes.select(F.col("rep").alias("parent_rep"), F.col("depth").alias("parent_depth"), F.col("least").alias("parent_least"))
    compact = nodes.join(parents, ["parent_rep", "parent_depth"], "left").join(sequences.select("rep", "n", "ends_sha256"), "rep")
    deeper = compact.withColumn("top", F.coalesce(F.col("parent_depth") + 1, F.lit(0))).withColumn("d", F.explode(F.sequence("top", "depth")))
    turn_of = kept.select(F.col("conv_id").alias("rep"), "piece", F.posexplode("befores").alias("i", "ahead")).select("rep", (F.col("piece") * PIECE + F.col("i") + 1).alias("d"), "ahead")
    # each of a first conversation's turns below what it shares with the one before is a node of its own
    result = deeper.join(turn_of, ["rep", "d"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    last_depth = F.col("d") == F.col("depth")
    return result.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("top"), F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last_depth, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("all_bytes") - F.col("members") * F.col("ahead") - (F.col("new_bytes") + F.col("before") - F.col("ahead"))).alias("saved_tokens"),
        F.when(last_depth & (F.col("n") == F.col("depth")), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
