"""Near-duplicate documents: a Hamming join of b-bit MinHash signatures over several indexes, then exact links.

A document's set is its distinct word shingles. Documents with equal sets are one class, and each class gets a signature
of ``CHUNKS * CHUNK`` symbols of ``BITS`` bits. By the pigeonhole principle two signatures that differ in fewer than
``CHUNKS * (ERRORS + 1)`` symbols have a chunk with at most ``ERRORS`` differences; listing, for each chunk, all ways to
leave out ``ERRORS`` symbols gives keys of which such a pair shares one for certain. Pairs with a similarity of 0.8 mostly
lie under that bound, and those above it still share a key in most cases: all in all they miss each other with a
probability of 6e-6.

Sharing a key makes a candidate; links are confirmed on the full sets. Only components are asked for, so a bucket never
gives all its pairs: in some rounds a node that isn't yet in the component of its buckets' leads is held against the lead
that it meets most often, and whatever pairs are left across components come last, all of them.

Very long texts: a text is one row of hashes, so a task needs some 60 bytes for each of its words. Ties: leads and
components are chosen by hashes and smallest ids, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, merged, saved
from .words import U64, distinct_by_row, hashed_words, mix, shingles, text_chunks

CHUNKS, CHUNK, ERRORS, BITS = 14, 7, 1, 16
SYMBOLS = CHUNKS * CHUNK
#: Nodes that share a key are compared by odd sketches before their full sets are: bit i says whether an odd number of the
#: set's values fall on i. Two sketches differ in no more bits than the sets have values that only one of them has, so no
#: pair that is similar enough can be lost there.
ODD_BITS = 4096
ODD_BYTES = ODD_BITS // 8
STAR_ROUNDS = 3
#: Buckets that a sample of the nodes shows to be larger than this, or than a share of all nodes, are dealt over salts.
HOT_BUCKET, HOT_SHARE, SAMPLE, SALTS = 10_000, 1e-4, 64, 32
#: Rows of a class or component are dealt over so many salts where they meet its label, as one may hold a third of all rows.
LABEL_SALTS = 16
_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, SYMBOLS, dtype=U64) | U64(1)
_SUBSETS = [(c * CHUNK + np.array(left), k) for k, (c, left) in enumerate((c, left) for c in range(CHUNKS) for left in combinations(range(CHUNK), CHUNK - ERRORS))]
#: The symbol that each key leaves out, and the lower bits of a key, which tell its number.
_LEFT_OUT = np.array([(set(range(k // CHUNK * CHUNK, k // CHUNK * CHUNK + CHUNK)) - set(columns)).pop() for columns, k in _SUBSETS])
_NUMBER = U64(127)
_KEY_FACTORS = np.random.Generator(np.random.PCG64(78)).integers(0, 2**64, (len(_SUBSETS), CHUNK - ERRORS), dtype=U64) | U64(1)


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of symbols for each run of hashes; runs must not be empty."""
    out = np.empty((len(ends) - 1, SYMBOLS), dtype=np.uint16)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = mix(np.minimum.reduceat(hashes * factor, ends[:-1])) & U64((1 << BITS) - 1)
    return out


def odd_sketches(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of ``ODD_BITS`` bits for each run of distinct values."""
    rows = np.repeat(np.arange(len(ends) - 1, dtype=U64), np.diff(ends))
    at, hits = np.unique(rows * U64(ODD_BITS) + values % U64(ODD_BITS), return_counts=True)
    odd = at[hits % 2 == 1].astype(np.int64)
    out = np.zeros((len(ends) - 1) * ODD_BYTES, dtype=np.uint8)
    np.bitwise_or.at(out, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
    return out.reshape(-1, ODD_BYTES)


def differences(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many bits rows of sketches differ."""
    return np.bitwise_count(np.ascontiguousarray(one ^ two).view(U64)).sum(axis=1, dtype=np.int64)


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: for each chunk and each symbol left out, a hash of the others and the key's number."""
    wide = signature.astype(U64)
    out = np.empty((len(wide), len(_SUBSETS)), dtype=U64)
    for (columns, k), factors in zip(_SUBSETS, _KEY_FACTORS):
        out[:, k] = mix((wide[:, columns] * factors).sum(axis=1, dtype=U64) + U64(k)) & ~_NUMBER | U64(k)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, width * len(rows) + 1, width, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def _sketch(size: int):
    """Rows ``(doc_id, text_hash, text)`` to ``(doc_id, text_hash, n_shingles, node, signature)``; node: a hash of the set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(2)):
                found, ends = shingles(hashed_words(chunk), size)
                values, bounds = distinct_by_row(found, ends)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                node, signature = np.zeros(len(n), dtype=U64), np.zeros((len(n), SYMBOLS), dtype=np.uint16)
                if len(full):
                    node[full] = mix(np.add.reduceat(mix(values + U64(1)), bounds[full]) + n[full].astype(U64))
                    signature[full] = signatures(found, np.append(ends[full], ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[chunk.first : chunk.last], batch.column(1)[chunk.first : chunk.last], pa.array(n, pa.int64()), pa.array(node.view(np.int64)), _binary(signature)],
                    ["doc_id", "text_hash", "n_shingles", "node", "signature"],
                )

    return sketch


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
        keys = keys_of(signature).view(np.int64)
        offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["node", "keys"])


def _sets(size: int):
    """Rows ``(node, text)`` to ``(node, members, odd)``: the set's values in ascending order and its odd sketch."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                values, bounds = distinct_by_row(*shingles(hashed_words(chunk), size))
                members = [values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[chunk.first : chunk.last], pa.array(members, pa.binary()), _binary(odd_sketches(values, bounds))], ["node", "members", "odd"])

    return sets


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, ODD_BYTES)


def first_shared(signature: np.ndarray, x: np.ndarray, y: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether the key with this number, which rows x and y share, is the first that they share.

    Two chunks that differ in no symbol share all their keys, two that differ in one share the key that leaves it out.
    """
    first = (number % CHUNK == 0) | (signature[x, _LEFT_OUT[number]] != signature[y, _LEFT_OUT[number]])
    chunks = signature.reshape(-1, CHUNKS, CHUNK)
    for c in range(CHUNKS - 1):
        asked = np.flatnonzero(first & (number >= (c + 1) * CHUNK))
        if not len(asked):
            break
        first[asked] = (chunks[x[asked], c] != chunks[y[asked], c]).sum(axis=1, dtype=np.uint8) > ERRORS
    return first


def _across(percent: int):
    """Rows ``(cell, key, side, node, label, n, odd, signature)`` in the order of cells to the near pairs of two labels.

    Near pairs are those whose sets can be as similar as asked for by their sizes ``n`` and by the bits in which their
    sketches differ. A pair that shares several keys is compared once, where its first common key is. Rows of one side (but
    -1) meet elsewhere.
    """

    def compared(cell: np.ndarray, key: np.ndarray, side: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, odd: np.ndarray, signature: np.ndarray) -> pa.RecordBatch:
        number = (key.view(U64) & _NUMBER).astype(np.int64)
        found = [np.zeros((0, 4), dtype=np.int64)]
        step, at = 1, np.arange(len(cell))
        while len(at := at[at + step < len(cell)]) and len(at := at[cell[at] == cell[at + step]]):
            other = at + step
            fit = (label[at] != label[other]) & ((side[at] < 0) | (side[at] != side[other])) & (100 * np.minimum(n[at], n[other]) >= percent * np.maximum(n[at], n[other]))
            x = at[fit]
            x = x[first_shared(signature, x, x + step, number[x])]
            for block in np.array_split(x, len(x) // 16384 + 1):
                apart = differences(odd[block], odd[block + step])
                near = block[(100 + percent) * apart <= (100 - percent) * (n[block] + n[block + step])]
                swap = node[near] > node[near + step]
                one, two = np.where(swap, near + step, near), np.where(swap, near, near + step)
                found.append(np.column_stack((node[one], node[two], label[one], label[two])))
            step += 1
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], ["a", "b", "la", "lb"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            rows = (*(batch.column(k).to_numpy() for k in range(6)), _matrix(batch.column(6)), signature)
            rows = rows if rest is None else tuple(np.concatenate(x) for x in zip(rest, rows))
            done = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last cell may go on
            yield compared(*(x[:done] for x in rows))
            rest = tuple(x[done:] for x in rows)
        if rest is not None:
            yield compared(*rest)

    return across


def _similar(percent: int):
    """Rows ``(la, lb, members, members)`` to the labels of the pairs whose sets are as similar as asked for."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(one.as_buffer(), dtype=U64), np.frombuffer(two.as_buffer(), dtype=U64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.sort(np.concatenate((x, y)))
                    common = int((both[1:] == both[:-1]).sum())
                    keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return similar


def _with_label(rows: DataFrame, of_label: DataFrame, by: str) -> DataFrame:
    """``rows`` with the columns of ``of_label`` where their label has a row there; both are dealt over salts of ``by``.

    ``of_label`` grows with the corpus, and its copies are not in Spark's guess of its size, so they are joined by sorting.
    """
    salted = of_label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    return merged(rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(LABEL_SALTS)).cast("int")), salted, ["label", "_salt"], "left").drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of the edges ``(a, b)``; label: the smallest node that it is connected with.

    Labels pass over edges and then to the label's own label, until none changes. Each round is written to shared storage.
    """
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    tables = [labels := saved(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")), "labels")]
    while True:
        heard = _with_label(both.withColumnRenamed("b", "label"), labels.select(F.col("node").alias("label"), F.col("label").alias("heard")), "a").groupBy("a").agg(F.min("heard").alias("heard"))
        told = merged(labels, heard.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("before"), F.least("label", "heard").alias("label"))
        of_label = labels.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = saved(_with_label(told, of_label, "node").select("node", "before", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        tables.append(after)
        if after.where("label <> before").isEmpty():
            dropped(both, *tables[:-1])
            return labels


def leads(rows: DataFrame, turn: int) -> DataFrame:
    """``(a, b, la, lb)``: for each node b the node a that leads most of its buckets, where that has another label.

    ``rows`` has ``key, salt, node, label``. A salted bucket has a lead for each salt, and those have a lead of their own.
    """
    order = F.xxhash64("node", F.lit(turn))
    led = rows.withColumn("lead", F.min(F.struct(order.alias("order"), "node", "label")).over(Window.partitionBy("key", "salt")))
    heads = led.where("salt >= 0 AND node = lead.node").withColumn("lead", F.min("lead").over(Window.partitionBy("key")))
    pairs = led.unionByName(heads).where("label <> lead.label").groupBy("node", "label", F.col("lead.node").alias("a"), F.col("lead.label").alias("la")).count()
    best = pairs.groupBy(F.col("node").alias("b"), F.col("label").alias("lb")).agg(F.max_by(F.struct("a", "la"), F.struct("count", "a")).alias("best"))
    return best.select("best.a", "b", "best.la", "lb")


def _pairs_across(labelled: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """All pairs ``(a, b, la, lb)`` with a common key, two labels and near signatures, compared inside tasks, key by key.

    A salted bucket is compared in cells of two salts each.
    """
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rows = merged(merged(labelled, mixed, "key", "left_semi"), signatures, "node")
    cells = F.when(F.col("salt") >= 0, F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda t: F.least("salt", t) * SALTS + F.greatest("salt", t))).otherwise(F.array(F.lit(-1)))
    cell = F.when(F.col("of") < 0, F.col("key")).otherwise(F.xxhash64("key", "of"))
    side = F.when(F.floor(F.col("of") / SALTS) != F.col("of") % SALTS, F.col("salt")).otherwise(-1)
    rows = rows.withColumn("of", F.explode(cells)).select(cell.alias("cell"), "key", side.alias("side"), "node", "label", "n", "odd", "signature")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_across(percent), "a long, b long, la long, lb long").distinct()


def _shared_keys(classes: DataFrame, hot_bucket: int) -> DataFrame:
    """``(node, keys)``: the keys that a node shares with others, each with a salt (-1: the bucket isn't hot)."""

    def keyed(nodes: DataFrame) -> DataFrame:
        return nodes.select("node", "signature").mapInArrow(_keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))

    # at most KEYS / HOT_SHARE keys are hot, as a node is in KEYS buckets: the broadcast is bounded
    limit = max(hot_bucket, HOT_SHARE * classes.count())
    sampled = keyed(classes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0))
    hot = sampled.groupBy("key").count().where(F.col("count") * SAMPLE > limit).select("key", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(-1).cast("int")
    rows = keyed(classes).join(F.broadcast(hot), "key", "left").select("key", "node", salt.alias("salt"))
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "salt"))).where("n > 1 OR salt >= 0")
    return saved(shared.groupBy("node").agg(F.collect_list(F.struct("key", "salt")).alias("keys")), "shared-keys")


def link_classes(docs: DataFrame, size: int, percent: int, text: str, doc_id: str, hot_bucket: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and ``(node, label)`` for each class of equal sets that shares a key with others."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    sketches = saved(rows.mapInArrow(_sketch(size), "doc_id long, text_hash long, n_shingles long, node long, signature binary"), "sketches")
    classes = saved(sketches.where("n_shingles > 0").groupBy("node").agg(F.min_by("signature", F.struct("doc_id", "text_hash")).alias("signature"), F.min(F.struct("doc_id", "text_hash")).alias("first")), "classes")
    keys = _shared_keys(classes, hot_bucket)
    nodes = saved(merged(keys.select("node"), classes, "node"), "shared-nodes")
    wanted = nodes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = rows.join(wanted.hint("merge"), (rows.doc_id.eqNullSafe(wanted.doc_id)) & (rows.text_hash == wanted.text_hash)).select("node", "text")
    sets = saved(texts.mapInArrow(_sets(size), "node long, members binary, odd binary").dropDuplicates(["node"]), "sets")
    compact = merged(sets.select("node", F.expr("octet_length(members) div 8").alias("n"), "odd"), nodes.select("node", "signature"), "node")
    members = sets.select("node", "members")

    labels = nodes.select("node", F.col("node").alias("label"))
    rounds = []  # what a round has written; only the last labels are read again
    for turn in range(STAR_ROUNDS + 1):
        labelled = merged(keys, labels, "node").select("node", "label", F.explode("keys").alias("k")).select("node", "label", "k.key", "k.salt")
        if turn < STAR_ROUNDS:
            pairs = leads(labelled, turn)
        else:
            pairs = saved(_pairs_across(labelled, compact, percent), "across")
        full = merged(merged(pairs, members.toDF("b", "mb"), "b"), members.toDF("a", "ma"), "a")
        links = saved(full.select("la", "lb", "ma", "mb").mapInArrow(_similar(percent), "a long, b long").distinct(), "links")
        if turn == STAR_ROUNDS:
            dropped(pairs)
        if not links.isEmpty():
            joined = components(links)
            of_label = joined.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = saved(_with_label(labels, of_label, "node").select("node", F.coalesce("to", "label").alias("label")), "node-labels")
            dropped(joined, *rounds)
            rounds = [labels]
        dropped(links)
    dropped(classes, keys, sets)
    return sketches, labels


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for each row of ``docs``.

    ``component_id`` is the smallest doc_id that similar documents lead to, the row's own included; ``kept`` says that the
    row has it. Documents without words (null, empty or blank) have no set and no links. Repeated rows share a component
    and are all kept if one is; a null id counts only where a component has no other. Other columns are ignored.
    """
    sketches, labels = link_classes(docs, shingle_words, round(100 * similarity), text, doc_id)
    # equal sets are one class; its smallest id stands for it, and the smallest of a component's classes for all
    of_class = sketches.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    of_class = merged(of_class, labels, "node", "left").where("rows > 1 OR label IS NOT NULL")
    of_class = saved(of_class.select("node", "least", F.coalesce("label", "node").alias("label")), "linked-classes")
    of_label = of_class.groupBy("label").agg(F.min("least").alias("component"))
    of_class = saved(_with_label(of_class, of_label, "node").select("node", F.coalesce("component", "least").alias("component")), "components")
    # a row that is alone in a class without links is its own component
    found = _with_label(sketches.withColumnRenamed("node", "label"), of_class.withColumnRenamed("node", "label").withColumn("linked", F.lit(True)), "doc_id")
    component = F.when((F.col("n_shingles") > 0) & F.col("linked"), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
