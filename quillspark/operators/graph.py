"""Property graphs as tables of nodes ``(id, kind, name)`` and edges ``(source, target, kind)``."""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import merged, saved
from .ranking import bm25

# Results must agree with them.
HOP_DECAY = 0.4


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "kind").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, kind, n``: nodes and edges of each kind."""
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...] = (), direction: str = "both") -> DataFrame:
    """Distinct ``start, id`` one hop away that exist as nodes."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    if direction == "in":
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    elif direction == "both":
        edges = both_ways(edges)
    hop = starts.select(F.col("id").alias("start")).join(edges, F.col("start") == F.col("source")).select("start", F.col("target").alias("id")).distinct()
    return hop.join(nodes.select("id"), "id", "left_semi")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, kinds: tuple[str, ...] = (), direction: str = "both") -> DataFrame:
    """``start, id, depth``: the least number of hops from each start, up to ``max_depth``; starts are left out."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    if direction == "in":
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    elif direction == "both":
        edges = both_ways(edges)
    edges = saved(edges.select(F.col("source").alias("id"), F.col("target").alias("next")).distinct(), "hops")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, max_depth + 1):
        hop = merged(front, edges, "id").select("start", F.col("next").alias("id")).distinct()
        front = merged(hop, seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth))
        front = saved(front, "front") if depth < max_depth else front  # the next hop reads it twice
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def degrees(edges: DataFrame, kind: str) -> DataFrame:
    """``id, callers``: how many distinct sources reach a target by edges of the kind."""
    return edges.where(F.col("kind") == kind).groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("callers"))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """All simple cycles of up to ``longest`` nodes, each once, from its smallest node: ``path``.

    Paths only grow through nodes larger than their first, so a cycle has one rotation.
    """
    hops = saved(edges.select("source", "target").distinct(), "hops")
    paths = hops.where("source < target").select(F.array("source", "target").alias("path"))
    found = hops.where("source = target").select(F.array("source").alias("path"))
    for _ in range(2, longest + 1):
        tail = paths.select("path", F.element_at("path", -1).alias("source"))
        step = saved(merged(tail, hops, "source"), "paths")  # read twice: what closes, and what goes on
        found = found.unionByName(step.where(F.col("target") == F.element_at("path", 1)).select("path"))
        paths = step.where((F.col("target") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
    return found


def untested(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Nodes of the kinds, with a public name, that no test reaches."""
    public = nodes.where(F.col("kind").isin(*kinds) & ~F.col("name").startswith("_"))
    return public.join(edges.where("kind = 'tests'").select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def search(nodes: DataFrame, fragment: str, limit: int) -> DataFrame:
    """Nodes with the fragment in their name, the shortest names first."""
    return nodes.where(F.col("name").ilike(f"%{fragment}%")).orderBy(F.length("name"), "name", "id").limit(limit)


def define(nodes: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    """``wanted, id, tier``: nodes of exactly the wanted name, else (unless strict) those that have it in their name."""
    exact = names.join(nodes, F.col("wanted") == F.col("name")).select("wanted", "id", F.lit(0).alias("tier"))
    if strict:
        return exact
    # names are a stated set of look-ups, held against all nodes
    loose = nodes.join(F.broadcast(names.join(exact.select("wanted").distinct(), "wanted", "left_anti")), F.lower("name").contains(F.lower("wanted"))).select("wanted", "id", F.lit(1).alias("tier"))
    return exact.unionByName(loose)


def exists(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``wanted, found``: whether a node has exactly that name or one that ends with it."""
    hits = define(nodes, names).join(nodes.select("id", "name"), "id").where(F.lower("name").endswith(F.lower("wanted"))).select("wanted").distinct()
    return names.join(hits.withColumn("found", F.lit(True)), "wanted", "left").select("wanted", F.coalesce("found", F.lit(False)).alias("found"))


#: Characters of a run that nodes are found by at most, bits of the filter of such runs, and parts that the nodes of one run are dealt into.
LONGEST_RUN, FILTER_BITS, RUN_PARTS = 8, 1 << 26, 16


def _filter(grams: DataFrame) -> bytes:
    """A bit for the hash of each ``gram``; it takes some runs for one of them, and loses none."""
    return _bitmap(grams.select(F.pmod(F.crc32(F.encode("gram", "utf-8")), F.lit(FILTER_BITS)).alias("at")))


def _runs_in(spark, grams: DataFrame):
    """Adds each ``gram`` that may be one of ``grams`` to nodes ``(id, name, qualname)`` that have it, whatever the case."""
    bits = spark.sparkContext.broadcast(_filter(grams))
    lengths = sorted({r.n for r in grams.select(F.length("gram").alias("n")).distinct().collect()})  # LONGEST_RUN + 1 at most

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            rows, found = [], []
            for row, texts in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                own = {x[i : i + n] for x in texts if x is not None for n in lengths for i in range(len(x) - n + 1)}
                for gram in own:
                    at = crc32(gram.encode()) % FILTER_BITS
                    if known[at >> 3] >> (at & 7) & 1:
                        rows.append(row)
                        found.append(gram)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in range(3)), pa.array(found, pa.string())], ["id", "name", "qualname", "gram"])

    return lambda nodes: nodes.select("id", "name", "qualname", F.lower("name"), F.lower("qualname")).mapInArrow(runs, "id string, name string, qualname string, gram string")


#: Shapes of wanted names (their length, and where they have ``_``) that are found by windows, the most frequent ones; runs of characters
#: that are hashed together at most; bits for each name in the filter; rows that a task holds before it hands them on.
SHAPES, HASHED_RUN, HASHES, HELD = 64, 16, 3, 200_000
_RUN_FACTOR, _PLACE_FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _shape_runs(shape: str) -> list[tuple[int, int]]:
    """Begin and length of the runs of characters between the ``_`` of a shape, none longer than HASHED_RUN."""
    return [(m.start() + k, min(HASHED_RUN, m.end() - m.start() - k)) for m in re.finditer("[^_]+", shape) for k in range(0, m.end() - m.start(), HASHED_RUN)]


def _run_hashes(points: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length up to the longest, a hash of the characters from each place on; too near the end it says nothing."""
    out = [np.zeros(len(points), dtype=np.uint64)]
    for n in range(1, longest + 1):
        here = out[-1] * _RUN_FACTOR + np.uint64(1)
        here[: max(0, len(points) - n + 1)] += points[n - 1 :]
        out.append(here)
    return out


def _window_hashes(runs: list[np.ndarray], shape: str, at: np.ndarray) -> np.ndarray:
    """A hash of the window of this shape that begins at each of the places, blind to what stands at its ``_``."""
    out = np.full(len(at), len(shape), dtype=np.uint64)
    for begin, n in _shape_runs(shape):
        out = (out ^ (out >> np.uint64(29))) * _PLACE_FACTOR + runs[n][at + begin] + np.uint64(begin)
    out = (out ^ (out >> np.uint64(32))) * _PLACE_FACTOR
    return out ^ (out >> np.uint64(29))


def _bits_of(hashes: np.ndarray, k: int) -> np.ndarray:
    return ((hashes >> np.uint64(19 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _pattern_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(pattern, shape)`` to the places ``at`` of the bits that stand for each pattern."""
    for batch in batches:
        found = [np.zeros(0, dtype=np.int64)]
        shapes = np.array(batch.column(1).to_pylist(), dtype=object)
        for shape in sorted(set(shapes)):
            texts = batch.column(0).filter(pa.array(shapes == shape)).to_pylist()
            runs = _run_hashes(_points(texts), HASHED_RUN)
            hashes = _window_hashes(runs, shape, np.arange(len(texts)) * len(shape))
            found += [_bits_of(hashes, k) for k in range(HASHES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["at"])


def _bitmap(at: DataFrame) -> bytes:
    """A bit for each place ``at`` under FILTER_BITS, 8 MB however many there are."""
    place = F.col("at") + 1  # bitmap_bucket_number begins with 1 for a position of 1
    parts = at.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(FILTER_BITS // 32768 * 4096)
    for r in parts.toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] = bytes(r.bits)
    return bytes(out)


def _windows_hit(texts: list[str], shapes: list[str], known: np.ndarray) -> dict[int, set[str]]:
    """For each text by its number: its windows of the given shapes whose bits are all set, with ``_`` where the shape has it."""
    points, lengths = _points(texts), np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))
    runs = _run_hashes(points, min(HASHED_RUN, max((n for shape in shapes for _, n in _shape_runs(shape)), default=0)))
    out: dict[int, set[str]] = {}
    for size in sorted({len(shape) for shape in shapes}):
        places = np.flatnonzero(left >= size)
        for shape in (x for x in shapes if len(x) == size):
            at, hashes = places, _window_hashes(runs, shape, places) if size else np.zeros(0, dtype=np.uint64)
            for k in range(HASHES if size else 0):
                bit = _bits_of(hashes, k)
                kept = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                at, hashes = at[kept], hashes[kept]
            of = np.searchsorted(ends, at, side="right")
            wild = [k for k, c in enumerate(shape) if c == "_"]
            for text, begin in zip(of.tolist(), (at - ends[of] + lengths[of]).tolist()):
                window = texts[text][begin : begin + size]
                for k in wild:
                    window = window[:k] + "_" + window[k + 1 :]
                out.setdefault(text, set()).add(window)
    return out


def _first_with(spark, fixed: DataFrame, shapes: list[str], loose: int):
    """Nodes ``(id, name, qualname)`` to ``(pattern, id, name)``: for each pattern ``(pattern, shape)`` that may be asked for, the first nodes
    that hold it, as far as one task knows. Each text is cut into windows of the shapes there are, so no node is sent for what it holds
    but isn't among the first by."""
    bits = spark.sparkContext.broadcast(_bitmap(fixed.mapInArrow(_pattern_bits, "at long")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, dtype=np.uint8)
        best: dict[str, list[tuple[int, str, str]]] = {}
        held = 0

        def told() -> pa.RecordBatch:
            rows = [(pattern, i, name if n >= 0 else None) for pattern, found in best.items() for n, name, i in found]
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["pattern", "id", "name"])

        for batch in batches:
            both = pa.chunked_array([batch.column(2), batch.column(3)]).dictionary_encode().unify_dictionaries().combine_chunks()
            both = both.chunk(0) if isinstance(both, pa.ChunkedArray) else both
            hits = _windows_hit(both.dictionary.to_pylist(), shapes, known)
            codes = both.indices.fill_null(-1).to_numpy().reshape(2, -1)
            some = np.isin(codes, np.fromiter(hits, dtype=np.int64, count=len(hits))).any(axis=0)
            rows = np.flatnonzero(some)
            ids, names = (batch.column(k).take(pa.array(rows)).to_pylist() for k in (0, 1))
            for a, b, i, name in zip(codes[0, rows].tolist(), codes[1, rows].tolist(), ids, names):
                row = (len(name), name, i) if name is not None else (-1, "", i)
                for pattern in hits.get(a, set()) | hits.get(b, set()):
                    found = best.setdefault(pattern, [])
                    if len(found) < loose or row < found[-1]:
                        insort(found, row)
                        held += 1
                        if len(found) > loose:
                            found.pop()
                            held -= 1
            if held > HELD:
                yield told()
                best, held = {}, 0
        yield told()

    return lambda nodes: nodes.select("id", "name", F.lower("name"), F.lower("qualname")).mapInArrow(first, "pattern string, id string, name string")


def _by_rarest_run(own: DataFrame, rest: DataFrame) -> DataFrame:
    """``wanted, id, name``: the nodes that hold names of any form, as LIKE says. A name meets only the nodes that have the rarest of the first and last
    LONGEST_RUN characters of its parts between wild ones. Other runs stay in the task that reads the node."""
    spark, size = own.sparkSession, F.lit(LONGEST_RUN)
    parts = F.filter(F.split(F.lower("wanted"), "[%_]"), lambda x: x != "")
    ends = F.array_distinct(F.concat(F.transform(parts, lambda x: F.left(x, size)), F.transform(parts, lambda x: F.right(x, size))))
    asked = saved(rest.select("wanted", F.explode(F.when(F.size(ends) > 0, ends).otherwise(F.array(F.lit("")))).alias("gram")), "asked")
    common = merged(asked.select("gram").distinct(), _runs_in(spark, asked)(own).groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rarest = merged(asked, common, "gram", "left").groupBy("wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    rarest = saved(rarest, "rarest")
    # the nodes of a run are dealt out, and meet a copy of the names that are searched for by it
    copies = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(RUN_PARTS - 1))))
    held = _runs_in(spark, rarest)(own).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(RUN_PARTS)).cast("int"))
    pattern = F.concat(F.lit("%"), F.replace(F.lower("wanted"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return merged(held, copies, ["gram", "part"]).withColumn("_pattern", pattern).where("lower(name) LIKE _pattern OR lower(qualname) LIKE _pattern").select("wanted", "id", "name")


def look_up(nodes: DataFrame, names: DataFrame, loose: int = 10) -> DataFrame:
    """``wanted, id, tier, place``: what each of ``names(wanted)`` may mean among ``nodes(id, name, qualname)``.

    Tier 0: nodes of that name; else 1: of that full name; else 2: the first ``loose`` whose name or full name holds it, as LIKE
    says without regard to case (``_`` and ``%`` stand for anything), the shortest names first. ``place`` counts from 1. No name
    is held against all nodes: a name without ``%`` is a window of a node's name, so tasks cut those into windows of the shapes that
    names have, and send on the first nodes for each only. Names with ``%``, and of rare shapes, are searched for by their rarest run
    (:func:`_by_rarest_run`). Very many nodes may have one name: they are numbered by a sort by range.
    """
    names = names.select("wanted").where("wanted IS NOT NULL").distinct()
    own, spark = nodes.select("id", "name", "qualname"), nodes.sparkSession
    exact = merged(names, own.withColumn("wanted", F.col("name")), "wanted").withColumn("tier", F.lit(0))
    rest = merged(names, exact.select("wanted").distinct(), "wanted", "left_anti")
    full = merged(rest, own.withColumn("wanted", F.col("qualname")), "wanted").withColumn("tier", F.lit(1))
    rest = merged(rest, full.select("wanted").distinct(), "wanted", "left_anti")

    shape = F.when(~F.contains("pattern", F.lit("%")), F.regexp_replace("pattern", "[^_]", "x"))
    rest = saved(rest.withColumn("pattern", F.lower("wanted")).withColumn("shape", shape), "rest")
    common = [r.shape for r in rest.where("shape <> ''").groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(SHAPES).collect()]
    found = F.coalesce(F.col("shape").isin(common), F.lit(False))
    fixed, other = rest.where(found), rest.where(~found)
    near = [merged(_first_with(spark, fixed.select("pattern", "shape"), common, loose)(own), fixed.select("pattern", "wanted"), "pattern").select("wanted", "id", "name")] if common else []
    near += [] if other.isEmpty() else [_by_rarest_run(own, other.select("wanted"))]

    place = (F.length("name"), "name", "id")
    named = exact.unionByName(full).orderBy("wanted", *place).select("wanted", "id", "tier", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    named = saved(named, "named")
    before = Window.partitionBy("wanted").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = named.groupBy("wanted", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select("wanted", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    out = merged(named, sizes, ["wanted", "_part"]).select("wanted", "id", "tier", (F.col("_at") + F.col("_start")).cast("int").alias("place"))
    order = Window.partitionBy("wanted").orderBy(*place)
    for hits in near:
        out = out.unionByName(hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= loose).select("wanted", "id", F.lit(2).alias("tier"), "place"))
    return out


def known(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``wanted, found``: whether a node has that name, or one of the first five that hold it has a full name that ends with it."""
    names = names.select("wanted").distinct()
    hits = look_up(nodes, names, loose=5).where("tier = 0 OR place <= 5").join(nodes.select("id", "qualname"), "id")
    hits = hits.where((F.col("tier") == 0) | F.endswith("qualname", "wanted")).select("wanted").distinct()
    return names.join(hits.withColumn("found", F.lit(True)), "wanted", "left").select("wanted", F.coalesce("found", F.lit(False)).alias("found"))


def impact(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """``wanted, id, how``: callers and tests of the first definition of each wanted name."""
    first = saved(define(nodes, names).groupBy("wanted").agg(F.min_by("id", F.struct("tier", "id")).alias("target")), "first")
    # the names are a stated set of look-ups with one definition each; what doesn't touch these never leaves its task
    touching = edges.where("kind IN ('calls', 'tests')").select("target", F.col("source").alias("id"), F.col("kind").alias("how"))
    return touching.join(F.broadcast(first), "target").select("wanted", "id", "how").distinct()


def describe_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, id, reason`` for pairs of nodes: the verb of an edge between them, or that the one leads to the other."""
    out = edges.select(F.col("source").alias("seed"), F.col("target").alias("id"), F.concat("kind", F.lit(" ->")).alias("verb"))
    back = edges.select(F.col("target").alias("seed"), F.col("source").alias("id"), F.concat("kind", F.lit(" <-")).alias("verb"))
    direct = out.unionByName(back).groupBy("seed", "id").agg(F.min("verb").alias("verb"))
    return pairs.join(direct, ["seed", "id"], "left").select("seed", "id", F.coalesce("verb", F.lit("reachable from")).alias("reason"))


def link_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TESTS edges: from a test to what it calls, unless that is a test, too."""
    kind = lambda key, name: nodes.select(F.col("id").alias(key), F.col("kind").alias(name))
    called = edges.where("kind = 'calls'").select("source", "target").join(kind("source", "sk"), "source").join(kind("target", "tk"), "target")
    return called.where("sk = 'test' AND tk <> 'test'").select("source", "target", F.lit("tests").alias("kind")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Nodes of the kind that no edge points to."""
    return nodes.where(F.col("kind") == kind).join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def resolve_unique(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """``references(source, name)`` with ``target``: the definition of that name if there is only one, else null."""
    unique = definitions.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").select("name", "target")
    return references.join(unique, "name", "left").select("source", "name", "target", F.col("target").isNotNull().alias("resolved"))


def dependencies(edges: DataFrame) -> DataFrame:
    """``id, uses, used_by``: sorted distinct targets and sources of each node, by imports."""
    pairs = edges.select("source", "target").distinct()
    uses = pairs.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list("target")).alias("uses"))
    used = pairs.groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_list("source")).alias("used_by"))
    none = F.array().cast("array<string>")
    return uses.join(used, "id", "full_outer").select("id", F.coalesce("uses", none).alias("uses"), F.coalesce("used_by", none).alias("used_by"))


#: What a link says of a node, from the node to the seed and back, in the order in which links count.
LINK_WORDS = (("contains", "contains", "contained in"), ("inherits", "inherits from", "base of"), ("calls", "calls", "called by"), ("tests", "tests", "tested by"))


def link_reasons(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``reason`` to ``pairs(seed, seed_name, id)``: how the node is linked to the seed, by its own edges first, or that it
    is only reached from there."""
    turn = lambda k: F.coalesce(*[F.when(F.col("kind") == x[0], F.lit(i)) for i, x in enumerate(LINK_WORDS)], F.lit(len(LINK_WORDS)))
    word = lambda k, other: F.coalesce(*[F.when(F.col("kind") == x[0], F.lit(x[k])) for x in LINK_WORDS], F.lit(other))
    own = edges.select(F.col("target").alias("seed"), F.col("source").alias("id"), turn(1).alias("_turn"), word(1, "relates to").alias("_word"))
    back = edges.select(F.col("source").alias("seed"), F.col("target").alias("id"), (turn(2) + 10).alias("_turn"), word(2, "related to").alias("_word"))
    first = own.unionByName(back).groupBy("seed", "id").agg(F.min(F.struct("_turn", "_word"))["_word"].alias("_word"))
    return pairs.join(first, ["seed", "id"], "left").withColumn("reason", F.concat(F.coalesce("_word", F.lit("reachable from")), F.lit(" "), "seed_name")).drop("_word")


def contexts_for(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, limit: int = 20, max_depth: int = 2) -> DataFrame:
    """``task_id, id, score, depth, reasons``: the best nodes for each of ``tasks(task_id, task)``.

    ``nodes`` has id, name, text, and whether it may be an answer (``wanted``); an optional ``place`` settles equal scores, then the
    id. The best by BM25 are seeds, and pass their score on along ``edges``, each hop for less. Seeds go in the order of their
    rank, and a later one passes on what earlier ones gave it: a fold over an array of at most ``max(limit // 2, 5)`` scores.
    Walks go through any node that exists; only wanted ones are answers. A seed keeps depth 0, others have the depth from the
    first seed that reaches them. Reasons stand in the order of the seeds, each once.
    """
    known = nodes.select("id")
    place = F.col("place") if "place" in nodes.columns else F.lit("")
    edges = saved(edges.select("source", "target", "kind").join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi").distinct(), "links")
    ranked = bm25(tasks.select(F.col("task_id").alias("query_id"), F.col("task").alias("query")), nodes.where("wanted").select(F.col("id").alias("doc_id"), "text"))
    seeds = ranked.where(F.col("rank") <= max(limit // 2, 5)).select(F.col("query_id").alias("task_id"), F.col("doc_id").alias("seed"), F.col("rank").cast("int").alias("rank"), "score")
    seeds = saved(seeds.join(nodes.select(F.col("id").alias("seed"), F.col("name").alias("seed_name")), "seed"), "seeds")
    reach = saved(reachable(edges, seeds.select(F.col("seed").alias("id")).distinct(), max_depth), "reach")

    # at most seeds x seeds numbers for each task, folded in the order of the ranks
    among = seeds.join(reach.withColumnRenamed("start", "seed"), "seed").join(seeds.select("task_id", F.col("seed").alias("id"), F.col("rank").alias("other")), ["task_id", "id"])
    among = among.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("rank") * 10_000 + F.col("other")).alias("k"), F.pow(F.lit(HOP_DECAY), "depth").alias("w")))).alias("weights"))
    bases = seeds.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"), F.max("score").alias("top"))
    bases = bases.join(among, "task_id", "left").withColumn("scores", F.transform("s", lambda x: x["score"] / F.col("top")))
    weight = lambda i, j: F.coalesce(F.try_element_at("weights", i * 10_000 + j), F.lit(0.0))

    def passed(state: Column, i: Column) -> Column:
        now = F.element_at(state["scores"], i)
        given = F.transform(state["scores"], lambda s, j: s + now * weight(i, j + 1))
        return F.struct(given.alias("scores"), F.concat(state["given"], F.array(now)).alias("given"))

    folded = bases.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.size("scores")), F.struct("scores", F.array().cast("array<double>").alias("given")), passed))
    passes = folded.select("task_id", F.posexplode(F.arrays_zip("f.scores", "f.given")).alias("i", "x")).select("task_id", (F.col("i") + 1).alias("rank"), F.col("x.scores").alias("final"), F.col("x.given").alias("given"))
    passes = seeds.join(passes, ["task_id", "rank"])

    answers = nodes.where("wanted").select("id")
    hits = passes.join(reach.withColumnRenamed("start", "seed"), "seed").join(answers, "id", "left_semi")
    hits = link_reasons(hits, edges).select("task_id", "id", "rank", "depth", "reason", (F.col("given") * F.pow(F.lit(HOP_DECAY), "depth")).alias("part"), F.lit(None).cast("double").alias("final"))
    said = F.concat(F.lit("matches '"), "task", F.lit("' (rank "), F.col("rank").cast("string"), F.lit(")"))
    direct = passes.join(tasks.select("task_id", "task"), "task_id").select("task_id", F.col("seed").alias("id"), F.lit(0).alias("rank"), F.lit(0).alias("depth"), said.alias("reason"), F.lit(0.0).alias("part"), "final")
    told = F.transform(F.sort_array(F.collect_list(F.struct("rank", "reason"))), lambda x: x["reason"])
    out = hits.unionByName(direct).groupBy("task_id", "id").agg(F.coalesce(F.max("final"), F.sum("part")).alias("score"), F.min_by("depth", "rank").alias("depth"), F.array_distinct(told).alias("reasons"))
    best = Window.partitionBy("task_id").orderBy(F.round("score", 9).desc(), "_place", "id")
    out = out.join(nodes.select("id", place.alias("_place")), "id").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit)
    return out.select("task_id", "id", "score", "depth", "reasons")


def context_for(nodes: DataFrame, edges: DataFrame, task: str, limit: int = 20, max_depth: int = 2) -> DataFrame:
    """Nodes ``(id, score, depth)`` for one task; all of ``nodes(id, name, text)`` may be answers. See :func:`contexts_for`."""
    tasks = nodes.sparkSession.createDataFrame([(0, task)], "task_id int, task string")
    return contexts_for(nodes.withColumn("wanted", F.lit(True)), edges, tasks, limit, max_depth).select("id", "score", "depth").orderBy(F.desc("score"), "id")
