"""Operators over typed edges (src, rel, dst), with driver loops that only unroll joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.vectors import dot
from quillspan.operators.dense import nearest
from quillspan.session import apart, bucketed, materialize, release, tidy


#: Queries whose walks share a round at most.
SIDE = 8
#: Steps of a block of nodes.
BLOCK_STEPS = 8_000_000
#: Bytes of masses that a round of a walk sends at most, where one query needs no more.
SENT = 4_000_000_000
#: Arrays of a block of nodes: ids of its nodes; places of nodes with steps, where their steps begin, and of each step the place among
#: the masses received and how often it counts (none: once); steps by node; places to send, how many to each block; seeds and their queries.
KINDS = {"nodes": np.int64, "filled": np.int32, "begin": np.int64, "column": np.int32, "times": np.int32, "total": np.float64, "send": np.int32, "n_send": np.int64, "seed": np.int32, "seed_slot": np.int32}
MESSAGE = "block long, sender long, masses binary"
#: Bytes of a graph and of one query's masses over it that a task may hold; a larger graph is walked by blocks of nodes.
WHOLE = 1_200_000_000
#: Nodes of a tile: numbers within one have two bytes, and masses of two tiles stay in a core's cache.
TILE = 65536
#: Steps between two tiles: numbers within these, and how often a step counts (none: once). Seeds have a query's slot for ``high``, and ``low`` -1.
PIECE = "high int, low int, highs binary, lows binary, times binary"
#: Nodes that are looked up at once.
LOOKED_UP = 1 << 20
#: Rows of a list that travels as one.
LONG = 1000


def with_inverse(edges: DataFrame) -> DataFrame:
    """Each edge, and its inverse under ``inverse_`` and the relation's name."""
    return edges.select("src", "rel", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.concat(F.lit("inverse_"), "rel").alias("rel"), F.col("src").alias("dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at a node; a loop counts twice."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, w): a step to a neighbour, parallel edges weighing more."""
    steps = both_ways(edges).groupBy("src", "dst").agg(F.count("*").alias("m"))
    return steps.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("src"))).drop("m")


def steps_by_blocks(edges: DataFrame, seeds: DataFrame, slots: DataFrame, salt: int, single: bool, size: int) -> tuple[DataFrame, list[int]]:
    """A row of arrays for each block of nodes, and the numbers by which blocks are dealt out.

    A step goes either way, so that a block knows by its own rows which of its nodes have
    neighbours in another block, in the order in which that block expects their masses.
    """
    spark = edges.sparkSession
    n = max(spark.sparkContext.defaultParallelism, 2 * edges.count() // size)
    found = {r.part: r.id for r in spark.range(64 * n).select("id", F.expr(f"pmod(hash(id), {n})").alias("part")).groupBy("part").agg(F.min("id").alias("id")).collect()}
    taken = set(found.values())
    spare = iter(i for i in range(66 * n) if i not in taken)
    # Of each block the label that is dealt to a part of its own.
    labels = [found.get(i) if i in found else next(spare) for i in range(n)]
    named = F.array(*(F.lit(x).cast("long") for x in labels))
    number = lambda c: F.xxhash64(F.lit(salt), c)
    ways = both_ways(edges.where("src <> dst") if single else edges).select(number("src").alias("u"), number("dst").alias("v"), F.lit(-1).alias("slot"))
    begun = seeds.join(F.broadcast(slots), "query_id").select(F.lit(0).cast("long").alias("u"), number("node").alias("v"), F.col("slot").cast("int").alias("slot"))
    dealt = ways.unionByName(begun).withColumn("block", F.element_at(named, (F.pmod("v", F.lit(n)) + 1).cast("int"))).repartition(n, "block")
    
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[x.to_numpy() for x in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        u, v, slot, label = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for block in np.unique(label):
            mine = label == block
            step, begin = mine & (slot < 0), mine & (slot >= 0)
            nodes = np.unique(v[mine])
            near, back = np.unique(u[step], return_inverse=True)
            of = near % n
            order = np.argsort(of, kind="stable")
            place = np.empty(len(near), dtype=np.int64)
            place[order] = np.arange(len(near))
            key, times = np.unique(np.searchsorted(nodes, v[step]) * len(near) + place[back], return_counts=True)
            row, column = np.divmod(key, max(len(near), 1))
            if single:
                times = times[:0]
            sent = np.unique(of[order][column] * len(nodes) + row)
            filled, first = np.unique(row, return_index=True)
            total = np.bincount(row, weights=None if single else times, minlength=len(nodes)).astype(np.float64)
            values = (nodes, filled, first, column, times, total, sent % len(nodes), np.bincount(sent // len(nodes), minlength=n), np.searchsorted(nodes, v[begin]), slot[begin])
            stored = (pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(values, KINDS.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([labels.index(block)], pa.int64()), *stored], names=["block", "nth", *KINDS])

    rows = dealt.select("u", "v", "slot", "block").mapInArrow(run, "block long, nth long, " + ", ".join(f"{x} binary" for x in KINDS))
    with tidy(spark):
        return bucketed(rows, "steps", "block", n), labels


def rounds_of(team: list[float], lowest: int, labels: list[int], nothing: int, restart: float) -> tuple:
    """The first, a next and the last round of queries ``lowest``… whose seeds have the masses of ``team``; a null node, ``nothing``, sends nothing."""

    def read(t):
        return {c: np.frombuffer(t.column(c)[0].as_buffer(), k) for c, k in KINDS.items()}

    def begun(b):
        x = np.zeros((len(team), len(b["nodes"])))
        ours = (b["seed_slot"] >= lowest) & (b["seed_slot"] < lowest + len(team))
        slot = b["seed_slot"][ours] - lowest
        x[slot, b["seed"][ours]] = np.array(team)[slot]
        return x

    def messages(t, b, x):
        out, ends = x / np.maximum(b["total"], 1.0), np.cumsum(b["n_send"])
        out[:, b["nodes"] == nothing] = 0.0
        nth = t.column("nth")[0].as_py()
        rows = [(labels[i], nth, out[:, b["send"][ends[i] - b["n_send"][i] : ends[i]]].tobytes()) for i in np.flatnonzero(b["n_send"])]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "sender", "masses"])

    def moved(b, sent):
        x = np.zeros((len(team), len(b["nodes"])))
        if len(b["column"]):
            order = np.argsort(sent.column("sender").to_numpy())
            parts = [np.frombuffer(sent.column("masses")[int(i)].as_buffer(), np.float64).reshape(len(team), -1) for i in order]
            for q in range(len(team)):
                got = np.concatenate([p[q] for p in parts])[b["column"]]
                x[q, b["filled"]] = np.add.reduceat(got * b["times"] if len(b["times"]) else got, b["begin"])
        return (1 - restart) * x + restart * begun(b)

    def first(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = read(t := batch.slice(i, 1))
                yield from messages(t, b, begun(b)).to_batches()

    def again(block, sent):
        b = read(block)
        return messages(block, b, moved(b, sent))

    def last(block, sent):
        b = read(block)
        x = np.ascontiguousarray(moved(b, sent).T)
        return pa.Table.from_arrays([pa.array(b["nodes"]), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(team)), pa.int32()), pa.array(x.ravel()))], names=["id", "masses"])

    return first, again, last


def named_nodes(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, int, int]:
    """(node, number), numbers from 0 without gaps; how many they are, and how many edges.

    Nodes of most edges are first, by powers of two, then by name, as like names often are near.
    """
    every = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).unionAll(seeds.select("node"))
    met = every.groupBy("node").agg(F.count("*").alias("times")).withColumn("rank", F.floor(F.log2("times")).cast("int"))
    with tidy(edges.sparkSession):
        names = materialize(met.orderBy(F.desc("rank"), F.length(F.col("node").cast("string")), "node").withColumn("id", F.monotonically_increasing_id()), "names")
    part = F.shiftright("id", 33)
    slices, before = [], 0
    for r in sorted(names.groupBy(part.alias("part"), "rank").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("times").alias("times")).collect(), key=lambda r: (-r["rank"], r.part)):
        slices.append((r.part, r["rank"], before - r.first, r.times))
        before += r.n
    begin = names.sparkSession.createDataFrame([x[:3] for x in slices], "part long, of long, shift long")
    out = names.join(F.broadcast(begin), (part == F.col("part")) & (F.col("rank") == F.col("of"))).select("node", (F.col("id") + F.col("shift")).cast("int").alias("number"))
    return out, before, sum(x[3] for x in slices) // 2


def pieces(edges: DataFrame, seeds: DataFrame, slots: DataFrame, names: DataFrame, single: bool, n: int) -> tuple[DataFrame, int]:
    """Rows ``PIECE`` of edges either way and of seeds, by numbers of nodes, and the number of a null node (-1: none).

    Each edge is held once. Edges between two tiles lie together, so that a round reads and
    adds up masses within two tiles at a time.
    """
    spark = edges.sparkSession
    for salt in range(9):
        number = lambda c, salt=salt: F.xxhash64(F.lit(salt), c)  # noqa: E731, B023
        found = names.select(number("node").alias("id"), "number").toArrow()
        ids, numbers = found.column("id").to_numpy(), found.column("number").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, numbers = ids[order], numbers[order]
        if (ids[1:] > ids[:-1]).all():
            break
    else:
        raise RuntimeError("nodes share numbers under every salt")
    known = spark.sparkContext.broadcast((ids, numbers))
    nothing = names.where("node IS NULL").select("number").first()

    def looked_up(x):
        ids, numbers = known.value
        order, out = np.argsort(x), np.empty(len(x), dtype=np.int64)
        out[order] = numbers[np.searchsorted(ids, x[order])]
        return out

    def together(batches, columns):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LOOKED_UP:
                yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in columns]
                held, rows = [], 0
        if rows:
            yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in columns]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in together(batches, ("u", "v")):
            a, b = looked_up(u), looked_up(v)
            a, b = np.minimum(a, b), np.maximum(a, b)
            key = (b // TILE << 48) | (a // TILE << 32) | (b % TILE << 16) | a % TILE
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not held:
            return
        key, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        pair = key >> 32
        ends = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(key)]
        for begin, end in zip(ends, ends[1:]):
            high, low = int(pair[begin]) & 0xFFFF, int(pair[begin]) >> 16
            for i in range(begin, end, TILE):
                k, t = key[i : min(i + TILE, end)], times[i : min(i + TILE, end)]
                often = None if single or (t == 1).all() else t.astype(np.int64).tobytes()
                row = ([high], [low], [k.astype(np.uint16).tobytes()], [(k >> 16).astype(np.uint16).tobytes()], [often])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["high", "low", "highs", "lows", "times"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, v in together(batches, ("slot", "v")):
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(looked_up(v))], names=["slot", "number"])

    def gathered(t: pa.Table) -> pa.Table:
        row = (t.column("slot")[:1], [-1], [b""], [t.column("number").to_numpy().astype(np.int32).tobytes()], [None])
        return pa.table([pa.array(x, t) if isinstance(x, list) else x for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["high", "low", "highs", "lows", "times"])

    ways = (edges.where("src <> dst") if single else edges).select(number("src").alias("u"), number("dst").alias("v"))
    dealt = ways.mapInArrow(keyed, "key long").repartition(n, F.shiftright("key", 32))
    begun = seeds.join(F.broadcast(slots), "query_id").select("slot", number("node").alias("v")).mapInArrow(placed, "slot int, number long")
    with tidy(spark):
        out = materialize(dealt.mapInArrow(cut, PIECE).unionByName(begun.groupBy("slot").applyInArrow(gathered, PIECE)), "pieces")
    known.destroy()
    return out, nothing.number if nothing else -1


def walk_whole(table: DataFrame, nodes: int, nothing: int, tasks: int, width: int, rounds: int, restart: float) -> DataFrame:
    """(chunk, slot, masses) of walks over ``pieces``: a task holds the graph and takes one query after another, so that nothing is sent in a round."""

    def walker(first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps, seeds = [], {}
            for batch in batches:
                for high, low, *kept in zip(*(batch.column(i).to_pylist() for i in (0, 1)), *(batch.column(i) for i in (2, 3, 4)), strict=True):
                    if low >= 0:
                        steps.append((high * TILE, low * TILE, *(np.frombuffer(x.as_buffer(), np.uint16) for x in kept[:2]), np.frombuffer(kept[2].as_buffer(), np.int64) if kept[2].is_valid else None))
                    elif high % tasks == first:
                        seeds[high] = np.frombuffer(kept[1].as_buffer(), np.int32).copy()
            steps.sort(key=lambda s: s[1::-1])
            most = max((len(s[2]) for s in steps), default=0)
            places, sent = np.empty((2, most), dtype=np.intp), np.empty((2, most))

            def moved(out, y):
                for a, b, highs, lows, times in steps:
                    (i, j), (down, up) = places[:, : len(highs)], sent[:, : len(highs)]
                    i[:], j[:] = highs, lows
                    np.take(out[a : a + TILE], i, out=down, mode="clip")
                    np.take(out[b : b + TILE], j, out=up, mode="clip")
                    if times is not None:
                        down *= times
                        up *= times
                    np.add.at(y[b : b + TILE], j, down)
                    np.add.at(y[a : a + TILE], i, up)

            share, x = np.zeros(nodes), np.ones(nodes)
            moved(x, share)
            np.divide(1.0, share, out=share, where=share > 0)
            if nothing >= 0:
                share[nothing] = 0.0
            for slot, start in seeds.items():
                x[:] = 0.0
                x[start] = 1.0 / len(start)
                y = np.empty(nodes)
                for _ in range(rounds):
                    x *= share
                    y[:] = 0.0
                    moved(x, y)
                    y *= 1 - restart
                    y[start] += restart / len(start)
                    x, y = y, x
                for i in range(0, nodes, width):
                    if (part := x[i : i + width]).any():
                        yield pa.RecordBatch.from_arrays([pa.array([i // width], pa.int32()), pa.array([slot], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "slot", "masses"])

        return run

    parts = [table.coalesce(1).mapInArrow(walker(i), "chunk int, slot int, masses binary") for i in range(tasks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    with apart(table.sparkSession):
        return materialize(out, "masses")


def with_names(masses: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(slot, node, mass) above zero of (chunk, slot, masses)."""

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        place = left.column("number").to_numpy() % width
        slot = right.column("slot").to_numpy()
        x = np.array([np.frombuffer(m.as_buffer(), np.float64)[place] for m in right.column("masses")]).reshape(len(slot), len(place)).T
        node, of = np.nonzero(x)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(place))))), pa.int32())
        found = pa.StructArray.from_arrays([pa.array(slot[of], pa.int32()), pa.array(x[node, of])], names=["slot", "mass"])
        return pa.table([left.column("node").combine_chunks(), pa.ListArray.from_arrays(ends, found)], names=["node", "found"])

    chunks = names.withColumn("chunk", F.floor(F.col("number") / width).cast("int")).groupBy("chunk").cogroup(masses.groupBy("chunk"))
    kind = names.schema["node"].dataType.simpleString()
    with tidy(names.sparkSession):
        walked = materialize(chunks.applyInArrow(met, f"node {kind}, found array<struct<slot: int, mass: double>>"), "walked")
    return walked.select("node", F.inline("found")).where("mass > 0")


def walk(edges: DataFrame, seeds: DataFrame, rounds: int, restart: float, *, single: bool = False, size: int = BLOCK_STEPS, most: int = SENT, whole: int = WHOLE) -> DataFrame:
    """(query_id, node, mass) of a walk over edges (src, dst) either way, from seeds (query_id, node), uniform over distinct ones.

    Parallel edges weigh more; with ``single`` they count as one, and loops go. A graph of
    at most ``whole`` bytes is held by each of as many tasks as there are queries, if there
    are cores for them; a task takes all rounds of its queries. A larger one lies in blocks.
    """
    spark, seeds = edges.sparkSession, seeds.where("query_id IS NOT NULL").distinct()
    asked = seeds.groupBy("query_id").agg(F.count("*").alias("n")).orderBy("query_id").collect()
    kind_of = seeds.schema["query_id"].dataType.simpleString()
    slots = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], f"slot int, query_id {kind_of}")
    names, nodes, n_edges = named_nodes(edges.select("src", "dst"), seeds)
    # Two bytes for each end of an edge, eight for a count; vectors of masses, sums and shares, and what is looked up.
    if asked and n_edges * (4 if single else 12) + nodes * 40 <= whole:
        n = max(spark.sparkContext.defaultParallelism, 2 * n_edges // size)
        tasks = min(len(asked), spark.sparkContext.defaultParallelism)
        width = max(1, 8 * TILE // max(8, len(asked)))
        table, nothing = pieces(edges.select("src", "dst"), seeds, slots, names, single, n)
        masses = walk_whole(table, nodes, nothing, tasks, width, rounds, restart)
        release(table)
        flat = with_names(masses, names, width)
        release(masses)
        return flat.join(F.broadcast(slots), "slot").select("query_id", "node", "mass")
    return walk_by_blocks(edges, seeds, rounds, restart, single, size, most, asked, slots, names)


def walk_by_blocks(edges: DataFrame, seeds: DataFrame, rounds: int, restart: float, single: bool, size: int, most: int, asked: list, slots: DataFrame, names: DataFrame) -> DataFrame:
    """``walk`` over a graph of any size.

    Nodes lie in blocks by a hash. In a round, a block sends each other block the masses of
    those nodes that have neighbours there, once and without their names, in tables that the
    next round reads in place and that go afterwards: nothing is shuffled. As many queries
    share a round as keep these tables at ``most`` bytes.
    """
    spark = edges.sparkSession
    for salt in range(9):
        named = names.select("node", F.xxhash64(F.lit(salt), "node").alias("id"))
        if named.agg(F.count("*") == F.count_distinct("id")).first()[0]:
            break
    else:
        raise RuntimeError("nodes share numbers under every salt")
    table, labels = steps_by_blocks(edges.select("src", "dst"), seeds, slots, salt, single, size)
    sends = table.agg(F.sum(F.octet_length("send"))).first()[0] or 0
    share = int(max(1, min(SIDE, most // max(2 * sends, 1))))
    nothing = spark.range(1).select(F.xxhash64(F.lit(salt), F.lit(None).cast("string"))).first()[0]
    done = []
    for lowest in range(0, len(asked), share):
        first, again, last = rounds_of([1.0 / r.n for r in asked[lowest : lowest + share]], lowest, labels, nothing, restart)
        met = lambda x: table.groupBy("block").cogroup(x.groupBy("block"))
        x = bucketed(table.mapInArrow(first, MESSAGE), "masses", "block", len(labels))
        for _ in range(rounds - 1):
            after = bucketed(met(x).applyInArrow(again, MESSAGE), "masses", "block", len(labels))
            release(x)
            x = after
        done.append(materialize(met(x).applyInArrow(last, "id long, masses array<double>").withColumn("lowest", F.lit(lowest)), "walked"))
        release(x)
    release(table)
    out = done[0] if done else spark.createDataFrame([], "id long, masses array<double>, lowest int")
    for more in done[1:]:
        out = out.unionByName(more)
    flat = out.join(named, "id").select("node", "lowest", F.posexplode("masses").alias("place", "mass")).where("mass > 0")
    return flat.join(F.broadcast(slots), flat["lowest"] + flat["place"] == slots["slot"]).select("query_id", "node", "mass")


def random_walk(edges: DataFrame, seeds: DataFrame, *, steps: int = 3, restart: float = 0.15) -> DataFrame:
    """(query_id, node, mass) after a few steps; parallel edges weigh more."""
    return walk(edges, seeds, steps, restart)


def personalised_rank(edges: DataFrame, seeds: DataFrame, *, rounds: int = 50, restart: float = 0.05) -> DataFrame:
    """(query_id, node, mass) of power iteration without loops or parallel edges; a node without neighbours loses its mass."""
    return walk(edges, seeds, rounds, restart, single=True)


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query_id, node, hops): least number of undirected steps from a seed, up to ``depth``."""
    near = materialize(both_ways(edges).distinct(), "neighbours")
    seen = seeds.distinct().withColumn("hops", F.lit(0))
    for i in range(1, depth + 1):
        front = seen.where(F.col("hops") == i - 1)
        new = front.join(near, front["node"] == near["src"]).select("query_id", F.col("dst").alias("node")).distinct()
        seen = materialize(seen.unionByName(new.join(seen, ["query_id", "node"], "left_anti").withColumn("hops", F.lit(i))), "seen")
    return seen


def hitting(edges: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """(query_id, node, p): chance that a walk from a node meets a target within some steps."""
    p = materialize(transitions(edges), "transitions").select(F.col("src").alias("before"), F.col("dst").alias("node"), "w")
    goal = targets.distinct().withColumn("p", F.lit(1.0))
    x = goal
    for _ in range(steps):
        back = x.join(p, "node").groupBy("query_id", F.col("before").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))
        x = goal.unionByName(back.join(goal, ["query_id", "node"], "left_anti"))
    return x


def message_pass(edges: DataFrame, state: DataFrame, weights: DataFrame, *, message: str = "mul", aggregate: str = "sum") -> DataFrame:
    """(query_id, node, value) of one layer over edges and state (query_id, node, value).

    A message is state times (``mul``) or plus (``add``) its relation's weight; messages and
    the node's own state are summed, or the largest or smallest counts, or their mean.
    """
    sent = state.join(edges, state["node"] == edges["src"]).join(F.broadcast(weights), "rel")
    value = F.col("value") * F.col("weight") if message == "mul" else F.col("value") + F.col("weight")
    moved = sent.select("query_id", F.col("dst").alias("node"), value.alias("value")).unionByName(state.select("query_id", "node", "value"))
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[aggregate]
    return moved.groupBy("query_id", "node").agg(fold("value").alias("value"))


def moments(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(query_id, node, mean, largest, smallest, deviation, scale): statistics of incoming messages and the degree scale."""
    sent = state.join(edges, state["node"] == edges["src"]).select("query_id", F.col("dst").alias("node"), "value")
    v = F.col("value")
    stats = sent.groupBy("query_id", "node").agg(
        F.avg(v).alias("mean"), F.max(v).alias("largest"), F.min(v).alias("smallest"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(1e-6))).alias("deviation"), F.log(F.count("*") + 1.0).alias("log_degree")
    )
    return stats.withColumn("scale", F.col("log_degree") / F.avg("log_degree").over(Window.partitionBy("query_id"))).drop("log_degree")


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; otherwise left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_merge")


def numbered(nodes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(node, number) of the distinct rows of nodes (node), numbers from 0 without gaps, and how many they are."""
    with tidy(nodes.sparkSession):
        ids = materialize(nodes.distinct().withColumn("id", F.monotonically_increasing_id()), name)
    slices, before = [], 0
    for part, n in sorted(map(tuple, ids.groupBy(F.shiftright("id", 33)).count().collect())):
        slices.append((part, before))
        before += n
    begin = ids.sparkSession.createDataFrame(slices, "part long, before long")
    number = (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("number")
    return ids.join(F.broadcast(begin), F.shiftright("id", 33) == F.col("part")).select("node", number), before


def shortcuts(edges: DataFrame, pairs: list[tuple[str, str]], *, long: int = LONG) -> DataFrame:
    """src -r1-> x -r2-> dst becomes src -short_r2-> dst for the listed pairs of relations; edges may repeat.

    What a node x reaches travels to a source as one list of numbers, and repeats go within
    the source's lists, so that pairs of ends are never shuffled. Sources with more than
    ``long`` steps, or with a step to a node that reaches more, are joined row by row.
    """
    allowed = F.broadcast(edges.sparkSession.createDataFrame(pairs, "r1 string, r2 string"))
    firsts, seconds = (edges.where(F.col("rel").isin(sorted({p[i] for p in pairs}))) for i in (0, 1))
    first = firsts.select("src", F.col("rel").alias("r1"), F.col("dst").alias("x")).join(allowed, "r1").select("src", "x", "r2")
    second = seconds.select(F.col("src").alias("x"), F.col("rel").alias("r2"), "dst")
    names, n = numbered(second.select(F.col("dst").alias("node")), "ends")
    # Two bytes a number, if they do.
    number = (F.col("number") - 32768).cast("smallint") if n <= 65536 else F.col("number").cast("int" if n < 1 << 31 else "long")
    names = few(names.select(F.col("node").alias("dst"), number.alias("number")))
    count = lambda df, *c: df.groupBy(*c).agg(F.count("*").alias("n")).where(F.col("n") > long).select(*c)
    with tidy(edges.sparkSession):
        wide = few(materialize(count(second, "x", "r2"), "wide"))
        hubs = few(materialize(count(first, "src", "r2").union(first.join(wide, ["x", "r2"], "left_semi").select("src", "r2")).distinct(), "hubs"))
        narrow = second.join(wide, ["x", "r2"], "left_anti").join(names, "dst").select("x", "r2", "number")
        lists = materialize(narrow.repartition("x").groupBy("x", "r2").agg(F.collect_set("number").alias("reached")), "lists")
    met = first.join(hubs, ["src", "r2"], "left_anti").join(lists, ["x", "r2"]).groupBy("src", "r2").agg(F.array_distinct(F.flatten(F.collect_list("reached"))).alias("reached"))
    light = met.select("src", "r2", F.explode("reached").alias("number")).join(names, "number").select("src", "r2", "dst")
    heavy = first.join(hubs, ["src", "r2"], "left_semi").join(second, ["x", "r2"]).select("src", "r2", "dst").distinct()
    return light.unionByName(heavy).where("src <> dst").select("src", F.concat(F.lit("short_"), "r2").alias("rel"), "dst")


def relation_graph(edges: DataFrame) -> DataFrame:
    """(r1, kind, r2): relations that share a node as head or tail of their edges."""
    ends = edges.select("rel", F.col("src").alias("node"), F.lit("head").alias("side")).unionByName(edges.select("rel", F.col("dst").alias("node"), F.lit("tail").alias("side"))).distinct()
    a = ends.select("node", F.col("rel").alias("r1"), F.col("side").alias("s1"))
    b = ends.select("node", F.col("rel").alias("r2"), F.col("side").alias("s2"))
    return a.join(b, "node").select("r1", F.concat_ws("_", "s1", "s2").alias("kind"), "r2").distinct()


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(kind, a, b, sim) of vectors (kind, id, v) of one kind, a < b, at ``least`` or above.

    Exact: vectors are dealt out in blocks, and each pair of blocks of a kind meets once, so
    that no task holds more than two blocks' share of a kind.
    """
    n = 8
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    left = dealt.select("kind", F.col("id").alias("x"), F.col("v").alias("vx"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))).alias("cell"), "block")
    right = left.select("kind", "cell", F.col("x").alias("y"), F.col("vx").alias("vy"), F.col("block").alias("block_y"))
    met = left.join(right, ["kind", "cell"]).where((F.col("x") < F.col("y")) & ((F.col("block") != F.col("block_y")) | (F.col("cell.p") == F.col("cell.q"))))
    return met.select("kind", F.col("x").alias("a"), F.col("y").alias("b"), dot(F.col("vx"), F.col("vy")).alias("sim")).where(F.col("sim") >= least)


def mutual_neighbours(vectors: DataFrame, k: int, low: float, high: float) -> DataFrame:
    """(kind, a, b, sim): each among the other's ``k`` nearest, then within bounds.

    The nearest are taken before the bounds, so that near copies use up places.
    """
    near = nearest(vectors, vectors, k, by=["kind"], same=True).select("kind", F.col("query_id").alias("x"), F.col("doc_id").alias("y"), F.col("score").alias("sim"))
    near = materialize(near, "near")
    back = near.select("kind", F.col("y").alias("x"), F.col("x").alias("y"))
    kept = near.join(back, ["kind", "x", "y"], "left_semi").where((F.col("x") < F.col("y")) & F.col("sim").between(low, high))
    return kept.select("kind", F.col("x").alias("a"), F.col("y").alias("b"), "sim")


def answer(expr: tuple, edges: DataFrame) -> DataFrame:
    """Nodes that a logical query over the graph has as answers.

    ``("node", name)``, ``("step", relation, query)``, ``("and", q, …)``, ``("or", q, …)``
    and ``("not", q, r)`` for q without r compile to joins and set operations.
    """
    kind, *rest = expr
    if kind == "node":
        return edges.sparkSession.createDataFrame([(rest[0],)], "node string")
    if kind == "step":
        inner = answer(rest[1], edges)
        return edges.where(F.col("rel") == rest[0]).join(inner, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
    parts = [answer(x, edges) for x in rest]
    out = parts[0]
    for p in parts[1:]:
        out = {"and": out.intersect, "or": lambda q, o=out: o.union(q).distinct(), "not": out.subtract}[kind](p)
    return out
