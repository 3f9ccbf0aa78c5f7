"""Graph operators on edge tables: closures, roots, tracing, versions, walks, synthetic edges.

Closures go frontier by frontier: each step joins only what is new with the edges and keeps what was not reached before, in tables written to
the checkpoint folder, so cycles end and lineage stays short. Many seeds go at once, as bits of words (``reaching``).
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.reaching import Reached, alike, reached
from tracewell.operators.running import numbered
from tracewell.operators.storage import bounded, written
from tracewell.operators.walking import drawn


def undirected(edges: DataFrame) -> DataFrame:
    """edges and the reverse of each whose pair has none."""
    pairs = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct()
    missing = edges.join(pairs, ["src", "dst"], "left_anti")
    return edges.unionByName(missing.withColumnRenamed("src", "__s").withColumnRenamed("dst", "src").withColumnRenamed("__s", "dst"))


def roots(edges: DataFrame, *by: str) -> DataFrame:
    """Nodes whose first outgoing edge is earlier than their first incoming one, or that have no incoming one."""
    out = edges.groupBy(*by, F.col("src").alias("node")).agg(F.min("t").alias("first_out"))
    into = edges.groupBy(*by, F.col("dst").alias("node")).agg(F.min("t").alias("first_in"))
    return out.join(into, [*by, "node"], "left").where("first_in IS NULL OR first_out < first_in").select(*by, "node")


def reach(edges: DataFrame, seeds: DataFrame, *by: str, backward: bool = False, max_hops: int | None = None) -> DataFrame:
    """(by, seed, node, hops): the pairs of ``reaching.alike``, or of ``reached`` where a seed may name several nodes, made as they are read."""
    return (reached if "seed" in seeds.columns else alike)(edges, seeds, *by, backward=backward, max_hops=max_hops).pairs()


def reach_pairs(edges: DataFrame, seeds: DataFrame, *by: str, backward: bool = False, max_hops: int | None = None) -> DataFrame:
    """(by, seed, node): the same without hops."""
    return (reached if "seed" in seeds.columns else alike)(edges, seeds, *by, backward=backward, max_hops=max_hops).pairs(False)


def reach_one(edges: DataFrame, seeds: DataFrame, *by: str, backward: bool = False) -> DataFrame:
    """(by, seed, node) where each group has one seed or few: a row for each node, frontier by frontier."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = written(edges.select(*by, F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "steps")
    seen = front = written(seeds.select(*by, F.col("node").alias("seed"), "node").distinct(), "reached")
    for hop in count(1):
        new = front.join(step, [*by, "node"]).select(*by, "seed", F.col("next").alias("node")).distinct()
        front = written(new.join(seen, [*by, "seed", "node"], "left_anti").select(*seen.columns), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if hop % 8 == 0:
            seen = written(seen, "reached")


def n_hop(edges: DataFrame, seeds: DataFrame, hops: int, *by: str) -> DataFrame:
    """(by, seed, node) within so many undirected hops."""
    both = edges.select(*by, "src", "dst").union(edges.select(*by, F.col("dst"), F.col("src")))
    return reach_pairs(both, seeds, *by, max_hops=hops)


def ways(edges: DataFrame, pois: DataFrame, *by: str, backward: bool = True) -> tuple[Reached, Reached]:
    """What leads to each point of interest, and what each entry of it leads to. What leads to a node of the first is in it too, so its entries are nodes without incoming edges at all."""
    up = reached(edges, pois, *by, backward=backward)
    a, b = ("src", "dst") if backward else ("dst", "src")
    inner = written(edges.select(*by, F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "inner")
    first = inner.select(*by, F.col("a").alias("node")).distinct().join(inner.select(*by, F.col("b").alias("node")).distinct(), [*by, "node"], "left_anti")
    return up, reached(edges, first.join(up.rows.select(*by, "node").distinct(), [*by, "node"], "left_semi"), *by, backward=not backward)


def crossed(up: Reached, down: Reached, nodes: DataFrame | None = None) -> DataFrame:
    """(by, poi, entry, node), or of some nodes (by, node) only: a node is on a way from every entry that leads to it to every point that it leads to."""
    key = [*up.by, "node"]
    to, of = up.cells(up.whole(), "node"), down.cells(down.whole(), "node").withColumnRenamed("word", "word2").withColumnRenamed("w", "w2")
    met = of.join(to if nodes is None else to.join(nodes, key, "left_semi"), key)
    rows = down.named(up.named(met, seed="pois"), "word2", "w2", "entries")
    return rows.select(*key, "entries", F.explode("pois").alias("poi")).select(*up.by, "poi", F.explode("entries").alias("entry"), "node").where("poi != entry")


def entry_components(edges: DataFrame, pois: DataFrame, *by: str, backward: bool = True) -> DataFrame:
    """(by, poi, entry, node): for each point of interest, the entries of what leads to it (nodes there without incoming edges) and the nodes on ways from the entry to it. Forward: exits, and ways to them."""
    return crossed(*ways(edges, pois, *by, backward=backward))


def ranked_ways(edges: DataFrame, pois: DataFrame, scores: DataFrame, *by: str) -> DataFrame:
    """(by, poi, node): ``ranked_entries`` of ``entry_components``, over classes of nodes that lie on ways between the same entries and points: a class counts with its number and sum of scores."""
    key = [*(c for c in by if c in scores.columns), "node"]
    up, down = ways(edges, pois, *by)
    sides = [r.cells(r.whole(), "node").groupBy(*by, "node").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("word", "w")))), 256).alias(c)) for r, c in ((up, "to"), (down, "of"))]
    alike = written(sides[0].join(sides[1], [*by, "node"]), "classes")
    members = written(alike.join(alike.groupBy(*by, "to", "of").agg(F.min("node").alias("class")), [*by, "to", "of"]).select(*by, "node", "class"), "members")
    sums = members.join(scores.select(*key, "score"), key, "left").groupBy(*by, "class").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("sum"), F.count(F.lit(1)).alias("n"))
    sums = written(sums.withColumnRenamed("class", "node"), "sums")
    parts = crossed(up, down, sums.select(*by, "node"))
    mean = parts.join(bounded(sums), [*by, "node"]).groupBy(*by, "poi", "entry").agg((F.sum("sum") / F.sum("n")).alias("mean"))
    best = mean.withColumn("r", F.rank().over(W.partitionBy(*by, "poi").orderBy(F.desc("mean")))).where("r = 1").select(*by, "poi", "entry")
    chosen = parts.join(bounded(written(best, "best")), [*by, "poi", "entry"], "left_semi").select(*by, "poi", F.col("node").alias("class")).distinct()
    found = chosen.join(bounded(members), [*by, "class"]).select(*by, "poi", "node")
    return found.unionByName(chosen.select(*by, "poi", F.col("poi").alias("node"))).distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, target, hops): lengths of shortest paths between the given nodes."""
    return reach(edges, sources, max_hops=max_hops).select(F.col("seed").alias("source"), F.col("node").alias("target"), "hops").join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("source", "target", "hops")


#: Edges of a node are kept in chunks of so many, in the order of their times.
CHUNK = 1000


def temporal_trace(edges: DataFrame, seeds: DataFrame, backward: bool = True, max_hops: int | None = None) -> DataFrame:
    """(seed, hop, node, t): the one chain back from each seed (node, t): always the latest edge into the node before the time reached, or forward the earliest edge out of it after. Times only fall (or rise), so chains end; max_hops ends them sooner.

    A step looks up the last chunk of the node's edges that begins before the time reached (the first that ends after it) and reads that one only; chains at one place and time look once.
    """
    at, other, best, pick, cond = ("dst", "src", F.max, F.array_max, "low < t") if backward else ("src", "dst", F.min, F.array_min, "high > t")
    ends = edges.select(F.col(at).alias("node"), F.struct(F.col("t").alias("e_t"), F.col(other).alias("to")).alias("e")).where("node IS NOT NULL AND e.e_t IS NOT NULL").distinct()
    placed = numbered(ends, ["node"], ["e"], "n").groupBy("node", F.floor((F.col("n") - 1) / CHUNK).alias("chunk"))
    chunks = written(placed.agg(F.min("e.e_t").alias("low"), F.max("e.e_t").alias("high"), F.collect_list("e").alias("list")), "chunks")
    spans = bounded(written(chunks.select("node", "chunk", "low", "high"), "spans"))
    front = written(seeds.select(F.col("node").alias("seed"), F.lit(0).alias("hop"), "node", "t"), "trace")
    parts = [front]
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        asked = front.select("node", "t").distinct().join(spans, "node").where(cond).groupBy("node", "t").agg(best("chunk").alias("chunk"))
        near = F.filter("list", lambda x: x["e_t"] < F.col("t") if backward else x["e_t"] > F.col("t"))
        met = front.join(asked.join(chunks, ["node", "chunk"]).select("node", "t", pick(near).alias("e")), ["node", "t"]).groupBy("seed").agg(best("e").alias("e"))
        front = written(met.select("seed", F.lit(hop).alias("hop"), F.col("e.to").alias("node"), F.col("e.e_t").alias("t")), "trace")
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) == 16:  # one table for many, so that long chains don't make long plans
            parts = [written(reduce(DataFrame.unionByName, parts), "trace")]
    return reduce(DataFrame.unionByName, parts)


def versioned(edges: DataFrame, *by: str) -> DataFrame:
    """(by, src, src_version, dst, dst_version, kind): the acyclic graph of node versions. In time order, an edge that arrives at a node seen before makes its next version, tied to the last by a self edge.

    An arrival bumps its node iff the node was seen in an earlier edge or is the edge's source; versions are running
    counts of bumps per node, one for the arrival itself in the target's and none in the source's.
    """
    e = written(numbered(edges.select(*by, "src", "dst", "t", "event_uuid"), [*by], ["t", "event_uuid"], "i"), "numbered")
    ends = e.select(*by, "i", F.col("src").alias("node"), F.lit(0).alias("arrival"), (F.col("src") == F.col("dst")).alias("loop")).unionByName(e.select(*by, "i", F.col("dst").alias("node"), F.lit(1).alias("arrival"), (F.col("src") == F.col("dst")).alias("loop")))
    seen = F.min("i").over(W.partitionBy(*by, "node"))
    bump = ((F.col("arrival") == 1) & ((seen < F.col("i")) | F.col("loop"))).cast("int")
    ends = ends.withColumn("bump", bump)
    ends = ends.withColumn("version", F.sum("bump").over(W.partitionBy(*by, "node").orderBy("i", "arrival").rowsBetween(W.unboundedPreceding, 0)))
    s, d = ends.where("arrival = 0"), ends.where("arrival = 1")
    moves = s.select(*by, "i", F.col("node").alias("src"), F.col("version").alias("src_version")).join(d.select(*by, "i", F.col("node").alias("dst"), F.col("version").alias("dst_version")), [*by, "i"]).drop("i")
    ties = d.where("bump = 1").select(*by, F.col("node").alias("src"), (F.col("version") - 1).alias("src_version"), F.col("node").alias("dst"), F.col("version").alias("dst_version"))
    return moves.withColumn("kind", F.lit("edge")).unionByName(ties.withColumn("kind", F.lit("next")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach. Each round every node takes the least root among its neighbours and that root's own root, until nothing changes."""
    links = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "links")
    label = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = links.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = label.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = new.join(label.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
        now = written(jump.select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "labels")
        if now.where("root != old").isEmpty():
            return now.select("node", "root")
        label = now.select("node", "root")


def degree_scores(edges: DataFrame, *by: str) -> DataFrame:
    """Out-degree over in-degree of each node; 0 without incoming edges."""
    ends = edges.select(*by, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select(*by, "e.*")
    g = ends.groupBy(*by, "node").agg(F.sum("o").alias("out"), F.sum("i").alias("into"))
    return g.select(*by, "node", "out", "into", F.round(F.when(F.col("into") == 0, 0.0).otherwise(F.col("out") / F.col("into")), 6).alias("score"))


def min_max(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """rows with column scaled to [0, 1] within each group (no nulls there), 0 where there is no range. An aggregate and a join: a hot group stays spread."""
    rows = written(rows, "rows")
    ends = written(rows.groupBy(*by).agg(F.min(column).alias("__low"), F.max(column).alias("__high")), "ends")
    low, high = F.col("__low"), F.col("__high")
    scaled = rows.join(bounded(ends), list(by)) if by else rows.join(F.broadcast(ends), F.lit(True))
    return scaled.withColumn(column, F.when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low))).select(rows.columns)


def ranked_entries(parts: DataFrame, scores: DataFrame, *by: str) -> DataFrame:
    """(by, poi, node): the nodes of the entries with the highest mean node score, ties included, and the point of interest itself. Scores may be by the same columns, or one for each node."""
    key = [*(c for c in by if c in scores.columns), "node"]
    mean = parts.join(scores.select(*key, "score"), key, "left").groupBy(*by, "poi", "entry").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    best = mean.withColumn("r", F.rank().over(W.partitionBy(*by, "poi").orderBy(F.desc("mean")))).where("r = 1").select(*by, "poi", "entry")
    return parts.join(best, [*by, "poi", "entry"], "left_semi").select(*by, "poi", "node").unionByName(parts.select(*by, "poi", F.col("poi").alias("node"))).distinct()


def trimmed(pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) without those whose source has no incoming or whose target has no outgoing pair, again and again while that takes a fiftieth of them: what is left holds all cycles."""
    n = pairs.count()
    while n:
        ins, outs = pairs.select(F.col("dst").alias("src")).distinct(), pairs.select(F.col("src").alias("dst")).distinct()
        pairs = written(pairs.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "core")
        before, n = n, pairs.count()
        if n > 0.98 * before:
            break
    return pairs


def coloured(core: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each, itself included. A hop follows only the pairs of nodes whose colour has just changed."""
    front = colour = written(core.select(F.col("src").alias("node")).union(core.select("dst")).distinct().withColumn("colour", F.col("node")), "colours")
    for hop in count(1):
        moved = core.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("colour").alias("near"), F.lit(None).cast(colour.schema["colour"].dataType).alias("colour"))
        both = moved.unionByName(colour.withColumn("near", F.lit(None).cast(colour.schema["colour"].dataType))).groupBy("node").agg(F.min("near").alias("near"), F.min("colour").alias("colour"))
        front = written(both.where("near < colour").select("node", F.col("near").alias("colour")), "colours")
        if front.isEmpty():
            return colour.groupBy("node").agg(F.min("colour").alias("colour"))
        colour = colour.unionByName(front)
        if hop % 8 == 0:
            colour = written(colour.groupBy("node").agg(F.min("colour").alias("colour")), "colours")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node on a cycle through other nodes, the least node of its strongly connected component. A row for each node, never pairs.

    Forward-backward colouring: after trimming, each node takes the least node that reaches it as its colour; a colour's own node is in a component
    with all nodes of the colour that reach it. Components found go, and so do edges between colours, until nothing is left. Nodes may be structs, so that many graphs go at once.
    """
    core = trimmed(written(edges.select("src", "dst").where("src != dst").distinct(), "pairs"))
    found = []
    while not core.isEmpty():
        colour = written(coloured(core), "colours")
        ends = core.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        inner = written(ends.where("colour = other").select("colour", "src", "dst"), "inner")
        own = reach_one(inner, colour.where("node = colour"), "colour", backward=True).select("node", F.col("seed").alias("component"))
        own = written(own, "components")
        found.append(own)
        gone = own.select("node")
        rest = inner.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        core = trimmed(written(rest.select("src", "dst"), "core"))
    if not found:
        kind = edges.schema["src"].dataType
        return edges.select(F.col("src").alias("node"), F.col("src").cast(kind).alias("component")).where("false")
    every = written(reduce(DataFrame.unionByName, found), "components")
    several = every.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return every.join(several, "component").select("node", "component")


def members(edges: DataFrame, *by: str) -> DataFrame:
    """(by, node, component): a row for every node under the least node of its strongly connected component (itself where it is alone). Edges with a null end or group are left out. Nodes are numbered in their order over all groups, so that rounds work on longs."""
    pairs = written(edges.select(*by, "src", "dst").dropna().distinct(), "pairs")
    nodes = pairs.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct()
    ids = written(numbered(nodes, [], [*by, "node"], "id"), "ids")
    tag = lambda c: ids.select(*by, F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    numbers = pairs.where("src != dst").join(tag("src"), [*by, "src"]).join(tag("dst"), [*by, "dst"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    parts = strong_components(numbers).select(F.col("node").alias("id"), F.col("component").alias("of"))
    least = parts.where("id = of").join(ids, "id").select("of", F.col("node").alias("component"))
    named = parts.join(least, "of").select("id", "component")
    return written(ids.join(named, "id", "left").select(*by, "node", F.coalesce("component", "node").alias("component")), "members")


def condensed(edges: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """``members``, and the distinct edges (by, src, dst) between components."""
    found = members(edges, *by)
    pairs = edges.select(*by, "src", "dst").where("src != dst").dropna().distinct()
    ends = pairs.join(found.select(*by, F.col("node").alias("src"), F.col("component").alias("a")), [*by, "src"]).join(found.select(*by, F.col("node").alias("dst"), F.col("component").alias("b")), [*by, "dst"])
    return found, written(ends.where("a != b").select(*by, F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "condensed")


def closure(edges: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Members as ``condensed`` has them, and (by, component, reached): the other components that each reaches. A node reaches the nodes of its own component and of those: two joins give all its descendants (or ancestors), and a component's nodes share one set of rows."""
    found, between = condensed(edges, *by)
    seeds = found.select(*by, F.col("component").alias("node")).distinct()
    return found, reach_pairs(between, seeds, *by).select(*by, F.col("seed").alias("component"), F.col("node").alias("reached")).where("component != reached")


def acyclic(edges: DataFrame) -> DataFrame:
    """Distinct edges that lie on no cycle: pairs without self loops whose ends are not in one strongly connected component."""
    pairs = written(edges.select("src", "dst").where("src != dst").distinct(), "pairs")
    parts = written(strong_components(pairs), "components")
    ends = pairs.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src", "left").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst", "left")
    return ends.where("a IS NULL OR b IS NULL OR a != b").select("src", "dst")


def pseudo_graph(edges: DataFrame, share: float = 0.5, *by: str) -> DataFrame:
    """(by, root, node): roots with their descendants, without roots that reach more than ``share`` of all nodes."""
    all_ = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    down = alike(edges, roots(edges, *by), *by)
    cells = written(down.found.cells(down.found.whole(), "node").withColumnRenamed("node", "class"), "cells")
    sums = cells.join(bounded(down.sizes), [*by, "class"]).groupBy(*by, "word").agg(F.array(*(F.sum(F.expr(f"n * getbit(w, {i})")) for i in range(64))).alias("n"))
    reach = sums.select(*by, "word", F.posexplode("n").alias("bit", "n"))
    ends = down.seeds.join(down.places(), [*by, "class"])
    own = ends.join(down.nodes.select(*by, F.col("node").alias("seed"), F.col("class").alias("at")), [*by, "seed"]).join(cells.withColumnRenamed("class", "at"), [*by, "at", "word"])
    own = own.where("getbit(w, bit) = 1").select(*by, "seed", F.lit(1).alias("own"))  # roots that are on a cycle, so among what they reach
    rated = ends.join(reach, [*by, "word", "bit"]).join(own, [*by, "seed"], "left")
    rated = rated.join(all_, list(by)) if by else rated.join(F.broadcast(all_), F.lit(True))
    kept = written(rated.where(F.col("n") - F.coalesce("own", F.lit(0)) <= share * F.col("total")).select(*by, "seed", "class"), "kept")
    return down.pairs(False, kept).select(*by, F.col("seed").alias("root"), "node")


def random_times(pairs: DataFrame, low: int, high: int, seed: int = 0) -> DataFrame:
    """pairs with a time in [low, high), a hash of the pair."""
    return pairs.withColumn("t", F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(high - low)))


def synthetic_attacks(edges: DataFrame, processes: DataFrame, files: DataFrame, per_process: int = 20, seed: int = 0) -> DataFrame:
    """OPEN, READ and WRITE edges from each process to files it never touched, at most ``per_process``, chosen by hash rank.

    Each process looks at a hash-chosen stretch of the file list instead of all pairs; what it touched is left out by an anti join. The stretch is as long as what it touched
    and what it needs together, so it always holds enough fresh files if there are any.
    """
    ranked = numbered(files.select(F.col("node").alias("file"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string"))).alias("h")), [], ["h", "file"], "r").select("file", (F.col("r") - 1).alias("r"))
    total = files.count()
    touched = edges.select(F.col("src").alias("node"), F.col("dst").alias("file")).union(edges.select("dst", "src")).distinct().join(files.select(F.col("node").alias("file")), "file", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    tries = F.least(F.lit(total), F.coalesce("d", F.lit(0)) + per_process)
    picks = processes.join(touched, "node", "left").where(tries > 0).select("node", F.explode(F.sequence(F.lit(0).cast("long"), tries - 1)).alias("k")).withColumn("r", F.pmod(drawn(seed, "node") % max(total, 1) + F.col("k"), F.lit(max(total, 1))))
    known = edges.select(F.col("src").alias("node"), F.col("dst").alias("file")).union(edges.select("dst", "src")).distinct()
    fresh = picks.join(ranked.withColumn("r", F.col("r").cast("long")), "r").join(known, ["node", "file"], "left_anti")
    kept = fresh.withColumn("n", F.row_number().over(W.partitionBy("node").orderBy("k"))).where(F.col("n") <= per_process)
    return kept.select(F.col("node").alias("src"), F.col("file").alias("dst"), F.explode(F.array(*map(F.lit, ("OPEN", "READ", "WRITE")))).alias("op"))


def last_neighbours(edges: DataFrame, size: int, *by: str) -> DataFrame:
    """(node, neighbour, e_id) of the last ``size`` edges of each node, either way round."""
    both = edges.select(*by, F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.col("event_uuid").alias("e_id"), "t").union(edges.select(*by, F.col("dst"), F.col("src"), "event_uuid", "t"))
    return both.withColumn("r", F.row_number().over(W.partitionBy(*by, "node").orderBy(F.desc("t"), F.desc("e_id"), "neighbour"))).where(F.col("r") <= size).drop("r", "t")


def last_update(batches: DataFrame) -> DataFrame:
    """(batch, node, t): the latest time of a node before each batch it is in; null if it is new."""
    ends = batches.select("batch", "t", F.explode(F.array("src", "dst")).alias("node")).groupBy("batch", "node").agg(F.max("t").alias("latest"))
    return ends.select("batch", "node", F.lag("latest").over(W.partitionBy("node").orderBy("batch")).alias("t"))
