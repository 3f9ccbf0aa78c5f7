"""Reachability from many seeds at once. The seeds that reach a node are bits of long words, so one row of an edge carries a block of up to 1,024 seeds.

Pairs of seed and node are made at the very end, from words, in the stage that reads them: they are neither shuffled nor written here, however many there are.

Where each seed is one node, ``alike`` searches between classes: seeds with the same next nodes, and nodes with the same nodes before them. Words then grow with classes of seeds times classes of nodes, not with pairs.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.running import numbered
from tracewell.operators.storage import bounded, written

#: Words of a row at most.
WORDS = 16
#: Members of a class of seeds and of nodes in one row at most.
SEEDS, NODES = 256, 1024


class Reached(NamedTuple):
    """rows (by, block, node, hops, w0, w1 ...): bit i of word j of a block stands for seed number 64 * (words * block + j) + i of its group, set in the row of the fewest hops. names (by, word, seeds): the seeds of each word in the order of its bits. rest (by, seed, node, hops): seeds with a null, which meet no edge."""

    rows: DataFrame
    names: DataFrame
    rest: DataFrame
    by: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return [c for c in self.rows.columns if c.startswith("w") and c[1:].isdigit()]

    def only(self, **group: object) -> Reached:
        """Those of one value of a column of ``by``, without it."""
        of = lambda table: table.where(" AND ".join(f"{c} = {v!r}" for c, v in group.items())).drop(*group)
        return Reached(of(self.rows), of(self.names), of(self.rest), tuple(b for b in self.by if b not in group))

    def whole(self) -> DataFrame:
        """(by, block, node, words) without hops."""
        return self.rows.groupBy(*self.by, "block", "node").agg(*(F.bit_or(w).alias(w) for w in self.words))

    def cells(self, rows: DataFrame, *keep: str) -> DataFrame:
        """(by, keep, word, w): a row for each word that is not zero."""
        each = F.array(*(F.struct(F.lit(j).alias("j"), F.col(w).alias("w")) for j, w in enumerate(self.words)))
        found = rows.select(*self.by, "block", *keep, F.explode(F.filter(each, lambda x: x["w"] != 0)).alias("x"))
        return found.select(*self.by, *keep, (F.col("block") * len(self.words) + F.col("x.j")).alias("word"), "x.w")

    def named(self, cells: DataFrame, word: str = "word", w: str = "w", seed: str = "seeds") -> DataFrame:
        """cells with the array of the seeds whose bits are set in w instead of word and w."""
        names = bounded(self.names).select(*self.by, F.col("word").alias(word), F.col("seeds").alias("__names"))
        chosen = F.expr(f"CASE WHEN {w} = -1 THEN __names ELSE filter(__names, (x, i) -> getbit({w}, i) = 1) END")
        return cells.join(names, [*self.by, word]).withColumn(seed, chosen).drop("__names", word, w)

    def single(self, cells: DataFrame, seed: str) -> DataFrame:
        """cells with a row for each seed whose bit is set in w, instead of word and w: bits are looked at in generated code, so sparse words cost little."""
        names = bounded(self.names).withColumnRenamed("seeds", "__names")
        each = cells.join(names, [*self.by, "word"]).withColumn("__bit", F.explode(F.array(*map(F.lit, range(64))))).where("getbit(w, __bit) = 1")
        return each.withColumn(seed, F.get("__names", F.col("__bit"))).drop("__names", "__bit", "word", "w")

    def pairs(self, hops: bool = True) -> DataFrame:
        """(by, seed, node, hops), or without hops."""
        keep = ("node", "hops") if hops else ("node",)
        rows = self.rows.repartition(*self.by, "block", "node") if hops else self.whole()
        out = self.named(self.cells(rows, *keep)).select(*self.by, F.explode("seeds").alias("seed"), *keep)
        return out.unionByName(self.rest.select(out.columns))


def reached(edges: DataFrame, seeds: DataFrame, *by: str, backward: bool = False, max_hops: int | None = None) -> Reached:
    """All nodes that can be reached from each seed along edges of the same ``by`` group (or against them), the seed too with 0 hops. Without max_hops until nothing new is found. A column ``seed`` of seeds, if there is one, names several nodes that start together."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = written(edges.select(*by, F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "steps")
    name = "seed" if "seed" in seeds.columns else "node"
    starts = written(seeds.select(*by, F.col(name).alias("seed"), "node").distinct(), "starts")
    rest = starts.where(" OR ".join(f"{c} IS NULL" for c in starts.columns)).withColumn("hops", F.lit(0))
    starts = starts.dropna()
    ids = written(numbered(starts.select(*by, "seed").distinct(), list(by), ["seed"], "n").select(*by, "seed", (F.col("n") - 1).alias("n")), "seeds")
    most = ids.agg(F.max("n")).first()[0] or 0
    words = [f"w{j}" for j in range(min(WORDS, most // 64 + 1))]
    bit = F.pmod("n", F.lit(64)).cast("int")
    names = ids.groupBy(*by, F.floor(F.col("n") / 64).alias("word")).agg(F.array_sort(F.collect_list(F.struct("n", "seed"))).alias("s")).select(*by, "word", F.col("s.seed").alias("seeds"))
    names = written(names, "seed-names")
    key = [*by, "block", "node"]
    at = starts.join(bounded(ids), [*by, "seed"]).select(*by, "node", F.floor(F.col("n") / (64 * len(words))).alias("block"), F.pmod(F.floor(F.col("n") / 64), F.lit(len(words))).alias("j"), bit.alias("bit"))
    put = F.expr("shiftleft(1L, bit)")
    first = at.groupBy(*key).agg(*(F.bit_or(F.when(F.col("j") == j, put).otherwise(F.lit(0).cast("long"))).alias(w) for j, w in enumerate(words)))
    front = seen = written(first.select(*key, *words), "reached")
    found = front.withColumn("hops", F.lit(0))
    zero = F.lit(0).cast("long")
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        moved = front.join(step, [*by, "node"]).select(*by, "block", F.col("next").alias("node"), *words, F.lit(True).alias("new"))
        both = moved.unionByName(seen.withColumn("new", F.lit(False))).groupBy(*key)
        fresh = lambda w: F.coalesce(F.bit_or(F.when(F.col("new"), F.col(w))), zero).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(F.when(~F.col("new"), F.col(w))), zero)))
        front = written(both.agg(*(fresh(w).alias(w) for w in words)).where(" OR ".join(f"{w} != 0" for w in words)), "reached")
        if front.isEmpty():
            break
        found, seen = found.unionByName(front.withColumn("hops", F.lit(hop))), seen.unionByName(front)
        if hop % 8 == 0:
            found = written(found, "reached")
            seen = written(seen.groupBy(*key).agg(*(F.bit_or(w).alias(w) for w in words)), "seen")
    return Reached(found, names, rest, by)


class Alike(NamedTuple):
    """found: what classes of seeds (numbers) reach of classes of nodes (numbers) by a hop or more, hops counted from 0. seeds (by, seed, class) and nodes (by, node, class): their members; a seed that leads nowhere has no class. sizes (by, class, n) of classes of nodes. starts (by, seed): all seeds, those with a null too."""

    found: Reached
    seeds: DataFrame
    nodes: DataFrame
    sizes: DataFrame
    starts: DataFrame

    def places(self) -> DataFrame:
        """(by, class, word, bit): where the words of found have each class of seeds."""
        return self.found.names.select(*self.found.by, "word", F.posexplode("seeds").alias("bit", "class"))

    def pairs(self, hops: bool = True, seeds: DataFrame | None = None) -> DataFrame:
        """(by, seed, node, hops), or without hops; seed and node differ but for the starts, which are left out where only some seeds (by, seed, class) are asked for."""
        by, spark = self.found.by, self.nodes.sparkSession
        keep = ("node", "hops") if hops else ("node",)
        cells = self.found.cells(self.found.rows if hops else self.found.whole(), *keep).withColumnRenamed("node", "class")
        keep = ("class", *keep[1:])
        some = written(dealt(self.seeds if seeds is None else seeds, "seed", SEEDS, *by).join(self.places(), [*by, "class"]), "members")
        names = written(some.groupBy(*by, "word", "part").agg(F.collect_list(F.struct("bit", F.col("members").alias("seeds"))).alias("names")), "names")
        nodes = written(dealt(self.nodes, "node", NODES, *by), "members").select(*by, "class", F.col("members").alias("nodes"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        cells = cells.repartition(parts, *by, "class", "word")  # a number, as few bytes here become many rows
        chosen = F.expr("CASE WHEN w = -1 THEN names ELSE filter(names, x -> getbit(w, x.bit) = 1) END")
        met = cells.join(bounded(names), [*by, "word"]).select(*by, *keep, F.explode(chosen).alias("x")).select(*by, *keep, F.col("x.seeds").alias("seeds"))
        met = met.join(bounded(nodes), [*by, "class"]).select(*by, *keep[1:], "seeds", F.explode("nodes").alias("node")).select(*by, *keep[1:], "node", F.explode("seeds").alias("seed"))
        out = met.where("NOT (seed <=> node)").select(*by, "seed", "node", *((F.col("hops") + 1).alias("hops") for _ in keep[1:]))
        return out if seeds is not None else out.unionByName(self.starts.select(*by, "seed", F.col("seed").alias("node"), *(F.lit(0).alias("hops") for _ in keep[1:])))


def dealt(rows: DataFrame, member: str, most: int, *by: str) -> DataFrame:
    """(by, class, part, members): the members of each class in rows of about ``most``, dealt by hash."""
    n = rows.groupBy(*by, "class").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    placed = rows.join(n, [*by, "class"]).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")))
    return placed.groupBy(*by, "class", "part").agg(F.collect_set(F.struct(member)).alias("members")).withColumn("members", F.col(f"members.{member}"))


def classes(pairs: DataFrame, member: str, of: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """(by, class, rep, n) and (by, member, class) of distinct pairs: members that stand with the same set of ``of`` make a class. Sets are told apart by their number of values and three 64-bit hashes summed by exclusive or, so no row holds a set. A class is a number, its rep the least of its members (null if that is all)."""
    marks = ["__n", "__x", "__y", "__z"]
    sums = [F.count(F.lit(1)), *(F.bit_xor(F.xxhash64(F.lit(k), of)) for k in range(3))]
    marked = written(pairs.groupBy(*by, member).agg(*(x.alias(m) for x, m in zip(sums, marks, strict=True))), "marked")
    found = marked.groupBy(*by, *marks).agg(F.min(member).alias("rep"), F.count(F.lit(1)).alias("n"))
    found = written(found.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = marked.join(found.select(*by, *marks, "class"), [*by, *marks]).select(*by, member, "class")
    return found.select(*by, "class", "rep", "n"), written(members, "classes")


def alike(edges: DataFrame, seeds: DataFrame, *by: str, backward: bool = False, max_hops: int | None = None) -> Alike:
    """``reached`` for seeds (by, node), between classes of nodes with the same nodes before them: every seed but one of themselves reaches them at the same hop. The edges into one of a class stand for all; seeds with the same next nodes make one seed that starts at those."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = written(edges.select(*by, F.col(a).alias("node"), F.col(b).alias("next")).dropna(subset=[*by, "node"]).distinct(), "steps")
    starts = written(seeds.select(*by, F.col("node").alias("seed")).distinct(), "starts")
    kinds, nodes = classes(step.select(*by, F.col("next").alias("to"), "node"), "to", "node", *by)
    nodes = nodes.withColumnRenamed("to", "node")
    reps = kinds.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("class").alias("next_class"), "rep")
    on = [F.col(c) == F.col(f"__{c}") for c in by] + [F.col("next").eqNullSafe(F.col("rep"))]
    into = written(step.join(reps, on).select(*by, "node", "next_class"), "into")
    asked = into.join(starts.withColumnRenamed("seed", "node"), [*by, "node"], "left_semi")
    origins, members = classes(asked.withColumnRenamed("node", "seed"), "seed", "next_class", *by)
    begun = asked.join(origins.select(*by, F.col("rep").alias("node"), "class"), [*by, "node"]).select(*by, F.col("class").alias("seed"), F.col("next_class").alias("node"))
    ways = into.join(nodes, [*by, "node"]).select(*by, F.col("class").alias("src"), F.col("next_class").alias("dst"))
    found = reached(ways, begun, *by, max_hops=None if max_hops is None else max_hops - 1)
    return Alike(found, members, nodes, kinds.select(*by, "class", "n"), starts)
