"""Benchmark decontamination on a distributed positional inverted index.

The index holds one posting (row, tid, pos) for each training token whose term occurs in a benchmark, and for each row an end mark, whose
position is the row's number of words. It is sharded by document, since tokens are posted where the text is read, without a
shuffle; each shard is sorted by term, so a term's postings are one list, and a look-up reads only the pages of the lists it asks for. A
query phrase looks up its rarest terms first: their postings, moved back by the terms' offsets in the item, must meet on one
diagonal (row, item, offset). Only for such rows are the other terms' postings asked for; runs of matched positions give exact phrase
occurrences. Proximity matches let the diagonal drift by a few words at each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, discard, list_sha256, materialise, words

WINDOW, RARE, SHARE, SLACK = 13, 3, 20, 2
#: A look-up reads at most so many stretches of each shard. If the vocabulary has more terms than LOOKUP_TERMS it reads whole shards: the join selects all the same.
STRETCHES, LOOKUP_TERMS = 32, 100_000
END = 0


def item_terms(items: DataFrame, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """Writes and returns (item, item_id, n, p, term, tid): the words of each item with their positions. Terms are numbered from 1, those that are most frequent in the items first.

    Items that repeat an id with another text count as items of their own under one id; null and wordless ones have no rows.
    """
    tokens = items.select(F.col(id_col).alias("item_id"), words(F.col(text)).alias("tokens")).distinct()
    tokens = tokens.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull(), F.concat_ws(" ", "tokens")))
    terms = materialise(tokens.select("item", "item_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("p", "term")), "items")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    numbered = counts.select("term", F.row_number().over(W.orderBy(F.desc("c"), "term")).alias("tid"))  # one row per term of the benchmark
    return materialise(terms.join(numbered, "term").select("item", "item_id", "n", "p", "term", "tid"), "terms")


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes and returns the postings (row, doc_id, tid, pos) of the given terms, each shard sorted by term. row numbers the rows of docs within this index; doc_id stands at end marks only."""
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.concat(words(F.col(text)), F.array(F.lit(""))).alias("tokens"))
    postings = tokens.select("row", "doc_id", F.posexplode("tokens").alias("pos", "term"))
    known = terms.select("term", "tid").distinct().unionByName(docs.sparkSession.createDataFrame([("", END)], "term string, tid int"))
    postings = postings.join(bounded(materialise(known, "vocabulary")), "term")
    return materialise(postings.select("row", F.when(F.col("tid") == END, F.col("doc_id")).alias("doc_id"), "tid", "pos").sortWithinPartitions("tid"), "postings")


def list_sizes(index: DataFrame) -> DataFrame:
    """Writes and returns (tid, count): the length of each posting list."""
    return materialise(index.where(F.col("tid") != END).groupBy("tid").agg(F.count(F.lit(1)).alias("count")), "list-sizes")


def stretches(sizes: list[tuple[int, int, bool]], most: int = STRETCHES) -> list[tuple[int, int]]:
    """Ranges of terms, at most ``most``, that hold all wanted ones and pass over as many postings as they can. sizes: (tid, count, wanted)."""
    cuts, first, last, skipped = [], None, None, 0
    for tid, count, wanted in sorted(sizes):
        if wanted:
            if last is not None:
                cuts.append((skipped, last, tid))
            first, last, skipped = tid if first is None else first, tid, 0
        else:
            skipped += count
    if first is None:
        return []
    kept = sorted((a, b) for n, a, b in sorted(cuts, reverse=True)[: most - 1] if n)
    return list(zip([first, *(b for _, b in kept)], [*(a for a, _ in kept), last], strict=True))


def look_up(index: DataFrame, sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of the wanted terms (a written table with a column tid), and what lies between them in the same pages."""
    if sizes.count() > LOOKUP_TERMS:
        return index.where(F.col("tid") != END)
    marked = sizes.join(wanted.select("tid").distinct().withColumn("wanted", F.lit(True)), "tid", "left").collect()
    ranges = [(F.col("tid") >= a) & (F.col("tid") <= b) for a, b in stretches([(r.tid, r["count"], bool(r.wanted)) for r in marked])]
    return index.where(reduce(Column.__or__, ranges, F.lit(False)))


def rarest(terms: DataFrame, sizes: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """Writes and returns (item, start, p, tid, k): for each window of an item the positions of its rarest terms, and how many these are. Windows with a term that the index lacks can't occur and have no rows."""
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - (window - 1)), F.least(F.col("p"), F.greatest(F.lit(0), F.col("n") - window)))).alias("start")
    slots = terms.select("item", "n", "p", "tid", starts).join(sizes, "tid")
    by = W.partitionBy("item", "start")
    slots = slots.withColumn("r", F.row_number().over(by.orderBy("count", "p"))).withColumn("known", F.count(F.lit(1)).over(by))
    kept = slots.where((F.col("known") == F.least(F.lit(window), "n")) & (F.col("r") <= rare))
    return materialise(kept.select("item", "start", "p", "tid", F.least(F.lit(rare), "known").alias("k")), "seeds")


def seed_hits(index: DataFrame, sizes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Writes and returns (row, item, p, delta): the postings of the rarest terms, moved back by their offsets."""
    points = materialise(seeds.select("item", "p", "tid").distinct(), "points")
    return materialise(look_up(index, sizes, points).join(bounded(points), "tid").select("row", "item", "p", (F.col("pos") - F.col("p")).alias("delta")), "hits")


def meeting(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, item, place): diagonals on which all rarest terms of some window meet."""
    met = hits.withColumnRenamed("delta", "place").join(bounded(seeds.select("item", "start", "p", "k")), ["item", "p"])
    return met.groupBy("row", "item", "place", "start", "k").agg(F.count_distinct("p").alias("n")).where("n = k").select("row", "item", "place").distinct()


def postings_of(index: DataFrame, sizes: DataFrame, terms: DataFrame, places: DataFrame) -> DataFrame:
    """Writes and returns (row, tid, pos): the postings of the items' terms in the rows where their rarest terms meet."""
    rows = materialise(places.select("row").distinct(), "rows")
    wanted = materialise(terms.join(bounded(materialise(places.select("item").distinct(), "met-items")), "item", "left_semi").select("tid").distinct(), "met-terms")
    return materialise(look_up(index, sizes, wanted).join(bounded(rows), "row", "left_semi").select("row", "tid", "pos"), "narrow")


def matches(narrow: DataFrame, terms: DataFrame, found: DataFrame) -> DataFrame:
    """(row, item, delta, p): the positions of an item matched on each diagonal (row, item, place)."""
    expected = found.join(bounded(terms.select("item", "p", "tid")), "item").select("row", "item", F.col("place").alias("delta"), "p", "tid", (F.col("place") + F.col("p")).alias("pos"))
    return expected.join(narrow, ["row", "pos", "tid"]).select("row", "item", "delta", "p")


def phrase_runs(found: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item_id, start, stop): stretches of a row's words, stop exclusive, that are covered by windows of an item, one for each maximal run on a diagonal."""
    by = W.partitionBy("row", "item", "delta").orderBy("p")
    runs = found.withColumn("island", F.col("p") - F.row_number().over(by)).groupBy("row", "item", "delta", "island").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("length"))
    sizes = materialise(terms.select("item", "item_id", "n").distinct(), "sizes")
    runs = runs.join(bounded(sizes), "item").where(F.col("length") >= F.least(F.lit(window), "n"))
    return runs.select("row", "item_id", (F.col("delta") + F.col("first")).alias("start"), (F.col("delta") + F.col("first") + F.col("length")).alias("stop"))


def drift(window: int, slack: int) -> int:
    return (window - 1) * slack + 1


def near_places(hits: DataFrame, seeds: DataFrame, window: int, slack: int) -> DataFrame:
    """(row, item, place, start): windows whose rarest terms follow each other on diagonals that drift no faster than a chain can. A place k holds the diagonals from k to k + 2 drifts, so any chain is whole in one."""
    reach = drift(window, slack)
    both = F.explode(F.array(F.floor(F.col("delta") / reach), F.floor(F.col("delta") / reach) - 1))
    placed = hits.withColumn("place", both)
    # most places have one of an item's rare terms alone: plain extremes tell them before any list is collected
    fewest = materialise(seeds.groupBy("item").agg(F.min("k").alias("fewest")), "fewest")
    spans = placed.groupBy("row", "item", "place").agg(F.min("p").alias("low"), F.max("p").alias("high")).join(bounded(fewest), "item")
    several = materialise(spans.where("fewest = 1 OR low < high").select("row", "item", "place"), "several")
    kept = placed.join(bounded(several), ["row", "item", "place"], "left_semi")
    met = kept.join(bounded(seeds.select("item", "start", "p", "k")), ["item", "p"])
    key = ["row", "item", "place", "start", "k"]
    lists = met.groupBy(*key, "p").agg(F.collect_set("delta").alias("at")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("p", "at"))).alias("lists")).where(F.size("lists") == F.col("k"))

    def step(chains: Column, term: Column) -> Column:
        fits = lambda d: F.exists(chains, lambda c: (d >= c["delta"]) & (d - c["delta"] <= slack * (term["p"] - c["p"])))
        return F.transform(F.filter(term["at"], fits), lambda d: F.struct(term["p"].alias("p"), d.alias("delta")))

    head = F.get("lists", F.lit(0))
    first = F.transform(head["at"], lambda d: F.struct(head["p"].alias("p"), d.alias("delta")))
    chained_ = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), first, step)
    return lists.where(F.size(chained_) > 0).select("row", "item", "place", "start").distinct()


def chained(narrow: DataFrame, terms: DataFrame, places: DataFrame, window: int, slack: int) -> DataFrame:
    """(row, item_id, start, stop): for each word that a chain begins with, the shortest chain. All postings of a place go into its chains; a place holds a bounded number of them."""
    reach = drift(window, slack)
    slots = terms.select("item", "item_id", "n", "p", "tid")
    wanted = places.join(bounded(slots), "item").where((F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + window))
    delta = F.col("pos") - F.col("p")
    met = wanted.join(narrow, ["row", "tid"]).where((delta >= F.col("place") * reach) & (delta < (F.col("place") + 2) * reach))
    key = ["row", "item", "item_id", "n", "place", "start"]
    lists = met.groupBy(*key, "p").agg(F.collect_list("pos").alias("at")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("p", "at"))).alias("lists"))
    lists = lists.where(F.size("lists") == F.least(F.lit(window), "n"))

    def step(chains: Column, word: Column) -> Column:
        after = lambda pos: F.filter(chains, lambda c: (pos > c["stop"]) & (pos <= c["stop"] + 1 + slack))
        longer = F.transform(word["at"], lambda pos: F.transform(after(pos), lambda c: F.struct(c["from"].alias("from"), pos.alias("stop"))))
        return F.array_distinct(F.flatten(longer))

    first = F.transform(F.get("lists", F.lit(0))["at"], lambda pos: F.struct(pos.alias("from"), pos.alias("stop")))
    chains = lists.select("row", "item_id", F.explode(F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), first, step)).alias("c"), "item", F.col("start").alias("w"))
    return chains.groupBy("row", "item_id", "item", "w", F.col("c.from").alias("start")).agg((F.min("c.stop") + 1).alias("stop")).select("row", "item_id", "start", "stop").distinct()


def proximity(index: DataFrame, terms: DataFrame, slack: int = SLACK, window: int = WINDOW) -> DataFrame:
    """(row, item_id, start, stop): all places where the words of a window of an item (of a shorter item all its words) occur in their order with at most ``slack`` words between neighbours; for each first word the shortest."""
    sizes = list_sizes(index)
    seeds = rarest(terms, sizes, window)
    places = materialise(near_places(seed_hits(index, sizes, seeds), seeds, window, slack), "places")
    return chained(postings_of(index, sizes, terms, places), terms, places, window, slack)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", window: int = WINDOW, share: int = SHARE, slack: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``slack`` also n_near, the items that have a proximity match of a window (an exact one is one).

    Hit words lie in an occurrence of a window: ``window`` consecutive words of an item, or all words of a shorter one. A
    row is contaminated if it has hit words and they are at least one in ``share``. Null texts have no words. Repeated
    rows and null ids are rows like others; an item with a null id hits words but is not counted, as it has no name; an empty table of either kind gives no hits or no rows.
    """
    terms = item_terms(items, text, item_id)
    index = build_index(docs, terms, text, id_col)
    sizes = list_sizes(index)
    seeds = rarest(terms, sizes, window)
    hits = seed_hits(index, sizes, seeds)
    found = materialise(meeting(hits, seeds), "diagonals")
    places = found if slack is None else materialise(near_places(hits, seeds, window, slack), "places")
    narrow = postings_of(index, sizes, terms, places)
    runs = materialise(phrase_runs(matches(narrow, terms, found), terms, window), "runs")
    hit = runs.select("row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    name = F.col("item_id").cast("string")
    names = runs.where("item_id IS NOT NULL").select("row", name.alias("name")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("name")).alias("names"))
    out = hit.join(names, "row", "left")
    if slack is not None:
        out = out.join(chained(narrow, terms, places, window, slack).where("item_id IS NOT NULL").groupBy("row").agg(F.count_distinct(name).alias("n_near")), "row", "full")
    hits = materialise(out, "hits")
    rows = index.where(F.col("tid") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    n_hit = zero("n_hit")
    return rows.join(bounded(hits), "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), zero("n_items").alias("n_items"), list_sha256(F.coalesce("names", F.array().cast("array<string>"))).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), *([] if slack is None else [zero("n_near").alias("n_near")]),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """docs without the documents that are contaminated; an id goes if any of its rows is, rows without an id by their own. Null and empty texts stay, no items take nothing, an empty table stays empty; columns stay as they are."""
    gone = contamination(docs, items, text, id_col, item_id).where("contaminated").select(F.col("doc_id").alias(id_col)).distinct()
    return discard(docs, materialise(gone, "contaminated"), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slack=SLACK)


SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, list_slice(ws, s, s + least(len(ws), 13) - 1) AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS s FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, s, list_slice(ws, s, s + n - 1) AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM dw, sizes WHERE len(ws) >= n)),
occ AS (SELECT doc_id, s, dwin.n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM dw),
step AS (SELECT item_id, w, n, row_number() OVER (ORDER BY item_id, w) AS wid FROM win),
chain(wid, k, doc_id, pos) AS (SELECT wid, 1, doc_id, pos FROM step JOIN dp ON dp.w = step.w[1]
  UNION SELECT c.wid, c.k + 1, c.doc_id, dp.pos FROM chain c JOIN step USING (wid) JOIN dp ON dp.doc_id = c.doc_id AND dp.w = step.w[c.k + 1] AND dp.pos > c.pos AND dp.pos <= c.pos + 3 WHERE c.k < n),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM chain JOIN step USING (wid) WHERE k = n GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""
