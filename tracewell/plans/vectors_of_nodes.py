"""Queries over vectors of labels. Bucket vectors are hashes here, where SQL has to follow; ``subword_node_vectors`` trains them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import summaries, vectors, wordvecs
from tracewell.operators.storage import written
from tracewell.plans.catalogue import TYPES, WITH, query
from tracewell.plans.edges import KINDS, typed_edges
from tracewell.sources import adapters as a

DIMS, SIZE = 4, 5000


def label_words(spark, d):
    return a.nodes(a.prov(spark, d)).select(F.col("node_id").alias("node"), text.path_tokens(F.col("label")).alias("words"))


def drawn(name: str, dims: int = DIMS):
    """A vector of numbers about as large as 1 that a name decides."""
    return F.array(*((wordvecs.bucket(F.concat(F.col(name).cast("string"), F.lit(f":{j}")), 2001) - 1000) / 997.0 for j in range(dims)))


def bucket_table(words):
    every = words.select(F.explode("words").alias("word")).distinct().select(F.explode(wordvecs.subwords(F.col("word"), buckets=SIZE)).alias("bucket")).distinct()
    return every.select("bucket", drawn("bucket").alias("vec"))


HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
TOKENS = a.PROV + ",\n" + a.NODES + r""", docs AS MATERIALIZED (SELECT node_id AS node, list_filter(regexp_split_to_array(replace(regexp_replace(label, '\\+', '/', 'g'), '/', ' / '), '[ \t\r\n]+'), lambda x: x <> '') AS words FROM nodes), tok AS MATERIALIZED (SELECT node, word, i - 1 AS i, len(words) AS n FROM (SELECT node, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs))"""
GRAMS = TOKENS + f""", w AS (SELECT DISTINCT word, '<' || word || '>' AS m FROM tok), gr AS (SELECT word, substr(m, i, n) AS g FROM w, range(3, 7) r(n), range(1, 40) s(i) WHERE i + n - 1 <= length(m) UNION SELECT word, m FROM w),
sub AS MATERIALIZED (SELECT DISTINCT word, {HASH.format("g")} % {SIZE} AS bucket FROM gr),
wv AS MATERIALIZED (SELECT word, {", ".join(f"avg(({HASH.format(f"bucket || ':{j}'")} % 2001 - 1000) / 997.0::DOUBLE) AS x{j}" for j in range(DIMS))} FROM sub GROUP BY word)"""


@query(WITH + GRAMS + " SELECT word, bucket FROM sub")
def subword_buckets(spark, d):
    words = label_words(spark, d).select(F.explode("words").alias("word")).distinct()
    return words.select("word", F.explode(wordvecs.subwords(F.col("word"), buckets=SIZE)).alias("bucket"))


def inferred(spark, d, weights):
    docs = written(label_words(spark, d), "documents")  # read several times; events once
    words = wordvecs.subword_vectors(docs.select(F.explode("words").alias("word")), bucket_table(docs), SIZE)
    total = docs.count()
    idf = docs.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.log(F.lit(float(total)) / F.count(F.lit(1))).alias("idf"))
    return wordvecs.text_vectors(docs, words, weights, idf)


def spread(rows, key):
    return rows.select(key, *(F.round(F.get("vec", F.lit(j)), 6).alias(f"x{j}") for j in range(DIMS)))


@query(WITH + GRAMS + f""", idf AS (SELECT word, ln((SELECT count(*) FROM docs)::DOUBLE / count(DISTINCT node)) AS idf FROM tok GROUP BY word)
SELECT node, {", ".join(f"round(sum(idf * x{j}) / nullif(sum(idf), 0), 6) AS x{j}" for j in range(DIMS))} FROM tok JOIN wv USING (word) JOIN idf USING (word) GROUP BY node""")
def idf_node_vectors(spark, d):
    return spread(inferred(spark, d, "idf"), "node")


POSITION = "(1.0::DOUBLE / n + 30.0::DOUBLE / (100.0 * n) * (n - 1) / 2 - i * 30.0::DOUBLE / (100.0 * n))"


@query(WITH + GRAMS + f" SELECT node, {', '.join(f'round(sum({POSITION} * x{j}) / sum({POSITION}), 6) AS x{j}' for j in range(DIMS))} FROM tok JOIN wv USING (word) GROUP BY node")
def positional_node_vectors(spark, d):
    return spread(inferred(spark, d, "position"), "node")


@query(WITH + GRAMS + f""", nv AS MATERIALIZED (SELECT node, [{", ".join(f"avg(x{j})" for j in range(DIMS))}] AS v FROM tok JOIN wv USING (word) GROUP BY node), kind AS (SELECT node_id AS node, CASE node_type WHEN 'subject' THEN 0 WHEN 'file' THEN 1 ELSE 2 END AS k FROM nodes),
msg AS (SELECT event_uuid, list_concat(list_transform(range(3), lambda z: CAST(z = ks.k AS DOUBLE)), s.v, list_transform(range(5), lambda z: CAST(z = list_position(['READ', 'OPEN', 'WRITE', 'CONNECT', 'RECVFROM'], op) - 1 AS DOUBLE)), list_transform(range(3), lambda z: CAST(z = kd.k AS DOUBLE)), t.v) AS m
  FROM prov JOIN nv s ON s.node = src JOIN nv t ON t.node = dst JOIN kind ks ON ks.node = src JOIN kind kd ON kd.node = dst)
SELECT event_uuid, CAST(len(m) AS INTEGER) AS width, round(list_sum(list_transform(m, lambda x, i: x * i)), 5) AS digest FROM msg""")
def edge_vectors_full(spark, d):
    nodes = written(inferred(spark, d, "mean"), "node-vectors")
    rows = typed_edges(spark, d).join(nodes.select(F.col("node").alias("src"), F.col("vec").alias("src_vec")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("vec").alias("dst_vec")), "dst")
    m = vectors.messages(rows, KINDS, TYPES, "src_vec", "dst_vec")
    return m.select("event_uuid", F.size("msg").alias("width"), F.round(F.aggregate(F.transform("msg", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("digest"))


@query(WITH + TOKENS + f""", known AS MATERIALIZED (SELECT word, {", ".join(f"({HASH.format(f"word || ':{j}'")} % 2001 - 1000) / 997.0::DOUBLE AS x{j}" for j in range(2))} FROM (SELECT DISTINCT word FROM tok)),
ctx AS MATERIALIZED (SELECT x.word, avg(k.x0) AS c0, avg(k.x1) AS c1 FROM tok x JOIN tok y ON y.node = x.node AND y.i <> x.i AND abs(y.i - x.i) <= 2 JOIN known k ON k.word = y.word GROUP BY x.word),
s AS (SELECT sum(c0 * c0) AS a, sum(c0 * c1) AS b, sum(c1 * c1) AS c, sum(c0 * x0) AS p0, sum(c1 * x0) AS q0, sum(c0 * x1) AS p1, sum(c1 * x1) AS q1 FROM ctx JOIN known USING (word))
SELECT 0 AS i, round((c * p0 - b * q0) / (a * c - b * b), 5) AS m0, round((a * q0 - b * p0) / (a * c - b * b), 5) AS m1 FROM s UNION ALL SELECT 1, round((c * p1 - b * q1) / (a * c - b * b), 5), round((a * q1 - b * p1) / (a * c - b * b), 5) FROM s""")
def induction_matrix(spark, d):
    docs = label_words(spark, d)
    words = docs.select(F.explode("words").alias("word")).distinct().select("word", drawn("word", 2).alias("vec"))
    m = wordvecs.induction_matrix(docs, words, reach=2)
    return spark.createDataFrame([(i, *(round(float(x), 5) for x in row)) for i, row in enumerate(m)], "i int, m0 double, m1 double")


@query()
def subword_node_vectors(spark, d):
    e = a.prov(spark, d)
    docs = written(summaries.corpus(e, a.nodes(e), text.path_tokens), "documents")
    table = wordvecs.subword_table(docs, dims=8, buckets=SIZE)
    words = wordvecs.subword_vectors(docs.select(F.explode("words").alias("word")), table, SIZE)
    return wordvecs.text_vectors(docs, words).select("node", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))
