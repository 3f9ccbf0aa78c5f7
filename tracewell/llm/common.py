"""What the operators of this subpackage share: working tables, bounded broadcasts, text expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.storage import folder as shared_dir
from tracewell.operators.storage import new_path, written

materialise = written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: What a broadcast may hold: both bounds are checked against the table itself.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: A sieve has so many blocks of so many 64-bit words: 16 MB, whatever goes into it.
SIEVE_BLOCKS, SIEVE_WORDS = 4096, 512
ARROW_BYTES = 4 << 20


def to_python(df: DataFrame) -> DataFrame:
    """df, after asking the session for small Arrow batches: texts go to Python workers ARROW_BYTES at a time, so that neither side holds much more than one text. A
    smaller setting of the session's own stays. The setting is read when the plan runs, so it can't be taken back here."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = (conf.get(name, None) or "").rstrip("bB")
    if not own.isdigit() or not 0 < int(own) <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def frugal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, with an allocator that gives memory back to the system: an idle worker keeps nothing of the batches it has seen."""
    pa.set_memory_pool(pa.system_memory_pool())
    yield from batches


def clear_shared(spark: SparkSession) -> None:
    """Deletes the working tables of this session; call it once results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tracewell")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(16).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df, a written table, is within both bounds of a broadcast. Rows are counted from footers first; bytes are summed over the values only if there are few rows."""
    if df.count() > (BROADCAST_ROWS if rows is None else rows):
        return False
    size = F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long")))
    return (df.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it fits, else as it is (a shuffled join, whose hot keys the adaptive skew join splits)."""
    return F.broadcast(df) if fits(df, rows) else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does this for texts that are all ASCII, and quickly."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words between runs of ASCII characters that are no letters or digits; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def without_spaces(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def list_sha256(items: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def _place(*keys: Column) -> tuple[Column, Column, Column]:
    """Block, word and bit of a key in a sieve. Equal keys have equal places, null too."""
    h = F.xxhash64(F.lit("sieve"), *keys)
    return F.pmod(h, F.lit(SIEVE_BLOCKS)).cast("int"), F.pmod(F.shiftright(h, 16), F.lit(SIEVE_WORDS)).cast("int"), F.expr("shiftleft(1L, cast(pmod(shiftright(__h, 40), 64) as int))")


def sieve(keys: DataFrame) -> DataFrame:
    """A Bloom filter of bounded size over all columns of keys: a row of SIEVE_WORDS words for each of SIEVE_BLOCKS blocks."""
    h = F.xxhash64(F.lit("sieve"), *keys.columns)
    block, word, bit = _place(*map(F.col, keys.columns))
    own = keys.select(h.alias("__h"), block.alias("block"), word.alias("word")).select("block", "word", bit.alias("bits"))
    blank = keys.sparkSession.range(SIEVE_BLOCKS * SIEVE_WORDS).select((F.col("id") % SIEVE_BLOCKS).cast("int").alias("block"), F.expr(f"cast(id div {SIEVE_BLOCKS} as int)").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = own.unionByName(blank).groupBy("block", "word").agg(F.bit_or("bits").alias("bits")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return written(words.select("block", F.transform("words", lambda w: w["bits"]).alias("words")), "sieve")


def sifted(rows: DataFrame, keys: DataFrame, on: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key may be in keys (all that are, and a few others), and those whose key is not. Nothing is shuffled; rows is read once for each part."""
    block, word, bit = _place(*on)
    marked = rows.withColumn("__h", F.xxhash64(F.lit("sieve"), *on)).withColumn("__block", block).withColumn("__word", word).withColumn("__bit", bit)
    marked = marked.join(F.broadcast(sieve(keys)), F.col("__block") == F.col("block"))
    hit = F.get("words", F.col("__word")).bitwiseAND(F.col("__bit")) != 0
    return marked.where(hit).select(rows.columns), marked.where(~hit).select(rows.columns)


def discard(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", rows: int | None = None) -> DataFrame:
    """docs without the rows whose id is in ids (a written table of distinct ids; null ids count as equal).

    Few ids are broadcast. Where they are too many, a Bloom filter of bounded size is, and only the rows that it can't clear are shuffled with their texts.
    """
    gone = ids.select(F.col(id_col).alias("__gone"))
    same = F.col(id_col).eqNullSafe(F.col("__gone")) if not gone.where("__gone IS NULL").isEmpty() else F.col(id_col) == F.col("__gone")
    if fits(gone, rows):
        return docs.join(F.broadcast(gone), same, "left_anti")
    kind = docs.schema[id_col].dataType.simpleString()
    suspects, clear = sifted(docs, gone.select(F.col("__gone").cast(kind)), [F.col(id_col)])
    return clear.unionByName(suspects.join(gone, same, "left_anti"))
