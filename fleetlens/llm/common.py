"""Helpers the corpus operators share: shared scratch tables, ranges, running sums and ranks.

A row's *range* is found from quantiles of the ordering column, so that no ordered
computation ever needs all rows in one task: windows run inside a range (or inside a salt
of a group) and a table with one row per range carries what came before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A null id counts as this one wherever documents are ordered or joined by id.
NULL_ID = -(2**63)
#: Rows that Spark and Python exchange at once while a table is written: rows hold texts and arrays, and two batches a task lie in memory outside the heap.
BATCH_ROWS, _BATCH = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: spark.checkpoint.dir, or one of our own where that is unset and Spark runs in one process (tests); an error on a cluster without one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str = "table", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. batch_rows: rows that go to Python and back at once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(rows), batch_rows)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_splits(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most parts - 1 ascending integers that cut col into ranges of about equal counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(col, at, max(10_000, 10 * parts)).alias("s")).head()["s"]
    return sorted(set(got or []))


def range_bucket(col: Column, splits: list[int]) -> Column:
    """How many of the splits are at most col, by binary descent; null goes to range 0."""
    if not splits:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")
    steps = [1 << b for b in range(len(splits).bit_length() - 1, -1, -1)]
    fits = lambda at: (at <= len(splits)) & (F.get(cuts, at - 1) <= col)
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def running_start(df: DataFrame, order: str, size: str, out: str, parts: int | None = None) -> DataFrame:
    """df with out = the sum of size over all rows before it in ascending order of `order` (an integer column).

    Rows with equal order values follow one another in any order. Holds on to nothing larger
    than one range; the table of range totals has `parts` rows. df is read three times.
    """
    parts = parts or shuffle_partitions(df.sparkSession)
    held = df.withColumn("__r", range_bucket(F.col(order), range_splits(df, order, parts)))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("__r").agg(F.sum(size).alias("__n")).select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("__local", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return local.join(F.broadcast(totals), "__r").withColumn(out, F.col("__base") + F.col("__local")).drop("__r", "__base", "__local")


def rank_within(df: DataFrame, keys: list[str], by: list[str], out: str, salts: int | None = None, salt: Column | None = None) -> DataFrame:
    """df with out = a gapless rank from 0 within each combination of keys.

    Each group is split into `salts` parts (as many as there are shuffle partitions) by a hash of
    the `by` columns or by salt, ranked inside the part and shifted by the sizes of the parts
    before it, so a group that holds a third of all rows spreads over all tasks. The table of
    part sizes has (groups x salts) rows and is joined by shuffle unless Spark sees it is small.
    """
    salts = salts or shuffle_partitions(df.sparkSession)
    salted = df.withColumn("__s", F.pmod(F.xxhash64(*by) if salt is None else salt, F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    ranked = salted.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*by)))
    same = [ranked[k].eqNullSafe(bases[k]) for k in keys] + [ranked["__s"] == bases["__s"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return ranked.join(bases, on).select(*[ranked[c] for c in df.columns], (F.col("__base") + F.col("__k") - 1).alias(out))


def told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs + __row, a number of its own for each row that ascends with doc_id, and whether ids repeat.

    Unique ids are these numbers themselves, a null one as NULL_ID. Where ids repeat, rows are counted
    from 0 in ascending order of doc_id (null first), those with equal ids in the order in which
    they are read; the counting moves numbers only, and a frequent id is spread over all tasks.
    """
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    if docs.groupBy(own.alias("__id")).count().where("count > 1").isEmpty():
        return docs.withColumn("__row", own), False
    held = stash(docs.withColumn("__read", F.monotonically_increasing_id()), "rows")
    keys = held.select(own.alias("__id"), "__read")
    counts = stash(keys.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")), "counts")
    before = running_start(counts, "__id", "__n", "__before").select("__id", "__before")
    numbers = rank_within(keys, ["__id"], ["__read"], "__k").join(before, "__id").select("__read", (F.col("__before") + F.col("__k")).alias("__row"))
    return stash(held.join(numbers, "__read").select(*docs.columns, "__row"), "rows"), True


def map_texts(docs: DataFrame, carried: list[str], fields: list[tuple[str, pa.DataType, str]], setup: Callable[[], Callable[[list], list[tuple]]]) -> DataFrame:
    """The carried columns of docs as they are + fields (name, Arrow type, SQL type), one row for each row of docs.

    setup() runs once a task and returns the function from texts (strings or None) to rows of fields.
    """
    names = [*carried, *(f[0] for f in fields)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema), *(f"{n} {t}" for n, _, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = zip(*work(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *(pa.array(c, kind) for c, (_, kind, _) in zip(made, fields, strict=True))], names=names)
            give_back()

    return docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(run, schema)


def text_verdict(setup: Callable[[], Callable[[list], list[bool]]]) -> Callable[[Column], Column]:
    """A function from a text column to a boolean one. setup() runs once a task and returns the function from texts (strings or None) to verdicts.

    Only text goes to Python and only verdicts come back; the other columns stay where they are.
    """

    @F.arrow_udf("boolean")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = setup()
        for texts in batches:
            made: list[bool] = []
            for i in range(0, len(texts), 500):
                made.extend(work(texts.slice(i, 500).to_pylist()))
            yield pa.array(made, pa.bool_())
            give_back()

    return verdict


def give_back() -> None:
    """Hand memory that Arrow has freed back to the system: a worker lives on between tasks, and what it keeps adds to its executor's share."""
    pa.default_memory_pool().release_unused()


def words_pattern() -> str:
    """A word is a run of characters other than ASCII white space."""
    return r"[^\x20\x09-\x0D]+"
