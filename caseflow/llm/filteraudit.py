"""What each of five text filters removes, in every order of applying them.

The documents are a stream: all files are taken as available-now micro-batches. Four of
the filters look at one text. The fifth fails a text that a smaller doc_id has too, so
it may turn out long after a document was read. The state, keyed by the text, holds the
smallest doc_id so far and whose it is. When a micro-batch brings a smaller one, the
rows counted as first are retracted from their counters and counted again as copies.
Every micro-batch leaves its changes of the counters, (part, filters failed, labels) ->
count; their sum is all that the report over the 120 orders needs.

State and counters are tables in the shared checkpoint folder, to which a micro-batch
adds a part under its own number; one that is run again replaces its part and reads the
parts before it alone. The state is met by joins on the text's digest. A text that a
third of the rows share moves as one row per (part, labels) and doc_id, dealt out by all
of these; only its smallest doc_id is brought together, combined before it is shuffled.
(The engine's own state with a function called per text did the same at eleven times the
CPU, some milliseconds a text.)
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import only
from caseflow.sources.scratch import scratch_dir, stage

FILTERS = "ABCDE"
BIT = {name: 1 << n for n, name in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BATCHES = 4  # micro-batches that the files are dealt to, if there are so many

FEW_WORDS, FEW_DISTINCT, CAPITALS = 200, 50, 2  # words; per cent of words; per cent of characters
SIGNS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"

STATE = "text_key binary, failed int, part string, good boolean, toxic boolean, doc_id long, n long"
COUNTERS = "part string, failed int, good boolean, toxic boolean, n long"


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.array_remove(F.split(text, BLANKS), "")
    few = F.size(words) < FEW_WORDS
    repeated = 100 * F.size(F.array_distinct(words)) < FEW_DISTINCT * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITALS * F.char_length(text).cast("long")
    tests = {"A": few, "B": repeated, "C": loud, "D": text.rlike(SIGNS)}
    return sum((test.cast("int") * BIT[name] for name, test in tests.items()), F.lit(0))


def changes(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes of the counters that a micro-batch makes, and what it adds to the state.

    ``rows`` and ``state`` have the columns of STATE; n rows are alike. A row of the state
    is first of its text if no doc_id of that text in the state is smaller.
    """
    known = rows.where("doc_id IS NOT NULL")
    smallest = known.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    held = state.groupBy("text_key").agg(F.min("doc_id").alias("held"))
    moved = stage(smallest.join(held, "text_key", "left").where("held IS NULL OR doc_id <= held"))
    first = known.join(moved.drop("held"), ["text_key", "doc_id"], "left_semi")
    retracted = state.join(moved.where("doc_id < held").select("text_key", F.col("held").alias("doc_id")), ["text_key", "doc_id"], "left_semi")

    def counted(of: DataFrame, copy: Column | bool, sign: int) -> DataFrame:
        bit = F.when(F.lit(copy) if isinstance(copy, bool) else copy, BIT["E"]).otherwise(0)
        return of.select("part", F.col("failed").bitwiseOR(bit).alias("failed"), "good", "toxic", (F.col("n") * sign).alias("n"))

    # every row counts as a copy, unless no id is smaller or larger than its own; the first ones do not
    all_rows = counted(rows, F.col("doc_id").isNotNull(), 1)
    kept = counted(first, False, 1).union(counted(first, True, -1))
    lost = counted(retracted, False, -1).union(counted(retracted, True, 1))
    return all_rows.union(kept).union(lost), first


def counters(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): how many documents of each part fail which filters.

    ``stream`` is a streaming DataFrame with doc_id, text and source; it is read to the
    end of what is available now. ``labels`` has doc_id, quality and toxic; of several
    rows for one doc_id any 1 counts.
    """
    spark = stream.sparkSession
    folder = scratch_dir(spark)
    text = F.coalesce("text", F.lit(""))
    slim = only(stream, "doc_id", "text", "source").select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"),
        failures(text).alias("failed"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        # rows without doc_id have no label; they need not meet in one task to learn it
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("spread"),
    )
    marked = only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked.agg(*(F.max(F.col(c).eqNullSafe(1)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic")))).write.parquet(f"{folder}/labels")
    for name, schema in (("state", STATE), ("counters", COUNTERS)):  # tables without files give no micro-batch
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}/batch=-1")

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        labelled = session.read.parquet(f"{folder}/labels").withColumn("spread", F.lit(0).cast("long"))
        marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
        rows = batch.join(labelled, ["doc_id", "spread"], "left").select("text_key", "failed", "part", *marks, "doc_id")
        rows = stage(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
        state = session.read.schema(f"{STATE}, batch int").parquet(f"{folder}/state").where(F.col("batch") < number).drop("batch")
        made, first = changes(rows, state)
        for name, table in (("counters", added(made)), ("state", first.select(state.columns))):
            table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    query = slim.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return added(spark.read.schema(COUNTERS).parquet(f"{folder}/counters"))


def added(changed: DataFrame) -> DataFrame:
    return changed.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def report(counted: DataFrame) -> DataFrame:
    """What every filter removes in every order, per part, from ``counters``."""
    fails = {name: F.col("failed").bitwiseAND(BIT[name]) != 0 for name in FILTERS}
    place = {name: F.instr("filter_order", name) for name in FILTERS}
    by_step = (
        counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
        # the step that removes the document; 6 for those that pass all
        .withColumn("first", F.least(*(F.when(fails[name], place[name]).otherwise(len(FILTERS) + 1) for name in FILTERS)))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("bit", sum((F.when(place[name] == F.col("step"), BIT[name]).otherwise(0) for name in FILTERS), F.lit(0)))
    )
    n, here = F.col("n"), F.col("first") == F.col("step")
    fails_this = F.col("failed").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    return by_step.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(fails_this & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
        # a filter is the first of k failed ones in every k-th order
        total(fails_this, n * (len(ORDERS) / F.bit_count("failed")).cast("long")).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """The report on the Parquet files at ``path``: (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley).

    A null text counts as empty, a null source as the empty part. A row without doc_id
    fails none as a copy and makes none one; rows of one doc_id are not copies of each
    other, and all of them are documents. Further columns of either table are ignored.
    Tables without rows give no rows. The files are dealt to about ``batches``
    micro-batches, whatever their number.
    """
    table = spark.read.parquet(path)
    files = -(-max(1, len(table.inputFiles())) // batches)
    folder, _, name = path.rstrip("/").rpartition("/")
    # as a pattern, the path may be one file as well as a folder of files
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{{{name}}}")
    return report(counters(stream, labels))
