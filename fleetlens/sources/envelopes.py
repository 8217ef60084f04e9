"""Hook envelopes and transcripts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clean_prompt, flatten_content

ENVELOPE = "agent string, cwd string, received_at string, payload string"


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(agent, cwd, received_at, payload) from JSON lines; records that can't be parsed are dropped."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(ENVELOPE + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record is null and payload is not null").drop("_corrupt_record")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines of JSONL transcripts that are JSON, numbered in order of their file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    numbered = text.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    return numbered.where(F.try_parse_json("line").isNotNull()).select("file", "n", "line")


def message_usage(lines: DataFrame) -> DataFrame:
    """(file, message_id, input_tokens, output_tokens): the first copy of each message's usage."""
    j = lambda p: F.get_json_object("line", p)
    found = lines.select("file", "n", j("$.message.id").alias("message_id"), j("$.message.usage.input_tokens").cast("long").alias("input_tokens"), j("$.message.usage.output_tokens").cast("long").alias("output_tokens")).where("message_id is not null and output_tokens is not null")
    first = F.row_number().over(Window.partitionBy("file", "message_id").orderBy("n"))
    return found.withColumn("r", first).where("r = 1").drop("r", "n")


def cumulative_usage(lines: DataFrame) -> DataFrame:
    """(file, n, output_tokens): what each cumulative report adds; reports that don't grow are skipped."""
    total = F.get_json_object("line", "$.payload.info.total_token_usage.output_tokens").cast("long")
    found = lines.select("file", "n", total.alias("total")).where("total is not null")
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    grown = found.withColumn("output_tokens", F.col("total") - F.coalesce(F.max("total").over(order), F.lit(0)))
    return grown.where("output_tokens > 0").select("file", "n", "output_tokens")


def transcript_summary(lines: DataFrame) -> DataFrame:
    """(file, model, first_ts, last_ts, assistant_messages, input_tokens, output_tokens): the majority model; of a message's copies the last counts."""
    j = lambda p: F.get_json_object("line", p)
    rows = lines.select("file", "n", j("$.type").alias("type"), F.try_to_timestamp(j("$.timestamp")).alias("ts"), j("$.message.model").alias("model"), F.coalesce(j("$.message.id"), F.col("n").cast("string")).alias("mid"), j("$.message.usage.input_tokens").cast("long").alias("i"), j("$.message.usage.output_tokens").cast("long").alias("o"))
    times = rows.groupBy("file").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    last = rows.where("type = 'assistant'").groupBy("file", "mid").agg(F.max_by(F.struct("model", "i", "o"), "n").alias("m")).select("file", "m.*")
    sums = last.groupBy("file").agg(F.count(F.lit(1)).alias("assistant_messages"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
    votes = last.where("model is not null").groupBy("file", "model").agg(F.count(F.lit(1)).alias("k")).groupBy("file").agg(F.min_by("model", F.struct(-F.col("k"), "model")).alias("model"))
    return times.join(sums, "file", "left").join(votes, "file", "left").select("file", "model", "first_ts", "last_ts", F.coalesce("assistant_messages", F.lit(0)).alias("assistant_messages"), "input_tokens", "output_tokens")


def transcript_prompts(lines: DataFrame) -> DataFrame:
    """(file, seq, prompt_text): user prompts, numbered from 1; meta and side-chain lines are skipped, and a prompt without text keeps its number but is left out."""
    j = lambda p: F.get_json_object("line", p)
    asked = lines.where((j("$.type") == "user") & (F.coalesce(j("$.isMeta"), F.lit("false")) != "true") & (F.coalesce(j("$.isSidechain"), F.lit("false")) != "true"))
    numbered = asked.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("n")))
    return numbered.select("file", "seq", clean_prompt(flatten_content(j("$.message.content"))).alias("prompt_text")).where("prompt_text is not null")
