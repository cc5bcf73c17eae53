"""Benchmark analytics over agent runs: log parsing, schedules, percentiles, correctness and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def percentile(values, p: float):
    """Nearest rank with round(p (n - 1)), half to even, of an array of numbers."""
    return F.element_at(F.sort_array(values), (F.bround(F.lit(p) * (F.size(values) - 1), 0) + 1).cast("int"))


def latency_percentiles(runs: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, p95) of a column for each group."""
    g = runs.groupBy(by).agg(F.collect_list(value).alias("v"))
    return g.select(by, F.size("v").cast("long").alias("n"), F.expr("aggregate(slice(array_sort(v), (size(v) + 1) div 2, 2 - size(v) % 2), cast(0 as double), (a, x) -> a + x) / (2 - size(v) % 2)").alias("median"), percentile(F.col("v"), 0.95).alias("p95"))


def schedule(spark: SparkSession, tasks: list[str], arms: list[str], repeats: int, seed: int) -> DataFrame:
    """(place, task, arm, repeat): every combination, shuffled by a hash of the seed."""
    t = spark.createDataFrame([(x,) for x in tasks], "task string").crossJoin(spark.createDataFrame([(x,) for x in arms], "arm string")).crossJoin(spark.range(repeats).select(F.col("id").cast("int").alias("repeat")))
    from pyspark.sql import Window as W

    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "task", "arm", F.col("repeat").cast("string")), 256)
    return t.withColumn("place", F.row_number().over(W.orderBy(key)))


def parse_logs(lines: DataFrame) -> DataFrame:
    """lines(run_id, value) of JSON events as (run_id, answer, input_tokens, output_tokens, tool_calls): the last agent message and the sums of usage; lines that aren't JSON are passed over."""
    e = lines.select("run_id", F.col("line_no"), F.from_json("value", "type string, item struct<type:string,text:string>, usage struct<input_tokens:long,output_tokens:long>").alias("e"))
    message = F.when(F.col("e.item.type") == "agent_message", F.col("e.item.text"))
    tool = F.coalesce(F.col("e.type").isin("item.completed") & F.col("e.item.type").isin("command_execution", "mcp_tool_call"), F.lit(False))
    return e.groupBy("run_id").agg(F.max_by(message, F.when(message.isNotNull(), F.col("line_no"))).alias("answer"), F.coalesce(F.sum("e.usage.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("e.usage.output_tokens"), F.lit(0)).alias("output_tokens"), F.sum(tool.cast("int")).alias("tool_calls"))


def validate_answers(runs: DataFrame) -> DataFrame:
    """Adds correct: every one of required (array) is in answer, and none of forbidden."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    return runs.withColumn("correct", F.forall("required", lambda x: F.contains(low, F.lower(x))) & ~F.exists("forbidden", lambda x: F.contains(low, F.lower(x))))


def summarize(runs: DataFrame) -> DataFrame:
    """One row over runs(task, arm, tokens, correct) of the arms baseline and treatment: medians summed over tasks, reduction, tasks improved, rates of correctness and the verdict."""
    m = runs.groupBy("task").pivot("arm", ["baseline", "treatment"]).agg(F.median("tokens").alias("t"), F.avg(F.col("correct").cast("double")).alias("c"))
    s = m.agg(F.sum("baseline_t").alias("baseline"), F.sum("treatment_t").alias("treatment"), F.count_if(F.col("treatment_t") < F.col("baseline_t")).alias("improved"), F.avg("baseline_c").alias("rate_baseline"), F.avg("treatment_c").alias("rate_treatment"))
    s = s.withColumn("reduction", F.when(F.col("baseline") > 0, 1 - F.col("treatment") / F.col("baseline")).otherwise(0.0))
    shown = (F.col("reduction") > 0) & (F.col("improved") >= 4) & (F.col("rate_treatment") >= F.col("rate_baseline"))
    return s.withColumn("verdict", F.when(shown & (F.col("reduction") >= 0.25) & (F.col("improved") >= 5), "ahorro_fuerte").when(shown, "ahorro_demostrado").otherwise("inconcluso"))
