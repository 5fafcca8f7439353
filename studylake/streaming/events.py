"""Folds of run events in batch; ``runs`` is the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "run_id string, seq bigint, type string, delta string, citation struct<title:string,url:string>, tool_index bigint, tool_name string, tool_input string, input_tokens bigint, output_tokens bigint, finish_reason string, ts timestamp_ntz"


def fold(events: DataFrame, key: str = "run_id") -> DataFrame:
    """One row a run: the answer, time of its first text, last usage, citations, and how it ended (AGG-15)."""
    text = F.col("type") == "text_delta"
    usage = F.struct("input_tokens", "output_tokens")
    used = (F.col("type") == "usage") | F.col("input_tokens").isNotNull()
    deltas = F.array_sort(F.collect_list(F.when(text, F.struct("seq", "delta"))))
    cited = F.array_sort(F.collect_list(F.when(F.col("type") == "citation", F.struct("seq", "citation"))))
    return events.groupBy(key).agg(
        F.array_join(F.transform(deltas, lambda d: d["delta"]), "").alias("answer"),
        F.min(F.when(text, F.col("ts"))).alias("first_text_at"),
        F.max_by(F.when(used, usage), F.when(used, F.col("seq"))).alias("usage"),
        F.array_distinct(F.transform(cited, lambda c: c["citation"])).alias("citations"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"),
        F.count("*").alias("n_events"),
    )


def tool_calls(events: DataFrame, key: str = "run_id") -> DataFrame:
    """``(key, tool_index, tool_name, arguments)``: a call's chunks put together in order (AGG-16)."""
    calls = events.where("type = 'tool_call'")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("tool_input", F.lit("")).alias("part"))))
    return calls.groupBy(key, "tool_index").agg(F.max("tool_name").alias("tool_name"), F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("arguments"))
