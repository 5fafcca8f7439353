"""Server-sent events: framing of byte streams and normalising of their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames(body: Column) -> Column:
    """Data of each complete frame, its lines joined; what follows the last blank line is not complete (SRC-10)."""
    parts = F.split(body, r"\r?\n\r?\n", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    data = F.transform(whole, lambda f: F.array_join(F.regexp_extract_all(f, F.lit(r"(?m)^data:\x20?(.*?)\r?$"), F.lit(1)), "\n"))
    return F.filter(data, lambda d: d != "")


def tail(body: Column) -> Column:
    """What is left in the buffer after the complete frames."""
    return F.element_at(F.split(body, r"\r?\n\r?\n", -1), -1)


def bodies(chunks: DataFrame) -> DataFrame:
    """``(run_id, body)``: a run's chunks put together in order, so frames cut between chunks are whole."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "body")))
    return chunks.groupBy("run_id", "protocol").agg(F.array_join(F.transform(ordered, lambda c: c["body"]), "").alias("body"))


def events(chunks: DataFrame) -> DataFrame:
    """Normalised events of chunk rows ``(run_id, seq, protocol, body)``: text, usage, citations, tool calls, the end.

    Protocols: ``responses`` (typed events) and ``chat`` (choices with deltas, ended by [DONE]).
    """
    return decoded(bodies(chunks).select("run_id", "protocol", F.posexplode(frames(F.col("body"))).alias("seq", "data")))


def decoded(each: DataFrame) -> DataFrame:
    """Events of frame rows ``(run_id, protocol, seq, data)``, in batch or as a stream; a time ``ts`` is kept."""
    get = lambda path: F.get_json_object("data", f"$.{path}")
    chat = F.col("protocol") == "chat"
    done = F.col("data") == "[DONE]"
    kind = get("type")
    delta = F.when(chat, get("choices[0].delta.content")).when(kind == "response.output_text.delta", get("delta"))
    used_in = F.coalesce(get("response.usage.input_tokens"), get("usage.prompt_tokens")).cast("long")
    used_out = F.coalesce(get("response.usage.output_tokens"), get("usage.completion_tokens")).cast("long")
    tool = F.when(chat, get("choices[0].delta.tool_calls[0].function.name")).otherwise(get("item.name"))
    tool_input = F.when(chat, get("choices[0].delta.tool_calls[0].function.arguments")).otherwise(F.when(kind == "response.function_call_arguments.delta", get("delta")))
    finish = F.when(done, "stop").when(chat, get("choices[0].finish_reason")).when(kind == "response.completed", "completed").when(kind == "response.failed", "failed")
    url = F.coalesce(get("annotation.url"), get("choices[0].delta.annotations[0].url_citation.url"))
    title = F.coalesce(get("annotation.title"), get("choices[0].delta.annotations[0].url_citation.title"))
    type_ = (
        F.when(F.coalesce(delta, F.lit("")) != "", "text_delta")
        .when(tool.isNotNull() | tool_input.isNotNull(), "tool_call")
        .when(url.isNotNull(), "citation")
        .when(finish.isNotNull(), "completed")
        .when(used_in.isNotNull(), "usage")
        .otherwise("other")
    )
    return each.select(
        "run_id", F.col("seq").cast("long").alias("seq"), type_.alias("type"), delta.alias("delta"),
        F.when(url.isNotNull(), F.struct(title.alias("title"), url.alias("url"))).alias("citation"),
        tool.alias("tool_name"), tool_input.alias("tool_input"), used_in.alias("input_tokens"), used_out.alias("output_tokens"), finish.alias("finish_reason"),
        *(["ts"] if "ts" in each.columns else []),
    )


def catalogue(raw: Column) -> Column:
    """A provider's list of models with names and windows filled in (SRC-11)."""
    parsed = F.from_json(raw, "data array<struct<id:string,name:string,context_window:bigint,context_length:bigint>>")["data"]
    return F.transform(
        F.filter(parsed, lambda m: m["id"].isNotNull()),
        lambda m: F.struct(m["id"].alias("id"), F.coalesce(F.nullif(m["name"], F.lit("")), m["id"]).alias("label"), F.coalesce(m["context_window"], m["context_length"], F.lit(0)).alias("context_window")),
    )
