"""Runs folded while they stream: chunks of bytes to frames, events to answers, in state that outlives a micro-batch.

Two stateful steps, each keyed by run: ``frames`` keeps what is left of a stream after its last complete frame, and chunks that
came before their turn; ``answers`` keeps the text so far, the last usage, citations and tool calls. Between them the payloads
are decoded by expressions. A run cut over any number of batches, with chunks in any order and some sent twice, gives what
``events.fold`` makes of the whole run, also when the query stops and starts again from its checkpoint.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources import sse

#: State of runs lives in RocksDB, on disk and not in the executors' heap.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Timers by the clock would make a query over all that is there now run batches without data for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
FRAME = "run_id string, protocol string, seq long, data string, ts timestamp"
ANSWER = (
    "run_id string, answer string, first_text_at timestamp, input_tokens long, output_tokens long, citations array<struct<title:string,url:string>>, "
    "tools array<struct<tool_index:bigint,tool_name:string,arguments:string>>, finish_reason string, n_events long"
)
IDLE_MS = 3_600_000


def _known(value):
    return None if value is None or value != value else value


def frames(chunks: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """``FRAME`` rows of streamed chunks (run_id, protocol, seq from 0, body, ts), in order; SRC-10.

    A run's state is what follows its last complete frame, and chunks that came early; it goes after ``idle_ms`` of silence.
    """

    def run(key, rows, state):
        if state.hasTimedOut:
            state.remove()
            return
        ready, number, tail, early = state.get if state.exists else (0, 0, "", "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        out = []
        for frame in rows:
            for seq, protocol, body, ts in zip(frame["seq"], frame["protocol"], frame["body"], frame["ts"]):
                if seq >= ready:
                    waiting.setdefault(int(seq), [protocol, body or "", ts.isoformat()])
        while ready in waiting:
            protocol, body, ts = waiting.pop(ready)
            ready += 1
            # A frame ends with a blank line, which may be cut anywhere itself.
            *whole, tail = re.split(r"\r?\n\r?\n", tail + body)
            for found in whole:
                data = "\n".join(re.findall(r"(?m)^data: ?(.*?)\r?$", found))
                if data:
                    out.append((key[0], protocol, number, data, pd.Timestamp(ts)))
                    number += 1
        state.update((ready, number, tail, json.dumps(waiting)))
        state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "protocol", "seq", "data", "ts"])

    kept = chunks.select("run_id", "protocol", F.col("seq").cast("long").alias("seq"), "body", F.col("ts").cast("timestamp").alias("ts"))
    return kept.groupBy("run_id").applyInPandasWithState(run, FRAME, "ready long, number long, tail string, early string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def answers(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """``ANSWER`` rows of streamed events in order; AGG-15, AGG-16.

    A run gives its answer when it has ended, and another with more ``n_events`` if it goes on; a run that is silent for
    ``idle_ms`` gives what it has said, and its state goes.
    """

    def fold(held: dict, e) -> None:
        held["n_events"] += 1
        if e.type == "text_delta":
            held["answer"] += e.delta
            held["first_text_at"] = held["first_text_at"] or e.ts.isoformat()
        if e.type == "citation" and [e.title, e.url] not in held["citations"]:
            held["citations"].append([e.title, e.url])
        if e.type == "usage" or _known(e.input_tokens) is not None:
            held["usage"] = [int(v) if _known(v) is not None else None for v in (e.input_tokens, e.output_tokens)]
        if e.type == "tool_call":
            call = held["tools"].setdefault(str(int(_known(e.tool_index) or 0)), [None, ""])
            call[:] = [call[0] or e.tool_name, call[1] + (e.tool_input or "")]
        held["finish_reason"] = _known(e.finish_reason) or held["finish_reason"]

    def row(key, held: dict) -> pd.DataFrame:
        tools = sorted((int(i), *call) for i, call in held["tools"].items())
        out = pd.DataFrame([{
            "run_id": key[0], "answer": held["answer"], "first_text_at": held["first_text_at"], "input_tokens": held["usage"][0], "output_tokens": held["usage"][1],
            "citations": [{"title": t, "url": u} for t, u in held["citations"]], "tools": [{"tool_index": i, "tool_name": t, "arguments": a} for i, t, a in tools],
            "finish_reason": held["finish_reason"], "n_events": held["n_events"],
        }])
        out["first_text_at"] = pd.to_datetime(out["first_text_at"])
        return out.astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    def run(key, rows, state):
        empty = {"answer": "", "first_text_at": None, "usage": [None, None], "citations": [], "tools": {}, "finish_reason": None, "n_events": 0}
        held = json.loads(state.get[0]) if state.exists else empty
        if state.hasTimedOut:
            state.remove()
            if held["finish_reason"] is None:
                yield row(key, held)
            return
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            fold(held, e)
        state.update((json.dumps(held),))
        state.setTimeoutDuration(idle_ms)
        if held["finish_reason"] is not None:
            yield row(key, held)

    flat = events.select("run_id", "seq", "type", "delta", "citation.title", "citation.url", "tool_index", "tool_name", "tool_input", "input_tokens", "output_tokens", "finish_reason", F.col("ts").cast("timestamp").alias("ts"))
    return flat.groupBy("run_id").applyInPandasWithState(run, ANSWER, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(chunks: DataFrame, path: str, checkpoint: str, idle_ms: int = IDLE_MS, **trigger):
    """Start the steps from chunks to answers: two queries, each with a file sink that takes every batch exactly once.

    Returns the queries. The first writes the decoded events under ``path``/events, which the second streams from; ``read``
    gives the newest answer of each run.
    """
    spark = chunks.sparkSession
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    trigger = trigger or {"availableNow": True}
    events = sse.decoded(frames(chunks, idle_ms)).withColumn("tool_index", F.lit(0).cast("long"))

    def write(df: DataFrame, name: str):
        return df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(**trigger).start()

    first = write(events, "events")
    if "availableNow" in trigger:
        first.awaitTermination()
    again = spark.readStream.schema(events.schema).parquet(f"{path}/events")
    return first, write(answers(again, idle_ms), "answers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest answer of each run so far."""
    rows = spark.read.parquet(f"{path}/answers")
    rest = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), "n_events").alias("a")).select("run_id", "a.*")
