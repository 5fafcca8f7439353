import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from studylake.sources import sse
from studylake.streaming import events as ev
from studylake.streaming import runs

CHUNK = "run_id string, protocol string, seq long, body string, ts timestamp"


def frame(**payload):
    return f"data: {json.dumps(payload)}\r\n\r\n"


def bodies():
    """Whole byte streams of runs in both protocols."""
    typed = "".join(frame(type="response.output_text.delta", delta=d) for d in ["Hé", "llo\n\n", "wor", "ld", ""])
    typed += frame(type="response.output_text.annotation.added", annotation={"title": "T", "url": "u1"}) * 2 + "event: x\ndata: {\"type\":\ndata: \"other\"}\n\n"
    typed += frame(type="response.completed", response={"usage": {"input_tokens": 7, "output_tokens": 9}})
    chat = "".join(frame(choices=[{"delta": {"content": c}}]) for c in "abc") + frame(choices=[{"delta": {"tool_calls": [{"function": {"name": "find", "arguments": '{"q":'}}]}}])
    chat += frame(choices=[{"delta": {"tool_calls": [{"function": {"arguments": "1}"}}]}}]) + frame(choices=[], usage={"prompt_tokens": 3, "completion_tokens": 4}) + "data: [DONE]\n\n"
    open_ended = frame(type="response.output_text.delta", delta="not ended") + "data: {\"type\": \"half"
    return {"typed": ("responses", typed), "chat": ("chat", chat), "open": ("responses", open_ended)}


def chunks(rng):
    rows = []
    for run, (protocol, body) in bodies().items():
        cuts = sorted(rng.sample(range(1, len(body)), 14))
        for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(body)])):
            rows.append((run, protocol, seq, body[a:b], dt.datetime(2024, 1, 1, 0, 0, seq)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_over_batches_and_restarts_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = chunks(rng)
    sent = rows + rng.sample(rows, 8)  # some twice
    rng.shuffle(sent)
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
    third = len(sent) // 3
    for part in (sent[:third], sent[third : 2 * third], sent[2 * third :]):  # the queries end and start again
        for half in (part[::2], part[1::2]):
            spark.createDataFrame(half, CHUNK).coalesce(1).write.mode("append").parquet(source)
        for query in runs.start(stream(), str(tmp_path / "out"), str(tmp_path / "ck")):
            query.awaitTermination(300)
            assert query.exception() is None
    got = {r.run_id: r for r in runs.read(spark, str(tmp_path / "out")).collect()}
    whole = sse.events(spark.createDataFrame(rows, CHUNK).select("run_id", "seq", "protocol", "body")).withColumn("tool_index", F.lit(0)).withColumn("ts", F.lit(None).cast("timestamp"))
    calls = {r.run_id: (r.tool_name, r.arguments) for r in ev.tool_calls(whole).collect()}
    want = {r.run_id: r for r in ev.fold(whole).collect()}
    assert set(got) == {"typed", "chat"} and want["open"].answer == "not ended"
    for run, r in got.items():
        w = want[run]
        assert (r.answer, r.finish_reason, r.n_events, r.citations) == (w.answer, w.finish_reason, w.n_events, w.citations)
        assert (r.input_tokens, r.output_tokens) == tuple(w.usage)
        assert {run: (t.tool_name, t.arguments) for t in r.tools} == ({run: calls[run]} if run in calls else {})
        assert r.first_text_at is not None
    assert got["typed"].answer == "Héllo\n\nworld" and calls["chat"] == ("find", '{"q":1}')


def test_a_silent_run_gives_what_it_said(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [r for r in chunks(random.Random(3)) if r[0] == "open"]
    stream = lambda: spark.readStream.schema(CHUNK).parquet(source)
    for part in (rows, [("typed", *r[1:]) for r in rows[:1]]):
        spark.createDataFrame(part, CHUNK).coalesce(1).write.mode("append").parquet(source)
        for query in runs.start(stream(), out, ck, idle_ms=1):
            query.awaitTermination(300)
            assert query.exception() is None
    r = runs.read(spark, out).where("run_id = 'open'").first()
    assert (r.answer, r.finish_reason, r.n_events) == ("not ended", None, 1)
