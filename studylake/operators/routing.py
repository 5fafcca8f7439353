"""Routing of requests to models: ordered rules, capabilities, and ranking by priority and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

ACTIONS = ("define", "explain", "eli14", "ask", "visualize", "research", "summarize", "tldr", "half-page", "visual-recap", "compact")
#: Latency of a model without history; it ranks last.
NO_HISTORY = 2**53 - 1

REQUEST = "action string, input string, has_visual boolean, web_enabled boolean, estimated_tokens bigint, model_override string, task_model_id string"


def profile_rule(action: Column, text: Column, has_visual: Column, web: Column) -> Column:
    """The profile that the ordered rules give, or null (RT-1). A blank input counts as one word."""
    words = F.greatest(F.size(tx.words(text)), F.lit(1))
    return (
        F.when((action == "research") | web, "research")
        .when(action.isin("visualize", "visual-recap"), "digest")
        .when(has_visual, "vision")
        .when((action == "define") & (words <= 3), "quick")
        .when(action.isin("explain", "eli14"), "standard")
        .when((F.regexp_count(text, F.lit(r"\?")) >= 2) | (F.length(text) > 240), "deep")
        .when(action.isin("summarize", "tldr", "half-page", "compact"), "digest")
    )


def profile(action: Column, text: Column, has_visual: Column, web: Column, classified: Column | None = None) -> Column:
    """The rules, else the classifier's answer where there is one, else the input's length (RT-4)."""
    rest = F.when(F.length(text) > 120, "deep").otherwise("standard")
    rule = profile_rule(action, text, has_visual, web)
    return F.coalesce(rule, rest) if classified is None else F.coalesce(rule, classified, rest)


def tools(action: Column, web: Column) -> Column:
    """Tools that an action may call (RT-5)."""
    none = F.array().cast("array<string>")
    return (
        F.when(action == "visualize", F.array(F.lit("render_diagram")))
        .when(action == "visual-recap", F.array(F.lit("image_generation")))
        .when((action == "research") | web, F.array(F.lit("provider_web_search")))
        .otherwise(none)
    )


def capable(r: str = "r", m: str = "m") -> Column:
    """Whether a model can serve a request (RT-2); ``r`` and ``m`` are the aliases of the two sides."""
    c = lambda name: F.col(f"{m}.capabilities.{name}")
    action, web = F.col(f"{r}.action"), F.col(f"{r}.web_enabled")
    return (
        F.col(f"{m}.enabled") & c("text") & c("streaming")
        & (~F.col(f"{r}.has_visual") | c("vision"))
        & ((action != "visualize") | (c("structuredOutput") & c("functionTools")))
        & ((action != "visual-recap") | (c("structuredOutput") & c("imageGeneration")))
        & (~((action == "research") | web) | c("providerWebSearch"))
        & (F.col(f"{m}.context_window") >= F.col(f"{r}.estimated_tokens") + F.col(f"{m}.max_output"))
    )


def route(requests: DataFrame, key: list[str], models: DataFrame, profiles: DataFrame, latency: DataFrame, classified: str | None = None) -> DataFrame:
    """``(key, profile, model_id, reason, error)`` for each request (RT-3, SRT-5, JN-19).

    ``requests`` has the columns of ``REQUEST``; ``models`` and ``profiles`` are settings of bounded size, sent to all tasks;
    ``latency``: ``(model_id, ttft)``. A named model is taken if it can serve the request, else it is an error; otherwise
    the profile's models compete by priority, then latency, models without history last, then id.
    """
    action, text, visual, web = (F.col(c) for c in ("action", "input", "has_visual", "web_enabled"))
    known = None if classified is None else F.col(classified)
    rule = profile_rule(action, text, visual, web)
    asked = requests.withColumn("rule", rule).withColumn("named", F.coalesce("model_override", "task_model_id"))
    fallback = F.coalesce(rule, known, F.lit("standard")) if known is not None else F.coalesce(rule, F.lit("standard"))
    asked = asked.withColumn("profile", F.when(F.col("named").isNotNull(), fallback).otherwise(profile(action, text, visual, web, known)))
    ranked = models.join(latency.withColumnRenamed("model_id", "id"), "id", "left").withColumn("ttft", F.coalesce("ttft", F.lit(float(NO_HISTORY))))
    in_profile = profiles.select(F.col("name").alias("profile_name"), F.explode("model_ids").alias("profile_model"))
    options = ranked.join(in_profile.groupBy("profile_model").agg(F.collect_set("profile_name").alias("in_profiles")), F.col("id") == F.col("profile_model"), "left")
    wanted = F.when(F.col("r.named").isNotNull(), F.col("m.id") == F.col("r.named")).otherwise(F.coalesce(F.array_contains("m.in_profiles", F.col("r.profile")), F.lit(False)))
    pairs = asked.alias("r").join(F.broadcast(options).alias("m"), wanted & capable())
    best = pairs.groupBy(*(F.col(f"r.{k}") for k in key)).agg(F.min(F.struct("m.priority", "m.ttft", "m.id")).alias("best"))
    out = asked.join(best, key, "left")
    reason = (
        F.when(F.col("model_override").isNotNull(), "manual override")
        .when(F.col("task_model_id").isNotNull(), "configured action route")
        .when(F.col("rule").isNotNull(), F.concat(F.lit("deterministic "), F.col("profile"), F.lit(" rule")))
        .otherwise("freeform deterministic fallback" if known is None else F.when(known.isNotNull(), "freeform quick classification").otherwise("freeform deterministic fallback"))
    )
    served = F.col("best").isNotNull()
    error = F.when(~served, F.when(F.col("named").isNotNull(), "named model cannot serve the request").otherwise(F.concat(F.lit("no capable "), F.col("profile"), F.lit(" model"))))
    return out.select(*key, "profile", F.col("best.id").alias("model_id"), F.when(served, reason).alias("reason"), error.alias("error"))


def ready(routed: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """``ready`` of each routed request: its model's provider is enabled and has a secret (PRJ-5, RT-6)."""
    state = providers.select(F.col("id").alias("provider_id"), (F.col("enabled") & F.col("has_secret")).alias("ready"))
    owned = models.select(F.col("id").alias("model_id"), "provider_id").join(state, "provider_id", "left").drop("provider_id")
    return routed.join(owned, "model_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def first_ready(requests: DataFrame, key: list[str], models: DataFrame, profiles: DataFrame, latency: DataFrame, providers: DataFrame, classified: str | None = None) -> DataFrame:
    """``route`` to the first of the eligible models whose provider is enabled and has a secret (RT-6)."""
    able = providers.where(F.col("enabled") & F.col("has_secret")).select(F.col("id").alias("provider_id"))
    routed = route(requests, key, models.join(able, "provider_id", "left_semi"), profiles, latency, classified)
    return routed.withColumn("ready", F.col("model_id").isNotNull())


def attempts(runs: DataFrame) -> DataFrame:
    """Last attempt of each run: ``(run_id, attempts, status)`` from ``(run_id, attempt, status)`` (RT-8)."""
    return runs.groupBy("run_id").agg(F.count("*").alias("attempts"), F.max_by("status", "attempt").alias("status"))
