"""Reading contexts of bounded size: tiers, budgets, neighbours, notes, discussion branches and their digests."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import relational as rel
from .store import written


@dataclass(frozen=True)
class Settings:
    """Tunables with their defaults (CTX-8)."""

    full_article_threshold_tokens: int = 1200
    reserved_prompt_tokens: int = 4000
    quick_context_max_tokens: int = 3000
    quick_context_percent: int = 25
    study_context_max_tokens: int = 12000
    study_context_percent: int = 60
    thread_ancestor_limit: int = 32
    digest_older_message_characters: int = 600
    digest_latest_message_characters: int = 2000

    def problems(self) -> list[str]:
        """Ranges and pairs that do not hold; empty if the settings are valid."""
        found = [f"{k} must be from {low} to {high}" for k, (low, high) in RANGES.items() if not low <= asdict(self)[k] <= high]
        for small, large in ORDERED:
            if asdict(self)[large] < asdict(self)[small]:
                found.append(f"{large} must be at least {small}")
        return found


#: The range of each setting.
RANGES = {
    "full_article_threshold_tokens": (100, 20000),
    "reserved_prompt_tokens": (0, 64000),
    "quick_context_max_tokens": (256, 64000),
    "quick_context_percent": (5, 100),
    "study_context_max_tokens": (512, 128000),
    "study_context_percent": (5, 100),
    "thread_ancestor_limit": (1, 128),
    "digest_older_message_characters": (100, 10000),
    "digest_latest_message_characters": (200, 20000),
}


#: Settings of which the second must be the first at least.
ORDERED = (
    ("quick_context_max_tokens", "study_context_max_tokens"),
    ("quick_context_percent", "study_context_percent"),
    ("digest_older_message_characters", "digest_latest_message_characters"),
)


def settings_problems() -> Column:
    """``Settings.problems`` for a table with a column for each setting (CTX-8): what does not hold, an empty array if all does."""
    ranges = [F.when(~F.col(k).between(low, high), f"{k} must be from {low} to {high}") for k, (low, high) in RANGES.items()]
    return F.array_compact(F.array(*ranges, *(F.when(F.col(large) < F.col(small), f"{large} must be at least {small}") for small, large in ORDERED)))


def full_estimate(text: Column, branch_json: Column, s: Settings) -> Column:
    """Tokens of text, branch and the reserve (CTX-3)."""
    return tx.token_estimate(text) + tx.token_estimate(branch_json) + s.reserved_prompt_tokens


def tier(text: Column, profile: Column, branch_json: Column, window: int = 128_000, s: Settings = Settings()) -> Column:
    """Which text a request gets: all of it, a brief or study context, or that with a branch digest (CTX-1)."""
    full = full_estimate(text, branch_json, s)
    return (
        F.when(tx.token_estimate(text) < s.full_article_threshold_tokens, "canonical")
        .when(profile.isin("deep", "vision", "research") & (full <= window), "canonical")
        .when(full > window, "study-with-branch-digest")
        .when(profile == "quick", "brief")
        .otherwise("study")
    )


def budget_chars(text: Column, profile: Column, s: Settings = Settings()) -> Column:
    """Characters that a cut context may hold (CTX-2)."""
    size = F.length(text)
    quick = F.least(F.lit(s.quick_context_max_tokens * 4), F.floor(size * s.quick_context_percent / 100))
    study = F.least(F.lit(s.study_context_max_tokens * 4), F.floor(size * s.study_context_percent / 100))
    return F.when(profile == "quick", quick).otherwise(study).cast("long")


def article(text: Column, profile: Column, which: Column, cached: Column, s: Settings = Settings()) -> Column:
    """The text itself: whole for canonical tiers, else the cached context, else a prefix."""
    return F.when(which == "canonical", text).otherwise(F.coalesce(cached, F.substr(text, F.lit(1), budget_chars(text, profile, s).cast("int"))))


def curated_notes(highlights: DataFrame, anchors: DataFrame, version: str) -> DataFrame:
    """Checked notes, or their quotes where the note is empty (CTX-7, JN-1, PRJ-4)."""
    kept = highlights.where("checked").select("anchor_id", "note")
    return kept.join(anchors.select("anchor_id", version, "exact_quote"), "anchor_id").select(version, tx.or_else(F.col("note"), F.col("exact_quote")).alias("note"))


def neighbour_text(blocks: DataFrame, key: str) -> DataFrame:
    """Text of each block with those next to it (CTX-4)."""
    return rel.neighbours(blocks, key, "ordinal", "text", "neighbour_text")


def digest(messages: Column, s: Settings = Settings()) -> Column:
    """Numbered lines of a branch, the last message at greater length (CTX-6); ``messages`` are structs of role and content."""
    last = F.size(messages) - 1
    line = lambda m, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), m["role"], F.lit(": "),
        F.when(i == last, F.substring(m["content"], 1, s.digest_latest_message_characters)).otherwise(F.substring(m["content"], 1, s.digest_older_message_characters)),
    )
    return F.array_join(F.transform(messages, line), "\n")


def digest_version(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Digest of each branch with its version: the stored one if it has as many messages, else the next (CTX-6)."""
    newest = stored.groupBy(key).agg(F.max_by(F.struct("version", "message_count", "content"), "version").alias("s"))
    same = F.coalesce(F.col("s.message_count") == F.col("message_count"), F.lit(False))
    return current.join(newest, key, "left").select(
        key,
        F.when(same, F.col("s.version")).otherwise(F.coalesce("s.version", F.lit(0)) + 1).cast("long").alias("version"),
        "message_count",
        F.when(same, F.col("s.content")).otherwise(F.col("content")).alias("content"),
    )


def active_branch(threads: DataFrame, messages: DataFrame, limit: int = 32) -> DataFrame:
    """``(leaf_id, depth, thread_id, cutoff)``: each thread's way up through parent messages (CTX-5, JN-18).

    ``threads``: thread_id, parent_message_id; ``messages``: message_id, thread_id, created_at. ``cutoff`` is the time up to
    which an ancestor's messages count, null for the leaf. A cycle ends at the limit. Ways are put together from ways of half
    their length, so 32 levels take five joins; rows are not bounded.
    """
    up = threads.select(F.col("thread_id").alias("leaf_id"), "parent_message_id").join(
        messages.select(F.col("message_id").alias("parent_message_id"), "thread_id", F.col("created_at").cast("timestamp_ntz").alias("cutoff")), "parent_message_id"
    )
    ways = written(up.select("leaf_id", F.lit(1).alias("depth"), "thread_id", "cutoff"), "branch")
    reach = 1
    while reach < limit - 1:
        far = ways.where(F.col("depth") == reach).select("leaf_id", F.col("thread_id").alias("__via"))
        on = ways.select(F.col("leaf_id").alias("__via"), (F.col("depth") + reach).alias("depth"), "thread_id", "cutoff").where(F.col("depth") < limit)
        more = written(far.join(on, "__via").select(*ways.columns), "branch")
        if more.isEmpty():
            break
        ways, reach = ways.unionByName(more), 2 * reach
    own = threads.select(F.col("thread_id").alias("leaf_id"), F.lit(0).alias("depth"), "thread_id", F.lit(None).cast("timestamp_ntz").alias("cutoff"))
    return own if limit < 2 else own.unionByName(ways)


def branch_messages(branch: DataFrame, messages: DataFrame) -> DataFrame:
    """``(leaf_id, branch)``: messages along each branch, the oldest ancestor's first (CTX-5)."""
    kept = branch.join(messages.select("thread_id", "message_id", "role", "content", F.col("created_at").cast("timestamp_ntz").alias("created_at")), "thread_id")
    kept = kept.where(F.col("cutoff").isNull() | (F.col("created_at") <= F.col("cutoff")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("o"), "created_at", "message_id", "role", "content")))
    return kept.groupBy("leaf_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("branch"))


def jobs_to_queue(wanted: DataFrame, cached: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts to generate: those wanted that are neither cached nor queued nor running (CTX-9), each once."""
    live = jobs.where(F.col("status").isin("queued", "running")).select(*keys)
    return wanted.select(*keys).distinct().join(cached.select(*keys), keys, "left_anti").join(live, keys, "left_anti")


#: States of a job and the moves between them (CTX-9); a job that has ended may be queued again.
STATES = ("none", "queued", "running", "completed", "failed", "cancelled")
MOVES = {
    ("none", "queue"): "queued", ("completed", "queue"): "queued", ("failed", "queue"): "queued", ("cancelled", "queue"): "queued", ("queued", "start"): "running",
    ("running", "result"): "completed", ("running", "fail"): "failed", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("queued", "text_changed"): "cancelled", ("running", "text_changed"): "cancelled",
}


def job_states(moves: DataFrame, job: str, order: str, move: str, chunk: Column) -> DataFrame:
    """``(job, status, errors, n_moves)``: each job's moves folded in order; an illegal move changes nothing and is counted.

    Moves of a job are folded a ``chunk`` at a time (a number that grows with ``order``), from every state that it may begin in,
    and the chunks are put together in their order: no task needs to hold all moves of a job.
    """
    table = F.create_map(*(F.lit(x) for (was, by), now in MOVES.items() for x in (f"{was} {by}", now)))
    start = lambda state: F.struct(state.alias("state"), F.lit(0).cast("long").alias("errors"))

    def step(acc: Column, m: Column) -> Column:
        now = F.try_element_at(table, F.concat(acc["state"], F.lit(" "), F.coalesce(m["move"], F.lit(""))))
        return F.struct(F.coalesce(now, acc["state"]).alias("state"), (acc["errors"] + now.isNull().cast("long")).alias("errors"))

    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(move).alias("move"))))
    parts = moves.groupBy(F.col(job).alias("job"), chunk.alias("chunk")).agg(steps.alias("steps"), F.count("*").alias("n"))
    ends = F.map_from_arrays(F.array(*map(F.lit, STATES)), F.array(*(F.aggregate("steps", start(F.lit(s)), step) for s in STATES)))
    parts = parts.select("job", "n", F.struct("chunk", ends.alias("ends")).alias("part"))
    whole = parts.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("part.chunk").alias("c"), F.map_values("part.ends").alias("ends")))), lambda p: p["ends"]).alias("parts"), F.sum("n").alias("n_moves"))

    def chain(acc: Column, ends_: Column) -> Column:
        end = F.element_at(ends_, F.array_position(F.array(*map(F.lit, STATES)), acc["state"]).cast("int"))
        return F.struct(end["state"].alias("state"), (acc["errors"] + end["errors"]).alias("errors"))

    done = whole.select("job", "n_moves", F.aggregate("parts", start(F.lit("none")), chain).alias("end"))
    return done.select(F.col("job").alias(job), F.col("end.state").alias("status"), F.col("end.errors").alias("errors"), "n_moves")


def finish_jobs(jobs: DataFrame, results: DataFrame, texts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Running jobs with their outcome (CTX-9): a result counts if its text is still the current one and it has 1 token at
    least and its tier's limit at most. ``results``: job_id, content, text_hash; ``texts``: version_id, text_hash."""
    table = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    current = texts.select("version_id", F.col("text_hash").alias("now"))
    joined = jobs.join(results.select("job_id", "content", "text_hash"), "job_id", "left").join(current, "version_id", "left")
    size = tx.token_estimate(F.col("content"))
    running = F.col("status") == "running"
    outcome = (
        F.when(F.col("content").isNull(), "failed")
        .when(~F.col("text_hash").eqNullSafe(F.col("now")), "cancelled")
        .when(size.between(1, F.try_element_at(table, F.col("tier"))), "completed")
        .otherwise("failed")
    )
    return joined.withColumn("status", F.when(running, outcome).otherwise(F.col("status"))).select(*jobs.columns, F.when(F.col("status") == "completed", F.col("content")).alias("content"))


MAX_UPLOAD = 5 << 20


def run_image(upload: Column, block_type: Column, visual: Column) -> Column:
    """Where a run's image comes from: an uploaded PNG, the block's own picture, or nowhere (CTX-10)."""
    png = (F.hex(F.substring(upload, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(upload) <= MAX_UPLOAD)
    return F.when(png, "upload").when((block_type == "image") & (visual != ""), "asset").when((block_type == "svg") & visual.isNotNull(), "svg")


def replay(requests: DataFrame, runs: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Requests to run, and the runs that answer those that were made before (CTX-12)."""
    return requests.dropDuplicates([key]).join(runs.select(key), key, "left_anti"), runs.join(requests.select(key).distinct(), key, "left_semi")
