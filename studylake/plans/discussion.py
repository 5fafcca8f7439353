"""Routing, context and template queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context, routing, templates
from .registry import query, read

_ACTION = "['define', 'explain', 'eli14', 'ask', 'visualize', 'research', 'summarize', 'tldr', 'half-page', 'visual-recap', 'compact'][turn % 11 + 1]"
_RULE = """CASE WHEN action = 'research' THEN 'research' WHEN action IN ('visualize', 'visual-recap') THEN 'digest'
  WHEN action = 'define' AND greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) <= 3 THEN 'quick'
  WHEN action IN ('explain', 'eli14') THEN 'standard'
  WHEN len(regexp_extract_all(text, '\\?')) >= 2 OR length(text) > 240 THEN 'deep'
  WHEN action IN ('summarize', 'tldr', 'half-page', 'compact') THEN 'digest' END"""
_REQUESTS = f"r AS (SELECT conv_id, turn, text, {_ACTION} AS action FROM conversations WHERE role = 'user'), p AS (SELECT *, {_RULE} AS rule FROM r)"


def _requests(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    action = F.element_at(F.array(*map(F.lit, routing.ACTIONS)), (F.col("turn") % len(routing.ACTIONS) + 1).cast("int"))
    no = F.lit(False)
    return turns.select(
        "conv_id", "turn", action.alias("action"), F.col("text").alias("input"), no.alias("has_visual"), no.alias("web_enabled"),
        tx.token_estimate(F.col("text")).alias("estimated_tokens"), F.lit(None).cast("string").alias("model_override"), F.lit(None).cast("string").alias("task_model_id"),
    )


@query(f"WITH {_REQUESTS} SELECT conv_id, turn, coalesce(rule, CASE WHEN length(text) > 120 THEN 'deep' ELSE 'standard' END) AS profile FROM p")
def route_profile(spark, sf_dir):
    """RT-1, RT-4."""
    r = _requests(spark, sf_dir)
    return r.select("conv_id", "turn", routing.profile(F.col("action"), F.col("input"), F.col("has_visual"), F.col("web_enabled")).alias("profile"))


@query(f"WITH {_REQUESTS} SELECT conv_id, turn, CASE action WHEN 'visualize' THEN 'render_diagram' WHEN 'visual-recap' THEN 'image_generation' WHEN 'research' THEN 'provider_web_search' ELSE '' END AS tools FROM p")
def tools_for_action(spark, sf_dir):
    """RT-5."""
    r = _requests(spark, sf_dir)
    return r.select("conv_id", "turn", F.array_join(routing.tools(F.col("action"), F.col("web_enabled")), ",").alias("tools"))


#: Settings of four models: id, provider, window, output, priority, abilities.
MODELS = [("error", "a", 9000, 500, 1, "text streaming"), ("click", "a", 128000, 4000, 1, "text streaming vision"), ("view", "b", 64000, 4000, 1, "text streaming structuredOutput functionTools imageGeneration"), ("purchase", "b", 128000, 8000, 2, "text streaming providerWebSearch structuredOutput functionTools imageGeneration")]
PROFILES = [("quick", ["error", "click"]), ("standard", ["click", "view"]), ("deep", ["view", "purchase"]), ("digest", ["view", "purchase"]), ("research", ["click", "purchase"]), ("vision", ["click"])]
_ABILITIES = ("text", "vision", "structuredOutput", "functionTools", "providerWebSearch", "reasoningControl", "imageGeneration", "streaming")


def _models(spark):
    schema = "id string, provider_id string, context_window bigint, max_output bigint, priority bigint, enabled boolean, capabilities struct<" + ",".join(f"{a}:boolean" for a in _ABILITIES) + ">"
    rows = [(i, p, w, o, n, True, tuple(a in able.split() for a in _ABILITIES)) for i, p, w, o, n, able in MODELS]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(PROFILES, "name string, model_ids array<string>")


_MODEL_ROWS = ", ".join(f"('{i}', '{p}', {w}, {o}, {n}, '{a}')" for i, p, w, o, n, a in MODELS)
_PROFILE_ROWS = ", ".join(f"('{n}', '{m}')" for n, ms in PROFILES for m in ms)
_ROUTED = f"""{_REQUESTS}, q AS (SELECT *, coalesce(rule, CASE WHEN length(text) > 120 THEN 'deep' ELSE 'standard' END) AS profile FROM p),
m(id, provider_id, win, outp, priority, able) AS (VALUES {_MODEL_ROWS}), f(profile, id) AS (VALUES {_PROFILE_ROWS}),
t AS (SELECT event_type AS id, round(avg(value), 6) AS ttft FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY 1),
c AS (SELECT q.conv_id, q.turn, q.profile, q.rule, m.id, m.provider_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY priority, coalesce(ttft, 9e15), m.id) AS k
  FROM q JOIN f ON f.profile = q.profile JOIN m ON m.id = f.id LEFT JOIN t ON t.id = m.id
  WHERE win >= CAST(ceil(length(text) / 4.0) AS BIGINT) + outp
    AND (action <> 'visualize' OR (able LIKE '%structuredOutput%' AND able LIKE '%functionTools%'))
    AND (action <> 'visual-recap' OR (able LIKE '%structuredOutput%' AND able LIKE '%imageGeneration%'))
    AND (action <> 'research' OR able LIKE '%providerWebSearch%'))"""


@query(f"""WITH {_ROUTED} SELECT q.conv_id, q.turn, c.id AS model_id,
CASE WHEN c.id IS NULL THEN NULL WHEN q.rule IS NOT NULL THEN 'deterministic ' || q.profile || ' rule' ELSE 'freeform deterministic fallback' END AS reason
FROM q LEFT JOIN c ON c.conv_id = q.conv_id AND c.turn = q.turn AND c.k = 1""")
def route_model(spark, sf_dir):
    """RT-2, RT-3, SRT-5, AGG-4, JN-19 (profiles, models and latencies by id): models are named after event types, whose mean values are their latencies."""
    models, profiles = _models(spark)
    events = read(spark, sf_dir, "events").where("event_type <> 'error' and value is not null")
    latency = events.groupBy(F.col("event_type").alias("model_id")).agg(F.round(F.avg("value"), 6).alias("ttft"))
    routed = routing.route(_requests(spark, sf_dir), ["conv_id", "turn"], models, profiles, latency)
    return routed.select("conv_id", "turn", "model_id", "reason")


@query(f"""WITH {_ROUTED}, k AS (SELECT conv_id, turn, arg_min(id, k) AS id FROM c WHERE provider_id = 'b' GROUP BY 1, 2)
SELECT q.conv_id, q.turn, k.id AS model_id, k.id IS NOT NULL AS ready FROM q LEFT JOIN k ON k.conv_id = q.conv_id AND k.turn = q.turn""")
def model_readiness(spark, sf_dir):
    """PRJ-5, RT-6: the first eligible model of a ready provider; one provider has a secret, the other none."""
    models, profiles = _models(spark)
    events = read(spark, sf_dir, "events").where("event_type <> 'error' and value is not null")
    latency = events.groupBy(F.col("event_type").alias("model_id")).agg(F.round(F.avg("value"), 6).alias("ttft"))
    providers = spark.createDataFrame([("a", True, False), ("b", True, True)], "id string, enabled boolean, has_secret boolean")
    return routing.first_ready(_requests(spark, sf_dir), ["conv_id", "turn"], models, profiles, latency, providers).select("conv_id", "turn", "model_id", "ready")


@query("""SELECT user_id AS run_id, count(*) AS attempts, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id""")
def run_attempts(spark, sf_dir):
    """RT-8: a user's events as the attempts of a run."""
    runs = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("status"))
    return routing.attempts(runs)


_TIERS = """d AS (SELECT doc_id, profile, length(text) AS n, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM documents, (SELECT unnest(['quick', 'standard', 'deep']) AS profile)),
x AS (SELECT *, CASE WHEN t < 1200 THEN 'canonical' WHEN profile = 'deep' AND t + 1 + 4000 <= 128000 THEN 'canonical' WHEN t + 1 + 4000 > 128000 THEN 'study-with-branch-digest'
  WHEN profile = 'quick' THEN 'brief' ELSE 'study' END AS tier,
  CAST(CASE WHEN profile = 'quick' THEN least(12000, floor(n * 25 / 100)) ELSE least(48000, floor(n * 60 / 100)) END AS BIGINT) AS max_chars FROM d)"""


def _tiers(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("profile", F.explode(F.array(*map(F.lit, ("quick", "standard", "deep")))))
    return docs.withColumn("tier", context.tier(F.col("text"), F.col("profile"), F.lit("[]")))


@query(f"WITH {_TIERS} SELECT doc_id, profile, tier, t AS token_estimate FROM x")
def context_tier(spark, sf_dir):
    """CTX-1, CTX-3."""
    return _tiers(spark, sf_dir).select("doc_id", "profile", "tier", tx.token_estimate(F.col("text")).alias("token_estimate"))


@query(f"WITH {_TIERS} SELECT doc_id, profile, tier, max_chars, tier <> 'canonical' AND max_chars < n AS truncated FROM x")
def context_budget(spark, sf_dir):
    """CTX-2."""
    limit = context.budget_chars(F.col("text"), F.col("profile"))
    return _tiers(spark, sf_dir).select("doc_id", "profile", "tier", limit.alias("max_chars"), ((F.col("tier") != "canonical") & (limit < F.length("text"))).alias("truncated"))


@query(f"""WITH {_TIERS} SELECT doc_id, profile, CASE WHEN tier = 'canonical' THEN n ELSE least(n, max_chars) END AS article_chars,
sha256(substr(text, 1, CASE WHEN tier = 'canonical' THEN n ELSE max_chars END)) AS article_hash FROM x JOIN documents USING (doc_id)""")
def context_article(spark, sf_dir):
    """CTX-1: the text that goes into the context where none is cached."""
    text = context.article(F.col("text"), F.col("profile"), F.col("tier"), F.lit(None).cast("string"))
    return _tiers(spark, sf_dir).select("doc_id", "profile", text.alias("a")).select("doc_id", "profile", F.length("a").cast("long").alias("article_chars"), F.sha2("a", 256).alias("article_hash"))


@query("""SELECT source, count(*) AS note_count, CAST(sum(length(CASE WHEN l.toxic = 1 THEN text ELSE 'checked' END)) AS BIGINT) AS note_chars
FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY source""")
def curated_notes(spark, sf_dir):
    """CTX-7, JN-1, PRJ-4: labels of quality 1 as checked highlights; toxic ones have an empty note and fall back to the quote."""
    docs, labels = read(spark, sf_dir, "documents", "labels")
    anchors = docs.select(F.col("doc_id").alias("anchor_id"), F.col("source").alias("version"), F.col("text").alias("exact_quote"))
    highlights = labels.select(F.col("doc_id").alias("anchor_id"), (F.col("quality") == 1).alias("checked"), F.when(F.col("toxic") == 1, "").otherwise("checked").alias("note"))
    notes = context.curated_notes(highlights, anchors, "version")
    return notes.groupBy(F.col("version").alias("source")).agg(F.count("*").alias("note_count"), F.sum(F.length("note")).cast("long").alias("note_chars"))


_BRANCH = """m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant')),
g AS (SELECT conv_id, string_agg(i || '. ' || role || ': ' || substr(text, 1, CASE WHEN i = n THEN 2000 ELSE 600 END), chr(10) ORDER BY turn) AS digest FROM m GROUP BY conv_id)"""


@query(f"WITH {_BRANCH} SELECT conv_id, length(digest) AS digest_chars, sha256(digest) AS digest_hash FROM g")
def branch_digest(spark, sf_dir):
    """CTX-6, ARRAY. Texts are cut before they are shuffled: an older message to its length, any to the latest's."""
    s = context.Settings()
    turns = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    cut = turns.select("conv_id", F.struct("turn", "role", F.substring("text", 1, s.digest_latest_message_characters).alias("content")).alias("m"))
    made = cut.groupBy("conv_id").agg(context.digest(F.array_sort(F.collect_list("m")), s).alias("d"))
    return made.select("conv_id", F.length("d").cast("long").alias("digest_chars"), F.sha2("d", 256).alias("digest_hash"))


@query("""WITH RECURSIVE n AS (SELECT conv_id * 100000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100000 + turn - 1 END AS parent FROM conversations),
w AS (SELECT id AS leaf_id, 0 AS depth, id AS node_id FROM n UNION ALL SELECT w.leaf_id, w.depth + 1, n.parent FROM w JOIN n ON n.id = w.node_id WHERE n.parent IS NOT NULL AND w.depth + 1 < 32)
SELECT leaf_id, CAST(depth AS BIGINT) AS depth, node_id FROM w""")
def active_branch(spark, sf_dir):
    """CTX-5, JN-18: each turn as a thread whose parent is the turn before."""
    turns = read(spark, sf_dir, "conversations")
    node = F.col("conv_id") * 100000 + F.col("turn")
    threads = turns.select(node.alias("thread_id"), F.when(F.col("turn") > 0, node - 1).alias("parent_message_id"))
    stamp = F.lit("2024-01-01").cast("timestamp_ntz")
    messages = turns.select(node.alias("message_id"), node.alias("thread_id"), stamp.alias("created_at"))
    branch = context.active_branch(threads, messages, 32)
    return branch.select("leaf_id", F.col("depth").cast("long").alias("depth"), F.col("thread_id").alias("node_id"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
u AS (SELECT t.conv_id, c.conv_id AS parent, c.turn AS cut FROM t JOIN conversations c ON c.conv_id = t.conv_id - 1 AND c.turn = t.conv_id % 3),
w AS (SELECT conv_id AS leaf, 0 AS depth, conv_id AS node, CAST(NULL AS BIGINT) AS cut FROM t UNION ALL SELECT w.leaf, depth + 1, u.parent, u.cut FROM w JOIN u ON u.conv_id = w.node WHERE depth + 1 < 32),
m AS (SELECT leaf, depth, turn, text FROM w JOIN conversations c ON c.conv_id = w.node WHERE cut IS NULL OR turn <= cut)
SELECT leaf AS conv_id, count(*) AS n_messages, max(depth) AS depth, sha256(string_agg(text, chr(10) ORDER BY depth DESC, turn)) AS branch_hash FROM m GROUP BY leaf""")
def branch_cutoffs(spark, sf_dir):
    """CTX-5: each conversation branches off an early turn of the one before it, and has its ancestors' messages up to there."""
    turns = read(spark, sf_dir, "conversations")
    said = turns.select((F.col("conv_id") * 100000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("thread_id"), "role", F.col("text").alias("content"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("created_at"))
    own = F.col("conv_id")
    threads = turns.select("conv_id").distinct().select(own.alias("thread_id"), ((own - 1) * 100000 + own % 3).alias("parent_message_id"))
    branch = context.active_branch(threads, said, 32)
    joined = context.branch_messages(branch, said).select("leaf_id", F.size("branch").cast("long").alias("n_messages"), F.sha2(F.array_join(F.transform("branch", lambda m: m["content"]), "\n"), 256).alias("branch_hash"))
    deepest = branch.join(said.select("thread_id", "created_at"), "thread_id").where("cutoff IS NULL OR created_at <= cutoff").groupBy("leaf_id").agg(F.max("depth").cast("long").alias("depth"))
    return joined.join(deepest, "leaf_id").select(F.col("leaf_id").alias("conv_id"), "n_messages", "depth", "branch_hash")


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'queue' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'fail' ELSE 'text_changed' END AS move,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, n, CAST(0 AS BIGINT) AS r, 'none' AS status, CAST(0 AS BIGINT) AS errors FROM e WHERE r = 1 UNION ALL
  SELECT s.user_id, s.n, e.r, CASE WHEN move = 'queue' AND status NOT IN ('queued', 'running') THEN 'queued' WHEN move = 'start' AND status = 'queued' THEN 'running' WHEN move = 'result' AND status = 'running' THEN 'completed'
    WHEN move = 'fail' AND status = 'running' THEN 'failed' WHEN move = 'text_changed' AND status IN ('queued', 'running') THEN 'cancelled' ELSE status END,
  errors + CASE WHEN (move = 'queue' AND status NOT IN ('queued', 'running')) OR (move = 'start' AND status = 'queued') OR (move IN ('result', 'fail') AND status = 'running') OR (move = 'text_changed' AND status IN ('queued', 'running')) THEN 0 ELSE 1 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT user_id, status, errors, n AS n_moves, status NOT IN ('queued', 'running') AS queued_again FROM s WHERE r = n""")
def job_states(spark, sf_dir):
    """CTX-9: a user's events as moves of a context job, folded in order; those without a live job are queued anew."""
    kind = F.col("event_type")
    move = F.when(kind == "view", "queue").when(kind == "click", "start").when(kind == "purchase", "result").when(kind == "error", "fail").otherwise("text_changed")
    events = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), move.alias("move"))
    states = context.job_states(events, "user_id", "at", "move", F.date_trunc("day", F.col("at.ts")))
    none = states.select("user_id").where("false")
    again = context.jobs_to_queue(states, none, states, ["user_id"]).withColumn("again", F.lit(True))
    return states.join(again, "user_id", "left").select("user_id", "status", "errors", "n_moves", F.coalesce("again", F.lit(False)).alias("queued_again"))


_ENVELOPE = " || ".join("'[" + v + "]' || chr(10) || " + {"articleContext": "text", "action": "action", "request": "'Please do this with the selection: ' || action || '.'", "contextTier": "'canonical'"}.get(v, "''") + " || chr(10)" for v in templates.ENVELOPE)


@query(f"WITH {_REQUESTS} SELECT conv_id, turn, CAST(length({_ENVELOPE}) AS BIGINT) AS prompt_chars, sha256({_ENVELOPE}) AS prompt_hash FROM p")
def prompt_render(spark, sf_dir):
    """TPL-3: the envelope filled from a turn; a text's own braces are left alone."""
    envelope = next(text for key, *_, text in templates.CATALOGUE if key == "user.envelope")
    request = templates.render("Please do this with the selection: {{action}}.", {"action": F.col("action")})
    prompt = templates.render(envelope, {"articleContext": F.col("input"), "action": F.col("action"), "contextTier": F.lit("canonical"), "request": request})
    made = _requests(spark, sf_dir).select("conv_id", "turn", prompt.alias("p"))
    return made.select("conv_id", "turn", F.length("p").cast("long").alias("prompt_chars"), F.sha2("p", 256).alias("prompt_hash"))


@query("""SELECT * FROM (VALUES ('context.cache-generation', true, '', '', false), ('request.define', false, 'other', '', false), ('scope.answer', false, '', 'answerText', false),
('scope.thread', false, '', '', true), ('user.envelope', true, '', '', false)) AS t(key, valid, unknown, missing, malformed)""")
def prompt_validate(spark, sf_dir):
    """TPL-1, TPL-2, TPL-4: defaults and three overrides, each wrong in a way of its own."""
    own = [("request.define", "{{other}} please"), ("scope.answer", "{{ action }} only"), ("scope.thread", "{{action}} and {{"), ("user.envelope", "{{articleContext}}{{action}}{{request}}")]
    overrides = spark.createDataFrame(own, "key string, template string")
    checked = templates.validate(templates.effective(templates.catalogue(spark), overrides))
    chosen = checked.where(F.col("overridden") | (F.col("key") == "context.cache-generation"))
    return chosen.select("key", "valid", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"), "malformed")
