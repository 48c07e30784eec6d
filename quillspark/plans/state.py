"""Queries over memory, runs and rankings that say how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims, context, ranking, surfacing, trials
from ..sources import adapters as A
from . import registry as R
from . import sql as S
from .registry import query

_RECALL_BUDGET = 150


def _scores(items: str, tasks: str) -> str:
    """item_scores(context_id, pos, score) of (context_id, pos, content) for (context_id, task); each context is a corpus."""
    return f"""tasks AS ({tasks}), it AS (SELECT context_id, pos, {S.terms('content')} AS t FROM {items}), asks AS (SELECT context_id, term, count(*) AS times FROM (SELECT context_id, unnest({S.terms('task')}) AS term FROM tasks) GROUP BY 1, 2),
tot AS (SELECT context_id, count(*) AS n_items, avg(len(t)) AS mean_length FROM it GROUP BY 1), itf AS (SELECT context_id, pos, len, term, times, count(*) AS tf FROM (SELECT context_id, pos, len(t) AS len, unnest(t) AS term FROM it) JOIN asks USING (context_id, term) GROUP BY ALL),
idf AS (SELECT context_id, term, count(*) AS df FROM itf GROUP BY 1, 2), item_scores AS (SELECT context_id, pos, sum(times * ln(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_length))) AS score FROM itf JOIN idf USING (context_id, term) JOIN tot USING (context_id) GROUP BY 1, 2)"""


_TASKS = "SELECT DISTINCT user_id AS context_id, CASE user_id % 3 WHEN 0 THEN 'statement ' || user_id || ' decision' WHEN 1 THEN 'soft constraint discovery ' || user_id ELSE '' END AS task FROM events"


@query(f"""WITH RECURSIVE {S.EVENTS}, {S.measured('events_ctx')}, {S.classified('measured')}, s AS (SELECT context_id, sum(token_count) AS t, coalesce(sum(token_count) FILTER (WHERE relevance IN ('critical', 'relevant')), 0) AS u FROM classified GROUP BY 1),
trig AS (SELECT context_id, CASE WHEN round(least(1, t / 1000.0), 4) >= 0.75 THEN 'window_usage' WHEN round(u / t::DOUBLE, 4) <= 0.5 THEN 'relevant_ratio' ELSE 'none' END AS reason FROM s),
{R._RECORDS}, {R._OFFERED}, {_scores('offered', _TASKS)}, c AS (SELECT o.context_id, o.token_count, row_number() OVER (PARTITION BY o.context_id ORDER BY score DESC NULLS LAST, o.pos) AS rank FROM offered o LEFT JOIN item_scores i ON i.context_id = o.context_id AND i.pos = o.pos AND i.score > 0),
f AS (SELECT context_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT context_id FROM c)
 UNION ALL SELECT c.context_id, c.rank, CASE WHEN f.used + c.token_count <= {_RECALL_BUDGET} THEN f.used + c.token_count ELSE f.used END, CASE WHEN f.used + c.token_count <= {_RECALL_BUDGET} THEN f.n + 1 ELSE f.n END FROM f JOIN c ON c.context_id = f.context_id AND c.rank = f.rank + 1),
o AS (SELECT context_id, count(*) AS on_file FROM offered GROUP BY 1), taken AS (SELECT context_id, max(n) AS n FROM f GROUP BY 1), ranked AS (SELECT context_id, count(*) AS n_ranked FROM item_scores WHERE score > 0 GROUP BY 1),
x AS (SELECT o.context_id, coalesce(reason, 'no context') AS reason, on_file, n, on_file - coalesce(n_ranked, 0) AS unranked, task <> '' AS stated FROM o LEFT JOIN trig USING (context_id) LEFT JOIN taken USING (context_id) LEFT JOIN ranked USING (context_id) LEFT JOIN tasks USING (context_id))
SELECT context_id, reason, on_file, (CASE WHEN pushed THEN n ELSE 0 END)::BIGINT AS surfaced, (CASE WHEN pushed THEN on_file - n ELSE 0 END)::BIGINT AS withheld, (CASE WHEN pushed THEN unranked ELSE 0 END)::BIGINT AS unranked,
 CASE WHEN pushed AND NOT stated THEN 'no task: candidates are in the order of the records' WHEN pushed AND unranked > 0 THEN unranked || ' candidate(s) share no word with the task and come last' END AS degraded_reason FROM (SELECT *, reason NOT IN ('none', 'no context') AS pushed FROM x)""")
def memory_recall_ranked(spark, sf_dir):
    """Memory for contexts of 1,000 tokens whose health says that it is due, the best for each context's task first."""
    offered = surfacing.candidates(R._records(spark, sf_dir))
    user = F.col("user_id")
    task = F.when(user % 3 == 0, F.concat(F.lit("statement "), user, F.lit(" decision"))).when(user % 3 == 1, F.concat(F.lit("soft constraint discovery "), user)).otherwise("")
    tasks = A.table(spark, sf_dir, "events").select("user_id").distinct().select(user.alias("context_id"), task.alias("task"))
    return surfacing.recall_for(offered, tasks, R.surfacing_trigger(spark, sf_dir), _RECALL_BUDGET)


_ASKED = "SELECT 0 AS query_id, 'the of and that inner nation' AS query"


@query(f"""WITH {S.bm25(_ASKED, 'SELECT doc_id, text FROM documents')} SELECT doc_id, round(1.0 / (60 + rank), 6) AS fused, 'lexical' AS method, 'lexical_only' AS mode, 'no document has a usable vector' AS degraded_reason FROM ranked""")
def hybrid_without_vectors(spark, sf_dir):
    """A ranking whose documents have no vector of the query's length says so."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("array<double>").alias("vector"))
    asked = spark.createDataFrame([(R.TASK, [1.0, 0.0])], "query string, vector array<double>")
    return ranking.hybrid(asked, docs).withColumn("fused", F.round("fused", 6))


_MANIFEST = """m AS (SELECT 'run' || event_id % 3 AS run_id, event_id AS line, event_id AS trial_id, value, event_id % 7 = 0 AS failed FROM events),
latest AS (SELECT * FROM m WHERE run_id = (SELECT max_by(run_id, line) FROM m))"""


@query(f"""WITH {_MANIFEST} SELECT trial_id, reason = '' AS ok, reason FROM (SELECT trial_id, CASE WHEN trial_id % 11 = 0 THEN 'the fixture has changed' WHEN trial_id % 13 = 0 THEN 'nothing was derived' WHEN trial_id % 5 = 0 THEN 'exit code 2 instead of ' || CASE WHEN failed THEN 1 ELSE 0 END
 WHEN trial_id % 4 = 0 THEN 'differs: value' WHEN trial_id % 17 = 0 THEN 'no longer reported: extra' ELSE '' END AS reason FROM latest)""")
def evidence_verify_latest(spark, sf_dir):
    """The last run's trials, derived again: what holds, and why the rest does not."""
    id, code = F.col("event_id"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    events = A.table(spark, sf_dir, "events")
    metrics = F.create_map(F.lit("value"), F.col("value"), F.lit("extra"), F.lit(1.0))
    published = events.select(F.concat(F.lit("run"), id % 3).alias("run_id"), id.alias("line"), id.alias("trial_id"), metrics.alias("metrics"), code.alias("exit_code"), F.when(id % 11 == 0, "old").otherwise("now").alias("fixture_hash"))
    value = F.when(id % 4 == 0, F.col("value") + 1).otherwise(F.col("value"))
    again = F.when(id % 17 == 0, F.create_map(F.lit("value"), value)).otherwise(F.create_map(F.lit("value"), value, F.lit("extra"), F.lit(1.0)))
    derived = events.where("event_id % 13 <> 0").select(id.alias("trial_id"), again.alias("metrics"), F.when(id % 5 == 0, 2).otherwise(code).alias("exit_code"))
    return trials.verify_latest(published, derived, "now")


@query(f"""WITH {R._TRIALS}, w AS (SELECT 'few_trials' AS warning, condition AS subject FROM trials GROUP BY 2 HAVING count(*) < 5 UNION ALL SELECT 'no_artifact', trial_id::VARCHAR FROM trials WHERE artifact_hash IS NULL UNION ALL SELECT DISTINCT 'missing_metric', 'value' FROM trials WHERE NOT reported
 UNION ALL SELECT 'degenerate_floor', 'success' FROM trials WHERE condition = 'c0' HAVING count(*) >= 2 UNION ALL SELECT DISTINCT 'unreadable_file', 'out/f' || trial_id % 9 || '.bin' FROM trials WHERE trial_id % 9 < 4),
t AS (SELECT condition, 'success' AS metric FROM trials WHERE condition <> 'c0' GROUP BY 1 UNION ALL SELECT condition, 'value' FROM trials WHERE condition <> 'c0' AND reported GROUP BY 1)
SELECT 'warning' AS section, warning || ':' || subject AS key, NULL::BIGINT AS warnings, NULL::BOOLEAN AS publishable FROM w UNION ALL SELECT 'comparison', condition || ':' || metric, NULL, NULL FROM t UNION ALL SELECT 'trial', trial_id::VARCHAR, NULL, NULL FROM trials UNION ALL SELECT 'run', '', count(*), count(*) = 0 FROM w""")
def eval_report_rows(spark, sf_dir):
    """A run's report as JSON rows: warnings, comparisons, trials, and whether the figures may be published."""
    runs = R._trials(spark, sf_dir)
    files = runs.where("trial_id % 9 < 4").select("trial_id", F.concat(F.lit("out/f"), F.col("trial_id") % 9, F.lit(".bin")).alias("path"))
    rows = trials.eval_report(runs, ("success", "value"), "c0", files)
    own = F.when(F.col("section") == "run", F.from_json("report", "warnings long, publishable boolean"))
    return rows.select("section", "key", own["warnings"].alias("warnings"), own["publishable"].alias("publishable"))


def _near(statements: str) -> str:
    return f"""{S.bm25("SELECT item_id AS query_id, text AS query FROM benchmark", statements)}, own AS (SELECT query_id, sum(times * ln(4.0 / 3) * times * 2.5 / (times + 1.5)) AS self_score FROM asked GROUP BY 1),
near AS (SELECT query_id, doc_id, round(least(score / self_score, 0.85), 2) AS confidence FROM ranked JOIN own USING (query_id) WHERE score / self_score >= 0.15)"""


@query(f"""WITH d AS (WITH {_near("SELECT doc_id, text FROM documents WHERE doc_id % 4 IN (1, 2)")} SELECT * FROM near), c AS (WITH {_near("SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0")} SELECT * FROM near)
SELECT query_id AS text_id, 'decision' AS what, doc_id::VARCHAR AS record, confidence, CASE WHEN doc_id % 4 = 1 THEN 'rejected' ELSE 'superseded' END AS status FROM d UNION ALL SELECT query_id, 'constraint', doc_id::VARCHAR, confidence, 'hard' FROM c""")
def memory_alignment(spark, sf_dir):
    """Texts that come back to decisions that are no longer taken, or go against hard constraints; all documents are records."""
    id = F.col("doc_id")
    records = A.table(spark, sf_dir, "documents").select(id.alias("id"), F.col("text").alias("statement"))
    status = F.when(F.col("id") % 4 == 1, "rejected").when(F.col("id") % 4 == 2, "superseded").otherwise("active")
    decisions = records.withColumns({"status": status, "detail": F.lit(None).cast("string")})
    constraints = records.withColumn("hard", F.col("id") % 2 == 0)
    texts = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), F.translate("text", "`", "'").alias("text"))  # no claims in them
    found = claims.check(texts, decisions=decisions, constraints=constraints)
    said = F.col("explanation")
    what = F.when(F.startswith(said, F.lit("resembles a breach")), "constraint").otherwise("decision")
    status = F.when(what == "constraint", "hard").otherwise(F.regexp_extract(said, r"^resembles a (\w+) decision", 1))
    return found.select("text_id", what.alias("what"), F.element_at("evidence", 1).alias("record"), "confidence", status.alias("status"))


@query(f"WITH {S.EVENTS}, {S.pipeline('events_ctx', R.BUDGET)} SELECT context_id, count(*) AS items, sum(after)::BIGINT AS tokens FROM kept GROUP BY 1")
def pruned_contexts(spark, sf_dir):
    """Contexts within their budget, written and read back."""
    import uuid

    from ..storage import shared_folder

    path = f"{shared_folder(spark)}/pruned-{uuid.uuid4().hex}"
    kept = context.run(A.events_context(spark, sf_dir), budget=R.BUDGET)
    context.write_pruned(kept.select("context_id", "pos", "kind", "content", "token_count"), path)
    again = spark.read.schema("context_id long, pos long, kind string, content string, token_count long").json(path)
    return again.groupBy("context_id").agg(F.count("*").alias("items"), F.sum("token_count").alias("tokens"))
