"""Registered queries and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, codegraph, context, graph, health, memory, ranking, rules, stats, surfacing, trials
from ..sources import adapters as A
from ..sources import repository, transcripts
from ..storage import saved
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "context_pipeline_ledger"
BUDGET = 110
TASK = "the of and that inner nation"
_found: dict[str, tuple[Query, str | None]] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _found[function.__name__] = (function, oracle)
        return function

    return register


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, (_, oracle) in _found.items() if oracle}


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


# texts


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens, 'heuristic:chars/4' AS token_method FROM documents")
def token_estimate_documents(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.lit(T.TOKEN_METHOD).alias("token_method"))


@query(f"WITH {S.DOCUMENTS}, {S.measured('docs_ctx')}, {S.DEDUPED} SELECT context_id, pos, content_hash FROM deduped")
def content_hash_dedup(spark, sf_dir):
    return context.dedup(context.measure(A.documents_context(spark, sf_dir))).select("context_id", "pos", "content_hash")


@query(f"WITH {S.CONVERSATIONS} SELECT kind, count(*) AS n FROM conv_ctx GROUP BY 1")
def role_to_kind_counts(spark, sf_dir):
    return A.conversations_context(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{m}'" for m in ("the ", "and ", "la ", "der ")) + " END AS marker FROM documents")
def critical_marker_scan(spark, sf_dir):
    """The first of some frequent words, as the driver's texts have none of the real markers."""
    return A.table(spark, sf_dir, "documents").select("doc_id", T.first_marker(F.col("text"), ("the ", "and ", "la ", "der ")).alias("marker"))


@query(f"WITH {S.EVENTS} SELECT context_id, pos, list_sort(list_distinct(regexp_extract_all(content, '{S.FIGURE}'))) AS figures FROM events_ctx WHERE regexp_matches(content, '{S.FIGURE}')")
def financial_figures(spark, sf_dir):
    found = A.events_context(spark, sf_dir).withColumn("figures", F.array_sort(T.financial_figures(F.col("content"))))
    return found.where(F.size("figures") > 0).select("context_id", "pos", "figures")


@query(f"WITH {S.EVENTS} SELECT context_id, pos, content FROM events_ctx WHERE kind = 'tool_output' AND {S.NOISY}")
def tool_noise_filter(spark, sf_dir):
    return A.events_context(spark, sf_dir).where((F.col("kind") == "tool_output") & T.is_noise(F.col("content"))).select("context_id", "pos", "content")


@query("SELECT model, coalesce(max(w), 128000) AS window FROM (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'GPT-4o-2024' WHEN 'view' THEN 'gpt-4-turbo-x' WHEN 'error' THEN 'o200k' ELSE 'other-' || event_type END AS model FROM events) m LEFT JOIN (VALUES ('gpt-4o', 128000), ('gpt-4-turbo', 128000), ('o200k', 128000)) t(p, w) ON starts_with(lower(model), p) GROUP BY 1")
def model_window_prefix_join(spark, sf_dir):
    kind = F.col("event_type")
    model = F.when(kind == "click", "GPT-4o-2024").when(kind == "view", "gpt-4-turbo-x").when(kind == "error", "o200k").otherwise(F.concat(F.lit("other-"), kind))
    windows = rows(spark, list(T.MODEL_WINDOWS), "prefix string, window int")  # a fixed table of a few rows
    models = A.table(spark, sf_dir, "events").select(model.alias("model")).distinct()
    found = models.join(F.broadcast(windows), F.lower("model").startswith(F.col("prefix")), "left")
    return found.groupBy("model").agg(F.coalesce(F.max("window"), F.lit(T.DEFAULT_WINDOW)).alias("window"))


# the context pipeline


def _classified(spark, sf_dir):
    return context.classify(context.measure(A.events_context(spark, sf_dir)))


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.DEDUPED}, {S.classified('deduped')} SELECT context_id, " + ", ".join(f"coalesce(sum(token_count) FILTER (WHERE relevance = '{b}'), 0)::BIGINT AS {b}" for b in context.BUCKETS) + " FROM classified GROUP BY 1")
def relevance_breakdown_events(spark, sf_dir):
    return context.breakdown(context.classify(context.dedup(context.measure(A.events_context(spark, sf_dir)))))


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.classified('measured')} SELECT context_id, pos, relevance FROM classified")
def classify_events(spark, sf_dir):
    return _classified(spark, sf_dir).select("context_id", "pos", "relevance")


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.DEDUPED} SELECT context_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY context_id) AS total FROM deduped) WHERE total > 10 AND original_index >= total - greatest(3, total // 10)")
def recency_window(spark, sf_dir):
    items = context.dedup(context.measure(A.events_context(spark, sf_dir)))
    return context.classify(items.withColumn("kind", F.lit("agent_message")).withColumn("content", F.lit("plain"))).where("relevance_reason = 'most recent exchange'").select("context_id", "pos")


@query(f"WITH {S.DOCUMENTS}, {S.measured('docs_ctx')}, {S.DEDUPED}, {S.classified('deduped')} SELECT context_id, pos, {S.SHORTENED} AS content, {S.tokens(S.SHORTENED)} AS token_count FROM classified")
def compress_long_items(spark, sf_dir):
    items = saved(context.dedup(context.measure(A.documents_context(spark, sf_dir))), "deduped")
    return context.compress(context.classify(items, few=True)).select("context_id", "pos", "content", "token_count")


@query(f"WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)} SELECT context_id, pos, after AS token_count FROM kept")
def budget_enforce(spark, sf_dir):
    return context.run(A.events_context(spark, sf_dir), budget=BUDGET).select("context_id", "pos", "token_count")


@query(f"WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)} SELECT context_id, pos, placed, relevance FROM placed")
def place_lost_in_middle(spark, sf_dir):
    return context.run(A.events_context(spark, sf_dir), budget=BUDGET).select("context_id", "pos", "placed", "relevance")


_LEDGER = """SELECT context_id, stage_no, stage, ib AS items_before, ia AS items_after, tb AS tokens_before, ta AS tokens_after FROM sums, LATERAL (VALUES
 (0, 'dedup', i0, i1, t0, t1), (1, 'classify', i1, i1, t1, t1), (2, 'filter_tool_output', i1, i2, t1, t2), (3, 'compress', i2, i2, t2, t3), (4, 'budget', i2, i4, t3, t4), (5, 'place', i4, i4, t4, t4)) s(stage_no, stage, ib, ia, tb, ta)"""


@query(f"""WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)},
sums AS (SELECT context_id, (SELECT count(*) FROM measured m WHERE m.context_id = c.context_id) AS i0, (SELECT sum(token_count)::BIGINT FROM measured m WHERE m.context_id = c.context_id) AS t0, count(*) AS i1, sum(token_count)::BIGINT AS t1,
 (SELECT count(*) FROM shortened s WHERE s.context_id = c.context_id) AS i2, (SELECT coalesce(sum(token_count), 0)::BIGINT FROM shortened s WHERE s.context_id = c.context_id) AS t2, (SELECT coalesce(sum(after), 0)::BIGINT FROM shortened s WHERE s.context_id = c.context_id) AS t3,
 (SELECT count(*) FROM kept k WHERE k.context_id = c.context_id) AS i4, (SELECT coalesce(sum(after), 0)::BIGINT FROM kept k WHERE k.context_id = c.context_id) AS t4 FROM classified c GROUP BY context_id) {_LEDGER}""")
def context_pipeline_ledger(spark, sf_dir):
    return context.ledger(A.events_context(spark, sf_dir), budget=BUDGET)


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, used AS (SELECT *, sum(token_count) OVER (PARTITION BY context_id ORDER BY pos DESC) AS u, row_number() OVER (PARTITION BY context_id ORDER BY pos DESC) AS n FROM measured) SELECT context_id, pos FROM used WHERE u <= 100 OR n = 1")
def tail_truncate(spark, sf_dir):
    return context.tail_truncate(context.measure(A.events_context(spark, sf_dir)), 100).select("context_id", "pos")


# ranking


def _documents(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", "text")


_BM25 = S.bm25(f"SELECT 0 AS query_id, '{TASK}' AS query", "SELECT doc_id, text FROM documents")


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, rank FROM ranked")
def bm25_scores(spark, sf_dir):
    found = ranking.bm25(rows(spark, [(0, TASK)], "query_id int, query string"), _documents(spark, sf_dir))
    return found.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk_documents(spark, sf_dir):
    return bm25_scores(spark, sf_dir).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(10)


_COSINE = """vectors AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM vectors WHERE doc_id = 0),
cosines AS (SELECT doc_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) AS score FROM vectors, q)"""


def _vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_COSINE} SELECT doc_id, round(score, 6) AS score FROM cosines")
def cosine_rank_embeddings(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    found = ranking.vector_rank(vectors.where("doc_id = 0").select("vector"), vectors)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def vector_search_embeddings(spark, sf_dir):
    """The ten nearest rows of every row whose id is divisible by 20."""
    vectors = _vectors(spark, sf_dir)
    found = ranking.vector_search(vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), vectors, k=10)
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}, {_COSINE}, sem AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS sr FROM cosines), lex AS (SELECT doc_id, rank AS lr FROM ranked)
SELECT doc_id, round(coalesce(1.0 / (60 + lr), 0) + coalesce(1.0 / (60 + sr), 0), 6) AS fused, CASE WHEN lr IS NULL THEN 'semantic' WHEN sr IS NULL THEN 'lexical' ELSE 'hybrid' END AS method FROM lex FULL JOIN sem USING (doc_id)""")
def rrf_hybrid(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    semantic = ranking.vector_rank(vectors.where("doc_id = 0").select("vector"), vectors)
    lexical = ranking.bm25(rows(spark, [(0, TASK)], "query_id int, query string"), _documents(spark, sf_dir))
    return ranking.fuse(lexical, semantic).select("doc_id", F.round("fused", 6).alias("fused"), "method")


@query(f"""WITH {S.bm25("SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 20 = 0", "SELECT item_id AS doc_id, text FROM benchmark")},
own AS (SELECT query_id, sum(times * ln(4.0 / 3) * times * 2.5 / (times + 1.5)) AS self_score FROM asked GROUP BY 1)
SELECT query_id, doc_id AS item_id, round(score / self_score, 6) AS similarity, round(least(score / self_score, 0.85), 2) AS confidence FROM ranked JOIN own USING (query_id) WHERE score / self_score >= 0.15""")
def statement_resurfacing(spark, sf_dir):
    """Texts (every id divisible by 20, a stated query set) that resemble recorded statements."""
    asked = A.table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    items = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    found = ranking.resemblances(asked, items)
    return found.select("query_id", F.col("doc_id").alias("item_id"), F.round("similarity", 6).alias("similarity"), "confidence")


@query(f"""WITH {S.bm25("SELECT item_id AS query_id, text AS query FROM benchmark", "SELECT doc_id, text FROM documents")},
own AS (SELECT query_id, sum(times * ln(4.0 / 3) * times * 2.5 / (times + 1.5)) AS self_score FROM asked GROUP BY 1)
SELECT query_id AS item_id, doc_id, round(least(score / self_score, 0.85), 2) AS confidence FROM ranked JOIN own USING (query_id) WHERE score / self_score >= 0.15""")
def hard_constraint_check(spark, sf_dir):
    """Texts that resemble a hard constraint; all documents stand for hard ones."""
    hard = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ranking.resemblances(asked, hard).select(F.col("query_id").alias("item_id"), "doc_id", "confidence")


# health and statistics

_RATIO = "CASE WHEN {w} <= 0 THEN 0 ELSE round(greatest(0, least(1, {p}::DOUBLE / {w})), 4) END"


@query(f"""WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.classified('measured')},
sums AS (SELECT context_id, sum(token_count)::BIGINT AS total_tokens, coalesce(sum(token_count) FILTER (WHERE relevance IN ('critical', 'relevant')), 0) AS useful, coalesce(sum(token_count) FILTER (WHERE relevance IN ('redundant', 'obsolete')), 0) AS wasted,
 coalesce(sum(token_count) FILTER (WHERE kind = 'tool_output' AND relevance <> 'critical'), 0) AS tool FROM classified GROUP BY 1),
r AS (SELECT context_id, total_tokens, {_RATIO.format(p='total_tokens', w=1000)} AS window_usage, {_RATIO.format(p='useful', w='total_tokens')} AS relevant_ratio, 1.0::DOUBLE AS critical_retained, {_RATIO.format(p='wasted', w='total_tokens')} AS redundancy, {_RATIO.format(p='tool', w='total_tokens')} AS tool_noise FROM sums)
SELECT *, round(0.35 + 0.25 * relevant_ratio + 0.15 * (1 - redundancy) + 0.15 * (1 - tool_noise) + 0.10 * (1 - window_usage), 3) AS score FROM r""")
def context_health(spark, sf_dir):
    return health.health(_classified(spark, sf_dir), window=1000)


@query(f"""WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)} SELECT c.context_id, coalesce(count(k.pos) FILTER (WHERE c.relevance = 'critical') / nullif(count(*) FILTER (WHERE c.relevance = 'critical'), 0), 1.0)::DOUBLE AS critical_retention
FROM classified c LEFT JOIN kept k ON c.context_id = k.context_id AND c.pos = k.pos GROUP BY 1""")
def critical_retention(spark, sf_dir):
    items = A.events_context(spark, sf_dir)
    return health.critical_retention(context.classify(context.dedup(context.measure(items))), context.run(items, budget=BUDGET))


@query(f"""WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)}, b AS (SELECT DISTINCT context_id, unnest(regexp_extract_all(content, '{S.FIGURE}')) AS f FROM classified), a AS (SELECT DISTINCT context_id, unnest(regexp_extract_all(short, '{S.FIGURE}')) AS f, 1 AS k FROM kept),
s AS (SELECT context_id, count(k) / count(*) AS share FROM b LEFT JOIN a USING (context_id, f) GROUP BY 1) SELECT context_id, coalesce(share, 1.0)::DOUBLE AS digit_retention FROM (SELECT DISTINCT context_id FROM classified) LEFT JOIN s USING (context_id)""")
def digit_retention(spark, sf_dir):
    items = A.events_context(spark, sf_dir)
    return health.digit_retention(context.classify(context.dedup(context.measure(items))), context.run(items, budget=BUDGET))


_SHARE = f"shares AS (SELECT context_id, {_RATIO.format(p='''coalesce(sum(token_count) FILTER (WHERE relevance = 'redundant'), 0)''', w='sum(token_count)')} AS duplicate_share, count(*) AS items FROM raw GROUP BY 1)"
_RAW = S.classified("measured").replace("classified AS", "raw AS").replace("ruled", "ruled_raw")


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, {_RAW}, {_SHARE} SELECT * FROM shares")
def duplicate_share(spark, sf_dir):
    return health.duplicate_share(_classified(spark, sf_dir))


@query(f"""WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)}, {_RAW}, {_SHARE}, b AS (SELECT context_id, sum(token_count) AS tb FROM measured GROUP BY 1), a AS (SELECT context_id, sum(after) AS ta FROM kept GROUP BY 1),
w AS (SELECT *, (duplicate_share > 0.5 OR items < 20)::INT AS warned FROM shares JOIN b USING (context_id) LEFT JOIN a USING (context_id))
SELECT count(*) AS cases, sum(tb)::BIGINT AS tokens_before, sum(coalesce(ta, 0))::BIGINT AS tokens_after, round((sum(tb) - sum(coalesce(ta, 0))) / sum(tb)::DOUBLE, 4) AS reduction_ratio, sum(warned)::BIGINT AS warned_cases, count(*) >= 3 AND sum(warned) = 0 AS publishable FROM w""")
def corpus_report(spark, sf_dir):
    items = A.events_context(spark, sf_dir)
    before = context.measure(items).groupBy("context_id").agg(F.sum("token_count").alias("tokens_before"))
    after = context.run(items, budget=BUDGET).groupBy("context_id").agg(F.sum("token_count").alias("tokens_after"))
    cases = before.join(after, "context_id", "left").join(health.duplicate_share(_classified(spark, sf_dir)), "context_id").withColumn("tokens_after", F.coalesce("tokens_after", F.lit(0)))
    return health.corpus_report(cases)


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.classified('measured')}, s AS (SELECT context_id, sum(token_count) AS t, coalesce(sum(token_count) FILTER (WHERE relevance IN ('critical', 'relevant')), 0) AS u FROM classified GROUP BY 1) SELECT context_id, CASE WHEN round(least(1, t / 1000.0), 4) >= 0.75 THEN 'window_usage' WHEN round(u / t::DOUBLE, 4) <= 0.5 THEN 'relevant_ratio' ELSE 'none' END AS reason FROM s")
def surfacing_trigger(spark, sf_dir):
    return health.surfacing_trigger(context_health(spark, sf_dir))


_VARIANCE = "count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stdev, round(min(value), 4) AS min, round(max(value), 4) AS max"


@query(f"WITH {S.METRICS} SELECT condition, metric, {_VARIANCE} FROM metrics GROUP BY 1, 2")
def metric_variance(spark, sf_dir):
    return stats.metric_variance(A.label_metrics(spark, sf_dir), by=("condition",))


@query(f"""WITH {S.METRICS}, w AS (SELECT metric, count(*) AS n_within, round(min(value), 4) AS floor_min, round(max(value), 4) AS floor_max FROM metrics WHERE condition = 'en' GROUP BY 1), b AS (SELECT metric, count(*) AS n_between, round(avg(value), 4) AS between_mean FROM metrics WHERE condition = 'fr' GROUP BY 1)
SELECT metric, n_within, floor_min, floor_max, n_between, between_mean, CASE WHEN coalesce(n_within, 0) < 2 OR n_between IS NULL THEN 'insufficient_data' WHEN between_mean < floor_min OR between_mean > floor_max THEN 'likely_real_difference' ELSE 'indistinguishable_from_noise' END AS verdict FROM w FULL JOIN b USING (metric)""")
def noise_floor_compare(spark, sf_dir):
    metrics = A.label_metrics(spark, sf_dir)
    return stats.against_noise_floor(metrics.where("condition = 'en'"), metrics.where("condition = 'fr'"))


@query(f"""WITH {S.EVENTS}, {S.pipeline('events_ctx', BUDGET)}, {_RAW}, {_SHARE},
crit AS (SELECT c.context_id, coalesce(count(k.pos) FILTER (WHERE c.relevance = 'critical') / nullif(count(*) FILTER (WHERE c.relevance = 'critical'), 0), 1.0) AS share FROM classified c LEFT JOIN kept k ON c.context_id = k.context_id AND c.pos = k.pos GROUP BY 1),
b AS (SELECT DISTINCT context_id, unnest(regexp_extract_all(content, '{S.FIGURE}')) AS f FROM classified), a AS (SELECT DISTINCT context_id, unnest(regexp_extract_all(short, '{S.FIGURE}')) AS f, 1 AS k FROM kept),
figs AS (SELECT context_id, count(k) / count(*) AS figs FROM b LEFT JOIN a USING (context_id, f) GROUP BY 1)
SELECT context_id, list_filter([CASE WHEN duplicate_share > 0.5 THEN 'duplicates' END, CASE WHEN items < 20 THEN 'few_items' END, CASE WHEN share < 1 THEN 'critical_lost' END, CASE WHEN coalesce(figs, 1) < 1 THEN 'figures_lost' END], lambda x: x IS NOT NULL) AS warnings
FROM shares JOIN crit USING (context_id) LEFT JOIN figs USING (context_id)""")
def case_warnings(spark, sf_dir):
    """The reasons not to publish each context's figures."""
    cases = health.duplicate_share(_classified(spark, sf_dir)).join(critical_retention(spark, sf_dir), "context_id").join(digit_retention(spark, sf_dir), "context_id")
    return health.case_warnings(cases).select("context_id", "warnings")


# memory


@query(f"WITH {S.LOG} SELECT record_type, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active FROM log GROUP BY 1")
def log_summary(spark, sf_dir):
    return memory.summary(A.event_log(spark, sf_dir))


@query(f"WITH {S.LOG} SELECT id, record_type FROM log WHERE status = 'active'")
def active_decisions(spark, sf_dir):
    return memory.active(A.event_log(spark, sf_dir)).select("id", "record_type")


@query(f"WITH {S.LOG} SELECT id FROM log WHERE record_type = 'error'")
def typed_scan(spark, sf_dir):
    return memory.typed(A.event_log(spark, sf_dir), "error").select("id")


@query(f"WITH {S.LOG} SELECT id, status, CASE WHEN id IN (SELECT supersedes FROM log WHERE supersedes IS NOT NULL) THEN 'superseded' ELSE status END AS effective_status FROM log")
def effective_status_chain(spark, sf_dir):
    return memory.effective_status(A.event_log(spark, sf_dir))


@query(f"WITH {S.LOG} SELECT id, record_type FROM log WHERE (record_type <> 'decision' OR status = 'active') AND id NOT IN (SELECT id FROM log WHERE id % 3 <> 0)")
def snapshot_restore_antijoin(spark, sf_dir):
    log = A.event_log(spark, sf_dir)
    return memory.restore(log.where("id % 3 <> 0"), memory.snapshot(log, 1)).select("id", "record_type")


@query(f"WITH {S.LOG} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS n FROM log) WHERE n = 1")
def latest_wins_upsert(spark, sf_dir):
    return memory.latest(A.event_log(spark, sf_dir), ("user_id",), ("ts", "id")).select("user_id", "id")


_CUTS = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH {S.LOG}, s AS (SELECT user_id AS store_id, {", ".join(f"coalesce(sum({S.tokens('payload')}) FILTER (WHERE record_type = '{t}'), 0) AS c{i}" for i, t in enumerate(_CUTS))} FROM log GROUP BY 1),
l AS (SELECT store_id, level, tokens FROM s, LATERAL (VALUES {", ".join(f"({k}, {' + '.join([f'c{i}' for i in range(k, 5)] + ['0'])})" for k in range(6))}) v(level, tokens))
SELECT store_id, coalesce(min(level) FILTER (WHERE tokens <= 60), 5)::INT AS cut_level, coalesce(min_by(tokens, level) FILTER (WHERE tokens <= 60), 0)::BIGINT AS tokens FROM l GROUP BY 1""")
def handoff_cascade(spark, sf_dir):
    records = A.event_log(spark, sf_dir).select(F.col("user_id").alias("store_id"), "record_type", T.estimate_tokens(F.col("payload")).alias("tokens"))
    return memory.handoff_level(records, 60, _CUTS)


@query(f"""WITH RECURSIVE {S.LOG}, c AS (SELECT user_id AS store_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rank, (1 + id % 9)::BIGINT AS tokens FROM log),
f AS (SELECT store_id, 0::BIGINT AS rank, 0::BIGINT AS used, NULL::BIGINT AS id FROM (SELECT DISTINCT store_id FROM c)
 UNION ALL SELECT c.store_id, c.rank, CASE WHEN f.used + c.tokens <= 50 THEN f.used + c.tokens ELSE f.used END, CASE WHEN f.used + c.tokens <= 50 THEN c.id END FROM f JOIN c ON c.store_id = f.store_id AND c.rank = f.rank + 1)
SELECT store_id, id FROM f WHERE id IS NOT NULL""")
def first_fit_select(spark, sf_dir):
    from pyspark.sql import Window

    log = A.event_log(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return memory.first_fit(log.select(F.col("user_id").alias("store_id"), rank.alias("rank"), "id", (1 + F.col("id") % 9).cast("long").alias("tokens")), 50)


# graphs


@query(f"WITH {S.STAR} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 2")
def graph_stats(spark, sf_dir):
    return graph.stats(*A.star_graph(spark, sf_dir))


@query(f"WITH {S.STAR} SELECT DISTINCT w.source AS start, w.target AS id FROM ways w JOIN nodes n ON n.id = w.target WHERE starts_with(w.source, 'nation:')")
def graph_neighbours(spark, sf_dir):
    nodes, edges = A.star_graph(spark, sf_dir)
    return graph.neighbours(nodes, edges, nodes.where("kind = 'nation'").select("id")).select("start", "id")


@query(f"WITH {S.STAR} SELECT target AS id, count(DISTINCT source) AS callers FROM edges WHERE kind = 'calls' GROUP BY 1")
def graph_callers_degree(spark, sf_dir):
    return graph.degrees(A.star_graph(spark, sf_dir)[1], "calls")


@query(f"""WITH {S.STAR}, one AS (SELECT DISTINCT source AS start, target AS id, 1 AS depth FROM edges WHERE starts_with(source, 'nation:') OR starts_with(source, 'region:')),
two AS (SELECT DISTINCT o.start, e.target AS id, 2 AS depth FROM one o JOIN edges e ON o.id = e.source) SELECT start, id, min(depth)::INT AS depth FROM (FROM one UNION ALL FROM two) WHERE start <> id GROUP BY 1, 2""")
def graph_bfs_depth2(spark, sf_dir):
    nodes, edges = A.star_graph(spark, sf_dir)
    return graph.reachable(edges, nodes.where("kind IN ('nation', 'region')").select("id"), 2, direction="out")


_RING = "hops AS (SELECT DISTINCT 'n' || (event_id % 40) AS source, 'n' || ((event_id * 7 + user_id) % 40) AS target FROM events)"


@query(f"""WITH {_RING}, two AS (SELECT [a.source, a.target] AS path FROM hops a JOIN hops b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target),
three AS (SELECT [a.source, a.target, b.target] AS path FROM hops a JOIN hops b ON a.target = b.source JOIN hops c ON b.target = c.source AND c.target = a.source WHERE a.source < a.target AND a.source < b.target AND a.target <> b.target)
SELECT [source] AS path FROM hops WHERE source = target UNION ALL FROM two UNION ALL FROM three""")
def graph_cycles(spark, sf_dir):
    ring = A.table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.col("event_id") % 40).alias("source"), F.concat(F.lit("n"), (F.col("event_id") * 7 + F.col("user_id")) % 40).alias("target"))
    return graph.cycles(ring, 3)


@query(f"WITH {S.STAR} SELECT id, name FROM nodes WHERE kind IN ('part', 'supplier') AND name NOT LIKE '\\_%' ESCAPE '\\' AND id NOT IN (SELECT target FROM edges WHERE kind = 'tests')")
def graph_untested(spark, sf_dir):
    return graph.untested(*A.star_graph(spark, sf_dir), ("part", "supplier")).select("id", "name")


@query(f"WITH {S.PAGES} SELECT DISTINCT page_id, href FROM links WHERE href NOT IN (SELECT path FROM paths)")
def graph_unresolved(spark, sf_dir):
    nodes, links = A.page_graph(spark, sf_dir)
    return links.distinct().join(nodes.select(F.col("path").alias("href")).distinct(), "href", "left_anti").select("page_id", "href")


@query(f"WITH {S.STAR} SELECT id, name FROM nodes WHERE name ILIKE '%an%' ORDER BY length(name), name, id LIMIT 20")
def graph_search_like(spark, sf_dir):
    return graph.search(A.star_graph(spark, sf_dir)[0], "an", 20).select("id", "name")


@query(f"""WITH {S.STAR}, wanted AS (SELECT * FROM (VALUES ('FRANCE'), ('ASIA'), ('Customer#00000001'), ('nothing like this')) v(wanted)), exact AS (SELECT wanted, id, 0 AS tier FROM wanted JOIN nodes ON wanted = name)
SELECT * FROM exact UNION ALL SELECT wanted, id, 1 FROM wanted JOIN nodes ON contains(lower(name), lower(wanted)) WHERE wanted NOT IN (SELECT wanted FROM exact)""")
def graph_define(spark, sf_dir):
    names = rows(spark, [("FRANCE",), ("ASIA",), ("Customer#00000001",), ("nothing like this",)], "wanted string")
    return graph.define(A.star_graph(spark, sf_dir)[0], names)


@query(f"""WITH RECURSIVE {S.STAR}, {S.contexts("SELECT 0 AS task_id, 'nation region asia africa' AS task", "SELECT id, name, kind || ' ' || name AS text, true AS wanted, '' AS place FROM nodes", "SELECT * FROM edges WHERE kind = 'contains'")} SELECT id, score, depth FROM answers""")
def graph_context_for(spark, sf_dir):
    """Places and sellers for a task, found by name and then along the graph."""
    nodes, edges = A.star_graph(spark, sf_dir)
    return graph.context_for(nodes.withColumn("text", F.concat_ws(" ", "kind", "name")), edges.where("kind = 'contains'"), "nation region asia africa", 20, 2).withColumn("score", F.round("score", 6))


@query(f"WITH {S.STAR}, p AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains'), u AS (SELECT source AS id, list_sort(list(target)) AS uses FROM p GROUP BY 1), b AS (SELECT target AS id, list_sort(list(source)) AS used_by FROM p GROUP BY 1) SELECT id, coalesce(uses, []) AS uses, coalesce(used_by, []) AS used_by FROM u FULL JOIN b USING (id)")
def file_dependencies(spark, sf_dir):
    return graph.dependencies(A.star_graph(spark, sf_dir)[1].where("kind = 'contains'"))


@query("""WITH n AS (SELECT 'u' || user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'function' END AS kind FROM events GROUP BY user_id), e AS (SELECT DISTINCT 'u' || user_id AS source, 'u' || (user_id * 5 + event_id) % 200 AS target FROM events)
SELECT DISTINCT source, target, 'tests' AS kind FROM e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target WHERE s.kind = 'test' AND t.kind <> 'test'""")
def link_tests_join(spark, sf_dir):
    events = A.table(spark, sf_dir, "events")
    nodes = events.select("user_id").distinct().select(F.concat(F.lit("u"), "user_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "test").otherwise("function").alias("kind"))
    edges = events.select(F.concat(F.lit("u"), "user_id").alias("source"), F.concat(F.lit("u"), (F.col("user_id") * 5 + F.col("event_id")) % 200).alias("target"), F.lit("calls").alias("kind")).distinct()
    return graph.link_tests(nodes, edges)


@query(f"WITH {S.STAR} SELECT id FROM nodes WHERE kind = 'part' AND id NOT IN (SELECT target FROM edges)")
def orphan_antijoin(spark, sf_dir):
    return graph.orphans(*A.star_graph(spark, sf_dir), "part").select("id")


@query("""WITH d AS (SELECT p_name AS name, 'part:' || p_partkey AS id FROM part), u AS (SELECT name, min(id) AS target FROM d GROUP BY 1 HAVING count(*) = 1)
SELECT 'line:' || l_orderkey || ':' || l_linenumber AS source, p_name AS name, target, target IS NOT NULL AS resolved FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN u ON u.name = p_name""")
def resolve_unique_name(spark, sf_dir):
    part, lines = A.table(spark, sf_dir, "part"), A.table(spark, sf_dir, "lineitem")
    references = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber").alias("source"), F.col("p_name").alias("name"))
    return graph.resolve_unique(references, part.select(F.col("p_name").alias("name"), F.concat(F.lit("part:"), "p_partkey").alias("id")))


# rules and risk


@query(f"""WITH {S.STAR}, pk AS (SELECT 'customer:' || c_custkey AS id, c_mktsegment AS package FROM customer UNION ALL SELECT 'part:' || p_partkey, p_brand FROM part), pol AS (SELECT * FROM (VALUES ('BUILDING', 'Brand#11'), ('BUILDING', 'Brand#12'), ('MACHINERY', '*')) v(package, allowed))
SELECT source, target, a.package AS from_package, b.package AS to_package FROM edges JOIN pk a ON a.id = source JOIN pk b ON b.id = target WHERE kind = 'tests' AND a.package <> b.package AND b.package <> 'Brand#13' AND a.package NOT IN (SELECT package FROM pol WHERE allowed = '*') AND NOT EXISTS (SELECT 1 FROM pol p WHERE p.package = a.package AND p.allowed = b.package)""")
def architecture_policy_antijoin(spark, sf_dir):
    customers = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("package"))
    packages = customers.unionByName(A.table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("package")))
    policy = rows(spark, [("BUILDING", "Brand#11"), ("BUILDING", "Brand#12"), ("MACHINERY", "*")], "package string, allowed string")
    return rules.policy_breaches(A.star_graph(spark, sf_dir)[1].where("kind = 'tests'").select("source", "target"), packages, policy, "Brand#13")


@query(f"""WITH {S.STAR}, u AS (SELECT id AS unit, CASE WHEN name LIKE '%1' THEN 'api' END AS path_marker FROM nodes WHERE kind IN ('part', 'supplier')),
c AS (SELECT target AS unit, count(DISTINCT source) AS callers FROM edges WHERE kind = 'calls' GROUP BY 1), f AS (SELECT target AS unit, count(DISTINCT source) AS fan_in FROM edges WHERE kind = 'contains' GROUP BY 1),
x AS (SELECT u.*, coalesce(callers, 0) AS callers, coalesce(fan_in, 0) AS fan_in, CASE WHEN unit IN (SELECT target FROM edges WHERE kind = 'tests') THEN 0 ELSE 1 END AS untested FROM u LEFT JOIN c USING (unit) LEFT JOIN f USING (unit)),
r AS (SELECT unit, path_marker, list_filter([CASE WHEN path_marker IS NOT NULL THEN 'path:' || path_marker END, CASE WHEN callers >= 3 THEN 'callers' END, CASE WHEN fan_in >= 2 THEN 'fan_in' END, CASE WHEN untested > 0 THEN 'untested' END], lambda v: v IS NOT NULL) AS reasons FROM x)
SELECT unit, CASE WHEN path_marker IS NOT NULL THEN 'high' WHEN len(reasons) > 0 THEN 'medium' ELSE 'low' END AS tier, reasons FROM r""")
def risk_tier(spark, sf_dir):
    nodes, edges = A.star_graph(spark, sf_dir)
    units = nodes.where("kind IN ('part', 'supplier')").select(F.col("id").alias("unit"), F.when(F.col("name").endswith("1"), "api").alias("path_marker"))
    tested = edges.where("kind = 'tests'").select(F.col("target").alias("unit")).distinct().withColumn("t", F.lit(1))
    degree = lambda kind, name: graph.degrees(edges, kind).select(F.col("id").alias("unit"), F.col("callers").alias(name))
    joined = units.join(degree("calls", "callers"), "unit", "left").join(degree("contains", "fan_in"), "unit", "left").join(tested, "unit", "left")
    return rules.risk_tier(joined.select("unit", "path_marker", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.when(F.col("t").isNull(), 1).otherwise(0).alias("untested")))


_RULES = [("r1", "PRE: click, view; POST: purchase", "low"), ("r2", "PRE: error; POST: signup", "high"), ("r3", "PRE: ; POST: view", "medium"), ("r4", "PRE: purchase; POST: loyal", "odd")]


def _rules(spark):
    return rules.parse_rules(rows(spark, _RULES, "id string, formal_spec string, risk_tier string"))


def _facts(spark, sf_dir):
    return A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit")).agg(F.array_sort(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")).otherwise(F.concat("event_type", F.lit("_low"))))).alias("facts"))


@query("SELECT 'part' || p_partkey AS id FROM part WHERE p_partkey % 4 <> 2")
def rules_for_tier(spark, sf_dir):
    """A rule for each part, of four kinds of tiers; those that a medium tier runs."""
    k = F.col("p_partkey")
    tier = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("odd")
    return rules.rules_for_tier(A.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), k).alias("id"), tier.alias("risk_tier")), "medium").select("id")


_FACTS = "facts AS (SELECT user_id AS unit, list_sort(list(DISTINCT CASE WHEN value > 50 THEN event_type ELSE event_type || '_low' END)) AS facts FROM events GROUP BY 1), rules AS (SELECT * FROM (VALUES ('r1', ['click', 'view'], 'purchase'), ('r2', ['error'], 'signup'), ('r3', [], 'view'), ('r4', ['purchase'], 'loyal')) v(id, pre, post))"


@query(f"WITH {_FACTS} SELECT id AS rule_id, unit, CASE WHEN NOT list_has_all(facts, pre) THEN 'unknown' WHEN list_contains(facts, post) THEN 'pass' ELSE 'fail' END AS status FROM facts, rules")
def rule_violations(spark, sf_dir):
    return rules.violations(_rules(spark), _facts(spark, sf_dir))


@query("""WITH facts AS (SELECT user_id AS unit, list(DISTINCT CASE WHEN value > 50 THEN event_type ELSE event_type || '_low' END) AS f FROM events GROUP BY 1), a AS (SELECT unit, list_distinct(list_concat(f, ['view'], CASE WHEN list_contains(f, 'error') THEN ['signup'] ELSE [] END)) AS f FROM facts),
b AS (SELECT unit, list_distinct(list_concat(f, CASE WHEN list_contains(f, 'click') THEN ['purchase'] ELSE [] END)) AS f FROM a) SELECT unit, list_sort(list_distinct(list_concat(f, CASE WHEN list_contains(f, 'purchase') THEN ['loyal'] ELSE [] END))) AS facts FROM b""")
def rule_fixpoint(spark, sf_dir):
    return rules.infer(_rules(spark), _facts(spark, sf_dir))


# transcripts, claims and code, from texts that are made of the tables' rows

_LINES = """lines AS (SELECT conv_id AS context_id, turn AS line_no, role, text, CASE WHEN turn % 5 = 4 THEN 'unparseable' WHEN role = 'system' THEN 'system' WHEN turn % 3 = 2 THEN role || '_without_message' ELSE 'item' END AS outcome FROM conversations)"""


def _session(spark, sf_dir):
    """Conversations as event lines: some aren't JSON, some have no message, some have their content in blocks."""
    talk = A.table(spark, sf_dir, "conversations")
    whole = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    blocks = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    bare = F.to_json(F.struct(F.col("role").alias("type")))
    value = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{broken "), "text")).when((F.col("turn") % 3 == 2) & (F.col("role") != "system"), bare).when(F.col("turn") % 2 == 1, blocks).otherwise(whole)
    return talk.select(F.col("conv_id").alias("context_id"), F.col("turn").alias("line_no"), value.alias("value"))


@query(f"WITH {_LINES} SELECT context_id, row_number() OVER (PARTITION BY context_id ORDER BY line_no) - 1 AS pos, CASE role WHEN 'user' THEN 'user_message' ELSE 'agent_message' END AS kind, text AS content FROM lines WHERE outcome = 'item' AND trim(text) <> ''")
def jsonl_event_parse(spark, sf_dir):
    return transcripts.from_session(_session(spark, sf_dir))


@query(f"WITH {_LINES} SELECT context_id, outcome AS reason, count(*) AS n FROM lines WHERE outcome <> 'item' GROUP BY 1, 2")
def skipped_line_counts(spark, sf_dir):
    return transcripts.skipped(_session(spark, sf_dir))


@query(f"WITH {S.CONVERSATIONS} SELECT context_id, row_number() OVER (PARTITION BY context_id ORDER BY pos) - 1 AS pos, kind, content FROM conv_ctx")
def message_list_parse(spark, sf_dir):
    """Each conversation as one JSON list of messages, read back."""
    talk = A.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    raw = talk.groupBy(F.col("conv_id").alias("context_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("raw"))
    return transcripts.from_messages(raw)


@query("SELECT conv_id AS context_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, coalesce(text, '') || repeat(chr(10) || 'after', 1 + 4 * turn::INT) AS content FROM conversations WHERE trim(coalesce(text, '') || repeat('after', turn::INT)) <> ''")
def deep_tool_results(spark, sf_dir):
    """Each turn inside results of tools that hold results of tools, 1 to 29 deep and deeper."""
    talk = A.table(spark, sf_dir, "conversations")
    depth = (1 + 4 * F.col("turn")).cast("int")
    leaf = F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    block = F.concat(F.repeat(F.lit('{"type":"tool_result","content":['), depth), leaf, F.repeat(F.lit(',{"type":"text","text":"after"}]}'), depth))
    value = F.concat(F.lit('{"type":"user","message":{"role":"user","content":['), block, F.lit("]}}"))
    return transcripts.from_session(talk.select(F.col("conv_id").alias("context_id"), F.col("turn").alias("line_no"), value.alias("value"))).select("context_id", "pos", "content")


_STATED = """t AS (SELECT s_suppkey AS k, (s_suppkey * 7) % 50 + 1 AS a, (s_suppkey * 3) % 50 + 1 AS b, (s_suppkey * 11) % 50 + 1 AS c FROM supplier),
claims AS (SELECT k AS text_id, 'symbol_relation' AS kind, 's' || k AS subject, 'calls' AS relation, 'p' || c AS target, true AS negated FROM t UNION ALL SELECT k, 'symbol_relation', 's' || k, 'calls', 'p' || a, false FROM t UNION ALL SELECT k, 'symbol_relation', 's' || k, 'calls', 'p' || b, false FROM t
 UNION ALL SELECT k, 'symbol_exists', 's' || (k + 5), NULL, NULL, false FROM t UNION ALL SELECT k, 'file_exists', 'parts/p' || k || '.py', NULL, NULL, false FROM t)"""


def _claim_texts(spark, sf_dir):
    k = F.col("s_suppkey")
    part = lambda n: F.concat(F.lit("`p"), ((k * n) % 50 + 1).cast("string"), F.lit("`"))
    own = F.concat(F.lit("`s"), k.cast("string"), F.lit("`"))
    text = F.concat(own, F.lit(" calls "), part(7), F.lit(" and "), part(3), F.lit(". "), own, F.lit(" never calls "), part(11), F.lit("; see `s"), (k + 5).cast("string"), F.lit("()` in `parts/p"), k.cast("string"), F.lit(".py`."))
    return A.table(spark, sf_dir, "supplier").select(k.alias("text_id"), text.alias("text"))


@query(f"WITH {_STATED} SELECT * FROM claims")
def claims_extract(spark, sf_dir):
    return claims.extract(_claim_texts(spark, sf_dir))


@query(f"""WITH {_STATED}, e AS (SELECT DISTINCT 's' || l_suppkey AS subject, 'p' || l_partkey AS target FROM lineitem), v AS (SELECT c.*, CASE
  WHEN kind = 'symbol_exists' THEN CASE WHEN subject IN (SELECT 's' || s_suppkey FROM supplier) THEN 'supported' ELSE 'contradicted' END WHEN kind = 'file_exists' THEN CASE WHEN subject IN (SELECT 'parts/p' || p_partkey || '.py' FROM part WHERE p_partkey % 2 = 0) THEN 'supported' ELSE 'contradicted' END
  WHEN subject NOT IN (SELECT 's' || s_suppkey FROM supplier) OR target NOT IN (SELECT 'p' || p_partkey FROM part) THEN 'absent' WHEN e.target IS NOT NULL THEN 'supported' ELSE 'contradicted' END AS s FROM claims c LEFT JOIN e USING (subject, target))
SELECT text_id, kind, subject, relation, target, negated, CASE WHEN NOT negated THEN replace(s, 'absent', 'contradicted') WHEN s = 'supported' THEN 'contradicted' ELSE 'supported' END AS status, CASE WHEN kind = 'symbol_relation' AND s = 'contradicted' THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM v""")
def claim_verdicts(spark, sf_dir):
    name = lambda table, prefix, key: A.table(spark, sf_dir, table).select(F.concat(F.lit(prefix), key).alias("name"))
    nodes = name("supplier", "s", "s_suppkey").unionByName(name("part", "p", "p_partkey"))
    edges = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("calls").alias("kind"), F.lit(True).alias("resolved")).distinct()
    files = A.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("parts/p"), "p_partkey", F.lit(".py")).alias("path"))
    return claims.verdicts(claims.extract(_claim_texts(spark, sf_dir)), nodes, edges, files)


@query("""WITH t AS (SELECT s_suppkey AS k, 's' || s_suppkey AS s, 's' || s_suppkey || '.py' AS f, 'parts/p' || (s_suppkey * 7) % 50 + 1 || '.py' AS a, 'parts/p' || (s_suppkey * 3) % 50 + 1 || '.py' AS b, 'parts/p' || (s_suppkey * 11) % 50 + 1 || '.py' AS c FROM supplier),
files AS (SELECT 'parts/p' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT f FROM t WHERE k % 3 <> 0), imports AS (SELECT DISTINCT 's' || l_suppkey || '.py' AS source, 'parts/p' || l_partkey || '.py' AS target FROM lineitem),
said AS (SELECT k AS text_id, 'symbol_relation' AS kind, s AS subject, 'calls' AS relation, a AS target, false AS negated FROM t UNION ALL SELECT k, 'symbol_relation', f, 'imports', b, false FROM t UNION ALL SELECT k, 'symbol_relation', f, 'imports', c, true FROM t
 UNION ALL SELECT k, 'symbol_relation', s, 'imports', 'p1', false FROM t UNION ALL SELECT k, 'symbol_relation', s, 'calls', 's_' || k, false FROM t UNION ALL SELECT k, 'file_exists', 'x.ini', NULL, NULL, false FROM t UNION ALL SELECT k, 'file_exists', '../parts/p2.py', NULL, NULL, false FROM t UNION ALL SELECT k, 'file_exists', 'parts/./x/../p' || k || '.py', NULL, NULL, false FROM t),
v AS (SELECT said.*, CASE WHEN kind = 'file_exists' THEN CASE WHEN replace(subject, './x/../', '') IN (SELECT path FROM files) THEN 'supported 1.0' ELSE 'contradicted 1.0' END
 WHEN relation = 'imports' AND subject NOT LIKE '%.py' THEN 'unverifiable 0.0' WHEN target LIKE 's_%' AND target NOT LIKE '%.py' THEN CASE WHEN text_id % 2 = 0 THEN 'unverifiable 0.0' ELSE 'contradicted 0.9' END
 WHEN relation = 'imports' AND subject NOT IN (SELECT path FROM files) OR target NOT IN (SELECT path FROM files) THEN 'contradicted 1.0' WHEN relation = 'imports' THEN CASE WHEN i.source IS NOT NULL THEN 'supported 1.0' ELSE 'contradicted 1.0' END
 WHEN (replace(subject, '.py', '') || '.py', target) IN (SELECT (source, target) FROM imports) THEN 'unverifiable 0.0' ELSE 'contradicted 0.9' END AS found FROM said LEFT JOIN (SELECT source, target AS to_file FROM imports) i ON subject = i.source AND target = i.to_file)
SELECT text_id, kind, subject, relation, target, negated, CASE WHEN negated AND found LIKE 'supp%' THEN 'contradicted' WHEN negated AND found LIKE 'contra%' THEN 'supported' ELSE split_part(found, ' ', 1) END AS status, split_part(found, ' ', 2)::DOUBLE AS confidence FROM v""")
def claim_file_verdicts(spark, sf_dir):
    """Claims about files: calls into files, imports, paths; and calls that the graph has by an open end only."""
    k = F.col("s_suppkey").cast("string")
    part = lambda n: F.concat(F.lit("parts/p"), ((F.col("s_suppkey") * n) % 50 + 1).cast("string"), F.lit(".py"))
    quoted = lambda *x: F.concat(F.lit("`"), *x, F.lit("`"))
    own, file = quoted(F.lit("s"), k), quoted(F.lit("s"), k, F.lit(".py"))
    text = F.concat(own, F.lit(" calls "), quoted(part(7)), F.lit(". "), file, F.lit(" imports "), quoted(part(3)), F.lit(", but "), file, F.lit(" never imports "), quoted(part(11)), F.lit("; "), own, F.lit(" imports `p1` and calls it. "),
                    own, F.lit(" method calls "), quoted(F.lit("s_"), k), F.lit(". Set `true`, `run` `x.ini` and `../parts/p2.py` or "), quoted(F.lit("parts/./x/../p"), k, F.lit(".py")))
    suppliers = A.table(spark, sf_dir, "supplier")
    nodes = suppliers.select(F.concat(F.lit("s"), k).alias("name"), F.concat(F.lit("s"), k, F.lit(".py")).alias("path")).unionByName(suppliers.select(F.concat(F.lit("s_"), k).alias("name"), F.lit("other.py").alias("path")))
    edges = suppliers.where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), k).alias("source"), F.concat(F.lit("some.module.s_"), k).alias("target"), F.lit("calls").alias("kind"), F.lit(False).alias("resolved"))
    files = A.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("parts/p"), "p_partkey", F.lit(".py")).alias("path")).unionByName(suppliers.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), k, F.lit(".py")).alias("path")))
    imports = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey", F.lit(".py")).alias("source"), F.concat(F.lit("parts/p"), "l_partkey", F.lit(".py")).alias("target"))
    return claims.verdicts(claims.extract(suppliers.select(F.col("s_suppkey").alias("text_id"), text.alias("text"))), nodes, edges, files, imports)


_IMPORTS = """k AS (SELECT p_partkey AS k, 'pkg/p' || p_partkey || '.py' AS path FROM part),
named AS (SELECT path, '.p' || (k * 7) % 50 + 1 AS target, 'pkg/p' || (k * 7) % 50 + 1 || '.py' AS file FROM k UNION SELECT path, 'pkg.p' || (k * 3) % 50 + 1 || '.thing', 'pkg/p' || (k * 3) % 50 + 1 || '.py' FROM k UNION SELECT path, 'pkg.p' || k + 1, 'pkg/p' || k + 1 || '.py' FROM k UNION SELECT path, 'os.path', NULL FROM k),
found AS (SELECT n.path, target, k.path AS target_path, k.path IS NOT NULL AS resolved FROM named n LEFT JOIN k ON n.file = k.path)"""


def _imports(spark, sf_dir):
    """Modules that import by a leading dot, by a name in a module, by a module, and from outside; with who imports whom."""
    k = F.col("p_partkey")
    part = lambda n: (n).cast("string")
    code = F.concat(F.lit("from . import p"), part((k * 7) % 50 + 1), F.lit("\nfrom pkg.p"), part((k * 3) % 50 + 1), F.lit(" import thing\nimport os.path\nimport pkg.p"), part(k + 1), F.lit("\n"))
    files = A.table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/p"), k.cast("string"), F.lit(".py")).alias("path"), code.alias("text"))
    return codegraph.resolve_imports(saved(codegraph.parse(files, largest=None), "parsed"), files)


@query(f"WITH {_IMPORTS} SELECT * FROM found")
def import_resolution(spark, sf_dir):
    return _imports(spark, sf_dir)


@query(f"""WITH {_IMPORTS}, hops AS (SELECT DISTINCT path AS source, target_path AS target FROM found WHERE resolved AND path <> target_path),
two AS (SELECT [a.source, a.target] AS path FROM hops a JOIN hops b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target),
three AS (SELECT [a.source, a.target, b.target] AS path FROM hops a JOIN hops b ON a.target = b.source JOIN hops c ON b.target = c.source AND c.target = a.source WHERE a.source < a.target AND a.source < b.target AND a.target <> b.target)
FROM two UNION ALL FROM three""")
def import_cycles(spark, sf_dir):
    """Files that import each other in a circle of up to three."""
    return graph.cycles(codegraph.file_edges(_imports(spark, sf_dir)), 3)


def _sources(spark, sf_dir):
    """A Python file for each part: a class, a method that calls a helper, and some unsafe SQL."""
    k = F.col("p_partkey").cast("string")
    safe = F.when(F.col("p_partkey") % 2 == 0, F.lit("db.execute('select ?', (x,))")).otherwise(F.lit("db.execute(f'select {x}')"))
    code = F.concat(F.lit("import os\n\nclass Part"), k, F.lit("(Base):\n    def run(self, db, x):\n        helper"), (F.col("p_partkey") % 3).cast("string"), F.lit("(x)\n        return "), safe, F.lit("\n\ndef helper"), k, F.lit("(x):\n    return x\n"))
    text = F.when(F.col("p_partkey") % 17 == 0, F.lit("def broken(:\n")).otherwise(code)
    return A.table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), text.alias("text"))


_FILES = "f AS (SELECT p_partkey AS k, 'src/p' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 17 <> 0)"


@query(f"WITH {_FILES} SELECT 'class:' || path || ':Part' || k AS id, 'class' AS kind, 'Part' || k AS name FROM f UNION ALL SELECT 'method:' || path || ':Part' || k || '.run', 'method', 'run' FROM f UNION ALL SELECT 'function:' || path || ':helper' || k, 'function', 'helper' || k FROM f")
def code_nodes(spark, sf_dir):
    return codegraph.nodes_of(codegraph.parse(_sources(spark, sf_dir), largest=None)).select("id", "kind", "name")


@query(f"""WITH {_FILES}, c AS (SELECT path, 'Part' || k || '.run' AS qualname, 'calls' AS kind, 'helper' || (k % 3) AS target FROM f UNION ALL SELECT path, 'Part' || k || '.run', 'calls', 'db.execute' FROM f UNION ALL SELECT path, 'Part' || k, 'inherits', 'Base' FROM f)
SELECT c.path, qualname, kind, target, 'function:' || f.path || ':' || target AS target_id, f.path IS NOT NULL AS resolved FROM c LEFT JOIN f ON target = 'helper' || f.k""")
def code_resolution(spark, sf_dir):
    return codegraph.resolve(saved(codegraph.parse(_sources(spark, sf_dir), largest=None), "parsed")).drop("line")


@query(f"WITH {_FILES} SELECT path AS unit, CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM f WHERE k % 2 = 1 UNION ALL SELECT path, 'unknown' FROM f WHERE k % 2 = 0")
def security_findings(spark, sf_dir):
    """Files with SQL texts built at run time and no parameters."""
    rule = rules.parse_rules(rows(spark, [("sql", "PRE: dynamic_sql; POST: parameterised_sql")], "id string, formal_spec string"))
    return rules.violations(rule, codegraph.facts(codegraph.parse(_sources(spark, sf_dir), largest=None))).select("unit", "status")


# surfacing, trials and repositories

_RECORDS = """records AS (SELECT user_id AS store_id, event_id AS id, CASE event_type WHEN 'click' THEN 'decision' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'discovery' ELSE 'constraint' END AS record_type,
 CASE WHEN value < 20 THEN 'resolved' ELSE 'active' END AS status, 'statement ' || event_id AS statement, event_id % 2 = 0 AS hard FROM events)"""


def _records(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "decision").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "discovery").otherwise("constraint")
    status = F.when(F.col("value") < 20, "resolved").otherwise("active")
    return A.table(spark, sf_dir, "events").select(F.col("user_id").alias("store_id"), F.col("event_id").alias("id"), kind.alias("record_type"), status.alias("status"), F.concat(F.lit("statement "), "event_id").alias("statement"), (F.col("event_id") % 2 == 0).alias("hard"))


_OFFERED = f"""offered AS (SELECT store_id AS context_id, row_number() OVER (PARTITION BY store_id ORDER BY o, id) - 1 AS pos, content, id AS record_id, {S.tokens('content')} AS token_count FROM (SELECT *,
 CASE record_type WHEN 'decision' THEN 0 WHEN 'constraint' THEN 1 WHEN 'discovery' THEN 2 ELSE 3 END AS o, CASE record_type WHEN 'decision' THEN 'decision: ' WHEN 'constraint' THEN CASE WHEN hard THEN 'hard constraint: ' ELSE 'soft constraint: ' END WHEN 'discovery' THEN 'discovery: ' ELSE 'already tried, did not work: ' END || statement AS content
 FROM records WHERE record_type IN ('constraint', 'discovery') OR (record_type = 'decision' AND status = 'active') OR (record_type = 'failure' AND status <> 'resolved')))"""


@query(f"WITH {_RECORDS}, {_OFFERED} SELECT context_id, pos, content, record_id, token_count FROM offered")
def surfacing_candidates(spark, sf_dir):
    return surfacing.candidates(_records(spark, sf_dir)).select("context_id", "pos", "content", "record_id", "token_count")


@query(f"""WITH RECURSIVE {_RECORDS}, {_OFFERED}, c AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY CASE WHEN record_id % 4 = 0 THEN record_id END DESC NULLS LAST, pos) AS rank FROM offered),
f AS (SELECT context_id, 0::BIGINT AS rank, 0::BIGINT AS used, NULL::BIGINT AS pos FROM (SELECT DISTINCT context_id FROM c)
 UNION ALL SELECT c.context_id, c.rank, CASE WHEN f.used + c.token_count <= 60 THEN f.used + c.token_count ELSE f.used END, CASE WHEN f.used + c.token_count <= 60 THEN c.pos END FROM f JOIN c ON c.context_id = f.context_id AND c.rank = f.rank + 1)
SELECT context_id, pos FROM f WHERE pos IS NOT NULL""")
def surfacing_select(spark, sf_dir):
    """Candidates with a rank first (here every fourth record, by its id), then the others, as far as they fit."""
    offered = surfacing.candidates(_records(spark, sf_dir))
    scores = offered.where("record_id % 4 = 0").select("context_id", "pos", F.col("record_id").cast("double").alias("score"))
    return surfacing.select(offered, scores, 60).select("context_id", "pos")


@query(f"WITH {S.EVENTS}, {_RECORDS}, {_OFFERED}, b AS (SELECT context_id, pos, content, 0 AS own FROM offered UNION ALL SELECT context_id, pos, content, 1 FROM events_ctx) SELECT context_id, row_number() OVER (PARTITION BY context_id ORDER BY own, pos) - 1 AS pos, content FROM b")
def adaptive_prepass_merge(spark, sf_dir):
    return surfacing.prepend(surfacing.candidates(_records(spark, sf_dir)), A.events_context(spark, sf_dir)).select("context_id", "pos", "content")


_TASKS = "tasks AS (SELECT c_custkey AS store_id, c_name AS title, c_mktsegment AS description, c_custkey % 3 AS k FROM customer)"
_SECTION = "coalesce(string_agg('- ' || {mark}statement{more}, chr(10) ORDER BY id) FILTER (WHERE record_type = '{kind}'), '')"
_LINES = ", ".join(
    _SECTION.format(kind=k, mark="CASE WHEN hard THEN '**[HARD]** ' ELSE '[soft] ' END || " if k == "constraint" else "", more={"decision": " || coalesce(chr(10) || '  - *why:* ' || detail, '')", "failure": " || coalesce(chr(10) || '  - *error:* ' || detail, '')"}.get(k, "")) + f" AS {k}s"
    for k, _ in surfacing.SECTIONS
)


@query(f"""WITH {_RECORDS}, {_TASKS}, detailed AS (SELECT *, CASE WHEN status = 'active' THEN 'detail ' || id END AS detail FROM records), listed AS (SELECT store_id, {_LINES} FROM detailed GROUP BY 1)
SELECT store_id, concat_ws(chr(10), '# HANDOFF', '', '## TASK', CASE WHEN title IS NULL THEN 'No task recorded.' ELSE '**' || title || '**' || CASE WHEN k = 0 THEN '' ELSE chr(10) || chr(10) || description END END, '',
 '## CURRENT STATE', CASE WHEN title IS NULL THEN 'Unknown — no task recorded.' ELSE 'Status: open' || chr(10) || 'Last updated: 2024-01-01' END, '', """
    + ", ".join(f"'## {title}', CASE WHEN coalesce({k}s, '') = '' THEN 'None recorded.' ELSE {'chr(10)'.join(repr(x) + ' || ' for x in surfacing.BEFORE.get(k, '').split(chr(10)) if x) + ('chr(10) || ' if k in surfacing.BEFORE else '')}{k}s END, ''" for k, title in surfacing.SECTIONS)
    + """, '## RELEVANT FILES', CASE WHEN k = 1 THEN '- `a.py`' || chr(10) || '- `b.py`' ELSE 'None recorded.' END, '', '## NEXT ACTION', CASE WHEN k = 2 THEN 'go on' ELSE 'Not recorded — decide this before continuing.' END, '') AS text FROM listed FULL JOIN tasks USING (store_id)""")
def handoff_render(spark, sf_dir):
    customers, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    tasks = customers.select(
        F.col("c_custkey").alias("store_id"), F.col("c_name").alias("title"), F.when(k != 0, F.col("c_mktsegment")).alias("description"), F.lit("open").alias("status"), F.lit("2024-01-01").alias("updated_at"),
        F.when(k == 1, F.array(F.lit("a.py"), F.lit("b.py"))).alias("relevant_files"), F.when(k == 2, "go on").alias("next_action"),
    )
    return surfacing.render_handoff(_records(spark, sf_dir).withColumn("detail", F.when(F.col("status") == "active", F.concat(F.lit("detail "), "id"))), tasks)


HANDOFF_BUDGET = 130


def _handoff_texts() -> str:
    """texts(store_id, level, text, ...): the whole text of each store's handoff at each of the six levels of cuts."""
    bare = _SECTION.format(kind="decision", mark="", more="")
    shown = {"decision": "CASE WHEN level >= 5 THEN '' WHEN level >= 2 THEN coalesce(bare, '') ELSE coalesce(decisions, '') END", "constraint": "CASE WHEN level >= 4 THEN '' ELSE coalesce(constraints, '') END",
             "discovery": "CASE WHEN level >= 1 THEN '' ELSE coalesce(discoverys, '') END", "failure": "CASE WHEN level >= 3 THEN '' ELSE coalesce(failures, '') END"}
    before = {k: f"'{v.strip()}' || chr(10) || " for k, v in surfacing.BEFORE.items()}
    sections = ", ".join(f"'## {title}', CASE WHEN {shown[k]} = '' THEN 'None recorded.' ELSE {before.get(k, '')}{shown[k]} END, ''" for k, title in surfacing.SECTIONS)
    return f"""detailed AS (SELECT *, CASE WHEN id % 3 > 0 THEN 'detail ' || id END AS detail FROM records), standing AS (SELECT * FROM detailed WHERE record_type IN ('constraint', 'discovery') OR (record_type = 'decision' AND status = 'active') OR (record_type = 'failure' AND status <> 'resolved')),
everyone AS (SELECT store_id FROM records UNION SELECT store_id FROM tasks), listed AS (SELECT store_id, {_LINES}, {bare} AS bare, list(id) AS ids FROM standing GROUP BY 1),
texts AS (SELECT store_id, level, concat_ws(chr(10), '# HANDOFF', '', '## TASK', CASE WHEN title IS NULL THEN 'No task recorded.' ELSE '**' || title || '**' || CASE WHEN k = 0 THEN '' ELSE chr(10) || chr(10) || description END END, '',
 '## CURRENT STATE', CASE WHEN title IS NULL THEN 'Unknown — no task recorded.' ELSE 'Status: open' || chr(10) || 'Last updated: 2024-01-01' END, '', {sections},
 '## RELEVANT FILES', CASE WHEN k = 1 THEN '- `a.py`' || chr(10) || '- `b.py`' ELSE 'None recorded.' END, '', '## NEXT ACTION', CASE WHEN k = 2 THEN 'go on' ELSE 'Not recorded — decide this before continuing.' END, '') AS text
 FROM everyone LEFT JOIN listed USING (store_id) LEFT JOIN tasks USING (store_id), range(6) l(level)),
counted AS (SELECT *, {S.tokens('text')} AS tokens FROM texts), chosen AS (SELECT * FROM counted WHERE level = 5 OR tokens <= {HANDOFF_BUDGET} QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY level) = 1)"""


def _handoffs(spark, sf_dir):
    customers, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    tasks = customers.select(
        F.col("c_custkey").alias("store_id"), F.col("c_name").alias("title"), F.when(k != 0, F.col("c_mktsegment")).alias("description"), F.lit("open").alias("status"), F.lit("2024-01-01").alias("updated_at"),
        F.when(k == 1, F.array(F.lit("a.py"), F.lit("b.py"))).alias("relevant_files"), F.when(k == 2, "go on").alias("next_action"),
    )
    records = _records(spark, sf_dir).withColumn("detail", F.when(F.col("id") % 3 > 0, F.concat(F.lit("detail "), "id")))
    return surfacing.handoffs(records, tasks, HANDOFF_BUDGET)


@query(f"""WITH {_RECORDS}, {_TASKS}, {_handoff_texts()}
SELECT store_id, text, tokens, tokens <= {HANDOFF_BUDGET} AS budget_met, ['discoveries', 'decisions_rationale', 'failures', 'constraints', 'decisions'][:level] AS dropped FROM chosen""")
def handoff_within_budget(spark, sf_dir):
    """Each store's handoff, cut until its own text fits."""
    return _handoffs(spark, sf_dir).select("store_id", "text", "tokens", "budget_met", "dropped")


@query(f"""WITH {_RECORDS}, {_TASKS}, {_handoff_texts()}, shown AS (SELECT store_id, list(id ORDER BY CASE record_type WHEN 'decision' THEN 0 WHEN 'constraint' THEN 1 WHEN 'discovery' THEN 2 ELSE 3 END, id) AS ids FROM standing JOIN chosen USING (store_id)
 WHERE level < CASE record_type WHEN 'discovery' THEN 1 WHEN 'failure' THEN 3 WHEN 'constraint' THEN 4 ELSE 5 END GROUP BY 1)
SELECT store_id, 'surfacing' AS record_type, 'handoff' AS surfaced_via, coalesce(ids, []) AS record_ids, ['discoveries', 'decisions_rationale', 'failures', 'constraints', 'decisions'][:level] AS dropped, tokens <= {HANDOFF_BUDGET} AS budget_met, tokens AS token_count, 'heuristic:chars/4' AS token_method FROM chosen LEFT JOIN shown USING (store_id)""")
def handoff_surfacing_rows(spark, sf_dir):
    """What each handoff writes into its store's log."""
    return surfacing.handoff_surfacings(_handoffs(spark, sf_dir))


@query(f"""WITH RECURSIVE {S.EVENTS}, {S.measured('events_ctx')}, {S.classified('measured')}, s AS (SELECT context_id, sum(token_count) AS t, coalesce(sum(token_count) FILTER (WHERE relevance IN ('critical', 'relevant')), 0) AS u FROM classified GROUP BY 1),
trig AS (SELECT context_id, CASE WHEN round(least(1, t / 1000.0), 4) >= 0.75 THEN 'window_usage' WHEN round(u / t::DOUBLE, 4) <= 0.5 THEN 'relevant_ratio' ELSE 'none' END AS reason FROM s),
{_RECORDS}, {_OFFERED}, c AS (SELECT context_id, token_count, row_number() OVER (PARTITION BY context_id ORDER BY pos) AS rank FROM offered),
f AS (SELECT context_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT context_id FROM c)
 UNION ALL SELECT c.context_id, c.rank, CASE WHEN f.used + c.token_count <= 150 THEN f.used + c.token_count ELSE f.used END, CASE WHEN f.used + c.token_count <= 150 THEN f.n + 1 ELSE f.n END FROM f JOIN c ON c.context_id = f.context_id AND c.rank = f.rank + 1),
o AS (SELECT context_id, count(*) AS on_file FROM offered GROUP BY 1), taken AS (SELECT context_id, max(n) AS n FROM f GROUP BY 1)
SELECT context_id, coalesce(reason, 'no context') AS reason, on_file, (CASE WHEN reason <> 'none' THEN n ELSE 0 END)::BIGINT AS surfaced, (CASE WHEN reason <> 'none' THEN on_file - n ELSE 0 END)::BIGINT AS withheld FROM o LEFT JOIN trig USING (context_id) LEFT JOIN taken USING (context_id)""")
def memory_recall(spark, sf_dir):
    """Memory for contexts of 1,000 tokens, whose health says whether it is due; in the order of the records."""
    offered = surfacing.candidates(_records(spark, sf_dir))
    scores = offered.where("false").select("context_id", "pos", F.lit(0.0).alias("score"))
    return surfacing.recall(offered, scores, surfacing_trigger(spark, sf_dir), 150)


_TRIALS = "trials AS (SELECT event_id AS trial_id, 'c' || (user_id % 3) AS condition, event_id % 5 <> 0 AS reported, value, CASE WHEN event_id % 50 <> 1 THEN 'h' || event_id END AS artifact_hash, CASE WHEN value < 30 THEN event_type END AS failure_mode FROM events)"


def _trials(spark, sf_dir):
    events, id = A.table(spark, sf_dir, "events"), F.col("event_id")
    metrics = F.when(id % 5 != 0, F.create_map(F.lit("success"), F.lit(1.0), F.lit("value"), F.col("value"))).otherwise(F.create_map(F.lit("success"), F.lit(1.0)))
    hash = F.when(id % 50 != 1, F.concat(F.lit("h"), id))
    return events.select(id.alias("trial_id"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("condition"), metrics.alias("metrics"), hash.alias("artifact_hash"), F.when(F.col("value") < 30, F.col("event_type")).alias("failure_mode"))


@query(f"WITH {_TRIALS} SELECT failure_mode, count(*) AS n FROM trials WHERE failure_mode IS NOT NULL GROUP BY 1")
def failure_mode_counts(spark, sf_dir):
    return trials.failure_modes(_trials(spark, sf_dir))


@query(f"""WITH {_TRIALS} SELECT 'few_trials' AS warning, condition AS subject FROM trials GROUP BY 2 HAVING count(*) < 5 UNION ALL SELECT 'no_artifact', trial_id::VARCHAR FROM trials WHERE artifact_hash IS NULL UNION ALL SELECT DISTINCT 'missing_metric', 'value' FROM trials WHERE NOT reported
 UNION ALL SELECT 'missing_metric', 'absent' FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM trials) UNION ALL SELECT 'degenerate_floor', 'success' FROM trials WHERE condition = 'c0' HAVING count(*) >= 2""")
def eval_gates(spark, sf_dir):
    return trials.gates(_trials(spark, sf_dir), ("success", "value", "absent"), "c0")


@query(f"WITH {_TRIALS} SELECT trial_id, 'success' AS metric, CASE WHEN trial_id % 2 = 0 THEN 'match' ELSE 'missing' END AS status FROM trials UNION ALL SELECT trial_id, 'value', CASE WHEN trial_id % 2 = 1 THEN 'missing' WHEN trial_id % 6 = 0 THEN 'differs' ELSE 'match' END FROM trials WHERE reported")
def evidence_verify(spark, sf_dir):
    published = _trials(spark, sf_dir).select("trial_id", "metrics")
    derived = published.where("trial_id % 2 = 0").withColumn("metrics", F.transform_values("metrics", lambda k, v: F.when((k == "value") & (F.col("trial_id") % 6 == 0), v + 1).otherwise(v)))
    return trials.verify(published, derived)


@query("""SELECT event_id AS trial_id, CASE WHEN event_id % 4 = 1 THEN 0.0 ELSE 1.0 END AS success, CASE WHEN event_id % 4 = 0 THEN user_id::DOUBLE END AS user, CASE WHEN event_id % 4 = 0 THEN 'scorer_json' ELSE 'exit_code' END AS source, CASE event_id % 4 WHEN 2 THEN 'not parseable' WHEN 3 THEN 'not numbers' END AS reason FROM events""")
def scorer_metrics(spark, sf_dir):
    id, user = F.col("event_id"), F.col("user_id").cast("string")
    last = F.when(id % 4 == 0, F.concat(F.lit('{"user": '), user, F.lit("}"))).when(id % 4 == 2, F.lit("{broken")).when(id % 4 == 3, F.lit('{"user": "text"}')).otherwise(F.lit("plain words"))
    parsed = A.table(spark, sf_dir, "events").withColumn("p", trials.parse_metrics(F.concat(F.lit("some output\n"), last, F.lit("\n\n")), F.when(id % 4 == 1, 1).otherwise(0)))
    return parsed.select(id.alias("trial_id"), F.col("p.metrics")["success"].alias("success"), F.col("p.metrics")["user"].alias("user"), "p.source", "p.reason")


_REPO = """files AS (SELECT 'src/p' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.txt' ELSE '.py' END AS path, p_name AS text, p_partkey AS k FROM part UNION ALL SELECT 'lib/x' || s_suppkey || '/setup.py', 'setup', s_suppkey FROM supplier UNION ALL SELECT 'lib/x' || s_suppkey || '/deep/a.py', s_name, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)"""


def _repository(spark, sf_dir):
    part, supplier = A.table(spark, sf_dir, "part"), A.table(spark, sf_dir, "supplier")
    k = F.col("p_partkey")
    own = part.select(F.concat(F.lit("src/p"), k, F.when(k % 3 == 0, ".txt").otherwise(".py")).alias("path"), F.col("p_name").alias("text"))
    lib = lambda name: F.concat(F.lit("lib/x"), "s_suppkey", F.lit(name)).alias("path")
    return own.unionByName(supplier.select(lib("/setup.py"), F.lit("setup").alias("text"))).unionByName(supplier.where("s_suppkey % 2 = 0").select(lib("/deep/a.py"), F.col("s_name").alias("text")))


def _known_files(spark, sf_dir):
    part, k = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.when(k % 2 == 0, F.col("p_name")).otherwise(F.lit("an older text"))
    return part.where("p_partkey % 5 <> 0").select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), T.raw_hash(text).alias("hash"))


@query(f"""WITH {_REPO} SELECT path, CASE WHEN NOT path LIKE '%.py' THEN 'suffix' WHEN path LIKE 'lib/%' THEN 'vendored' WHEN k % 5 = 0 THEN 'new' WHEN k % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS outcome FROM files""")
def repository_outcomes(spark, sf_dir):
    return repository.outcomes(_repository(spark, sf_dir), _known_files(spark, sf_dir), largest=None)


@query("SELECT 'src/p' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 = 0")
def repository_vanished(spark, sf_dir):
    return repository.vanished(_repository(spark, sf_dir), _known_files(spark, sf_dir))


@query("SELECT 'lib/x' || s_suppkey AS folder FROM supplier")
def nested_projects(spark, sf_dir):
    return repository.nested_projects(_repository(spark, sf_dir))


@query(f"WITH {_REPO} SELECT count(*) FILTER (WHERE path LIKE 'src/%.py') AS in_graph, count(*) FILTER (WHERE NOT path LIKE 'src/%.py') AS out_of_scope, 0::BIGINT AS failed, 1.0::DOUBLE AS coverage FROM files")
def repository_coverage(spark, sf_dir):
    return repository.coverage(repository_outcomes(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, qualname, kind, target FROM (SELECT path, k, 'Part' || k || '.run' AS qualname, 'calls' AS kind, 'helper' || (k % 3) AS target FROM f) WHERE path NOT IN (SELECT 'src/p' || p_partkey || '.py' FROM part WHERE p_partkey % 4 = 0) AND NOT EXISTS (SELECT 1 FROM f g WHERE target = 'helper' || g.k AND g.k % 4 = 0)")
def forget_files(spark, sf_dir):
    """Calls that are left when every fourth file is forgotten: neither from it nor to what it defined."""
    parsed = saved(codegraph.parse(_sources(spark, sf_dir), largest=None), "parsed")
    edges = codegraph.resolve(parsed).where("kind = 'calls' AND target LIKE 'helper%'")
    source = F.concat_ws(":", F.lit("method"), "path", "qualname")
    gone = A.table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")).alias("path"))
    linked = edges.select(source.alias("source"), F.coalesce("target_id", F.lit("")).alias("target"), "path", "qualname", "kind", F.col("target").alias("name"))
    _, left = repository.forget(codegraph.nodes_of(parsed), linked, gone)
    return left.select("path", "qualname", "kind", F.col("name").alias("target"))


@query(f"WITH {S.CONVERSATIONS} SELECT context_id, row_number() OVER (PARTITION BY context_id ORDER BY pos) - 1 AS pos, content FROM conv_ctx WHERE context_id % 3 <> 2 UNION ALL SELECT context_id, pos, content FROM conv_ctx WHERE context_id % 3 = 2")
def load_any_format(spark, sf_dir):
    """Each conversation in one of three formats, told apart by its text: JSON messages, event lines, plain text."""
    talk = A.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("conv_id") % 3 == 1, F.when(F.col("role") == "user", "user").otherwise("assistant")).otherwise(F.col("role")).alias("role"), F.col("text").alias("content")).alias("m"))
    whole = talk.groupBy(F.col("conv_id").alias("context_id")).agg(F.array_sort(F.collect_list("m")).alias("m"))
    messages = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    lines = F.array_join(F.transform("m", lambda x: F.to_json(F.struct(x["role"].alias("type"), F.struct(x["content"].alias("content")).alias("message")))), "\n")
    # a session has two lines at least; the blank-like last one is skipped
    lines = F.concat(lines, F.lit('\n{"type": "end"}'))
    plain = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    raw = F.when(F.col("context_id") % 3 == 0, messages).when(F.col("context_id") % 3 == 1, lines).otherwise(plain)
    return transcripts.load(whole.select("context_id", raw.alias("raw"))).select("context_id", "pos", "content")


@query(f"""WITH {S.STAR}, wanted AS (SELECT min(name) AS wanted FROM nodes WHERE kind = 'part' UNION ALL SELECT max(name) FROM nodes WHERE kind = 'part'), first AS (SELECT wanted, min(id) AS target FROM wanted JOIN nodes ON name = wanted GROUP BY 1)
SELECT DISTINCT wanted, source AS id, e.kind AS how FROM first JOIN edges e USING (target) WHERE e.kind IN ('calls', 'tests')""")
def graph_impact(spark, sf_dir):
    """Who calls and who tests the first and the last part by name."""
    nodes, edges = A.star_graph(spark, sf_dir)
    parts = nodes.where("kind = 'part'").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    return graph.impact(nodes, edges, parts.select(F.explode(F.array("a", "b")).alias("wanted")))


@query(f"""WITH {S.STAR}, wanted AS (SELECT * FROM (VALUES ('FRANCE'), ('000001'), ('nowhere')) v(wanted)) SELECT wanted, EXISTS (SELECT 1 FROM nodes WHERE lower(name) = lower(wanted) OR ends_with(lower(name), lower(wanted))) AS found FROM wanted""")
def graph_exists(spark, sf_dir):
    names = rows(spark, [("FRANCE",), ("000001",), ("nowhere",)], "wanted string")
    return graph.exists(A.star_graph(spark, sf_dir)[0], names)


@query(f"""WITH {S.STAR}, p AS (SELECT 'nation:' || n_nationkey AS seed, 'region:' || r_regionkey AS id FROM nation, region)
SELECT seed, id, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE source = id AND target = seed AND kind = 'contains') THEN 'contains <-' ELSE 'reachable from' END AS reason FROM p""")
def graph_describe_links(spark, sf_dir):
    nodes, edges = A.star_graph(spark, sf_dir)
    of = lambda kind, name: nodes.where(F.col("kind") == kind).select(F.col("id").alias(name))
    # 25 nations and 5 regions
    return graph.describe_links(of("nation", "seed").join(F.broadcast(of("region", "id"))), edges.where("kind = 'contains'"))


_ITEM_SCORES = f"""it AS (SELECT context_id, pos, {S.terms('content')} AS t FROM deduped), ask AS (SELECT unnest(['view', 'k', 'exit', 'view']) AS term), asks AS (SELECT term, count(*) AS times FROM ask GROUP BY 1),
tot AS (SELECT context_id, count(*) AS n_items, avg(len(t)) AS mean_length FROM it GROUP BY 1), itf AS (SELECT context_id, pos, len, term, times, count(*) AS tf FROM (SELECT context_id, pos, len(t) AS len, unnest(t) AS term FROM it) JOIN asks USING (term) GROUP BY ALL),
idf AS (SELECT context_id, term, count(*) AS df FROM itf GROUP BY 1, 2), item_scores AS (SELECT context_id, pos, sum(times * ln(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_length))) AS score FROM itf JOIN idf USING (context_id, term) JOIN tot USING (context_id) GROUP BY 1, 2)"""


@query(f"WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.DEDUPED}, {_ITEM_SCORES} SELECT context_id, pos, round(score, 6) AS score FROM item_scores WHERE score > 0")
def rank_items_in_context(spark, sf_dir):
    items = context.dedup(context.measure(A.events_context(spark, sf_dir)))
    return ranking.score_items(items, "view k exit view").select("context_id", "pos", F.round("score", 6).alias("score"))


@query(f"""WITH {S.EVENTS}, {S.measured('events_ctx')}, {S.DEDUPED}, {S.classified('deduped')}, {_ITEM_SCORES},
short AS (SELECT c.*, coalesce(round(s.score, 6), 0) AS rank_score FROM classified c LEFT JOIN item_scores s USING (context_id, pos) WHERE NOT (kind = 'tool_output' AND relevance = 'irrelevant')),
sm AS (SELECT *, sum(token_count) OVER (PARTITION BY context_id) AS whole, coalesce(sum(token_count) OVER (PARTITION BY context_id ORDER BY CASE relevance WHEN 'irrelevant' THEN 0 WHEN 'obsolete' THEN 1 WHEN 'redundant' THEN 2 WHEN 'relevant' THEN 3 ELSE 4 END, rank_score, original_index DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM short)
SELECT context_id, pos FROM sm WHERE relevance = 'critical' OR whole - gone <= {BUDGET // 2}""")
def context_pipeline_ranked(spark, sf_dir):
    """What is left under a tight budget when items are ranked for a task."""
    items = A.events_context(spark, sf_dir)
    scores = ranking.score_items(context.dedup(context.measure(items)), "view k exit view").withColumn("score", F.round("score", 6))
    return context.run(items, scores, BUDGET // 2).select("context_id", "pos")


from . import code, state  # noqa: E402, F401  their queries register themselves here
