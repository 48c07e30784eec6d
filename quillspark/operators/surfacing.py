"""What memory offers to a context, how much of it fits, and how a handoff reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN_METHOD, content_hash, estimate_tokens, normalised, terms, tokens_of
from .memory import first_fit
from .ranking import score_items

# Results must agree with them.
BUDGET_SHARE = 0.15
SECTIONS = (("decision", "DECISIONS"), ("constraint", "CONSTRAINTS"), ("discovery", "DISCOVERIES"), ("failure", "FAILURES"))
BEFORE = {"failure": "Already tried and did not work — do not repeat:\n"}


def candidates(records: DataFrame) -> DataFrame:
    """Memory items of ``records(store_id, id, record_type, status, statement, hard)``: active decisions, then constraints,
    discoveries and unresolved failures, each with a word that says what it is."""
    kind = F.col("record_type")
    order = F.when(kind == "decision", 0).when(kind == "constraint", 1).when(kind == "discovery", 2).when(kind == "failure", 3)
    word = (
        F.when(kind == "decision", "decision: ")
        .when(kind == "constraint", F.when(F.col("hard"), "hard constraint: ").otherwise("soft constraint: "))
        .when(kind == "discovery", "discovery: ")
        .otherwise("already tried, did not work: ")
    )
    open_ = records.where(((kind == "decision") & (F.col("status") == "active")) | kind.isin("constraint", "discovery") | ((kind == "failure") & (F.col("status") != "resolved")))
    pos = F.row_number().over(Window.partitionBy("store_id").orderBy("_order", "id")) - 1
    content = F.concat(word, F.col("statement"))
    out = open_.withColumn("_order", order).withColumn("content", content)
    return out.select(
        F.col("store_id").alias("context_id"), pos.cast("long").alias("pos"), F.lit("memory").alias("kind"), "content", F.col("id").alias("record_id"),
        estimate_tokens(F.col("content")).alias("token_count"), F.lit(TOKEN_METHOD).alias("token_method"), content_hash(F.col("content")).alias("content_hash"),
    )


def plan_budget(window: Column, share: float = BUDGET_SHARE) -> Column:
    """The tokens of a window that memory may take."""
    return F.floor(window * F.lit(share)).cast("long")


def select(offered: DataFrame, scores: DataFrame, budget: int) -> DataFrame:
    """The candidates ``(context_id, pos, token_count)`` that are taken: by rank, those without a score last, skipping what doesn't fit."""
    ranked = offered.join(scores.select("context_id", "pos", "score"), ["context_id", "pos"], "left")
    rank = F.row_number().over(Window.partitionBy("context_id").orderBy(F.desc_nulls_last("score"), "pos"))
    taken = first_fit(ranked.select(F.col("context_id").alias("store_id"), rank.alias("rank"), F.col("pos").alias("id"), F.col("token_count").alias("tokens")), budget)
    return offered.join(taken.select(F.col("store_id").alias("context_id"), F.col("id").alias("pos")), ["context_id", "pos"], "left_semi")


def prepend(surfaced: DataFrame, items: DataFrame) -> DataFrame:
    """Surfaced items before a context's own, with places that are unique again."""
    both = surfaced.select("context_id", "pos", "kind", "content", F.lit(0).alias("_own")).unionByName(items.select("context_id", "pos", "kind", "content", F.lit(1).alias("_own")))
    place = F.row_number().over(Window.partitionBy("context_id").orderBy("_own", "pos")) - 1
    return both.select("context_id", place.cast("long").alias("pos"), "kind", "content")


def recall(offered: DataFrame, scores: DataFrame, triggers: DataFrame, budget: int) -> DataFrame:
    """``context_id, reason, on_file, surfaced, withheld`` for each context with candidates.

    Where ``triggers(context_id, reason)`` has a reason, candidates are surfaced as far as they fit and the rest is withheld. With
    the reason ``none`` nothing is pushed; a context without a row there has ``no context``. In both, nothing counts as withheld.
    """
    counts = offered.groupBy("context_id").agg(F.count("*").alias("on_file"))
    due = triggers.where("reason <> 'none'").select("context_id")
    taken = select(offered.join(due, "context_id", "left_semi"), scores, budget).groupBy("context_id").agg(F.count("*").alias("surfaced"))
    out = counts.join(triggers.select("context_id", "reason"), "context_id", "left").join(taken, "context_id", "left")
    surfaced = F.coalesce("surfaced", F.lit(0)).cast("long")
    withheld = F.when(F.col("reason") != "none", F.col("on_file") - surfaced).otherwise(0).cast("long")
    return out.select("context_id", F.coalesce("reason", F.lit("no context")).alias("reason"), "on_file", surfaced.alias("surfaced"), withheld.alias("withheld"))


def render_handoff(records: DataFrame, tasks: DataFrame, rationale: bool = True, stores: DataFrame | None = None) -> DataFrame:
    """``store_id, text``: a document of eight sections for each store that has records or a task; empty sections say so.
    With ``stores(store_id)`` also those without either have one.

    ``records(store_id, id, record_type, statement, detail, hard)``: the detail is a decision's reason or a failure's error.
    ``tasks(store_id, title, description, status, updated_at, relevant_files, next_action)`` has at most one row for a store. A
    store's records meet in one row: pass what handoff_level left of them.
    """
    listed = [F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.struct("id", "statement", "detail", "hard")))).alias(kind) for kind, _ in SECTIONS]
    both = records.groupBy("store_id").agg(*listed).join(tasks.withColumn("_task", F.lit(True)), "store_id", "full")
    both = both if stores is None else stores.join(both, "store_id", "left")
    known = F.coalesce("_task", F.lit(False))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""

    def more(r: Column, label: str) -> Column:
        return F.when(filled(r["detail"]), F.concat(F.lit(f"\n  - *{label}:* "), r["detail"])).otherwise("")

    def lines(kind: str) -> Column:
        def line(r: Column) -> Column:
            mark = F.when(r["hard"], "**[HARD]** ").otherwise("[soft] ") if kind == "constraint" else F.lit("")
            rest = more(r, "why") if kind == "decision" and rationale else more(r, "error") if kind == "failure" else F.lit("")
            return F.concat(F.lit("- "), mark, r["statement"], rest)

        return F.array_join(F.transform(kind, line), "\n")

    def section(title: str, body: Column) -> list[Column]:
        return [F.lit(f"## {title}"), F.concat(body, F.lit("\n"))]

    about = F.concat(F.lit("**"), F.col("title"), F.lit("**"), F.when(filled(F.col("description")), F.concat(F.lit("\n\n"), F.col("description"))).otherwise(""))
    state = F.concat(F.lit("Status: "), F.col("status"), F.lit("\nLast updated: "), F.col("updated_at"))
    parts = [F.lit("# HANDOFF\n"), *section("TASK", F.when(known, about).otherwise("No task recorded.")), *section("CURRENT STATE", F.when(known, state).otherwise("Unknown — no task recorded."))]
    for kind, title in SECTIONS:
        none = F.coalesce(F.size(kind), F.lit(0)) <= 0
        parts += section(title, F.when(none, "None recorded.").otherwise(F.concat(F.lit(BEFORE.get(kind, "")), lines(kind))))
    files = F.array_join(F.transform("relevant_files", lambda f: F.concat(F.lit("- `"), f, F.lit("`"))), "\n")
    parts += section("RELEVANT FILES", F.when(F.coalesce(F.size("relevant_files"), F.lit(0)) > 0, files).otherwise("None recorded."))
    parts += section("NEXT ACTION", F.when(filled(F.col("next_action")), F.col("next_action")).otherwise("Not recorded — decide this before continuing."))
    return both.select("store_id", F.concat_ws("\n", *parts).alias("text"))


#: What a handoff leaves out to fit, in this order.
HANDOFF_CUT_ORDER = ("discoveries", "decisions_rationale", "failures", "constraints", "decisions")
_CUT_OF = {"discovery": 1, "failure": 3, "constraint": 4, "decision": 5}  # the level at which a kind of record is gone
_WHY_CUT = 2


def _line(kind: Column, hard: Column, statement: Column) -> Column:
    mark = F.when(kind == "constraint", F.when(hard, "**[HARD]** ").otherwise("[soft] ")).otherwise("")
    return F.concat(F.lit("- "), mark, F.coalesce(statement, F.lit("")))


def _more(kind: Column, detail: Column) -> Column:
    label = F.when(kind == "decision", "why").when(kind == "failure", "error")
    return F.when(label.isNotNull() & (F.coalesce(detail, F.lit("")) != ""), F.concat(F.lit("  - *"), label, F.lit(":* "), detail))


def handoffs(records: DataFrame, tasks: DataFrame, budget: int | None = None) -> DataFrame:
    """``store_id, text, tokens, token_method, budget_met, dropped, record_ids, counts``: the handoff of each store, cut until its
    own text fits the budget.

    Of ``records(store_id, id, record_type, status, statement, detail, hard)`` active decisions, constraints, discoveries and
    unresolved failures count; ``tasks`` is as in :func:`render_handoff`. Parts go in the order of HANDOFF_CUT_ORDER, and after
    each cut the text that is left is counted anew; where nothing is left to cut ``budget_met`` is false. The count of a text is
    the sum over its lines, so all six texts are counted by sums and only the one that is chosen is ever put together: a
    store's records meet in one row only as far as the budget holds them. Without a budget nothing is cut.
    """
    kind = F.col("record_type")
    standing = records.where(((kind == "decision") & (F.col("status") == "active")) | kind.isin("constraint", "discovery") | ((kind == "failure") & ~F.col("status").eqNullSafe("resolved")))
    size = lambda text: F.length(normalised(text)).cast("long")
    measured = standing.select("store_id", kind, (size(_line(kind, F.col("hard"), F.col("statement"))) + 1).alias("own"), (F.coalesce(size(_more(kind, F.col("detail"))) + 1, F.lit(0))).alias("more"))
    of = lambda name, k: F.coalesce(F.sum(F.when(kind == k, F.col(name))), F.lit(0))
    sums = measured.groupBy("store_id").agg(*[of(n, k).alias(f"{n}_{k}") for n in ("own", "more") for k in _CUT_OF])
    # a handoff without records has the lines that are always there; a line more costs its length and one space
    everyone = records.select("store_id").unionByName(tasks.select("store_id")).distinct()
    base = render_handoff(records.where("false"), tasks, stores=everyone).select("store_id", size(F.col("text")).alias("_base"))
    stores = base.join(sums, "store_id", "left").na.fill(0)
    none = len("None recorded.") + 1

    def part(k: str, level: int) -> Column:
        if level >= _CUT_OF[k]:
            return F.lit(0)
        more = F.col(f"more_{k}") if not (k == "decision" and level >= _WHY_CUT) else F.lit(0)
        before = len(BEFORE.get(k, "").strip()) + (1 if k in BEFORE else 0)
        return F.when(F.col(f"own_{k}") > 0, F.col(f"own_{k}") + more + before - none).otherwise(0)

    levels = F.array(*[F.struct(F.lit(n).alias("level"), tokens_of(F.col("_base") + sum((part(k, n) for k in _CUT_OF), F.lit(0))).alias("tokens")) for n in range(len(HANDOFF_CUT_ORDER) + 1)])
    fits = F.filter(levels, lambda x: F.lit(True) if budget is None else x["tokens"] <= budget)
    chosen = stores.select("store_id", F.coalesce(F.get(fits, F.lit(0)), F.element_at(levels, -1)).alias("c")).select("store_id", F.col("c.level").alias("_level"), F.col("c.tokens").alias("tokens"))
    gone = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in _CUT_OF.items()])
    left = standing.join(chosen, "store_id").where(F.col("_level") < gone)
    left = left.withColumn("detail", F.when((kind != "decision") | (F.col("_level") < _WHY_CUT), F.col("detail")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(*[F.when(kind == k, F.lit(i)) for i, (k, _) in enumerate(SECTIONS)]).alias("o"), "id"))), lambda x: x["id"])
    kept = left.groupBy("store_id").agg(ids.alias("record_ids"), *[F.sum((kind == k).cast("long")).alias(k) for k, _ in SECTIONS])
    text = render_handoff(left.select("store_id", "id", "record_type", "statement", "detail", "hard"), tasks, stores=everyone)
    out = chosen.join(kept, "store_id", "left").join(text, "store_id")
    counts = F.struct(*[F.coalesce(k, F.lit(0)).alias(k) for k, _ in SECTIONS])
    return out.select(
        "store_id",
        "text",
        "tokens",
        F.lit(TOKEN_METHOD).alias("token_method"),
        (F.lit(True) if budget is None else F.col("tokens") <= budget).alias("budget_met"),
        F.slice(F.array(*map(F.lit, HANDOFF_CUT_ORDER)), F.lit(1), F.col("_level")).alias("dropped"),
        F.coalesce("record_ids", F.array().cast("array<bigint>")).alias("record_ids"),
        counts.alias("counts"),
    )


def handoff_surfacings(handoffs_: DataFrame) -> DataFrame:
    """The record that each handoff leaves in its store's log: what it showed, what it left out, and whether it fitted."""
    return handoffs_.select("store_id", F.lit("surfacing").alias("record_type"), F.lit("handoff").alias("surfaced_via"), "record_ids", "dropped", "budget_met", F.col("tokens").alias("token_count"), "token_method")


def token_footer(handoffs_: DataFrame) -> Column:
    """The line below a handoff: its tokens, and what was dropped to fit."""
    count = F.concat(F.lit("["), F.format_number("tokens", 0), F.lit(" tokens, "), "token_method", F.lit("]"))
    return F.concat(count, F.when(F.size("dropped") > 0, F.concat(F.lit("\n[dropped to fit budget: "), F.array_join("dropped", ", "), F.lit("]"))).otherwise(""))


def recall_for(offered: DataFrame, tasks: DataFrame, triggers: DataFrame, budget: int) -> DataFrame:
    """:func:`recall` with ranking inside: ``tasks(context_id, task)`` order each context's candidates by BM25, and candidates
    without a word of the task come last instead of never. Adds ``unranked``, how many those are, where memory is pushed, and
    ``degraded_reason``: why the order says less than it could (no task, or unranked candidates)."""
    scores = score_items(offered, tasks)
    out = recall(offered, scores, triggers, budget)
    stated = tasks.select("context_id", (F.size(terms(F.col("task"))) > 0).alias("_stated"))
    ranked = scores.groupBy("context_id").agg(F.count("*").alias("_ranked"))
    out = out.join(ranked, "context_id", "left").join(stated, "context_id", "left")
    pushed = ~F.col("reason").isin("none", "no context")
    unranked = F.col("on_file") - F.coalesce("_ranked", F.lit(0))
    why = F.when(pushed & ~F.coalesce("_stated", F.lit(False)), "no task: candidates are in the order of the records").when(pushed & (unranked > 0), F.concat(unranked.cast("string"), F.lit(" candidate(s) share no word with the task and come last")))
    return out.select("context_id", "reason", "on_file", "surfaced", "withheld", F.when(pushed, unranked).otherwise(0).alias("unranked"), why.alias("degraded_reason"))


def recall_lines(offered: DataFrame, scores: DataFrame, triggers: DataFrame, budget: int, shown: int = 160) -> DataFrame:
    """``context_id, place, line``: what is pushed, in the order of its rank, each as one line of at most ``shown`` characters."""
    due = offered.join(triggers.where("reason <> 'none'").select("context_id"), "context_id", "left_semi")
    taken = select(due, scores, budget).join(scores, ["context_id", "pos"], "left")
    place = F.row_number().over(Window.partitionBy("context_id").orderBy(F.desc_nulls_last("score"), "pos"))
    return taken.select("context_id", place.cast("long").alias("place"), F.concat(F.lit("  - "), F.substring(normalised(F.col("content")), 1, shown)).alias("line"))
