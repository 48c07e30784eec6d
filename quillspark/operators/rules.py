"""Rules over facts, import policies and risk tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Results must agree with them.
MANY_CALLERS, WIDE_FAN_IN, MOST_ROUNDS = 3, 2, 10
TIERS = ("low", "medium", "high")


def parse_rules(rules: DataFrame) -> DataFrame:
    """Adds ``pre`` (a list) and ``post`` from a text ``PRE: a, b; POST: c``. Without ``PRE:`` the list is null: the rule has no
    trigger and never fires; an empty one is always met."""
    listed = F.when(F.contains("formal_spec", F.lit("PRE:")), F.regexp_extract("formal_spec", r"PRE:\s*([^;]*)", 1))
    pre = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    return rules.withColumn("pre", pre).withColumn("post", F.trim(F.regexp_extract("formal_spec", r"POST:\s*([^;]*)", 1)))


def violations(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """``rule_id, unit, status`` for parsed rules and ``facts(unit, facts)``: unknown without the preconditions, then pass or fail.

    Rules are a stated, short list that is held against every unit.
    """
    pairs = facts.join(F.broadcast(rules.select(F.col("id").alias("rule_id"), "pre", "post")))
    met = F.coalesce(F.forall("pre", lambda p: F.array_contains("facts", p)), F.lit(False))
    status = F.when(~met, "unknown").when(F.array_contains("facts", F.col("post")), "pass").otherwise("fail")
    return pairs.select("rule_id", "unit", status.alias("status"))


def applicable(rules: DataFrame, facts: DataFrame, language: str) -> DataFrame:
    named = rules.where(F.array_contains("applies_to", language))
    return violations(named, facts).where("status <> 'unknown'").select("rule_id", "unit")


def infer(rules: DataFrame, facts: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``unit, facts`` with all that follows, by at most ``rounds`` rounds of forward chaining.

    A round adds what every rule with its preconditions met concludes; later rounds change nothing once none does.
    """
    return _chained(rules, facts, rounds).select("unit", F.array_sort("chain.facts").alias("facts"))


_STEP = "struct<round:int,rule_id:string,derived:string,because:array<string>>"


def _chained(rules: DataFrame, facts: DataFrame, rounds: int) -> DataFrame:
    """``unit, chain``: all facts that follow, and the steps; a fold over the rounds, so the plan doesn't grow with them."""
    parsed = [r for r in rules.select("id", "pre", "post").collect() if r.pre is not None and r.post]  # a short list by its nature
    listed = F.array(*[F.struct(F.lit(r.id).alias("id"), F.array(*map(F.lit, r.pre)).cast("array<string>").alias("pre"), F.lit(r.post).alias("post")) for r in parsed])
    start = F.struct(F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), F.array().cast(f"array<{_STEP}>").alias("steps"))

    def round_(state: Column, n: Column) -> Column:
        new = F.filter(listed, lambda r: F.forall(r["pre"], lambda p: F.array_contains(state["facts"], p)) & ~F.array_contains(state["facts"], r["post"]))
        steps = F.transform(new, lambda r: F.struct(n.alias("round"), r["id"].alias("rule_id"), r["post"].alias("derived"), r["pre"].alias("because")))
        return F.struct(F.array_union(state["facts"], F.transform(new, lambda r: r["post"])).alias("facts"), F.concat(state["steps"], steps).alias("steps"))

    # a chain is no longer than the list of rules
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(min(rounds, len(parsed)))), start, round_) if parsed and rounds > 0 else start
    return facts.select("unit", chain.alias("chain"))


def policy_breaches(edges: DataFrame, packages: DataFrame, policy: DataFrame, core: str) -> DataFrame:
    """Imports ``(source, target)`` between packages that the policy ``(package, allowed)`` doesn't allow; ``*`` allows all."""
    of = lambda key, name: packages.select(F.col("id").alias(key), F.col("package").alias(name))
    crossing = edges.join(of("source", "from_package"), "source").join(of("target", "to_package"), "target")
    crossing = crossing.where((F.col("from_package") != F.col("to_package")) & (F.col("to_package") != core))
    allowed = policy.select(F.col("package").alias("from_package"), F.col("allowed").alias("to_package"))
    free = allowed.where("to_package = '*'").select("from_package").distinct()
    return crossing.join(free, "from_package", "left_anti").join(allowed, ["from_package", "to_package"], "left_anti").select("source", "target", "from_package", "to_package")


def risk_tier(units: DataFrame) -> DataFrame:
    """``unit, tier, reasons`` of ``units(unit, path_marker, callers, fan_in, untested)``."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("path_marker").isNotNull(), F.concat(F.lit("path:"), "path_marker")),
            F.when(F.col("callers") >= MANY_CALLERS, F.lit("callers")),
            F.when(F.col("fan_in") >= WIDE_FAN_IN, F.lit("fan_in")),
            F.when(F.col("untested") > 0, F.lit("untested")),
        )
    )
    tier = F.when(F.col("path_marker").isNotNull(), "high").when(F.size(reasons) > 0, "medium").otherwise("low")
    return units.select("unit", tier.alias("tier"), reasons.alias("reasons"))


def rules_for_tier(rules: DataFrame, tier: str) -> DataFrame:
    """Rules whose tier isn't above the given one; unknown tiers count as the lowest."""
    level = lambda c: F.coalesce(*[F.when(c == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(0))
    return rules.where(level(F.col("risk_tier")) <= level(F.lit(tier)))

def _met(rules: DataFrame) -> Column:
    """Whether a unit's facts have all of a rule's preconditions; a rule that names none at all has no trigger and is never met."""
    return F.coalesce(F.forall("pre", lambda p: F.array_contains("facts", p)), F.lit(False)) & (F.col("post") != "")


def applied(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """``rule_id, unit, status, derived``: what each rule concludes for each unit by itself; pass, or unknown without its trigger."""
    pairs = facts.join(F.broadcast(rules.select(F.col("id").alias("rule_id"), "pre", "post")))
    return pairs.select("rule_id", "unit", F.when(_met(rules), "pass").otherwise("unknown").alias("status"), F.when(_met(rules), F.col("post")).alias("derived"))


def infer_traced(rules: DataFrame, facts: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``unit, round, rule_id, derived, because``: which rule gave which new fact in which round, and from what.

    A round looks at the facts that stand before it, so two rules can give the same fact in one round; a fact that a unit has is
    not given again. ``because`` are the rule's preconditions. Units that nothing is concluded for have no row.
    """
    return _chained(rules, facts, rounds).select("unit", F.inline("chain.steps"))


#: The built-in rules: a shape to look for, and the fact that makes it harmless.
SECURITY_RULES = (
    ("sql-injection", "PRE: dynamic_sql; POST: parameterised_sql", "high", "high", "A shape, not a flow of data: a text built from constants alone is also found."),
    ("check-then-act-race", "PRE: check_then_set; POST: guarded_check_then_set", "medium", "medium", "Whether the container is shared isn't known: a local one that is filled is also found."),
    ("shell-command-injection", "PRE: dynamic_shell; POST: listed_command", "high", "low", "A shape, not a flow of data: a command that the operator controls is also found."),
)


def security_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules: ``id, formal_spec, severity, risk_tier, caveat, pre, post``."""
    return parse_rules(spark.createDataFrame(SECURITY_RULES, "id string, formal_spec string, severity string, risk_tier string, caveat string"))


def findings(rules: DataFrame, facts: DataFrame, places: DataFrame) -> DataFrame:
    """``rule_id, unit, severity, lines``: the rules that units break, and where ``places(unit, kind, line)`` shows the trigger."""
    broken = violations(rules, facts).where("status = 'fail'").select("rule_id", "unit")
    named = F.broadcast(rules.select(F.col("id").alias("rule_id"), "severity", "pre"))
    shown = broken.join(named, "rule_id")
    lines = shown.select("rule_id", "unit", F.explode("pre").alias("kind")).join(places, ["unit", "kind"]).groupBy("rule_id", "unit").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return shown.join(lines, ["rule_id", "unit"], "left").select("rule_id", "unit", "severity", F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))


def caveats(rules: DataFrame, found: DataFrame) -> DataFrame:
    """``rule_id, caveat, n``: what to keep in mind about each rule that has findings, and how many."""
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(rules.select(F.col("id").alias("rule_id"), "caveat")), "rule_id").select("rule_id", "caveat", "n")


def _level(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(0))


def rules_for_units(rules: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, rule_id``: the rules whose tier isn't above that of each of ``units(unit, tier)``; unknown tiers count as the lowest."""
    short = F.broadcast(rules.select(F.col("id").alias("rule_id"), _level(F.col("risk_tier")).alias("_of_rule")))  # a short list by its nature
    return units.withColumn("_of_unit", _level(F.col("tier"))).join(short, F.col("_of_rule") <= F.col("_of_unit")).select("unit", "rule_id")
