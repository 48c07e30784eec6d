"""Trials: metrics from a scorer's output, gates on what may be claimed, and re-derived results held against published ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import metric_variance

# Results must agree with them.
FEWEST_TRIALS = 5


def parse_metrics(stdout: Column, exit_code: Column) -> Column:
    """``struct(metrics, source, reason)``: success by the exit code, and the numbers of the last line if it is a JSON object."""
    lines = F.filter(F.transform(F.split(F.coalesce(stdout, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    base = F.create_map(F.lit("success"), F.when(exit_code == 0, 1.0).otherwise(0.0))
    texts = F.from_json(last, "map<string,string>")
    numbers = F.transform_values(texts, lambda k, v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double")))
    bad = F.exists(F.map_values(numbers), lambda v: v.isNull()) | last.rlike(r':\s*"')
    listed = last.startswith("{")
    fine = listed & F.try_parse_json(last).isNotNull() & texts.isNotNull() & ~bad
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(numbers, k)), numbers)
    reason = F.when(listed & F.try_parse_json(last).isNull(), "not parseable").when(listed & ~F.coalesce(fine, F.lit(False)), "not numbers")
    return F.struct(F.when(fine, merged).otherwise(base).alias("metrics"), F.when(fine, "scorer_json").otherwise("exit_code").alias("source"), reason.alias("reason"))


def by_condition(trials: DataFrame) -> DataFrame:
    """Variance of each metric in each condition of ``trials(condition, metrics)``."""
    return metric_variance(trials, by=("condition",))


def failure_modes(trials: DataFrame) -> DataFrame:
    return trials.where("failure_mode IS NOT NULL").groupBy("failure_mode").agg(F.count("*").alias("n"))


def gates(trials: DataFrame, metric_keys: tuple[str, ...], baseline: str) -> DataFrame:
    """``warning, subject`` for each reason not to publish ``trials(trial_id, condition, metrics, artifact_hash)``."""
    few = trials.groupBy("condition").agg(F.count("*").alias("n")).where(F.col("n") < FEWEST_TRIALS).select(F.lit("few_trials").alias("warning"), F.col("condition").alias("subject"))
    unkept = trials.where("artifact_hash IS NULL OR artifact_hash = ''").select(F.lit("no_artifact").alias("warning"), F.col("trial_id").cast("string").alias("subject"))
    wanted = trials.select("metrics", F.explode(F.array(*map(F.lit, metric_keys))).alias("metric"))
    missing = wanted.where(~F.map_contains_key("metrics", F.col("metric"))).select(F.lit("missing_metric").alias("warning"), F.col("metric").alias("subject")).distinct()
    floor = metric_variance(trials.where(F.col("condition") == baseline)).where((F.col("n") >= 2) & (F.col("min") == F.col("max")) & F.col("metric").isin(*metric_keys))
    flat = floor.select(F.lit("degenerate_floor").alias("warning"), F.col("metric").alias("subject"))
    return few.unionByName(unkept).unionByName(missing).unionByName(flat)


def verify(published: DataFrame, derived: DataFrame) -> DataFrame:
    """``trial_id, metric, status`` of published and re-derived ``(trial_id, metrics)``: match, differs or missing."""
    flat = lambda df, name: df.select("trial_id", F.explode("metrics").alias("metric", name))
    both = flat(published, "p").join(flat(derived, "d"), ["trial_id", "metric"], "left")
    return both.select("trial_id", "metric", F.when(F.col("d").isNull(), "missing").when(F.col("p") == F.col("d"), "match").otherwise("differs").alias("status"))


def latest_run(manifest: DataFrame) -> DataFrame:
    """The rows ``(run_id, line, ...)`` of the run that was written last: a verification reads that one only."""
    last = manifest.agg(F.max_by("run_id", "line").alias("run_id"))  # one row
    return manifest.join(F.broadcast(last), "run_id", "left_semi")


def evidence_gates(trials: DataFrame, unreadable: DataFrame | None) -> DataFrame:
    """``warning, subject``: that nothing was kept to derive the figures from (``unreadable`` is None), or which files
    ``(trial_id, path)`` of the kept versions no diff can tell, each path once."""
    if unreadable is None:
        return trials.limit(1).select(F.lit("no_evidence").alias("warning"), F.lit("").alias("subject"))
    return unreadable.select(F.lit("unreadable_file").alias("warning"), F.col("path").alias("subject")).distinct()


def verify_latest(manifest: DataFrame, derived: DataFrame, fixture: str | None) -> DataFrame:
    """``trial_id, ok, reason`` for each trial of the run that was written last.

    ``manifest(run_id, line, trial_id, metrics, exit_code, fixture_hash)`` is what was published, ``derived(trial_id, metrics,
    exit_code)`` what comes out now, ``fixture`` the digest of the fixture as it stands (None: it is gone). A fixture that moved,
    a diff that no longer applies (no derived row), another exit code, figures that differ and figures that are no longer
    reported are told apart, in this order; the names of figures stand sorted.
    """
    run = latest_run(manifest).select("trial_id", "metrics", "exit_code", "fixture_hash")
    both = run.join(derived.select("trial_id", F.col("metrics").alias("now"), F.col("exit_code").alias("exit_now")), "trial_id", "left")
    keys = F.array_sort(F.map_keys("metrics"))
    differing = F.filter(keys, lambda k: F.map_contains_key("now", k) & (F.try_element_at("now", k) != F.try_element_at("metrics", k)))
    missing = F.filter(keys, lambda k: ~F.map_contains_key("now", k))
    told = lambda names, word: F.concat(F.lit(word), F.array_join(names, ", "))
    reason = (
        F.when(F.lit(fixture is None), "the fixture is gone")
        .when(~F.col("fixture_hash").eqNullSafe(F.lit(fixture)), "the fixture has changed")
        .when(F.col("exit_now").isNull(), "nothing was derived")
        .when(F.col("exit_now") != F.col("exit_code"), F.concat(F.lit("exit code "), F.col("exit_now").cast("string"), F.lit(" instead of "), F.col("exit_code").cast("string")))
        .when(F.size(differing) > 0, told(differing, "differs: "))
        .when(F.size(missing) > 0, told(missing, "no longer reported: "))
    )
    return both.select("trial_id", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def eval_report(trials: DataFrame, metric_keys: tuple[str, ...], baseline: str, unreadable: DataFrame | None = None) -> DataFrame:
    """``section, key, report``: a run's report as JSON rows, so that warnings travel with the figures and no row holds all trials.

    Sections are ``warning`` (also those of :func:`evidence_gates`), ``comparison`` of each condition and metric with the
    baseline's noise floor, ``trial``, and one ``run`` that says whether the figures may be published: only without warnings.
    """
    warnings = gates(trials, metric_keys, baseline).unionByName(evidence_gates(trials, unreadable))
    floor = by_condition(trials).where(F.col("metric").isin(*metric_keys))
    base = floor.where(F.col("condition") == baseline).select("metric", F.col("n").alias("n_within"), F.col("min").alias("floor_min"), F.col("max").alias("floor_max"))
    rest = floor.where(F.col("condition") != baseline).select("condition", "metric", F.col("n").alias("n_between"), F.col("mean").alias("between_mean")).join(base, "metric", "left")
    verdict = F.when(F.coalesce("n_within", F.lit(0)) < 2, "insufficient_data").when((F.col("between_mean") < F.col("floor_min")) | (F.col("between_mean") > F.col("floor_max")), "likely_real_difference").otherwise("indistinguishable_from_noise")
    rest = rest.withColumn("verdict", verdict)
    rows = lambda df, section, key, *columns: df.select(F.lit(section).alias("section"), key.alias("key"), F.to_json(F.struct(*columns)).alias("report"))
    told = rows(warnings, "warning", F.concat_ws(":", "warning", "subject"), "warning", "subject")
    told = told.unionByName(rows(rest, "comparison", F.concat_ws(":", "condition", "metric"), "condition", "metric", "n_within", "floor_min", "floor_max", "n_between", "between_mean", "verdict"))
    told = told.unionByName(rows(trials, "trial", F.col("trial_id").cast("string"), *[c for c in trials.columns]))
    n = warnings.agg(F.count("*").alias("warnings")).select("warnings", (F.col("warnings") == 0).alias("publishable"), F.lit(baseline).alias("baseline"))
    return told.unionByName(rows(n, "run", F.lit(""), "baseline", "warnings", "publishable"))
