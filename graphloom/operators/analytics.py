"""Tables over experiment runs (A1-A30). A run has run_id, question_id, condition, approach, model, run_number, ts and scores."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.quantiles import exact_quantiles, expanded


def latest_runs(runs: DataFrame, keys: list[str], ts: str = "ts", tie: str = "run_id") -> DataFrame:
    """A1: the latest record of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _mean(c: str) -> Column:
    return F.avg(c).alias(f"mean_{c}")


def condition_table(runs: DataFrame, scores: list[str], by: list[str]) -> DataFrame:
    """A2: means of scores (nulls skipped), searches a run, and the share of searches with at most 150 characters of output; calls is an array of structs with tool_name, output_size."""
    search = F.filter("calls", lambda c: F.contains(F.lower(c["tool_name"]), F.lit("search")))
    failed = F.filter(search, lambda c: c["output_size"] <= 150)
    t = runs.withColumn("_n", F.size(search)).withColumn("_f", F.size(failed))
    return t.groupBy(*by).agg(
        *map(_mean, scores), F.avg("_n").alias("searches"),
        F.coalesce(100 * F.sum("_f") / F.nullif(F.sum("_n"), F.lit(0)), F.lit(0.0)).alias("failed_percent")
    )


def retry_rate(runs: DataFrame, by: list[str]) -> DataFrame:
    """A3: share of runs with more than one retrieval iteration."""
    return runs.groupBy(*by).agg(F.avg((F.col("retrieval_iterations") > 1).cast("double")).alias("retry_rate"))


def recognition(runs: DataFrame) -> DataFrame:
    """A4: recognised and false alarms per question and overall; columns question_id, instructed, underspecified, recognised."""
    hit, alarm = F.count_if(F.col("underspecified") & F.col("recognised")), F.count_if(~F.col("underspecified") & F.col("recognised"))
    return runs.groupingSets([["instructed", "question_id"], ["instructed"]], "instructed", "question_id").agg(
        F.count(F.lit(1)).alias("n"), hit.alias("recognised"), alarm.alias("false_alarms")
    )


def tool_time(runs: DataFrame, by: list[str]) -> DataFrame:
    """A5: mean tool time and run time."""
    total = F.aggregate("calls", F.lit(0.0), lambda a, c: a + c["duration_ms"])
    return runs.withColumn("_t", total).groupBy(*by).agg(F.avg("_t").alias("tool_ms"), F.avg("total_time_ms").alias("run_ms"))


def handback(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs handed back and others: n, mean F1, share of at least 0.9."""
    return runs.groupBy(*by, "handed_back").agg(
        F.count(F.lit(1)).alias("n"), F.avg("f1").alias("mean_f1"), F.avg((F.col("f1") >= 0.9).cast("double")).alias("high_share")
    )


def search_size(runs: DataFrame, default_k: int, by: list[str]) -> DataFrame:
    """Calls (array of structs with k): share over the default, largest, median of each run's largest."""
    calls = runs.select(*by, "run_id", F.explode("calls.k").alias("k"))
    per_run = calls.groupBy(*by, "run_id").agg(
        F.max("k").alias("most"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > default_k).alias("over")
    )
    sums = per_run.groupBy(*by).agg((F.sum("over") / F.sum("n")).alias("over_share"), F.max("most").alias("max_k"))
    return _beside(sums, exact_quantiles(per_run, by, "most", {"median_max_k": 0.5}).drop("n"), by)


def typo_reach(hits: DataFrame) -> DataFrame:
    """How many runs and calls a misspelling reached; from N13's (run_id, typo, hit)."""
    return hits.groupBy("typo").agg(F.count_if("hit").alias("calls"), F.count_distinct(F.when(F.col("hit"), F.col("run_id"))).alias("runs"))


def runtime_stats(runs: DataFrame, measures: list[str], sets: list[list[str]]) -> DataFrame:
    """N, mean, median, interpolated p95, min and max of measures for each grouping set, long form."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    long = runs.select(*keys, *measures).unpivot(keys, measures, "measure", "value").where("value is not null")
    by = ["_set", *keys, "measure"]
    each = expanded(long, [[*s, "measure"] for s in sets], ["value"])
    stats = each.groupBy(*by).agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    spread = exact_quantiles(each, by, "value", {"median": 0.5, "p95": 0.95})
    return _beside(stats, spread, by).select(*keys, "measure", "n", "mean", "median", "p95", "low", "high")


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Both tables' columns for equal keys, nulls too."""
    keys = [F.col(k).alias(f"_{k}") for k in by]
    b = b.select(*keys, *(c for c in b.columns if c not in by))
    met = reduce(and_, (a[k].eqNullSafe(b[f"_{k}"]) for k in by), F.lit(True))
    return a.join(b, met).drop(*(f"_{k}" for k in by))


def error_rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """A10: ratios of sums."""
    return runs.groupBy(*by).agg(
        (F.sum("syntax_errors") / F.nullif(F.sum("queries"), F.lit(0))).alias("syntax_error_rate"),
        (F.sum("tool_ok") / F.nullif(F.sum("tool_calls"), F.lit(0))).alias("tool_success_rate")
    )


def tool_usage(calls: DataFrame, n: int = 20) -> DataFrame:
    """The most used tools with their mean latency."""
    return calls.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("mean_ms")
    ).orderBy(F.desc("calls"), "tool_name").limit(n)


def cell_stats(runs: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean and standard error over per-question means (0 for one question)."""
    q = runs.groupBy(*by, "question_id").agg(F.avg(score).alias("m"))
    return q.groupBy(*by).agg(
        F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m") / F.sqrt(F.count("m")), F.lit(0.0)).alias("se"), F.count("m").alias("n")
    )


def paired_cells(runs: DataFrame, config: str, a, b, score: str) -> DataFrame:
    """A12 over the questions that both configurations have."""
    own = lambda x: runs.where(F.col(config) == x).select("question_id").distinct()
    both = own(a).join(own(b), "question_id", "left_semi")
    return cell_stats(runs.where(F.col(config).isin(a, b)).join(both, "question_id", "left_semi"), [config], score)


def group_scores(runs: DataFrame, score: str, cells: list[str]) -> DataFrame:
    """Per question the mean of per-model means, one column a cell."""
    m = runs.groupBy("question_id", "cell", "model").agg(F.avg(score).alias("m"))
    return m.groupBy("question_id").pivot("cell", cells).agg(F.avg("m"))


def subtypes(questions: DataFrame, cut: int = 50) -> DataFrame:
    """(question_id, target_kind, worst_rank, score): entity, displaced or bridged, with group means."""
    kind = F.when(F.col("target_kind") == "instance", "entity").when(F.col("worst_rank") > cut, "displaced").otherwise("bridged")
    return questions.groupBy(kind.alias("subtype")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


def baseline_of(questions: DataFrame) -> DataFrame:
    """(question_id, baseline_id) of variants: SYN01, TYPO01 and LARGE01 belong to BASE01."""
    number = F.regexp_extract("question_id", r"^(?:SYN|TYPO|LARGE)(.*)$", 1)
    return questions.where(F.col("question_id").rlike("^(SYN|TYPO|LARGE)")).select(
        "question_id", F.concat(F.lit("BASE"), number).alias("baseline_id")
    ).distinct()


def deltas(runs: DataFrame, pairs: DataFrame, score: str) -> DataFrame:
    """Variant minus baseline, per model."""
    m = runs.groupBy("question_id", "model").agg(F.avg(score).alias("m"))
    base = m.select(F.col("question_id").alias("baseline_id"), "model", F.col("m").alias("b"))
    return pairs.join(m, "question_id").join(base, ["baseline_id", "model"]).select(
        "question_id", "model", (F.col("m") - F.col("b")).alias("delta")
    )


def summary(runs: DataFrame, measures: list[str], sets: list[list[str]], spread: str | None = None) -> DataFrame:
    """Means (missing values 0) and, if asked, population or sample deviations, for each grouping set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    t = runs.na.fill(0, measures) if spread is None else runs
    dev = {"pop": F.stddev_pop, "samp": F.stddev_samp}.get(spread)
    aggs = [F.count(F.lit(1)).alias("n"), *map(_mean, measures), *([dev(m).alias(f"std_{m}") for m in measures] if dev else [])]
    return (t.groupingSets(sets, *keys) if keys else t.groupBy()).agg(*aggs)


def retrieval_summary(runs: DataFrame, measures: list[str]) -> DataFrame:
    """N, mean and population deviation of each measure over all runs, by approach, by query set and by dataset.

    runs (approach, query_set, dataset, ...); "_LARGE" is taken out of a dataset's name. Missing values are left out.
    """
    t = runs.withColumn("dataset", F.replace("dataset", F.lit("_LARGE"), F.lit("")))
    return summary(t, measures, [[], ["approach"], ["query_set"], ["dataset"]], "pop")


def batch_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """Replicate runs (f1, accuracy, time_ms, tokens, success, unanswerable) of each question, approach and model.

    Means and population deviations (0 for a single value or none, as are the means), the rates of success and of answers that
    the run called impossible.
    """
    zero = F.lit(0.0)
    each = [
        f(m) for m in ("f1", "accuracy", "time_ms", "tokens") for f in (
            lambda c: F.coalesce(F.avg(c), zero).alias(f"mean_{c}"), lambda c: F.coalesce(F.stddev_pop(c), zero).alias(f"std_{c}")
        )
    ]
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f"{c}_rate")
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *each, rate("success"), rate("unanswerable"))


def _syntax_errors(runs: DataFrame) -> DataFrame:
    """Runs with their class: uncorrected (error_type syntax_error and an initial error), corrected or other, and the errors that count."""
    uncorrected = F.coalesce((F.col("error_type") == "syntax_error") & (F.col("initial_error") != ""), F.lit(False))
    corrected = ~uncorrected & F.coalesce("corrected", F.lit(False))
    none = F.array().cast("array<string>")
    found = F.when(uncorrected, F.array("initial_error")).when(corrected, F.coalesce("errors", none)).otherwise(none)
    return runs.select(
        "run_id", uncorrected.alias("uncorrected"), corrected.alias("corrected"), found.alias("found"),
        F.when(corrected & (F.col("iterations") > 0), F.col("iterations")).alias("used")
    )


def syntax_metrics(runs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` commonest errors with how many runs have them; of runs (run_id, error_type, initial_error, corrected, errors, iterations)."""
    e = _syntax_errors(runs).select("run_id", F.explode("found").alias("error"))
    return e.groupBy("error").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs")
    ).orderBy(F.desc("n"), "error").limit(n)


def syntax_summary(runs: DataFrame) -> DataFrame:
    """One row: corrected runs, their percentage, all errors, uncorrected runs, mean iterations of corrected runs; rounded to 1."""
    t = _syntax_errors(runs)
    rate = F.coalesce(F.round(100 * F.count_if("corrected") / F.count(F.lit(1)), 1), F.lit(0.0))
    return t.agg(
        F.count_if("corrected").alias("corrections"), rate.alias("correction_rate"),
        F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("errors"), F.count_if("uncorrected").alias("uncorrected"),
        F.coalesce(F.round(F.avg("used"), 1), F.lit(0.0)).alias("mean_iterations")
    )


def template_summary(runs: DataFrame, score: str) -> DataFrame:
    """Mean, sample variance and failures by template."""
    return runs.groupBy("template").agg(
        F.avg(score).alias("mean"), F.var_samp(score).alias("variance"), F.count_if(~F.col("success")).alias("failures")
    )


#: Thresholds of the problem rules: very low and low recall, partial concepts and success (fixed values).
LOW, MIDDLE, HIGH = 0.3, 0.7, 0.8
#: What low recall is put down to, by ambiguity (fixed values).
CAUSES = {
    "case_variation": "instance_case_mismatch", "synonym": "instance_synonym_not_resolved", "temporal": "instance_temporal_not_resolved",
    "fuzzy_typo": "instance_fuzzy_not_resolved",
    "cross_dataset": "cross_missing_query", "multi_step": "cross_missing_query",
}


def detect_problems(runs: DataFrame) -> DataFrame:
    """(run_id, question_id, ambiguity, problem, severity), a row a problem of a run.

    Runs have n_rows, schema_recall, n_matched concepts, measurements and missing (arrays of concepts), best_recall, ambiguity.
    """
    c = F.col
    problem = lambda name, severity: F.struct(name.alias("problem"), F.lit(severity).alias("severity"))
    short = (F.size("measurements") > 0) & (c("n_matched") < F.size("measurements")) & F.arrays_overlap("measurements", "missing")
    cause = F.coalesce(
        F.element_at(F.create_map(*(F.lit(x) for kv in CAUSES.items() for x in kv)), F.coalesce("ambiguity", F.lit("none"))),
        F.lit("low_recall")
    )
    low = (c("best_recall") < MIDDLE) & (c("n_rows") != 0)
    rules = [
        F.when(c("n_rows") == 0, problem(F.lit("empty_over_constrained"), "critical")),
        F.when(
            c("schema_recall") == 0, problem(F.lit("concept_missing"), "critical")
        ).when(c("schema_recall") < HIGH, problem(F.lit("concept_partial"), "major")),
        F.when(short, problem(F.lit("measurement_missing"), "major")),
        F.when(low & (c("best_recall") < LOW), problem(cause, "critical")).when(low, problem(cause, "major")),
        F.when(short, problem(F.lit("agg_missing_group_by"), "major")),
    ]
    return runs.select(
        "run_id", "question_id", "ambiguity", F.explode(F.array_compact(F.array(*rules))).alias("p")
    ).select("run_id", "question_id", "ambiguity", "p.problem", "p.severity")


def category_stats(runs: DataFrame, by: list[str], f1: str = "f1") -> DataFrame:
    """Successes (F1 >= 0.8), partial ones, failures (0) and the mean."""
    x = F.col(f1)
    return runs.groupBy(*by).agg(
        F.count_if(x >= HIGH).alias("success"), F.count_if((x < HIGH) & (x > 0)).alias("partial"), F.count_if(x == 0).alias("failure"),
        F.avg(x).alias("mean_f1")
    )


def correlations(problems: DataFrame, runs: DataFrame) -> DataFrame:
    """P(problem given ambiguity)."""
    n = runs.groupBy("ambiguity").agg(F.count(F.lit(1)).alias("n"))
    k = problems.groupBy("ambiguity", "problem").agg(F.count_distinct("run_id").alias("k"))
    return k.join(n, "ambiguity").select(
        "ambiguity", "problem", (F.col("k") / F.col("n")).alias("p")
    ).orderBy(F.desc("p"), "ambiguity", "problem")


def report(runs: DataFrame, problems: DataFrame) -> DataFrame:
    """The five hardest questions and ten commonest problems."""
    hard = runs.groupBy(F.col("question_id").alias("name")).agg(F.avg("f1").alias("value")).orderBy("value", "name").limit(5)
    common = problems.groupBy(F.col("problem").alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).orderBy(F.desc("value"), "name").limit(10)
    return hard.withColumn("part", F.lit("hardest")).unionByName(common.withColumn("part", F.lit("commonest")))


def merge_runs(first: DataFrame, second: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Predictions (question_id, prediction): the later run wins, or the source (1 or 2) that ``plan`` fixes; empty ones drop out."""
    keep = lambda df, n: df.where(F.trim("prediction") != "").select("question_id", F.col("prediction").alias(n))
    both = keep(first, "p1").join(keep(second, "p2"), "question_id", "full")
    both = both.join(plan, "question_id", "left") if plan is not None else both.withColumn("source", F.lit(None).cast("int"))
    return both.select(
        "question_id",
        F.when(
            F.col("source") == 1, F.col("p1")
        ).when(F.col("source") == 2, F.col("p2")).otherwise(F.coalesce("p2", "p1")).alias("prediction")
    ).where("prediction is not null")


def missing_questions(questions: DataFrame, merged: DataFrame) -> DataFrame:
    """Questions without a prediction."""
    return questions.select("question_id").join(merged, "question_id", "left_anti")


def skip_report(runs: DataFrame, readings: DataFrame) -> DataFrame:
    """Runs by why they can't be evaluated, next to those that are."""
    t = runs.join(readings.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_readings")), "question_id", "left")
    reason = F.when(F.col("n_readings").isNull(), "no_reading").when(~F.col("success"), "failed_run").when(
        F.col("prediction").isNull(), "no_prediction"
    ).otherwise("evaluated")
    return t.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
