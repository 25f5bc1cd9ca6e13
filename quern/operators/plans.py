"""Plans as rows with an array of steps: when and how to plan again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_REPLANS, LEAST_CONFIDENCE, EARLY = 3, 0.4, 0.34
# Words by which a user asks for another plan, and for one from the start.
ASKED = ("修正", "変更", "やり直し", "違う", "別の")
FROM_START = "最初から"


def trigger(status: Column, confidence: Column, replans: Column, feedback: Column | None = None) -> Column:
    """step_failed, low_confidence or user_feedback; null where the plan stays or was replaced too often."""
    asked = F.coalesce(F.coalesce(feedback, F.lit("")).rlike("|".join(ASKED)), F.lit(False)) if feedback is not None else F.lit(False)
    why = F.when(status == "failed", "step_failed").when(confidence < LEAST_CONFIDENCE, "low_confidence").when(asked, "user_feedback")
    return F.when(replans < MOST_REPLANS, why)


def strategy(why: Column, replans: Column, step: Column, steps: Column, fallback: Column, feedback: Column | None = None) -> Column:
    """abort, fallback, full or partial: an early failure (a third of the plan) or a timeout takes a new plan, others its rest."""
    start = F.coalesce(feedback.contains(FROM_START), F.lit(False)) if feedback is not None else F.lit(False)
    return (
        F.when(replans >= MOST_REPLANS, "abort")
        .when((why == "step_failed") & fallback.isNotNull() & (fallback != ""), "fallback")
        .when(why == "timeout", "full")
        .when(why == "user_feedback", F.when(start, "full").otherwise("partial"))
        .when(step / steps <= EARLY, "full")
        .otherwise("partial")
    )


def with_fallback(plans: DataFrame, failed: str, steps: str = "steps") -> DataFrame:
    """`plans` whose failed step is replaced by its fallback action, if it has one; that has no further fallback."""

    def replace(s: Column) -> Column:
        other = s.withField("action", s["fallback"]).withField("description", F.concat(F.lit("[代替] "), s["description"])).withField("fallback", F.lit(None).cast("string"))
        return F.when((s["step_id"] == F.col(failed)) & (s["fallback"] != ""), other).otherwise(s)

    return plans.withColumn(steps, F.transform(steps, replace))


def without_step(plans: DataFrame, failed: str, steps: str = "steps") -> DataFrame:
    """`plans` without their failed step, which no other depends on any more; a null one leaves the plan."""
    kept = F.filter(steps, lambda s: ~F.coalesce(s["step_id"] == F.col(failed), F.lit(False)))
    cut = lambda s: s.withField("depends_on", F.filter(s["depends_on"], lambda d: ~F.coalesce(d == F.col(failed), F.lit(False))))
    return plans.withColumn(steps, F.transform(kept, cut))


def renumbered(plans: DataFrame, done: str, steps: str = "steps") -> DataFrame:
    """New steps numbered on from the `done` ones, each depending on the one before."""

    def number(s: Column, i: Column) -> Column:
        new = (F.col(done) + i + 1).cast("int")
        return s.withField("step_id", new).withField("depends_on", F.when(new > 1, F.array(new - 1)).otherwise(F.array().cast("array<int>")))

    return plans.withColumn(steps, F.transform(steps, number))


def inherited(steps: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, step_id, confidence): 0 for a failed step; a step without own results takes the best confidence it depends on.

    steps: plan_id, step_id, action, depends_on; results: plan_id, step_id, status, n_results, confidence. Searches keep their own.
    """
    own = steps.join(results, ["plan_id", "step_id"], "left")
    needs = steps.select("plan_id", "step_id", F.explode("depends_on").alias("_need"))
    before = results.select(F.col("plan_id").alias("_p"), F.col("step_id").alias("_s"), F.col("confidence").alias("_c"))
    best = needs.join(before, (F.col("plan_id") == F.col("_p")) & (F.col("_need") == F.col("_s"))).groupBy("plan_id", "step_id").agg(F.max("_c").alias("_best"))
    idle = (F.coalesce("n_results", F.lit(0)) == 0) & ~F.col("action").isin("rag_search", "web_search") & (F.col("_best") > 0)
    score = F.when(F.coalesce("status", F.lit("failed")) != "success", 0.0).when(idle, F.col("_best")).otherwise(F.col("confidence"))
    return own.join(best, ["plan_id", "step_id"], "left").select("plan_id", "step_id", score.alias("confidence"))


def invalid_dependencies(steps: DataFrame) -> DataFrame:
    """(plan_id, step_id, need, problem): dependencies on a step that the plan hasn't ("unknown") and on a step not before ("backward"); one may be both."""
    needs = steps.select("plan_id", "step_id", F.explode("depends_on").alias("need"))
    there = steps.select(F.col("plan_id").alias("_p"), F.col("step_id").alias("_s")).distinct()
    both = needs.join(there, (F.col("plan_id") == F.col("_p")) & (F.col("need") == F.col("_s")), "left")
    problems = F.array_compact(F.array(F.when(F.col("_s").isNull(), "unknown"), F.when(F.col("need") >= F.col("step_id"), "backward")))
    return both.select("plan_id", "step_id", "need", F.explode(problems).alias("problem"))


def step_inputs(steps: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, step_id, inputs): the outputs of the steps that a step depends on and that succeeded, by step; an empty array without any."""
    needs = steps.select("plan_id", "step_id", F.explode_outer("depends_on").alias("_need"))
    done = results.where("status = 'success'").select(F.col("plan_id").alias("_p"), F.col("step_id").alias("_s"), "output")
    both = needs.join(done, (F.col("plan_id") == F.col("_p")) & (F.col("_need") == F.col("_s")), "left")
    found = F.sort_array(F.collect_list(F.when(F.col("output").isNotNull(), F.struct("_s", "output"))))
    return both.groupBy("plan_id", "step_id").agg(found.alias("_l")).select("plan_id", "step_id", F.col("_l.output").alias("inputs"))
