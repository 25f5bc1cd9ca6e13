"""Confidence of steps and plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.keywords import let
from quern.functions.text import search_quality


def tool_success(done: Column, runs: Column, rate: Column) -> Column:
    """Share of a step's tool runs that succeeded; without runs the rate given."""
    return F.when(runs == 0, rate).otherwise(done / runs)


def penalties(search: Column, found: Column, rate: Column, sources: Column, own: Column) -> tuple[Column, Column]:
    """(factor, array<string> of names): no results of a search, failed tools, no sources (but for searches with results and sure answers)."""
    none = search & (found == 0)
    failed = rate < 1.0
    bare = (sources == 0) & ~(search & (found > 0)) & ~(~search & (own >= 0.8))
    factor = F.when(none, 0.5).otherwise(1.0) * F.when(failed, rate * 0.2 + 0.8).otherwise(1.0) * F.when(bare, 0.7).otherwise(1.0)
    names = F.array(F.when(none, "no_search_results"), F.when(failed, F.format_string("tool_failures(rate=%.2f)", rate)), F.when(bare, "no_sources"))
    return factor, F.array_compact(names)


def score(search: Column, quality: Column, agreement: Column, own: Column, covered: Column, success: Column, sources: Column, factor: Column) -> Column:
    """A step's confidence, 0 to 1, three places: of a search its quality times its tools' success; else the weighted mean of the factors that hold."""
    parts = [(quality > 0, quality, 0.6), (F.lit(True), success, 0.4), (sources > 1, agreement, 0.2), (own > 0.6, own, 0.3), (covered > 0.1, covered, 0.1)]
    total = sum((F.when(on, v * w).otherwise(0.0) for on, v, w in parts), F.lit(0.0))
    weights = sum((F.when(on, w).otherwise(0.0) for on, _, w in parts), F.lit(0.0))
    base = F.when(search, quality * F.when(success < 1.0, success).otherwise(1.0)).otherwise(total / weights)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * factor)), 3)


def aggregated(steps: DataFrame, plan: str, order: str, score: str) -> DataFrame:
    """(plan, mean, least, weighted, checked, critical): weights are places in the plan; a score under 0.3 cuts the mean by 0.7."""
    place = F.row_number().over(W.partitionBy(plan).orderBy(order))
    s = F.col(score)
    return steps.withColumn("_n", place).groupBy(plan).agg(
        F.round(F.avg(s), 6).alias("mean"), F.round(F.min(s), 6).alias("least"), F.round(F.sum(s * F.col("_n")) / F.sum("_n"), 6).alias("weighted"),
        F.round(F.avg(s) * F.when(F.bool_or(s < 0.3), 0.7).otherwise(1.0), 6).alias("checked"), F.bool_or(s < 0.3).alias("critical"),
    )


def ready(steps: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, step_id, ready): whether all steps that a step depends on have succeeded; none: true."""
    needs = steps.select("plan_id", "step_id", F.explode_outer("depends_on").alias("need"))
    done = results.select(F.col("plan_id").alias("p"), F.col("step_id").alias("s"), (F.col("status") == "success").alias("ok"))
    met = needs.join(done, (F.col("plan_id") == F.col("p")) & (F.col("need") == F.col("s")), "left")
    return met.groupBy("plan_id", "step_id").agg(F.bool_and(F.col("need").isNull() | F.coalesce("ok", F.lit(False))).alias("ready"))


START = (0.9, 0.7, 0.4)


def moved(state: tuple, recent: list, last: int = 10) -> tuple:
    """Thresholds (silent, notify, confirm) after a record: of the `last` records, the new one included, over 30 % confident but
    wrong raise all three by 0.05, else over 30 % doubtful but right lower them; fewer records change nothing."""
    a, b, c = state
    if len(recent) < last:
        return state
    if sum(x > b and not ok for x, ok in recent) / last > 0.3:
        a, b, c = min(0.95, a + 0.05), min(0.85, b + 0.05), min(0.6, c + 0.05)
    elif sum(x < c and ok for x, ok in recent) / last > 0.3:
        a, b, c = max(0.8, a - 0.05), max(0.6, b - 0.05), max(0.3, c - 0.05)
    return round(a, 6), round(b, 6), round(c, 6)


def _states() -> list[tuple]:
    """All thresholds that can be reached."""
    found = [START]
    for s in found:
        for x, ok in ((1.0, False), (0.0, True)):
            found += [n for n in [moved(s, [(x, ok)] * 10)] if n not in found]
    return found


def thresholds(feedback: DataFrame, key: str = "user_id", last: int = 10) -> DataFrame:
    """(key, silent, notify, confirm) after a fold by `moved` over each key's feedback (ts, confidence, was_correct) in order.

    Records go by ts, then confidence, then was_correct, nulls first; a null confidence is neither sure nor doubtful, a null
    was_correct is wrong. Records are sorted over all tasks, so a key may span several: each gives its first records and what the
    others make of every state the thresholds can be in (they are few), and a second fold takes these, one a task, in order.
    """
    states = _states()
    place = {s: i for i, s in enumerate(states)}
    of = feedback.schema[key].dataType.simpleString()
    record = "struct<x: double, ok: boolean>"
    up, down = (np.array([place[moved(s, [r] * 10)] for s in states]) for r in ((1.0, False), (0.0, True)))
    sure, low = (np.array([s[i] for s in states]) for i in (1, 2))

    def often(hit: np.ndarray) -> np.ndarray:
        """For each window of `last` rows and each state, whether over 30 % of the rows hit."""
        total = np.concatenate([np.zeros((1, hit.shape[1]), int), np.cumsum(hit, axis=0)])
        return (total[last:] - total[:-last]) / last > 0.3

    def pieces(batches):
        task, now, head, xs, oks, to = TaskContext.get().partitionId(), None, [], np.empty(0), np.empty(0, bool), None

        def out() -> pd.DataFrame:
            listed = lambda x, ok: [{"x": float(a), "ok": bool(b)} for a, b in zip(x, ok, strict=True)]
            tail = listed(xs, oks) if full else []
            return pd.DataFrame({key: pd.Series([now[0]], dtype=object), "_task": [task], "_head": [listed(*zip(*head, strict=True)) if head else []], "_tail": [tail], "_to": [to.tolist()]})

        for pdf in batches:
            names = pdf[key]
            x, ok = pdf["confidence"].to_numpy(float, na_value=np.nan), (pdf["was_correct"] == True).to_numpy(bool)  # noqa: E712
            cuts = np.flatnonzero(np.diff(pd.factorize(names)[0])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if lo == hi:
                    continue
                k = None if pd.isna(names.iloc[lo]) else names.iloc[lo]
                if now != (k,):
                    if now:
                        yield out()
                    now, head, xs, oks, to, full = (k,), [], np.empty(0), np.empty(0, bool), np.arange(len(states)), False
                take = min(last - 1 - len(head), hi - lo)
                full = full or hi - lo > take
                head += list(zip(x[lo : lo + take], ok[lo : lo + take], strict=True))
                xs, oks = np.concatenate([xs, x[lo:hi]]), np.concatenate([oks, ok[lo:hi]])
                if len(xs) >= last:
                    more, less = often((xs[:, None] > sure) & ~oks[:, None]), often((xs[:, None] < low) & oks[:, None])
                    for r in np.flatnonzero(more.any(axis=1) | less.any(axis=1)):
                        to = np.where(more[r][to], up[to], np.where(less[r][to], down[to], to))
                xs, oks = xs[-(last - 1) :], oks[-(last - 1) :]
        if now:
            yield out()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, recent = START, []
        for _, head, tail, to in sorted(zip(pdf["_task"], pdf["_head"], pdf["_tail"], pdf["_to"], strict=True), key=lambda r: r[0]):
            for r in head:
                recent = [*recent, (r["x"], r["ok"])][-last:]
                state = moved(state, recent, last)
            if len(tail):
                state, recent = states[to[place[state]]], [(r["x"], r["ok"]) for r in tail]
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]], dtype=object), "silent": [state[0]], "notify": [state[1]], "confirm": [state[2]]})

    rows = feedback.select(key, "ts", F.col("confidence").cast("double").alias("confidence"), "was_correct")
    order = [key, "ts", "confidence", "was_correct"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranges.mapInPandas(pieces, f"`{key}` {of}, _task int, _head array<{record}>, _tail array<{record}>, _to array<int>")
    return parts.groupBy(key).applyInPandas(fold, f"`{key}` {of}, silent double, notify double, confirm double")


def assembled(plans: DataFrame) -> DataFrame:
    """(plan_id, step_id, confidence) of the steps of each plan, in order of step_id.

    `plans` has a row a step: plan_id, step_id, action, depends_on, status, n_results, top, mean, variance (of its results' scores),
    n_sources, agreement (null: 1). A failed step has 0. A step that isn't a search and has no results takes the best confidence of
    the steps it depends on for its results' scores, as one result; so confidences run along the plan, which is folded in the row
    (a plan is a model's answer, its steps are few). Nulls: no results, no sources, variance 1.
    """
    names = ("step_id", "action", "depends_on", "status", "n_results", "top", "mean", "variance", "n_sources", "agreement")
    one = plans.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_steps"))
    zero = F.lit(0.0)

    def add(done: Column, s: Column) -> Column:
        search = s["action"].isin("rag_search", "web_search")
        before = F.coalesce(F.array_max(F.transform(F.filter(done, lambda d: F.array_contains(s["depends_on"], d["step_id"])), lambda d: d["confidence"])), zero)
        own = F.coalesce(s["n_results"], F.lit(0)) > 0
        n = F.coalesce(s["n_sources"], F.lit(0))
        right = F.coalesce(s["status"] == "success", F.lit(False))

        def seen(best: Column) -> Column:
            takes = ~own & ~search & (best > 0)
            top, mean = (F.when(takes, best).otherwise(F.coalesce(s[c], zero)) for c in ("top", "mean"))
            found = F.when(own, s["n_results"]).when(takes, 1).otherwise(0)
            quality = F.when(found > 0, search_quality(top, mean, F.coalesce(s["variance"], F.lit(1.0)))).otherwise(zero)
            return F.struct(found.alias("found"), quality.alias("quality"))

        def judged(x: Column) -> Column:
            factor, _ = penalties(search, x["found"], F.lit(1.0), n, zero)
            value = score(search, x["quality"], F.coalesce(s["agreement"], F.lit(1.0)), zero, zero, F.lit(1.0), n, factor)
            return F.struct(s["step_id"].alias("step_id"), F.when(right, value).otherwise(zero).alias("confidence"))

        return F.array_append(done, let(let(before, seen), judged))

    kind = plans.schema["step_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<step_id: {kind}, confidence: double>>")
    return one.select("plan_id", F.inline(F.aggregate("_steps", none, add)))


def overridden(judged: Column, found: Column, searched: Column, sure: float = 0.9) -> Column:
    """A judge's confidence, or a search's best score if that is higher and over `sure`."""
    return F.when(searched & (found > sure), F.greatest(judged, found)).otherwise(judged)


def level(score: Column, silent: Column, notify: Column, confirm: Column) -> Column:
    """What to do at a confidence under thresholds of one's own, such as those of `thresholds`; a null score is escalated."""
    return F.when(score >= silent, "silent").when(score >= notify, "notify").when(score >= confirm, "confirm").otherwise("escalate")
