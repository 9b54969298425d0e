"""Request outcomes of one server: histograms, ratios, phases around a change and gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions.scalars import in_window, ratio


def server_requests(events: DataFrame, server: str, start, end) -> DataFrame:
    """Recommendation requests of the window with `attributed` (null server) and `status_text`.

    Other servers are dropped. A request without server cannot be attributed.
    """
    host = F.trim(F.col("fields.server"))
    unknown = F.coalesce(host == "", F.lit(True))
    rows = events.where((F.col("event_type") == "recommendation") & in_window(F.col("event_ts"), start, end))
    return (rows.where(unknown | (F.lower(host) == server.lower()))
            .withColumn("attributed", ~unknown)
            .withColumn("status_text", F.coalesce(F.col("fields.status").cast("string"), F.lit("unknown"))))


def status_histogram(requests: DataFrame) -> DataFrame:
    return requests.where("attributed").groupBy("status_text").agg(F.count(F.lit(1)).alias("requests"))


def _outcome() -> list[Column]:
    ok = F.col("attributed") & (F.col("status_text") == "200")
    return [F.count_if("attributed").alias("requests"), F.count_if(ok).alias("successful"),
            F.count_if(F.col("attributed") & (F.col("status_text") != "200")).alias("failed"),
            F.count_if(~F.col("attributed")).alias("unattributed")]


def availability(requests: DataFrame, bracketed: DataFrame) -> DataFrame:
    """Success ratios; the unqualified ones only when every partition encloses the window.

    The conservative ratio counts unattributed requests as failures. bracketed: one row with
    `window_bracketed`.
    """
    row = requests.agg(*_outcome()).crossJoin(F.broadcast(bracketed))  # one row each
    covered = F.col("window_bracketed") & (F.col("requests") > 0)
    return row.withColumns({
        "observed_ratio": ratio(F.col("successful"), F.col("requests")),
        "ratio": F.when(covered, ratio(F.col("successful"), F.col("requests"))),
        "conservative_ratio": F.when(covered, ratio(F.col("successful"), F.col("requests") + F.col("unattributed")))})


def before_after(requests: DataFrame, switch) -> DataFrame:
    """The same counts before, after and over all, in one pass: (phase, requests, ..., availability)."""
    phase = F.when(F.col("event_ts") < F.lit(switch).cast("timestamp"), "before").otherwise("after")
    rows = requests.withColumn("phase", phase).rollup("phase").agg(*_outcome())
    return rows.select(F.coalesce("phase", F.lit("overall")).alias("phase"), "requests", "successful", "failed",
                       "unattributed", ratio(F.col("successful"), F.col("requests")).alias("availability"))


def evidence_usable(phases: DataFrame, bracketed: DataFrame) -> DataFrame:
    """One row `usable`: window enclosed, nothing unattributed, requests on both sides."""
    count = lambda name: F.coalesce(F.sum(F.when(F.col("phase") == name, F.col("requests"))), F.lit(0))
    lost = F.coalesce(F.sum(F.when(F.col("phase") == "overall", F.col("unattributed"))), F.lit(0))
    sides = phases.agg(((count("before") > 0) & (count("after") > 0) & (lost == 0)).alias("_ok"))
    return sides.crossJoin(F.broadcast(bracketed)).select((F.col("_ok") & F.col("window_bracketed")).alias("usable"))


def metric_gauges(report: DataFrame, max_age_seconds: float, always: tuple[str, ...] = ("collector_age_seconds",)) -> DataFrame:
    """One-row report of numeric columns to (name, value); a stale report keeps only collector values."""
    age = F.col("collector_age_seconds")
    fresh = F.coalesce((age >= 0) & (age <= max_age_seconds), F.lit(False))
    known = report.withColumn("collector_fresh", fresh.cast("double"))
    names = [c for c in known.columns]
    doubles = known.select(*[F.col(c).cast("double").alias(c) for c in names])
    rows = doubles.select(F.expr(f"stack({len(names)}, {', '.join(f'{c!r}, `{c}`' for c in names)}) as (name, value)"),
                          (F.col("collector_fresh") == 1).alias("_fresh"))
    return rows.select("name", F.when(F.col("_fresh") | F.col("name").startswith("collector_"), F.col("value")).alias("value"))
