"""Measures of write tasks and of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import base_name, megabytes, value_bytes
from .blocks import numbered

#: Upper bounds of the write delay classes, in milliseconds.
DELAY_BOUNDS = (50, 100, 500)
#: Samples of a series that one task takes at a time.
CHUNK = 4096


def legend():
    """A task's column in comparisons: mode, threads, id."""
    mode = F.when(F.col("type") == 0, "plain").otherwise("separated")
    return F.concat(mode, F.lit("-"), F.col("thread").cast("string"), F.lit("t-"), F.col("id").cast("string"))


def task_measures(tasks: DataFrame) -> DataFrame:
    """Of each task: label, legend, whole MB written, seconds, write amplification and MB a second."""
    return tasks.select(
        "id", "thread", "type",
        base_name(F.col("data_path")).alias("label"),
        legend().alias("legend"),
        megabytes(F.col("written_size")).alias("written_mb"),
        F.col("write_duration").alias("seconds"),
        (F.col("written_total").cast("double") / F.col("written_size")).alias("write_amplification"),
        (F.col("data_size") / F.col("write_duration") / 1048576).alias("mb_per_second"),
    )


def compare(tasks: DataFrame, measure: str, legends: list[str]) -> DataFrame:
    """One row for each dataset and a column for each legend; missing cells are 0."""
    wide = task_measures(tasks).groupBy("label").pivot("legend", legends).agg(F.max(measure).cast("double"))
    return wide.na.fill(0.0)


def legends_of(tasks: DataFrame) -> list[str]:
    """Legends in the order of tasks: threads, then mode, both descending; tasks are few."""
    return [r["legend"] for r in task_order(tasks).select(legend().alias("legend")).collect()]


def task_order(tasks: DataFrame) -> DataFrame:
    """Tasks as a comparison lists them."""
    return tasks.orderBy(F.col("thread").desc(), F.col("type").desc(), F.col("id").desc())


def running_latency(samples: DataFrame, by: str, at: str, value: str, last: int = 4) -> DataFrame:
    """Mean of the last samples that are not 0, at each sample.

    A series is cut into chunks of ``CHUNK`` samples; a chunk also gets the few
    samples before it, so chunks need no other and a long series is many tasks.
    """
    placed = numbered(samples, [by], at)
    chunk = F.floor(F.col("place") / CHUNK)
    ahead = F.when(F.col("place") % CHUNK >= CHUNK - (last - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = placed.withColumn("chunk", F.explode(ahead))
    order = Window.partitionBy(by, "chunk").orderBy("place").rowsBetween(-(last - 1), 0)
    told = spread.withColumn("latency", F.avg(F.when(F.col(value) != 0, F.col(value))).over(order))
    return told.where(F.col("chunk") == chunk).drop("chunk", "place")


def coupled_averages(samples: DataFrame, by: str, at: str) -> DataFrame:
    """Final values of two averages that halve towards each other's, over positive samples ``td`` and ``tg`` in order.

    Each update of the first is ``(td + second) / 2`` and of the second then
    ``(tg + first) / 2``; samples that are not positive change nothing.  Both are 0
    at first.  An update is linear in the two values, so a chunk of samples is two
    rows of three numbers, and chunks of chunks likewise until one is left: no task
    gathers more than ``CHUNK`` rows of a series.
    """
    # What a chunk does to (first, second): first = f0 + f1 first + f2 second, and second by g0, g1, g2.
    half = lambda given, x: [(x[0] + given) / 2, x[1] / 2, x[2] / 2]
    pick = lambda test, a, b: [F.when(test, x).otherwise(y) for x, y in zip(a, b, strict=True)]
    one = lambda a, b, c: [F.lit(float(v)) for v in (a, b, c)]
    first = pick(F.col("td") > 0, half(F.col("td"), one(0, 0, 1)), one(0, 1, 0))
    second = pick(F.col("tg") > 0, half(F.col("tg"), first), one(0, 0, 1))
    names = [f"{r}{k}" for r in "fg" for k in range(3)]
    steps = numbered(samples, [by], at).select(by, "place", *(c.cast("double").alias(n) for c, n in zip([*first, *second], names, strict=True)))
    most = steps.agg(F.max("place")).first()[0]

    def after(s, x):
        out = [x[f"{r}0"] * (1.0 if k == 0 else 0.0) + x[f"{r}1"] * s[f"f{k}"] + x[f"{r}2"] * s[f"g{k}"] for r in "fg" for k in range(3)]
        return F.struct(*(c.alias(n) for c, n in zip(out, names, strict=True)))

    start = F.struct(*(F.lit(v).alias(n) for v, n in zip((0.0, 1.0, 0.0, 0.0, 0.0, 1.0), names, strict=True)))
    while most is not None:
        chunks = steps.groupBy(by, F.floor(F.col("place") / CHUNK).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", *names))).alias("all"))
        steps = chunks.select(by, "place", F.aggregate("all", start, after).alias("s")).select(by, "place", *(f"s.{n}" for n in names))
        most = None if most < CHUNK else most // CHUNK
    return steps.select(by, F.col("f0").alias("avg_td"), F.col("g0").alias("avg_tg"))


def delay_classes(samples: DataFrame, delay: str) -> DataFrame:
    """Cumulative counts of delays up to each bound, and of all."""
    counts = [F.sum((F.col(delay) <= b).cast("bigint")).alias(f"le_{b}") for b in DELAY_BOUNDS]
    return samples.agg(*counts, F.count(F.lit(1)).alias("n"), F.sum(delay).alias("total"))


def store_gauges(points: DataFrame) -> DataFrame:
    """Counters and gauges of points as ``(metric, label, value)``: points, bytes, series and times, by type of field."""
    by = points.groupBy("ftype").agg(
        F.count(F.lit(1)).alias("points_total"), F.sum(value_bytes()).alias("bytes_total"), F.countDistinct("key", "field").alias("series"), F.min(F.expr("ts_ns div 1000000000")).alias("oldest_seconds"), F.max(F.expr("ts_ns div 1000000000")).alias("newest_seconds")
    )
    names = [c for c in by.columns if c != "ftype"]
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return by.select(F.concat(F.lit('type="'), "ftype", F.lit('"')).alias("label"), F.explode(pairs).alias("p")).select("p.metric", "label", "p.value")


def histogram_metrics(classes: DataFrame, metric: str) -> DataFrame:
    """The one row of :func:`delay_classes` as ``(metric, label, value)``: cumulative buckets, count and sum."""
    parts = [(f"{metric}_bucket", f'le="{b}"', f"le_{b}") for b in DELAY_BOUNDS] + [(f"{metric}_bucket", 'le="+Inf"', "n"), (f"{metric}_count", "", "n"), (f"{metric}_sum", "", "total")]
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"), F.col(c).cast("double").alias("value")) for m, label, c in parts))
    return classes.select(F.explode(rows).alias("p")).select("p.*")


def exposition(metrics: DataFrame) -> DataFrame:
    """``line`` of each ``(metric, label, value)`` in the text format that metric scrapers read."""
    label = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit("{"), "label", F.lit("}")))
    whole = F.col("value") == F.floor("value")
    number = F.when(whole & (F.abs("value") < 1e18), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    return metrics.select(F.concat("metric", label, F.lit(" "), number).alias("line"))
