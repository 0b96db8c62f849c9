"""Range, containment and as-of joins. All take the columns that bind rows to one video as equi keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contained(spans: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, *, how: str = "inner", bucket: float | None = None) -> DataFrame:
    """Points with ``start <= at < end`` of the span. ``keys`` are equi keys of both sides.

    With ``bucket`` the time axis is cut into buckets of so many seconds, and the bucket is one more equi key: a span
    goes to each bucket that it touches, a point to its own. So the work of a long video is spread over tasks and a span
    meets only the points near it. Each pair meets in one bucket, that of the point.
    """
    spans, points = spans.alias("s"), points.alias("p")
    on = [F.col(f"s.{k}") == F.col(f"p.{k}") for k in keys]
    inside = (F.col(f"p.{at}") >= F.col(f"s.{start}")) & (F.col(f"p.{at}") < F.col(f"s.{end}"))
    if bucket is None:
        return spans.join(points, [*on, inside], how)
    if how != "inner":
        raise ValueError("a bucketed join is an inner join; join its result back for the others")
    last = F.greatest(F.floor(F.col(f"s.{end}") / bucket), F.floor(F.col(f"s.{start}") / bucket))
    cut = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(f"s.{start}") / bucket), last))).alias("s")
    dealt = points.withColumn("bucket_", F.floor(F.col(f"p.{at}") / bucket)).alias("p")
    return cut.join(dealt, [*on, F.col("s.bucket_") == F.col("p.bucket_"), inside], how).drop("bucket_")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", *, bucket: float | None = None) -> DataFrame:
    """Pairs of half-open intervals (start_seconds, end_seconds) that overlap; sides are aliased ``l`` and ``r``.

    With ``bucket`` both sides go to each bucket of so many seconds that they touch, which is one more equi key; a pair counts
    in the bucket in which the later of the two starts.
    """
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    met = [F.col("r.end_seconds") > F.col("l.start_seconds"), F.col("r.start_seconds") < F.col("l.end_seconds")]
    if bucket is None:
        return l.join(r, [*on, *met], how)
    if how != "inner":
        raise ValueError("a bucketed join is an inner join; join its result back for the others")
    number = lambda c: F.floor(F.col(c) / bucket)
    cut = lambda df, a: df.withColumn("bucket_", F.explode(F.sequence(number(f"{a}.start_seconds"), F.greatest(number(f"{a}.start_seconds"), number(f"{a}.end_seconds"))))).alias(a)
    later = F.floor(F.greatest(F.col("l.start_seconds"), F.col("r.start_seconds")) / bucket)
    return cut(l, "l").join(cut(r, "r"), [*on, F.col("l.bucket_") == F.col("r.bucket_"), later == F.col("l.bucket_"), *met]).drop("bucket_")


def look_up(left: DataFrame, right: DataFrame, keys: list[str], time: str, wanted: dict[str, tuple[str, str]], *, bucket: float | None = None, bucket_as: str | None = None, tasks: int | None = None) -> DataFrame:
    """``left`` with, for each name of ``wanted``, a value of the nearest row of ``right`` on one side of its time.

    ``wanted`` gives a column of ``right`` and a direction: ``backward`` takes its last value that is not null at or before
    ``time``, ``forward`` the first at or after. Of several at one time the greatest counts backward, the smallest forward. Rows
    of ``right`` without a time match nothing, and rows of ``left`` without a time or key find nothing.

    Both sides meet in one union and one sort for each direction. With ``bucket`` the time axis is cut into buckets of so many
    seconds, which join the keys: rows are sorted within a bucket only, and what reaches a bucket from those before (after) it
    comes from a window over the buckets alone, one short row each. So a long video spreads over tasks. ``bucket_as`` names a
    column for the number of a row's bucket: windows that have it and ``keys`` among their keys need no further shuffle. ``tasks`` deals
    the buckets out to so many tasks, which are not joined again when their files are small.
    """
    values = list(dict.fromkeys(c for c, _ in wanted.values()))
    types = {c: right.schema[c].dataType for c in values}
    right = right.select(*keys, time, *[F.col(c).alias(f"_of_{c}") for c in values]).filter(F.col(time).isNotNull()).withColumn("_side", F.lit(0))
    both = left.withColumns({f"_of_{c}": F.lit(None).cast(t) for c, t in types.items()}).withColumn("_side", F.lit(1)).unionByName(right, allowMissingColumns=True)
    of = [F.col(f"_of_{c}") for c in values]
    within = list(keys)
    if bucket is not None:
        both, within = both.withColumn("_bucket", F.floor(F.col(time) / bucket)), [*keys, "_bucket"]
        both = both if tasks is None else both.repartition(tasks, *within)
    whole = Window.partitionBy(*within).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = {"backward": whole.orderBy(F.col(time), "_side", *of), "forward": whole.orderBy(F.col(time).desc(), "_side", *[c.desc() for c in of])}
    known = F.col(time).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    found = both.withColumns({f"_got_{n}": F.when(known, F.last(f"_of_{c}", ignorenulls=True).over(order[d])) for n, (c, d) in wanted.items()}).filter("_side = 1")
    if bucket is None:
        return found.select(*left.columns, *[F.col(f"_got_{n}").alias(n) for n in wanted])
    edge = {"backward": F.max, "forward": F.min}
    held = lambda c: F.when(F.col(f"_of_{c}").isNotNull(), F.struct(time, *of, F.col(f"_of_{c}").alias("v")))
    placed = lambda df: df.withColumn("_bucket", F.floor(F.col(time) / bucket))
    edges = placed(right).groupBy(*within).agg(*[edge[d](held(c)).getField("v").alias(f"_edge_{n}") for n, (c, d) in wanted.items()])
    asked = placed(left).select(*within).distinct().filter(F.col("_bucket").isNotNull()).withColumn("_asked", F.lit(True))
    along = Window.partitionBy(*keys).rangeBetween(Window.unboundedPreceding, -1)  # buckets before a bucket, by number
    buckets = {"backward": along.orderBy("_bucket"), "forward": along.orderBy(F.desc("_bucket"))}
    reach = asked.unionByName(edges, allowMissingColumns=True)
    reach = reach.select(*within, "_asked", *[F.last(f"_edge_{n}", ignorenulls=True).over(buckets[d]).alias(f"_far_{n}") for n, (_, d) in wanted.items()]).filter("_asked").drop("_asked")
    joined = found.join(reach, within, "left")
    number = [F.col("_bucket").alias(bucket_as)] if bucket_as else []
    return joined.select(*left.columns, *number, *[F.coalesce(f"_got_{n}", f"_far_{n}").alias(n) for n in wanted])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], *, direction: str = "backward", bucket: float | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before ``time`` (``forward``: the first at or after), and its time
    as ``matched_<time>``. See :func:`look_up` for ties, nulls and ``bucket``."""
    packed = right.select(*keys, time, F.struct(F.col(time).alias("at"), *values).alias("row"))
    found = look_up(left, packed, keys, time, {"_hit": ("row", direction)}, bucket=bucket)
    return found.select(*left.columns, F.col("_hit.at").alias(f"matched_{time}"), *[F.col(f"_hit.{v}").alias(v) for v in values])
