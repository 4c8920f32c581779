"""Mixing sources to target weights along a curriculum.

Targets: each source's share of the budget follows its weight, but stops at a multiple of its size; what is cut off is dealt
to the others by weight until no target is above its stop. Places: a source's documents stand in hash order, and their
running word counts are its cumulative demand. Each source has a weight schedule over the training time 0 to 1, a broken
line. Its integral says which part of the target is due by which time; inverted, it gives every document its time. Sorting
by time mixes the sources as scheduled.

Running sums never order a whole source in one task: documents fall into pieces by the first digits of the hash, pieces are
added up first, and only rows of one piece of one source are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Broken lines (time, weight), dealt to the sources like the weights: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))

Schedule = tuple[tuple[float, float], ...]


def word_count(text: str | Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _pieces(df: DataFrame, pieces: int | None) -> int:
    return pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, pieces: int) -> DataFrame:
    """docs with size, source, hash order and piece in columns that start with _mix_."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.col(text).cast("string"), F.lit(""))
    order = F.md5(key.cast("binary"))
    piece = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.lit(pieces) / F.lit(1 << 32)).cast("int")
    return docs.withColumns({"_mix_size": word_count(F.col(text).cast("string")), "_mix_source": F.col(source).cast("string"), "_mix_order": order}).withColumn("_mix_piece", piece)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, size) with one row a source to source, size, place, target.

    Sources stand by code point, null last, and take the weights in turn. The level, target per weight, rises until the
    set of sources at their stop stays the same; each step is one sum over the sources.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    rows = sizes.select("source", "size", place.alias("place"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    rows = scale.cut_lineage(rows.withColumn("stop", F.col("size") * F.lit(float(most))))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        at_stop = F.col("stop") <= F.lit(level) * F.col("weight")
        sums = rows.agg(F.sum(F.when(at_stop, F.col("stop")).otherwise(0.0)), F.sum(F.when(at_stop, 0).otherwise(F.col("weight"))), F.count_if(at_stop)).first()
        if sums[2] == full or not sums[1]:
            break
        full = sums[2]
        level = (budget * total - sums[0]) / sums[1]
    return rows.select("source", "size", "place", F.least("stop", F.lit(level) * F.col("weight")).alias("target"))


def plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET, most: float = MOST, pieces: int | None = None,
) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_place, _mix_target, _mix_first (words of its source before it), _mix_times.

    A document is taken in each round through its source in which its middle word lies before the target, so a source's
    taken words miss its target by half a document at most. Null and wordless texts have size 0 and are taken as their
    place says; a null source is a source of its own; rows without id are ordered by text; equal rows are taken each.
    """
    count = _pieces(docs, pieces)
    sized = _sized(docs, doc_id, text, source, count)
    sums = scale.cut_lineage(sized.groupBy("_mix_source", "_mix_piece").agg(F.sum("_mix_size").alias("words")))
    goal = targets(sums.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("words").alias("size")), weights, budget, most)
    before = F.sum("words").over(W.partitionBy("_mix_source").orderBy("_mix_piece")) - F.col("words")
    piece = sums.select(F.col("_mix_source").alias("_s"), F.col("_mix_piece").alias("_p"), before.alias("_before"))
    piece = piece.join(goal, F.col("_s").eqNullSafe(F.col("source"))).select("_s", "_p", "_before", F.col("size").alias("_mix_source_size"), F.col("place").alias("_mix_place"), F.col("target").alias("_mix_target"))
    piece = scale.cut_lineage(piece)
    # ties of the hash are the same id; their texts decide
    inside = W.partitionBy("_mix_source", "_mix_piece").orderBy("_mix_order", "_mix_size", "_mix_tie").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("_mix_tie", F.xxhash64(F.col(text).cast("string"))).withColumn("_mix_in", F.sum("_mix_size").over(inside) - F.col("_mix_size"))
    placed = placed.join(piece, F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.col("_mix_piece") == F.col("_p")))
    placed = placed.withColumn("_mix_first", F.col("_before") + F.col("_mix_in"))
    middle = F.col("_mix_first") + F.col("_mix_size") / 2
    # rounds r with middle + r * source size < target
    rounds = F.when(F.col("_mix_source_size") > 0, F.ceil((F.col("_mix_target") - middle) / F.col("_mix_source_size"))).otherwise(0)
    times = F.greatest(F.lit(0), F.least(F.lit(int(most)), rounds)).cast("int")
    return placed.withColumn("_mix_times", times).drop("_s", "_p", "_before", "_mix_in", "_mix_tie")


def due_time(part: Column, schedule: Schedule) -> Column:
    """The time by which this part (0 to 1) of the schedule's integral is reached."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole, done, out = sum(areas), 0.0, F.lit(schedule[-1][0])
    if whole <= 0 or any(w < 0 for _, w in schedule):
        raise ValueError("weights are not negative and not all zero")
    steps = []
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas):
        rest = part * whole - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            time = rest / w0 if w0 else F.lit(0.0)
        else:
            time = (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))) - w0) / slope
        done += area
        steps.append((done / whole, F.lit(t0) + F.least(F.greatest(time, F.lit(0.0)), F.lit(t1 - t0))))
    for end, time in reversed(steps):
        out = F.when(part < end, time).otherwise(out)
    return out


def mix(
    docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, shards: int | None = None, keep_position: bool = False,
    keep: tuple[str, ...] = (), **options,
) -> DataFrame:
    """The mix in training order: each document as often as it is taken, with the columns of docs (and _mix_position, and those of the plan in keep)."""
    count = _pieces(docs, shards)
    rows = plan(docs, **options).where("_mix_times > 0").withColumn("_mix_round", F.explode(F.sequence(F.lit(0), F.col("_mix_times") - 1)))
    part = (F.col("_mix_first") + F.col("_mix_round") * F.col("_mix_source_size")) / F.col("_mix_target")
    time = F.lit(0.0)
    for i, schedule in enumerate(schedules):
        time = F.when(F.col("_mix_place") % len(schedules) == i, due_time(part, schedule)).otherwise(time)
    rows = rows.withColumn("_mix_position", time)
    ordered = rows.repartitionByRange(count, "_mix_position", "_mix_order").sortWithinPartitions("_mix_position", "_mix_order")
    return ordered.select(*[F.col(c) for c in docs.columns], *(["_mix_position"] if keep_position else []), *keep)


def dealt(docs: DataFrame, text: str = "text", schedules: tuple[Schedule, ...] = SCHEDULES, **options) -> DataFrame:
    """The plan's rows with _mix_taken (words in the mix, counted there) and _mix_rank (ascending in the mix, null if not taken), in training order.

    The mix is sorted whole, texts included. Documents that it leaves out are joined back and come last. A document's place
    in its source leads to its copies; only documents without words share one.
    """
    slot = ("_mix_place", "_mix_first", "_mix_size")
    # the running number keeps Spark from dropping the sort below the sums
    mixed = mix(docs, schedules, keep=slot, text=text, **options).withColumn("_mix_rank", F.monotonically_increasing_id())
    copies = mixed.groupBy(*slot).agg(F.sum(word_count(F.col(text).cast("string"))).alias("_mix_taken"), F.min("_mix_rank").alias("_mix_rank"))
    found = plan(docs, text=text, **options).drop(text).join(copies, list(slot), "left")
    found = found.withColumn("_mix_taken", F.coalesce("_mix_taken", F.lit(0)))
    return found.orderBy(F.col("_mix_rank").asc_nulls_last(), "_mix_order")
