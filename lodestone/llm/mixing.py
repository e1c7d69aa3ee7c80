"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources, ordered by code point (null last), weigh 5, 2, 1 in turn and share 150 % of all
words; a target stops at twice its source's size and the excess is reshared by weight. That is a
water level over the sources: sorted by cap per weight, the first source whose cap reaches the level
left by those before it fixes the level for all.

Order: each source's documents stand in the order of a hash of their ids. A source is read as often as
its target asks, whole passes first, then the start of one more; the document at the end is cut. Running
sums over a source are taken in buckets of the hash: sums of buckets first, then within each bucket, so
that no source, however large, is summed in one task.

Curriculum: a source's weight changes over training along straight lines between knots. Its integral,
scaled to the target, is the source's cumulative demand; a copy of a document stands where the demand
meets the words before it. Documents are sorted by that position in ranges.

Cases: null and empty texts have size 0 and are taken 0 times; very long texts are counted whole and may be
cut; a source without words has target 0; a null source is a source; ties in the hash are ordered by id
and size, and copies at one position by a hash of their row, so reruns agree; rows that repeat are taken
one by one; columns named like the outputs are replaced, others are kept; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.store import join_small, lasting, passing, written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Knots (time, relative weight) of the schedules that the sources take in turn: falling, rising, level.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)
#: Documents of a bucket of the order, on average; with four digits of the hash there are 65,536 buckets of a source at most.
BUCKET_DOCS = 500
HEX = 1 << 32


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) with place (from 0) and target."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("place", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.get(F.array(*map(F.lit, map(float, weights))), F.col("place") % len(weights)))
    t = t.withColumn("cap", repeats * F.col("source_size").cast("double")).withColumn("reach", F.col("cap") / F.col("weight"))
    rising = everything.orderBy("reach", "place")
    t = t.withColumn("rise", F.row_number().over(rising))
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (share * F.sum("source_size").over(everything) - before) / onward)
    level = F.min(F.when(F.col("reach") >= F.col("level"), F.struct("rise", "level"))).over(everything)["level"]
    t = t.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf")))))
    return t.select("source", "source_size", "place", "target")


def segments(knots: tuple) -> list[tuple[float, float, float, float, float]]:
    """(share of demand before, time, length, weight at the start, slope) of each stretch of a schedule."""
    area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (a, u), (b, v) in zip(knots, knots[1:]):
        out.append((done, a, b - a, u / area, (v - u) / (b - a) / area))
        done += (b - a) * (u + v) / 2 / area
    return out


def time_of(share: Column, place: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source has been asked for a share of its target: the inverse of the integral."""
    found = None
    for k, knots in enumerate(schedules):
        here = None
        for done, at, length, start, slope in segments(knots):
            more = F.greatest(share - done, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(start * start) + 2 * slope * more, F.lit(0.0)))
            value = at + F.least(F.lit(length), 2 * more / F.greatest(start + root, F.lit(1e-12)))
            here = value if here is None else F.when(share >= done, value).otherwise(here)
        found = here if found is None else F.when(place % len(schedules) == k, here).otherwise(found)
    return F.when(share.isNotNull(), found)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep_text: bool = True, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, taken, and positions: the time of each copy that is taken.

    keep_text=False leaves the text out of every shuffle.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "positions")]
    rest = [c for c in names if keep_text or c != text]
    rows = docs.select(F.struct(*rest).alias("__row"), F.col(doc_id).alias("__id"), F.col(source).cast("string").alias("__source"), word_count(F.col(text)).alias("size"))
    rows = rows.withColumn("__key", F.coalesce(F.concat(F.lit("="), "__source"), F.lit(""))).withColumn("__order", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("__id").cast("string"), F.lit("")))))
    narrow = written(rows.select("__key", "__source", "size", "__order").groupBy("__key", F.substring("__order", 1, 4).alias("__slot")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("__source").alias("__source")), "slots")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    digits = 4
    while digits > 1 and 16 ** (digits - 1) * BUCKET_DOCS >= total:
        digits -= 1
    sizes = narrow.groupBy("__key").agg(F.first("__source").alias("source"), F.sum("size").alias("source_size"))
    goal = written(targets(sizes), "targets").withColumn("__key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    by_bucket = narrow.groupBy("__key", F.substring("__slot", 1, digits).alias("__bucket")).agg(F.sum("size").alias("__in"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("__key", "__bucket", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__start"))
    placed = join_small(starts, goal, ["__key"], "inner")
    within = Window.partitionBy("__key", "__bucket").orderBy("__order", "__id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.drop("__source").withColumn("__bucket", F.substring("__order", 1, digits)).withColumn("__upto", F.sum("size").over(within))
    out = run.join(placed, ["__key", "__bucket"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = out.withColumn("__passes", passes).withColumn("__first", F.col("__start") + F.col("__upto") - F.col("size"))
    left = F.round(F.col("target") - F.col("__passes") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("__first")))
    out = out.withColumn("__part", part).withColumn("taken", (F.col("__passes") * F.col("size") + F.col("__part")).cast("long"))
    copies = (F.col("__passes") + (F.col("__part") > 0).cast("long")).cast("int")
    at = lambda k: time_of((F.col("__first") + k * F.col("source_size")) / F.col("target"), F.col("place"))
    positions = F.when((F.col("taken") > 0) & (copies > 0), F.transform(F.sequence(F.lit(0), F.greatest(copies - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))
    return out.select("__row.*", "size", "source_size", "target", "taken", positions.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, range-sorted by its position; the columns of mix() other than positions are kept.

    Copies at one position (the first of each source, for one) stand in the order of a hash of their row, so
    reruns agree; rows that are equal in all columns can't be told apart.
    """
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions")
    tie = F.xxhash64(*(c for c in rows.columns if c != "position"))
    return range_sorted(rows.withColumn("__tie", tie), ["position", "__tie"]).drop("__tie")


def range_sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt out in ranges of the keys, each sorted."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mixing_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first position of every document, range-sorted by position, those that the mix doesn't take first."""
    with passing():
        out = mix(docs.select("doc_id", "source", "text"), keep_text=False)
        narrow = lasting(out.select("doc_id", "size", "source_size", F.col("target"), "taken", F.get("positions", F.lit(0)).alias("position")), "mixed")
    return range_sorted(narrow, ["position", "doc_id", "size"])


def mixing_sql() -> str:
    """The same for DuckDB."""

    def time_sql(k: int, knots: tuple) -> str:
        out = ""
        for done, at, length, start, slope in segments(knots):
            more = f"greatest(share - {done!r}, 0.0)"
            value = f"{at!r} + least({length!r}, 2 * {more} / greatest({start!r} + sqrt(greatest({start * start!r} + {2 * slope!r} * {more}, 0.0)), 1e-12))"
            out = value if not out else f"case when share >= {done!r} then {value} else {out} end"
        return f"when place % {len(SCHEDULES)} = {k} then {out}"

    times = " ".join(time_sql(k, x) for k, x in enumerate(SCHEDULES))
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5('mix' || coalesce(cast(doc_id as varchar), '')) as o from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as place from s),
w as (select *, ({list(map(float, WEIGHTS))}::double[])[place % {len(WEIGHTS)} + 1] as weight, {REPEATS} * source_size::double as cap from r),
x as (select *, cap / weight as reach, row_number() over (order by cap / weight, place) as rise from w),
l as (select *, ({SHARE}::double * sum(source_size) over () - coalesce(sum(cap) over (order by rise rows between unbounded preceding and 1 preceding), 0.0)) / sum(weight) over (order by rise rows between current row and unbounded following) as level from x),
t as (select source, source_size, place, least(cap, weight * (select arg_min(level, rise) from l where reach >= level)) as target from l),
c as (select d.doc_id, d.size, t.source_size, t.place, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as passes,
  sum(d.size) over (partition by d.source order by d.o, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as before
  from d join t on d.source is not distinct from t.source),
p as (select *, passes * size + greatest(0, least(size, round(target - passes * source_size)::bigint - before)) as taken, before / target as share from c)
select doc_id, size, source_size, target, taken::bigint as taken, case when taken > 0 then case {times} end end as position from p
"""
