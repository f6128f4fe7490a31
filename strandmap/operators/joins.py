"""Joins by order: as-of, nearest, interpolated, interval and proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import scratch


def _merged(left: DataFrame, right: DataFrame, on: str, by: list[str]) -> DataFrame:
    """Both sides in one table: a left row is a struct ``_l``, a right row a struct ``_r``."""
    lcols = [F.col(c) for c in left.columns]
    a = left.select(*by, F.col(on).alias("_at"), F.struct(*lcols).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(on).alias("_at"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    return a.union(b)


def _bracketed(left: DataFrame, right: DataFrame, on: str, by: list[str], span: Column | None, at_or_after: bool = False) -> DataFrame:
    """Left rows with the last right row at or before (``_b``) and the first after (``_a``; or at, if ``at_or_after``).

    One shuffle: the union of both sides is ordered forwards and backwards, with running frames, so the work is linear. Without a ``by`` key the work must be cut into spans of the
    order: each span also gets the last right row before it and the first after it, so no task sees the whole table.
    """
    both = _merged(left, right, on, by)
    keys = [F.col(k) for k in by]
    is_left = F.col("_l").isNotNull()
    backwards = (F.col("_at").desc(), is_left if at_or_after else is_left.desc())
    if span is not None:
        both = both.withColumn("_span", span)
        edges = both.filter(F.col("_r").isNotNull()).groupBy(*by, "_span").agg(F.max_by("_r", "_at").alias("last"), F.max("_at").alias("last_at"), F.min_by("_r", "_at").alias("first"), F.min("_at").alias("first_at"))
        spans = both.select(*by, "_span").distinct()
        w = Window.partitionBy(*keys)
        edges = spans.join(edges, [*by, "_span"], "left")
        has = F.col("last_at").isNotNull()
        edges = edges.withColumn("_prev", F.last(F.when(has, F.struct("last_at", "last")), True).over(w.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)))
        edges = edges.withColumn("_next", F.last(F.when(has, F.struct("first_at", "first")), True).over(w.orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)))
        ghosts = edges.select(*by, "_span", F.explode(F.array(F.struct(F.col("_prev.last_at").alias("_at"), F.col("_prev.last").alias("_r")), F.struct(F.col("_next.first_at").alias("_at"), F.col("_next.first").alias("_r")))).alias("g"))
        ghosts = ghosts.filter(F.col("g._r").isNotNull()).select(*by, "g._at", F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), "g._r", "_span")
        both = both.select(*by, "_at", "_l", "_r", "_span").union(ghosts)
        keys = [*keys, F.col("_span")]
    before = Window.partitionBy(*keys).orderBy("_at", is_left).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last("_r", ignorenulls=True).over(before)).withColumn("_a", F.last("_r", ignorenulls=True).over(after))
    return both.filter(F.col("_l").isNotNull())


def asof(left: DataFrame, right: DataFrame, on: str, take: list[str], by: list[str] | None = None, direction: str = "backward", span: Column | None = None) -> DataFrame:
    """Left rows with ``take`` of one right row: the last at or before (backward), the first at or after (forward), or the
    nearest (of equally near ones the later). Nulls where there is none. ``span`` is an expression over ``_at`` that
    grows with it and cuts the order into parts."""
    got = _bracketed(left, right, on, by or [], span, direction == "forward")
    lat = F.col(f"_l.{on}")
    if direction == "backward":
        pick = F.col("_b")
    elif direction == "forward":
        pick = F.col("_a")
    else:
        back, ahead = lat - F.col(f"_b.{on}"), F.col(f"_a.{on}") - lat
        pick = F.when(F.col("_a").isNull() | (back < ahead), F.col("_b")).otherwise(F.col("_a"))
        pick = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(pick)
    return got.withColumn("_p", pick).select("_l.*", *[F.col(f"_p.{c}").alias(c) for c in take])


def interpolated(left: DataFrame, right: DataFrame, on: str, value: str, by: list[str] | None = None, gap: float | None = None, outside: float | None = None, span: Column | None = None) -> DataFrame:
    """Left rows with ``value`` interpolated between the right rows around them.

    ``outside`` where there is none on one side, or where one is more than ``gap`` away.
    """
    got = _bracketed(left, right, on, by or [], span)
    x, x0, x1 = (F.col(f"{s}.{on}") for s in ("_l", "_b", "_a"))
    y0, y1 = F.col(f"_b.{value}"), F.col(f"_a.{value}")
    y = F.when(x == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    ok = x0.isNotNull() & (x1.isNotNull() | (x == x0))
    if gap is not None:
        ok = ok & (x - x0 <= gap) & (F.coalesce(x1 - x, F.lit(0.0)) <= gap)
    return got.select("_l.*", F.when(ok, y).otherwise(F.lit(outside)).alias(value))


def object_positions(times: DataFrame, ephemeris: DataFrame, on: str, lon: str, lat: str, gap: float, by: list[str] | None = None, span: Column | None = None) -> DataFrame:
    """Rows of ``times`` with an object's direction (lon, lat), from a table of its directions at some times.

    Between two entries, at most ``gap`` from the row on either side, the unit vector moves along its chord; null
    elsewhere. ``by`` names the object's column where there are several.
    """
    from ..functions.angles import lon_lat, unit_vector

    e = ephemeris.select(*(by or []), on, F.struct(*[c.alias(f"u{i}") for i, c in enumerate(unit_vector(F.col(lon), F.col(lat)))]).alias("_u"))
    got = _bracketed(times, e, on, by or [], span)
    x, x0, x1 = (F.col(f"{s}.{on}") for s in ("_l", "_b", "_a"))
    share = F.when(x == x0, 0.0).otherwise((x - x0) / (x1 - x0))
    near = (x - x0 <= gap) & ((x == x0) | (x1 - x <= gap))
    u = [F.when(x == x0, F.col(f"_b._u.u{i}")).otherwise(F.col(f"_b._u.u{i}") + (F.col(f"_a._u.u{i}") - F.col(f"_b._u.u{i}")) * share) for i in range(3)]
    size = F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    at = lon_lat([c / size for c in u])
    return got.select("_l.*", F.when(near, at[0]).alias(lon), F.when(near, at[1]).alias(lat))


def within(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float, closed: str = "left", by: list[str] | None = None) -> DataFrame:
    """Points joined with the ranges they lie in, as an equi-join on cells of ``width``.

    A range is listed under each cell it touches, so the cost follows the lengths of the ranges and not the product
    of both tables. closed: "left" for [start, end), "neither", or "both".
    """
    by = by or []
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    x, a, b = F.col(at), F.col(start), F.col(end)
    inside = {"left": (x >= a) & (x < b), "both": (x >= a) & (x <= b), "neither": (x > a) & (x < b)}[closed]
    return p.join(cells, [*by, "_cell"]).filter(inside).drop("_cell")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written out once, where it is read several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float, closed: str) -> tuple[DataFrame, DataFrame, int]:
    """Distinct points with their rank ``_i`` in order from 0, distinct ranges with the ranks [``_lo``, ``_hi``) of the
    points inside (where there are some), and the largest power of 2 that such a range holds.

    Points and ends of ranges are ordered together within cells of ``width``, and one window over the cells adds up
    their counts, so no task sees the whole order.
    """
    r = ranges.select(start, end).distinct()
    ends = r.select(F.explode(F.array(start, end)).alias("_at"), F.lit(0).alias("_k"))
    both = points.select(F.col(at).alias("_at"), F.lit(1).alias("_k")).union(ends).filter("_at IS NOT NULL").groupBy("_at").agg(F.max("_k").alias("_p"), F.min("_k").alias("_e"))
    both = both.withColumn("_cell", F.floor(F.col("_at") / width))
    order = Window.partitionBy("_cell").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    both = _kept(both.withColumn("_c", F.sum("_p").over(order)), "order")
    cells = both.groupBy("_cell").agg(F.sum("_p").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.join(cells.select("_cell", before.alias("_off")), "_cell").select("_at", "_p", "_e", (F.col("_off") + F.col("_c")).alias("_upto"))
    below, upto = F.col("_upto") - F.col("_p"), F.col("_upto")
    lo, hi = {"left": (below, below), "both": (below, upto), "neither": (upto, below), "right": (upto, upto)}[closed]
    marks = both.filter("_e = 0")
    inside = r.join(marks.select(F.col("_at").alias(start), lo.alias("_lo")), start).join(marks.select(F.col("_at").alias(end), hi.alias("_hi")), end).filter("_lo < _hi")
    inside = _kept(inside, "ranks")
    most = inside.agg(F.max(F.col("_hi") - F.col("_lo"))).head()[0]
    return both.filter("_p = 1").select(F.col("_at").alias(at), below.alias("_i")), inside, (most or 1).bit_length() - 1


def _blocks() -> Column:
    """The least blocks of 2 ** level ranks that make up [_lo, _hi): two a level at most, as an array of (level, number)."""

    def of(level: Column) -> Column:
        a, b = -F.call_function("shiftright", -F.col("_lo"), level), F.call_function("shiftright", F.col("_hi"), level)
        left, right = F.struct(level.alias("level"), a.alias("block")), F.struct(level.alias("level"), (b - 1).alias("block"))
        return F.array(F.when((a < b) & (a % 2 == 1), left), F.when((a < b) & (b % 2 == 1), right))

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("_hi") - F.col("_lo"))).cast("int"))
    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def _above(levels: int) -> Column:
    """The blocks up to a level that hold a rank ``_i``, as an array of (level, number)."""
    return F.array(*[F.struct(F.lit(v).alias("level"), F.call_function("shiftright", F.col("_i"), F.lit(v)).alias("block")) for v in range(levels + 1)])


#: How parts of a summary are put together: sums of counts and sums, least and greatest of bounds.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _summary(df: DataFrame, keys: list[str], parts: dict[str, tuple[str, str | None]]) -> DataFrame:
    first = {"count": lambda c: F.count("*"), "sum": F.sum, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[first[how](c).alias(n) for n, (how, c) in parts.items()])


def _merged_parts(df: DataFrame, keys: list[str], parts: dict[str, tuple[str, str | None]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[_MERGE[how](n).alias(n) for n, (how, _) in parts.items()])


def summed_within(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float, parts: dict[str, tuple[str, str | None]], closed: str = "left") -> DataFrame:
    """Distinct ranges (start, end) that hold points, with a summary of them: name -> ("count", None), ("sum", column), ("min", column) or ("max", column).

    No pair of a point and a range is built: equal times are summed up first, then blocks of 1, 2, 4, ... times in
    order, and a range meets the blocks that it is made of, at most two of each size. Work grows as n log n, however
    many points a range holds. closed: "left", "right", "both" or "neither".
    """
    at_once = _summary(points.filter(F.col(at).isNotNull()), [at], parts)
    at_once = _kept(at_once, "times")
    rank, inside, levels = _ranked(at_once, ranges, at, start, end, width, closed)
    blocks = _merged_parts(at_once.join(rank, at).withColumn("_b", F.explode(_above(levels))), ["_b"], parts)
    return _merged_parts(inside.withColumn("_b", F.explode(_blocks())).join(blocks, "_b"), [start, end], parts)


def summed_around(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float, parts: dict[str, tuple[str, str | None]], closed: str = "left") -> DataFrame:
    """Distinct points that lie in ranges, with a summary of these; as summed_within() the other way round."""
    at_once = _kept(_summary(ranges, [start, end], parts), "ranges")
    rank, inside, levels = _ranked(points, at_once, at, start, end, width, closed)
    blocks = _merged_parts(at_once.join(inside, [start, end]).withColumn("_b", F.explode(_blocks())), ["_b"], parts)
    around = rank.withColumn("_b", F.explode(_above(levels)))
    return _merged_parts(around.join(blocks, "_b"), [at], parts)


def overlapping(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Pairs of ranges (a_start, a_end), (b_start, b_end) with b_end > a_start and b_start <= a_end, found by shared cells."""
    cell = lambda d, s, e: d.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    first = F.col("_cell") == F.floor(F.greatest("a_start", "b_start") / width)  # a pair counts in one cell only
    return cell(a, "a_start", "a_end").join(cell(b, "b_start", "b_end"), "_cell").filter((F.col("b_end") > F.col("a_start")) & (F.col("b_start") <= F.col("a_end")) & first).drop("_cell")


def overlap_summary(rows: DataFrame, key: str, start: str, end: str, width: float) -> DataFrame:
    """For each key the number, least and greatest key of the ranges of other keys that its ranges overlap (as in overlapping()).

    Ranges that start within (start, end] and those around the start are summed up by blocks, own ones included. Rows
    of the same key are then taken off the count. Where the least (or greatest) key is its own, the next is sought among
    pairs: such ranges of different keys don't overlap each other, so there are few pairs to a row. Ranges whose end is
    before their start are paired by cells.
    """
    k, a, b = F.col(key), F.col(start), F.col(end)
    q = _kept(rows.filter(k.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(key, start, end).agg(F.count("*").alias("_w")), "overlaps")
    parts = {"_n": ("sum", "_w"), "_first": ("min", key), "_last": ("max", key)}
    good, back = q.filter(b >= a), q.filter(b < a)
    within_ = summed_within(good, good, start, start, end, width, parts, "right")
    around = summed_around(good, good, start, start, end, width, parts)
    sums = within_.unionByName(good.select(start, end).distinct().join(around, start).select(*within_.columns))
    each = lambda d, s: d.select(a.alias(f"{s}_start"), b.alias(f"{s}_end"), *[F.col(c).alias(f"{s}{c}") for c in parts])
    groups = [_summary(d, [start, end], parts) for d in (q, good, back)]
    for left, right in ((groups[2], groups[0]), (groups[1], groups[2])):
        pairs = overlapping(each(left, "a"), each(right, "b"), width)
        sums = sums.unionByName(pairs.select(F.col("a_start").alias(start), F.col("a_end").alias(end), *[F.col(f"b{c}").alias(c) for c in parts]))
    found = q.join(_merged_parts(sums, [start, end], parts), [start, end])
    found = _kept(found.groupBy(key).agg(F.sum(F.col("_w") * F.col("_n")).alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last")), "found")

    mine = q.select(k, a.alias("a_start"), b.alias("a_end"), F.col("_w").alias("_v")).join(q, key).filter((b > F.col("a_start")) & (a <= F.col("a_end")))
    found = found.join(mine.groupBy(key).agg(F.sum(F.col("_v") * F.col("_w")).alias("_own")), key, "left").withColumn("_n", F.col("_n") - F.coalesce("_own", F.lit(0))).filter("_n > 0")

    other = q.select(k.alias("_r"), a.alias("b_start"), b.alias("b_end"))

    def beyond(mark: str, best) -> DataFrame:
        ends = q.join(found.filter(F.col(mark) == k).select(key), key).select(k, a.alias("a_start"), b.alias("a_end"))
        return overlapping(ends, other, width).filter(k != F.col("_r")).groupBy(key).agg(best("_r").alias(f"_next{mark}"))

    found = found.join(beyond("_first", F.min), key, "left").join(beyond("_last", F.max), key, "left")
    return found.select(key, F.col("_n").alias("n"), F.coalesce("_next_first", "_first").alias("first"), F.coalesce("_next_last", "_last").alias("last"))


def lookup_last(left: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows with the row of ``table`` whose key matches; of several the last by ``order``."""
    names = [c for c in table.columns if c != key]
    last = table.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_v"))
    return left.join(last, key, "left").select(*left.columns, *[F.col(f"_v.{c}") for c in names])


def wildcard_masked(channels: DataFrame, rules: DataFrame, cols: list[str]) -> DataFrame:
    """Channels that some rule matches; 0 in a rule stands for every value, but a rule of zeros alone for none.

    Each kind of rule (which columns are 0) is one equi-join, so no rule is held against every channel.
    """
    rules = rules.filter(" OR ".join(f"{c} <> 0" for c in cols))
    out = None
    for kind in range(1, 2 ** len(cols)):
        named = [c for i, c in enumerate(cols) if kind >> i & 1]
        of = rules.filter(" AND ".join(f"{c} {'<>' if c in named else '='} 0" for c in cols)).select(*named).distinct()
        hit = channels.join(of, named, "left_semi").select(*channels.columns)
        out = hit if out is None else out.union(hit)
    return out.distinct()


def best_patch(samples: DataFrame, patches: DataFrame, lon: str, lat: str, plon: str, plat: str, radius: str, priority: str, name: str, cell: float) -> DataFrame:
    """The patch each sample lies in: distance below the patch's radius, highest priority, then nearest.

    Samples meet only patches of their own cell of latitude; a patch is listed under all cells its radius reaches.
    """
    from ..functions.angles import distance

    p = patches.select(F.col(plon).alias("_plon"), F.col(plat).alias("_plat"), F.col(radius).alias("_rad"), F.col(priority).alias("_prio"), F.col(name).alias(name))
    p = p.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_plat") - F.col("_rad")) / cell), F.floor((F.col("_plat") + F.col("_rad")) / cell))))
    hit = samples.withColumn("_cell", F.floor(F.col(lat) / cell)).join(p, "_cell")
    hit = hit.withColumn("dist", distance(F.col(lon), F.col(lat), F.col("_plon"), F.col("_plat"))).filter(F.col("dist") < F.col("_rad"))
    best = F.min_by(F.struct(name, "dist"), F.struct(-F.col("_prio"), F.col("dist"), F.col(name)))
    return hit.groupBy(*samples.columns).agg(best.alias("_h")).select(*samples.columns, "_h.*")
