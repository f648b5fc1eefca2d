"""Exact order statistics over ranges of a second number, without pairing requests with the rows that they range over.

Values are numbered within their key by size. Read as a number in base ``FAN``, a value's rank is a path from its key to it. At each
node on the way, counts by digit and ``x``, summed along ``x``, tell for every range how many of its values lie below each digit; so all
requests that share a range descend by one lookup a digit, and what a request leaves out is subtracted from its counts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Children of a node. Three levels hold two million values a key, five 34 thousand million.
FAN = 128
#: Rows of a key that are compared with each other, all at once, instead of by rank.
FEW = 512
#: Ranges of a node that one task looks up.
CHUNK = 50_000


def _folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session on one machine that names none gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint: computed once, and read again if an executor is lost."""
    _folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the folder of checkpoints: computed once, and each reader takes only the columns that it
    needs. Spark knows the table's size, so that a small one is broadcast without dealing out what it is joined with."""
    path = f"{_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """``rows`` with their place in ``order`` within ``keys``, from 0, as ``name``; equal rows in any order.

    Rows are sorted over all partitions and numbered in each; then places are shifted by what earlier partitions hold of the key.
    So a key, or a table without keys, doesn't meet in one task.
    """
    part, row, start, before, n = (free(rows, x) for x in ("_part", "_row", "_start", "_before", "_n"))
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    marked = kept(ranged.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    runs = marked.groupBy(*keys, part).agg(F.count("*").alias(n), F.min(row).alias(start))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    to = {k: free(rows, f"_of_{k}") for k in [*keys, part]}
    runs = kept(runs.select(*(F.col(k).alias(v) for k, v in to.items()), start, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before)))
    same = F.lit(True)
    for k, v in to.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    return marked.join(runs, same).select(*rows.columns, (F.col(row) - F.col(start) + F.col(before)).alias(name))


def beside(points: DataFrame, cells: DataFrame, keys: Sequence[str], at: str, by: str, each: int) -> DataFrame:
    """``points`` with the columns of the ``each`` cells next below or at them, and next above them, by ``by`` within ``keys``.

    ``points`` are distinct in ``keys`` and ``at``, ``cells`` in ``keys`` and ``by``; they share no other name. Points and cells are put
    in one order, so a point meets twice ``each`` cells at most, however many its key has.
    """
    pos, x, ask = "_pos", "_x", "_ask"
    places = cells.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    marks = points.select(*keys, F.col(at).alias(x), F.lit(1).alias(ask)).unionByName(cells.select(*keys, F.col(by).alias(x), F.lit(0).alias(ask)))
    below = F.sum(1 - F.col(ask)).over(Window.partitionBy(*keys).orderBy(x, ask).rowsBetween(Window.unboundedPreceding, 0))
    found = marks.withColumn(pos, below).where(F.col(ask) == 1).select(*keys, F.col(x).alias(at), F.explode(F.sequence(F.col(pos) - each + 1, F.col(pos) + each)).alias(pos))
    found = found.join(places.hint("merge"), [*keys, pos]).drop(pos)  # sizes are told before the explosion: never broadcast it
    rest = [c for c in points.columns if c not in (*keys, at)]
    return found.join(points, [*keys, at]) if rest else found


def _edges(xs: np.ndarray, a: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of sorted ``xs``, and the first after them, with |x - a| / a <= tol, as the division rounds; below 0, ``tol`` stands for
    |x - a| <= a * -tol, as the product rounds."""
    share = np.abs(tol)
    low = np.searchsorted(xs, a * (1 - share) - 1e-9 * a, "left")
    high = np.searchsorted(xs, a * (1 + share) + 1e-9 * a, "right")
    padded = np.append(xs, np.inf)
    far = lambda gap: np.where(tol < 0, gap > a * share, gap / a > share)
    while (over := (padded[low] < a) & far(a - padded[low])).any():
        low += over
    while (over := (high > low) & (padded[high - 1] > a) & far(padded[high - 1] - a)).any():
        high -= over
    return low, np.maximum(low, high)


def _in_ranges(cells: pa.Table, asked: pa.Table, fan: int) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
    """Of each distinct range: its digits and how many values they have in it, zeros left out; and which range each row of ``asked`` has.

    ``cells`` has place, digit, x, n, ``asked`` place, lo, hi; a place is what both sides have in common, and a range lies in one.
    """
    places = pa.chunked_array([*cells["place"].chunks, *asked["place"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    place, wanted = places[: cells.num_rows].astype(np.int64), places[cells.num_rows :].astype(np.int64)
    xs, x = np.unique(cells["x"].to_numpy(), return_inverse=True)
    children = place * fan + cells["digit"].to_numpy()
    at = children * (len(xs) + 1) + x
    by = np.argsort(at, kind="stable")
    at, sums = at[by], np.concatenate([[0], np.cumsum(cells["n"].to_numpy()[by])])
    children = np.unique(children)
    low = np.searchsorted(xs, asked["lo"].to_numpy(), "left")
    high = np.maximum(low, np.searchsorted(xs, asked["hi"].to_numpy(), "right"))
    m = len(xs) + 1
    if (int(wanted.max(initial=0)) + 1) * m * m < 1 << 62:  # one number tells ranges apart
        codes, which = np.unique((wanted * m + low) * m + high, return_inverse=True)
        ranges = np.stack([codes // (m * m), codes // m % m, codes % m])
    else:
        ranges, which = np.unique(np.stack([wanted, low, high]), axis=1, return_inverse=True)
    start, end = np.searchsorted(children, ranges[0] * fan), np.searchsorted(children, (ranges[0] + 1) * fan)
    sizes, digits, counted = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, ranges.shape[1], 1 << 14):
        piece = slice(i, i + (1 << 14))
        n = end[piece] - start[piece]
        of = np.repeat(np.arange(len(n)), n)
        child = children[start[piece][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
        edge = lambda side: sums[np.searchsorted(at, child * (len(xs) + 1) + side[piece][of])]  # noqa: B023, E731
        found = edge(ranges[2]) - edge(ranges[1])
        some = found > 0
        sizes.append(np.bincount(of[some], minlength=len(n)))
        digits.append(child[some] % fan)
        counted.append(found[some])
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(digits))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counted))), which.ravel()


def _nearest(cells: pa.Table, asked: pa.Table, tols: Sequence[str]) -> dict[str, pa.Array]:
    """lo, hi and n for each of ``tols``: the least and the largest x of the place within it of ``a``, and how many values lie there."""
    places = pa.chunked_array([*cells["place"].chunks, *asked["place"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    place, wanted = places[: cells.num_rows].astype(np.int64), places[cells.num_rows :].astype(np.int64)
    xs, x = np.unique(cells["x"].to_numpy(), return_inverse=True)
    m = len(xs) + 1
    at = place * m + x
    by = np.argsort(at, kind="stable")
    at, sums, there = at[by], np.concatenate([[0], np.cumsum(cells["n"].to_numpy()[by])]), np.append(xs[x[by]], np.inf)
    found = {}
    for tol in tols:
        low, high = _edges(xs, asked["a"].to_numpy(), asked[tol].to_numpy())
        first, end = np.searchsorted(at, wanted * m + low), np.searchsorted(at, wanted * m + high)
        some = end > first
        found |= {f"lo_{tol}": pa.array(np.where(some, there[first], np.inf)), f"hi_{tol}": pa.array(np.where(some, there[end - 1], -np.inf)), f"n_{tol}": pa.array(sums[end] - sums[first])}
    return found


def _looked_up(cells: DataFrame, asked: DataFrame, keys: list[str], schema: str, then: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``then`` over cells and rows of ``asked`` that share some of the places that ``keys`` name.

    ``cells`` has keys, digit, x, n. Places are dealt over tasks together. A place has as many cells at most as digits times distinct ``x``;
    one that many rows ask for gets its cells copied for every ``CHUNK`` of them.
    """
    place = F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)).alias("place")
    cells, asked = cells.select(place, "digit", "x", "n"), asked.select("*", place)
    # a row for each CHUNK rows of asked at most
    busy = F.broadcast(asked.groupBy("place").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1"))
    buckets = 2 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.coalesce("chunks", F.lit(1))
    bucket = F.pmod(F.xxhash64("place", "chunk"), F.lit(buckets)).cast("int").alias("bucket")
    left = cells.join(busy, "place", "left").select("place", "digit", "x", "n", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")).select(F.concat_ws("\x1f", "place", "chunk").alias("place"), "digit", "x", "n", bucket)
    right = asked.join(busy, "place", "left").withColumn("chunk", F.pmod(F.monotonically_increasing_id(), chunks).cast("int")).select(*(c for c in asked.columns if c != "place"), F.concat_ws("\x1f", "place", "chunk").alias("place"), bucket)
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(then, schema)


def _near(x: str) -> Column:
    gap = F.abs(F.col(x) - F.col("a"))
    return F.when(F.col("tol") < 0, gap <= F.col("a") * -F.col("tol")).otherwise(gap / F.col("a") <= F.col("tol"))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes), *more])


def _table(asked: pa.Table, columns: list[str], more: dict[str, pa.Array]) -> pa.Table:
    return pa.table([*(more[c] if c in more else asked[c] for c in columns), *(v for c, v in more.items() if c not in columns)], names=[*columns, *(c for c in more if c not in columns)])


#: A range is told by the first and the last ``x`` of its key in it (``snapped``), so that all that hold the same values are one.
RANGE = ["key", "grp", "lo", "hi"]


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join by keys of which nulls are equal too; the keys once."""
    to = {k: free(left, f"_of_{k}") for k in keys}
    same = F.lit(True)
    for k, v in to.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    return left.join(right.withColumnsRenamed(to), same).drop(*to.values())


def cells(values: DataFrame) -> DataFrame:
    """key, grp, x, n: how often the values have each x. Stands for them where only ranges and counts are asked."""
    return kept(values.groupBy("key", "grp", "x").agg(F.count("*").alias("n")))


def _by_x(values: DataFrame, keys: list[str]) -> DataFrame:
    n = F.sum("n") if "n" in values.columns else F.count("*")
    return values.groupBy(*keys, "x").agg(n.alias("n")).withColumn("digit", F.lit(0))


def snapped(values: DataFrame, points: DataFrame, tols: Sequence[str]) -> DataFrame:
    """``points`` (key, a, and each of ``tols``) with lo_, hi_ and n_ of each of ``tols``: the least and the largest x of the key that lie
    within it of ``a``, and how many values do; lo is over hi where none does. ``values`` are those of ``counts``, or their ``cells``."""
    columns = points.columns
    more = [f"`{name}_{tol}` {kind}" for tol in tols for name, kind in (("lo", "double"), ("hi", "double"), ("n", "long"))]
    return kept(_looked_up(_by_x(values, ["key"]), points, ["key"], _schema(points, *more), lambda cells, asked: _table(asked, columns, _nearest(cells, asked, tols))))


def counted(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (distinct key, grp, lo, hi) with ``n``: how many values of the key, but for those of grp, lie from lo to hi."""

    def summed(columns: list[str], name: str):
        def then(cells: pa.Table, asked: pa.Table) -> pa.Table:
            _, counted, which = _in_ranges(cells, asked, 1)
            one = np.zeros(len(counted), dtype=np.int64)
            one[counted.value_lengths().to_numpy() > 0] = counted.flatten().to_numpy()
            return _table(asked, columns, {name: pa.array(one[which])})

        return then

    every = kept(_looked_up(_by_x(values, ["key"]), ranges.select(*RANGE), ["key"], _schema(ranges.select(*RANGE), "n_all long"), summed(RANGE, "n_all")))
    with_group, alone = every.where("grp is not null"), every.where("grp is null").withColumn("n_out", F.lit(0).cast("long"))
    both = alone.unionByName(_looked_up(_by_x(values, ["key", "grp"]), with_group, ["key", "grp"], _schema(every, "n_out long"), summed([*RANGE, "n_all"], "n_out")))
    return kept(both.select(*RANGE, (F.col("n_all") - F.col("n_out")).alias("n")))


def _inside() -> Column:
    return F.coalesce(F.col("own").isNotNull() & _near("own_x"), F.lit(False))


def counts(values: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` with ``lo``, ``hi`` (of ``snapped``) and ``n``: how many values of the key lie within ``tol``, as a share of ``a``, of ``a``,
    without those left out.

    ``values`` has id, key, grp, x, y, none null but perhaps grp; ``asks`` has ask (distinct), key, a (over 0), tol, grp (a group that
    is left out, or null), own (the id of one value of the key that is left out, or null; not one of grp) and own_x, that value's ``x``.
    Asks of one range are looked up once. A ``tol`` below 0 is compared with -tol times ``a``, without division (see ``_edges``).
    """
    values = cells(values)
    points = snapped(values, kept(asks.select("key", "a", "tol").distinct()), ["tol"]).select("key", "a", "tol", F.col("lo_tol").alias("lo"), F.col("hi_tol").alias("hi"))
    asked = kept(matched(asks, points, ["key", "a", "tol"]))
    found = counted(values, kept(asked.select(*RANGE).distinct())).withColumnRenamed("n", "_all")
    return matched(asked, found, RANGE).select(*asks.columns, "lo", "hi", (F.col("_all") - _inside().cast("int")).alias("n"))


def quantiles(values: DataFrame, asks: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``asks`` with ``q``: the exact quantiles of ``y`` in each range, between two values linear, as an array in the order of ``shares``.

    ``values`` and ``asks`` are those of ``counts``, whose ``n`` the asks have; without any value in range there is no row. Equal values
    and repeated rows count each. ``own_y``, the ``y`` of own, may be told, else it is looked up (the least of rows that repeat an id).
    """
    asked = asks.where("n > 0").withColumn("inside", _inside())
    if "own_y" not in asks.columns:
        own = values.groupBy("key", F.col("id").alias("own")).agg(F.min("y").alias("own_y"))
        asked = asked.where("inside").join(own, ["key", "own"]).unionByName(asked.where("not inside").withColumn("own_y", F.lit(None).cast("double")))
    asked = kept(asked)
    found = elements(values, asked.select(*RANGE, "n", "inside"), shares)
    same = [*RANGE, "n", "inside"]
    answered = matched(asked.select(*same).distinct(), found, RANGE).select(*same, spots(shares).alias("spots"))
    return matched(asked, kept(answered), same).select(*asks.columns, F.array(*(between(F.col("spots")[i], F.col("inside")) for i in range(len(shares)))).alias("q"))


def _of_the_others(x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tol: float, shares: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many others of its group lie within ``tol`` of its ``x``, and the quantiles of their ``y``. Rows are in the order of ``y``, unknown
    ones (NaN) last; a group is ``sizes`` rows from ``starts``. Groups of about one size are compared together, some millions of pairs at a time."""
    n, q = np.zeros(len(x), np.int64), np.full((len(shares), len(x)), np.nan)
    wide = -(-sizes // 8) * 8
    for width in np.unique(wide):
        groups, step = np.flatnonzero(wide == width), max(1, (1 << 21) // int(width) ** 2)
        for i in range(0, len(groups), step):
            some = groups[i : i + step]
            there = np.arange(width) < sizes[some][:, None]
            at = np.where(there, starts[some][:, None] + np.arange(width), starts[some][:, None])
            xs, ys = x[at], y[at]
            near = np.abs(xs[:, None, :] - xs[:, :, None]) / xs[:, :, None] <= tol
            near &= (there & ~np.isnan(ys))[:, None, :]
            near[:, np.arange(width), np.arange(width)] = False
            upto = near.cumsum(axis=2, dtype=np.int16)
            count = upto[:, :, -1].astype(np.int64)
            n[at[there]] = count[there]
            value = lambda k: np.take_along_axis(ys, (upto > k[:, :, None].astype(np.int16)).argmax(axis=2), axis=1)  # noqa: B023, E731
            for out, share in zip(q, shares):
                place = share * (count - 1)
                low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
                a, b = value(low), value(high)
                found = np.where(low == high, a, (high - place) * a + (place - low) * b)
                out[at[there]] = np.where(count > 0, found, np.nan)[there]
    return n, q


def of_the_others(rows: DataFrame, tol: float, shares: Sequence[float]) -> DataFrame:
    """``rows`` (key, x, y, ..) with ``n`` and ``q``: how many other rows of the key, whose y is known, lie within ``tol`` of x as a share of x, and the
    exact quantiles of their y (null if there are none). For keys of ``FEW`` rows at most; rows of larger ones are left out.

    A key's rows lie next to each other in a sorted partition, so batches hold whole keys, and many small ones are settled together.
    """
    few = FEW

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(np.append(starts, table.num_rows))
            if (sizes > few).any():
                table, sizes = table.filter(pa.array(np.repeat(sizes <= few, sizes))), sizes[sizes <= few]
                starts = np.cumsum(sizes) - sizes
            number = lambda name: table[name].to_numpy().astype(np.float64)
            n, q = _of_the_others(number("x"), number("y"), starts, sizes, tol, shares)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(q.T.ravel(), from_pandas=True), len(shares)).cast(pa.list_(pa.float64()))
            yield from table.append_column("n", pa.array(n)).append_column("q", lists).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []  # of one key, the last met
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.chunked_array([*(b["key"].slice(b.num_rows - 1) for b in held[-1:]), batch["key"]]).combine_chunks()
            begins = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + (0 if held else 1)
            if len(begins):
                last = int(begins[-1])
                if size > few:  # its rows weren't held
                    held, batch, begins, last = [], batch.slice(int(begins[0])), begins - begins[0], last - int(begins[0])
                    starts = begins[:-1]
                else:
                    starts = np.append(0, begins[:-1] + size) if held or begins[0] else begins[:-1] + size
                if last + sum(b.num_rows for b in held):
                    yield from finished(pa.Table.from_batches([*held, batch.slice(0, last)]), starts)
                held, batch, size = [], batch.slice(last), 0
            held, size = [*held, batch], size + batch.num_rows
            if size > few:
                held = [batch.slice(batch.num_rows - 1)]
        if held and size <= few:
            yield from finished(pa.Table.from_batches(held), np.zeros(1, dtype=np.int64))

    ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("y"))
    return ordered.mapInArrow(settle, _schema(rows, "n long", "q array<double>"))


def spots(shares: Sequence[float]) -> Column:
    """What ``between`` needs for each share, from ``n`` and the elements ``ys`` of a range: a row for each range makes them, not one for
    each that asks for it."""

    def spot(s: float) -> Column:
        at = F.lit(s) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        y = lambda k: F.try_element_at("ys", k)
        return F.struct(y(low).alias("a"), y(low + 1).alias("a_next"), y(high).alias("b"), y(high + 1).alias("b_next"), (high - at).alias("of_a"), (at - low).alias("of_b"), (low == high).alias("one"))

    return F.array(*map(spot, shares))


def between(spot: Column, inside: Column) -> Column:
    """A quantile from one of ``spots``; where one value of the range, ``own_y``, is left out, what lies at or after it moves up a place."""

    def place(y: str) -> Column:
        return F.when(inside & (spot[y] >= F.col("own_y")), spot[f"{y}_next"]).otherwise(spot[y])

    return F.when(spot["one"], place("a")).otherwise(spot["of_a"] * place("a") + spot["of_b"] * place("b"))


def elements(values: DataFrame, ranges: DataFrame, shares: Sequence[float]) -> DataFrame:
    """key, grp, lo, hi, ys: the values of each range, from the least, at the places from 0 that ``spots`` needs, as a map by place.

    ``ranges`` has key, grp, lo, hi, n (over 0, without the value that is left out) and inside (whether one is left out), rows repeated or not.
    Cost: a few shuffles for each digit of the largest key's size; distinct ranges times places go down one lookup at a time, and ranges
    never meet the rows in them.
    """
    ranked = kept(numbered(values.select("key", "grp", "x", "y"), ["key"], ["y"], "at"))
    largest = ranked.agg(F.max("at")).first()[0]
    levels = 1
    while largest is not None and FAN**levels <= largest:
        levels += 1
    sizes = kept(ranked.groupBy("key").agg(F.count("*").alias("size")))
    needed = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(s) * (F.col("n") - 1)), F.ceil(F.lit(s) * (F.col("n") - 1))) for s in shares))))
    needed = F.when(F.col("inside"), F.array_union(needed, F.transform(needed, lambda k: k + 1))).otherwise(needed)
    asked = ranges.distinct().select(*RANGE, F.explode(needed).alias("k")).groupBy(*RANGE).agg(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.nullif(k, F.lit(-1))).alias("positions"))  # as Arrow gives it back: nullable
    asked = kept(asked.withColumn("ask", F.monotonically_increasing_id()))
    active = asked.join(sizes, "key").select("ask", *RANGE, "size", F.lit(0).cast("long").alias("node"), "positions").withColumn("ks", F.col("positions"))
    columns = active.columns
    fan = FAN

    def left_out(cells: pa.Table, asked: pa.Table) -> pa.Table:
        digits, counted, which = _in_ranges(cells, asked, fan)
        return _table(asked, columns, {"out_digits": digits.take(pa.array(which)), "out_counts": counted.take(pa.array(which))})

    def descend(width: int):
        def then(cells: pa.Table, asked: pa.Table) -> pa.Table:
            """A row for each child that some positions of a row go to, with these positions and their places in the child."""
            digits, counted, which = _in_ranges(cells, asked, fan)
            parts = []
            for i in range(0, asked.num_rows, 1 << 13):
                piece, rows = asked.slice(i, 1 << 13).combine_chunks(), pa.array(which[i : i + (1 << 13)])
                n = piece.num_rows
                below = np.zeros((n, fan), dtype=np.int64)
                for lists, numbers, sign in ((digits.take(rows), counted.take(rows), 1), (piece["out_digits"].combine_chunks(), piece["out_counts"].combine_chunks(), -1)):
                    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    np.add.at(below, (np.repeat(np.arange(n), sizes), lists.flatten().to_numpy()), sign * numbers.flatten().to_numpy())
                node = piece["node"].to_numpy()
                below = below.cumsum(axis=1)
                positions, ks = piece["positions"].combine_chunks(), piece["ks"].combine_chunks()
                of = np.repeat(np.arange(n), positions.value_lengths().to_numpy())
                k = ks.flatten().to_numpy()
                digit = (below[of] > k[:, None]).argmax(axis=1)
                k = k - np.where(digit > 0, below[of, digit - 1], 0)
                # positions ascend within a row, and so do their digits
                first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (digit[1:] != digit[:-1])]))
                edges = pa.array(np.concatenate([first, [len(of)]]), pa.int32())
                lists = {"positions": pa.ListArray.from_arrays(edges, positions.flatten()), "ks": pa.ListArray.from_arrays(edges, pa.array(k))}
                made = piece.take(pa.array(of[first]))
                parts.append(_table(made, columns, {"node": pa.array(node[of[first]] * fan + digit[first])} | lists))
            return pa.concat_tables(parts) if parts else _table(asked, columns, {})

        return then

    for level in range(levels):
        width = fan ** (levels - 1 - level)
        placed = ranked.withColumns({"node": F.floor(F.col("at") / F.lit(width * fan)), "digit": (F.floor(F.col("at") / F.lit(width)) % fan).cast("int")})
        # all values of a smaller key have the digit 0 here
        small, large = (active.where(F.col("size") <= width), active.where(F.col("size") > width)) if level < levels - 1 else (None, active)
        placed = placed.join(kept(large.select("key", "node").distinct()), ["key", "node"], "left_semi")
        cells = lambda keys: placed.groupBy(*keys, "digit", "x").agg(F.count("*").alias("n"))  # noqa: B023, E731
        nothing = {"out_digits": F.lit(None).cast("array<long>"), "out_counts": F.lit(None).cast("array<long>")}
        kind = _schema(active, "out_digits array<long>", "out_counts array<long>")
        grouped = _looked_up(cells(["key", "grp", "node"]), large.where("grp is not null"), ["key", "grp", "node"], kind, left_out)
        both = large.where("grp is null").withColumns(nothing).unionByName(grouped)
        found = _looked_up(cells(["key", "node"]), kept(both), ["key", "node"], _schema(active), descend(width))
        active = kept(found if small is None else found.unionByName(small))
    active = active.select("ask", "key", "node", F.explode("positions").alias("position"))
    found = active.join(ranked.select("key", F.col("at").alias("node"), "y"), ["key", "node"])
    found = found.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("position", "y"))).alias("ys"))
    return kept(asked.select("ask", *RANGE).join(found, "ask").drop("ask"))
