"""Events to visits and per-patient token sequences.

How a sequence is put together. Equal events of one patient and day are first counted
(``n`` copies, summed map-side), so a patient or a day with a huge number of rows costs
no more than its distinct codes. The tokens before each day are then a running total
over a narrow table with one row per patient and day, and the tokens before each code
a running total within the day. With every token's absolute position known, tokens are
collected into arrays.

A sequence is one row, whatever its length. A caller who asks for ``segment_tokens`` gets
every sequence in segments of that many tokens instead: ``start`` is the position of a
segment's first token in the sequence and ``visit`` the number of visits that end before
it. ``n_tokens`` and ``n_visits`` are always those of the whole sequence. Operators take
both forms, and positions mean the same in both.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.functions.arrays import count_token, tail
from epistrand.schemas import SEP

# Stands for a missing date: later than any date.
_NO_DAY = 2**31 - 1


def count_events(events: DataFrame, *keys: str) -> DataFrame:
    """Equal events counted: ``PATIENT_ID, day, CODE, n`` and any further ``keys``.

    ``day`` is the number of days since 1970-01-01.
    """
    return events.groupBy("PATIENT_ID", day_number(F.col("DATE")).alias("day"), "CODE", *keys).agg(F.count("*").alias("n"))


def day_number(date):
    return F.coalesce(F.unix_date(date), F.lit(_NO_DAY))


def year_of_day(day):
    return F.when(day != F.lit(_NO_DAY), F.year(F.date_from_unix_date(day)))


def lay_out(days: DataFrame, keys: list[str]) -> DataFrame:
    """Add to each day of a sequence where it starts and how long the whole sequence is.

    ``days`` has ``keys, day, n_day``. A sequence has one row per calendar day here, so
    the window is bounded by the length of a record, not by its number of events.
    """
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_day") + 1
    return days.select(
        "*",
        F.coalesce(F.sum(tokens).over(before), F.lit(0)).alias("start"),
        (F.row_number().over(whole.orderBy("day")) - 1).cast("long").alias("visit"),
        F.sum(tokens).over(whole).alias("n_tokens"),
        F.count("*").over(whole).alias("n_visits"),
    )


def assemble(counts: DataFrame, layout: DataFrame, keys: list[str], segment_tokens: int | None = None) -> DataFrame:
    """Token arrays from counted events and the layout of their days.

    ``counts`` has ``keys, day, CODE, AGE, n``; ``layout`` has ``keys, day, sep_age`` and
    the columns of :func:`lay_out`. If ``AGE`` is missing from ``counts``, all events of a
    day get ``sep_age``. Returns ``keys, n_tokens, n_visits, code, age``, and before them
    ``start, visit`` if ``segment_tokens`` is given.
    """
    return collect_runs(place(counts, layout, keys), keys, segment_tokens)


def place(counts: DataFrame, layout: DataFrame, keys: list[str], carry=("n_tokens", "n_visits")) -> DataFrame:
    """Runs of equal tokens at their absolute positions: the long form that arrays are collected from.

    ``keys, at, n, visit, code, age, sep_age, closes`` and the columns of the layout in
    ``carry``. ``closes`` marks the last run of a day, which the separator follows.
    """
    has_age = "AGE" in counts.columns
    order = [F.col("CODE").asc_nulls_last()] + ([F.col("AGE").asc_nulls_last()] if has_age else [])
    before = (
        Window.partitionBy(*keys, "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # The window leaves the counts partitioned and sorted for a merge join. The size of
    # compressed files may make Spark believe that they can be broadcast instead.
    placed = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        layout.hint("merge"), [*keys, "day"]
    )
    return placed.select(
        *keys, *carry, (F.col("start") + F.col("_before")).alias("at"), "n", "visit",
        F.col("CODE").alias("code"), (F.col("AGE") if has_age else F.col("sep_age")).alias("age"), "sep_age",
        (F.col("_before") + F.col("n") == F.col("n_day")).alias("closes"),
    )


def place_in_order(counts: DataFrame, keys: list[str], also: tuple = ()) -> DataFrame:
    """The positions of :func:`lay_out` and :func:`place` together, by one shuffle: of the counts, by ``keys``.

    ``counts`` has ``keys, day, CODE, n``. Adds ``at, visit, closes, n_tokens, n_visits`` and, for
    each name and column in ``also``, the column's greatest value in the sequence. A sequence passes
    through one task in order; the windows keep no more of it in memory than fits, and spill.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("day", F.col("CODE").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.select(
        "*",
        (~F.lag("day").over(order).eqNullSafe(F.col("day"))).cast("long").alias("_opens"),
        (~F.lead("day").over(order).eqNullSafe(F.col("day"))).alias("closes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.sum("n").over(every).alias("_events"),
        *[F.max(column).over(every).alias(name) for name, column in also],
    )
    visit = (F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("visit")
    placed = placed.select("*", visit, F.sum("_opens").over(every).alias("n_visits"))
    # A separator follows each visit.
    positions = {"at": F.col("_before") + F.col("visit"), "n_tokens": F.col("_events") + F.col("n_visits")}
    return placed.withColumns(positions).drop("_opens", "_before", "_events")


def last_tokens(runs: DataFrame, n: int) -> DataFrame:
    """The runs of the last ``n`` tokens of each sequence, cut at its border, so that no more is ever collected."""
    first = F.greatest(F.col("n_tokens") - n, F.lit(0))
    gone = F.greatest(first - F.col("at"), F.lit(0))
    cut = runs.filter(F.col("at") + F.col("n") + F.col("closes").cast("long") > first)
    return cut.withColumns({"at": F.col("at") + F.least(gone, F.col("n")), "n": F.greatest(F.col("n") - gone, F.lit(0))})


def collect_tails(runs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One row per sequence with its last ``n`` tokens; ``n_tokens, n_visits`` are those of the whole sequence."""
    tails = collect_runs(last_tokens(runs, n), keys)
    return tails.withColumnRenamed("PATIENT_ID", "patid") if "PATIENT_ID" in keys else tails


def collect_runs(
    runs: DataFrame, keys: list[str], segment_tokens: int | None = None, deal: tuple[int, str] | None = None,
    together: bool = False,
) -> DataFrame:
    """Collect runs of equal tokens into one row per sequence, or per segment of it.

    With ``deal``, a number and one of the keys, the result is hash partitioned by that key
    into so many partitions, as a table stored by key needs it. ``together`` says that the runs
    of a sequence are in one partition, as ``place_in_order`` leaves them; no run is shuffled then.
    """
    at, n, closes = F.col("at"), F.col("n"), F.col("closes").cast("long")
    group, first, copies, has_sep = list(keys), at, n, F.col("closes")
    if segment_tokens is not None:
        if segment_tokens < 1:
            raise ValueError("segment_tokens must be at least 1")
        size = F.lit(segment_tokens).cast("long")
        segments = F.sequence(F.floor(at / size), F.floor((at + n + closes - 1) / size))
        runs = runs.withColumn("start", F.explode(F.transform(segments, lambda i: i * size)))
        low, high = F.col("start"), F.col("start") + size
        first = F.greatest(at, low)
        copies = F.greatest(F.least(at + n, high) - first, F.lit(0))
        has_sep = F.col("closes") & (at + n >= low) & (at + n < high)
        group.append("start")
    group += ["n_tokens", "n_visits"]
    piece = F.struct(first.alias("at"), "code", "age", "sep_age", copies.cast("int").alias("copies"), has_sep.alias("sep"), "visit")
    # Rows arrive in groups, so that each array is filled in one go.
    pieces = runs.select(*group, piece.alias("piece"))
    pieces = (pieces if together else pieces.repartition(*(deal or group))).sortWithinPartitions(*group)
    collected = pieces.groupBy(*group).agg(F.sort_array(F.collect_list("piece")).alias("pieces"))

    def spread(value, closing):
        def one(p):
            repeated = F.array_repeat(value(p), p["copies"])
            return F.when(p["sep"], F.concat(repeated, F.array(closing(p)))).otherwise(repeated)

        return F.flatten(F.transform("pieces", one))

    visit = [F.get("pieces", F.lit(0))["visit"].alias("visit")] if segment_tokens is not None else []
    return collected.select(
        *group[:-2], *visit, "n_tokens", "n_visits",
        spread(lambda p: p["code"], lambda p: F.lit(SEP)).alias("code"),
        spread(lambda p: p["age"], lambda p: p["sep_age"]).alias("age"),
    )


def collect_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sequence from counted events ``keys, day, CODE, n, sep_age``, of which all of a day have its age.

    As ``collect_runs`` of what ``place`` makes of them, without their positions.
    """
    piece = F.struct("day", F.col("CODE").isNull().alias("no_code"), "CODE", F.col("n").cast("int").alias("copies"), "sep_age")
    pieces = counts.select(*keys, piece.alias("piece")).repartition(*keys).sortWithinPartitions(*keys)
    collected = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    # The day of the piece after each; none follows the last one.
    after = F.concat(F.slice(F.col("pieces.day"), F.lit(2), F.size("pieces")), F.array(F.lit(None).cast("int")))
    rows = collected.select(*keys, "pieces", after.alias("after"))

    def code(p, next_day):
        repeated = F.array_repeat(p["CODE"], p["copies"])
        return F.when(p["day"].eqNullSafe(next_day), repeated).otherwise(F.concat(repeated, F.array(F.lit(SEP))))

    def age(p, next_day):
        return F.array_repeat(p["sep_age"], p["copies"] + F.when(p["day"].eqNullSafe(next_day), 0).otherwise(1))

    codes, ages = (F.flatten(F.zip_with("pieces", "after", f)) for f in (code, age))
    n_tokens = F.aggregate("pieces", F.col("n_visits"), lambda n, p: n + p["copies"])
    rows = rows.select(*keys, "pieces", F.size(F.array_distinct("pieces.day")).cast("long").alias("n_visits"), codes.alias("code"), ages.alias("age"))
    return rows.select(*keys, n_tokens.alias("n_tokens"), "n_visits", "code", "age")


def build_visits(events: DataFrame, segment_tokens: int | None = None) -> DataFrame:
    """One row per patient and day: the sorted codes of the day and their ages, closed by SEP.

    ``events`` has ages (see ``add_age``). Returns ``PATIENT_ID, DATE, n_tokens, code, age``,
    and ``start`` in the visit if it is cut into segments.
    """
    counts = count_events(events, "AGE")
    date = F.when(F.col("_day") != F.lit(_NO_DAY), F.date_from_unix_date("_day")).alias("DATE")
    if segment_tokens is None:
        return _whole_visits(counts).select("PATIENT_ID", date, "n_tokens", "code", "age")
    days = _days(counts, ["PATIENT_ID"])
    zero = F.lit(0).cast("long")
    layout = days.withColumns({"start": zero, "visit": zero, "n_tokens": F.col("n_day") + 1, "n_visits": F.lit(1)})
    # The day is part of the key, so positions count within the visit.
    visits = assemble(
        counts.withColumn("_day", F.col("day")), layout.withColumn("_day", F.col("day")),
        ["PATIENT_ID", "_day"], segment_tokens,
    )
    return visits.select("PATIENT_ID", date, "start", "n_tokens", "code", "age")


def _whole_visits(counts):
    """One row per patient and day from counted events, which come together by one shuffle.

    The codes order a day, so it needs no positions. Events without a patient are left out, as
    :func:`place` does.
    """
    fields = [F.col("CODE").isNull().alias("no_code"), "CODE", F.col("AGE").isNull().alias("no_age"), "AGE"]
    piece = F.struct(*fields, F.col("n").cast("int").alias("copies"))
    pieces = counts.filter(F.col("PATIENT_ID").isNotNull()).select("PATIENT_ID", F.col("day").alias("_day"), "n", piece.alias("piece"))
    # Rows arrive in groups, so that each array is filled in one go.
    pieces = pieces.repartition("PATIENT_ID", "_day").sortWithinPartitions("PATIENT_ID", "_day")
    visits = pieces.groupBy("PATIENT_ID", "_day").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"),
        (F.sum("n") + 1).alias("n_tokens"),
        F.min("piece.AGE").alias("sep_age"),
    )

    def spread(field, closing):
        repeated = F.flatten(F.transform("pieces", lambda p: F.array_repeat(p[field], p["copies"])))
        return F.concat(repeated, F.array(closing))

    codes, ages = spread("CODE", F.lit(SEP)), spread("AGE", F.col("sep_age"))
    return visits.select("PATIENT_ID", "_day", "n_tokens", codes.alias("code"), ages.alias("age"))


def _days(counts, keys):
    """Days of each sequence: ``keys, day, n_day, sep_age``."""
    return counts.groupBy(*keys, "day").agg(F.sum("n").alias("n_day"), F.min("AGE").alias("sep_age"))


def build_sequences(events: DataFrame, segment_tokens: int | None = None, by: tuple = ()) -> DataFrame:
    """The visits of each patient in date order: ``patid, n_tokens, n_visits, code, age``.

    ``events`` has ages (see ``add_age``). With ``by`` there is one sequence per patient
    and value of those columns.
    """
    keys = [*by, "PATIENT_ID"]
    return sequences_from_counts(count_events(events, "AGE", *by), keys, segment_tokens)


def sequences_from_counts(counts: DataFrame, keys: list[str], segment_tokens: int | None = None) -> DataFrame:
    """As :func:`build_sequences`, from events that are already counted."""
    layout = lay_out(_days(counts, keys), keys)
    return assemble(counts, layout, keys, segment_tokens).withColumnRenamed("PATIENT_ID", "patid")


def once_each(sequences: DataFrame) -> DataFrame:
    """One row per sequence: its first segment, if it comes in segments."""
    return sequences.filter(F.col("start") == 0) if "start" in sequences.columns else sequences


def latest(sequences: DataFrame, n: int) -> DataFrame:
    """One row per sequence with its last ``n`` tokens (all, if there are fewer) in ``code`` and ``age``.

    Of a sequence in segments only those that hold such tokens are brought together.
    """
    arrays = [c for c in ("code", "age") if c in sequences.columns]
    if "start" not in sequences.columns:
        return sequences.withColumns({c: tail(F.col(c), n) for c in arrays})
    gone = F.greatest(F.col("n_tokens") - n - F.col("start"), F.lit(0)).cast("int")
    cut = sequences.filter(F.col("start") + F.size("code") > F.col("n_tokens") - n)
    cut = cut.withColumns({c: F.slice(c, gone + 1, F.greatest(F.size(c) - gone, F.lit(0))) for c in arrays})
    others = [c for c in sequences.columns if c not in ("start", "visit", *arrays)]
    joined = cut.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct("start", *arrays))).alias("_segments"))
    columns = {c: F.flatten(F.col(f"_segments.{c}")) for c in arrays}
    return joined.select(*others, *[v.alias(c) for c, v in columns.items()])


def min_tokens(sequences: DataFrame, n: int = 2) -> DataFrame:
    """Sequences of at least ``n`` tokens, separators included; all segments of those in segments."""
    length = F.col("n_tokens") if "n_tokens" in sequences.columns else F.size("code")
    return sequences.filter(length >= n)


def min_visits(sequences: DataFrame, n: int = 5) -> DataFrame:
    """Sequences of at least ``n`` visits; all segments of those in segments."""
    visits = F.col("n_visits") if "n_visits" in sequences.columns else count_token(F.col("code"))
    return sequences.filter(visits >= n)


def visit_filter_report(sequences: DataFrame, n: int = 5) -> DataFrame:
    """How many sequences :func:`min_visits` keeps: ``n_before, n_after, n_dropped``."""
    whole = once_each(sequences)
    visits = F.col("n_visits") if "n_visits" in sequences.columns else count_token(F.col("code"))
    return whole.agg(
        F.count("*").alias("n_before"),
        F.count_if(visits >= n).alias("n_after"),
        F.count_if(visits < n).alias("n_dropped"),
    )


def _lengths(sequences):
    whole = once_each(sequences)
    length = F.col("n_tokens") if "n_tokens" in sequences.columns else F.size("code").cast("long")
    return whole.withColumn("seq_len", length)


def sequence_summary(sequences: DataFrame) -> DataFrame:
    """``n_patients, avg_seq_len, max_seq_len``. Where there is ``n_tokens``, no array is read."""
    return _lengths(sequences).agg(
        F.count("*").alias("n_patients"),
        F.avg("seq_len").alias("avg_seq_len"),
        F.max("seq_len").alias("max_seq_len"),
    )


def longest_sequences(sequences: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` longest sequences: ``patid, seq_len``."""
    return _lengths(sequences).select("patid", "seq_len").orderBy(F.desc("seq_len"), "patid").limit(k)
