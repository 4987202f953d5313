"""Mixed timestamp formats and zones to one instant (expectation-maximisation per source).

Every text is parsed under each format that can read it. A source (feed) is a mixture of formats - year first, month in
letters, epoch, day-month and month-day numbers - and of junk. Each value contributes its likelihood under every valid
parse, by the distance of the instant to the time the row was written; EM fits the mixture weights of the source and the
posterior chooses the interpretation. What stays open comes out with an explicit status.

A declared ``date_order`` is a prior worth ``DECLARED`` observations, which unmistakable values of the other order can
outvote; a source without one learns its order from its values alone. Values enter the fit as counts by their
likelihoods, at most some thirty groups a source, so the steps work on sufficient statistics and not on rows.

Edge cases (all tested): null, empty or unreadable text and impossible dates -> ``unreadable``; a wall time
that occurs twice -> ``ambiguous_fold``, one that never occurs -> ``nonexistent``; both day orders about
equally likely -> ``ambiguous_order``; wall time without a known zone or zone letters the feed's zone doesn't
use -> ``unknown_zone``. Repeated rows each keep their own result; extra columns of the input are ignored.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fenced, small_side, spread

# Month names as written by senders.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_ZONE = r"([Zz]|[A-Za-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[([A-Za-z_/+\-0-9]+)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_TAIL = rf"{_CLOCK}\s*{_ZONE}$"
#: Each pattern rewrites a text it reads to kind|year|month|day|hour|minute|second|fraction|a-or-p|zone.
SHAPES = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[Tt\s]\s*{_TAIL}", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?()\s*{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}|\d{{2}}),?\s+{_TAIL}", "num|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?,?\s+(\d{{4}}),?\s+{_TAIL}", "txt|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TAIL}", "txt|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{10})(?:\.(\d{1,9}))?$", "epoch|$1||||||$2||"),
    (r"^(\d{10})(\d{3})$", "epoch|$1||||||$2||"),
    (r"^(\d{10})(\d{6})$", "epoch|$1||||||$2||"),
]

#: The formats a source mixes; those of one kind but ``num`` have one reading.
FORMATS = ("ymd", "txt", "epoch", "dmy", "mdy", "junk")
#: Likelihood of a parse by its distance to the time the row was written: within 3 days, 60 days, beyond; that of junk.
NEAR, FAR, REMOTE, JUNK = 0.90, 0.09, 0.01, 1e-12
#: Prior of the declared order and of the other one, in observations; every other format has one.
DECLARED, OTHER = 100.0, 0.01
EM_STEPS, SURE = 40, 0.99
#: An order with less than this share of a source's numeric dates is no format of the source: a date possible in that
#: order only is an impossible date.
MINOR = 0.05
#: Zone names whose letters are looked up: the tz database has fewer. More are refused.
MAX_ZONES = 1000
DAY_US = 86_400_000_000


def zone_letters(zones: list[str]) -> list[tuple[str, str, int]]:
    """(zone, letters, offset in microseconds) that each zone of the tz database has used since 2000.

    A zone name counts among the few hundred of the tz database, which bounds this table. Letters with two
    meanings inside one zone are left out.
    """
    out = []
    for name in zones:
        seen: dict[str, set[int]] = {}
        try:
            zone = ZoneInfo(name)
        except Exception:  # an unknown zone has no letters
            continue
        at = datetime(2000, 1, 1, tzinfo=timezone.utc)
        while at.year < 2040:
            local = at.astimezone(zone)
            if (letters := local.tzname() or "").isalpha():
                seen.setdefault(letters.upper(), set()).add(int(local.utcoffset().total_seconds()) * 1_000_000)
            at += timedelta(days=7)
        out += [(name, k, min(v)) for k, v in seen.items() if len(v) == 1]
    return out


def _fields(text: Column) -> Column:
    """The text rewritten by the one shape that reads it; unread texts have no ``|``."""
    out = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    out = F.translate(out, "|", "\u0001")
    for pattern, to in SHAPES:
        out = F.regexp_replace(out, pattern, to)
    return out


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null for an impossible date."""
    return F.unix_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def _offset(zone: Column, at: Column) -> Column:
    """Offset of a zone in microseconds at an instant given in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone)) - at


PARSED = ("row_id", "feed_id", "written", "zone", "declared", "kind", "wall_dmy", "wall_mdy", "mark_us", "marked")


def parsed(messages: DataFrame, feeds: DataFrame, letters: DataFrame, columns: tuple[str, ...] = PARSED) -> DataFrame:
    """row_id, feed_id and the clock readings of each text: wall_dmy and wall_mdy in microseconds (equal for
    all formats but ``num``), mark_us (offset of a zone mark), whether it is marked, zone and declared order."""
    f = feeds.select(F.col("feed_id").alias("_f"), F.col("zone_name").alias("zone"), F.lower("date_order").alias("declared"))
    m = messages.select("row_id", "feed_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("written"), _fields(F.col("received_at")).alias("_s"))
    m = m.join(f, m.feed_id == f._f, "left").withColumn("_p", F.split("_s", r"\|"))
    p = lambda i: F.get("_p", F.lit(i))
    m = m.select("row_id", "feed_id", "written", "zone", "declared", F.when(F.size("_p") >= 10, p(0)).alias("kind"), *[p(i).alias(f"_{i}") for i in range(1, 10)])
    number = lambda c: F.col(c).try_cast("bigint")
    year = F.when(F.length("_1") == 2, F.concat(F.lit("20"), F.col("_1"))).otherwise(F.col("_1"))
    month = F.when(F.col("kind") == "txt", F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring("_2", 1, 3))).cast("string")).otherwise(F.col("_2"))
    half = F.lower("_8")
    hour = F.when(half == "", number("_4")).when(number("_4").between(1, 12), number("_4") % 12 + F.when(half == "p", 12).otherwise(0))
    sec = F.when(F.col("_6") == "", F.lit(0)).otherwise(number("_6"))
    frac = F.rpad(F.substring("_7", 1, 6), 6, "0").try_cast("bigint")
    frac = F.when(F.col("_7") == "", F.lit(0)).otherwise(frac)
    clock = F.when((hour <= 23) & (number("_5") <= 59) & (sec <= 59), ((hour * 60 + number("_5")) * 60 + sec) * 1_000_000 + frac)
    m = m.withColumns({"_clock": clock, "_y": year, "_m": month, "_letters": F.upper("_9")})
    wall = lambda y, mo, d: _days(y, mo, d) * F.lit(DAY_US) + F.col("_clock")
    epoch = F.when(F.col("kind") == "epoch", number("_1") * 1_000_000 + frac)
    as_dmy = F.when(F.col("kind") == "epoch", epoch).otherwise(wall(F.col("_y"), F.col("_m"), F.col("_3")))
    as_mdy = F.when(F.col("kind") == "num", wall(F.col("_y"), F.col("_3"), F.col("_m"))).otherwise(F.col("wall_dmy"))
    m = m.withColumn("wall_dmy", as_dmy).withColumn("wall_mdy", as_mdy)
    digits = F.regexp_replace("_9", ":", "")
    hours, minutes = F.substring(digits, 2, 2).try_cast("int"), F.when(F.length(digits) > 3, F.substring(digits, 4, 2).try_cast("int")).otherwise(0)
    signed = F.when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes).cast("bigint") * 60_000_000 * F.when(F.startswith("_9", F.lit("-")), -1).otherwise(1))
    z = letters.select(F.col("zone").alias("_z"), F.col("letters").alias("_l"), F.col("offset_us").alias("_o"))
    m = m.join(F.broadcast(z), (m.zone == z._z) & (m._letters == z._l), "left")  # bounded by the tz database
    mark = F.when(F.col("kind") == "epoch", F.lit(0)).when(F.col("_letters").isin("Z", "UTC", "GMT"), F.lit(0)).when(F.col("_9").rlike(r"^[+-]"), signed).otherwise(F.col("_o"))
    m = m.withColumns({"mark_us": mark.cast("bigint"), "marked": F.coalesce(F.col("_9"), F.lit("")) != ""})
    return fenced(m.select(*columns))


def _likelihood(wall: Column) -> Column:
    gap = F.abs(wall - F.col("written"))
    return F.when(wall.isNull(), 0.0).when(gap <= 3 * DAY_US, NEAR).when(gap <= 60 * DAY_US, FAR).otherwise(REMOTE)


def _likelihoods() -> Column:
    """Likelihood of a parsed text under each of FORMATS."""
    kind, dmy, mdy = F.col("kind"), _likelihood(F.col("wall_dmy")), _likelihood(F.col("wall_mdy"))
    own = {"dmy": F.when(kind == "num", dmy), "mdy": F.when(kind == "num", mdy), "junk": F.lit(JUNK)}
    return F.array(*[F.coalesce(own.get(k, F.when(kind == k, dmy)), F.lit(0.0)) for k in FORMATS])


def format_mixture(parts: DataFrame, steps: int = EM_STEPS) -> DataFrame:
    """EM over the texts of each source: feed_id and the weights of FORMATS, all steps inside one ``aggregate``."""
    stats = parts.select("feed_id", "declared", _likelihoods().alias("l")).groupBy("feed_id", "declared", "l").agg(F.count("*").cast("double").alias("n"))
    per = stats.groupBy("feed_id").agg(F.first("declared", True).alias("declared"), F.collect_list(F.struct("l", "n")).alias("s"))
    order = lambda own, other: F.when(F.col("declared") == own, DECLARED).when(F.col("declared") == other, OTHER).otherwise(1.0)
    prior = F.array(*[order("dmy", "mdy") if k == "dmy" else order("mdy", "dmy") if k == "mdy" else F.lit(1.0) for k in FORMATS])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    scaled = lambda x: F.transform(x, lambda y: y / total(x))

    def step(w: Column, _: Column) -> Column:
        def share(x: Column) -> Column:
            joint = F.zip_with(x["l"], w, lambda a, b: a * b)
            return F.transform(joint, lambda j: x["n"] * j / total(joint))

        return scaled(F.aggregate("s", F.col("prior"), lambda a, x: F.zip_with(a, share(x), lambda p, q: p + q)))

    fitted = per.withColumn("prior", prior).withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>"), scaled(F.col("prior")), step))
    return fitted.select("feed_id", "w")


def normalise_timestamps(messages: DataFrame, feeds: DataFrame, steps: int = EM_STEPS) -> DataFrame:
    """row_id, feed_id, kind, utc_us, status ('resolved' or why not), posterior of the chosen reading; EM takes ``steps``.

    One row per row of ``messages``. ``feeds`` must have unique feed_id; messages of an unknown feed are
    resolved only where the text carries its own offset. See the module for edge cases.
    """
    spark = messages.sparkSession
    names = [r[0] for r in feeds.select("zone_name").where("zone_name is not null").distinct().limit(MAX_ZONES + 1).collect()]
    if len(names) > MAX_ZONES:
        raise ValueError(f"feeds name more than {MAX_ZONES} zones, which is more than the tz database has")
    letters = spark.createDataFrame(zone_letters(names), "zone string, letters string, offset_us bigint")
    messages = spread(messages.select("row_id", "feed_id", "received_at", "created_at"))
    w = small_side(format_mixture(parsed(messages, feeds, letters, ("feed_id", "written", "declared", "kind", "wall_dmy", "wall_mdy")), steps))
    m = parsed(messages, feeds, letters).join(w.select(F.col("feed_id").alias("_wf"), "w"), F.col("feed_id").eqNullSafe(F.col("_wf")), "left")
    joint = F.zip_with("w", _likelihoods(), lambda a, b: a * b)
    m = fenced(m.select(*PARSED, "w", joint.alias("_joint"))).withColumn("_sum", F.aggregate("_joint", F.lit(0.0), lambda a, x: a + x))
    at = lambda k: F.col("_joint")[FORMATS.index(k)] / F.col("_sum")
    same = F.col("wall_dmy").eqNullSafe(F.col("wall_mdy"))
    numeric = F.col("kind").eqNullSafe("num")
    m = m.withColumns({"p_dmy": F.when(numeric & same, at("dmy") + at("mdy")).otherwise(at("dmy")), "p_mdy": at("mdy"), "p_junk": at("junk")})
    dmy, mdy = (F.col("w")[FORMATS.index(k)] for k in ("dmy", "mdy"))
    slip = numeric & (F.col("wall_dmy").isNull() & (mdy < MINOR * (dmy + mdy)) | F.col("wall_mdy").isNull() & (dmy < MINOR * (dmy + mdy)))
    two = numeric & ~same
    posterior = F.when(two, F.greatest("p_dmy", "p_mdy")).otherwise(1 - F.col("p_junk"))
    wall = F.when(slip, F.lit(None)).when(two & ~(F.col("p_dmy") >= F.col("p_mdy")), F.col("wall_mdy")).otherwise(F.col("wall_dmy"))
    m = m.withColumns({"posterior": posterior, "wall": wall})
    # a zone changes its offset at most once within two days: the offsets before and after are all candidates
    zone = F.when(F.col("mark_us").isNull() & ~F.col("marked") & F.col("wall").isNotNull(), F.col("zone"))
    m = m.withColumn("_zone", zone)
    m = m.withColumns({"_u1": F.col("wall") - _offset(F.col("_zone"), F.col("wall") - DAY_US), "_u2": F.col("wall") - _offset(F.col("_zone"), F.col("wall") + DAY_US)})
    holds = lambda u: u + _offset(F.col("_zone"), u) == F.col("wall")
    both = F.col("_u1") != F.col("_u2")
    ok1 = holds(F.col("_u1"))
    ok2 = F.when(both, holds(F.col("_u2"))).otherwise(ok1)
    m = m.withColumns({"_ok1": ok1, "_ok2": ok2})
    readable = F.col("wall").isNotNull()
    status = (
        F.when(~readable | (F.col("p_junk") > 0.5), "unreadable")
        .when(F.col("posterior") < SURE, "ambiguous_order")
        .when(F.col("mark_us").isNotNull(), "resolved")
        .when(F.col("marked") | F.col("zone").isNull(), "unknown_zone")
        .when(F.col("_ok1") & F.col("_ok2") & both, "ambiguous_fold")
        .when(F.col("_ok1") | F.col("_ok2"), "resolved")
        .otherwise("nonexistent")
    )
    utc = F.when(F.col("mark_us").isNotNull(), F.col("wall") - F.col("mark_us")).when(F.col("_ok1"), F.col("_u1")).otherwise(F.col("_u2"))
    m = m.withColumn("status", status)
    return fenced(m.select("row_id", "feed_id", "kind", F.when(F.col("status") == "resolved", utc).alias("utc_us"), "status", F.when(readable, F.col("posterior")).alias("posterior")))
