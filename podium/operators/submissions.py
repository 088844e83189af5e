"""Rules applied to submissions: validation, personal bests, history, rate limit."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.sequences import Sequence, numbered
from podium.functions.sizes import counted_broadcast
from podium.functions.times import bucket, micros_between
from podium.functions.values import event_key, is_highest, sort_key
from podium.operators.ranking import TOP_BOUND, page_bounds, ranks_of
from podium.operators.standings import BEST
from podium.schemas import SCORE
from podium.session import pinned

# 12 digits, 2 of them decimals; 30 submissions a minute.
WHOLE_DIGITS = 10
DECIMALS = 2
RATE_LIMIT = 30

# Texts that are valid at sight: ten digits at most, two decimals, and zeros at either end.
PLAIN = r"^0*\d{1,10}(?:\.\d{0,2}0*)?$"
# Sign, whole digits and decimals (or decimals alone), sign and digits of an exponent.
NUMBER = r"^([+-]?)(?:(\d+)(?:\.(\d*))?|\.(\d+))(?:[eE]([+-]?)(\d+))?$"


def _with_digits(rows):
    """``rows`` (_text, _plain) with the sign, the significant digits and how many of them are decimals.

    Nothing is rounded: zeros at either end are taken off and the exponent moves the point. Beyond
    nine digits an exponent counts as the largest of nine. Each step is a column of its own, so the
    steps after it use it again and do not match the text anew; plain texts have nulls.
    """
    def part(n):
        return F.regexp_extract("_text", NUMBER, n)

    odd = ~F.coalesce("_plain", F.lit(False))
    parts = F.struct(*(part(n).alias(f"p{n}") for n in range(1, 7)))
    rows = rows.withColumn("_parts", F.when(odd, parts))
    every = F.regexp_replace(F.concat("_parts.p2", "_parts.p3", "_parts.p4"), "^0+", "")
    rows = rows.withColumn("_every", every).withColumn("_shift", F.regexp_replace("_parts.p6", "^0+", ""))
    shift = F.when(F.length("_shift") > 9, F.lit(999_999_999)).otherwise(
        F.coalesce(F.col("_shift").try_cast("int"), F.lit(0))
    )
    rows = rows.withColumn("_digits", F.regexp_replace("_every", "0+$", "")).withColumn("_shift", shift)
    shift = F.when(F.col("_parts.p5") == "-", -F.col("_shift")).otherwise(F.col("_shift"))
    zeros = F.length("_every") - F.length("_digits")
    decimals = F.length(F.concat("_parts.p3", "_parts.p4")) - shift - zeros
    return rows.withColumn("_sign", F.col("_parts.p1")).withColumn("_decimals", decimals)


def judged(submissions, games):
    """Submissions with ``reject_reason`` (null when valid) and the score as decimal.

    Digits are counted in the text, before any cast could round them. Zeros at the end are no
    decimals (1.000 is valid), and minus zero is zero.
    The games table is the static side, so this also runs on a stream.
    """
    known = games.select("game_id", F.col("is_active").alias("_active"))
    joined = submissions.join(known, "game_id", "left")
    joined = joined.withColumn("_text", F.trim(F.col("score").cast("string")))
    joined = _with_digits(joined.withColumn("_plain", F.col("_text").rlike(PLAIN)))
    text, plain, sign, digits, decimals = map(F.col, ("_text", "_plain", "_sign", "_digits", "_decimals"))
    reason = (
        F.when(F.col("_active").isNull(), "game_not_found")
        .when(~F.col("_active"), "game_inactive")
        # Nearly all texts end here; only others have their digits taken apart.
        .when(plain, F.lit(None))
        .when(~F.coalesce(text.rlike(NUMBER), F.lit(False)), "score_not_a_number")
        .when((sign == "-") & (digits != ""), "score_negative")
        .when((digits != "") & (decimals > DECIMALS), "too_many_decimals")
        .when((digits != "") & (F.length(digits) - decimals > WHOLE_DIGITS), "too_many_digits")
    )
    number = F.when(plain, text).when(digits == "", F.lit("0")).otherwise(text)
    return joined.withColumn("_reason", reason).select(
        "id",
        "user_id",
        "game_id",
        F.col("score").alias("raw_score"),
        F.when(F.col("_reason").isNull(), number.try_cast(SCORE)).alias("score"),
        "submitted_at",
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.col("_reason").alias("reject_reason"),
    )


def valid(judged_rows):
    """Accepted submissions in the shape of scores."""
    return judged_rows.filter(F.col("reject_reason").isNull()).drop("raw_score", "reject_reason")


def rejected(judged_rows):
    return judged_rows.filter(F.col("reject_reason").isNotNull()).drop("score")


def personal_best_flags(scores, games, bound=None):
    """Every submission with the flag: does it beat all earlier ones of its user in its game?

    The first submission does. Time decides what is earlier, then the id.
    """
    typed = scores.join(games.select("game_id", "score_type"), "game_id")
    # One running maximum serves all score types: smaller scores win where it is negated.
    worth = F.when(is_highest(), F.col("score")).otherwise(-F.col("score"))
    narrow = typed.select(
        "id", "user_id", "game_id", "score", "submitted_at", worth.alias("_worth")
    )
    seq = Sequence(narrow, ["user_id", "game_id"], ["submitted_at", "id"], bound, counted=scores)
    flagged = seq.running("_before", F.max, F.greatest, "_worth").done()
    beats = F.col("_before").isNull() | (F.col("_worth") > F.col("_before"))
    return flagged.select(
        "id", "user_id", "game_id", "score", "submitted_at", beats.alias("is_personal_best")
    )


def user_best(scores, games, user_id=None, game_id=None):
    """The best row of each (user, game): its id, score, time. Equal scores: the earliest."""
    if user_id is not None:
        scores = scores.filter(F.col("user_id") == user_id)
    if game_id is not None:
        scores = scores.filter(F.col("game_id") == game_id)
    typed = scores.join(games.select("game_id", "score_type"), "game_id")
    # Per score first, then the best score: keys of fixed width, so both are hash aggregates.
    keyed = typed.select(
        "user_id",
        "game_id",
        "id",
        "score",
        "submitted_at",
        event_key().alias("_event"),
        sort_key().alias("_key"),
    )
    each = keyed.groupBy("user_id", "game_id", "_key").agg(
        F.min_by("id", "_event").alias("id"),
        F.first("score").alias("score"),
        F.min("submitted_at").alias("submitted_at"),
    )
    return each.groupBy("user_id", "game_id").agg(
        *(F.min_by(c, "_key").alias(c) for c in ("id", "score", "submitted_at"))
    )


def score_history(scores, games, user_id, game_id, page=1, page_size=20, bound=None):
    """One page of a user's scores in a game, newest first."""
    start, end = page_bounds(page, page_size)
    placed = _history_places(scores, games, user_id, game_id, start + 1, end + 1, bound)
    return placed.orderBy("_place").drop("_place")


def score_history_top(scores, games, user_id, game_id, limit=None):
    """A user's scores in a game, newest first; all of them unless ``limit`` is given."""
    rows = _history(scores, games, user_id, game_id).orderBy(*_newest())
    return rows if limit is None else rows.limit(limit)


def history_page(scores, games, user_id, game_id, page=1, page_size=20, bound=None):
    """As :func:`score_history`, with paging columns; has_next looks one row ahead.

    A page without scores is one row with the paging columns and nulls beside them.
    """
    start, end = page_bounds(page, page_size)
    size = end - start + 1
    ahead = _history_places(scores, games, user_id, game_id, start + 1, end + 2, bound)
    row = F.struct(*(c for c in ahead.columns if c != "_place"))
    shown = F.collect_list(F.when(F.col("_place") <= end + 1, row))  # at most 100 rows
    gathered = ahead.agg(
        shown.alias("rows"),
        F.coalesce(F.max("_place") > end + 1, F.lit(False)).alias("has_next"),
    )
    return gathered.select("has_next", F.explode_outer("rows").alias("row")).select(
        "row.*",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        "has_next",
    )


def _newest():
    return [F.desc("submitted_at"), F.desc("id")]


def _history(scores, games, user_id, game_id):
    mine = scores.filter((F.col("user_id") == user_id) & (F.col("game_id") == game_id))
    return mine.join(games.select("game_id", "game_name"), "game_id").select(
        "id", "game_name", "score", "submitted_at", "metadata"
    )


def _history_places(scores, games, user_id, game_id, first, last, bound):
    """Rows first..last of a history with their ``_place``. Deep ones are numbered in pieces."""
    rows = _history(scores, games, user_id, game_id)
    if last <= TOP_BOUND:
        newest = Window.partitionBy(F.lit(0)).orderBy(*_newest())
        placed = rows.orderBy(*_newest()).limit(last).withColumn("_place", F.row_number().over(newest))
    else:
        every = rows.withColumn("_all", F.lit(0))
        placed = numbered(every, ["_all"], _newest(), "_place", bound).drop("_all")
    return placed.filter(F.col("_place").between(first, last))


def submission_results(scores, games, new_ids=None, kind=BEST, bound=None):
    """What a submitter is told: score, personal-best flag, rank and board size after the write.

    ``new_ids`` (a DataFrame with ``id``) limits the answer to a batch of new submissions.
    """
    flags = personal_best_flags(scores, games, bound)
    wanted = None
    if new_ids is not None:
        flags = flags.join(new_ids.select("id"), "id", "left_semi")
        wanted = scores.join(new_ids.select("id"), "id", "left_semi")
    ranks = ranks_of(scores, games, wanted, kind, bound)
    return flags.join(ranks, ["game_id", "user_id"], "left").select(
        "id",
        "user_id",
        "game_id",
        "score",
        F.col("user_rank").alias("rank"),
        "total_players",
        "is_personal_best",
    )


def busy_slots(scores, limit=RATE_LIMIT, unit="minute"):
    """(user, minute) slots with more than ``limit`` submissions."""
    slots = scores.groupBy("user_id", bucket(unit, "submitted_at").alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return slots.filter(F.col("n") > limit)


def rate_limit_excess(scores, limit=RATE_LIMIT, unit="minute", bound=None):
    """Submissions beyond the first ``limit`` of their user and minute, with their position.

    Only slots over the limit are numbered; all others leave after one counting aggregate.
    """
    rows = scores.select(
        "id", "user_id", "game_id", "submitted_at", bucket(unit, "submitted_at").alias("slot")
    )
    busy = counted_broadcast(pinned(busy_slots(scores, limit, unit).select("user_id", "slot")))
    crowded = rows.join(busy, ["user_id", "slot"], "left_semi")
    seq = Sequence(crowded, ["user_id", "slot"], ["submitted_at", "id"], bound)
    return seq.number("position").done().filter(F.col("position") > limit)


def play_sessions(scores, gap_minutes=30, bound=None):
    """Play sessions: a user's submissions with pauses of at most ``gap_minutes``.

    One row per session: start, end (last submission), submissions, length in seconds.
    """
    gap = F.lit(gap_minutes * 60_000_000)
    rows = scores.select("id", "user_id", "submitted_at")
    seq = Sequence(rows, ["user_id"], ["submitted_at", "id"], bound).previous(
        "_last", "submitted_at"
    )
    pause = micros_between("_last", "submitted_at")
    starts = F.when(F.col("_last").isNull() | (pause > gap), F.col("submitted_at"))
    # The session of a row is the latest start up to it.
    seq.derive("_start", starts).running(
        "session_start", F.max, F.greatest, "_start", inclusive=True
    )
    sessions = seq.done().groupBy("user_id", "session_start").agg(
        F.max("submitted_at").alias("session_end"), F.count(F.lit(1)).alias("submissions")
    )
    length = micros_between("session_start", "session_end")
    return sessions.withColumn("length_seconds", length.cast("double") / F.lit(1e6))
