
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from podium.operators import board_index, filters, ranking, standings, submissions  # noqa: E402
from podium.plans import daily, dashboards, reports, views  # noqa: E402
from podium.session import scratch  # noqa: E402
from podium.sources import demo, fixtures, sinks, tables  # noqa: E402
from podium.streaming import activity, corrections, intake, keyed, live, seen  # noqa: E402

try:
    from podium.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("podium.llm", "podium.llm.queries", "corpus_pipeline"):
        raise
    llm = None
except ImportError as missing:
    if missing.name != "podium.llm":  # an empty folder that is left of the subpackage
        raise
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF = fixtures.AS_OF
ORDERS_AS_OF = fixtures.ORDERS_AS_OF
MIDWAY = "2024-01-15 12:00:00"
USER = 8  # the user of single-user queries
GAME = 1  # the game of single-game queries

# Columns computed in double precision by different formulas on both sides.
ROUNDED = (
    "score_stddev",
    "score_consistency",
    "std_deviation",
    "percentile_25",
    "percentile_50",
    "percentile_75",
    "engagement_score",
    "avg_engagement",
    "bin_low",
    "bin_high",
)


def _tidy(df):
    """Round the columns that two engines may compute differently in the last digits."""
    for name in ROUNDED:
        if name in df.columns and isinstance(df.schema[name].dataType, T.DoubleType):
            df = df.withColumn(name, F.round(name, 6))
    return df


class Tables:
    """The logical tables of one test folder, opened when first used."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @cached_property
    def games(self):
        return fixtures.games(self.spark)

    @cached_property
    def users(self):
        return fixtures.users(self.spark, self.sf_dir)

    @cached_property
    def scores(self):
        return fixtures.scores(self.spark, self.sf_dir)

    @cached_property
    def order_games(self):
        return fixtures.order_games(self.spark)

    @cached_property
    def order_scores(self):
        return fixtures.order_scores(self.spark, self.sf_dir)

    @property
    def events(self):
        return fixtures.table(self.spark, self.sf_dir, "events")

    def stream(self):
        return fixtures.events_stream(self.spark, self.sf_dir)

    def score_stream(self):
        return fixtures.scores_from_events(self.stream())

    def demo_tables(self):
        """The tables with one market segment and one game named as demo data."""
        name = F.when(F.col("game_id") == 2, F.lit("Demo view")).otherwise(F.col("game_name"))
        return (
            self.scores,
            self.games.withColumn("game_name", name),
            fixtures.users(self.spark, self.sf_dir, "MACHINERY"),
        )


# --- streams: run to the end of the files, then read what they wrote ----------------------


def _finish(query):
    query.awaitTermination()


def _live_standings(t):
    path, check = scratch(t.spark, "standings"), scratch(t.spark, "check")
    _finish(live.start_live_standings(t.score_stream(), path, check, available_now=True))
    return live.live_standings(t.spark, path, t.games)


def _keyed_standings(t):
    """Scores by halves of the time, the later half first, the query restarted in between."""
    base = scratch(t.spark, "keyed")
    early = F.col("submitted_at") <= F.lit(MIDWAY).cast("timestamp_ntz")
    for rows in (t.scores.filter(~early), t.scores.filter(early)):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(t.scores.schema).parquet(f"{base}/in")
        _finish(keyed.start_keyed(stream, f"{base}/out", f"{base}/check", available_now=True))
    return keyed.keyed_standings(t.spark, f"{base}/out", t.games)


def _answers(t):
    path, out, check = (scratch(t.spark, n) for n in ("standings", "answers", "check"))
    _finish(live.start_answers(t.score_stream(), path, out, t.games, check, available_now=True))
    return t.spark.read.parquet(out).drop("batch_id")


def _pipeline(t, rejects):
    """Submissions from arrival to answer in three batches, out of time order, the last played twice.

    Every third is written as Spark deals it out, and taken by the query with the same checkpoint.
    """
    base = scratch(t.spark, "submissions")
    given = fixtures.submissions_from_events(t.events)
    for part in (0, 1, 2, 2):
        given.filter(F.pmod("id", F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(given.schema).parquet(f"{base}/in")
        _finish(
            live.start_submissions(
                stream, f"{base}/boards", f"{base}/answers", f"{base}/rejects", f"{base}/slots",
                t.games, f"{base}/check", available_now=True, seen=f"{base}/seen",
            )
        )
    if rejects:
        rows = t.spark.read.parquet(f"{base}/rejects")
        return rows.groupBy("game_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"))
    return live.live_standings(t.spark, f"{base}/boards", t.games).select(
        "game_id", "user_id", "best_score", "n"
    )


def _stored_stream(t, rows):
    path, check = scratch(t.spark, "out"), scratch(t.spark, "check")
    schema = rows.schema
    _finish(activity.start(rows, path, check, available_now=True))
    return t.spark.read.schema(schema).parquet(path).drop("batch_id")


def _intake(t, accepted):
    good, bad, check = (scratch(t.spark, n) for n in ("accepted", "rejected", "check"))
    stream = fixtures.submissions_from_events(t.stream())
    _finish(intake.start_intake(stream, t.games, good, bad, check, available_now=True))
    rows = t.spark.read.parquet(good if accepted else bad).drop("batch_id")
    if accepted:
        return rows
    return rows.groupBy("game_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def _distinct_ids(t):
    twice = t.score_stream().unionByName(t.score_stream())
    kept = _stored_stream(t, intake.distinct_ids(twice, "40 days"))
    return kept.agg(F.count(F.lit(1)).alias("submissions"), F.count_distinct("id").alias("ids"))


def _unique_ids(t):
    """Scores by halves of the time, then all of them once more: a replay a month late."""
    base = scratch(t.spark, "unique")
    early = F.col("submitted_at") <= F.lit(MIDWAY).cast("timestamp_ntz")
    for rows in (t.scores.filter(early), t.scores.filter(~early), t.scores):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(t.scores.schema).parquet(f"{base}/in")
        _finish(seen.start_unique(stream, f"{base}/seen", f"{base}/out", f"{base}/check", available_now=True))
    kept = t.spark.read.schema(t.scores.schema).parquet(f"{base}/out")
    return kept.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("submissions"), F.sum("score").cast("decimal(22,2)").alias("score_sum")
    )


def _corrected(t, kind):
    """All scores in a first batch; in a second one in five deleted and one in seven halved."""
    base = scratch(t.spark, "corrections")
    row = F.struct("id", "user_id", "game_id", "score", "submitted_at")
    image, none = row.cast(corrections.IMAGE), F.lit(None).cast(corrections.IMAGE)
    gone, edited = F.col("id") % 5 == 0, F.col("id") % 7 == 0
    halved = t.scores.withColumn("score", F.when(edited, F.bround(F.col("score") / 2, 0)).otherwise(F.col("score")).cast("decimal(12,2)"))
    both = t.scores.select(image.alias("before"), "id").join(halved.select(image.alias("after"), "id"), "id")
    after = F.when(~gone, F.col("after"))
    batches = (
        t.scores.select(none.alias("before"), image.alias("after")),
        both.filter(gone | edited).select("before", after.alias("after")),
    )
    for rows in batches:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(corrections.CHANGES).parquet(f"{base}/in")
        _finish(
            corrections.start_corrections(
                stream, f"{base}/board", t.games, f"{base}/check", available_now=True, kind=kind
            )
        )
    return corrections.corrected_board(t.spark, f"{base}/board", t.games, halved.filter(~gone), kind)


def _days(t):
    """Where the scores lie as summaries by day: of the first half, then refreshed by the rest."""
    path = scratch(t.spark, "days")
    early = F.col("submitted_at") <= F.lit(MIDWAY).cast("timestamp_ntz")
    daily.store_days(t.scores.filter(early), path)
    daily.refresh_days(t.scores, t.scores.filter(~early), path)
    return path


def _estimates(t):
    """Whether estimated players and quartiles of every game lie within their errors."""
    path = _days(t)
    exact = daily.distinct_players(t.spark, path).withColumnRenamed("unique_players", "exact")
    players = daily.approximate_players(t.spark, path).join(exact, "game_id").select(
        "game_id", (F.abs(F.col("unique_players") / F.col("exact") - 1) < 0.065).alias("players_near")
    )
    shares = (0.25, 0.5, 0.75)
    found = daily.approximate_quantiles(t.spark, path, shares)
    met = t.scores.join(F.broadcast(found), "game_id").groupBy("game_id").agg(  # a row a game
        *(
            ((F.avg((F.col("score") <= F.col(q)).cast("int")) >= s - 0.05)
             & (F.avg((F.col("score") < F.col(q)).cast("int")) <= s + 0.05)).alias(f"{q}_near")
            for s, q in ((s, f"q{round(100 * s)}") for s in shares)
        )
    )
    return players.join(met, "game_id")


def _published(t):
    """Write a view as a table and read it back."""
    base = scratch(t.spark, "views")
    view = views.game_popularity(t.order_scores, t.order_games)
    sinks.publish({"game_popularity": view}, base)
    return t.spark.read.parquet(f"{base}/analytics_game_popularity")


def _snapshot(t):
    """Two views published together, twice, and one read from the second version."""
    base = scratch(t.spark, "snapshots")
    for scores in (t.scores.filter(F.col("game_id") == GAME), t.scores):
        both = {
            "game_analytics": views.game_analytics(scores, t.games),
            "daily_metrics": views.daily_metrics(scores, t.users),
        }
        sinks.publish_snapshot(both, base)
    return sinks.read_snapshot(t.spark, base, "daily_metrics")


def _written_report(t):
    """A report as written: its decimals formatted, its order kept, read back as text in that order."""
    path = f"{scratch(t.spark, 'reports')}/game_performance"
    report = reports.game_performance(t.scores, t.games, AS_OF)
    sinks.write_report(report, path, "json", sinks.REPORT_ORDER["game_performance"])
    return t.spark.read.schema(sinks.formatted(report).schema).json(path)


def _rebuilt(t):
    """Rebuild the boards of games with a score of 400 or more, store them and read them back."""
    path = scratch(t.spark, "boards")
    standings.rebuild(t.scores, t.games, t.scores.filter("score >= 400"), path)
    return standings.stored_standings(t.spark, path).select("game_id", "user_id", "score")


def _stored(t):
    """The best standings, stored and read back."""
    path = scratch(t.spark, "boards")
    standings.store_standings(
        standings.best_standings(t.scores, t.games).select(*standings.STORED.names), path
    )
    return standings.stored_standings(t.spark, path)


def _live(t):
    path, check = scratch(t.spark, "standings"), scratch(t.spark, "check")
    _finish(live.start_live_standings(t.score_stream(), path, check, available_now=True))
    return path


def _indexed(t, scores=None, leaf=50):
    """Where the best standings of ``scores`` lie as an index, in small leaves."""
    path = scratch(t.spark, "index")
    board_index.store_index(standings.best_standings(t.scores if scores is None else scores, t.games), t.games, path, leaf)
    return path


def _index_behind(t):
    """A user's ranks by an index of the first half of the time and the standings since."""
    early = F.col("submitted_at") <= F.lit(MIDWAY).cast("timestamp_ntz")
    since = standings.best_standings(t.scores.filter(~early), t.games)
    return board_index.changed_rank(t.spark, _indexed(t, t.scores.filter(early)), since, t.games, USER)


def _after_clear(t):
    """Sizes of the boards left when one of them is cleared, with the session in dynamic mode."""
    path, mode = scratch(t.spark, "boards"), "spark.sql.sources.partitionOverwriteMode"
    standings.store_standings(
        standings.best_standings(t.scores, t.games).select(*standings.STORED.names), path
    )
    before = t.spark.conf.get(mode)
    t.spark.conf.set(mode, "dynamic")
    try:
        standings.clear_board(t.spark, path, GAME)
    finally:
        t.spark.conf.set(mode, before)
    return standings.board_sizes(standings.stored_standings(t.spark, path))


def _scanned(t):
    """Scores, games and users written as tables, read with their fixed schemas and counted."""
    base = scratch(t.spark, "tables")
    tables.write_scores(t.scores, f"{base}/scores")
    t.games.write.parquet(f"{base}/games")
    tables.store_users(t.users).write.parquet(f"{base}/users")
    scores = tables.scan_scores(t.spark, base)
    games, users = tables.scan_games(t.spark, base), tables.scan_users(t.spark, base)
    named = filters.with_names(tables.newest_first(scores), games, users)
    return named.groupBy("game_name", "user_email").agg(
        F.count(F.lit(1)).alias("scores"), F.max("score").alias("best_score")
    )


def _without_demo(t):
    kept, _, _ = demo.without_demo(*t.demo_tables())
    return kept.groupBy("game_id").agg(F.count(F.lit(1)).alias("scores"))


def _judged(t):
    return submissions.judged(fixtures.submissions_from_events(t.events), t.games)


def _rejected(t):
    rows = submissions.rejected(_judged(t))
    return rows.groupBy("game_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def _members(t, rule):
    """All (game, user) pairs of the users that satisfy ``rule``."""
    pairs = t.scores.select("game_id", "user_id").distinct()
    return pairs.join(t.users.filter(rule).select("user_id"), "user_id", "left_semi")


def _query_table():
    top20 = {"start": 0, "end": 19}
    return {
        # boards and ranks
        "game_board_best": lambda t: ranking.game_board(t.scores, t.games, t.users, **top20),
        "game_board_latest": lambda t: ranking.game_board(
            t.scores, t.games, t.users, kind="latest", **top20
        ),
        "game_board_as_stored": lambda t: ranking.game_board(
            t.scores, t.games, t.users, kind="latest", as_stored=True, **top20
        ),
        "game_board_page": lambda t: ranking.board_page(
            t.scores, t.games, t.users, GAME, page=2, page_size=10
        ),
        "game_board_orders": lambda t: ranking.game_board(
            t.order_scores, t.order_games, t.users, 0, 49, kind="latest"
        ),
        "full_board_ranks": lambda t: ranking.ranked_standings(
            standings.best_standings(t.order_scores, t.order_games), t.order_games
        ),
        "global_board": lambda t: ranking.global_board(t.scores, t.users),
        "global_board_page": lambda t: ranking.global_page(t.scores, t.users),
        "global_total_board": lambda t: ranking.global_total_board(t.scores, t.games, t.users),
        "user_rank": lambda t: ranking.user_rank(t.scores, t.games, USER),
        "user_global_rank": lambda t: ranking.user_global_rank(t.scores, USER),
        "surrounding_players": lambda t: ranking.surrounding_players(
            t.scores, t.games, t.users, USER
        ),
        "staff_ranks": lambda t: ranking.ranks_of(t.scores, t.games, _members(t, "is_active")),
        "staff_neighbours": lambda t: ranking.neighbours_of(
            t.scores, t.games, _members(t, "is_staff")
        ),
        "stored_board": lambda t: ranking.standing_board(
            _stored(t), t.games, t.users, 0, 19, game_id=GAME
        ),
        "stored_user_rank": lambda t: ranking.standing_rank(_stored(t), t.games, USER, GAME),
        "stored_neighbours": lambda t: ranking.standing_neighbours(
            _stored(t), t.games, t.users, USER, GAME
        ),
        "indexed_page": lambda t: board_index.indexed_page(
            t.spark, _indexed(t), t.users, GAME, page=2, page_size=10
        ),
        "indexed_rank": lambda t: board_index.indexed_rank(t.spark, _indexed(t), USER),
        "indexed_rank_behind": _index_behind,
        "indexed_neighbours": lambda t: board_index.indexed_neighbours(
            t.spark, _indexed(t, leaf=7), t.users, USER, GAME
        ),
        "live_global_board": lambda t: ranking.standing_global_board(
            live.live_totals(t.spark, _live(t)), t.users
        ),
        "board_after_clear": _after_clear,
        "board_size": lambda t: standings.board_sizes(t.scores),
        "rebuild_selected": _rebuilt,
        # submissions
        "validated_submissions": lambda t: submissions.valid(_judged(t)),
        "rejected_submissions": _rejected,
        "personal_best_flags": lambda t: submissions.personal_best_flags(t.scores, t.games),
        "personal_best_flags_orders": lambda t: submissions.personal_best_flags(
            t.order_scores, t.order_games
        ),
        "user_best": lambda t: submissions.user_best(t.scores, t.games),
        "score_history": lambda t: submissions.score_history(t.scores, t.games, USER, GAME),
        "score_history_page": lambda t: submissions.history_page(
            t.scores, t.games, USER, GAME, page=2, page_size=5
        ),
        "submission_results": lambda t: submissions.submission_results(t.scores, t.games),
        "rate_limit_excess": lambda t: submissions.rate_limit_excess(t.scores),
        "rate_limit_excess_daily": lambda t: submissions.rate_limit_excess(t.scores, 3, "day"),
        "rate_limit_excess_hourly": lambda t: submissions.rate_limit_excess(t.scores, 1, "hour"),
        "play_sessions": lambda t: submissions.play_sessions(t.scores),
        # reports
        "top_players": lambda t: reports.top_players(t.scores, t.games, t.users, AS_OF),
        "game_performance": lambda t: reports.game_performance(t.scores, t.games, AS_OF),
        "activity_trend": lambda t: reports.activity_trend(t.scores, AS_OF),
        "activity_trend_daily": lambda t: reports.activity_trend(t.scores, AS_OF, "daily", GAME),
        "activity_trend_orders": lambda t: reports.activity_trend(
            t.order_scores, ORDERS_AS_OF, "monthly"
        ),
        "score_distribution": lambda t: reports.score_distribution(t.scores, AS_OF),
        "score_distribution_orders": lambda t: reports.score_distribution(
            t.order_scores, ORDERS_AS_OF, "monthly"
        ),
        "merged_performance": lambda t: daily.merged_performance(
            t.spark, _days(t), t.games, "2024-01-03", "2024-01-20"
        ),
        "rolling_players": lambda t: daily.rolling_players(t.spark, _days(t)),
        "rolling_players_of_games": lambda t: daily.rolling_players(
            t.spark, _days(t), 30, by=("game_id",)
        ),
        "estimates_within_error": _estimates,
        "user_activity": lambda t: reports.user_activity(t.scores, t.users, AS_OF),
        "engagement_trend": lambda t: reports.engagement_trend(t.scores, AS_OF),
        "new_vs_returning": lambda t: reports.new_vs_returning(t.scores, t.users, AS_OF),
        "current_top": lambda t: reports.current_top(t.scores, t.games, t.users, GAME).select(
            "rank", "user_id", "username", "name", "score", "game_id"
        ),
        "score_progression": lambda t: reports.score_progression(
            t.scores, t.games, t.users, AS_OF, GAME
        ),
        "competition_metrics": lambda t: reports.competition_metrics(t.scores, AS_OF, GAME),
        "board_volatility": lambda t: reports.board_volatility(t.scores, t.games),
        "board_volatility_orders": lambda t: reports.board_volatility(
            t.order_scores, t.order_games
        ),
        "peak_hours": lambda t: reports.peak_hours(t.scores, AS_OF),
        "improvement_patterns": lambda t: reports.improvement_patterns(t.scores, AS_OF),
        "metadata_patterns": lambda t: reports.metadata_patterns(t.scores, AS_OF),
        "submission_frequency": lambda t: reports.submission_frequency(t.scores, AS_OF),
        # reports made in the middle of the data
        "top_players_midway": lambda t: reports.top_players(
            t.scores, t.games, t.users, MIDWAY, limit=None
        ),
        "game_performance_midway": lambda t: reports.game_performance(t.scores, t.games, MIDWAY),
        "user_activity_midway": lambda t: reports.user_activity(t.scores, t.users, MIDWAY),
        "competition_metrics_midway": lambda t: reports.competition_metrics(
            t.scores, MIDWAY, GAME
        ),
        "peak_hours_midway": lambda t: reports.peak_hours(t.scores, MIDWAY),
        "v_user_engagement_midway": lambda t: views.user_engagement(t.scores, t.users, MIDWAY),
        # views
        "v_game_analytics": lambda t: views.game_analytics(t.scores, t.games),
        "v_user_engagement": lambda t: views.user_engagement(t.scores, t.users, AS_OF),
        "v_leaderboard_trends": lambda t: views.leaderboard_trends(t.scores, t.games, t.users),
        "v_leaderboard_trends_orders": lambda t: views.leaderboard_trends(
            t.order_scores, t.order_games, t.users
        ),
        "v_scoring_patterns": lambda t: views.scoring_patterns(t.scores, t.games),
        "v_daily_metrics": lambda t: views.daily_metrics(t.scores, t.users),
        "v_daily_metrics_orders": lambda t: views.daily_metrics(t.order_scores, t.users),
        "v_user_performance": lambda t: views.user_performance(t.scores, t.games, t.users),
        "v_user_performance_orders": lambda t: views.user_performance(
            t.order_scores, t.order_games, t.users
        ),
        "v_game_popularity": lambda t: views.game_popularity(t.scores, t.games),
        "v_game_popularity_orders": lambda t: views.game_popularity(
            t.order_scores, t.order_games
        ),
        "published_game_popularity": _published,
        "published_snapshot": _snapshot,
        "written_report": _written_report,
        # lists and filters
        "scanned_tables": _scanned,
        "totals": lambda t: demo.totals(t.scores, t.games, t.users),
        "game_facets": lambda t: filters.game_facets(
            t.games.join(t.scores.filter("score >= 400"), "game_id", "left_semi")
        ),
        "visible_scores": lambda t: filters.score_facets(
            t.scores, filters.visible_games(t.games)
        ),
        "active_games": lambda t: demo.scores_per_game(t.scores, filters.active_games(t.games)),
        "own_scores": lambda t: filters.own_scores(t.scores, t.games, USER),
        "search_scores": lambda t: filters.search_scores(
            t.scores, t.games, t.users, "#00000001 VIEW"
        ).select("id", "score", "game_name", "user_email"),
        "score_facets": lambda t: filters.score_facets(t.scores, t.games),
        "date_drilldown": lambda t: filters.date_drilldown(t.scores),
        "date_drilldown_orders": lambda t: filters.date_drilldown(t.order_scores),
        "scores_with_names": lambda t: filters.with_names(t.scores, t.games, t.users).select(
            "id", "game_id", "game_name", "user_id", "user_email", "score", "submitted_at"
        ),
        "scores_this_month": lambda t: filters.facet(
            filters.submitted_when(t.scores, "this_month", AS_OF), "game_id"
        ),
        "scores_per_game": lambda t: demo.scores_per_game(t.scores, t.games),
        "without_demo": _without_demo,
        # dashboards
        "retention_cohort": lambda t: dashboards.retention_cohort(t.scores),
        "retention_cohort_orders": lambda t: dashboards.retention_cohort(t.order_scores),
        "score_histogram": lambda t: dashboards.score_histogram(t.scores, t.games),
        "difficulty_mix": lambda t: dashboards.difficulty_mix(t.scores, t.games),
        "calendar_heatmap": lambda t: dashboards.calendar_heatmap(t.scores),
        "board_heatmap": lambda t: dashboards.board_heatmap(t.scores, t.games),
        "player_segments": lambda t: dashboards.player_segments(t.scores, t.users, AS_OF),
        "segment_sizes": lambda t: dashboards.segment_sizes(
            dashboards.player_segments(t.scores, t.users, AS_OF)
        ),
        "competition_intensity": lambda t: dashboards.competition_intensity(t.scores, t.games),
        "segment_transitions": lambda t: dashboards.segment_transitions(t.scores),
        "engagement_funnel": lambda t: dashboards.engagement_funnel(t.scores, t.users),
        # streams
        "stream_live_standings": _live_standings,
        "stream_keyed_standings": _keyed_standings,
        "stream_answers": _answers,
        "stream_pipeline": lambda t: _pipeline(t, False),
        "stream_pipeline_rejects": lambda t: _pipeline(t, True),
        "stream_live_activity": lambda t: _stored_stream(
            t, activity.live_activity(t.score_stream())
        ),
        "stream_live_sessions": lambda t: _stored_stream(
            t, activity.live_sessions(t.score_stream())
        ),
        "stream_accepted": lambda t: _intake(t, True),
        "stream_rejected": lambda t: _intake(t, False),
        "stream_distinct_ids": _distinct_ids,
        "stream_unique_ids": _unique_ids,
        "stream_corrected_board": lambda t: _corrected(t, "best"),
        "stream_corrected_latest": lambda t: _corrected(t, "latest"),
        "stream_busy_hours": lambda t: _stored_stream(
            t, intake.busy_minutes(t.score_stream(), limit=1, width="1 hour")
        ),
    }


def _bind(query):
    return lambda spark, sf_dir: _tidy(query(Tables(spark, sf_dir)))


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of all but the llm subpackage."""
    return {name: _bind(query) for name, query in _query_table().items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql(USER, GAME) | (llm.oracle_sql() if llm else {})


def entry(spark: SparkSession) -> DataFrame:
    """Top 20 of every game's board by best score."""
    return queries()["game_board_best"](spark, SMOKE_DIR)
