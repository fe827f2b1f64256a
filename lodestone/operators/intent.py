"""Sports intent from words of a query, and flat tables from nested service responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FIXTURE_WORDS, H2H_WORDS, LEAGUES, LIVE_WORDS, STANDINGS_WORDS, TEAMS

FIXTURES_SCHEMA = "response array<struct<fixture: struct<id: bigint, date: string, venue: struct<name: string>, status: struct<short: string, elapsed: int>>, league: struct<name: string, round: string>, teams: struct<home: struct<name: string>, away: struct<name: string>>, goals: struct<home: int, away: int>>>"
STANDINGS_SCHEMA = "response array<struct<league: struct<standings: array<array<struct<rank: int, team: struct<name: string>, all: struct<played: int, win: int, draw: int, lose: int, goals: struct<`for`: int, against: int>>, goalsDiff: int, points: int, form: string>>>>>>"


def _longest(query: Column, names: dict[str, int]) -> Column:
    """The longest name that the query holds, the earlier of equal lengths; null if none."""
    ordered = F.array(*(F.lit(n) for n in sorted(names, key=lambda n: -len(n))))
    return F.get(F.filter(ordered, lambda n: query.contains(n)), F.lit(0))


def _any(query: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | query.contains(w)
    return out


def detected(queries: DataFrame) -> DataFrame:
    """query, action, team_id, league_id, matched_name; action null: no sports query."""
    q = F.trim(F.lower("query"))
    ids = lambda names: F.create_map(*(x for n, i in names.items() for x in (F.lit(n), F.lit(i))))
    found = queries.withColumns({"q": q, "team": _longest(q, TEAMS), "league": _longest(q, LEAGUES)})
    found = found.withColumns({"team_id": F.element_at(ids(TEAMS), F.col("team")), "league_id": F.element_at(ids(LEAGUES), F.col("league")), "n": F.size(F.split("q", r"\s+"))})
    has_team, has_league = F.col("team").isNotNull(), F.col("league").isNotNull()
    action = (
        F.when(_any(F.col("q"), LIVE_WORDS), "live").when(_any(F.col("q"), STANDINGS_WORDS) & has_league, "standings").when(_any(F.col("q"), H2H_WORDS) & has_team, "h2h")
        .when(_any(F.col("q"), FIXTURE_WORDS) & (has_team | has_league), "upcoming").when(has_team & (F.col("n") <= 2) & F.col("q").isin(list(TEAMS)), "upcoming")
        .when(has_league & (F.col("n") <= 3) & F.col("q").isin(list(LEAGUES)), "standings")
    )
    return found.select("query", action.alias("action"), "team_id", "league_id", F.coalesce("team", "league", F.lit("")).alias("matched_name"))


def fixtures(responses: DataFrame) -> DataFrame:
    """One row per match from (json): upcoming, league, live and head-to-head responses share this form."""
    f = responses.select(F.explode(F.from_json("json", FIXTURES_SCHEMA)["response"]).alias("f"))
    text = lambda path: F.coalesce(F.col(path), F.lit(""))
    return f.select(
        F.col("f.fixture.id").alias("id"), F.col("f.fixture.date").alias("date"), text("f.fixture.venue.name").alias("venue"), F.coalesce("f.fixture.status.short", F.lit("NS")).alias("status"),
        F.col("f.fixture.status.elapsed").alias("elapsed"), text("f.league.name").alias("league"), text("f.league.round").alias("round"), text("f.teams.home.name").alias("home_team"),
        text("f.teams.away.name").alias("away_team"), F.col("f.goals.home").alias("score_home"), F.col("f.goals.away").alias("score_away"),
    )


def standings(responses: DataFrame) -> DataFrame:
    """One row per team from (json): leagues hold groups, groups hold teams."""
    groups = responses.select(F.explode(F.from_json("json", STANDINGS_SCHEMA)["response"]).alias("l")).select(F.explode("l.league.standings").alias("g"))
    t = groups.select(F.explode("g").alias("t"))
    zero = lambda path: F.coalesce(F.col(path), F.lit(0))
    return t.select(
        F.col("t.rank").alias("rank"), F.coalesce("t.team.name", F.lit("")).alias("team"), zero("t.all.played").alias("played"), zero("t.all.win").alias("won"), zero("t.all.draw").alias("drawn"),
        zero("t.all.lose").alias("lost"), zero("t.all.goals.for").alias("gf"), zero("t.all.goals.against").alias("ga"), zero("t.goalsDiff").alias("gd"), zero("t.points").alias("points"), F.coalesce("t.form", F.lit("")).alias("form"),
    )
