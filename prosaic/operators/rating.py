"""Paired rating: Swiss rounds with Elo updates. A round is set-based, since each player plays at most once in it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosaic.operators.ranking import global_rank
from prosaic.sources.tables import saved

# Fixed values.
START, K, SCALE, ROUNDS = 1500.0, 32.0, 400.0, 4


def expected(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / SCALE))


def pairings(players: DataFrame) -> DataFrame:
    """a, b with their ratings: players (player, seed, elo) ranked by rating, then seed, and paired by neighbouring ranks; an odd last one rests.

    Ranks come from a range exchange and one count per partition, not from one
    window over all players.
    """
    ranked = global_rank(players.select("player", "seed", "elo"), [F.desc("elo"), F.asc("seed")], "rank")
    pair = F.floor((F.col("rank") - 1) / 2)
    side = lambda p: F.max(F.when(F.col("rank") % 2 == p, F.struct("player", "elo")))
    grouped = ranked.groupBy(pair.alias("pair")).agg(side(1).alias("a"), side(0).alias("b")).filter("a is not null and b is not null")
    return grouped.select("pair", F.col("a.player").alias("a"), F.col("b.player").alias("b"), F.col("a.elo").alias("elo_a"), F.col("b.elo").alias("elo_b"))


def winner_of(answer: Column, a: Column, b: Column) -> Column:
    """'A', 'B' or a player's number; null for anything else, which is a matchup that failed."""
    return F.when(answer == "A", a).when(answer == "B", b).otherwise(answer.try_cast("bigint"))


def update(players: DataFrame, matchups: DataFrame) -> DataFrame:
    """players after a round of matchups (a, b, elo_a, elo_b, winner); matchups with a null winner don't count."""
    played = matchups.filter("winner is not null")
    won = F.when(F.col("winner") == F.col("a"), 1.0).otherwise(0.0)
    gain = K * (won - expected(F.col("elo_a"), F.col("elo_b")))
    gain_b = K * ((1 - won) - (1 - expected(F.col("elo_a"), F.col("elo_b"))))
    changes = played.select(F.explode(F.array(F.struct(F.col("a").alias("player"), gain.alias("gain")), F.struct(F.col("b").alias("player"), gain_b.alias("gain")))).alias("x")).select("x.*")
    return players.join(changes, "player", "left").select("player", "seed", (F.col("elo") + F.coalesce("gain", F.lit(0.0))).alias("elo"))


def tournament(players: DataFrame, judge: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, save: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Final ratings (player, seed, elo) and all matchups (round, a, b, winner).

    players has player and seed; judge adds winner to pairings. save writes a
    round's table and reads it again, so that plans don't grow from round to
    round; it gets the table and a name. The sum of ratings never changes.
    """
    save = save or saved
    now, played = players.select("player", "seed", F.lit(START).alias("elo")), []
    for n in range(1, rounds + 1):
        judged = save(judge(pairings(now)), f"round{n}")
        played.append(judged.select(F.lit(n).alias("round"), "a", "b", "winner"))
        now = save(update(now, judged), f"elo{n}")
    return now, reduce(DataFrame.unionByName, played)


def ranking(ratings: DataFrame) -> DataFrame:
    """ratings with rank, by rating and then seed."""
    return global_rank(ratings, [F.desc("elo"), F.asc("seed")], "rank")


