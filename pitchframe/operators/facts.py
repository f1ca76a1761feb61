"""Recorded facts that may be told, the prediction of one named ball, and ledgers of calls against what happened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import COUNTS, EVIDENCE_TIER, LABELS, PROBS, conceded, outcome, overs_notation, phase_legal, ratio, summed, tier, timeline_key, top_label, total
from .evaluate import READ, judged
from .evidence import CHRONOLOGY, CONTEXTS
from .models import hierarchical
from .state import with_state

IDENTITY = ("season_id", "match_id", "innings", "over_number", "ball_number")
#: Fixed value: the only status of a fact that may be told.
VERIFIED = "verified"


def is_verified(status: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(status))) == VERIFIED, F.lit(False))


def player_facts(knowledge: DataFrame, *attributes: str) -> DataFrame:
    """(player, attribute, value, told) of each record (player, status, attributes): the value only if the record is verified and it is not
    blank. A fact of a record that is not verified is listed without its value."""
    rows = knowledge.select("player", is_verified("status").alias("v"), *(F.col(a).cast("string") for a in attributes))
    rows = rows.unpivot(["player", "v"], list(attributes), "attribute", "value")
    told = F.col("v") & (F.coalesce(F.trim("value"), F.lit("")) != "")
    return rows.select("player", "attribute", F.when(told, F.col("value")).alias("value"), told.cast("int").alias("told"))


def team_season(records: DataFrame, *fields: str) -> DataFrame:
    """Of each team and season the record (team, season_id, id, status, retrieved_at, fields) retrieved last, the larger id of equals, if
    that one is verified; an older verified record does not stand in for it."""
    newest = F.max_by(F.struct("status", *fields), F.struct(F.coalesce(F.col("retrieved_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), "id"))
    rows = records.groupBy("team", "season_id").agg(newest.alias("r"))
    return rows.select("team", "season_id", "r.*").where(is_verified("status")).drop("status")


def predict_ball(balls: DataFrame, **identity: int) -> DataFrame:
    """The three base models' probabilities of one ball, named by IDENTITY, from all balls before it; no row if there is none.

    The ball's keys go to all tasks, which count the earlier balls of each context; nothing is ordered or shuffled but counts.
    """
    here = reduce(lambda a, c: a & (F.col(c) == identity[c]), IDENTITY, F.lit(True))
    keys = list(dict.fromkeys(k for c in READ for k in CONTEXTS[c] if k != "legal_phase"))
    innings = with_state(balls.where(reduce(lambda a, c: a & (F.col(c) == identity[c]), IDENTITY[:3], F.lit(True))))
    target = innings.where(here).withColumns({"legal_phase": phase_legal(), "label": outcome()}).orderBy("source_row_number").limit(1)
    target = target.select(*(F.col(c).alias(f"t_{c}") for c in (*CHRONOLOGY, *keys, "legal_phase", "label")))
    # Phases of earlier balls need their own innings' state; seasons after the ball's are not read.
    past = with_state(balls.where(F.col("season_id") <= identity["season_id"])).withColumns({"legal_phase": phase_legal(), "label": outcome()})
    place = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in CHRONOLOGY))
    met = past.select(*CHRONOLOGY, *keys, "legal_phase", "label").crossJoin(F.broadcast(target)).where(place("") < place("t_"))  # one row
    same = {c: reduce(lambda a, k: a & (F.col(k) == F.col(f"t_{k}")), CONTEXTS[c], F.lit(True)) for c in READ}
    counted = met.agg(*(F.count(F.when(same[c] & (F.col("label") == x), 1)).alias(f"{c}_{n}") for c in READ for x, n in zip(LABELS, COUNTS, strict=True)))
    one = target.select(*(F.col(f"t_{c}").alias(c) for c in (*CHRONOLOGY, "legal_phase", "label"))).crossJoin(F.broadcast(counted))
    return judged(hierarchical(one))


def replay_report(rows: DataFrame) -> DataFrame:
    """By innings of a replay (``trace``): predictions of the hierarchical model, right and wrong ones, and how often each outcome and phase came."""
    top = top_label([F.col(f"hierarchical_{p}") for p in PROBS])
    phases = [F.count(F.when(F.col("legal_phase") == p, 1)).alias(f"in_{p}") for p in ("powerplay", "middle", "death")]
    outcomes = [F.count(F.when(F.col("actual") == x, 1)).alias(c) for x, c in zip(LABELS, COUNTS, strict=True)]
    right = (top == F.col("actual")).cast("int")
    got = rows.groupBy("season_id", "match_id", "innings").agg(F.count("*").alias("predictions"), summed(right, "correct"), summed(1 - right, "incorrect"), *outcomes, *phases)
    return got.withColumn("accuracy", F.round(ratio("correct", "predictions"), 6))


def ledger_accuracy(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """By innings of a replay (``trace``): outcomes revealed, and how many of them the user's ``calls`` (CHRONOLOGY, call) and the model had right.
    A ball without a call is one that the user missed."""
    top = top_label([F.col(f"hierarchical_{p}") for p in PROBS])
    both = rows.select(*CHRONOLOGY, "actual", top.alias("top")).join(calls, list(CHRONOLOGY), "left")
    got = both.groupBy("season_id", "match_id", "innings").agg(
        F.count("*").alias("revealed"), F.count("call").alias("called"), total(F.col("call") == F.col("actual"), "user_correct"), total(F.col("top") == F.col("actual"), "model_correct")
    )
    return got.withColumns({"user_accuracy": ratio("user_correct", "revealed"), "model_accuracy": ratio("model_correct", "revealed")})


def same_again(balls: DataFrame) -> DataFrame:
    """A call for every ball but the first of its innings: that the ball before comes again."""
    w = Window.partitionBy(*IDENTITY[:3]).orderBy(*CHRONOLOGY[3:])
    return balls.withColumn("call", F.lag(outcome()).over(w)).where("call IS NOT NULL").select(*CHRONOLOGY, "call")


def verified_coverage(covered: DataFrame, gates: DataFrame) -> DataFrame:
    """By season: whether its statistics may be told, and why not. A season that has a gate is trusted by it, else by complete coverage."""
    rows = covered.select("season_id", "coverage").join(gates.select("season_id", "gate"), "season_id", "full")
    # The gates that pass.
    passes = F.col("gate").isin("PASS", "PASS_WITH_DEFINITION_NOTE", "UNAVAILABLE")
    trusted = F.coalesce(passes, F.col("coverage") == "complete", F.lit(False))
    why = F.when(trusted, "ok").when(F.col("gate").isNotNull(), F.lower("gate")).when(F.col("coverage").isNull(), "coverage_not_recorded").otherwise("coverage_incomplete")
    return rows.select("season_id", trusted.cast("int").alias("trusted"), why.alias("reason"))


def told(answers: DataFrame, trust: DataFrame) -> DataFrame:
    """``answers`` of seasons whose statistics may be told (``verified_coverage``); seasons without a record may not."""
    return answers.join(trust.where("trusted = 1").select("season_id"), "season_id", "left_semi")


def timeline(balls: DataFrame) -> DataFrame:
    """Each ball's key, whose order as text is the order of play, and the overs bowled up to it in cricket's notation."""
    legal = F.sum("legal_ball").over(Window.partitionBy(*IDENTITY[:3]).orderBy(*CHRONOLOGY[3:]).rowsBetween(Window.unboundedPreceding, 0))
    return balls.select(*CHRONOLOGY, timeline_key().alias("timeline_key"), overs_notation(legal).alias("overs"))


def matchup_evidence(balls: DataFrame) -> DataFrame:
    """By batter and bowler: balls, rates that are null where nothing divides, and how strong the evidence is."""
    faced = F.sum(1 - F.col("is_wide_ball"))
    out = F.sum(F.when((F.col("is_wicket") == 1) & (F.col("player_out") == F.col("batter")), 1).otherwise(0))
    rows = balls.groupBy("batter", "bowler").agg(faced.cast("bigint").alias("balls"), summed("batter_runs", "runs"), out.cast("bigint").alias("outs"), F.sum(conceded()).cast("bigint").alias("conceded"))
    rate = lambda a, b, by: F.floor(F.col(a) * float(by) / F.nullif(F.col(b), F.lit(0)) * 100.0 + 0.5) / 100.0
    return rows.withColumns({"strike_rate": rate("runs", "balls", 100), "average": rate("runs", "outs", 1), "evidence": tier("balls", *EVIDENCE_TIER)})
