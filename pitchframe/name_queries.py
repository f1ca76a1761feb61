"""Queries on misspelt names and on names in free text; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry as R
from .operators import identity as N
from .operators import mentions as M
from .operators import similar as X
from .sources.adapter import DELIVERIES_SQL, META_SQL, deliveries, match_meta

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- misspelt names: the first two words of every document as names, and each of them with two slips ---------------------
def two_words(texts: DataFrame) -> DataFrame:
    """(f, l): the first two words of each text of two words or more, as ``norm`` has them; the words after them are not looked for."""
    found = F.regexp_extract(F.lower("text"), "^[^a-z0-9]*+[a-z0-9]++[^a-z0-9]++[a-z0-9]++", 0)
    # By a generator a text is searched once, however many columns and conditions follow.
    words = texts.select(F.explode(F.filter(F.array(found), lambda x: x != "")).alias("w")).select(F.split(N.norm(F.col("w")), " ").alias("w"))
    return words.select(F.get("w", F.lit(0)).alias("f"), F.get("w", F.lit(1)).alias("l")).distinct()


def resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nine branches of the plan read the names, each of which would search all texts; names are small and take long.
    names = two_words(_table(spark, sf_dir, "documents")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).persist()
    slip = "concat(substring(f, 2, 1), substring(f, 1, 1), substring(f, 3), ' ', substring(l, 1, length(l) div 2), substring(l, length(l) div 2 + 2))"
    asked = names.where("length(l) > 1").select(F.expr(slip).alias("query")).distinct()
    players = names.select(F.concat_ws(" ", "f", "l").alias("player"))
    return X.told(X.fuzzy(asked, players), asked)


def _blocks_sql(name: str, pairs: str) -> str:
    """CTEs up to ``name`` (a, b, ratio): a box of both words has its longest common run, the earliest of equals, and boxes left and right of it."""
    return f"""
{name}_runs AS MATERIALIZED (
  SELECT a, b, i, j, max(i) OVER (PARTITION BY a, b, i - j, island) - i + 1 AS m FROM (
    SELECT a, b, i, j, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM {pairs}, range(30) r(i), range(30) s(j)
    WHERE i < length(a) AND j < length(b) AND substr(a, i + 1, 1) = substr(b, j + 1, 1))),
{name}_boxes AS (
  SELECT a, b, 0::BIGINT AS a0, length(a) AS a1, 0::BIGINT AS b0, length(b) AS b1, 0::BIGINT AS n FROM {pairs}
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN a0 ELSE best.i + best.m END, CASE side WHEN 0 THEN best.i ELSE a1 END,
    CASE side WHEN 0 THEN b0 ELSE best.j + best.m END, CASE side WHEN 0 THEN best.j ELSE b1 END, CASE side WHEN 0 THEN best.m ELSE 0 END
  FROM (
    SELECT x.a, x.b, a0, a1, b0, b1, arg_min({{'i': i, 'j': j, 'm': least(m, a1 - i, b1 - j)}}, (-least(m, a1 - i, b1 - j), i, j)) AS best
    FROM {name}_boxes x JOIN {name}_runs y ON x.a = y.a AND x.b = y.b AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY ALL), range(2) t(side)),
{name} AS (SELECT a, b, 2.0::DOUBLE * sum(n) / (length(a) + length(b)) AS ratio FROM {name}_boxes GROUP BY a, b)"""


FUZZY_SQL = f"""
WITH RECURSIVE names AS MATERIALIZED (
  SELECT DISTINCT w[1] AS f, w[2] AS l FROM (SELECT string_split({_NORM.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 2),
asked AS MATERIALIZED (
  SELECT DISTINCT substr(f, 2, 1) || substr(f, 1, 1) || substr(f, 3) AS f, substr(l, 1, length(l) // 2) || substr(l, length(l) // 2 + 2) AS l FROM names WHERE length(l) > 1),
last_pairs AS MATERIALIZED (
  SELECT DISTINCT x.l AS a, y.l AS b FROM asked x JOIN names y ON 2.0 * least(length(x.l), length(y.l)) >= 0.82 * (length(x.l) + length(y.l)) WHERE x.l <> '' AND y.l <> ''),
{_blocks_sql('lasts', 'last_pairs')},
met AS MATERIALIZED (SELECT x.f || ' ' || x.l AS query, y.f || ' ' || y.l AS player, x.f AS f, y.f AS g, ratio FROM asked x JOIN lasts ON a = x.l JOIN names y ON b = y.l WHERE ratio >= 0.82),
first_pairs AS MATERIALIZED (SELECT DISTINCT f AS a, g AS b FROM met WHERE length(g) > 1),
{_blocks_sql('firsts', 'first_pairs')},
scored AS (
  SELECT query, player, ratio * 80 + first * 20 AS score FROM (
    SELECT query, player, m.ratio, CASE WHEN length(g) = 1 THEN (g = substr(f, 1, 1))::INT::DOUBLE ELSE r.ratio END AS first FROM met m LEFT JOIN firsts r ON a = f AND b = g)
  WHERE first >= 0.34),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, player) AS k FROM scored),
best AS (
  SELECT query, max(score) FILTER (k = 1) AS top, max(score) FILTER (k = 2) AS second, max(player) FILTER (k = 1) AS first, string_agg(player, '|' ORDER BY k) FILTER (k <= 8) AS candidates
  FROM ranked GROUP BY query)
SELECT f || ' ' || l AS query, CASE WHEN second IS NULL OR top >= second + 16 THEN first END AS player, candidates FROM asked LEFT JOIN best ON query = f || ' ' || l
"""
R.QUERIES["q_resolve_fuzzy"], R.ORACLES["q_resolve_fuzzy"] = resolve_fuzzy, FUZZY_SQL


# --- names in free text: questions made of every match and every pair of players ------------------------------------------
def _displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, display, region): the teams of the deliveries by the nation of their number."""
    nations, regions = (_table(spark, sf_dir, t) for t in ("nation", "region"))
    return nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.concat(F.lit("Team"), "n_nationkey").alias("team"), F.col("n_name").alias("display"), F.col("r_name").alias("region"))


def team_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _displays(spark, sf_dir)
    index = M.team_aliases(shown, shown.select(F.col("region").alias("alias"), F.col("team").alias("name")))
    games = match_meta(deliveries(spark, sf_dir)).join(shown, F.col("team_a") == F.col("team"))
    forms = F.array(
        F.concat(F.lit("How did "), "team_a", F.lit(" do against "), "team_b", F.lit(" in match "), F.col("match_id").cast("string"), F.lit("?")),
        F.concat(F.lit("Did "), F.regexp_replace("display", "_", " - "), F.lit(" win "), F.col("match_id").cast("string"), F.lit(", and "), F.lower("display"), F.lit("?")),
        F.concat(F.regexp_replace("display", "^(.)[^_]*_", "$1"), F.lit(" in "), F.col("match_id").cast("string")),
        F.concat(F.lit("best side of "), "region", F.lit(" in "), F.col("match_id").cast("string")),
    )
    return M.teams_named(games.select(F.explode(forms).alias("query")), index)


def player_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls = deliveries(spark, sf_dir)
    players = balls.select("batter").union(balls.select("bowler")).toDF("player").distinct()
    # Numbers are words of their own in aliases, so that a number may name a batter and a bowler.
    apart = F.concat_ws(" ", F.regexp_extract("player", "^[A-Za-z]+", 0), F.regexp_extract("player", "[0-9]+$", 0))
    forms = F.array(F.col("player"), apart, F.regexp_extract("player", "[0-9]+$", 0))
    index = players.select(F.explode(forms).alias("alias"), "player")
    pairs = balls.select("batter", "bowler").distinct()
    number = F.regexp_extract("bowler", "[0-9]+$", 0)
    asked = F.array(
        F.concat("batter", F.lit("'s runs against "), "bowler"), F.concat(F.lit("bat "), F.regexp_extract("batter", "[0-9]+$", 0), F.lit(" or bowler "), number),
        F.concat(F.lit("who bowled "), number, F.lit("?")), F.lit("Batman's runs"),
    )
    from .operators.aggregates import player_activity

    return M.players_named(pairs.select(F.explode(asked).alias("query")), index, player_activity(balls))


def _mentions_sql() -> str:
    """CTEs from words of questions (asked) and forms (form, names) up to mentions: matches in order, each kept if it overlaps none kept."""
    return f"""
spoken AS MATERIALIZED (SELECT DISTINCT query, string_split({_NORM.format('query')}, ' ') AS w FROM asked),
found AS MATERIALIZED (
  SELECT query, i, n AS width, form, names, row_number() OVER (PARTITION BY query ORDER BY n DESC, i) AS k
  FROM (SELECT query, i, n, array_to_string(w[i : i + n - 1], ' ') AS form FROM spoken, range(1, 40) r(i), range(1, 6) s(n) WHERE i + n - 1 <= len(w)) JOIN forms USING (form)),
steps AS (
  SELECT query, 0::BIGINT AS k, []::BIGINT[] AS covered, false AS stays FROM spoken
  UNION ALL
  SELECT s.query, f.k, CASE WHEN len(list_intersect(covered, range(i, i + width))) = 0 THEN list_concat(covered, range(i, i + width)) ELSE covered END,
    len(list_intersect(covered, range(i, i + width))) = 0 FROM steps s JOIN found f ON f.query = s.query AND f.k = s.k + 1),
mentions AS (SELECT f.* FROM found f JOIN steps s ON s.query = f.query AND s.k = f.k WHERE stays)"""


TEAM_MENTIONS_SQL = (DELIVERIES_SQL + META_SQL).replace("WITH base", "WITH RECURSIVE base", 1) + f""",
shown AS (SELECT 'Team' || n_nationkey AS team, n_name AS display, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
forms AS (
  SELECT form, list(DISTINCT team ORDER BY team) AS names FROM (
    SELECT {_NORM.format('team')} AS form, team FROM shown UNION SELECT {_NORM.format('display')}, team FROM shown UNION SELECT {_NORM.format('region')}, team FROM shown
    UNION SELECT regexp_replace({_NORM.format('display')}, '^(.)[^ ]* (.).*$', '\\1\\2'), team FROM shown) GROUP BY form),
games AS (SELECT * FROM meta JOIN shown ON team_a = team),
asked AS (
  SELECT unnest(['How did ' || team_a || ' do against ' || team_b || ' in match ' || match_id || '?', 'Did ' || replace(display, '_', ' - ') || ' win ' || match_id || ', and ' || lower(display) || '?',
    regexp_replace(display, '^(.)[^_]*_', '\\1') || ' in ' || match_id, 'best side of ' || region || ' in ' || match_id]) AS query FROM games),
{_mentions_sql()},
named AS (SELECT query, list_sort(list_distinct(flatten(list(names)))) AS names, count(*) AS mentions FROM mentions GROUP BY query)
SELECT query, CASE WHEN len(names) = 1 THEN names[1] END AS team, array_to_string(names[1:6], '|') AS candidates, coalesce(mentions, 0)::BIGINT AS mentions FROM (SELECT DISTINCT query FROM asked) LEFT JOIN named USING (query)
"""
R.QUERIES["q_team_mentions"], R.ORACLES["q_team_mentions"] = team_mentions, TEAM_MENTIONS_SQL

PLAYER_MENTIONS_SQL = DELIVERIES_SQL.replace("WITH base", "WITH RECURSIVE base", 1) + f""",
faced AS (SELECT batter AS player, count(*) AS n FROM balls GROUP BY 1 UNION ALL SELECT bowler, count(*) FROM balls GROUP BY 1),
activity AS (SELECT player, sum(n)::BIGINT AS n FROM faced GROUP BY 1),
forms AS (
  SELECT form, list(DISTINCT player ORDER BY player) AS names FROM (
    SELECT lower(player) AS form, player FROM activity UNION SELECT regexp_replace(lower(player), '^([a-z]+)([0-9]+)$', '\\1 \\2'), player FROM activity
    UNION SELECT regexp_extract(player, '[0-9]+$'), player FROM activity) GROUP BY form),
pairs AS (SELECT DISTINCT batter, bowler, regexp_extract(batter, '[0-9]+$') AS x, regexp_extract(bowler, '[0-9]+$') AS y FROM balls),
asked AS (SELECT unnest([batter || '''s runs against ' || bowler, 'bat ' || x || ' or bowler ' || y, 'who bowled ' || y || '?', 'Batman''s runs']) AS query FROM pairs),
{_mentions_sql()},
told AS (
  SELECT query, i::INT AS i, form, names, list_filter(names, lambda p: i > 1 AND lower(p)[1] = w[i - 1][1]) AS fits FROM mentions JOIN spoken USING (query)),
lead AS (
  SELECT lower(player)[1] AS initial, max(n) AS best, arg_max(player, (n, player)) AS player, list(n ORDER BY n DESC)[2] AS next, array_to_string(list(player ORDER BY n DESC, player)[1:6], '|') AS candidates
  FROM activity GROUP BY 1)
SELECT query, i, form, CASE WHEN len(names) = 1 THEN names[1] WHEN len(fits) = 1 THEN fits[1] END AS player, array_to_string(names[1:6], '|') AS candidates FROM told
UNION ALL
SELECT query, 0, owner, player, candidates FROM (SELECT DISTINCT query, lower(regexp_extract(query, '\\b([A-Za-z]{{4,}})''s\\b', 1)) AS owner FROM asked WHERE query NOT IN (SELECT query FROM mentions)) JOIN lead ON initial = owner[1]
WHERE best >= 500 AND best >= 2 * next
"""
R.QUERIES["q_player_mentions"], R.ORACLES["q_player_mentions"] = player_mentions, PLAYER_MENTIONS_SQL
