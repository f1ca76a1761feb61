"""Chat formatting by quotation linking.

Messages quote earlier ones with ``>`` marks, nested once for each level. Every quoted passage (a run of lines of one
level) and every line of it is normalised and hashed; the same is done with the words a message adds itself, whole,
by paragraph and by line. Joining the hashes inside a conversation gives, for each passage, the first message that
said it. A message answers the message that most characters of its outermost quotes come from; without a quote that
is found, the message one turn before it, if there is one. Following quotes back gives the thread a message
belongs to, and ordering by thread and turn puts every answer behind what it answers.

Only hashes and turns are shuffled, keyed by conversation and hash, and a passage's candidates are reduced to the
first message before the join, so neither a long conversation nor a much-repeated line multiplies rows.
DataFrame functions only.

Defined results: null text is an empty message; a message of quotes alone keeps an empty text; rows with a null
conv_id or turn are dropped; of rows with equal (conv_id, turn) each is kept, and links go to the turn; quotes of text that
nobody said stay unlinked and are still removed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

MARKS = r"^[ \t]*(>[ \t>]*)"
ATTRIBUTION = r"(?i)^[ \t]*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t\r]*\z"


def normal(text: Column) -> Column:
    """Lower case, quote marks and edge punctuation dropped, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (its own words) and lines: array of (level, body) for each line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("body"))

    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "role", F.transform(lines, line).alias("lines")
    )
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~(quoted & x["body"].rlike(ATTRIBUTION)))
    text = F.array_join(F.transform(own, lambda x: x["body"]), "\n")
    text = F.when(quoted, F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))).otherwise(text)
    return rows.select("conv_id", "turn", "role", text.alias("text"), "lines", quoted.alias("quoted"))


def _units(whole: Column, pieces: Column) -> Column:
    """The distinct normalised forms of a passage and of its pieces, as (hash, characters)."""
    forms = F.array_distinct(F.transform(F.concat(F.array(whole), pieces), normal))
    forms = F.filter(forms, lambda x: x != "")
    return F.transform(forms, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("chars")))


def said(messages: DataFrame) -> DataFrame:
    """(conv_id, hash, turn): the first message that says each whole text, paragraph or line."""
    pieces = F.concat(F.split("text", "\n[ \t]*\n"), F.split("text", "\n"))
    units = messages.select("conv_id", "turn", F.explode(_units(F.col("text"), pieces)).alias("u"))
    return units.groupBy("conv_id", F.col("u.hash").alias("hash")).agg(F.min("turn").alias("origin"))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, hash, chars, whole): units of each run of quoted lines of one level."""
    lines = F.filter("lines", lambda x: (x["level"] == 0) | (F.trim(x["body"]) != ""))

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is worked out once, however often it is named."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def cut(rows: Column) -> Column:
        """Runs of lines of one level, by the places where the level changes."""
        first = lambda i: (i == 0) | (F.get(rows, i)["level"] != F.get(rows, i - 1)["level"])
        starts = F.when(F.size(rows) > 0, F.filter(F.sequence(F.lit(0), F.size(rows) - 1), first)).otherwise(F.array().cast("array<int>"))

        def between(at: Column) -> Column:
            bodies = lambda i, k: F.transform(F.slice(rows, i + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - i), lambda x: x["body"])
            return F.transform(at, lambda i, k: F.struct(F.get(rows, i)["level"].alias("level"), bodies(i, k).alias("lines")))

        return bound(starts, between)

    runs = bound(lines, cut)
    found = messages.where("quoted").select("conv_id", "turn", F.posexplode(runs).alias("passage", "run"))
    found = found.where("run.level > 0").select(
        "conv_id", "turn", "passage", "run.level", _units(F.array_join("run.lines", " "), F.col("run.lines")).alias("units")
    )
    return found.select("conv_id", "turn", "passage", "level", F.posexplode("units").alias("unit", "u")).select(
        "conv_id", "turn", "passage", "level", "u.hash", "u.chars", (F.col("unit") == 0).alias("whole")
    )


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, origin, chars): the earlier message each quoted passage is from, if found.

    The whole passage decides where it is found; otherwise its lines do, by the characters they bring together.
    """
    units = passages(messages).join(said(messages), ["conv_id", "hash"]).where("origin < turn")
    votes = units.groupBy("conv_id", "turn", "passage", "level", "origin").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("chars")
    )
    best = votes.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("whole", "chars", "origin")).alias("best"))
    return best.select("conv_id", "turn", "passage", "level", "best.origin", "best.chars")


def threads(replies: DataFrame, rounds: int = 40) -> DataFrame:
    """(conv_id, turn, thread, depth) from (conv_id, turn, origin), by doubling the way back in each round."""
    state = written(replies.select("conv_id", "turn", F.col("origin").alias("thread"), F.lit(1).alias("depth")), "threads")
    for _ in range(rounds):
        back = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        on = state.join(back, ["conv_id", "thread"], "left")
        if on.where("next IS NOT NULL").isEmpty():
            return state
        state = written(
            on.select(
                "conv_id", "turn", F.coalesce("next", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "threads",
        )
    raise RuntimeError(f"threads are longer than 2**{rounds} answers")


def conversations(messages: DataFrame, template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """One row per message: conv_id, thread, turn, depth, reply_to, role, text, quotes, linked, formatted.

    Ordered by (conv_id, thread, turn): each answer stands behind what it answers.
    """
    rows = parsed(messages)
    found = links(rows)
    outer = found.where("level = 1").groupBy("conv_id", "turn", "origin").agg(F.sum("chars").alias("chars"))
    reply = outer.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct("chars", "origin")).alias("origin"))
    reply = written(reply, "replies")
    counts = found.groupBy("conv_id", "turn").agg(F.count("*").alias("linked"))
    quotes = passages(rows).where("whole").groupBy("conv_id", "turn").agg(F.count("*").alias("quotes"))
    turns = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before")).distinct()
    keys = ["conv_id", "turn"]
    out = rows.join(reply, keys, "left").join(threads(reply), keys, "left").join(counts, keys, "left")
    out = out.join(quotes, keys, "left").join(turns, keys, "left")
    formatted, role = F.lit(template), F.coalesce("role", F.lit(""))
    formatted = F.replace(F.replace(formatted, F.lit("{role}"), role), F.lit("{text}"), F.col("text"))
    return out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("origin", "before").alias("reply_to"), "role", "text",
        F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"),
        formatted.alias("formatted"),
    ).orderBy("conv_id", "thread", "turn")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


#: Passages are linked by their normalised text, which the operator hashes.
CHAT_SQL = r"""
WITH RECURSIVE messages AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
marked AS (
  SELECT id, conv_id, turn, i, parts[i] AS x,
    length(regexp_replace(regexp_extract(parts[i], '^[ \t]*(>[ \t>]*)', 1), '[^>]', '', 'g')) AS level
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM messages)
),
lines AS (
  SELECT id, conv_id, turn, i, level, CASE WHEN level > 0 THEN regexp_replace(x, '^[ \t]*(>[ \t>]*)', '') ELSE x END AS body,
    max(level) OVER (PARTITION BY id) > 0 AS quoted
  FROM marked
),
own AS (
  SELECT m.id, m.conv_id, m.turn, m.role, bool_or(l.quoted) AS quoted,
    coalesce(string_agg(l.body, chr(10) ORDER BY l.i) FILTER (l.level = 0 AND NOT (l.quoted AND regexp_matches(l.body,
      '(?i)^[ \t]*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t\r]*\z'))), '') AS raw
  FROM messages m JOIN lines l ON l.id = m.id GROUP BY ALL
),
texts AS (
  SELECT id, conv_id, turn, role, CASE WHEN quoted THEN
    trim(regexp_replace(regexp_replace(raw, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+\z', '', 'g')) ELSE raw END AS text
  FROM own
),
said AS (
  SELECT conv_id, form, min(turn) AS origin
  FROM (SELECT conv_id, turn, trim(regexp_replace(lower(unnest(
          [text] || regexp_split_to_array(text, '\n[ \t]*\n') || string_split(text, chr(10)))), '[\s>]+', ' ', 'g')) AS form FROM texts)
  WHERE form <> '' GROUP BY ALL
),
shown AS (
  SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) = level THEN 0 ELSE 1 END AS opens
  FROM lines WHERE quoted AND (level = 0 OR trim(body) <> '')
),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY i) - 1 AS passage FROM shown),
passages AS (
  SELECT id, conv_id, turn, passage, level,
    trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[\s>]+', ' ', 'g')) AS whole_form,
    list_distinct(list(trim(regexp_replace(lower(body), '[\s>]+', ' ', 'g')))) AS line_forms
  FROM runs WHERE level > 0 GROUP BY ALL
),
units AS (
  SELECT id, conv_id, turn, passage, level, whole_form AS form, true AS whole FROM passages WHERE whole_form <> ''
  UNION ALL
  SELECT id, conv_id, turn, passage, level, form, false AS whole
  FROM (SELECT *, unnest(line_forms) AS form FROM passages) WHERE form <> '' AND form <> whole_form
),
votes AS (
  SELECT u.conv_id, u.turn, u.passage, u.level, s.origin, bool_or(u.whole) AS whole, sum(length(u.form)) AS chars
  FROM units u JOIN said s ON s.conv_id = u.conv_id AND s.form = u.form WHERE s.origin < u.turn GROUP BY ALL
),
links AS (
  SELECT conv_id, turn, passage, level, origin, chars FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, passage, level ORDER BY whole DESC, chars DESC, origin DESC) = 1
),
replies AS (
  SELECT conv_id, turn, origin FROM (SELECT conv_id, turn, origin, sum(chars) AS chars FROM links WHERE level = 1 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, origin DESC) = 1
),
walk(conv_id, turn, thread, depth) AS (
  SELECT conv_id, turn, origin, 1 FROM replies
  UNION ALL
  SELECT w.conv_id, w.turn, r.origin, w.depth + 1 FROM walk w JOIN replies r ON r.conv_id = w.conv_id AND r.turn = w.thread
),
threads AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT t.conv_id, coalesce(h.thread, t.turn) AS thread, t.turn, coalesce(h.depth, 0) AS depth, coalesce(r.origin, b.turn) AS reply_to,
  t.role, t.text, coalesce(q.n, 0) AS quotes, coalesce(l.n, 0) AS linked,
  '<|' || coalesce(t.role, '') || '|>' || chr(10) || t.text || chr(10) AS formatted
FROM texts t
LEFT JOIN replies r ON r.conv_id = t.conv_id AND r.turn = t.turn
LEFT JOIN threads h ON h.conv_id = t.conv_id AND h.turn = t.turn
LEFT JOIN (SELECT DISTINCT conv_id, turn FROM messages) b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1
LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM units WHERE whole GROUP BY ALL) q ON q.conv_id = t.conv_id AND q.turn = t.turn
LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM links GROUP BY ALL) l ON l.conv_id = t.conv_id AND l.turn = t.turn
"""
