"""Chat formatting by quotation linking: replies find the messages that they quote.

Lines that start with `>` marks are quoted, as deep as they have marks. A run of lines of one
depth is a passage. Passages and the messages' own text are normalised (lower case,
single spaces) and cut into sentences; a sentence's original is the first message of
the conversation that says it itself. A passage is linked to the earlier message that is the original
of most of its characters, and a message replies to what its shallowest linked passage
quotes. Threads are followed by doubling. The conversation then reads thread by thread, each
in order of turns, with no quotes left in the messages.

Everything is DataFrame expressions. Null texts are empty messages. Rows that agree in conversation, turn, role and
text are one message, with its number of `copies`. Messages without a conversation stand alone, at position 0. Among equal
turns, a null one comes first and messages go by a digest of role and text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.text import text_or_empty
from inspectrum.operators.ordered import range_partitioned, running_totals
from inspectrum.sources.workspace import discard, materialize

_MARKS = r"^([ \t]*>)+"
_ATTRIBUTION = r"(?i)(wrote|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"
KEY = ["conv_id", "at", "m"]
_NO_TURN = -(2**63)


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def _sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(_normal(text), "([.!?]) ", "$1\n"), "\n"), lambda s: s != "")


def parsed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: its key, `body` without quotes, and `passages`, an array of (level, text)."""
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), text_or_empty(text).alias("text"))
    m = F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\x01"), F.col("text")).cast("binary"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("at", F.coalesce("turn", F.lit(_NO_TURN))).withColumn("m", m).withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("levels", F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))))
    rows = rows.withColumn("cuts", F.expr("concat(filter(sequence(0, size(levels) - 1), i -> i = 0 or levels[i] <> levels[i - 1]), array(size(levels)))"))
    run = F.expr("transform(sequence(0, size(cuts) - 2), k -> struct(levels[cuts[k]] as level, slice(lines, cuts[k] + 1, cuts[k + 1] - cuts[k]) as lines))")
    passages = F.transform(
        F.filter(run, lambda p: p["level"] > 0),
        lambda p: F.struct(p["level"].alias("level"), F.array_join(F.transform(p["lines"], lambda x: F.regexp_replace(x, _MARKS + " ?", "")), "\n").alias("text")),
    )
    own = F.expr("filter(sequence(0, size(levels) - 1), i -> levels[i] = 0 and not (coalesce(get(levels, i + 1), 0) > 0 and lines[i] rlike '" + _ATTRIBUTION.replace("\\", "\\\\") + "'))")
    body = F.btrim(F.array_join(F.transform(own, lambda i: F.get(F.col("lines"), i)), "\n"), F.lit(" \t\r\n"))
    return rows.select("conv_id", "turn", "role", "copies", "at", "m", body.alias("body"), passages.alias("passages"))


def linked(messages: DataFrame) -> DataFrame:
    """(key, passage, level, of_at, of_m) of every passage that quotes an earlier message of its conversation."""
    known = messages.filter("conv_id is not null")
    quoting = known.filter(F.size("passages") > 0).select(*KEY, F.posexplode("passages").alias("passage", "p"))
    quoted = quoting.select(*KEY, "passage", F.col("p.level").alias("level"), F.explode(F.array_distinct(_sentences(F.col("p.text")))).alias("s"))
    asked = quoted.select("conv_id", "at", "m", "passage", "level", F.xxhash64("s").alias("unit"), F.length("s").alias("size"))
    said = known.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said.select("conv_id", F.explode(_sentences(F.col("body"))).alias("s"), "at", "m").select("conv_id", F.xxhash64("s").alias("unit"), "at", "m")
    # One row for each sentence of a conversation: a sentence that very many messages say meets one row.
    first = said.groupBy("conv_id", "unit").agg(F.min(F.struct("at", "m")).alias("of"))
    met = asked.join(first, ["conv_id", "unit"]).filter(F.col("of") < F.struct("at", "m"))
    sizes = met.groupBy(*KEY, "passage", "level", "of").agg(F.sum("size").alias("size"))
    best = sizes.groupBy(*KEY, "passage", "level").agg(F.max_by("of", F.struct("size", "of")).alias("of"))
    return best.select(*KEY, "passage", "level", F.col("of.at").alias("of_at"), F.col("of.m").alias("of_m"))


def threads(parents: DataFrame) -> DataFrame:
    """(key, root_at, root_m, depth) of messages with a parent, from (key, of_at, of_m): ancestors are doubled until none has a parent."""
    now = materialize(parents.select(*KEY, F.col("of_at").alias("root_at"), F.col("of_m").alias("root_m"), F.lit(1).alias("depth")), "threads")
    while True:
        above = now.select("conv_id", F.col("at").alias("root_at"), F.col("m").alias("root_m"), F.col("root_at").alias("up_at"), F.col("root_m").alias("up_m"), F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "root_at", "root_m"], "left")
        if joined.filter("up_m is not null").isEmpty():
            return now
        step = joined.select(
            *KEY, F.coalesce("up_at", "root_at").alias("root_at"), F.coalesce("up_m", "root_m").alias("root_m"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        after = materialize(step, "threads")
        discard(now)
        now = after


def reply_ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, copies, body, n_quotes, n_linked, parent_turn, thread_turn, depth, position): one row for each message.

    `position` counts from 0 in each conversation: threads by their first message, messages of a
    thread by turn. A reply always comes after what it replies to.
    """
    messages = materialize(parsed(df, conv, turn, role, text), "messages")
    links = materialize(linked(messages), "quotes")
    parents = links.groupBy(*KEY).agg(F.count("*").alias("n_linked"), F.max_by(F.struct("of_at", "of_m"), F.struct(-F.col("level"), F.col("passage"))).alias("of"))
    parents = materialize(parents.select(*KEY, "n_linked", F.col("of.of_at").alias("of_at"), F.col("of.of_m").alias("of_m")), "parents")
    roots = threads(parents)
    slim = messages.select("*", F.size("passages").alias("n_quotes")).drop("passages")
    placed = slim.join(parents, KEY, "left").join(roots, KEY, "left")
    placed = placed.withColumn("root_at", F.coalesce("root_at", "at")).withColumn("root_m", F.coalesce("root_m", "m")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    placed = placed.withColumn("order", F.struct("root_at", "root_m", "at", "m")).withColumn("one", F.lit(1))
    ranged = range_partitioned(placed.filter("conv_id is not null").select("conv_id", "order", "one"), ["conv_id", "order"], "order")
    numbered = running_totals(ranged, "order", {"upto": "one"}, by=["conv_id"])
    numbers = numbered.select("conv_id", F.col("order.at").alias("at"), F.col("order.m").alias("m"), (F.col("upto") - 1).alias("position"))

    def turn_of(at: str) -> Column:
        return F.when(F.col(at) != _NO_TURN, F.col(at))

    result = placed.join(numbers, KEY, "left").select(
        "conv_id", "turn", "role", "copies", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), turn_of("of_at").alias("parent_turn"),
        turn_of("root_at").alias("thread_turn"), "depth", F.coalesce("position", F.lit(0)).alias("position"),
    )
    out = materialize(result, "replies")
    discard(messages, links, parents, roots, ranged)
    return out


ORACLE = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY ALL),
message AS (
  SELECT *, coalesce(turn, {_NO_TURN}) AS seq, md5(coalesce(role, '') || chr(1) || text) AS m, row_number() OVER () AS row FROM raw),
line AS (
  SELECT row, i, x, length(regexp_replace(regexp_extract(x, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM message)),
beside AS (SELECT *, lag(level) OVER w AS before, coalesce(lead(level) OVER w, 0) AS after FROM line WINDOW w AS (PARTITION BY row ORDER BY i)),
run AS (SELECT *, count(*) FILTER (before IS NULL OR before <> level) OVER (PARTITION BY row ORDER BY i) AS run FROM beside),
body AS (
  SELECT row, trim(string_agg(x, chr(10) ORDER BY i), chr(32) || chr(9) || chr(13) || chr(10)) AS body FROM run
  WHERE level = 0 AND NOT (after > 0 AND regexp_matches(x, '{_ATTRIBUTION}')) GROUP BY row),
passage AS (
  SELECT row, run, level, string_agg(regexp_replace(x, '^([ \t]*>)+ ?', ''), chr(10) ORDER BY i) AS text FROM run WHERE level > 0 GROUP BY row, run, level),
normal AS (
  SELECT row, run, level, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS text FROM passage
  UNION ALL SELECT row, 0, 0, trim(regexp_replace(lower(body), '[ \t\r\n]+', ' ', 'g')) FROM body),
unit AS (
  SELECT DISTINCT row, run, level, s FROM (SELECT row, run, level, unnest(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS s FROM normal) WHERE s <> ''),
placed AS (SELECT unit.*, conv_id, seq, m FROM unit JOIN message USING (row) WHERE conv_id IS NOT NULL),
first AS (SELECT conv_id, s, min((seq, m)) AS of FROM placed WHERE level = 0 GROUP BY conv_id, s),
met AS (
  SELECT p.row, p.run, p.level, of, sum(length(p.s)) AS size FROM placed p JOIN first f ON p.conv_id = f.conv_id AND p.s = f.s
  WHERE p.level > 0 AND of < (p.seq, p.m) GROUP BY p.row, p.run, p.level, of),
link AS (SELECT row, run, level, arg_max(of, (size, of)) AS of FROM met GROUP BY row, run, level),
reply AS (SELECT row, count(*) AS n_linked, arg_max(of, (-level, run)) AS of FROM link GROUP BY row),
edge AS (SELECT child.row AS row, parent.row AS up FROM reply JOIN message child USING (row) JOIN message parent ON parent.conv_id = child.conv_id AND (parent.seq, parent.m) = of),
walk AS (SELECT row, row AS top, 0 AS depth FROM message UNION ALL SELECT walk.row, edge.up, depth + 1 FROM walk JOIN edge ON walk.top = edge.row),
root AS (SELECT row, arg_max(top, depth) AS top, max(depth) AS depth FROM walk GROUP BY row),
quotes AS (SELECT row, count(*) AS n FROM passage GROUP BY row)
SELECT a.conv_id, a.turn, a.role, a.copies, coalesce(body, '') AS body, coalesce(quotes.n, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
       (SELECT up.turn FROM edge JOIN message up ON up.row = edge.up WHERE edge.row = a.row) AS parent_turn, t.turn AS thread_turn, depth,
       CASE WHEN a.conv_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY a.conv_id ORDER BY t.seq, t.m, a.seq, a.m) - 1 END AS position
FROM message a JOIN root ON root.row = a.row JOIN message t ON t.row = root.top
LEFT JOIN body ON body.row = a.row LEFT JOIN quotes ON quotes.row = a.row LEFT JOIN reply ON reply.row = a.row
"""
