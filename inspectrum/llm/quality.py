"""Quality rules by weak supervision: rules vote or abstain, and their accuracies are estimated without labels.

Each rule votes bad (0) or good (2) on a document, or abstains (1). Expectation-maximisation fits
the share of good documents and, for either kind of document, how often each rule votes bad
where it votes; abstentions count for neither side. A document is kept if it is probably good given all votes, so a rule
that often votes bad on documents of which all other rules think well is outvoted. Votes have at most
3 ** rules combinations, so the fit runs on counts of combinations, whatever the number
of documents, inside one expression.

Everything is DataFrame expressions. Nulls are texts without words. Texts without words fail.
Rows are judged one by one, so repeated rows get equal results; an empty table gives an empty
result. Repeated windows are found by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.text import SPACE_CLASS, SPACES, text_or_empty, whole_rows
from inspectrum.sources.workspace import discard, materialize

ROUNDS = 30
#: Votes of each kind counted for every rule before any are seen, and the probability of a good document at first, by its number of bad votes.
PRIOR_VOTES, START = 1.0, (0.95, 0.5, 0.05)
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
KEEP_FROM = 0.5
#: Rules by name: when it votes bad, when it votes good.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "repeated lines": ("n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines", "5 * n_dup_lines <= n_lines or n_dup_lines <= 1"),
    "repeated words": ("10 * n_repeat_words > 3 * n_words", "5 * n_repeat_words <= n_words"),
    "exclamations": ("5 * n_exclamations > n_words", "50 * n_exclamations <= n_words"),
    "capitals": ("3 * n_capitals > word_chars", "10 * n_capitals <= word_chars"),
    "word length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "letters": ("10 * n_letters < 9 * word_chars", "25 * n_letters >= 23 * word_chars"),
    "distinct words": ("5 * n_distinct < n_words", "5 * n_distinct >= 2 * n_words or n_words > 1000"),
    "sentences": ("50 * n_stops < n_words", "n_stops between 0.02 * n_words and 0.5 * n_words"),
}

# Positions of words that lie in a repeated window, from windows sorted by hash: a window is
# repeated if a neighbour has its hash; windows in text order then add up to covered words.
_REPEATED = """
transform(array(sort_array(transform(__g, (h, i) -> struct(h, i)))), s ->
  aggregate(
    sort_array(transform(
      filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h)),
      x -> x.i)),
    struct(0 as upto, 0L as n),
    (a, i) -> struct(i + 3 as upto, a.n + (i + 3 - greatest(a.upto, i)) as n),
    a -> a.n))[0]
"""


def measured(df: DataFrame, text_col: str = "text", into: str = "__quality") -> DataFrame:
    """Adds a struct of counts and votes of each row's text."""
    text = text_or_empty(text_col)
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    windows = "if(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))"
    kept = [F.col(f"`{c}`") for c in df.columns]
    cut = df.select(*kept, text.alias("__t"), words.alias("__w"), lines.alias("__l"))
    cut = cut.select(*kept, "__t", "__w", "__l", F.expr(windows).cast("array<bigint>").alias("__g"))
    repeated = F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.expr(_REPEATED)).otherwise(F.lit(0))

    def count(pattern: str) -> Column:
        return F.regexp_count("__t", F.lit(pattern)).cast("long")

    counted = cut.select(
        *kept,
        F.struct(
            F.size("__w").cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            count("[#*$%&|<>]").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            repeated.cast("long").alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
            count("!").alias("n_exclamations"),
            count(r"\p{Lu}").alias("n_capitals"),
            count("[.!?]").alias("n_stops"),
            count(r"[\p{L}\p{N}]").alias("n_letters"),
            F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        ).alias("__c"),
    )
    fields = F.col("__c")
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_exclamations n_capitals n_stops n_letters n_distinct".split()
    wide = counted.select(*kept, *[fields[n].alias(f"__{n}") for n in names])

    def condition(rule: str) -> Column:
        for n in sorted(names, key=len, reverse=True):
            rule = rule.replace(n, f"__{n}")
        return F.expr(rule)

    votes = [F.when(F.col("__n_words") == 0, 0).when(condition(bad), 0).when(condition(good), 2).otherwise(1) for bad, good in RULES.values()]
    failed = (F.col("__n_words") < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEATED_PERCENT * F.col("__n_words"))
    return wide.select(
        *kept,
        F.struct(*[F.col(f"__{n}").alias(n) for n in names], failed.alias("base_failed"), F.array(*votes).alias("votes")).alias(into),
    )


def _fit() -> str:
    """One expression: the posterior of every combination in `c`, an array of (votes, n)."""
    rules = range(len(RULES))
    good = " * ".join(f"s.good[{r}][x.votes[{r}]]" for r in rules)
    bad = " * ".join(f"s.bad[{r}][x.votes[{r}]]" for r in rules)
    posterior = f"transform(c, x -> (s.share * {good}) / (s.share * {good} + (1 - s.share) * {bad}))"
    start = f"transform(c, x -> element_at(array({', '.join(f'{p}D' for p in START)}), least({len(START) - 1}, size(filter(x.votes, v -> v = 0))) + 1))"

    def total(weight: str, where: str = "true") -> str:
        return f"aggregate(sequence(1, size(c)), 0D, (a, j) -> a + if({where}, element_at(c, j).n * {weight}, 0D))"

    def share(weight: str, r: int, v: int) -> str:
        cast = f"element_at(c, j).votes[{r}]"
        return f"({PRIOR_VOTES}D + {total(weight, f'{cast} = {v}')}) / ({2 * PRIOR_VOTES}D + {total(weight, f'{cast} <> 1')})"

    def shares(weight: str) -> str:
        return "array(" + ", ".join(f"array({share(weight, r, 0)}, 1D, {share(weight, r, 2)})" for r in rules) + ")"

    def fitted(w: str) -> str:
        g, b = "element_at(w, j)", "(1 - element_at(w, j))"
        return f"transform(array({w}), w -> named_struct('share', {total(g)} / {total('1D')}, 'good', {shares(g)}, 'bad', {shares(b)}))[0]"

    last = f"aggregate(sequence(2, {ROUNDS}), {fitted(start)}, (s, round) -> {fitted(posterior)})"
    return f"transform(array({last}), s -> zip_with(c, {posterior}, (y, p) -> named_struct('votes', y.votes, 'p', p)))[0]"


def posteriors(votes: DataFrame) -> DataFrame:
    """(votes, quality) for every combination of votes in a column `votes`; at most 3 ** rules rows."""
    counts = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("c")).filter("size(c) > 0")
    zipped = listed.select(F.explode(F.expr(_fit())).alias("z"))
    return zipped.select(F.col("z.votes").alias("votes"), F.round("z.p", 6).alias("quality"))


def judged(df: DataFrame, text_col: str = "text", into: str = "__quality", written: list[str] | None = None) -> DataFrame:
    """Columns `written` of `df` (all by default) and a struct with the counts, `base_failed`, the probability `quality` and `kept`."""
    table = materialize(measured(df, text_col, into).select(*[F.col(f"`{c}`") for c in written or df.columns], into), "quality")
    found = posteriors(table.select(F.col(f"{into}.votes").alias("votes")))
    fitted = materialize(found, "posteriors")
    # Bounded: one row for each combination of votes.
    joined = table.join(F.broadcast(fitted.withColumnRenamed("votes", "__v").withColumnRenamed("quality", "__p")), F.col(f"{into}.votes") == F.col("__v"))
    kept = ~F.col(f"{into}.base_failed") & (F.col("__p") >= KEEP_FROM)
    return joined.withColumn(into, F.col(into).withField("quality", F.col("__p")).withField("kept", kept)).drop("__v", "__p")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of `df` that are kept, with its columns."""
    return judged(whole_rows(df), f"row.`{text_col}`").filter("__quality.kept").select("row.*")


def quality_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, quality)."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = judged(texts, written=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return rows.select("doc_id", *[F.col(f"__quality.{n}").alias(n) for n in names])


def oracle() -> str:
    """The same table in another dialect: the fit unrolled over long tables of (combination, rule, vote)."""
    cases = ",\n".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END AS v{r}" for r, (bad, good) in enumerate(RULES.values()))
    pattern = "[" + ", ".join(f"v{r}" for r in range(len(RULES))) + "]"
    steps = []
    for k in range(1, ROUNDS + 1):
        steps.append(
            f"""p{k} AS MATERIALIZED (
  SELECT rule, vote,
         CASE vote WHEN 1 THEN 1 ELSE ({PRIOR_VOTES} + g) / ({2 * PRIOR_VOTES} + sum(g) FILTER (vote <> 1) OVER (PARTITION BY rule)) END AS good,
         CASE vote WHEN 1 THEN 1 ELSE ({PRIOR_VOTES} + b) / ({2 * PRIOR_VOTES} + sum(b) FILTER (vote <> 1) OVER (PARTITION BY rule)) END AS bad
  FROM (SELECT rule, vote, coalesce(sum(long.n * w), 0) AS g, coalesce(sum(long.n * (1 - w)), 0) AS b
        FROM slots LEFT JOIN long USING (rule, vote) LEFT JOIN w{k - 1} USING (votes) GROUP BY rule, vote)),
s{k} AS MATERIALIZED (SELECT sum(n * w) / sum(n) AS share FROM w{k - 1}),
w{k} AS MATERIALIZED (
  SELECT votes, any_value(long.n) AS n,
         any_value(share) * exp(sum(ln(good))) / (any_value(share) * exp(sum(ln(good))) + (1 - any_value(share)) * exp(sum(ln(bad)))) AS w
  FROM long JOIN p{k} USING (rule, vote) CROSS JOIN s{k} GROUP BY votes)"""
        )
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
placed AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (SELECT row, i, word || chr(1) || lead(word) OVER o || chr(1) || lead(word, 2) OVER o AS g FROM placed WINDOW o AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, unnest(list(i)) AS i FROM windows WHERE g IS NOT NULL GROUP BY row, g HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY row),
lines AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS again
          FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
counts AS (
  SELECT t.row, doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.again, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines, len(regexp_extract_all(text, '!')) AS n_exclamations,
         len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '[.!?]')) AS n_stops,
         len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) AS n_letters, len(list_distinct(w)) AS n_distinct
  FROM t JOIN words USING (row) LEFT JOIN covered USING (row) LEFT JOIN lines USING (row)),
voted AS (SELECT *, {cases} FROM counts),
named AS (SELECT *, {pattern} AS votes FROM voted),
long AS (SELECT votes, n, unnest(votes) AS vote, generate_subscripts(votes, 1) AS rule FROM (SELECT votes, count(*)::DOUBLE AS n FROM named GROUP BY votes)),
slots AS (SELECT rule, vote FROM range(1, {len(RULES) + 1}) a(rule), range(3) b(vote)),
w0 AS MATERIALIZED (SELECT DISTINCT votes, n, [{', '.join(map(str, START))}][least({len(START) - 1}, len(list_filter(votes, lambda v: v = 0))) + 1] AS w FROM long),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AND round(w, 6) >= {KEEP_FROM} AS kept, round(w, 6) AS quality
FROM named JOIN w{ROUNDS} USING (votes)
"""
