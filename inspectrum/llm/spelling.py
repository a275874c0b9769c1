"""Spelling variants: words that one edit apart stand by the far more frequent one.

A dictionary of grams of variable length is built from the words: a gram of two code points is enough where it is rare,
and is extended to three where more than one gram in `COMMON` begins with it. A word is decomposed from left to right into the
longest gram of the dictionary at each place, less those inside the one before. For every place of an edit the
grams that it can affect are bounded from the dictionary alone: a gram hears of the code point after it only if the dictionary
extends it, and of the one before only if it ends a longer gram. All other grams are shared by every word that the edit leads to; with at
least seven code points that is one gram at least. Their lists are merged by one key, what the unaffected grams cover on
the left and on the right, so words meet only if they share all of them. In a merged list near words
are verified by what is left of the word when one code point goes, in time linear in the list; no pair of words is
written, only each word's number of near words and the best of them. A pair is counted at the one place of
its edit, so lists need no comparison with each other.

A null text has no words. A null id counts as empty in the alteration. Near words of equal count go by code-point order.
Repeated documents count again. Very long texts are cut into words as they are. The table of words has one row for each word, whatever
other columns documents have. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.sharding import CRC_TABLE_SQL, crc32_sql
from inspectrum.llm.text import texts_of
from inspectrum.sources.workspace import discard, materialize

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in so many loses a code point.
ALTERED = 31
#: A form is at least so many times as frequent as its variant.
TIMES = 10
#: A gram of two is extended where more than one in so many grams begins like it; so at most so many are.
COMMON = 400


def altered_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of whole texts, some of them altered, that are long enough and occur twice or more."""
    # A run of letters shorter than the least length can't become a word.
    runs = texts_of(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    hashed = lowered.select("run", code.alias("h"))
    at = F.col("h") % F.length("run")
    shorter = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
    word = F.when(F.col("h") % ALTERED == 0, shorter).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def gram_dictionary(words: DataFrame) -> set[str]:
    """The grams of three: those that occur and begin with a common gram of two.

    All other places of a word have grams of two. At most `COMMON` grams of two are common, so the dictionary is no larger than
    that many alphabets.
    """
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.substr("word", p, F.lit(3)))
    grams = words.filter(F.length("word") >= 2).select(F.explode(places).alias("gram"))
    counts = materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = counts.groupBy(F.substring("gram", 1, 2).alias("start")).agg(F.sum("n").alias("n"))
    common = starts.filter(F.col("n") * COMMON > total).select("start")
    longer = counts.filter(F.length("gram") == 3).join(F.broadcast(common), F.substring("gram", 1, 2) == F.col("start"), "left_semi")
    found = {r.gram for r in longer.select("gram").collect()}
    discard(counts)
    return found


class Decomposer:
    """Decomposes words into grams and gives the keys of the lists that they belong to."""

    def __init__(self, longer: set[str]) -> None:
        self._longer = longer
        self._starts = {g[:2] for g in longer}
        self._ends = {g[1:] for g in longer}

    def grams(self, word: str) -> list[tuple[int, int]]:
        """Start and end of each gram, none inside the one before."""
        out, reach = [], 0
        for p in range(len(word) - 1):
            end = p + 3 if word[p : p + 3] in self._longer else p + 2
            if end > reach:
                out.append((p, end))
                reach = end
        return out

    def window(self, word: str, start: int, end: int) -> tuple[int, int]:
        """First and last place whose code point has a say in the gram; they may lie one outside the word."""
        if end - start == 3:
            return start, end - 1
        gram = word[start:end]
        return start - (gram in self._ends), end - 1 + (gram in self._starts)

    def kept(self, word: str) -> tuple[list[int], list[int]]:
        """`left[i]`: where the grams end that only places before i have a say in; `right[i]`: where those from i on start."""
        n = len(word)
        left, right = [0] * (n + 1), [n] * (n + 2)
        for start, end in self.grams(word):
            first, last = self.window(word, start, end)
            if last + 1 <= n and left[last + 1] < end:
                left[last + 1] = end
            if first >= 0 and right[first] > start:
                right[first] = start
        for i in range(n):
            left[i + 1] = max(left[i], left[i + 1])
        for i in range(n, -1, -1):
            right[i] = min(right[i], right[i + 1])
        return left, right

    def lists(self, word: str) -> dict[tuple[int, int], list[int]]:
        """For (left, right) cover of the unaffected grams: the range of places of a replaced or deleted code point, and of gaps."""
        left, right = self.kept(word)
        out: dict[tuple[int, int], list[int]] = {}
        for i in range(len(word)):
            span = out.setdefault((left[i], right[i + 1]), [i, i, 0, -1])
            span[1] = i
        for i in range(len(word) + 1):
            key = left[i], right[i]
            span = out.get(key)
            if span is None:
                out[key] = [0, -1, i, i]
            elif span[3] < 0:
                span[2] = span[3] = i
            else:
                span[3] = i
        return out


_LISTED = pa.schema(
    [("head", pa.string()), ("tail", pa.string()), ("hole", pa.string()), ("n", pa.int64())]
    + [(c, pa.int32()) for c in ("place", "last_place", "gap", "last_gap")]
)


def _listed(batches: Iterable[pa.RecordBatch], longer: set[str]) -> Iterator[pa.RecordBatch]:
    cut = Decomposer(longer)
    for batch in batches:
        rows = []
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
            for (a, b), span in cut.lists(word).items():
                rows.append((word[:a], word[b:], word[a:b], n, *span))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LISTED)], schema=_LISTED)


class _Best:
    """Number of near words and the best of them, for each word of one list."""

    def __init__(self) -> None:
        self.found: dict[str, list] = {}

    def add(self, word: str, near: str, near_n: int) -> None:
        got = self.found.get(word)
        if got is None:
            self.found[word] = [1, near, near_n]
            return
        got[0] += 1
        if near_n > got[2] or near_n == got[2] and near < got[1]:
            got[1:] = near, near_n

    def add_group(self, group: list[tuple[str, int]]) -> None:
        """All words of a group are near each other: only the two best matter."""
        first, second = sorted(group, key=lambda x: (-x[1], x[0]))[:2]
        for word, _ in group:
            near, near_n = second if word == first[0] else first
            self.add(word, near, near_n)
            self.found[word][0] += len(group) - 2


def near_in_list(head: str, tail: str, members: list[tuple]) -> dict[str, list]:
    """Near words among the members (hole, n, place, last_place, gap, last_gap) of one merged list: exactly one edit at a place of the list."""
    best, replaced = _Best(), defaultdict(list)
    at = len(head)
    holes = {m[0]: m for m in members if m[5] >= m[4]}
    for hole, n, place, last_place, _, _ in members:
        word = head + hole + tail
        for i in range(place, last_place + 1):
            j = i - at
            rest = hole[:j] + hole[j + 1 :]
            replaced[i, rest].append((word, n))
            # Of a run of equal code points the last one counts as deleted.
            shorter = holes.get(rest)
            if shorter and shorter[4] <= i <= shorter[5] and word[i] != word[i + 1 : i + 2]:
                other = head + rest + tail
                best.add(word, other, shorter[1])
                best.add(other, word, n)
    for group in replaced.values():
        if len(group) > 1:
            best.add_group(group)
    return best.found


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify the merged lists of sorted rows, one list at a time."""
    held: pa.Table | None = None

    def verified(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out, members, key = [], [], None
        columns = [rows[c].to_pylist() for c in _LISTED.names]
        for head, tail, *member in [*zip(*columns), (None, None)]:
            if (head, tail) != key:
                if len(members) > 1:
                    out += [(w, *x) for w, x in near_in_list(*key, members).items()]
                members, key = [], (head, tail)
            members.append(member)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows.cast(held.schema)]).combine_chunks()
        n = len(rows)
        if n < 2:
            held = rows
            continue
        head, tail = (rows[c].combine_chunks() for c in ("head", "tail"))
        same = pc.and_(pc.equal(head[1:], head[:-1]), pc.equal(tail[1:], tail[:-1])).to_numpy(zero_copy_only=False)
        # The last list may go on in the next batch; lists of one word hold no pair.
        edges = (~same).nonzero()[0]
        whole = int(edges[-1]) + 1 if len(edges) else 0
        held = rows.slice(whole)
        if whole:
            shared = pa.array([*same[:whole], False])
            shared = pc.or_(shared, pa.array([False, *same[:whole]]))[:whole]
            yield from verified(rows.slice(0, whole).filter(shared))
    if held is not None and len(held) > 1:
        yield from verified(held)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) of distinct words (word, n) of at least seven code points: how many others are one edit away, and the most frequent of them."""
    longer = gram_dictionary(words)
    listed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(
        functools.partial(_listed, longer=longer), "head string, tail string, hole string, n long, place int, last_place int, gap int, last_gap int"
    )
    merged = listed.repartition("head", "tail").sortWithinPartitions("head", "tail")
    found = merged.mapInArrow(_merged, "word string, n_near long, near string, near_n long")
    both = found.withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", "n"), allowMissingColumns=True)
    return both.groupBy("word").agg(
        F.max("n").alias("n"),
        F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"),
        F.min_by("near", F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), "near"))).alias("near"),
        F.max("near_n").alias("near_n"),
    )


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): follow forms to the last one, by doubling.

    Each form is ten times as frequent as the word before, so a chain has at most 18 steps and five rounds end it.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = current.join(onward, "root", "left")
        moved = materialize(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(current)
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = materialize(words, "words")
    near = materialize(near_words(words), "near-words")
    discard(words)
    has_form = F.col("near_n") >= TIMES * F.col("n")
    formed = near.select("word", "n", "n_near", F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"))
    roots = roots_of(formed.filter("form IS NOT NULL"))
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents
),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("keyed")} AS h FROM counted, crc_table),
altered AS (
    SELECT CASE WHEN h % {ALTERED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
holes AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM words, range(1, 1000) r(i) WHERE i <= length(word)),
links AS (
    SELECT x.word, y.word AS near FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION
    SELECT x.word, y.word FROM holes x JOIN words y ON y.word = x.a || x.b
    UNION
    SELECT y.word, x.word FROM holes x JOIN words y ON y.word = x.a || x.b
),
best AS (
    SELECT l.word, l.near, w.n AS near_n, count(*) OVER (PARTITION BY l.word) AS n_near,
           row_number() OVER (PARTITION BY l.word ORDER BY w.n DESC, encode(l.near)) AS nth
    FROM links l JOIN words w ON w.word = l.near
),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {TIMES} * w.n THEN b.near END AS form,
           CASE WHEN b.near_n >= {TIMES} * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word AND b.nth = 1
),
followed(word, reached) AS (
    SELECT word, word FROM formed
    UNION ALL
    SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.reached WHERE g.form IS NOT NULL
)
SELECT f.word, f.form, r.reached AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT d.word, d.reached FROM followed d JOIN formed g ON g.word = d.reached WHERE g.form IS NULL) r ON r.word = f.word
"""
