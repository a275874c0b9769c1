"""Shards of equal bytes by sampled splitters, in DataFrame expressions.

Rows are ordered by a digest of their text, so equal texts stand side by side, then by `doc_id`. A sample of the keys,
weighted by size, gives the quantiles at which the order is cut into many small ranges of about equal bytes;
a repeated row gets a number of its own in the key, so that even a single row that is half of the table is cut. Rows are
dealt to tasks by range. The exact bytes of every range then say at which byte of the order it begins: a range that
lies within one shard goes there whole, and one that a shard's limit crosses is overfull for that shard and is
subdivided, row by row, at the limit. A row belongs to the shard that holds its middle byte. So a
shard differs from an equal share by at most the largest row, whatever the sample; the sample only decides how evenly
tasks are loaded.

A null text has no bytes and counts as empty. Null ids stand first among equal texts; equal rows take places of their
own in any order, which gives the same set of rows. A row larger than a share fills its shard and may leave a
neighbour empty. Texts of any length are read once and never shuffled. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from inspectrum.llm.text import texts_of
from inspectrum.sources.workspace import discard, materialize

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Ranges that the order is cut into, and sampled keys for each: about 32 000 keys in all come to the driver, at every size.
RANGES, SAMPLED = 1024, 32
_DIGITS = 15


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest, row_id) without the texts."""
    rows = texts_of(docs)
    text = F.col("text")
    return rows.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long").alias("digest"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row_id"),
    )


def _key() -> Column:
    return F.struct("digest", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "row_id")


def splitters(rows: DataFrame, ranges: int, sampled: int) -> list[tuple[int, int, int]]:
    """Keys that cut the order into about equal bytes: quantiles of a sample in which a row's chance grows with its size.

    The chance of a row comes from a hash of its key, so a task that is run again draws the same rows. A row of more bytes
    than one sampled key stands for is always drawn, and as often as it stands for keys.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    step = max(1, total // (ranges * sampled))
    share = F.pmod(F.xxhash64(F.lit(1), "digest", "doc_id", "row_id"), F.lit(step))
    drawn = rows.withColumn("times", ((F.col("size") + share) / F.lit(step)).cast("long")).filter("times > 0")
    keys = [(tuple(r[0]), r[1]) for r in drawn.select(_key(), "times").collect()]
    weight = sum(n for _, n in keys)
    out, before, cut = [], 0, 1
    for key, n in sorted(keys):
        before += n
        while cut < ranges and before * ranges >= cut * weight:
            out.append(key)
            cut += 1
    return sorted(set(out))


def range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted `bounds` are not above the row's key, by halving."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    at = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(i).alias("doc"), F.lit(r).alias("row_id")) for d, i, r in bounds])

    def halved(low: Column, step: Column) -> Column:
        up = low + step
        return F.when((up <= len(bounds)) & (F.get(at, F.least(up, F.lit(len(bounds))) - 1) <= F.col("key")), up).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halved)


def shards_of(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, sampled: int = SAMPLED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    With another number of shards the limits move, so the law is `bytes` and no grown shard is promised.
    """
    rows = materialize(keyed(docs), "shard-keys")
    bounds = splitters(rows, ranges, sampled)
    dealt = rows.withColumn("key", _key()).withColumn("range", range_of(bounds)).drop("key")
    sums = dealt.groupBy("range").agg(F.sum("size").alias("bytes"))
    # One row for each range, at most `ranges` of them; so are the pieces below, and one more for each shard.
    order = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    begin = F.sum("bytes").over(order) - F.col("bytes")
    starts = materialize(sums.select("range", begin.alias("start"), F.sum("bytes").over(W.partitionBy(F.lit(0))).alias("total")), "range-starts")
    inside = W.partitionBy("range").orderBy("digest", F.col("doc_id").asc_nulls_first(), "row_id").rowsBetween(W.unboundedPreceding, 0)
    counted = dealt.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}).join(F.broadcast(starts), "range")
    middle = "(2 * (start + upto) - size)"
    shard = F.expr(f"least({shards - 1}, {middle} * {shards} div (2 * total))").cast("int")
    cut = materialize(counted.select("doc_id", "size", "text_crc32", "range", "nth", shard.alias("shard")), "shard-rows")
    # Places inside a shard: rows of the shard in earlier ranges come first.
    pieces = cut.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    by_shard = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    places = materialize(pieces.select("range", "shard", (F.sum("n").over(by_shard) - F.col("n") - F.col("first")).alias("shift")), "shard-places")
    out = cut.join(F.broadcast(places), ["range", "shard"])
    discard(rows)
    slot = (F.col("nth") + F.col("shift")).cast("long")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of a string's UTF-8 bytes; the query joins `crc_table` below."""
    code = "('0x' || x)::UBIGINT"
    step = "xor(c // 256, list_extract(entries, (xor(c, b) % 256)::INT + 1))"
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: {code})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {values}), lambda c, b: {step}), 4294967295::UBIGINT)::BIGINT"


#: The remainders of all bytes by the reversed polynomial of CRC-32, as one list `entries`.
CRC_TABLE_SQL = """
crc_bits(i, v, k) AS (
    SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
    UNION ALL
    SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, k + 1 FROM crc_bits WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS entries FROM crc_bits WHERE k = 8)"""

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
keyed AS (
    SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
           ('0x' || substr(md5(coalesce(text, '')), 1, {_DIGITS}))::BIGINT AS digest
    FROM documents, crc_table
),
summed AS (
    SELECT *, sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, (sum(size) OVER ())::BIGINT AS total
    FROM keyed
),
cut AS (SELECT *, least({SHARDS - 1}, (2 * upto - size) * {SHARDS} // (2 * total))::INT AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""
