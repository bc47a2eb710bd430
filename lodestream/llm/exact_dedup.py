"""Exact dedup by distributed MSD radix partitioning.

A document is a string of bytes. Round k splits every open group by the next
digit, a run of successive bytes: groups of one document are done, and so are
groups whose texts have ended. Digits grow from round to round, so that a few
rounds reach the end of long texts, while the first round, the only one over
the whole corpus, moves a short digit and an id per document. Equal digits are
compared as bytes; no digest decides anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.scratch import masked, save, unmasked, without

FIRST_DIGIT = 64
GROWTH = 16
MAX_BYTES = (1 << 31) - 1
#: Open documents whose ids may be broadcast: 16 bytes each, so 16 MB at most.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _groups(rows: DataFrame, digit: int) -> DataFrame:
    """Groups of two or more with the same digit; counts are combined before the shuffle."""
    found = rows.groupBy("_group", "_digit").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_row").alias("_next"),
        F.min("_key").alias("_keep"),
        F.coalesce(F.min_by("_row", "_key"), F.min("_row")).alias("_keep_row"),
    )
    return found.where("_n > 1").withColumn("_ended", F.octet_length("_digit") < digit)


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every document.

    Texts are equal if they are identical after white space runs become one
    space; null counts as empty. The row with the smallest key of a group stays:
    null keys come last, and of rows with the same key any one stays, so exactly
    one row per distinct text is kept. keep_id is null only if all keys of the
    group are. text_sha256 is an output only. Input columns named like an output
    are replaced. Without rows the result is empty.
    """
    docs = without(docs, "keep_id", "group_size", "kept", "text_sha256")
    rows, names = masked(docs)
    key, text = names[key], names[text]
    norm = F.encode(normalised(F.col(text)), "UTF-8")
    base = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_norm", norm)
    base = base.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_first", F.substring("_norm", 1, first_digit)).drop("_norm")
    base = save(base, "dedup-base")
    open_rows = base.select(F.lit(0).cast("long").alias("_group"), F.col("_first").alias("_digit"), "_row", F.col(key).alias("_key"))
    digit, done, rest, moved = first_digit, [], None, 0
    while True:
        groups = save(_groups(open_rows, digit), "dedup-groups")
        same = (F.col("r._group") == F.col("g._group")) & (F.col("r._digit") == F.col("g._digit"))
        joined = open_rows.alias("r").join(groups.alias("g"), same).select("r.*", "g._n", "g._next", "g._keep", "g._keep_row", "g._ended")
        joined = save(joined.drop("_digit"), "dedup-members")
        moved += joined.where("_ended").count()
        done.append(joined.where("_ended").select(F.col("_row").alias("_of"), "_n", "_keep", "_keep_row"))
        left = joined.where("not _ended").select(F.col("_next").alias("_group"), "_row", "_key")
        n = left.count()
        if not n:
            break
        few = F.broadcast(left) if n <= broadcast_rows else left
        if rest is None:
            # Only now are texts moved, and only of documents that share their first digit.
            rest = base.select("_row", norm.alias("_rest")).join(few, "_row")
        else:
            rest = rest.drop("_group", "_key", "_digit").join(few, "_row")
        after, digit = digit, digit * growth
        cut = F.substring("_rest", after + 1, MAX_BYTES)
        rest = rest.select("_group", "_row", "_key", F.substring(cut, 1, digit).alias("_digit"), cut.alias("_rest"))
        rest = save(rest, "dedup-rest")
        open_rows = rest.select("_group", "_digit", "_row", "_key")
    repeated = done[0]
    for more in done[1:]:
        repeated = repeated.unionByName(more)
    # Ids of repeated texts only, as few as the last rounds' members.
    repeated = F.broadcast(repeated) if moved <= broadcast_rows // 2 else repeated
    result = base.drop("_first").join(repeated, F.col("_row") == F.col("_of"), "left")
    return result.select(
        *unmasked(names),
        F.when(F.col("_of").isNull(), F.col(key)).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("_keep_row", "_row") == F.col("_row")).alias("kept"),
        "text_sha256",
    )
