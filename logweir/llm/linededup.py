r"""Line dedup over a whole corpus: one occurrence of a frequent line stays, all others go.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z in lower case. Keys of at
least ``MIN_CHARS`` code points found in at least ``MIN_DOCS`` documents lose all their lines, except those
in the largest document id that holds the key.

Method: every long line becomes one narrow row (128-bit key hash, document, position). The rows are range
partitioned by (hash, document slice) and sorted inside a partition by (document descending, position),
so the first occurrences come by as a stream; a slice reports its number of documents and its first
document. A key that a third of all lines share is thus spread over ``SLICES`` ranges, and only one row
per key and slice meets again. Lines of frequent keys are then joined back (Spark splits hot partitions)
and leave one 64-bit word of a keep bitmap per 64 lines; words that keep all their lines are left out.
Text crosses the network once, when ``apply_bitmaps`` meets documents with their bitmaps.

Keys are compared by two 64-bit hashes, so two different lines meet with a chance of 2^-128 per pair.

Defined results: NULL or empty text is one empty line; a NULL id is one document, smaller than all others;
rows that repeat an id and a text are one document and get the same bitmap; rows that share an id but not
the text count as one document, and each text has its own bitmap; an empty table gives an empty result;
whatever columns the input has, ``apply_bitmaps`` returns its rows as the struct ``doc`` beside the struct
``lines``, so that names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.text import SPACE, lower_ascii

MIN_CHARS = 40
MIN_DOCS = 5
SLICES = 64
NO_ID = -(2**63)
ROW = ["l_doc", "l_text_hash"]
KEY = ["l_h1", "l_h2"]


def _identity(id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("l_doc"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("l_text_hash")]


def long_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: document, position, key hashes."""
    keys = F.transform(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), "\n", -1),
                       lambda line: F.btrim(line, F.lit(SPACE)))
    rows = docs.select(*_identity(id, text), F.posexplode(keys).alias("l_pos", "l_key"))
    return rows.where(F.length("l_key") >= min_chars).select(
        *ROW, "l_pos", F.xxhash64("l_key").alias("l_h1"), F.xxhash64(F.lit("second"), "l_key").alias("l_h2"))


def frequent_keys(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys found in enough documents, with the document that keeps them."""
    ranged = rows.withColumn("l_slice", F.pmod(F.xxhash64("l_doc"), F.lit(SLICES))).repartitionByRange(*KEY, "l_slice")
    stream = Window.partitionBy(*KEY, "l_slice").orderBy(F.desc("l_doc"), "l_pos")
    first = F.coalesce(F.lag("l_doc").over(stream) != F.col("l_doc"), F.lit(True))
    slices = (ranged.select(*KEY, "l_slice", "l_doc", first.alias("l_first")).where("l_first")
              .groupBy(*KEY, "l_slice").agg(F.count("*").alias("l_n"), F.max("l_doc").alias("l_keeper")))
    return (slices.groupBy(*KEY).agg(F.sum("l_n").alias("l_n"), F.max("l_keeper").alias("l_keeper"))
            .where(F.col("l_n") >= min_docs).select(*KEY, "l_keeper"))


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document that loses lines: ``l_bitmap``, its words with a dropped line; bit i of word w is line 64w+i."""
    rows = long_lines(docs, id, text, min_chars)
    # Dealt evenly first, the keys get an exchange of their own, and Spark can split a hot key in the join.
    keys = frequent_keys(rows, min_docs).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dropped = rows.join(keys, KEY).where("l_doc != l_keeper")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("l_pos") % 64)
    words = (dropped.groupBy(*ROW, F.floor(F.col("l_pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(bit).alias("dropped")))
    kept = F.struct("word", F.bitwise_not("dropped").alias("kept"))
    return words.groupBy(*ROW).agg(F.sort_array(F.collect_list(kept)).alias("l_bitmap"))


def dropped_positions(bitmap: Column) -> Column:
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(bitmap, lambda w: F.transform(
        F.filter(bits, lambda b: F.getbit(w["kept"], b) == 0), lambda b: 64 * w["word"] + b)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows as ``doc`` beside ``lines``: their number ``n``, how many are ``dropped``, the remaining ``text``."""
    joined = docs.select(F.struct("*").alias("doc"), *_identity(id, text)).join(bitmaps, ROW, "left")
    gone = F.coalesce(dropped_positions(F.col("l_bitmap")), F.array().cast("array<int>"))
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    split = joined.select("doc", F.split(body, "\n", -1).alias("split"), gone.alias("gone"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone"),
                       lambda i: F.get(F.col("split"), i))
    return split.select("doc", F.struct(
        F.size("split").cast("bigint").alias("n"), F.size("gone").cast("bigint").alias("dropped"),
        F.when(F.size("gone") == 0, body).otherwise(F.array_join(left, "\n")).alias("text")).alias("lines"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, id, text, min_chars, min_docs), id, text)
