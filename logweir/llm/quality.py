r"""Line-first quality rules: judge lines, drop the failing ones, then judge what is left.

A line fails when it is

- navigation: at least two column bars, or at most eight words (``FEW_CHARS`` characters where words have no spaces
  between them) of which none ends a sentence;
- badly punctuated: no sentence ends within its last ``TAIL`` characters, or it holds a symbol of ``[#*$%&|<>]`` for every two words;
- boilerplate: a short line (up to 200 characters) with a phrase such as "cookie policy" or "enable javascript".

Endings are judged by paragraph: a line of hard-wrapped text, which the next line goes on with, need not end a sentence.
Such a line is of ``WRAPPED`` characters, and the first word of the next line would have made it longer than all lines
up to two places away. Sentences end as Unicode has it in all scripts; Thai and Lao have no such mark, and no such rule.

A document is rejected when the base rules reject it (fewer than 50 words, or more than half of its
words stand in three-word windows found twice or more), or when its failing lines hold more than
``MAX_LOSS`` of its word characters. Everything runs inside one projection over the scan: no shuffle, so
no key can be hot, and one row is the largest unit of work.

Defined results: NULL and blank texts have no words and fail; repeated rows are judged alike, each for
itself; an empty table gives an empty result; whatever columns the input has, ``clean_lines`` returns its rows
as the struct ``doc`` beside the struct ``quality``, so that names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.text import SPACE, bind, words

MIN_WORDS = 50
MAX_REPEAT = 0.5
MAX_LOSS = 0.3
SHORT_LINE = 200
TAIL = 40
SYMBOLS = "[#*$%&|<>]"
WRAPPED = (30, 120)
FEW_CHARS = 24
# Marks that end a sentence in Latin, East Asian, Devanagari, Arabic, Armenian, Ethiopic, Burmese, Khmer,
# Tibetan and Mongolian writing, in this order.
STOPS = ".!?…‥。．！？｡।॥؟۔։።፧፨၊။៕។།༎᠃᠉"
SENTENCE_END = f"[{STOPS}]"
CLOSED = (*STOPS, ":", ";", "；", "：", "؛", "፤")
CLOSERS = "\"'”’»)]」』）】"
UNENDED = r"[\p{IsThai}\p{IsLao}]"
UNSPACED = r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
BOILERPLATE = r"(?i)\b(?:" + "|".join((
    "cookie (policy|settings|consent)", "uses cookies", "privacy policy", "terms of (use|service)",
    "terms and conditions", "all rights reserved", "enable javascript", "javascript is disabled",
    "click here", "read more", "sign (in|up)", "log ?in", "subscribe (now|to)", "share (on|this)",
    "follow us", "skip to (main )?content", "lorem ipsum", "page not found", "powered by", "add to cart",
)) + ")"


def repeat_words(word_list: Column) -> Column:
    """Number of words inside three-word windows that stand twice or more in the list.

    Windows are sorted by (hash, position) packed into one long. Neighbours of equal hash are only
    candidates: they are compared as text, so a hash collision never counts.
    """
    def windows(w: Column) -> Column:
        return bind(F.length(F.bin(F.size(w).cast("bigint"))), lambda bits: starts(w, bits))

    def starts(w: Column, bits: Column) -> Column:
        def pack(i: Column) -> Column:
            hashed = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", hashed, bits).bitwiseOR(i.cast("bigint"))

        def meets(p: Column) -> Column:
            pairs = F.filter(F.sequence(F.lit(0), F.size(p) - 2), lambda j: F.call_function(
                "shiftrightunsigned", F.get(p, j).bitwiseXOR(F.get(p, j + 1)), bits) == 0)
            return F.array_distinct(F.flatten(F.transform(pairs, lambda j: F.array(F.get(p, j), F.get(p, j + 1)))))

        def position(x: Column) -> Column:
            return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")

        def spelled(x: Column) -> Column:
            return bind(position(x), lambda i: F.struct(
                F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))

        def repeated(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (F.get(s, j + 1)["t"] == x["t"]) | (
                (j > 0) & (F.get(s, j - 1)["t"] == x["t"])))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), pack))
        return bind(F.sort_array(F.transform(bind(packed, meets), spelled)), repeated)

    def covered(found: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(found, none, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return bind(word_list, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(covered(windows(w))))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), ""))


def goes_on(lines: Column, at: Column) -> Column:
    """Whether the line at this place was broken only to keep its width, and the next one goes on with it."""
    own, after = F.length(F.get(lines, at)), F.get(lines, at + 1)
    width = F.greatest(*[F.length(F.get(lines, at + k)) for k in (-2, -1, 0, 1, 2)])
    return F.coalesce(own.between(*WRAPPED) & after.rlike(r"[^\x20\x09-\x0D]") & (
        own + 1 + F.length(F.regexp_extract(after, r"[^\x20\x09-\x0D]+", 0)) > width), F.lit(False))


def line_fails(line: Column, unfinished: Column | None = None) -> Column:
    """Whether a line breaks a rule; blank lines break none. Cheap tests guard the costly ones.

    A line that is ``unfinished`` (default: none is) ends in a later line.
    """
    n_words = F.size(words(line))
    short = F.length(line) <= SHORT_LINE
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    end = F.rtrim(line, F.lit(SPACE + CLOSERS))
    ended = F.lit(False) if unfinished is None else unfinished
    open_end = (~F.right(end, F.lit(1)).isin(*CLOSED) & ~F.right(end, F.lit(TAIL)).rlike(SENTENCE_END)
                & ~F.right(end, F.lit(TAIL)).rlike(UNENDED) & ~ended)
    few = (n_words <= 8) & ((F.length(line) <= FEW_CHARS) | ~line.rlike(UNSPACED))
    navigation = (bars >= 2) | (short & ~line.rlike(SENTENCE_END) & few & ~ended)
    noisy = line.rlike(SYMBOLS) & (2 * symbols(line) > n_words)
    return line.rlike(r"[^\x20\x09-\x0D]") & (open_end | navigation | noisy | (short & line.rlike(BOILERPLATE)))


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows as ``doc`` beside ``quality``: the measures, the verdict ``kept``, the remaining ``text``."""
    lines = F.split("body", "\n", -1)
    judged = bind(lines, lambda all_lines: F.transform(all_lines, lambda line, at: F.struct(
        line.alias("line"), line_fails(line, goes_on(all_lines, at)).alias("bad"))))
    spoken = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def chosen(bad: bool) -> Column:
        return F.array_join(F.transform(
            F.filter("lines", lambda x: x["bad"] if bad else ~x["bad"]), lambda x: x["line"]), "\n")

    measured = bind(words(F.col("body")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        repeat_words(w).cast("bigint").alias("n_repeat_words"),
    ))
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        "doc", "body", measured.alias("m"), judged.alias("lines"),
        bind(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup_lines"))
    n, chars, repeats = (F.col(f"m.{name}") for name in ("n_words", "word_chars", "n_repeat_words"))
    failed = (n < MIN_WORDS) | (100 * repeats > int(100 * MAX_REPEAT) * n)
    return rows.select("doc", F.struct(
        n.alias("n_words"), chars.alias("word_chars"), symbols(F.col("body")).cast("bigint").alias("n_symbols"),
        F.col("dup_lines").alias("n_dup_lines"), repeats.alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (100 * word_chars(chosen(True)) <= int(100 * MAX_LOSS) * chars)).alias("kept"),
        chosen(False).alias("text")).alias("quality"))
