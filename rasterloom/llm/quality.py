"""Line-first quality rules with DataFrame functions only.

Each line with a word is judged by itself: it must end like a sentence (punctuation), must not be a row of separated
links (navigation), shout, consist of symbols, or hold a stock phrase of web pages (boilerplate). Lines that fail are
removed. A document is rejected when it loses too large a part of its text that way, or fails the base rules: too few
words, or too many words in five-word windows that the text repeats.

The repeated windows are found inside the row, without a shuffle: 32-bit window hashes and places are packed into one
sorted array of longs, only windows whose hash occurs again are compared as text. The work of a text of n words is
n log n, its memory proportional to n.

Defined results: a null or empty text has no lines and no words, fails the base rules and is not kept; repeated rows are
judged alike; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rules of a line (fixed values). Counts are compared with the number of blanks of the line plus one.
END = r"[.!?:;…\"')\]»”][\x20\x09-\x0D]*$"
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = ("(?i)all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|sign (in|up)|log ?in to|subscribe (to|now)|"
               "click here|read more|enable javascript|lorem ipsum|share this|skip to (main )?content|back to top|add to cart")
WINDOW = 5


def _count(line: Column, part: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(part), F.lit("")))) / len(part)


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule."""
    blanks = _count(line, " ") + 1
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    return (~line.rlike(END) | (_count(line, "|") * 4 > blanks) | (_count(line, "!!") * 4 > blanks) | (symbols * 2 > blanks) | line.rlike(BOILERPLATE))


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more; ``words`` must be a lambda variable or a plain column."""
    n = F.size(words)
    code = lambda i: F.hash(*[F.get(words, i + k) for k in range(WINDOW)]).cast("bigint")
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.shiftleft(code(i), 32).bitwiseOR(i.cast("bigint"))))
    top = lambda a, j: F.shiftright(F.get(a, j), 32)
    again = lambda a: F.filter(a, lambda x, j: (F.shiftright(x, 32) == F.coalesce(top(a, j - 1), F.lit(1 << 40)))
                               | (F.shiftright(x, 32) == F.coalesce(top(a, j + 1), F.lit(1 << 40))))
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    named = lambda a: F.sort_array(F.transform(again(a), lambda x: F.struct(F.array_join(F.slice(words, place(x) + 1, WINDOW), " ").alias("s"), place(x).alias("p"))))
    text = lambda e, j: F.get(e, j)["s"]
    same = lambda e: F.sort_array(F.transform(F.filter(e, lambda x, j: (x["s"] == F.coalesce(text(e, j - 1), F.lit(""))) | (x["s"] == F.coalesce(text(e, j + 1), F.lit("")))),
                                              lambda x: x["p"]))
    reach = lambda q: F.aggregate(F.transform(q, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(q, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    covered = let(packed, lambda a: let(named(a), lambda e: let(same(e), reach)))
    return F.when(n >= WINDOW, covered).otherwise(0).cast("bigint")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20,
            max_loss: float = 0.4) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, loss, cleaned, kept).

    ``cleaned`` is the text without failing lines, ``loss`` the share of characters of non-blank lines that went with them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_word = let(F.array_remove(F.split(text, SPACE_RUN), ""), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    by_line = let(full, lambda a: let(F.filter(a, lambda x: ~line_fails(x)), lambda ok: F.struct(
        (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"), F.size(a).cast("bigint").alias("n_lines"),
        (F.size(a) - F.size(ok)).cast("bigint").alias("n_failed_lines"),
        F.when(F.size(a) > 0, 1 - chars(ok) / chars(a)).otherwise(F.lit(0.0)).alias("loss"), F.array_join(ok, "\n").alias("cleaned"))))
    n_symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint")
    out = docs.select(F.col(id_col).alias("doc_id"), by_word.alias("w"), by_line.alias("l"), n_symbols.alias("n_symbols"))
    failed = (F.col("w.n_words") < min_words) | (100 * F.col("w.n_repeat_words") > max_repeat_pct * F.col("w.n_words"))
    return out.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "l.n_lines",
                      "l.n_failed_lines", "l.loss", "l.cleaned", (~failed & (F.col("l.loss") <= max_loss)).alias("kept"))
