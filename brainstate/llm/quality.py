"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged on its own by rules on punctuation, navigation
and boilerplate. Lines that fail are removed, and a document that loses too
much of its text by that is rejected. Everything is a projection of the row:
no shuffle, no Python.

Defined results: a null text counts as empty, has no words and is rejected
(fewer than 50 words). Repeated rows are judged one by one. Other columns of the
input don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainstate.llm.common import BLANKS, GAP, WORD

#: Characters that separate the entries of menus and breadcrumbs.
SEPARATORS = "|»›•·"
#: Characters of mark-up and code that prose has few of.
SYMBOLS = "#*$%&<>@=_~^{}[]\\"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up for",
    "log in to",
    "subscribe to our",
    "share this page",
    "powered by",
)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line fails with a separator for every so many words, from three separators on.
WORDS_PER_SEPARATOR = 4
#: A line fails with more than so many symbols per hundred visible characters.
MAX_SYMBOL_PERCENT = 10
#: A line of at most so many words with no closing punctuation is a menu entry or a stub.
STUB_WORDS = 4
#: A boilerplate phrase fails a line of at most so many words.
BOILERPLATE_WORDS = 25
#: A document is rejected if it keeps less than so many percent of its word characters.
MIN_KEPT_PERCENT = 60


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _one_of(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def _more_words(line: Column, n: int) -> Column:
    """True if line has more than n words; reads no further than that."""
    return line.rlike(rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{{n + 1}}}")


def line_fails(line: Column) -> Column:
    """True if a line, which has a word, breaks one of the rules.

    The cheap tests come first: few lines need their words or symbols counted.
    """
    navigation = (_count(line, SEPARATORS) >= 3) & (
        _count(line, SEPARATORS) * WORDS_PER_SEPARATOR >= F.regexp_count(line, F.lit(WORD))
    )
    symbols = _count(line, SYMBOLS) * 100 > F.length(_without(line, BLANKS)) * MAX_SYMBOL_PERCENT
    stub = ~_more_words(line, STUB_WORDS) & ~line.rlike(r"[.!?:;…\"'”’»)。！？][\x20\x09-\x0D]*$")
    phrase = F.lit(False)
    for text in BOILERPLATE:
        phrase = phrase | F.contains(F.lower(line), F.lit(text))
    return (
        (line.rlike(_one_of(SEPARATORS + SYMBOLS)) & (navigation | symbols))
        | stub
        | (~_more_words(line, BOILERPLATE_WORDS) & phrase)
    )


def with_quality(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add the struct column `out` to docs, or replace it: the counts, cleaned_text, base_failed and kept."""
    # The row is carried as one column, so that no name of the input can clash.
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    row = docs.select(carried.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = row.withColumns(
        {
            "words": F.when(~F.col("text").rlike(WORD), F.array().cast("array<string>")).otherwise(
                F.split(F.btrim("text", F.lit(BLANKS)), GAP)
            ),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)),
        }
    )
    row = row.withColumns(
        {
            "n_words": F.size("words"),
            "kept_lines": F.filter("lines", lambda x: ~line_fails(x)),
        }
    )
    words, windows, marked, starts = map(F.col, ("words", "windows", "marked", "starts"))
    row = row.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.slice("words", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Windows sorted by hash stand next to their equals; only texts that have equals are sorted.
    row = row.withColumn(
        "marked",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")),
    )
    row = row.withColumn(
        "starts",
        F.transform(
            F.filter(
                marked,
                lambda e, j: F.coalesce(F.get(marked, j + 1)["g"] == e["g"], F.lit(False))
                | F.coalesce(F.get(marked, j - 1)["g"] == e["g"], F.lit(False)),
            ),
            lambda e: e["i"],
        ),
    )
    repeated = F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2))
    row = row.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")),
            "n_symbols": F.when(
                F.col("text").rlike(_one_of("#*$%&|<>")), _count(F.col("text"), "#*$%&|<>")
            ).otherwise(0),
            "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
            "n_repeat_words": F.size(F.array_distinct(repeated)),
            "n_failed_lines": F.size("lines") - F.size("kept_lines"),
            "cleaned_text": F.array_join("kept_lines", "\n"),
        }
    )
    row = row.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT),
    )
    lost_too_much = (
        F.length(_without(F.col("cleaned_text"), BLANKS)).cast("long") * 100
        < F.col("word_chars").cast("long") * MIN_KEPT_PERCENT
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines")
    quality = F.struct(
        *[F.col(k).cast("long").alias(k) for k in counts],
        "cleaned_text",
        "base_failed",
        (~F.col("base_failed") & ~lost_too_much).alias("kept"),
    )
    # Exploding an array of one keeps filters on the result above the steps: pushed below
    # them, they would hold every step's expression many times over.
    return row.select("row", F.explode(F.array(quality)).alias("quality")).select("row.*", F.col("quality").alias(out))
