"""Query of line-first cleaning over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm import quality as q
from brainstate.llm.common import table

NAME = "op7_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return q.with_quality(docs).select(
        "doc_id",
        *[
            F.col(f"quality.{name}")
            for name in (
                "n_words",
                "word_chars",
                "n_symbols",
                "n_dup_lines",
                "n_repeat_words",
                "n_failed_lines",
                "base_failed",
                "kept",
            )
        ],
    )


def _count(text: str, chars: str) -> str:
    escaped = "".join("\\" + c if c.isascii() else c for c in chars)
    return f"(length({text}) - length(regexp_replace({text}, '[{escaped}]', '', 'g')))"


_WORD = r"[^\x20\x09-\x0D]+"
_N = f"len(regexp_extract_all(x, '{_WORD}'))"
_VISIBLE = r"length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))"
_PHRASES = " or ".join(f"contains(lower(x), '{p}')" for p in q.BOILERPLATE)
_FAILS = rf"""(
    ({_count("x", q.SEPARATORS)} >= 3
     and {_count("x", q.SEPARATORS)} * {q.WORDS_PER_SEPARATOR} >= {_N})
    or {_count("x", q.SYMBOLS)} * 100 > {_VISIBLE} * {q.MAX_SYMBOL_PERCENT}
    or ({_N} <= {q.STUB_WORDS}
        and not regexp_matches(x, '[.!?:;…"''”’»)。！？][\x20\x09-\x0D]*$'))
    or ({_N} <= {q.BOILERPLATE_WORDS} and ({_PHRASES})))"""

SQL = rf"""
with r as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{_WORD}')) as l
  from documents),
g as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from r where len(w) >= 3)),
c as (select rid, i, count(*) over (partition by rid, gram) as n from g),
p as (
  select rid, count(distinct k) as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as k from c where n >= 2)
  group by rid),
s as (
  select r.*, list_filter(l, lambda x: not {_FAILS}) as good,
         coalesce(p.n_repeat_words, 0) as n_repeat_words
  from r left join p using (rid)),
f as (
  select doc_id, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         {_count("t", "#*$%&|<>")}::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         n_repeat_words::bigint as n_repeat_words,
         (len(l) - len(good))::bigint as n_failed_lines,
         coalesce(list_sum(list_transform(good, lambda x: {_VISIBLE})), 0)::bigint as kept_chars
  from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
       (n_words < {q.MIN_WORDS}
        or n_repeat_words * 100 > n_words * {q.MAX_REPEATED_PERCENT}) as base_failed,
       not (n_words < {q.MIN_WORDS}
            or n_repeat_words * 100 > n_words * {q.MAX_REPEATED_PERCENT})
       and kept_chars * 100 >= word_chars * {q.MIN_KEPT_PERCENT} as kept
from f
"""
