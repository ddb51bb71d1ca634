"""Text, time and JSON columns (SC1 to SC8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of the memory text, and what an open one ends with.
END_LINE, TOTAL_LINE = "【结束时间】: ", "【持续总时长】: "
OPEN_MARK = "[状态持续中...]"
TIME_FORMAT = "yyyy'年'MM'月'dd'日' HH'时'mm'分'ss'秒'"
DATA_URL = "data:image/jpeg;base64,"


def cn_timestamp(ts: Column) -> Column:
    """SC3: a time in Chinese, in the session's time zone."""
    return F.date_format(ts, TIME_FORMAT)


def cn_duration(seconds: Column) -> Column:
    """SC4: whole seconds as minutes and seconds."""
    m, s = F.floor(seconds / 60), seconds % 60
    return F.when(m > 0, F.concat(m.cast("string"), F.lit("分"), s.cast("string"), F.lit("秒"))).otherwise(
        F.concat(s.cast("string"), F.lit("秒"))
    )


def memory_text_open(state: Column, start: Column, advice: Column) -> Column:
    """SC1: the document of an event that goes on."""
    return F.concat(
        F.lit("【状态】: "), state, F.lit("\n【开始时间】: "), cn_timestamp(start),
        F.lit("\n【当时AI分析/环境推断】: "), advice, F.lit(f"\n{END_LINE}{OPEN_MARK}"),
    )


def memory_text_close(document: Column, end: Column, seconds: Column) -> Column:
    """SC2: the document with its open end line replaced by the end and the duration; the mark elsewhere stays."""
    closing = F.concat(F.lit(END_LINE), cn_timestamp(end), F.lit(f"\n{TOTAL_LINE}"), cn_duration(seconds))
    return F.replace(document, F.lit(END_LINE + OPEN_MARK), closing)


def speech_text(text: Column) -> Column:
    """SC5: marks, brackets and characters beyond the basic plane become one blank each."""
    out = F.regexp_replace(text, r"[*#_~`]", " ")
    out = F.regexp_replace(out, r"[\[\]{}]", " ")
    return F.regexp_replace(out, r"[\x{10000}-\x{10FFFF}]", " ")


def json_string(text: Column) -> Column:
    """SC6: the text as a JSON string."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def flatten_output(parts: Column) -> Column:
    """SC7: the texts of an array of structs with `text`, joined; null texts are empty."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def image_data_url(image: Column) -> Column:
    """SC8: a data URL of the bytes of a JPEG; null stays null."""
    return F.concat(F.lit(DATA_URL), F.translate(F.base64(image), "\r\n", ""))


def image_bytes(url: Column) -> Column:
    """SC8, the way back."""
    return F.unbase64(F.substring(url, F.lit(len(DATA_URL) + 1), F.length(url)))


def size_kb(image: Column) -> Column:
    """SC8: size of the bytes in KB."""
    return F.length(image) / 1024
