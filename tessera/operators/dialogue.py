"""Classification of replies and of a conversation's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a yes, of a no (which is looked for first), and of a task that is done; the mark of an open question.
YES = (
    "是", "是的", "对", "对的", "嗯", "嗯嗯", "好", "好的", "行", "可以", "确认", "确定", "没错", "正确", "已经", "都拿到了", "拿到了", "完成",
    "完成了", "可以了", "ok", "okay", "y", "yes", "yeah",
)
NO = ("不是", "不对", "没有", "未", "没拿到", "还没", "不确定", "不用", "不行", "否")
DONE, DONE_ALONE = ("任务完成", "完成了", "我完成", "已完成", "结束", "通关", "搞定"), ("完成", "完成!", "完成。", "完成了", "完成了。")
PENDING = "__NPC_CONFIRM_PENDING__"


def _low(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def reply(text: Column) -> Column:
    """negative, affirmative or none; words count wherever they are in the text."""
    t = _low(text)
    return F.when(_any(t, NO), "negative").when(_any(t, YES), "affirmative").otherwise("none")


def says_done(text: Column) -> Column:
    t = _low(text)
    return _any(t, DONE) | t.isin(*DONE_ALONE)


def pending(turns: DataFrame, key: str) -> DataFrame:
    """(key, pending): whether the assistant has asked for a confirmation."""
    asked = (F.col("role") == "assistant") & F.contains(F.coalesce("text", F.lit("")), F.lit(PENDING))
    return turns.groupBy(key).agg(F.coalesce(F.bool_or(asked), F.lit(False)).alias("pending"))


def confirmed(turns: DataFrame, key: str, order: str) -> DataFrame:
    """(key, confirmed): whether the user's last turn says yes where a confirmation is pending."""
    last = turns.where("role = 'user'").groupBy(key).agg(F.max_by("text", order).alias("said"))
    return pending(turns, key).join(last, key, "left").select(key, (F.col("pending") & (reply(F.col("said")) == "affirmative")).alias("confirmed"))
