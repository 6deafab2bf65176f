"""Chat requests and conversations as columns (ops 21-26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
_OBJECT = T.StructType([
    T.StructField("messages", MESSAGES),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("num_attempts", T.IntegerType()),
    T.StructField("max_attempts", T.IntegerType()),
])


def parse_requests(df: DataFrame, col: str = "request") -> DataFrame:
    """Request JSON -> ``messages array<struct<role,content>>`` plus attempts (op 21).

    Accepts an object with ``messages``, a bare list of messages, or one message.
    A list starts with '['; an object is parsed once and is a single message when it
    has no ``messages`` field."""
    s = F.ltrim(F.col(col))
    obj = F.from_json(F.col(col), _OBJECT)
    as_list = F.from_json(F.col(col), MESSAGES)
    single = F.array(F.struct(obj["role"].alias("role"), obj["content"].alias("content")))
    messages = (F.when(F.startswith(s, F.lit("[")), as_list)
                .when(obj["messages"].isNotNull(), obj["messages"])
                .when(obj["role"].isNotNull() | obj["content"].isNotNull(), single))
    is_obj = F.startswith(s, F.lit("{"))
    return df.withColumns({
        "messages": messages,
        "num_attempts": F.when(is_obj, obj["num_attempts"]),
        "max_attempts": F.when(is_obj, obj["max_attempts"]),
    })


def first_user_content(messages: str = "messages"):
    """Content of the first message with role 'user' in an array column."""
    return F.try_element_at(F.filter(F.col(messages), lambda m: m["role"] == "user"), F.lit(1))["content"]


def first_user_message(conversations: DataFrame, key: str = "conv_id", turn: str = "turn",
                       role: str = "role", text: str = "text", out: str = "question") -> DataFrame:
    """First user message per conversation from the long form (op 22).

    One partial aggregate: ``min_by`` skips rows whose ordering value is null, so
    non-user turns never win, and conversations without a user turn get null.
    Map-side combine keeps a hot conversation from landing whole in one task."""
    user_turn = F.when(F.col(role) == "user", F.col(turn))
    return conversations.groupBy(key).agg(F.min_by(F.col(text), user_turn).alias(out))


def split_valid(df: DataFrame, question: str = "question") -> DataFrame:
    """Rows without a question, or whose first user message is empty, carry the error
    text; others carry null (op 23). Use ``error IS NULL`` to split."""
    bad = F.col(question).isNull() | (F.col(question) == "")
    return df.withColumn("error", F.when(bad, F.lit(settings.NO_USER_MESSAGE)))


def with_defaults(df: DataFrame) -> DataFrame:
    """``num_attempts`` default 0 and ``max_attempts`` default 3 (op 24)."""
    return df.withColumns({
        "num_attempts": F.coalesce(F.col("num_attempts"), F.lit(settings.DEFAULT_NUM_ATTEMPTS)),
        "max_attempts": F.coalesce(F.col("max_attempts"), F.lit(settings.DEFAULT_MAX_ATTEMPTS)),
    })


def transcript(turns: DataFrame) -> DataFrame:
    """Chat history replayed as role + content, one row per turn (op 25).

    ``turns`` carries ``pos``, the replay position of each row in its session
    (``operators.order.with_position``). History stays in long form: nothing is gathered into one
    row, and a very long session never has to fit in one task."""
    return turns.select(
        "conv_id", "pos", "turn", "role", F.col("text").alias("content"),
        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))


def reply_or_error(history: DataFrame, replies: DataFrame) -> DataFrame:
    """Store each model reply as the next assistant turn; a failed call becomes the fixed
    error text (op 26). Returns history plus the new turns."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    new = (replies.join(last, "conv_id", "left")
           .select("conv_id",
                   (F.coalesce(F.col("last_turn"), F.lit(-1)) + 1).alias("turn"),
                   F.lit("assistant").alias("role"),
                   F.when(F.col("error").isNotNull() | F.col("reply").isNull(), F.lit(settings.UI_ERROR_REPLY))
                   .otherwise(F.col("reply")).alias("text")))
    return history.select("conv_id", "turn", "role", "text").unionByName(new)
