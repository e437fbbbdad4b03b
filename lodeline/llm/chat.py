"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events (conv_id, message, seq, at, kind, role, text) is folded message by message, in the order of seq, then at: `message` and `edit` set the text,
`delta` appends to it, `regenerate` empties it. Messages stand in the order of their first event. Each becomes
`<|im_start|>role\\ntext<|im_end|>\\n`; `&` and `<|` inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)
PROBE = "<|im_end|><|im_start|>assistant ok"
#: Characters of a streamed delta, and of a draft that is given up.
DELTA, DRAFT = 256, 32


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, role, text): each message's final state; null texts count as empty.

    Events of one seq and at (a log may do without at) are taken in the order of kind, then text. The last role given holds. A message's log is
    gathered in one row, as its text will be.
    """
    at = F.col("at") if "at" in events.columns else F.lit(0)
    log = F.array_sort(F.collect_list(F.struct("seq", at.alias("at"), "kind", F.coalesce("text", F.lit("")).alias("text"), "role")))
    by_message = events.groupBy("conv_id", "message").agg(log.alias("log"))
    # What holds is the last event that sets or empties the text, and the deltas after it, joined once.
    last = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e.kind != "delta", i))), F.lit(-1))
    by_message = by_message.withColumn("last", last)
    base = F.when((F.col("last") >= 0) & (F.get("log", F.col("last")).kind != "regenerate"), F.get("log", F.col("last")).text).otherwise("")
    deltas = F.transform(F.slice("log", F.col("last") + 2, F.size("log")), lambda e: e.text)
    role = F.get(F.reverse(F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())), F.lit(0))
    return by_message.select("conv_id", "message", F.col("log")[0].seq.alias("seq"), F.coalesce(role, F.lit("")).alias("role"), F.concat(base, F.array_join(deltas, "")).alias("text"))


def rendered(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask has (turn, start, length), in code points of formatted, of each text under loss.

    A conversation is one row, and so one string below 2 GB, by its nature.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message")
    m = messages.withColumns({"turn": F.row_number().over(order) - 1, "head": F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n")), "body": escaped(F.col("text"))})
    m = m.withColumn("size", F.length("head") + F.length("body") + len(STOP))
    m = m.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    piece = F.struct("turn", F.concat("head", "body", F.lit(STOP)).alias("piece"), F.col("role").isin(*loss_roles).alias("loss"), "start", F.length("body").alias("length"))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.turn.alias("turn"), t.start.alias("start"), t.length.alias("length")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from (conv_id, formatted, loss_mask) alone: roles and texts as they were."""
    pieces = formatted.withColumn("pieces", F.split("formatted", r"<\|im_end\|>\n"))
    pieces = pieces.withColumn("pieces", F.slice("pieces", 1, F.size("pieces") - 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(_unescaped_role(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescaped(F.substr(p, F.length(head) + 2)).alias("text"), (F.length(p) - F.length(head) - 1).alias("length"))

    turns = pieces.withColumn("turns", F.transform("pieces", turn))
    loss = F.transform("loss_mask", lambda m: F.when(F.get("turns", m.turn).length == m.length, F.get("turns", m.turn).text).otherwise(F.raise_error(F.lit("the loss mask doesn't fit the text"))))
    return turns.select("conv_id", "turns", loss.alias("loss_texts"), "formatted")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The logs that rows of conversations, each a message of its own, would have left: an assistant's begins empty, streams a draft, is regenerated and streamed
    again in deltas; another's is given as a draft and then edited. Rows of one turn stand in the order of role, then text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("message"), F.col("turn").cast("long").alias("seq"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def event(at: Column, kind: str, text: Column, role: Column | None = None) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    draft = F.substring("text", 1, DRAFT)
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    closed = F.when(F.length("text") % DELTA == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))  # a stream ends with a delta that isn't full
    pieces = F.transform(F.concat(cut, closed), lambda x, i: event(i + 3, "delta", x))
    streamed = F.concat(F.array(event(F.lit(0), "message", F.lit(""), F.col("role")), event(F.lit(1), "delta", draft), event(F.lit(2), "regenerate", F.lit(""))), pieces)
    edited = F.array(event(F.lit(0), "message", draft, F.col("role")), event(F.lit(1), "edit", F.col("text")))
    log = rows.select("conv_id", "message", "seq", F.explode(F.when(F.col("role").isin(*LOSS_ROLES), streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "message", "seq", "e.at", "e.kind", "e.role", "e.text")


def formatted(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) rendered. Null texts and roles are empty, a null turn stands first,
    rows without conv_id are one conversation, repeated rows are turns of their own; no rows give none."""
    return rendered(folded(conversation_events(conversations)))


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(probe)
    back = read_back(formatted(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.array_join("loss_texts", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"
ORACLE = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(START) + 1 + len(STOP)} + length(replace({_ESCAPED.format('role')}, chr(10), '&nl;')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
