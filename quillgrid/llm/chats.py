"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events of conversations: a `message` opens a message, `delta`s append to it, an `edit` replaces its text, a
`regenerate` empties it for the deltas that follow. Edits and regenerations also withdraw the messages opened between the
message and themselves. `fold` turns the log into final messages, `render` into marked turns with their loss mask, and
`parsed` reads turns back. A message is folded by itself and a conversation in blocks of sequence numbers, so that no
conversation, however long, is sorted in one task; `assembled` joins the blocks' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sequence numbers of a block.
BLOCK = 1024
#: Code points of a streamed part.
PART = 512
START, COLON, END = "### ", ": ", "</turn>\n"
_LEAST = -(2**63)


def escaped(text: Column) -> Column:
    """text without the template's marks; a backslash stands before what it changed."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("###"), F.lit("\\###"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def log_of(rows: DataFrame, part: int = PART) -> DataFrame:
    """The log that messages (conv_id, turn, role, text) give when assistants' texts are streamed in parts of so many code points.

    Each row is a message of its own, repeated ones included; null text is empty.
    """
    text, streamed = F.coalesce(F.col("text"), F.lit("")), F.col("role") == "assistant"
    whole = F.struct(F.lit(0).alias("part"), F.lit("message").alias("kind"), F.when(streamed, "").otherwise(text).alias("text"))
    parts = F.transform(F.sequence(F.lit(1), F.ceil(F.length(text) / part).cast("int")), lambda k: F.struct(k.alias("part"), F.lit("delta").alias("kind"), F.substr(text, (k - 1) * part + 1, F.lit(part)).alias("text")))
    events = F.when(streamed & (text != ""), F.concat(F.array(whole), parts)).otherwise(F.array(whole))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("seq"), F.monotonically_increasing_id().alias("message"), "role", events.alias("events"))
    own = own.select("conv_id", "seq", "message", "role", F.explode("events").alias("e"))
    return own.select("conv_id", "seq", "e.part", "message", "e.kind", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text")


def _events(log: DataFrame) -> DataFrame:
    seq, part = F.coalesce(F.col("seq").cast("long"), F.lit(_LEAST)), F.coalesce(F.col("part").cast("long"), F.lit(_LEAST))
    return log.select("conv_id", "message", "kind", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(seq.alias("seq"), part.alias("part")).alias("at"))


def _block(at: str) -> Column:
    return F.floor(F.col(f"{at}.seq") / BLOCK)


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, block, at, message, role, text): the messages that a log (conv_id, seq, part, message, kind, role, text) leaves.

    Events of a message come by (seq, part); of equal ones deltas come last, then they go by text. A message's first
    `message` event gives its place and role, a later one replaces its text as an edit does; events of messages that no
    event opens say nothing, as their place is unknown. Null seq and part come first, null text is
    empty, null role stays, null conv_id and message are ids of their own; events of other kinds say nothing. Repeated
    events count as often; an empty log gives no rows.
    """
    events = _events(log).filter(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    opens = F.when(F.col("kind") == "message", F.col("at"))
    anew = F.when(F.col("kind") != "delta", F.col("at"))
    said = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    own = events.groupBy("conv_id", "message").agg(
        F.min(opens).alias("at"),
        F.min(F.when(F.col("kind") == "message", F.struct("at", "role"))).alias("first"),
        F.max(anew).alias("anew"),
        F.sort_array(F.collect_list(F.struct("at", F.when(F.col("kind") == "delta", 1).otherwise(0).alias("rank"), said.alias("text")))).alias("parts"),
    )
    kept = F.filter("parts", lambda e: e["at"] >= F.col("anew"))
    # of several events that begin anew at one place, the last one counts
    begins = F.coalesce(F.get(F.filter(kept, lambda e: e["rank"] == 0), F.size(F.filter(kept, lambda e: e["rank"] == 0)) - 1)["text"], F.lit(""))
    text = F.concat(begins, F.array_join(F.transform(F.filter(kept, lambda e: e["rank"] == 1), lambda e: e["text"]), ""))
    messages = own.filter(F.col("at").isNotNull()).select("conv_id", _block("at").alias("block"), "at", "message", F.col("first.role").alias("role"), text.alias("text"))
    return _standing(messages, events)


def _standing(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Without the messages that a later edit or regeneration of an earlier message withdraws."""
    last = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at")))
    narrow = events.groupBy("conv_id", "message").agg(F.min(F.when(F.col("kind") == "message", F.col("at"))).alias("a"), last.alias("cut")).filter(F.col("a").isNotNull())
    cuts = narrow.groupBy(F.col("conv_id").alias("c"), _block("a").alias("b"), "a").agg(F.max("cut").alias("cut"))
    blocks = cuts.groupBy(F.col("c").alias("bc"), F.col("b").alias("bb")).agg(F.max("cut").alias("cut"))
    earlier = Window.partitionBy("bc").orderBy("bb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("bc", "bb", F.max("cut").over(earlier).alias("before"))
    within = Window.partitionBy("c", "b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select("c", "b", "a", F.max("cut").over(within).alias("here")).join(blocks, F.col("c").eqNullSafe(F.col("bc")) & (F.col("b") == F.col("bb")))
    gone = cuts.filter(F.greatest("here", "before") > F.col("a")).select("c", "b", "a")
    return messages.join(gone, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("at") == F.col("a")), "left_anti")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """messages with turn (the marked text) and its loss mask: mask_start and mask_length in code points, null where no loss is taken.

    A turn reads `### role: text</turn>` and a line end, with marks inside role and text escaped. Null role and text are
    empty; rows are independent, so ties, repeated rows and empty tables need nothing.
    """
    role = F.replace(escaped(F.coalesce(F.col("role"), F.lit(""))), F.lit(":"), F.lit("\\:"))
    head, text = F.concat(F.lit(START), role, F.lit(COLON)), escaped(F.coalesce(F.col("text"), F.lit("")))
    mask = F.coalesce(F.col("role"), F.lit("")) == trained
    out = messages.withColumn("turn", F.concat(head, text, F.lit(END)))
    return out.withColumns({"mask_start": F.when(mask, F.length(head)), "mask_length": F.when(mask, F.length(text))})


def parsed(rendered: DataFrame) -> DataFrame:
    """rendered with role, text and loss_text (null outside the mask) read back from turn and mask."""
    body = F.substr("turn", F.lit(len(START) + 1), F.length("turn") - len(START) - len(END))
    role = F.regexp_extract(body, r"(?s)^((?:[^\\:]|\\.)*)" + COLON, 1)
    text = F.substr(body, F.length(role) + len(COLON) + 1, F.length(body))
    loss = F.when(F.col("mask_start").isNotNull(), F.substr("turn", F.col("mask_start") + 1, F.col("mask_length")))
    return rendered.select(*[c for c in rendered.columns if c not in ("role", "text")], unescaped(role).alias("role"), unescaped(text).alias("text"), unescaped(loss).alias("loss_text"))


def assembled(turns: DataFrame, **texts: Column) -> DataFrame:
    """Per conversation: turns, chars (code points of the whole) and the named texts, each its rows' texts in order.

    turns needs conv_id, block, at, message, role, turn. Equal places are ordered by role, turn and message. A block's
    texts are joined before a conversation's are.
    """
    row = F.struct("at", "role", F.col("turn").alias("said"), "message", *[F.coalesce(c, F.lit("")).alias(k) for k, c in texts.items()])
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum(F.length("turn")).alias("chars"), F.sort_array(F.collect_list(row)).alias("rows"))
    blocks = blocks.select("conv_id", "n", "chars", F.struct("block", *[F.array_join(F.col("rows")[k], "").alias(k) for k in texts]).alias("own"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("turns"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list("own")).alias("rows"))
    return whole.select("conv_id", "turns", "chars", *[F.array_join(F.col("rows")[k], "").alias(k) for k in texts])


def formatted(log: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turns, chars, formatted, spans): whole conversations of a log.

    spans: of each turn in order its chars, and start and length of its loss mask in code points from the turn's start
    (null where no loss is taken). Nulls, ties and empty logs as in fold and render.
    """
    turns = render(fold(log), trained)
    span = F.concat_ws(",", F.length("turn"), F.coalesce("mask_start", F.lit(-1)), F.coalesce("mask_length", F.lit(-1)))
    whole = assembled(turns, formatted=F.col("turn"), spans=F.concat(span, F.lit(";")))
    known = lambda v: F.when(v.cast("long") >= 0, v.cast("long"))
    cells = F.transform(F.split(F.rtrim("spans", F.lit(";")), ";"), lambda s: F.split(s, ","))
    return whole.withColumn("spans", F.transform(cells, lambda c: F.struct(known(c[0]).alias("chars"), known(c[1]).alias("start"), known(c[2]).alias("length"))))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns whose text looks like the template."""
    turn = F.col("id")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The rows become a log, the log messages, these turns; roles, texts and loss are read back from the turns. Null text
    is empty text, null role an empty role, null turns come first, null conv_id is a conversation; repeated rows are
    turns of their own; further columns are not read; an empty table gives no rows.
    """
    back = parsed(render(fold(log_of(rows))))
    whole = assembled(back, all=F.concat("role", F.lit("\n"), "text", F.lit("\n")), loss=F.col("loss_text"))
    return whole.select("conv_id", F.col("turns").alias("n_turns"), F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
