"""Chat formatting in budgeted windows, by prefix sums of turn tokens.

Method. Turns are put in order and their tokens summed up. The sums are cut into cells of the target budget:
turns inside a cell make one window, a turn across a border makes a window of its own, so
spans are aligned to turns and hold no more than the budget unless one turn alone does.
Every window starts with the conversation's system turn and repeats the turns of
the last ``HISTORY`` tokens before it; both are masked, so each assistant text
is a target once. Only DataFrame functions are used.

Template of a turn: ``### role: text </turn>`` and a line feed. In roles and texts a backslash
becomes ``\\s``, ``<`` becomes ``\\l``, ``#`` becomes ``\\h`` (and ``:`` in roles ``\\c``), so no
control string occurs inside, and undoing the replacements gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TARGET = 1024
HISTORY = 256
#: Tokens counted for the marks around a turn.
MARKS = 4
#: Turns per block of the two-level prefix sums.
BLOCK = 64
END = " </turn>\n"
_TOKEN = r"\p{L}+|\p{N}+|[^ \t\n\r\f\x0B\p{L}\p{N}]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\s"), F.lit("\\"))


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with their number and the tokens before and after them in the conversation.

    Order: turn (null first), role, text; equal rows stay separate turns. Sums are taken inside blocks of turns and then over
    blocks, so a long conversation is not sorted in one task. A leading system turn
    has number 1, is marked ``lead`` and is not counted.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 60))).alias("block"),
    ).withColumn("cost", F.regexp_count("text", F.lit(_TOKEN)).cast("long") + MARKS)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    sums = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"place": F.row_number().over(inside), "before": F.coalesce(F.sum("cost").over(sums), F.lit(0))})
    blocks = rows.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("size"), F.sum("cost").alias("total"),
        F.max(F.when(F.col("place") == 1, F.struct("role", "cost"))).alias("first"),
    )
    along = Window.partitionBy("conv_id").orderBy("block")
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("first").over(along.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("earlier"),
        F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"),
        F.when(head["role"] == "system", head["cost"]).otherwise(F.lit(0)).alias("skipped"),
    )
    joined = rows.join(blocks, rows.conv_id.eqNullSafe(blocks.c) & (rows.block == blocks.b))
    number = F.col("earlier") + F.col("place")
    lead = (number == 1) & (F.col("skipped") > 0)
    start = F.when(lead, F.lit(0)).otherwise(F.col("offset") + F.col("before") - F.col("skipped"))
    return joined.select(
        "conv_id", number.alias("number"), "role", "text", "cost", lead.alias("lead"), start.alias("start"), (start + F.col("cost")).alias("end")
    )


def windows(turns: DataFrame, target: int = TARGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows: ``conv_id, window, text, n_context, loss, n_tokens``.

    ``text`` holds the system turn, repeated history and the span's turns; the first ``n_context`` turns are repeats.
    ``loss`` lists the places (in characters, from 0) and lengths of the assistant texts of the span. A conversation's windows are in the order of
    ``window``; a conversation of a system turn alone has one window.
    """
    rows = ordered(turns)
    cell = F.floor(F.col("start") / target)
    across = (F.col("end") > (cell + 1) * target).cast("long")
    rows = rows.withColumn("window", F.when(F.col("lead"), F.lit(-1)).otherwise(2 * cell + across))
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    piece = F.struct(
        F.concat(F.lit("### "), role, F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("answer"),
    )
    rows = rows.select("conv_id", "number", "cost", "lead", "start", "end", "window", piece.alias("piece"))
    spans = rows.where("not lead").groupBy("conv_id", "window").agg(F.min("start").alias("from"))
    targets = rows.where("not lead").select("conv_id", "window", F.lit(2).alias("kind"), "number", "cost", "piece")
    # Repeated history starts at most `history` tokens before the span: it lies in one of two buckets.
    bucket = lambda at: F.floor(at / history)
    wanted = spans.where("from > 0").select(
        F.col("conv_id").alias("c"), F.col("window").alias("w"), "from",
        F.explode(F.array_distinct(F.array(bucket(F.col("from") - history), bucket(F.col("from"))))).alias("bucket"),
    )
    past = rows.where("not lead").withColumn("place", bucket(F.col("start")))
    repeats = past.join(
        wanted,
        past.conv_id.eqNullSafe(wanted.c) & (past.place == wanted.bucket)
        & (past.start >= wanted["from"] - history) & (past.end <= wanted["from"]),
    ).select("conv_id", F.col("w").alias("window"), F.lit(1).alias("kind"), "number", "cost", "piece")
    lead = rows.where("lead").select(F.col("conv_id").alias("c"), "number", "cost", "piece")
    leading = lead.join(spans, lead.c.eqNullSafe(spans.conv_id), "left").select(
        F.col("c").alias("conv_id"),
        F.coalesce("window", F.lit(0)).alias("window"),
        # The first window has the system turn as its own, the others repeat it.
        F.when(F.coalesce("from", F.lit(0)) == 0, F.lit(2)).otherwise(F.lit(0)).alias("kind"),
        "number", "cost", "piece",
    )
    turns_of = F.array_sort(F.collect_list(F.struct("kind", "number", "piece")))
    grouped = targets.union(repeats).union(leading).groupBy("conv_id", "window").agg(
        turns_of.alias("turns"), F.sum((F.col("kind") < 2).cast("int")).alias("n_context"), F.sum("cost").alias("n_tokens")
    )
    full = lambda x: F.concat(x["piece"]["head"], x["piece"]["body"], F.lit(END))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,length:bigint>>").alias("spans"))
    marked = F.aggregate(
        "turns",
        empty,
        lambda s, x: F.struct(
            (s["at"] + F.length(full(x))).cast("long").alias("at"),
            F.when(
                x["piece"]["answer"] & (x["kind"] == 2),
                F.concat(s["spans"], F.array(F.struct(
                    (s["at"] + F.length(x["piece"]["head"])).cast("long").alias("at"),
                    F.length(x["piece"]["body"]).cast("long").alias("length"),
                ))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("turns", full), "").alias("text"), "n_context",
        marked["spans"].alias("loss"), "n_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: its own turns ``turns`` (role, text), and ``targets``, the texts under the loss mask."""
    parts = F.slice(F.split("text", END), F.col("n_context") + 1, F.lit(1 << 30))
    own = F.filter(parts, lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, F.lit(5), F.length(x)), ": ", 1)).alias("role"),
        unescape(F.substring(x, F.instr(x, ": ") + 2, F.length(x))).alias("text"),
    )
    taken = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["at"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), taken.alias("targets"), F.length("text").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what the windows hold.

    A digest runs over a whole conversation, so a conversation's text has to fit a row here; the windows themselves do not
    depend on the conversation's length.
    """
    said = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    rows = read_back(formatted).select(
        "conv_id", "window", F.size("turns").alias("n"), "chars",
        F.array_join(F.transform("turns", said), "").alias("said"), F.array_join("targets", "").alias("loss"),
    )
    whole = F.array_sort(F.collect_list(F.struct("window", "said", "loss")))
    joined = lambda name: F.array_join(F.transform("whole", lambda x: x[name]), "")
    return (
        rows.groupBy("conv_id")
        .agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), whole.alias("whole"))
        .select(
            "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
            F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
