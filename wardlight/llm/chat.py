"""Reply trees to training conversations, with DataFrame operations only.

Messages form trees (parent_id null: root). Self-joins that double their reach
each round give every message its depth and the sum of scores on its way to the
root, so a thread of n messages takes log2(n) rounds. Leaves are ranked by that
score within their tree; the paths of the chosen leaves are enumerated by the
same doubled pointers, and each path is formatted as one conversation.

Markers inside texts and roles are escaped reversibly, so the formatted text
splits into its turns without ambiguity.

Null texts and roles are empty, and very long ones are formatted whole. Messages of equal turn are
ordered by role and text, so ties and repeated rows give one result. A table without messages gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import let, stored

# Fixed values of the template.
START = "<|im_start|>"
END = "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    r"""Backslash doubled, `<|` as `<\|`, line feed left alone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of `escape`: pairs of backslashes are read from the left."""
    parts = F.transform(
        F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit("<\\|"), F.lit("<|"))
    )
    return F.array_join(parts, "\\")


def escape_role(role: Column) -> Column:
    r"""As `escape`, with line feeds as `\n`: a role ends at the first line feed."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(
        F.split(role, r"\\\\"),
        lambda part: F.replace(
            F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")
        ),
    )
    return F.array_join(parts, "\\")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of conversations whose rows reply to the row before, by turn.

    Repeated turn numbers are kept, ordered by role and text; a null turn comes
    first. Messages are identified by tree and position, so the window holds a
    few short columns.
    """
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    place = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree_id"),
        place.alias("message_id"),
        F.when(place > 1, place - 1).alias("parent_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    )


def climb(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored pointer tables of each round, and (tree_id, message_id, depth, path_score).

    Round k's table holds the ancestor 2^k steps up. A parent that is missing
    ends the path, as a root does; so does a cycle, which a forest cannot have:
    messages on one raise an error.
    """
    known = messages.select("tree_id", "message_id")
    state = stored(
        messages.select("tree_id", "message_id", "parent_id", "score").join(
            known.withColumnRenamed("message_id", "parent_id").withColumn("exists", F.lit(True)),
            ["tree_id", "parent_id"],
            "left",
        ).select(
            "tree_id",
            "message_id",
            F.when(F.col("exists"), F.col("parent_id")).alias("up"),
            F.lit(1).cast("long").alias("steps"),
            F.coalesce(F.col("score"), F.lit(0.0)).alias("sum_score"),
        ),
        "chat-up",
    )
    rounds = []
    while True:
        rounds.append(state.where("up IS NOT NULL").select("tree_id", "message_id", "up"))
        count, open_rows, longest = state.agg(
            F.count("*"), F.count("up"), F.max("steps")
        ).first()
        if not open_rows:
            return rounds[:-1], state.select(
                "tree_id", "message_id", F.col("steps").alias("depth"), F.col("sum_score").alias("path_score")
            )
        if longest > 2 * count:
            raise ValueError("the messages contain a cycle of replies")
        # Rows that have reached their root stay as they are and are not joined again.
        above = state.select(
            "tree_id",
            F.col("message_id").alias("up"),
            F.col("up").alias("next_up"),
            F.col("steps").alias("more_steps"),
            F.col("sum_score").alias("more_score"),
        )
        climbed = state.where("up IS NOT NULL").join(above, ["tree_id", "up"]).select(
            "tree_id",
            "message_id",
            F.col("next_up").alias("up"),
            (F.col("steps") + F.col("more_steps")).alias("steps"),
            (F.col("sum_score") + F.col("more_score")).alias("sum_score"),
        )
        state = stored(state.where("up IS NULL").unionByName(climbed), "chat-up")


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Rows (tree_id, leaf_id, branch_rank, step, message_id) of the chosen paths.

    Leaves are ranked by path score, then length, then id. `branches` is the
    number of paths kept per tree, None keeps all. `step` counts from the leaf.
    """
    rounds, reached = climb(messages)
    parents = messages.select("tree_id", F.col("parent_id").alias("message_id")).distinct()
    leaves = reached.join(parents, ["tree_id", "message_id"], "left_anti")
    best = F.struct(F.col("path_score"), F.col("depth"), -F.col("message_id"))
    if branches == 1:
        chosen = leaves.groupBy("tree_id").agg(F.max_by("message_id", best).alias("leaf_id")).withColumn(
            "branch_rank", F.lit(1)
        )
    else:
        order = Window.partitionBy("tree_id").orderBy(best.desc())
        chosen = leaves.select(
            "tree_id", F.col("message_id").alias("leaf_id"), F.row_number().over(order).alias("branch_rank")
        )
        if branches is not None:
            chosen = chosen.where(F.col("branch_rank") <= branches)
    found = stored(
        chosen.select(
            "tree_id", "leaf_id", "branch_rank", F.lit(0).cast("long").alias("step"), F.col("leaf_id").alias("message_id")
        ),
        "chat-paths",
    )
    for k, pointers in reversed(list(enumerate(rounds))):
        jumped = found.join(pointers, ["tree_id", "message_id"]).select(
            "tree_id", "leaf_id", "branch_rank", (F.col("step") + 2**k).alias("step"), F.col("up").alias("message_id")
        )
        # Stored, as the union names the rows so far twice.
        found = stored(found.unionByName(jumped), "chat-paths")
    return found


def format_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One conversation per chosen path: (tree_id, branch_rank, n_turns, formatted, loss_spans).

    `formatted` repeats `<|im_start|>role\\ntext<|im_end|>\\n`. `loss_spans` marks
    what is trained on: for each assistant turn its number, the start of its
    text within the turn's block (after the start marker), the absolute start
    and the length, all in code points of the escaped text.
    """
    rows = paths(messages, branches).join(
        messages.select("tree_id", "message_id", "role", "text"), ["tree_id", "message_id"]
    )
    head = F.concat(escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        (-F.col("step")).alias("place"),
        F.concat(head, body).alias("block"),
        F.char_length(head).cast("long").alias("skip"),
        F.char_length(body).cast("long").alias("length"),
        (F.col("role") == TRAINED_ROLE).alias("trained"),
    )
    grouped = rows.groupBy("tree_id", "branch_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    around = len(START) + len(END) + 1

    def span(state, item):
        start = state.at + F.lit(len(START)) + item.skip
        entry = F.struct(
            state.turn.alias("turn"), item.skip.alias("offset"), start.alias("start"), item.length.alias("length")
        )
        return F.struct(
            (state.at + F.lit(around) + item.skip + item.length).alias("at"),
            (state.turn + 1).alias("turn"),
            F.when(item.trained, F.concat(state.spans, F.array(entry))).otherwise(state.spans).alias("spans"),
        )

    nothing = F.expr(
        "struct(0L AS at, 0 AS turn, CAST(array() AS array<struct<turn:int,offset:bigint,start:bigint,length:bigint>>) AS spans)"
    )
    return grouped.select(
        "tree_id",
        "branch_rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(
            F.transform("turns", lambda t: F.concat(F.lit(START), t.block, F.lit(END), F.lit("\n"))), ""
        ).alias("formatted"),
        F.aggregate("turns", nothing, span, lambda state: state.spans).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text, block) read back from a formatted conversation.

    Escaping keeps `<|` out of texts and roles, so the start marker splits the
    turns, and each block ends with the end marker and a line feed.
    """
    tail = len(END) + 1
    blocks = let(F.split(formatted, r"<\|im_start\|>"), lambda x: F.slice(x, F.lit(2), F.size(x)))

    def turn(block):
        inner = F.substring(block, F.lit(1), F.char_length(block) - F.lit(tail))
        return let(
            inner,
            lambda x: F.struct(
                unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
                unescape(
                    F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + F.lit(2), F.char_length(x))
                ).alias("text"),
                block.alias("block"),
            ),
        )

    return F.transform(blocks, turn)


def trained_text(turns: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between the spans."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                F.substring(F.element_at(turns, s.turn + 1).block, (s.offset + 1).cast("int"), s.length.cast("int"))
            ),
        ),
        "",
    )
