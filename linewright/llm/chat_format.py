"""Chat formatting as relational expressions.

The rows of a conversation are collected as structs and sorted by turn, neighbours of one role
are merged into one block by an array aggregation, and the blocks are concatenated, all with
Spark expressions.  A block is ``<|im_start|>role``, a line end, its texts, ``<|im_end|>`` and a
line end; the texts of one block are set apart by ``<|im_sep|>``, so nothing is lost by merging.

Control strings inside roles and texts are escaped: a backslash becomes ``\\b``, and the first
character of a control string a backslash and a letter.  After that no control string is left, and
every backslash starts an escape, so ``unescaped`` is the exact inverse.

Defined results: a NULL text or role is empty; rows that tie on the turn follow role and text,
repeated rows are turns of their own, a NULL turn comes first, and rows with a NULL conversation
are one conversation; an empty table gives no rows; extra columns are ignored.  A conversation is
one string in the output, so one row has to hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# The first character of a control string, of this template or of others that texts hold.
_ANGLE = r"<(?=\|im_(?:start|sep|end)\|>|/?s>)"
_SQUARE = r"\[(?=/?INST\])"
ASSISTANT = "assistant"
# Prefix sums are taken in runs of this many, since appending to an array copies it.
_RUN = 256


def escaped(text: Column) -> Column:
    plain = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(F.regexp_replace(plain, _ANGLE, r"\\l"), _SQUARE, r"\\s")


def unescaped(text: Column) -> Column:
    for sign, plain in (("\\l", "<"), ("\\s", "["), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def _running(values: Column) -> Column:
    """Sum up to each element, by an aggregation that appends."""
    start = F.struct(
        F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums")
    )

    def step(at: Column, value: Column) -> Column:
        total = at["sum"] + value
        return F.struct(
            total.alias("sum"), F.concat(at["sums"], F.array(total)).alias("sums")
        )

    return F.aggregate(values, start, step, lambda at: at["sums"])


def with_running_sums(df: DataFrame, sizes: str, name: str) -> DataFrame:
    """Add ``name``: the running sums of the array column ``sizes`` (BIGINT)."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _RUN).cast("int")),
        lambda run: F.slice(sizes, run * _RUN + 1, F.lit(_RUN)),
    )
    local = df.withColumn("_local", F.transform(runs, _running))
    last = F.transform("_local", lambda sums: F.element_at(sums, -1))
    based = local.withColumn("_ends", _running(last))
    moved = F.transform(
        "_local",
        lambda sums, run: F.transform(
            sums, lambda x: x + F.when(run == 0, F.lit(0)).otherwise(F.get("_ends", run - 1))
        ),
    )
    return based.withColumn(name, F.flatten(moved)).drop("_local", "_ends")


def format_conversations(
    rows: DataFrame,
    conversation_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation.

    ``loss_spans`` has the start and end (code points, end exclusive) of each assistant text in
    ``formatted``.
    """
    turns = rows.select(
        F.col(conversation_column).alias("conv_id"),
        F.struct(
            F.col(turn_column).alias("turn"),
            F.replace(
                escaped(F.coalesce(F.col(role_column), F.lit(""))), F.lit("\n"), F.lit("\\n")
            ).alias("role"),
            escaped(F.coalesce(F.col(text_column), F.lit(""))).alias("text"),
            (F.coalesce(F.col(role_column), F.lit("")) == ASSISTANT).alias("learn"),
        ).alias("entry"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("entry")).alias("turns")
    )
    # Neighbours of one role become one block, from where the role changes to the next change.
    changes = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    starts = sorted_turns.withColumn("starts", changes)
    blocks = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda first, i: F.slice(
                "turns",
                first + 1,
                F.coalesce(F.get("starts", i + 1), F.size("turns")) - first,
            ),
        ),
    ).drop("starts", "turns")
    # Each turn with what stands before and after its text in its block.
    pieces = F.transform(
        "blocks",
        lambda block: F.transform(
            block,
            lambda turn, i: F.struct(
                F.when(i == 0, F.concat(F.lit(START), turn["role"], F.lit("\n")))
                .otherwise(F.lit(SEPARATOR))
                .alias("before"),
                turn["text"].alias("text"),
                F.when(i == F.size(block) - 1, F.lit(END + "\n"))
                .otherwise(F.lit(""))
                .alias("after"),
                turn["learn"].alias("learn"),
            ),
        ),
    )
    flat = blocks.withColumn("pieces", F.flatten(pieces)).drop("blocks")
    sized = flat.withColumn(
        "sizes",
        F.transform(
            "pieces",
            lambda p: F.length(F.concat(p["before"], p["text"], p["after"])).cast("long"),
        ),
    )
    summed = with_running_sums(sized, "sizes", "ends")
    spans = F.zip_with(
        "pieces",
        "ends",
        lambda p, end: F.struct(
            (end - F.length(p["after"]) - F.length(p["text"])).alias("start"),
            (end - F.length(p["after"])).alias("end"),
            p["learn"].alias("learn"),
        ),
    )
    masked = F.filter(spans, lambda span: span["learn"])
    return summed.select(
        "conv_id",
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""
        ).alias("formatted"),
        F.transform(
            masked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
        ).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns`` (role and text, one per input row) and ``loss_texts``, from the strings.

    Only ``formatted`` and ``loss_spans`` are looked at.
    """
    blocks = F.slice(F.split("formatted", START.replace("|", r"\|")), 2, 1 << 30)
    with_blocks = formatted.withColumn("blocks", blocks)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block))
        inner = F.substr(body, F.lit(1), F.length(body) - len(END) - 1)
        return F.transform(
            F.split(inner, SEPARATOR.replace("|", r"\|")),
            lambda text: F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")),
        )

    return with_blocks.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform("blocks", turns_of)).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescaped(
                F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            ),
        ).alias("loss_texts"),
    )


def format_digests(rows: DataFrame) -> DataFrame:
    """Digests of what ``read_back`` finds in the formatted conversations."""
    found = read_back(format_conversations(rows))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join("loss_texts", "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
