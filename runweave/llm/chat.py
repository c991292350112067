"""Chat formatting by prefix-target expansion, in SQL functions only.

Each assistant turn becomes an example: all turns before it are its context and
only its reply is trainable. Turns are marked

    ### Role: text </turn>

and every control string inside a text is escaped by a backslash, as is every
backslash, so that a formatted example can be read back to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import table

ASSISTANT = "assistant"
#: What stands before a role, between role and text, and after a text.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: A conversation of the query that says its own template's control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    """Texts without an unescaped `#`, `<` or `:`, and their backslashes doubled.

    Of the control strings each has one of these, and ` <` stands before </turn>
    only, so none can stand in a text.
    """
    return F.regexp_replace(text, r"([\\#<:])", r"\\$1")


def unescape(text: Column) -> Column:
    """What `escape` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segment(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(BETWEEN), escape(turn["text"]), F.lit(CLOSE))


def expand(conversations: DataFrame) -> DataFrame:
    """An example for each assistant turn of (conv_id, turn, role, text).

    Returned: conv_id, example (from 1), n_turns, context, target and `trained`.
    The formatted example is context + target. `context` ends with the marker
    of the reply, `target` is the escaped reply alone, and only it is under the
    loss mask. Turns after a conversation's last reply, or all of one without
    any, make a last example that is context only: target is null, nothing is
    trained. `last` marks a conversation's last example; it holds all of its
    turns, once `</turn>` is put after a target.

    Rows go by turn, null turns first, equal turns by role and text. A null role
    or text is empty; a null conv_id is a conversation. Repeated rows are turns
    of their own and extra columns are ignored. The text of a conversation is
    repeated in its later examples, as the examples themselves are.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    segments = F.transform("turns", _segment)
    is_reply = F.transform("turns", lambda t: t["role"] == ASSISTANT)
    rows = turns.select("conv_id", F.size("turns").alias("n_turns"), segments.alias("segments"), is_reply.alias("is_reply"), "turns")
    ends = F.filter(F.sequence(F.lit(1), F.col("n_turns")), lambda i: (i == F.col("n_turns")) | F.element_at("is_reply", i))
    examples = rows.withColumn("ends", ends)
    examples = examples.select("conv_id", "n_turns", "segments", "turns", "is_reply", F.posexplode("ends").alias("place", "end"))
    trained = F.element_at("is_reply", F.col("end"))
    before = F.array_join(F.slice("segments", F.lit(1), F.when(trained, F.col("end") - 1).otherwise(F.col("end"))), "")
    this = F.element_at("turns", F.col("end"))
    return examples.select(
        "conv_id",
        (F.col("place") + 1).alias("example"),
        F.col("end").alias("n_turns"),
        F.when(trained, F.concat(before, F.lit(OPEN), escape(this["role"]), F.lit(BETWEEN))).otherwise(before).alias("context"),
        F.when(trained, escape(this["text"])).alias("target"),
        trained.alias("trained"),
        (F.col("end") == F.col("n_turns")).alias("last"),
    )


def read_back(example: Column) -> Column:
    """The turns (role, text) of a formatted example that ends after a turn."""
    parts = F.filter(F.split(example, "(?<= </turn>\n)"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^### ((?:[^\\:]|\\.)*+): ", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^### (?:[^\\:]|\\.)*+: (.*) </turn>\n$", 1)).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read from their formatted texts.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each
    turn), loss_chars and loss_sha256 (of the text under the loss masks, in
    order), formatted_chars (of all examples) and n_examples.
    """
    # only what is needed of an example meets the others of its conversation
    whole = F.when(F.col("last"), F.concat("context", F.coalesce(F.concat("target", F.lit(CLOSE)), F.lit(""))))
    rows = examples.select("conv_id", "example", F.col("trained"), unescape(F.col("target")).alias("reply"), whole.alias("whole"), (F.length("context") + F.coalesce(F.length("target"), F.lit(0))).cast("long").alias("chars"))
    met = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.first("whole", ignorenulls=True).alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    turns = met.withColumn("turns", read_back(F.col("whole"))).withColumn("loss", F.array_join(F.transform("replies", lambda r: r["reply"]), ""))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return digest(expand(rows.unionByName(probe)))
