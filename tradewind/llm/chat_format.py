"""Chat formatting by relational means (operator 9, native).

Turns are put in order, adjacent turns of one role are merged into one block by
array functions, and the blocks are concatenated. Every step is a Spark
expression. The template:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT ...<|im_end|>\\n

``<|im_sep|>`` stands between the texts of a merged block, so that reading back
gives the turns as they were. Inside roles and texts a backslash is doubled and
a backslash is put after the first character of every control string (of this
template and of other common ones), which no template then recognises; dropping
one backslash of each pair undoes it. In a role a line feed is escaped as well.

Defined cases: a null text or role is empty; a null ``conv_id`` is one
conversation of its own; turns with equal (or null, which comes first) numbers
go by role, then text; repeated rows are turns like any other; an empty table
gives no row; other columns are ignored. A conversation is one output row, so
its turns meet in one task by definition of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# First characters and rests of control strings in use by public templates.
CONTROLS = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("<", "<SYS>>"), ("<", "</SYS>>"), ("[", "INST]"), ("[", "/INST]"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, rest in CONTROLS:
        out = F.replace(out, F.lit(first + rest), F.lit(first + "\\" + rest))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id, formatted, loss_spans.

    ``loss_spans`` is the loss mask: array of (start, end) in characters of
    ``formatted``, end exclusive, one span for each text of ``loss_role``.
    One shuffle by conv_id serves the window and the collection.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", "turn", F.col("role").alias("raw_role"),
                 F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")).alias("role"),
                 escape(F.col("text")).alias("body"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    t = (t.withColumn("at", F.row_number().over(order))
          .withColumn("head", F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)))
          .withColumn("tail", F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True))))
    opening = F.when(F.col("head"), F.lit(len(START) + 1) + F.length("role")).otherwise(F.lit(len(SEP)))
    n = opening + F.length("body") + F.when(F.col("tail"), F.lit(len(END))).otherwise(F.lit(0))
    t = t.withColumn("opening", opening.cast("long")).withColumn("n", n.cast("long"))
    t = t.withColumn("start", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") + F.col("opening"))
    span = F.when(F.col("raw_role") == loss_role,
                  F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    g = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "head", "role", "body"))).alias("turns"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"))
    # Merge: a block runs from one head to the next; its texts are a slice of the sorted turns.
    heads = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["head"])
    g = g.withColumn("heads", heads)
    last = F.size("heads")
    blocks = F.transform("heads", lambda s, i: F.struct(
        F.element_at("turns", s)["role"].alias("role"),
        F.transform(F.slice("turns", s, F.when(i + 1 < last, F.get("heads", i + 1)).otherwise(F.size("turns") + 1) - s),
                    lambda x: x["body"]).alias("texts")))
    g = g.withColumn("blocks", blocks)
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END))), "")
    return g.select("conv_id", formatted.alias("formatted"), "loss_spans")


def parse_formatted(formatted: Column) -> Column:
    """Formatted text -> array of (role, text), one entry for each turn as it was."""
    parts = F.split(formatted, r"<\|im_start\|>")
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)
    header = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"

    def turns(block: Column) -> Column:
        role = F.regexp_extract(block, header, 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every conversation and conversation -1, read back from the output."""
    from tradewind.llm.common import read
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = format_conversations(rows.unionByName(trap))
    out = (out.withColumn("turns", parse_formatted(F.col("formatted")))
              .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans"))))
    lf = F.lit("\n")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], lf, t["text"], lf)), ""), 256)
        .alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for first, rest in CONTROLS:
        out = f"replace({out}, '{first}{rest}', '{first}\\{rest}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w <> role, true) AS head, coalesce(lead(role) OVER w <> role, true) AS tail
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(CASE WHEN head THEN {len(START) + 1} + length(replace({_sql_escape('role')}, chr(10), '\\' || chr(10))) ELSE {len(SEP)} END
      + length({_sql_escape('text')}) + CASE WHEN tail THEN {len(END)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
