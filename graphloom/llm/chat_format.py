"""Chat formatting with prefix-target expansion (operator 5, DataFrame operations).

A turn is written `<|im_start|>role`, a line end, the text, `<|im_end|>`, a line end. Every assistant turn becomes an example of
its own: all turns up to it, with only its own text trainable. Turns after the last assistant turn get a last example without a
target, so that the output holds whole conversations.

Examples are written out, one row each with its whole text, and everything is read back from them. A conversation of n turns
makes text that grows with n times n, as the expansion asks for; nothing else does.

Control strings within texts are escaped: `<`, any backslashes and `|` get one backslash more before the bar, so `<|` occurs in
markers only, and taking that backslash away again restores the text. In roles a backslash also becomes `\\s` and a line end `\\n`.

Rows are ordered by turn (null first), then role and text; null role and text count as empty. A row with a null conv_id is a
conversation of its own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, running_sums, table

START, STOP = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # every backslash is followed by s or n, so neither step makes or breaks a mark of the other
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, own (a number for each row without a conv_id), formatted, targets: array of
    (loss_start, loss_stop), in characters."""
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own")
    t = turns.select("conv_id", own, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", "own", "turn", "role", "text", escape(F.col("text")).alias("body"), F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"))
    whole = t.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("t"))
    ends = running_sums(F.transform("t", lambda x: F.length(x.head) + F.length(x.body) + len(STOP)))
    bounds = lambda x, end: F.struct(x.role.alias("role"), (end - F.length(x.body) - len(STOP)).alias("loss_start"), (end - len(STOP)).alias("loss_stop"))
    targets = F.filter(F.zip_with("t", ends, bounds), lambda e: e.role == "assistant")
    targets = F.transform(targets, lambda e: F.struct(e.loss_start.alias("loss_start"), e.loss_stop.alias("loss_stop")))
    return whole.select("conv_id", "own", F.array_join(F.transform("t", lambda x: F.concat(x.head, x.body, F.lit(STOP))), "").alias("formatted"), targets.alias("targets"))


def examples(formatted: DataFrame) -> DataFrame:
    """The expansion: one row per assistant turn (conv_id, own, example, text, loss_start, loss_stop, last), and one with null bounds
    for turns after the last of them. The last example of a conversation holds all of it."""
    stop = F.coalesce(F.element_at("targets", F.when(F.size("targets") > 0, F.size("targets"))).loss_stop + len(STOP), F.lit(0))
    tail = F.when(stop < F.length("formatted"), F.array(F.expr("cast(named_struct('loss_start', null, 'loss_stop', null) as struct<loss_start: int, loss_stop: int>)"))).otherwise(F.expr("cast(array() as array<struct<loss_start: int, loss_stop: int>>)"))
    rows = formatted.withColumn("all", F.concat("targets", tail)).select("conv_id", "own", "formatted", F.size("all").alias("n"), F.posexplode("all").alias("example", "e"))
    end = F.coalesce(F.col("e.loss_stop") + len(STOP), F.length("formatted"))
    return rows.select("conv_id", "own", "example", F.substr("formatted", F.lit(1), end).alias("text"), "e.loss_start", "e.loss_stop", (F.col("example") + 1 == F.col("n")).alias("last"))


def parse(text: Column) -> Column:
    """The turns of an example: array of (role, text)."""
    turns = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    return F.transform(turns, lambda x: F.struct(_unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"), unescape(F.substr(body(x), F.instr(body(x), F.lit("\n")) + 1)).alias("text")))


def digest(written: DataFrame) -> DataFrame:
    """examples -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples). An example gives what
    it is the first to hold: its own target, and the last one the whole conversation."""
    loss = F.coalesce(unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_stop") - F.col("loss_start"))), F.lit(""))
    parts = written.select("conv_id", "own", "example", F.length("text").alias("chars"), loss.alias("loss"), F.when(F.col("last"), F.col("text")).alias("whole"))
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "")
    c = parts.groupBy("conv_id", "own").agg(F.sum("chars").cast("long").alias("formatted_chars"), losses.alias("loss"), F.max("whole").alias("whole"))
    c = c.select("conv_id", "formatted_chars", "loss", parse(F.col("whole")).alias("t"))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return c.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return digest(materialise(examples(format_conversations(turns.union(extra))), "chat"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text) AS r,
    sum(length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24)
      OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY r) AS turns,
    coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '') AS loss,
    coalesce(sum(upto) FILTER (role = 'assistant'), 0) + CASE WHEN coalesce(max(r) FILTER (role = 'assistant'), 0) < count(*) THEN max(upto) ELSE 0 END AS chars
  FROM n GROUP BY conv_id, own)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
