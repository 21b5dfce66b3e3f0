"""Chat formatting from an event log, with DataFrame and SQL functions only.

A log holds one row for each thing that happened in a conversation:

    conv_id, seq (order of events), msg (order of the message it concerns), kind, role, text

`delta` appends its text to its message. `edit` and `regenerate` replace what the message held, and
drop later messages (greater msg) that were written before: what followed an edited or regenerated message is
void. `final_messages` folds such a log into one row for each message that is left; `render` writes a
conversation as one string with a loss mask over the assistant's texts; `read_back` parses it.

Template: each turn is `### Role: ` + escaped text + `</turn>` + newline. Inside texts and roles the
three control strings are written `\0` (backslash), `\1` (###), `\2` (</turn>) and `\3` (the colon, in
role names only), which is reversible and leaves no marker inside a text.

Defined results: null texts and roles are empty; an unknown kind counts as delta; events that tie in
seq are ordered by msg, kind, role, text; repeated rows are repeated events; an empty table gives no row; a null
conv_id is a conversation of its own; other columns are left out.

One exchange on conv_id serves the windows and both aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</turn>\n"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replace(c, ("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))


def unescape(c: Column) -> Column:
    return _replace(c, ("\\1", "###"), ("\\2", "</turn>"), ("\\3", ":"), ("\\0", "\\"))


def _role_label(role: Column) -> Column:
    known = F.when(role == "user", "User").when(role == "assistant", "Assistant").when(role == "system", "System")
    return known.otherwise(F.concat(F.lit("="), _replace(escape(role), (":", "\\3"))))


def _role_name(label: Column) -> Column:
    known = F.when(label == "User", "user").when(label == "Assistant", "assistant").when(label == "System", "system")
    return known.otherwise(unescape(F.substr(label, F.lit(2))))


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text: what the log leaves of each message. The role is the one of its last event."""
    e = events.select(
        "conv_id",
        "seq",
        "msg",
        F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    resets = F.col("kind").isin("edit", "regenerate")
    order = W.partitionBy("conv_id").orderBy("seq", "msg", "kind", "role", "text")
    e = e.withColumn("at", F.row_number().over(order))
    later = W.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("void", F.coalesce(F.min(F.when(resets, F.col("msg"))).over(later) < F.col("msg"), F.lit(False))).where("not void")
    part = F.struct("at", resets.alias("reset"), "role", "text")
    folded = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.when(resets, F.col("at"))).alias("since"))
    kept = F.filter("parts", lambda p: p["at"] >= F.coalesce(F.col("since"), F.lit(0)))
    return folded.select("conv_id", "msg", F.element_at("parts", -1)["role"].alias("role"), F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask: array of (start, length) code points of assistant texts, as escaped."""
    head = F.concat(F.lit("### "), _role_label(F.col("role")), F.lit(": "))
    m = messages.select("conv_id", "msg", F.col("role") == "assistant", head, escape(F.col("text"))).toDF("conv_id", "msg", "own", "head", "body")
    m = m.withColumn("turn_text", F.concat("head", "body", F.lit(END)))
    upto = F.sum(F.length("turn_text").cast("long")).over(W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, 0))
    start = upto - F.length("body") - len(END)
    turns = F.sort_array(F.collect_list(F.struct("msg", "turn_text", "own", F.struct(F.col("start").alias("start"), F.length("body").alias("length")).alias("span"))))
    g = m.withColumn("start", start).groupBy("conv_id").agg(turns.alias("turns"))
    return g.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["own"]), lambda t: t["span"]).alias("loss_mask"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Final messages of each conversation, rendered."""
    return render(final_messages(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both parsed from `formatted` and `loss_mask` alone."""
    # each turn ends with END, and no text holds it, so the last part is empty
    parts = F.filter(F.split("formatted", END), lambda p: p != "")
    cut = lambda p: F.instr(p, ": ")
    turn = lambda p: F.struct(
        _role_name(F.substr(p, F.lit(5), cut(p) - 5)).alias("role"), unescape(F.substr(p, cut(p) + 2)).alias("text")
    )
    spans = F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"])))
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss_text": F.array_join(spans, "")})


#: Conversation that the contract adds: texts that look like the template.
PLANT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    plant = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PLANT)).toDF("conv_id", "turn", "role", "text")
    log = rows.unionByName(plant).withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    out = read_back(format_chats(log.withColumn("seq", n).select("conv_id", "seq", F.col("seq").alias("msg"), F.lit("delta").alias("kind"), "role", "text")))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')) AS n,
  CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role)
    ELSE 1 + length(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3')) END AS r FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + r + 2 + n + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
