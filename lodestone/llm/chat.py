"""Chat formatting as one relational aggregate, without Python on the executors.

A conversation becomes one string of blocks ``<s>role[INST]text[SEP]text[/INST]</s>``: turns are collected as structs and
sorted, adjacent turns of one role share a block, and ``[SEP]`` keeps their borders.  Control strings inside roles and texts
get one more ``&`` behind their opening bracket, which ``unescape`` takes off again, so the format reads back exactly.
The loss mask is a list of runs (length in code points, counts for the loss or not) over the formatted string.

Defined cases: a null role or text is empty; rows that share a turn number are ordered by role, then text, and repeated rows stay;
null turn numbers come first; rows without conv_id form one conversation with a null id; an empty table gives no rows; only
the four named columns are read, so further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

_CONTROL = r"(?:s>|INST\]|SEP\])"
_ESCAPE = (r"([<\[])(&*/?" + _CONTROL + ")", "$1&$2")
_UNESCAPE = (r"([<\[])&(&*/?" + _CONTROL + ")", "$1$2")
#: Borders before and behind each control string.
_BORDER = r"(?<=<s>|</s>|\[INST\]|\[/INST\]|\[SEP\])|(?=</?s>|\[/?INST\]|\[SEP\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_runs) from rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    turns = turns.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        return F.struct(
            F.element_at("turns", start)["role"].alias("role"),
            F.transform(F.slice("turns", start, stop - start), lambda t: escape(t["text"])).alias("texts"),
        )

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        no = F.lit(False)
        texts = F.transform(
            b["texts"],
            lambda t, i: F.array(part(F.when(i > 0, F.lit("[SEP]")).otherwise(F.lit("")), no), part(t, b["role"] == loss_role)),
        )
        head = F.array(part(F.lit("<s>"), no), part(escape(b["role"]), no), part(F.lit("[INST]"), no))
        return F.concat(head, F.flatten(texts), F.array(part(F.lit("[/INST]"), no), part(F.lit("</s>"), no)))

    made = turns.withColumn("blocks", F.transform("starts", block)).withColumn("parts", F.flatten(F.transform("blocks", pieces)))
    runs = F.transform(F.filter("parts", lambda p: p["text"] != ""), lambda p: F.struct(F.length(p["text"]).cast("long").alias("n"), p["loss"].alias("loss")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        runs.alias("loss_runs"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both taken from the formatted string and its mask alone."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        inner = F.split(b, r"\[/?INST\]", -1)
        role = unescape(F.substring(inner[0], 4, 1 << 30))
        return F.transform(F.split(inner[1], r"\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    pieces = F.filter(F.split("formatted", _BORDER, -1), lambda p: p != "")
    under = F.filter(F.arrays_zip(pieces.alias("piece"), F.col("loss_runs").alias("run")), lambda z: z["run"]["loss"])
    aligned = F.forall(F.arrays_zip(pieces.alias("piece"), F.col("loss_runs").alias("run")), lambda z: F.coalesce(F.length(z["piece"]), F.lit(-1)) == F.coalesce(z["run"]["n"], F.lit(-2)))
    loss = F.array_join(F.transform(under, lambda z: unescape(z["piece"])), "")
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns))).withColumn("loss_text", F.when(aligned, loss).otherwise(F.raise_error(F.lit("the loss mask does not fit the formatted text"))))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).selectExpr("-1L AS conv_id", "explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t")
    probe = probe.select("conv_id", "t.turn", "t.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(text, '([<\[])(&*/?(?:s>|INST\]|SEP\]))', '\1&\2', 'g')) AS text_chars,
    length(regexp_replace(role, '([<\[])(&*/?(?:s>|INST\]|SEP\]))', '\1&\2', 'g')) AS role_chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN same THEN 5 ELSE role_chars + 20 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
