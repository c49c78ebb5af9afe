"""Chat formatting by relational steps, in Spark expressions only.

The turns of a conversation are collected as structs, sorted, cut into blocks of adjacent turns of one role, and concatenated:

    <|role|> first text <|+|> second text of the same role <|end|> ...

Inside roles and texts, `\\` becomes `\\\\`, `<` becomes `\\l` and `[` becomes `\\b`, so none of the template's marks, nor other
control strings such as `</s>` or `[INST]`, can stand in them; `unescaped` undoes it exactly.

Nulls: a null text or role is empty, a null turn sorts first. Ties on the turn are ordered by role, then text; repeated rows stay.
Rows whose conversation is null form one conversation. Empty table: no rows. Very long conversations take time linear in their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN, END = "<|+|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def escaped_role(role: Column) -> Column:
    """Roles stand between bars, so a bar becomes `\\p` in them."""
    return F.replace(escaped(role), F.lit("|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    """Pairs of backslashes first, left to right, then the letters between them."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\p"), F.lit("|")))
    return F.array_join(plain, "\\")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, pieces, n_blocks): pieces are (piece, loss) whose concatenation is `formatted`; loss marks text to train on."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    at = F.sequence(F.lit(0), F.size("ts") - 1)
    starts = grouped.withColumn("starts", F.filter(at, lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"])))
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("ts", s)["role"].alias("role"),
            F.transform(F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ts")) - s), lambda x: escaped(x["text"])).alias("texts"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    inner = lambda b: F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")), F.lit(False)), piece(x, b["role"] == trained_role))))
    of_block = lambda b: F.concat(F.array(piece(F.concat(F.lit("<|"), escaped_role(b["role"]), F.lit("|>")), F.lit(False))), inner(b), F.array(piece(F.lit(END), F.lit(False))))
    done = starts.select("conv_id", blocks.alias("blocks")).select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), F.filter(F.flatten(F.transform("blocks", of_block)), lambda p: p["piece"] != "").alias("pieces"))
    return done.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces", "n_blocks")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    head = lambda b: F.regexp_extract(b, r"^<\|([^<|]*)\|>", 1)
    body = lambda b: F.split(F.substr(b, F.length(head(b)) + 5), r"<\|\+\|>")
    return F.flatten(F.transform(blocks, lambda b: F.transform(body(b), lambda x: F.struct(unescaped(head(b)).alias("role"), unescaped(x).alias("text")))))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("select cast(-7 as bigint) conv_id, cast(t as bigint) turn, r role, '</s>[INST] ok [/INST]' text from values (0, 'user'), (1, 'assistant') as v(t, r)")
    done = format_chats(table.unionByName(own))
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescaped(p["piece"])), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", "n_blocks", "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


#: Escaping adds one character for each `\\`, `<` and `[`; each block adds its role's marks and its end, each further text of a block a join.
OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 0 ELSE 1 END AS new_block,
    length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS esc_text,
    length(role) + length(regexp_replace(role, '[^<\[\\|]', '', 'g')) AS esc_role
  FROM rows
), folded AS (
  SELECT conv_id, count(*) AS n_turns, sum(new_block) AS n_blocks,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(esc_text + CASE WHEN new_block = 1 THEN esc_role + 11 ELSE 5 END) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(n_blocks AS BIGINT) AS n_blocks
FROM folded
"""
