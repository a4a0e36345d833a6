"""Operator 10: chat formatting with cumulative-snapshot collapse.

A logged conversation that another, longer one begins with is an earlier snapshot of
it. Each conversation gets a rolling hash after each of its turns, SHA-256 of the hash
before, the role and the text. A conversation whose last hash is among the hashes that
others have before their last turn is a proper prefix and goes (anti-join); of
conversations with the same last hash the one with the smallest id stays. What is left
is rendered. Only DataFrame functions are used.

Hashes of inner turns are made distinct and last hashes are grouped before they meet,
so a conversation that a third of all rows repeat is one row on either side.

Defined results: turns are ordered by `turn`, then role and text; rows that repeat in
all four columns count once; null roles and texts count as empty; rows without a
conversation id are left out; a null turn comes first; an empty table gives an empty
table; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common


def conversations(df: DataFrame) -> DataFrame:
    """`conv_id`, `turns` in order, and `hashes`, the rolling hash after each turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    grouped = df.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list(turn))).alias("turns"))
    one = lambda t: F.concat_ws("\x1f", F.length(t["role"]).cast("string"), t["role"], t["text"])
    hashes = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("every")),
        lambda acc, t: F.struct(F.sha2(F.concat_ws("\x1e", acc["last"], one(t)), 256).alias("last"), F.concat(acc["every"], F.array(acc["last"])).alias("every")),
    )
    return grouped.withColumn("_h", hashes).select("conv_id", "turns", F.slice(F.concat("_h.every", F.array("_h.last")), 2, F.size("turns")).alias("hashes"))


def collapse(df: DataFrame) -> DataFrame:
    """The maximal conversations: `conv_id`, `turns`, and `n_copies`, how many conversations are the same."""
    every = conversations(df)
    ends = every.groupBy(F.element_at("hashes", -1).alias("_hash")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = every.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("_hash")).distinct()
    kept = ends.join(inner, "_hash", "left_anti").select("conv_id", "n_copies")
    return every.select("conv_id", "turns").join(kept, "conv_id")


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """`df` with `rendered`: each turn between role header and end mark."""
    shown = F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    return df.withColumn("rendered", F.array_join(shown, ""))


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    kept = render(collapse(common.table(spark, sf_dir, "conversations")))
    return kept.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "n_copies", F.length("rendered").cast("bigint").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), "rendered")


OP10_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT turns[1:i] AS turns FROM c, unnest(range(1, len(turns))) AS u(i)
), e AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY turns
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies, CAST(length(rendered) AS BIGINT) AS n_chars,
       sha256(rendered) AS rendered_sha256, rendered
FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = e.turns)
"""
