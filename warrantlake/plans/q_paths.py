"""Selectors over documents made of conversations, one of each, and their list of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions import paths
from warrantlake.sources.views import table

PATHS = ["conv.id", "conv.missing.deeper", "turns[turn=1].chars", "turns[meta.role=user].chars", "turns[meta.role=user,turn=2].chars", "turns[turn=99].chars", "turns.chars", "conv[id=1].x", "turns[short=True].turn"]


def documents(s: SparkSession, d: str) -> DataFrame:
    """(conv_id, document): JSON text."""
    turn = F.struct("turn", F.struct("role").alias("meta"), F.length("text").alias("chars"), (F.length("text") < 60).alias("short"))
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("turns"))
    return turns.select("conv_id", F.to_json(F.struct(F.struct(F.col("conv_id").alias("id")).alias("conv"), "turns")).alias("document"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    x = documents(s, d)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), paths.text_at(F.col("document"), p).alias("r")) for p in PATHS]))
    return x.select("conv_id", each.alias("x")).select("conv_id", "x.path", "x.r.value", "x.r.problem")


def _selected(path: str, where: str, value: str) -> str:
    return f"""SELECT conv_id, '{path}' AS path, CASE WHEN count(*) FILTER ({where}) = 1 THEN CAST(max({value}) FILTER ({where}) AS VARCHAR) END AS value,
      CASE WHEN count(*) FILTER ({where}) <> 1 THEN 'turns: matched ' || CAST(count(*) FILTER ({where}) AS VARCHAR) || ' elements' END AS problem FROM conversations GROUP BY 1"""


def _stated(path: str, value: str, problem: str) -> str:
    return f"SELECT conv_id, '{path}' AS path, {value} AS value, {problem} AS problem FROM conversations GROUP BY 1"


_SQL = " UNION ALL ".join([
    _stated(PATHS[0], "CAST(conv_id AS VARCHAR)", "NULL"), _stated(PATHS[1], "NULL", "'missing: not found'"),
    _selected(PATHS[2], "turn = 1", "length(text)"), _selected(PATHS[3], "role = 'user'", "length(text)"), _selected(PATHS[4], "role = 'user' AND turn = 2", "length(text)"), _selected(PATHS[5], "turn = 99", "length(text)"),
    _stated(PATHS[6], "NULL", "'chars: a list without a selector'"), _stated(PATHS[7], "NULL", "'conv: not a list'"), _selected(PATHS[8], "length(text) < 60", "turn"),
])

QUERIES = {"sf16_selectors": (_resolved, _SQL)}
