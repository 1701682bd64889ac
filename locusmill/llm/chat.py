"""Chat formatting: cumulative snapshots of one conversation collapse into the longest before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from locusmill.llm.common import saved


def _sized(col: Column) -> Column:
    """A value with its length before it, so that joined values can't be told apart wrongly; null differs from empty."""
    return F.concat(F.coalesce(F.length(col), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(col, F.lit("")))


def collapse_snapshots(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation that is not the beginning of a longer one: conv, n_turns, n_copies, rendered.

    Turns stand in order of (turn, role, text), nulls first; a row that repeats all four values counts once, and rows
    of null ``conv`` are one conversation. Two conversations have a beginning in common if role and text of their
    turns are equal one by one, whatever the turn numbers; null differs from empty. Of equal conversations the one of
    smallest id stays (a null id only if no other has the text), and n_copies counts them. Rolling SHA-256 hashes stand
    for the beginnings; the proper ones are made distinct before the anti-join, and so are the whole ones, so neither
    side of it has a hot key. Rendered: ``<|role|>``, line end, text, ``<|end|>``, line end for each turn; ``<|`` inside a
    text becomes ``< |``, so no turn can forge a mark. Null role reads ``unknown``, null text is empty. Other columns
    aren't read. An empty table gives an empty one.
    """
    turns = df.groupBy(F.col(conv).alias("conv")).agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63))).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns")
    )
    hashes = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda done, t: F.array_append(done, F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), _sized(t.role), _sized(t.text)), 256)),
    )
    logged = saved(turns.withColumn("hashes", hashes))
    whole = logged.groupBy(F.element_at("hashes", -1).alias("h")).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    begun = logged.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("h")).distinct()
    kept = whole.join(begun, "h", "left_anti").select(F.col("conv").alias("kept"), "n_copies")
    line = lambda t: F.concat(F.lit("<|"), F.replace(F.coalesce(t.role, F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("|>\n"), F.replace(F.coalesce(t.text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    return logged.join(kept, F.col("conv").eqNullSafe(F.col("kept"))).select(
        F.col("conv").alias(conv),
        F.size("turns").cast("long").alias("n_turns"),
        "n_copies",
        F.array_join(F.transform("turns", line), "").alias("rendered"),
    )


COLLAPSE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS ts FROM t GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, ts FROM c GROUP BY ts),
p AS (SELECT DISTINCT ts[1:n] AS ts FROM c, range(1, 100000) r(n) WHERE n < len(ts))
SELECT w.conv_id, len(w.ts)::BIGINT AS n_turns, w.n_copies,
  list_aggregate(list_transform(w.ts, lambda t: '<|' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || '|>' || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)), 'string_agg', '') AS rendered
FROM w ANTI JOIN p ON w.ts = p.ts
"""
