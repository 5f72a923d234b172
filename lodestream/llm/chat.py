"""Chat formatting with cumulative-snapshot collapse (operator 4).

A conversation that is logged anew after each turn leaves snapshots that are prefixes of the last one. Every turn is
hashed with its position, role and text (two 64-bit hashes); the rolling hash of a prefix is the exclusive-or of its
turns' hashes. A conversation whose whole hash, at its length, is that of a proper prefix of another is anti-joined
away; of conversations with equal turns the one with the least id stays. What is left is rendered.

Equality rests on 128 hash bits and the number of turns; turns are not compared again.

Positions and rolling hashes are built in two levels (within the parts that turns are dealt to by ranges of conversation,
turn, role and the beginning of the text, then over the parts), and what is known of a conversation reaches its turns by
part, so a conversation of any length, turns without a number or id among them, spreads over tasks. A
rendered conversation is one row per turn, with its place and the number of turns: concatenated in order they are the
conversation, and no row grows with it.

Turns are ordered by turn (null first), role, text; null roles and texts render as empty and differ from empty ones
in the comparison; repeated rows are turns of their own; turns without a conversation id form one conversation; ids may
be of any type that has an order; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.windows import spread_ranked

#: Characters of a text that tell which range of equal turns it belongs to.
BEGINNING = 64
#: How a turn is written; "<|" within a text is spaced out, so that no text can end its turn.
BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _turn_hash(salt: int) -> Column:
    return F.xxhash64(
        F.lit(salt), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))
    )


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv (a struct of the id), run, n_turns, pos, role, text, h1, h2: position from 1, and the rolling hashes of the conversation up to this turn."""
    keys = ["conv", "run"]
    conv = F.struct(F.col("conv_id").alias("id"))  # of one field, so that a null id is a key like any other
    rows = turns.select(conv.alias("conv"), "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    deal = [*order[:2], F.substring("text", 1, BEGINNING).asc_nulls_first()]
    rows = spread_ranked(rows, "pos", ["conv"], order, total="n_turns", part="run", deal=deal).drop("turn")
    rows = rows.withColumns({"t1": _turn_hash(1), "t2": _turn_hash(2)})
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*keys).agg(F.bit_xor("t1").alias("r1"), F.bit_xor("t2").alias("r2"))
    base = total.select(*keys, *[F.coalesce(F.bit_xor(f"r{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    up_to = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"o{i}": F.bit_xor(f"t{i}").over(up_to) for i in (1, 2)}).join(base, keys)
    return rows.select(*keys, "n_turns", "pos", "role", "text", *[F.col(f"o{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv of the conversations that are not a prefix of another, the least id of equal ones.

    Copies are reduced to their least id, and prefixes to distinct ones, before the two meet.
    """
    mark = ["n", "h1", "h2"]
    whole = prefixes.filter("pos = n_turns").groupBy(F.col("pos").alias("n"), "h1", "h2").agg(
        F.min(F.struct(F.col("conv.id").isNull().alias("none"), "conv")).alias("k")
    )
    proper = prefixes.filter("pos < n_turns").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, mark, "left_anti").select("k.conv")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 1), n_turns (of the conversation), rendered: the turns of the maximal conversations, as they are written."""
    prefixes = with_prefix_hashes(turns)
    runs = prefixes.select("conv", "run").distinct().join(maximal(prefixes), "conv", "left_semi")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|", "< |")
    piece = F.concat(F.lit(BEGIN), plain("role"), F.lit(MIDDLE), plain("text"), F.lit("\n" + END))
    rows = prefixes.join(runs, ["conv", "run"], "left_semi")
    return rows.select(F.col("conv.id").alias("conv_id"), F.col("pos").cast("long").alias("turn_no"), "n_turns", piece.alias("rendered"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT c.l[1:k.k] AS l FROM c, LATERAL (SELECT unnest(range(1, c.n)) AS k) AS k),
m AS (SELECT min(conv_id) AS conv_id, n FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = c.l) GROUP BY l, n)
SELECT m.conv_id, t.pos AS turn_no, m.n AS n_turns,
  '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS rendered
FROM t JOIN m ON t.conv_id = m.conv_id
"""
