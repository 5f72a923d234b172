"""Merkle manifest of a dataset, stored in van Emde Boas order (operator 12).

Every row is a leaf: SHA-256 (lowercase hex) of its fields, each as its length and value. A source's leaves, ordered by
id, make a tree of fan-out 16; the sources' roots, ordered by source, make one more, whose root stands for the table.

A tree of ``levels`` levels is cut at half its height, the lower half of its subtrees again, and so on until a piece
has at most ``BLOCK`` levels; a piece is a block, one row of the manifest, and holds its nodes in the order of the same
recursion (``address``), the first being its root. The addresses of a complete tree are used, so a node's place follows
from level and number alone, whatever the number of leaves; places of absent nodes hold zeros.

Construction goes from below, one pass a band of blocks: leaves (then block roots) are grouped by aligned block, at most
16**3 leaves or 16**4 roots a group, so no task holds a source. The roots of a band are the input of the next one. A
block also keeps the roots right below it, so the siblings of all its nodes are within it. Retrieval goes from above: a
block takes the siblings above its root, and hands each block below what is above that one's root. So each block is
read once for all its leaves, and a leaf is never joined to the path of its own.

Leaves are numbered by ranges of (source, id, digest); rows equal in all of these are alike and spread by their place in
the table. Null fields are written ``-``; null sources are a source of their own, first in order; null ids come
first; repeated rows are leaves each; a lone leaf is its source's root, a lone source's root the table's; an empty table
gives an empty result; columns beyond the five named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.windows import spread_ranked

from ._shared import written

#: Children of a node; levels of a block at most; levels of a tree at most (16**14 leaves).
FAN, BLOCK, MOST_LEVELS = 16, 4, 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the layout -----------------------------------------------------------------------------------------------------


def size(levels: int) -> int:
    """Nodes of a complete tree."""
    return (FAN**levels - 1) // (FAN - 1)


def levels_of(n: int) -> int:
    """Levels of nodes over n leaves, the leaves among them."""
    levels = 1
    while FAN ** (levels - 1) < n:
        levels += 1
    return levels


@cache
def bands(levels: int) -> tuple[int, ...]:
    """Levels of the blocks on the way from the root to a leaf."""
    if levels <= BLOCK:
        return (levels,)
    return bands(levels // 2) + bands(levels - levels // 2)


def address(levels: int, depth: int, index: int) -> int:
    """Place of the node ``index`` of ``depth`` (0: root) in a complete tree: its upper half first, then each lower subtree."""
    if levels == 1:
        return 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    tree, within = divmod(index, FAN ** (depth - top))
    return size(top) + tree * size(levels - top) + address(levels - top, depth - top, within)


@cache
def places(levels: int) -> tuple[np.ndarray, ...]:
    """For each depth of a block, the places of its nodes."""
    return tuple(np.array([address(levels, d, i) for i in range(FAN**d)], np.int64) for d in range(levels))


def sibling_addresses(levels: int, n: int, leaf: int) -> list[list[int]]:
    """For each level from the leaf up, the addresses of the other nodes of its run, left to right."""
    out, index, count = [], leaf, n
    for depth in range(levels - 1, 0, -1):
        first = index // FAN * FAN
        out.append([address(levels, depth, i) for i in range(first, min(first + FAN, count)) if i != index])
        index, count = index // FAN, -(-count // FAN)
    return out


# --- leaves ---------------------------------------------------------------------------------------------------------


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its value, or a dash if null."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def leaves(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """id, tree (the source), leaf, claim: digests of a row and, where ``tampered`` holds, of the row with A-Z lower-cased in its text."""
    plain = [F.col(c) for c in FIELDS]
    changed = [*plain[:-1], F.translate("text", _UPPER, _LOWER)]
    claim = F.when(tampered, leaf_digest(changed)) if tampered is not None else F.lit(None).cast("binary")
    return df.select(F.col("doc_id").alias("id"), F.col("source").alias("tree"), leaf_digest(plain).alias("leaf"), claim.alias("claim"))


def numbered(found: DataFrame) -> DataFrame:
    """``found`` with pos (from 0, within its tree, by id and digest) and n, the leaves of its tree."""
    rows = written(found.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    return spread_ranked(rows, "pos", ["tree"], order, total="n").withColumn("pos", F.col("pos") - 1)


# --- construction ---------------------------------------------------------------------------------------------------


def _levels_column(n: Column) -> Column:
    """``levels_of`` as a column."""
    return sum(((n > FAN**k).cast("int") for k in range(MOST_LEVELS)), F.lit(1)).cast("int")


def _by_levels(levels: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), levels)


def _packed(bottom: list[bytes], levels: int) -> bytes:
    """The nodes above and with ``bottom`` (digests, left to right) in the block's order."""
    nodes = np.zeros((size(levels), 32), np.uint8)
    row = bottom
    for depth in range(levels - 1, -1, -1):
        nodes[places(levels)[depth][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = _parents(row)
    return nodes.tobytes()


def _parents(row: list[bytes]) -> list[bytes]:
    text = [d.hex() for d in row]
    return [sha256("".join(text[k : k + FAN]).encode()).digest() for k in range(0, len(text), FAN)]


def _block_schema(tree: str, ident: str) -> str:
    return f"tree {tree}, n long, levels int, pass int, block long, address long, nodes binary, below binary, ids array<{ident}>, claims array<binary>"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def manifest(rows: DataFrame) -> list[DataFrame]:
    """Blocks of every tree of ``rows`` (tree, id, leaf, claim, pos, n), a table a pass, the leaves' blocks first.

    A pass groups digests by the block they belong to and makes its nodes; a tree takes part in as many passes as it
    has bands.
    """
    spec = _block_schema(rows.schema["tree"].dataType.simpleString(), rows.schema["id"].dataType.simpleString())
    arrow = _arrow(spec)
    heights = [bands(k)[::-1] for k in range(1, MOST_LEVELS + 1)]  # from below

    def built(at: int):
        def run(table: pa.Table) -> pa.Table:
            first = {c: table.column(c)[0].as_py() for c in ("tree", "n", "levels", "block")}
            order = np.argsort(np.asarray(table.column("pos")), kind="stable")
            digests = table.column("leaf").take(pa.array(order)).to_pylist()
            own = heights[first["levels"] - 1][at]
            depth = sum(heights[first["levels"] - 1][at + 1 :])
            row = {
                **first, "pass": at, "address": address(first["levels"], depth, first["block"]),
                "nodes": _packed(digests if at == 0 else _parents(digests), own), "below": b"" if at == 0 else b"".join(digests),
                "ids": table.column("id").take(pa.array(order)).to_pylist() if at == 0 else [],
                "claims": table.column("claim").take(pa.array(order)).to_pylist() if at == 0 else [],
            }
            return pa.Table.from_pylist([row], schema=arrow)

        return run

    now = rows.withColumn("levels", _levels_column(F.col("n")))
    out: list[DataFrame] = []
    most = now.agg(F.max("levels")).first()[0] or 1
    for at in range(max(len(bands(k)) for k in range(1, most + 1))):
        width = [FAN ** (h[at] - (at == 0)) if at < len(h) else 1 for h in heights]
        taking = [int(at < len(h)) for h in heights]
        part = now.filter(_by_levels(F.col("levels"), taking) == 1)
        part = part.withColumn("block", F.floor(F.col("pos") / _by_levels(F.col("levels"), width)).cast("long"))
        blocks = part.groupBy("tree", "block").applyInArrow(built(at), spec)
        out.append(written(blocks, f"merkle-{at}"))
        root = F.substring("nodes", 1, 32)
        now = out[-1].select(
            "tree", "n", "levels", F.col("block").alias("pos"), root.alias("leaf"),
            F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("binary").alias("claim")
        )
    return out


def tree_roots(blocks: list[DataFrame]) -> DataFrame:
    """tree, root of every tree."""
    last = [len(bands(k)) - 1 for k in range(1, MOST_LEVELS + 1)]
    tops = [
        b.filter(_by_levels(F.col("levels"), last) == at).select("tree", F.substring("nodes", 1, 32).alias("root")) for at,
        b in enumerate(blocks)
    ]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def stored_nodes(blocks: list[DataFrame]) -> DataFrame:
    """tree, address, digest of every node there is, at the address that ``address`` gives it."""
    out = None
    for b in blocks:
        every = F.explode(F.sequence(F.lit(0), (F.octet_length("nodes") / 32).cast("int") - 1))
        nodes = b.select("tree", "address", "nodes", every.alias("k")).select(
            "tree", (F.col("address") + F.col("k")).alias("address"), F.expr("substring(nodes, k * 32 + 1, 32)").alias("digest")
        )
        nodes = nodes.filter(F.col("digest") != F.lit(bytes(32)))
        out = nodes if out is None else out.union(nodes)
    return out


# --- retrieval ------------------------------------------------------------------------------------------------------

_SIDES = "array<struct<before:string,after:string>>"


def _around(row: list[str]) -> list[tuple[str, str]]:
    """For each digest of a level, those before and after it in its run."""
    out = []
    for k in range(0, len(row), FAN):
        run = row[k : k + FAN]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def _levels_within(nodes: bytes, levels: int, bottom: int) -> list[list[str]]:
    """Digests of a block's levels from the lowest up, of which ``bottom`` are there, by the nodes' places."""
    out, count = [], bottom
    for depth in range(levels - 1, -1, -1):
        out.append([nodes[p * 32 : p * 32 + 32].hex() for p in places(levels)[depth][:count]])
        count = -(-count // FAN)
    return out


def _sides(found: list[list[str]]) -> list[list[tuple[str, str]]]:
    """What is beside each node, for each level below the block's root."""
    return [_around(row) for row in found[:-1]]


def _own(sides: list[list[tuple[str, str]]], index: int) -> list[tuple[str, str]]:
    out = []
    for level in sides:
        out.append(level[index])
        index //= FAN
    return out


def folded(digest: str, sides: list[tuple[str, str]]) -> str:
    """The root that a digest and what is beside it, level by level, give."""
    for before, after in sides:
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


def _walk(blocks: list[DataFrame], tops: DataFrame, leaf_spec: str, leaf_rows) -> DataFrame:
    """From the tops (tree, block = 0, subroot, root, sides above the tree's root) down to ``leaf_rows`` of the leaves' blocks."""
    heights = [bands(k)[::-1] for k in range(1, MOST_LEVELS + 1)]
    tree = tops.schema["tree"].dataType.simpleString()
    path_spec = f"tree {tree}, block long, subroot string, root string, sides {_SIDES}"

    def step(at: int, spec: str):
        arrow = _arrow(spec)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    b = batch.slice(k, 1).to_pylist()[0]
                    own = heights[b["levels"] - 1][at]
                    above = [(s["before"], s["after"]) for s in b["sides"]]
                    if at == 0:
                        rows = leaf_rows(b, _levels_within(b["nodes"], own, len(b["ids"])), above)
                    else:
                        below = [b["below"][i : i + 32].hex() for i in range(0, len(b["below"]), 32)]
                        sides = _sides([below, *_levels_within(b["nodes"], own, -(-len(below) // FAN))])
                        first = b["block"] * FAN**own
                        rows = [
                            {
                                "tree": b["tree"], "block": first + i, "subroot": b["subroot"], "root": b["root"],
                                "sides": [{"before": x, "after": y} for x, y in [*_own(sides, i), *above]]
                            } for i in range(len(below))
                        ]
                    for i in range(0, len(rows), 1024):
                        yield pa.RecordBatch.from_pylist(rows[i : i + 1024], schema=arrow)

        return run

    starts = [len(h) - 1 for h in heights]
    paths = None
    for at in range(len(blocks) - 1, -1, -1):
        here = blocks[at].alias("b")
        begin = tops.join(
            here.filter(_by_levels(F.col("levels"), starts) == at).select(F.col("tree").alias("_t")).distinct(),
            F.col("tree").eqNullSafe(F.col("_t")), "left_semi"
        )
        paths = begin if paths is None else begin.unionByName(paths)
        p = paths.alias("p")
        met = here.join(
            p, F.col("b.tree").eqNullSafe(F.col("p.tree")) & (F.col("b.block") == F.col("p.block"))
        ).select("b.*", "p.subroot", "p.root", "p.sides")
        spec = leaf_spec if at == 0 else path_spec
        paths = met.mapInArrow(step(at, spec), spec)
    return paths


def table_tops(blocks: list[DataFrame]) -> DataFrame:
    """tree, block = 0, subroot, root, sides of each tree, from the tree over the trees' roots; that one is built here."""
    roots = tree_roots(blocks)
    kind = roots.schema["tree"].dataType.simpleString()
    rows = roots.select(
        F.lit(0).alias("tree"), F.col("tree").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("claim")
    )
    over = manifest(spread_ranked(rows, "pos", [], [F.col("id").asc_nulls_first()], total="n").withColumn("pos", F.col("pos") - 1))
    top = tree_roots(over).select(
        "tree", F.lit(0).cast("long").alias("block"), F.lower(F.hex("root")).alias("subroot"), F.lower(F.hex("root")).alias("root"),
        F.array().cast(_SIDES).alias("sides")
    )

    def of_each(b: dict, found: list[list[str]], above: list[tuple[str, str]]) -> list[dict]:
        sides = _sides(found)
        return [
            {
                "tree": s, "block": 0, "subroot": found[0][i], "root": b["root"],
                "sides": [{"before": x, "after": y} for x, y in [*_own(sides, i), *above]]
            } for i,
            s in enumerate(b["ids"])
        ]

    return _walk(over, top, f"tree {kind}, block long, subroot string, root string, sides {_SIDES}", of_each)


def proved(blocks: list[DataFrame], tops: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for every leaf: the proof's digest, and the root that its claim (or else the leaf) gives."""
    kind = blocks[0].schema["ids"].dataType.elementType.simpleString()
    spec = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def of_each(b: dict, found: list[list[str]], above: list[tuple[str, str]]) -> list[dict]:
        sides = _sides(found)
        rest = "".join(x + y for x, y in above)
        known: dict[str, str] = {}
        out = []
        for i, (ident, claim) in enumerate(zip(b["ids"], b["claims"], strict=True)):
            own = _own(sides, i)
            proof = sha256(("".join(x + y for x, y in own) + rest).encode()).hexdigest()
            block_root = folded(claim.hex() if claim is not None else found[0][i], own)
            if block_root not in known:
                known[block_root] = folded(block_root, above)
            root = known[block_root]
            out.append(
                {
                    id_col: ident, "leaf": found[0][i], "subroot": b["subroot"], "root": b["root"], "proof_sha256": proof,
                    "folded_root": root, "verified": root == b["root"]
                }
            )
        return out

    return _walk(blocks, tops, spec, of_each)


def proofs(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Build the manifest of ``df`` (the columns of documents) and prove every row against its root."""
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    blocks = manifest(numbered(leaves(df, tampered)))
    return proved(blocks, table_tops(blocks))


def _oracle(depth: int = 4) -> str:
    """SQL of the proofs, for at most 16**depth leaves a source and as many sources: one table of nodes and one of siblings a level."""

    def tree(name: str, leaf: str) -> str:
        parts = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM ({leaf}))"]
        for k in range(depth):
            parts.append(
                f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM (SELECT s, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
  FROM {name}{k} WHERE c > 1 GROUP BY s, pos // 16))"""
            )
            run = "PARTITION BY s, pos // 16 ORDER BY pos"
            sides = ", ".join(
                f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN {a} AND {b}), '') AS {c}" for a, b,
                c in (("UNBOUNDED PRECEDING", "1 PRECEDING", "x"), ("1 FOLLOWING", "UNBOUNDED FOLLOWING", "y"))
            )
            parts.append(f"{name}{k}s AS (SELECT s, pos, {sides} FROM {name}{k} WHERE c > 1)")
        ends = " UNION ALL ".join(f"SELECT s, h FROM {name}{k} WHERE c = 1" for k in range(depth + 1))
        return ",\n".join([*parts, f"{name}r AS ({ends})"])

    def digest(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    crc = "list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: ord(z)::UBIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::UBIGINT) ELSE u >> 1 END))"
    fold, joins, proof = "coalesce(d.claim, d.leaf)", [], []
    for name, pos, key in (("d", "d.pos", "d.s"), ("g", "d.s", "0")):
        for k in range(depth):
            t = f"{name}{k}s"
            joins.append(f"LEFT JOIN {t} ON {t}.s = {key} AND {t}.pos = {pos} // {16**k}")
            fold = f"CASE WHEN {t}.pos IS NULL THEN {fold} ELSE sha256({t}.x || {fold} || {t}.y) END"
            proof.append(f"coalesce({t}.x || {t}.y, '')")
    return f"""
WITH o AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {digest("text")} AS leaf,
  CASE WHEN xor({crc}, 4294967295::UBIGINT) % 5 = 0 THEN {digest(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS claim FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM o),
{tree("d", "SELECT s, pos, leaf AS h FROM d")},
{tree("g", "SELECT 0 AS s, s AS pos, h FROM dr")},
f AS (SELECT d.doc_id, d.leaf, dr.h AS subroot, gr.h AS root, sha256({" || ".join(proof)}) AS proof_sha256, {fold} AS folded_root
  FROM d JOIN dr ON dr.s = d.s CROSS JOIN gr {" ".join(joins)})
SELECT *, folded_root = root AS verified FROM f
"""


ORACLE_SQL = _oracle()
