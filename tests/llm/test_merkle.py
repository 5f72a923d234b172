import re
import zlib
from hashlib import sha256

import pytest

from lodestream.llm import merkle
from lodestream.llm.queries import op12_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, n long, id string, leaf string, block long"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_above(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def sides(levels, index):
    for row in levels[:-1]:
        first = index // 16 * 16
        yield row[first:index], row[index + 1 : first + 16]
        index //= 16


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    trees = [sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[1])), r) for r in trees[k]) for k in sorted(trees)]
    built = [levels_above([key[2] for key, _ in t]) for t in trees]
    over = levels_above([b[-1][0] for b in built])
    out = []
    for s, (tree, b) in enumerate(zip(trees, built, strict=True)):
        for i, ((_, _, leaf), r) in enumerate(tree):
            around = [*sides(b, i), *sides(over, s)]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            got = leaf_of(r, text)
            for x, y in around:
                got = h("".join(x) + got + "".join(y))
            proof = h("".join("".join(x) + "".join(y) for x, y in around))
            out.append((r[0], leaf, b[-1][0], over[-1][0], proof, got, got == over[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "x", "x", 3) for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op12_merkle(spark, sf)) == expected(rows)


def test_sizes_around_the_fan_out_nulls_repeats_and_clashing_names(spark):
    rows = [(i, f"Text {i}", "en", f"s{n}", i) for n in (1, 15, 16, 17, 256, 257, 300) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "", "", "", 0), (7, "É A b", "ü", "é", -3), (7, "É A b", "ü", "é", -3), (7, "X" * 200_000, "-", "-", 1)]
    assert got(merkle.proofs(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_trees_of_several_bands(spark, monkeypatch, most):
    """With smaller blocks the same trees take more passes; a third of all rows are repeats under one id, and many sources make a tall upper tree."""
    rows = [(i, f"T{i}", "en", "hot", 1) for i in range(5000)] + [(3, "T", "en", "hot", 1)] * 300 + [(i, "A", None, f"s{i:03}", 2) for i in range(270)]
    monkeypatch.setattr(merkle, "BLOCK", most)
    merkle.bands.cache_clear()
    try:
        assert got(merkle.proofs(frame(spark, rows))) == expected(rows)
    finally:
        merkle.bands.cache_clear()


def test_lone_leaf_and_empty_table(spark):
    rows = [(1, "Ab", "en", "s", 2)]
    assert got(merkle.proofs(frame(spark, rows))) == expected(rows)
    assert got(merkle.proofs(frame(spark, []))) == []


def test_addresses_name_every_node_once_with_blocks_in_one_piece():
    for levels in range(1, 6):
        every = [merkle.address(levels, d, i) for d in range(levels) for i in range(16**d)]
        assert sorted(every) == list(range(merkle.size(levels)))
        cut = merkle.bands(levels)
        assert sum(cut) == levels and max(cut) <= merkle.BLOCK
        depth = sum(cut[:-1])
        for block in (0, 16**depth - 1):
            first = merkle.address(levels, depth, block)
            inside = [merkle.address(levels, depth + d, block * 16**d + i) for d in range(cut[-1]) for i in range(16**d)]
            assert sorted(inside) == list(range(first, first + merkle.size(cut[-1])))


def test_stored_nodes_are_found_by_address(spark):
    """Siblings read from the manifest by address alone give each leaf's root."""
    n = 4500
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    blocks = merkle.manifest(merkle.numbered(merkle.leaves(frame(spark, rows))))
    node = {r.address: r.digest.hex() for r in merkle.stored_nodes(blocks).collect()}
    levels = merkle.levels_of(n)
    tree = levels_above([leaf_of(r, r[1]) for r in rows])
    assert len(node) == sum(map(len, tree)) and node[0] == tree[-1][0]
    for leaf in (0, 15, 16, 4095, 4096, n - 1):
        found = [[node[a] for a in run] for run in merkle.sibling_addresses(levels, n, leaf)]
        assert found == [[*x, *y] for x, y in sides(tree, leaf)]


def test_blocks_stay_small_under_a_hot_source(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(6000)]
    blocks = merkle.manifest(merkle.numbered(merkle.leaves(frame(spark, rows))))
    assert max(len(r.ids) for r in blocks[0].select("ids").collect()) <= 16 ** (merkle.BLOCK - 1)
