import base64
import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import pyarrow as pa  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lodestream.llm import bpe, tokenfile  # noqa: E402
from lodestream.llm._shared import utf8  # noqa: E402
from lodestream.llm.queries import op1_bpe, op9_token_files  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, ids string, part int"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def odd_texts(n=3000):
    rng = random.Random(7)
    bits = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "ß", "9", "٣", " ", " ", "\x1c", "\x85", "!", "#", "日", "😀", "\x00", "I", "'S", "\r\n", "²", "_", "<|endoftext|>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 20000, "the cat " * 4000, " " * 9000, "'" * 500, "x" + "\n" * 700 + "y"]


def rows_of(encode, texts, limit):
    raw, offs = utf8(pa.array(texts, pa.string()))
    out = []
    for a, b, ids, n in bpe.encode_chunks(raw, offs, encode, limit=limit):
        ends = np.concatenate(([0], np.cumsum(n)))
        out += [ids[ends[i] : ends[i + 1]].tolist() for i in range(b - a)]
    return out


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    h = vocabulary.hash
    assert sorted(h.key.tolist()) == list(range(len(vocabulary.tokens)))


def test_encoding_equals_the_library_on_odd_texts(vocabulary, reference):
    texts = odd_texts()
    assert rows_of(vocabulary.encode, texts, 4000) == [reference.encode_ordinary(t) for t in texts]


def test_decoding_returns_the_bytes_and_refuses_foreign_ids(vocabulary):
    raw, offs = utf8(pa.array(odd_texts(200), pa.string()))
    ids, n = vocabulary.encode(bpe.padded(raw), offs)
    data, ends = vocabulary.decode(ids, n)
    assert data.tobytes() == raw.tobytes() and ends.tolist() == offs.tolist()
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([999999], np.uint32), np.array([1]))


def test_op1_on_nulls_repeats_and_clashing_columns(spark, vocabulary, reference):
    rows = [(1, "it's  a test", "x", "y", 0), (1, "it's  a test", "x", "y", 0), (2, None, "x", "y", 0), (None, "", "x", "y", 0), (3, "ünïcode\n", None, None, None)]
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), RANKS).collect()
    want = []
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), RANKS).count() == 0


def test_op1_query_equals_the_library(spark, sf, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 70000, 200000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 256, n), rng.integers(0, 1 << rng.integers(9, 32), n)).astype(np.uint32)
        codes = tokenfile.Codes(*tokenfile.pack(ids))
        at = rng.permutation(n)
        assert (codes.at(at) == ids[at]).all()


def expected(library, docs):
    start, out = 0, []
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op9_query_equals_the_library(spark, sf, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op9_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(library, docs)


def test_op9_small_shards_nulls_and_random_access(spark, library, tmp_path):
    docs = [(i, t) for i, t in enumerate(odd_texts(60))] + [(70, None), (71, ""), (72, "again"), (72, "again")]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in docs], SCHEMA)
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(df, JSON, path, shard_tokens=300)
    got = sorted(tuple(r) for r in tokenfile.read_documents(spark, path, with_ids=False).collect())
    want = expected(library, sorted(docs, key=lambda d: (d[0], d[1] or "")))
    assert got == want
    every = [x for _, t in sorted(docs, key=lambda d: (d[0], d[1] or "")) for x in [*library.encode(t or "", add_special_tokens=False).ids, 2]]
    places = [0, 5, 299, 300, 301, len(every) - 1, len(every) // 2]
    found = tokenfile.tokens_at(spark, path, spark.createDataFrame([(p,) for p in [*places, 5, -1, len(every), None]], "place long"))
    assert sorted((r.place, r.token_id) for r in found.collect()) == sorted((p, every[p]) for p in [*places, 5])


def test_added_tokens_get_their_ids(spark, library):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>b", "<|endoftext|", "x" * 9000 + "<|endoftext|>" + " the cat" * 9000, None, "plain"]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(tuple(r) for r in tokenfile.through_files(df, JSON).collect())
    assert got == expected(library, list(enumerate(texts)))
    assert library.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    definition = json.loads(Path(JSON).read_text())
    definition["added_tokens"].append({"id": 50257, "content": "<sep>", "single_word": False, "lstrip": True, "rstrip": True, "normalized": False, "special": True})
    wider = json.dumps(definition)
    encoder, added = tokenfile.PieceEncoder(wider), tokenfile.AddedTokens(wider)
    column = pa.array(["a  <sep>  b", "plain", "x <|endoftext|> <sep>"])
    ids = [x.tolist() for *_, ids, n in tokenfile.encoded(column, encoder, added) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert ids == [Tokenizer.from_str(wider).encode(t, add_special_tokens=False).ids for t in column.to_pylist()]


def test_repeated_neighbours_are_coded_like_others(spark):
    rows = [(i, t, "x", "y", 0) for i, t in enumerate(["a b", "a b", None, None, "", "c", "a b", "c" * 5000, "c" * 5000])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    one = {r.doc_id: r for r in bpe.round_trip(df, RANKS, with_ids=True).collect()}
    two = {r.doc_id: r for r in bpe.round_trip(df.orderBy((F.col("doc_id") * 7) % 9), RANKS, with_ids=True).collect()}
    assert one == two and len(one) == 9 and bytes(one[0].ids) == bytes(one[6].ids) != b""


def test_op9_empty_table(spark, tmp_path):
    assert tokenfile.through_files(spark.createDataFrame([], SCHEMA), JSON).count() == 0
