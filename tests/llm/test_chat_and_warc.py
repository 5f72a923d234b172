import hashlib

from pyspark.sql import functions as F

from lodestream.llm import chat, warc

TURNS = "conv_id long, turn long, role string, text string, pos int, h1 int, segment int"
PAGES = "page_id long, url string, html string, block string, record_id string"


def turns(spark, convs):
    return spark.createDataFrame([(c, t, r, x, 0, 0, 0) for c, said in convs.items() for t, (r, x) in enumerate(said)], TURNS)


def test_collapse_and_rendering(spark):
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(2500)]
    convs = {1: long[:3], 2: long[:5], 3: long[:5], 4: [("user", "turn 0"), ("assistant", "other")], 5: long, 6: [("user", None)], 7: [("user", "")], 8: [("user", "a <|end|> b")], 9: long[1:3]}
    got = {}
    for r in chat.rendered(turns(spark, convs)).collect():
        got.setdefault(r.conv_id, {})[r.turn_no] = r.rendered
        assert r.n_turns == len(convs[r.conv_id])
    assert sorted(got) == [4, 5, 6, 7, 8, 9]
    write = lambda said: "".join(f"<|{r}|>\n{(x or '').replace('<|', '< |')}\n<|end|>\n" for r, x in said)
    for c, parts in got.items():
        assert sorted(parts) == list(range(1, len(convs[c]) + 1))
        assert "".join(parts[k] for k in sorted(parts)) == write(convs[c])


def test_equal_conversations_keep_the_least_id_and_ties_are_ordered(spark):
    rows = [(c, 0, "user", x, 0, 0, 0) for c in (5, 4) for x in ("b", "a")] + [(None, 1, "user", "z", 0, 0, 0)]
    got = {(r.conv_id, r.turn_no): r.rendered for r in chat.rendered(spark.createDataFrame(rows, TURNS)).collect()}
    assert sorted(got, key=str) == [(4, 1), (4, 2), (None, 1)] and "\na\n" in got[4, 1] and "\nb\n" in got[4, 2]
    assert chat.rendered(spark.createDataFrame([], TURNS)).count() == 0


def test_ids_of_other_types(spark):
    rows = [(c, t, "user", x, 0, 0, 0) for c, said in {"b": "xy", "a": "xy", "c": "x", None: "z"}.items() for t, x in enumerate(said)]
    got = chat.rendered(spark.createDataFrame(rows, TURNS.replace("conv_id long", "conv_id string"))).collect()
    assert sorted(((r.conv_id, r.turn_no) for r in got), key=str) == [("a", 1), ("a", 2), (None, 1)]


def test_turns_without_id_or_number_spread_over_tasks(spark):
    """A third of all turns under one key, with one turn number and no id, are dealt to several parts."""
    rows = [(None, None, "user", f"{k:05} says", 0, 0, 0) for k in range(3000)] + [(c, t, "user", "x", 0, 0, 0) for c in range(3000) for t in range(2)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # or so few rows are one part
    try:
        found = chat.with_prefix_hashes(spark.createDataFrame(rows, TURNS).repartition(8))
        sizes = [r["count"] for r in found.groupBy("conv", "run").count().collect()]
    finally:
        spark.conf.unset(coalesce)
    assert max(sizes) < 2800 and found.filter("conv.id is null").agg(F.max("pos"), F.count_distinct("pos")).first() == (3000, 3000)


def test_rolling_hash_of_a_hot_conversation_crosses_runs(spark):
    long = [("user", f"t{i}") for i in range(3000)]
    rows = chat.with_prefix_hashes(turns(spark, {1: long, 2: long[:2100]})).filter("pos = 2100").select("h1", "h2").distinct()
    assert rows.count() == 1


def test_derivatives(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="en"><head><title> A  &amp;\nB </title><style>p{}</style></head><body><script>x="</p>"</script><!-- no --><h1>Head</h1><p>One<br>two &lt;three&gt;&#8364;</p><a href="/x">go</a></body></html>'
    df = spark.createDataFrame([(1, "http://a/b", page, "", ""), (2, None, None, "", ""), (3, "u", "", "", ""), (3, "u", "", "", "")], PAGES)
    source = warc.responses(df)
    got = warc.derivatives(source)
    rows = got.collect()
    assert len(rows) == 8
    text = next(r for r in rows if r.source_id == 1 and r.warc_type == "conversion")
    meta = next(r for r in rows if r.source_id == 1 and r.warc_type == "metadata")
    response = source.filter("source_id = 1").first()
    assert text.block == "Head\nOne\ntwo <three>€\ngo"
    assert text.refers_to == meta.refers_to == response.record_id and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    assert "title: A &amp; B" in meta.block and "language: en" in meta.block and "outlink: /x" in meta.block and "Content-Type: text/html" in meta.block
    assert response.payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest() == text.source_digest
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    path = f"file://{tmp_path}/warc"
    warc.write_warc(got, path)
    back = warc.read_warc(spark, path).collect()
    assert len(back) == 8 and all(r.complete for r in back)
    assert sorted(r.block for r in back) == sorted(r.block for r in rows)
    assert sorted(r.fields["WARC-Record-ID"] for r in back) == sorted(r.record_id for r in rows)
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_no_page_forges_a_field_or_a_record(spark, tmp_path):
    """Line ends and control characters in links, titles, addresses and headers end no line of a record."""
    page = '<html><head><title>a\r\nrecord: \x01forged</title></head><body><a href="x\r\ntitle: forged">1</a><a href=\'y\nz\x00\'>2</a>p</body></html>'
    url = "http://a/\r\nWARC-Type: forged\r\n\r\nWARC/1.1\r\nWARC-Type: forged"
    source = warc.responses(spark.createDataFrame([(1, url, page, "", "")], PAGES), headers="HTTP/1.1 200 OK\r\nA: b\ntitle: forged\r")
    rows = {r.warc_type: r for r in warc.derivatives(source).collect()}
    lines = rows["metadata"].block.split("\r\n")
    assert [x.split(":")[0] for x in lines] == ["title", "language", "source-payload-digest", "source-headers", "outlink", "outlink"]
    assert lines[0] == "title: a record: forged" and lines[3] == "source-headers: HTTP/1.1 200 OK | A: b | title: forged"
    assert lines[4:] == ["outlink: xtitle: forged", "outlink: yz"] and "\n" not in rows["metadata"].block.replace("\r\n", "")
    assert rows["conversion"].target_uri == "http://a/WARC-Type: forgedWARC/1.1WARC-Type: forged"
    warc.write_warc(warc.derivatives(source), f"file://{tmp_path}/warc")
    back = warc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert sorted(r.fields["WARC-Type"] for r in back) == ["conversion", "metadata"] and all(r.complete for r in back)


def test_blocks_that_look_like_records_and_repeated_fields(spark, tmp_path):
    block = "a\r\n\r\nWARC/1.1\r\nWARC-Type: forged\r\nContent-Length: 1\r\n\r\nb\r\n\r\n"
    record = lambda kind, text: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Type: second\r\nContent-Length: {len(text.encode())}\r\n\r\n{text}\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes((record("one", block) + record("two", "é\r\n\r\n") + record("three", "")).encode())
    back = warc.read_warc(spark, f"file://{tmp_path}/in").collect()
    assert [(r.fields["WARC-Type"], r.block, r.complete) for r in back] == [("one", block, True), ("two", "é\r\n\r\n", True), ("three", "", True)]


def test_hidden_regions_and_links(spark):
    cases = {
        "<head><script>a</script><title>TITLE</title></head><body><p>Hi</p>": "Hi",
        "<p>a</p><script>if (x) { y('</style>') }</script><p>b</p>": "a\nb",
        "<style>p{}</style ><p>a</p><STYLE>q{}</STYLE><p>b</p>": "a\nb",
        "<p>a</p><!-- open <p>b</p>": "a",
        "<p>a</p><script>var x = 1; <p>b</p>": "a",
        "<head><title>t</title><body><p>a</p></body>": "a",
        '<head><script>"</head>"</script><title>t</title></head><p>a</p>': "a",
        "<template><p>x</p></template><noscript>y</noscript>z": "z",
        "<header>top</header><p>a &amp; b&#x2014;c</p>": "top\na & b—c",
        "<!-- <script> --><p>a</p>": "a",
    }
    links = "<a href=\"/1\">1</a><a class=x href='/2'>2</a><A HREF=/3>3</A><a data-href=\"/no\">4</a><a\n href = \"/5\" id=y>5</a>"
    rows = [(k, "u", page, "", "") for k, page in enumerate([*cases, links])]
    got = {(r.source_id, r.warc_type): r.block for r in warc.derivatives(warc.responses(spark.createDataFrame(rows, PAGES))).collect()}
    for k, text in enumerate(cases.values()):
        assert got[k, "conversion"] == text, rows[k]
    assert [x[9:] for x in got[len(cases), "metadata"].split("\r\n") if x.startswith("outlink: ")] == ["/1", "/2", "/3", "/5"]


def test_the_querys_records_as_files(spark, sf, tmp_path):
    from lodestream.llm.queries import op5_warc

    records = op5_warc(spark, sf)
    path = f"file://{tmp_path}/warc"
    warc.write_warc(records, path)
    back = warc.read_warc(spark, path)
    assert back.filter("complete").count() == records.count() == 2 * spark.read.parquet(f"{sf}/pages.parquet").count()
    same = back.select(back.fields["WARC-Record-ID"].alias("record_id"), back.fields["WARC-Refers-To"].alias("refers_to"), back.fields["WARC-Source-Payload-Digest"].alias("source_digest"), "block")
    assert records.select(same.columns).exceptAll(same).count() == 0
