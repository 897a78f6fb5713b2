"""Operators against hand-computed values."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions.text import glob_pattern, hash_uuid, tokens
from brindle.operators import admin, catalog, chunking, encoders, fusion, index, metrics, rag, rerank, retrieve, understanding
from brindle.sources import files
from brindle.streaming import watch


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_bm25_golden(spark):
    corpus = docs(spark, chunk1="hello world rust programming", chunk2="python machine learning", chunk3="rust systems programming")
    query = spark.createDataFrame([(0, "rust")], "qid int, text string")
    got = [(r.doc_id, r.score) for r in retrieve.bm25(corpus, query).orderBy("rank").collect()]
    assert got == [("chunk3", 0.490051), ("chunk1", 0.434457)]
    assert retrieve.bm25(corpus, query, min_score=0.45).count() == 1


def test_rows_that_share_an_id_count_each_for_itself(spark):
    corpus = spark.createDataFrame([("a", "red red"), ("a", "red blue"), ("b", "green")], "doc_id string, text string")
    got = [r.score for r in retrieve.bm25(corpus, spark.createDataFrame([(0, "red")], "qid int, text string")).collect()]
    assert len(got) == 2 and max(got) < 2.2 * 0.5


def test_text_is_told_from_binary(spark):
    cases = {b"plain": True, "ümläut".encode(): True, b"\xff\xfe\x00\x81": False, b"\x89PNG\r\n\x1a\n": False, b"": True, b"a" * 1023 + "é".encode() + b"b": True, b"a" * 1000 + b"\xff" + b"a" * 500: False, None: False}
    table = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, content binary")
    assert [r.t for r in table.select("i", files.is_text(F.col("content")).alias("t")).orderBy("i").collect()] == list(cases.values())


def ranked(spark, **lists):
    rows = [(name, o, i + 1, d, s) for o, (name, items) in enumerate(lists.items()) for i, (d, s) in enumerate(items)]
    return spark.createDataFrame(rows, "retriever string, ord int, rank int, id string, score double")


def test_rrf_golden_and_ties(spark):
    got = [(r.id, r.fused_score) for r in fusion.rrf(ranked(spark, bm25=[("a", 2.0), ("b", 1.0)], splade=[("b", 2.0), ("c", 1.0)])).collect()]
    assert got == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]
    ties = fusion.rrf(ranked(spark, bm25=[("a", 1.0), ("x", 0.5)], splade=[("b", 1.0), ("y", 0.5), ("", 0.1)]))
    assert [r.id for r in ties.collect()] == ["a", "b", "x", "y"]


def test_weighted_golden(spark):
    got = {r.id: r.fused_score for r in fusion.weighted(ranked(spark, bm25=[("a", 10.0), ("b", 5.0)], splade=[("b", 3.0), ("c", 1.0)], odd=[("z", 4.0)]), {"bm25": 1.0, "splade": 1.0}).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 0.0, "z": 0.0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), unique=True, min_size=1), st.lists(st.sampled_from("abcdef"), unique=True, min_size=1))
def test_rrf_follows_the_formula(spark, one, two):
    got = {r.id: r.fused_score for r in fusion.rrf(ranked(spark, p=[(x, 1.0) for x in one], q=[(x, 1.0) for x in two]), limit=None).collect()}
    for x in {*one, *two}:
        assert got[x] == pytest.approx(sum(1 / (61 + items.index(x)) for items in (one, two) if x in items), abs=1e-6)


def test_file_dedupe_golden(spark):
    rows = [("c1", "p.py", "", 0.9), ("c2", "p.py", "", 0.8), ("c3", None, None, 0.7), ("c4", None, None, 0.6), ("c5", "", "p.py", 0.5)]
    table = spark.createDataFrame(rows, "id string, full_path string, file_path string, score double")
    once = fusion.per_file(table, ["full_path", "file_path"], [F.desc("score")])
    assert {r.id for r in once.collect()} == {"c1", "c3", "c4"}
    assert fusion.per_file(once, ["full_path", "file_path"], [F.desc("score")]).count() == 3


def test_chunk_id_and_enhancement_golden(spark):
    row = spark.range(1).select(
        hash_uuid(F.lit("/tmp/test.py:0:def foo(): pass")).alias("id"), files.content_hash(F.lit("/tmp/test.py:0:def foo(): pass")).alias("hash"),
        chunking.enhanced(F.lit("src/a/config.yaml"), F.lit("x")).alias("text"),
    ).first()
    assert row.id == "2be87994-d150-a221-8293-128fea668bea" and row.hash.startswith("2be87994d150a2218293128fea668bea")
    assert row.text == "File: config.yaml\nPath: src/a/config.yaml\n\nx"


def test_relevance_golden(spark):
    golden = {7.0: (100, "High"), 6.0: (98, "High"), 1.1: (77, "High"), 0.407: (64, "Good"), 0.0: (55, "Fair"), -0.4: (47, "Fair"), -1.428: (29, "Low"), -3.373: (15, "Low"), -20.0: (12, "Low")}
    pct, label = fusion.relevance(F.col("s"))
    got = {r.s: (r.p, r.l) for r in spark.createDataFrame([(s,) for s in golden], "s double").select("s", pct.alias("p"), label.alias("l")).collect()}
    assert got == golden


def test_percentiles_golden(spark):
    table = spark.createDataFrame([("a", float(i), i) for i in range(1, 101)], "k string, v double, i int")
    assert tuple(metrics.latency_percentiles(table, "k", "v").first()) == ("a", 100, 51.0, 96.0, 100.0)


def test_score_parsing_golden(spark):
    golden = {"8,3,9,5": [0.8, 0.3, 0.9, 0.5], "Scores: 8, 3": [0.8, 0.3, 0.3, 0.2], "none": [0.5, 0.4, 0.3, 0.2], "0.9, 0.2, 0.1, 0.4": [0.9, 0.2, 0.1, 0.4], "12,3,1,1": [1.0, 0.3, 0.1, 0.1], "[INST] 1,2 [/INST] 4": [0.4, 0.4, 0.3, 0.2]}
    got = {r.a: r.s for r in spark.createDataFrame([(a,) for a in golden], "a string").select("a", rerank.parsed_scores(F.col("a"), F.lit(4)).alias("s")).collect()}
    assert got == golden


def test_query_understanding_golden(spark):
    q = spark.createDataFrame([("where is AuthService defined in auth.py",), ("explain how model loading works",), ("sorting function in python",), ("plain words",)], "q string")
    intent, confidence = understanding.intent(F.col("q"))
    kind, language, refined = understanding.scope(F.col("q"))
    rows = q.select(intent.alias("i"), confidence.alias("c"), understanding.language_hints(F.col("q")).alias("h"), understanding.path_hints(F.col("q")).alias("p"), understanding.symbol_hints(F.col("q")).alias("s"), understanding.filters(F.col("q")).alias("f"), kind.alias("k"), language.alias("l"), refined.alias("r")).collect()
    assert (rows[0].i, rows[0].c, rows[0].h, rows[0].p, rows[0].s) == ("lookup", 0.8, ["py"], ["auth.py"], ["AuthService"])
    assert rows[0].f == {"language": ["py"], "path_pattern": ["auth.py"]}
    assert rows[1].k == "explanation" and (rows[2].k, rows[2].l, rows[2].r) == ("lookup", "python", "sorting function")
    assert (rows[3].i, rows[3].c, rows[3].l) == ("lookup", 0.5, None)


def ask(search, question, generate, max_steps=1):
    """The loop over one question: (answer, number of texts, steps)."""
    known, query, seen, answer = [], question, set(), ""
    for step in range(max_steps):
        if query not in seen:
            seen.add(query)
            known += [r.text for r in search(query, rag.PER_STEP).limit(rag.PER_STEP).collect() if r.text not in known]
        if not known and step == 0:
            return rag.NOTHING, 0, 1
        answer = generate(question, "\n".join(known))
        again = re.search(r"SEARCH:\s*(.+)", answer)
        if not again:
            return answer, len(known), step + 1
        query = again[1].strip()
    return re.sub("SEARCH:.*", rag.ENDED, answer), len(known), max_steps


def test_context_and_loop(spark):
    row = spark.createDataFrame([(0, 1, "src/foo.py", 10, 12, " def foo "), (0, 2, None, 0, None, "x")], "q int, rank int, path string, start_line int, end_line int, text string")
    context = rag.contexts(row, "q", [F.asc("rank")]).first().context
    assert "Source [1]: src/foo.py (Lines 10-12)\ndef foo" in context and "Source [2]: unknown (Lines ?-?)" in context
    assert spark.range(1).select(rag.without_search(F.lit('Hm. SEARCH: more')).alias('a')).first().a == 'Hm. *Max search steps reached. Best effort answer:*'


def test_splitter():
    assert [len(c) for c in chunking.split_text("a" * 1000, 200, 0)] == [200] * 5


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_splitter_keeps_words_and_size(text, size):
    chunks = chunking.split_text(text, size, 0)
    assert all(0 < len(c) <= size for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_fixed_chunks_golden(spark):
    rows = spark.createDataFrame([(1, "p", "x" * 2500), (2, "q", "")], "doc_id int, path string, text string")
    assert [(r.chunk_index, len(r.content)) for r in chunking.fixed_chunks(rows).orderBy("chunk_index").collect()] == [(0, 1000), (1, 1000), (2, 900)]


def test_code_blocks():
    found = chunking.code_blocks("class A:\n    def m(self):\n        pass\n\ndef f():\n    return 1\n", "python")
    assert [(b[1], b[2], b[3], b[4]) for b in found] == [("class", ["A"], 1, 3), ("method", ["A.m"], 2, 3), ("function", ["f"], 5, 6)]
    assert chunking.code_blocks("x = 1", "python")[0][1] == "module" and chunking.code_blocks("def (", "python")[0][1] == "module"
    assert [b[2] for b in chunking.code_blocks("function go() {\n  return {}\n}\nclass K {\n}\n", "javascript")] == [["go"], ["K"]]


def test_tree_and_glob(spark):
    tree = {(r.parent, r.name, r.type) for r in catalog.file_tree(spark.createDataFrame([("b/x.py",), ("a.txt",), ("b/c/y.py",)], "path string")).collect()}
    assert tree == {("", "b", "folder"), ("", "a.txt", "file"), ("b", "x.py", "file"), ("b", "c", "folder"), ("b/c", "y.py", "file")}
    import re

    assert re.match(glob_pattern("src/*.p[yz]"), "src/a/b.py") and not re.match(glob_pattern("[!a]?"), "ab") and re.match(glob_pattern("[!a]?"), "ba")


def test_ignore_golden(spark):
    paths = ["node_modules/x.js", "a/__pycache__/m.pyc", "x.log", "src/main.py", "keep.txt", "b.txt"]
    rules = [*files.DEFAULT_IGNORES, "*.txt", "", "# c", "!keep.txt"]
    got = {r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").where(~files.ignored(F.col("p"), rules)).collect()}
    assert got == {"src/main.py", "keep.txt"}


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<p>one</p><script>x</script><p>two &amp; three</p>")
    (tmp_path / "b.txt").write_bytes(b"plain")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00\x80")
    rows = {r.path: (r.status, r.text) for r in files.parse(files.scan(spark, str(tmp_path))).select("path", "status", "text").collect()}
    assert rows == {"d/a.html": ("success", "one\n\ntwo & three"), "b.txt": ("success", "plain"), "c.bin": ("error", None)}


def test_debounce_golden(spark):
    at = lambda s: f"2024-01-01 00:00:{s:09.6f}"
    per = spark.createDataFrame([("p", at(t)) for t in (0, 1, 2, 10)], "k string, s string").select("k", F.col("s").cast("timestamp").alias("ts"))
    assert sorted((r.last.second, r.events) for r in watch.debounced(per, 3000, ["k"]).collect()) == [(2, 3), (10, 1)]
    together = spark.createDataFrame([(at(t),) for t in (0.0, 0.4, 1.5)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    for seconds in (1, 3600):
        assert sorted(r.events for r in watch.debounced_globally(together, 500, bucket_seconds=seconds).collect()) == [1, 2]


def test_debounced_stream_matches_the_batch(spark, tmp_path):
    base = "2024-01-01 00:"
    times = [("p", "00:00"), ("p", "00:01"), ("q", "00:01"), ("p", "00:10"), ("p", "50:00"), ("q", "50:00")]
    rows = spark.createDataFrame([(k, base + s) for k, s in times], "k string, s string").select("k", F.col("s").cast("timestamp").alias("ts"))
    for i, part in enumerate((rows.where("minute(ts) < 30"), rows.where("minute(ts) >= 30"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = watch.debounced_stream(stream, "k", idle_ms=3000, late="1 second")
    query = out.writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.key, r.events) for r in spark.table("flushes").collect())
    assert got == [("p", 1), ("p", 2), ("q", 1)]


def test_index_upkeep(spark):
    corpus = docs(spark, a="x y x", b="y z")
    assert {(r.doc_id, r.term, r.tf) for r in index.postings(corpus).collect()} == {("a", "x", 2), ("a", "y", 1), ("b", "y", 1), ("b", "z", 1)}
    new = docs(spark, b="new", c="c")
    merged = index.replace_by_key(corpus, new, ["doc_id"])
    assert {(r.doc_id, r.text) for r in merged.collect()} == {("a", "x y x"), ("b", "new"), ("c", "c")}
    again = index.replace_by_key(merged, new, ["doc_id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))
    assert index.delete(corpus, new, "doc_id").count() == 1


def test_settings():
    s = admin.Settings({"hybrid": {"rrf_k": 60}, "a": {"b": {"c": 1}}}, {"BRINDLE_A_B_C": "2.5", "OTHER": "x"})
    assert s.get("a.b.c") == 2.5 and admin.unflatten(admin.flatten({"x": {"y": 1}})) == {"x": {"y": 1}}
    s.snapshot()
    s.set("hybrid.rrf_k", 100)
    s.rollback(0)
    assert s.get("hybrid.rrf_k") == 60 and s.version == 2 and s.nested("a") == {"b": {"c": 2.5}}
    with pytest.raises(ValueError):
        s.set("hybrid.rrf_k", 0)
    assert admin.coerce("true") is True and admin.coerce("1,b") == [1, "b"]


def test_roles_and_sparse(spark):
    roles = spark.createDataFrame([("admin",), ("member",), ("viewer",), ("guest",)], "r string")
    assert [x.a for x in roles.select(admin.allowed(F.col("r"), "member").alias("a")).collect()] == [True, True, False, False]
    vector = encoders.keyword_vector(docs(spark, a="the THE of cat"))
    assert {(r.term, r.val) for r in vector.collect()} == {("the", 2.0), ("cat", 1.0)}
    assert spark.range(1).select(tokens(F.lit("Ünï-x2 " + "y" * 41)).alias("t")).first().t == ["ünï", "x2"]


def test_dense_search_in_blocks_is_the_same(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)], "vec_id int, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "vec_id", "score").collect()))
    assert rows(retrieve.dense_search(vectors, queries, 5)) == rows(retrieve.dense_search(vectors, queries, 5, few=7))


def test_dense_search_leaves_out_what_has_no_direction(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, [1.0, 1.0]), (7, [2.0, 0.0])], "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 0.0])], "qid string, q array<double>")
    got = [(r.qid, r.rank, r.vec_id, r.score) for r in retrieve.dense_search(vectors, queries, 2).orderBy("rank").collect()]
    assert got == [("a", 1, 1, 1.0), ("a", 2, 7, 1.0)]


def test_ingest_goes_on_from_its_checkpoint(spark, tmp_path):
    schema, order = "path string, version int", [F.desc("version")]
    source, rows, seen = str(tmp_path / "in"), str(tmp_path / "rows"), []
    sink = watch.batch_sink(rows)

    def run(versions):
        spark.createDataFrame(versions, schema).write.mode("append").parquet(source)
        watch.ingest_stream(spark, source, schema, lambda r, n: (seen.append(n), sink(r, n), sink(r, n)), str(tmp_path / "checkpoint"), rules=["skip/"]).awaitTermination()
        return sorted(map(tuple, watch.current(spark, rows, schema, "path", order).collect()))

    assert run([("a", 1), ("b", 1), ("skip/c", 1), ("x/skip/d", 1)]) == [("a", 1), ("b", 1)]
    assert run([("a", 3), ("a", 2)]) == [("a", 3), ("b", 1)] and seen == [0, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(3, 20), st.integers(0, 9))
def test_splitter_with_overlap_equals_a_search_for_every_cut(text, size, overlap):
    """Chunks are the longest runs of pieces that fit; the next begins at the first piece from which at most the overlap is repeated and the next piece fits."""
    overlap = min(overlap, size - 1)

    def merged(parts):
        out, start, total = [], 0, lambda a, b: sum(map(len, parts[a:b]))
        while start < len(parts):
            end = max(e for e in range(start + 1, len(parts) + 1) if e == start + 1 or total(start, e) <= size)
            out.append("".join(parts[start:end]).strip())
            if end == len(parts):
                break
            start = min(s for s in range(start, end + 1) if s == end or (total(s, end) <= overlap and total(s, end) + len(parts[end]) <= size))
        return [c for c in out if c]

    def chunks(text, separators):
        separator = next(s for s in separators if not s or s in text)
        finer = separators[separators.index(separator) + 1 :]
        first, *rest = text.split(separator) if separator else ("", *text)
        parts, out, short = [p for p in [first, *(separator + r for r in rest)] if p], [], []
        for part in parts:
            if len(part) <= size:
                short.append(part)
            else:
                out, short = out + merged(short) + (chunks(part, finer) if finer else [part]), []
        return out + merged(short)

    assert chunking.split_text(text, size, overlap) == chunks(text, chunking.SEPARATORS)


def test_deep_dive_answers_like_the_loop_over_one_question(spark):
    corpus = docs(spark, a="amber one", b="amber two", c="cloud three", d="window four", e="cloud cloud five").withColumn("path", F.concat(F.lit("p/"), "doc_id"))
    lines = {"start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")}

    def search(asked, k):
        return retrieve.bm25(corpus, asked, k).join(corpus, "doc_id").withColumns(lines)

    def generate(question, context):
        more = F.when(~F.contains(context, F.lit("cloud")), "SEARCH: cloud").when(~F.contains(context, F.lit("window")), "SEARCH: window")
        return F.when(F.contains(question, F.lit("stuck")), "Hm. SEARCH: nowhere").otherwise(F.coalesce(more, F.lit("done")))

    def plain(question, context):
        more = "SEARCH: cloud" if "cloud" not in context else "SEARCH: window" if "window" not in context else "done"
        return "Hm. SEARCH: nowhere" if "stuck" in question else more

    texts = ["amber", "cloud", "nothing here", "amber stuck", "window cloud"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
    got = {r.qid: (r.answer, r.sources, r.steps) for r in rag.deep_dive(search, asked, generate).collect()}
    one = lambda q, k: search(spark.createDataFrame([(0, q)], "qid int, text string"), k).orderBy("rank")
    for i, text in enumerate(texts):
        assert got[i] == ask(one, text, plain, max_steps=3), text


def test_ingest_without_a_first_scan(spark, tmp_path):
    """What is there when watching begins is left out, and nothing else: in an empty folder the first new file counts."""
    schema, order = "path string, version int", [F.desc("version")]
    for name, there in (("empty", []), ("filled", [("old", 1)])):
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "rows")
        (tmp_path / name / "in").mkdir(parents=True)

        def add(*rows, source=source):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

        def run(source=source, out=out, name=name):
            watch.ingest_stream(spark, source, schema, watch.batch_sink(out), str(tmp_path / name / "checkpoint"), version=order, initial=False).awaitTermination()
            return sorted(map(tuple, watch.current(spark, out, schema, "path", order).collect()))

        if there:
            add(*there)
        assert run() == []
        add(("a", 1))
        assert run() == [("a", 1)]
        add(("b", 1), ("a", 2))
        assert run() == [("a", 2), ("b", 1)] == run()


def test_changes_reach_the_index_in_the_order_of_their_versions(spark, tmp_path):
    import random

    from brindle.operators import indexed, segments

    schema, rng = "path string, version int, text string, gone boolean", random.Random(9)
    feed = [(f"p{rng.randrange(6)}", v, f"word{rng.randrange(4)} w{v}", rng.random() < 0.3) for v in range(24)]
    feed += [("q", 100, "word1 first", False), ("q", 102, "", True)]
    late = [("q", 101, "word1 late", False), ("z", 7, "word0", True), *feed[3:5]]
    rng.shuffle(feed)
    sink = watch.index_sink(str(tmp_path / "store"))
    source = str(tmp_path / "in")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        watch.ingest_stream(spark, source, schema, lambda r, n: (sink(r, n), sink(r, n)), str(tmp_path / "checkpoint")).awaitTermination()

    for part in (feed[:9], feed[9:17], feed[17:], late):
        run(part)
    last = {}
    for path, version, text, gone in [*feed, *late]:
        last[path] = max(last.get(path, (-1,)), (version, text, gone))
    expected = {p: t for p, (_, t, gone) in last.items() if not gone}
    index = segments.live(spark, str(tmp_path / "store" / "index"))
    assert {r.doc_id for r in index.living(index.table("documents")).collect()} == set(expected) and index.n == len(expected)
    found = indexed.search_text(spark, str(tmp_path / "store" / "index"), "word1")
    assert {r.doc_id for r in found.collect()} == {p for p, t in expected.items() if "word1" in t.split()}


def test_unchanged_files_dont_come_again(spark, tmp_path):
    schema, source, out = "path string, hash string", str(tmp_path / "in"), str(tmp_path / "out")
    steps = [[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")], [("b", "2"), ("a", "1")], [("b", "1"), ("c", "1"), ("d", "1")]]
    expected, last = [], {}
    for step in steps:  # each run goes on from the checkpoint
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(source)
        stream = watch.changed_stream(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        expected += [e for e in step if last.get(e[0]) != e[1]]
        last |= dict(step)
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(expected)


def walk(tree: dict[str, str], names=(".gitignore", ".ignore")) -> set[str]:
    """A walk that goes down folder by folder."""
    import fnmatch

    kept = set()

    def match(pattern: str, parts: list[str], folder: bool) -> bool:
        only_folder, body = pattern.endswith("/"), pattern.strip("/")
        if only_folder and not folder:
            return False
        tied = "/" in pattern.rstrip("/")
        want = body.split("/")

        def fits(want, parts):
            if not want:
                return not parts
            if want[0] == "**":
                return bool(parts) if len(want) == 1 else any(fits(want[1:], parts[i:]) for i in range(len(parts) + 1))
            return bool(parts) and fnmatch.fnmatchcase(parts[0], want[0].replace("[^", "[!")) and fits(want[1:], parts[1:])

        return fits(want, parts) if tied else any(fits(want, parts[i:]) for i in range(len(parts)))

    def ignored(parts: list[str], folder: bool) -> bool:
        for name in reversed(names):
            for depth in range(len(parts) - 1, -1, -1):
                lines = tree.get("/".join([*parts[:depth], name]), "").splitlines()
                for line in reversed(lines):
                    if line and not line.startswith("#"):
                        keeps = line.startswith("!")
                        if match(line.removeprefix("!"), parts[depth:], folder):
                            return not keeps
        return False

    for path in tree:
        parts = path.split("/")
        if not any(ignored(parts[:n], n < len(parts)) for n in range(1, len(parts) + 1)):
            kept.add(path)
    return kept


def test_a_walk_heeds_the_ignore_files_of_every_folder(spark):
    tree = {
        ".gitignore": "*.log\nbuild/\n/top.txt\n# c\n\n!keep.log\ndocs/**/draft.md\n**/tmp\n[a-c]?.bin\n[!x]z.q",
        "a/.gitignore": "!x.log\nnested/\n*.md", "a/b/.ignore": "!*.md\n/only", "a/b/.gitignore": "*.rs", "build/.gitignore": "!*",
    }
    names = ["x.log", "keep.log", "top.txt", "y.md", "draft.md", "only", "z.rs", "tmp", "a1.bin", "d1.bin", "xz.q", "yz.q", "plain"]
    tree |= {f"{folder}{name}": "" for folder in ("", "a/", "a/b/", "build/", "a/nested/", "docs/", "docs/p/q/", "a/b/only2/", "a/tmp/") for name in names}
    table = spark.createDataFrame([(p, c.encode()) for p, c in tree.items()], "path string, content binary")
    got = {r.path for r in files.not_ignored(table).collect()}
    assert got == walk(tree) and 20 < len(got) < len(tree)
    own = {p.replace(".ignore", ".own"): c for p, c in tree.items()}
    table = spark.createDataFrame([(p, c.encode()) for p, c in own.items()], "path string, content binary")
    assert {r.path for r in files.not_ignored(table, (".gitignore", ".own")).collect()} == walk(own, (".gitignore", ".own"))


def test_ignore_patterns(spark):
    cases = [("*.py[co]", "a/m.pyc", True), ("*.py[co]", "m.pyx", False), ("[!a]x", "bx", True), ("[^a]x", "ax", False), ("\\#x", "#x", True), ("\\!x", "!x", True), ("#x", "#x", False), ("a[", "a[", True), ("x\\ ", "x ", True), ("x  ", "x", True), ("a/**/b", "a/b", True), ("a/**/b", "a/c/d/b", True), ("/a/*", "b/a/c", False), ("[]-]", "]", True), ("[", "[", True)]
    for rule, path, expected in cases:
        assert spark.range(1).select(files.ignored(F.lit(path), [rule]).alias("i")).first().i is expected, (rule, path)
    assert spark.range(1).select(files.ignored(F.lit("a.log"), ["*.log", "!!a.log", "!a.log"]).alias("i")).first().i is False


def test_lists_of_texts_are_added_up_where_they_stand(spark, monkeypatch):
    """Keyword and weighted-term lists without an exchange of words equal those of counted vectors, repeated and missing ids included."""
    import random

    import numpy as np

    from brindle.functions.text import tokens

    rng, words = random.Random(4), [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.choice([5, 40, 90]))) for i in range(400)] + [(3, text(9)), (3, text(20)), (None, text(30)), (None, text(30)), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, text(12)) for i in range(30)], "qid int, text string")
    listed = lambda df: sorted((r.qid, r["rank"], r.doc_id or -1, r.score) for r in df.collect())
    kinds = [(encoders.keyword_vector, encoders.keywords(), lambda n: n), (encoders.term_weights, tokens(F.col("text")), np.sqrt)]
    for vector, own, weigh in kinds:
        make = lambda keep, vector=vector: vector(docs, buckets=100, keep=keep)
        queries = vector(asked, key="qid", buckets=100)
        expected = listed(retrieve.sparse_search(make, queries, 7))
        for pieces in (1 << 21, 50):
            monkeypatch.setattr("brindle.operators.products.PRODUCTS", pieces)
            found = retrieve.sparse_words(docs, own, queries, weigh, make, 100, 7)
            assert listed(found) == expected and len(expected) == 30 * 7
        assert listed(retrieve.sparse_words(docs, own, queries, weigh, make, 100, 7, few=5)) == expected
    plan = retrieve.sparse_words(docs, own, queries, weigh, make, 100, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Explode" not in plan and "Generate" not in plan
    scores = retrieve.top_k(retrieve.bm25_scores(docs, retrieve.query_terms(asked)).drop("matched"), 7)
    assert listed(retrieve.bm25(docs, asked, 7)) == listed(scores)


def test_an_encoder_is_called_once_a_text(spark):
    texts = spark.createDataFrame([("a b",), ("",), ("c",)], "text string")
    vectors = texts.select(encoders.dense(F.col("text")).alias("v")).where("size(v) = 64 AND exists(v, x -> x <> 0)")
    assert vectors._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and vectors.count() == 2
