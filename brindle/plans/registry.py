"""One query per operator of the engine over the given tables, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import hash_uuid, stable_bucket, tokens
from brindle.operators import admin, catalog, cells, chunking, encoders, fusion, index, indexed, metrics, rag, rerank, retrieve, segments, understanding
from brindle.session import shared_path, spread
from brindle.sources import files
from brindle.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


# ---- SQL pieces

PATH = "source || '/' || doc_id || '.' || lang || '.txt'"
C = f"c AS (SELECT doc_id, {PATH} AS path, source AS org_id, lang AS language, text, n_chars FROM documents)"
TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) < 40)"
ITEMS = "q AS (SELECT item_id AS qid, text FROM benchmark)"
FIRST = "q AS (SELECT 0 AS qid, text FROM benchmark ORDER BY item_id LIMIT 1)"
TERMS = f"qt AS (SELECT qid, unnest({TOK}) AS term FROM q), terms AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS weight FROM qt GROUP BY ALL)"


def bm25_ctes(docs: str = "documents") -> str:
    """Scores s(qid, doc_id, score) of ``docs`` for terms, statistics from all documents."""
    return rf"""
tok AS (SELECT doc_id, unnest({TOK}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT doc_id, len({TOK}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
s AS (SELECT t.qid, f.doc_id,
        round(sum(t.weight * (ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))))), 6) AS score
      FROM terms t JOIN tf f USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), st
      WHERE f.doc_id IN (SELECT doc_id FROM {docs}) GROUP BY 1, 2)"""


def ranked(source: str, k: int, name: str = "r", key: str = "doc_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS rank FROM {source}) WHERE rank <= {k})"


def items(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def first_item(spark, d):
    """The benchmark's first item as the one query."""
    return t(spark, d, "benchmark").orderBy("item_id").limit(1).select(F.lit(0).alias("qid"), "text")


# ---- sources

RULES = [*files.DEFAULT_IGNORES, "# site", "fr/", "*5", "!*25", "/de/1*", "[3-4]?[!0-6]", "\\#x"]


def _case(column: str, rules: list[str]) -> str:
    out = "false"
    for keeps, pattern in filter(None, map(files.ignore_rule, rules)):
        out = f"CASE WHEN regexp_matches({column}, '{files.ignore_expression(pattern)}') THEN {str(not keeps).lower()} ELSE {out} END"
    return out


URL = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^[^/]*/', '')"


@query(f"WITH p AS (SELECT page_id, {URL} AS path FROM pages) SELECT page_id, path, {_case('path', RULES)} AS ignored FROM p")
def a3_ignore_filter(spark, d):
    paths = t(spark, d, "pages").select("page_id", F.regexp_replace(files.url_path(F.col("url")), "^[^/]*/", "").alias("path"))
    return paths.withColumn("ignored", files.ignored(F.col("path"), RULES))


@query("""SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE lang <> 'de' AND NOT
CASE WHEN regexp_matches(CAST(doc_id AS VARCHAR), '^[12]') THEN true WHEN doc_id % 100 = 17 THEN false ELSE doc_id % 10 = 7 END""")
def a2_nested_ignores(spark, d):
    """A walk over the documents as files, with ignore files in the root, in each source's folder and in each language's."""
    docs = t(spark, d, "documents")
    paths = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit("").alias("content"))
    rules = lambda folder, text: docs.select(F.concat(folder, F.lit(".gitignore")).alias("path"), F.lit(text).alias("content")).distinct()
    tree = [rules(F.lit(""), "*7.txt\n# all"), rules(F.concat("source", F.lit("/")), "!*17.txt\n/de/"), rules(F.concat("source", F.lit("/"), "lang", F.lit("/")), "[12]*.txt\n\\!x")]
    return files.not_ignored(reduce(DataFrame.unionByName, tree, paths)).where(~F.endswith("path", F.lit(".gitignore"))).select("path")


@query("SELECT doc_id, try(decode(CASE WHEN doc_id % 3 = 0 THEN unhex(md5(text)) ELSE encode(text) END)) IS NOT NULL AS is_text FROM documents")
def a4_text_sniff(spark, d):
    """Every third document is replaced by the bytes of its MD5, which are rarely text."""
    content = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.md5(F.col("text").cast("binary")))).otherwise(F.col("text").cast("binary"))
    return t(spark, d, "documents").select("doc_id", files.is_text(content).alias("is_text"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def a5_content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", files.content_hash(F.col("text")).alias("hash"))


@query(f"WITH {C} SELECT path, sha256(text) AS hash, doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a6_changed_files(spark, d):
    """The labelled documents are the snapshot."""
    now = files.corpus(spark, d).select("path", files.content_hash(F.col("text")).alias("hash"), "doc_id")
    return files.changed(now, now.join(t(spark, d, "labels"), "doc_id", "left_semi"))


@query(f"WITH {C} SELECT path, sha256(text) AS hash FROM c UNION ALL SELECT path, sha256('new ' || text) FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def a6_changed_stream(spark, d):
    """Two scans of all documents as a stream, those of good quality having a new text in the second: what comes is new or changed."""
    folder, rows = shared_path(spark, "scans"), files.corpus(spark, d)
    good = t(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("new ").alias("mark"))
    later = rows.join(good, "doc_id", "left").withColumn("text", F.concat(F.coalesce("mark", F.lit("")), "text"))
    for n, scan in enumerate((rows, later)):
        scan.select("path", files.content_hash(F.col("text")).alias("hash")).write.parquet(f"{folder}/in/{n}")
        stream = watch.changed_stream(spark.readStream.schema("path string, hash string").parquet(f"{folder}/in/*"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, hash string").parquet(f"{folder}/out")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS text FROM pages")
def a8_html_text(spark, d):
    return t(spark, d, "pages").select("page_id", files.strip_tags(F.col("html")).alias("text"))


@query()
def a9_parse_files(spark, d):
    pages = t(spark, d, "pages").select("page_id", F.concat(files.url_path(F.col("url")), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return files.parse(pages).select("page_id", "status", "text")


ENDED = "source || '/' || doc_id || CASE lang WHEN 'en' THEN '.PY' WHEN 'de' THEN '.rs' WHEN 'fr' THEN '.md' ELSE '' END"


def _ended():
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".PY").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".md").otherwise(""))


def _map_case(ending: str, table: dict[str, str], default: str) -> str:
    return f"CASE {ending} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


ENDING = "lower(regexp_extract(path, '([.][^./]+)$', 1))"
ENDING_OF_ENDED = f"lower(regexp_extract({ENDED}, '([.][^./]+)$', 1))"
VIEWER_ENDING, TEXT_LANGUAGE = "lower(string_split(path, '.')[-1])", "'text'"


@query(f"WITH p AS (SELECT doc_id, {ENDED} AS path FROM documents) SELECT doc_id, {_map_case(ENDING, files.LANGUAGES, 'NULL')} AS language FROM p")
def a10_language_by_ext(spark, d):
    return t(spark, d, "documents").select("doc_id", files.language(_ended()).alias("language"))


@query(f"WITH p AS (SELECT doc_id, {ENDED} AS path FROM documents) SELECT doc_id, {_map_case(VIEWER_ENDING, files.VIEWER_LANGUAGES, TEXT_LANGUAGE)} AS language FROM p")
def a11_viewer_language(spark, d):
    return t(spark, d, "documents").select("doc_id", files.viewer_language(_ended()).alias("language"))


# ---- chunks


@query(f"WITH {C} SELECT path, 'module' AS chunk_type, CAST(1 AS INTEGER) AS start_line, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS end_line, text AS content FROM c WHERE text <> ''")
def b2_module_fallback(spark, d):
    return chunking.ast_chunks(files.corpus(spark, d)).select("path", "chunk_type", "start_line", "end_line", "content")


#: A file in each language, N being its name: braces and ends in notes and texts, and the blocks (node type, kind, name, first and last line).
CODE = {
    "python": ("class N:\n    def name(self):\n        return '}'\n\ndef makeN():\n    return N()\n", [("class_definition", "class", "N", 1, 3), ("function_definition", "method", "N.name", 2, 3), ("function_definition", "function", "makeN", 5, 6)]),
    "javascript": ("class N {\n  name() { return '}'; }\n}\nconst makeN = () => new N();\n", [("class_declaration", "class", "N", 1, 3), ("method_definition", "method", "N.name", 2, 2), ("arrow_function", "function", "makeN", 4, 4)]),
    "typescript": ("export class N {\n  private name(a: string): string {\n    return `}`;\n  }\n}\n", [("class_declaration", "class", "N", 1, 5), ("method_definition", "method", "N.name", 2, 4)]),
    "tsx": ("export function N(p: P) {\n  return <div>{p.a}</div>; // }\n}\n", [("function_declaration", "function", "N", 1, 3)]),
    "go": ("type N struct {\n\tX int // }\n}\n\nfunc (n N) Name() string {\n\treturn \"}\"\n}\n\nfunc makeN() {}\n", [("type_declaration", "class", "N", 1, 3), ("method_declaration", "method", "N.Name", 5, 7), ("function_declaration", "function", "makeN", 9, 9)]),
    "rust": ("pub struct N;\nimpl N {\n    fn name(&self) -> char {\n        '}'\n    }\n}\n", [("struct_item", "class", "N", 1, 1), ("impl_item", "class", "N", 2, 6), ("function_item", "method", "N.name", 3, 5)]),
    "java": ("class N {\n    String name() {\n        return \"}\"; // }\n    }\n}\n", [("class_declaration", "class", "N", 1, 5), ("method_declaration", "method", "N.name", 2, 4)]),
    "c": ("struct N { int x; };\nint makeN(int a)\n{\n    return '}';\n}\n", [("struct_specifier", "class", "N", 1, 1), ("function_definition", "function", "makeN", 2, 5)]),
    "cpp": ("class N {\n public:\n  int name() { return '}'; }\n};\n", [("class_specifier", "class", "N", 1, 4), ("function_definition", "method", "N.name", 3, 3)]),
    "ruby": ("class N\n  def name # end\n    \"end\" if true\n  end\nend\n", [("class", "class", "N", 1, 5), ("method", "method", "N.name", 2, 4)]),
    "php": ("<?php\nclass N {\n    public function name() { return \"}\"; }\n}\nfunction makeN() {} # }\n", [("class_declaration", "class", "N", 2, 4), ("method_declaration", "method", "N.name", 3, 3), ("function_definition", "function", "makeN", 5, 5)]),
}


def _code_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    texts = ", ".join(f"({i}, {quoted(language)}, {quoted(text)})" for i, (language, (text, _)) in enumerate(CODE.items()))
    found = ", ".join(f"({i}, {n}, {quoted(node)}, {quoted(kind)}, {quoted(name)}, {first}, {last})" for i, (_, blocks) in enumerate(CODE.values()) for n, (node, kind, name, first, last) in enumerate(blocks))
    return f"""WITH c(i, language, text) AS (VALUES {texts}), b(i, n, node_type, chunk_type, symbols, start_line, end_line) AS (VALUES {found}),
f AS (SELECT 'Part' || p_partkey AS name, c.* FROM part JOIN c ON p_partkey % {len(CODE)} = i)
SELECT name AS path, language, CAST(n AS INTEGER) AS chunk_index, array_to_string(string_split(replace(text, 'N', name), chr(10))[start_line:end_line], chr(10)) AS content, chunk_type,
replace(symbols, 'N', name) AS symbols, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, node_type FROM f JOIN b USING (i)"""


@query(_code_sql())
def b1_ast_chunks(spark, d):
    """Each part as a file in one of eleven languages."""
    name = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("p_partkey", F.lit(len(CODE))) + 1).cast("int"))
    files_ = t(spark, d, "part").select(name.alias("path"), pick(CODE).alias("language"), F.replace(pick([text for text, _ in CODE.values()]), F.lit("N"), name).alias("text"))
    return chunking.ast_chunks(files_).withColumn("symbols", F.array_join("symbols", ","))


@query()
def b4_recursive_split(spark, d):
    return chunking.recursive_chunks(files.corpus(spark, d))


def _stride(size: int, overlap: int) -> str:
    return f"""WITH {C}, r AS (SELECT doc_id, path, text, unnest(generate_series(0, greatest(length(text) - 1 - {overlap}, 0), {size - overlap})) AS pos FROM c WHERE length(text) > 0)
SELECT doc_id, path, CAST(pos // {size - overlap} AS BIGINT) AS chunk_index, substr(text, pos + 1, {size}) AS content FROM r"""


@query(_stride(1000, 200))
def b4_fixed_stride_chunks(spark, d):
    return chunking.fixed_chunks(files.corpus(spark, d))


@query(_stride(1000, 0))
def b5_chunk_no_overlap(spark, d):
    return chunking.fixed_chunks(files.corpus(spark, d), overlap=0)


@query(f"WITH p AS (SELECT text, {_map_case(ENDING_OF_ENDED, files.LANGUAGES, 'NULL')} AS language FROM documents) SELECT CASE WHEN text = '' THEN 'skipped' WHEN language IS NOT NULL THEN 'ast' ELSE 'fallback' END AS status, count(*) AS files FROM p GROUP BY 1")
def b6_ingest_status(spark, d):
    rows = t(spark, d, "documents").select(chunking.ingest_status(F.col("text"), files.language(_ended())).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("files"))


@query(f"WITH {C} SELECT doc_id, 'File: ' || string_split(path, '/')[-1] || chr(10) || 'Path: ' || path || chr(10) || chr(10) || text AS content FROM c")
def b7_enhanced_content(spark, d):
    return files.corpus(spark, d).select("doc_id", chunking.enhanced(F.col("path"), F.col("text")).alias("content"))


@query(f"WITH {C} SELECT doc_id, regexp_replace(substr(sha256(path || ':0:' || text), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS chunk_id, sha256(path || ':0:' || text) AS content_hash FROM c")
def b8_chunk_ids(spark, d):
    key = F.concat_ws(":", "path", F.lit("0"), "text")
    return files.corpus(spark, d).select("doc_id", hash_uuid(key).alias("chunk_id"), files.content_hash(key).alias("content_hash"))


# ---- encoders

BUCKET = "CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) % 30000"
KEYWORDS = rf"""
kw AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[ \t\r\n\f\v]+', ' ', 'g')), ' ')) AS term FROM documents),
kv AS (SELECT doc_id, term, {BUCKET} AS idx, CAST(count(*) AS DOUBLE) AS val FROM kw WHERE length(term) > 2 GROUP BY doc_id, term)"""


@query()
def c1_latent_embed(spark, d):
    """Vectors from the corpus itself: latent semantic directions of all documents."""
    docs = t(spark, d, "documents")
    model = encoders.latent(docs)
    return docs.select("doc_id", encoders.dense(F.col("text"), lambda: model).alias("embedding"))


@query()
def c1_dense_embed(spark, d):
    return files.corpus(spark, d).select("doc_id", encoders.dense(F.col("text")).alias("dense"))


@query(rf"WITH w AS (SELECT doc_id, unnest({TOK}) AS term FROM documents) SELECT doc_id, {BUCKET} AS idx, round(ln(1 + greatest(max((length(term) - 5) * 0.5e0), 0e0)), 6) AS val FROM w GROUP BY 1, 2 HAVING max((length(term) - 5) * 0.5e0) > 0")
def c2_splade_pooling(spark, d):
    """Logits by word length stand for a model's."""
    words = t(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    logits = words.select("doc_id", stable_bucket(F.col("term"), encoders.BUCKETS).alias("idx"), ((F.length("term") - 5) * 0.5).alias("logit"))
    return encoders.pooled(logits).withColumn("val", F.round("val", 6))


@query(rf"WITH w AS (SELECT doc_id, unnest({TOK}) AS term FROM documents) SELECT doc_id, {BUCKET} AS idx, round(sqrt(count(*)), 6) AS val FROM w GROUP BY 1, 2")
def c4_bm42_weights(spark, d):
    return encoders.term_weights(t(spark, d, "documents")).withColumn("val", F.round("val", 6))


@query(f"WITH {KEYWORDS} SELECT * FROM kv".replace("WITH \n", "WITH "))
def c5_keyword_sparse(spark, d):
    return encoders.keyword_vector(t(spark, d, "documents"))


@query("""WITH m AS (SELECT user_id, max(ts) AS last, bool_or(event_type = 'view') AS loaded FROM events GROUP BY 1)
SELECT user_id, CAST((epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) // 1000000 AS BIGINT) AS idle_seconds FROM m WHERE loaded AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(last) > 86400000000""")
def c6_model_ttl(spark, d):
    """Users stand for models, views for loads, a day for the time to live."""
    events = _events(spark, d)
    models = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "view").alias("loaded"))
    now = models.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    idle = F.floor((F.unix_micros("now") - F.unix_micros("last")) / 1_000_000)
    return metrics.expired(now, F.col("now"), "last", 86_400).select("user_id", idle.alias("idle_seconds"))


# ---- index

NEW = "n AS (SELECT path, upper(text) AS text, 2 AS version FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), o AS (SELECT path, text, 1 AS version FROM c)"


@query(f"WITH {C}, {NEW} SELECT * FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n".replace("upper(text)", "'new ' || text"))
def e2_replace_by_key(spark, d):
    """Documents of good quality come again with a new text."""
    docs = files.corpus(spark, d)
    good = docs.join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("path", F.concat(F.lit("new "), "text").alias("text"), F.lit(2).alias("version"))
    return index.replace_by_key(docs.select("path", "text", F.lit(1).alias("version")), good, ["path"])


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def e3_upsert(spark, d):
    return index.upsert(t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "value")


@query(f"WITH w AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL) SELECT term, count(*) AS docs FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def e5_delete(spark, d):
    """Postings without the toxic documents, counted by term."""
    left = index.delete(index.postings(t(spark, d, "documents")), t(spark, d, "labels").where("toxic = 1"), "doc_id")
    return left.groupBy("term").agg(F.count("*").alias("docs"))


@query("SELECT count(*) AS docs FROM documents")
def e8_doc_count(spark, d):
    return t(spark, d, "documents").agg(F.count("*").alias("docs"))


@query(f"WITH w AS (SELECT doc_id, unnest({TOK}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL")
def e9_build_postings(spark, d):
    return index.postings(t(spark, d, "documents"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY ALL")
def e9_term_df(spark, d):
    return index.term_df(t(spark, d, "documents"))


@query(f"SELECT doc_id, CAST(len({TOK}) AS BIGINT) AS dl FROM documents")
def e9_doc_len(spark, d):
    return index.doc_lengths(t(spark, d, "documents"))


@query("SELECT source, count(*) AS deleted FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def e10_delete_doc(spark, d):
    """What a deletion of the toxic documents removes, by store."""
    docs = t(spark, d, "documents")
    gone = docs.join(t(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return gone.groupBy("source").agg(F.count("*").alias("deleted"))


def _edited_index(spark, d, **changes: DataFrame) -> str:
    """A stored index of all documents, edited."""
    path = shared_path(spark, "index")
    segments.create(t(spark, d, "documents"), path)
    segments.update(spark, path, **changes)
    return path


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'new ' || text ELSE text END AS text FROM documents),
w AS (SELECT doc_id, unnest({TOK}) AS term FROM x) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term""")
def e4_replace_postings(spark, d):
    """Documents of good quality come again with a new text: document and corpus frequencies from the stored postings."""
    docs = t(spark, d, "documents")
    good = docs.join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("new "), "text").alias("text"))
    stored = segments.live(spark, _edited_index(spark, d, add=good))
    return stored.living(segments.postings(stored.stored("blocks"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT 0::BIGINT AS n, count(*) AS postings FROM documents WHERE false")
def e6_clear(spark, d):
    """Documents of a stored index that was cleared, and what a search finds in it."""
    path = shared_path(spark, "index")
    segments.create(t(spark, d, "documents"), path)
    segments.clear(spark, path)
    return indexed.search(spark, path, items(spark, d)).agg(F.lit(segments.live(spark, path).n).cast("long").alias("n"), F.count("*").alias("postings"))


@query(f"WITH l AS (SELECT len({TOK}) AS dl FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM l")
def e10_delete_from_index(spark, d):
    """The statistics of the stored index after the toxic documents' deletion."""
    stored = segments.live(spark, _edited_index(spark, d, gone=t(spark, d, "labels").where("toxic = 1")))
    return stored.living(stored.table("documents")).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY ALL")
def e11_rebuild(spark, d):
    """Document frequencies of the labelled and of the other documents, added up: a rebuild by increments."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    parts = [index.term_df(docs.join(labels, "doc_id", how)) for how in ("left_semi", "left_anti")]
    return parts[0].unionByName(parts[1]).groupBy("term").agg(F.sum("df").alias("df"))


@query("SELECT count(*) AS chunks, count(embedding) AS dense, count(quality) AS sparse, count(CASE WHEN text <> '' THEN 1 END) AS lexical FROM documents LEFT JOIN (SELECT DISTINCT ON (vec_id) vec_id, embedding FROM embeddings) ON doc_id = vec_id LEFT JOIN labels USING (doc_id)")
def e13_ingest_summary(spark, d):
    """Documents with a vector, a label (for a sparse vector) and a text."""
    vectors, labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense")), t(spark, d, "labels").select("doc_id", F.col("quality").alias("sparse"))
    return index.summary(t(spark, d, "documents").join(vectors, "doc_id", "left").join(labels, "doc_id", "left"))


@query("SELECT n_name, count(*) AS merged, bool_or(s_acctbal > 5000) AS active, bool_or(s_acctbal < 0) AS gpu_enabled FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def e14_registry_merge(spark, d):
    rows = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return index.merge_registry(rows.select("n_name", (F.col("s_acctbal") > 5000).alias("active"), (F.col("s_acctbal") < 0).alias("gpu_enabled")), "n_name", ["active", "gpu_enabled"])


# ---- retrieval


@query(f"WITH {FIRST}, {TERMS}, {bm25_ctes()}, {ranked('s', 20)} SELECT * FROM r")
def f1_bm25_topk(spark, d):
    return retrieve.bm25(t(spark, d, "documents"), first_item(spark, d))


@query(f"WITH {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20)} SELECT * FROM r")
def f1_bm25_batch(spark, d):
    return retrieve.bm25(t(spark, d, "documents"), items(spark, d))


@query(SQL["f1_bm25_batch"])
def f1_bm25_indexed(spark, d):
    """The same from an index that is built first."""
    path = shared_path(spark, "index")
    segments.create(t(spark, d, "documents"), path)
    return indexed.search(spark, path, items(spark, d))


FINAL = f"""final AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'new ' || text ELSE text END AS text
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0))"""


@query(f"WITH {FINAL}, {ITEMS}, {TERMS}, {bm25_ctes('final').replace('FROM documents', 'FROM final')}, {ranked('s', 20)} SELECT * FROM r")
def e11_merged_segments(spark, d):
    """A search over an index that grew by segments: four of a quarter each, good documents coming again with a new text, toxic ones
    gone, and segments of one size merged; the same as over an index of what is left."""
    path, docs, labels = shared_path(spark, "index"), t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "labels")
    segments.create(docs.where("doc_id % 4 = 0"), path)
    for n in (1, 2, 3):
        segments.update(spark, path, add=docs.where(f"doc_id % 4 = {n}"))
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("new "), "text").alias("text"))
    segments.update(spark, path, add=good, gone=labels.where("toxic = 1 AND quality = 0"))
    while segments.merge(spark, path):
        pass
    return indexed.search(spark, path, items(spark, d))


def _words(n: int) -> str:
    return f"w AS (SELECT list_distinct({TOK}) AS d, {TOK} AS a FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)), dd AS (SELECT a AS a, list_filter(a, lambda x, i: list_position(a, x) = i) AS u FROM w), ws AS (SELECT u[1:{n}] AS u, a FROM dd)"


def _boolean(condition: str, used: str) -> str:
    return f"WITH {_words(4)}, terms AS (SELECT 0 AS qid, unnest({used}) AS term, 1e0 AS weight FROM ws), ok AS (SELECT doc_id FROM documents, ws WHERE {condition}), {bm25_ctes('ok')}, {ranked('s', 20)} SELECT * FROM r"


def _first_words(spark, d, n: int = 4) -> list[str]:
    """The first distinct words of the first benchmark item: the query a caller would type."""
    words = first_item(spark, d).select(F.slice(F.array_distinct(tokens(F.col("text"))), 1, n).alias("w")).first()
    return words.w if words else []


def _asked(spark, d, wanted: int, form: str) -> DataFrame:
    """Search with the first item's words in a query; no documents where it has fewer."""
    words, docs = _first_words(spark, d, wanted), t(spark, d, "documents")
    return indexed.search_docs(docs, form.format(*words) if len(words) == wanted else "")


@query(_boolean(f"list_contains({TOK}, u[1]) AND list_contains({TOK}, u[3])", "u[1:3]"))
def f1c_bm25_must(spark, d):
    return _asked(spark, d, 3, "+{0} {1} +{2}")


@query(_boolean(f"list_contains({TOK}, u[1]) AND list_contains({TOK}, u[2])", "u[1:2]"))
def f1c_bm25_and(spark, d):
    return _asked(spark, d, 2, "{0} AND {1}")


@query(_boolean(f"NOT list_contains({TOK}, u[4])", "u[1:2]"))
def f1c_bm25_not(spark, d):
    return _asked(spark, d, 4, "{0} {1} NOT {3}")


@query(_boolean(f"NOT contains(' ' || array_to_string({TOK}, ' ') || ' ', ' ' || u[1] || ' ' || u[2] || ' ')", "u[3:4]"))
def f1c_bm25_not_phrase(spark, d):
    return _asked(spark, d, 4, '{2} {3} -"{0} {1}"')


@query(f"""WITH w AS (SELECT {TOK}[1:2] AS a FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)),
n AS (SELECT doc_id, ' ' || array_to_string({TOK}, '  ') || ' ' AS x FROM documents)
SELECT doc_id, CAST((length(x) - length(replace(x, p, ''))) // length(p) AS BIGINT) AS n FROM n, (SELECT ' ' || array_to_string(a, '  ') || ' ' AS p FROM w) WHERE contains(x, p)""")
def f1c_bm25_phrase(spark, d):
    """How often the first two words of the first item follow each other."""
    phrase = first_item(spark, d).select(F.posexplode(F.slice(tokens(F.col("text")), 1, 2)).alias("place", "term"))
    return retrieve.phrase_positions(t(spark, d, "documents"), phrase)


HAS = lambda n: f"list_contains({TOK}, u[{n}])"
#: Forms of a query over the first item's words, with what they mean and the words that score.
FORMS = [
    ("({0} OR {1}) AND {2}", f"({HAS(1)} OR {HAS(2)}) AND {HAS(3)}", "u[1:3]"),
    ("{0} AND ({1} OR NOT {2})", f"{HAS(1)} AND ({HAS(2)} OR NOT {HAS(3)})", "u[1:2]"),
    ("+text:{0} -({1} {2})", f"{HAS(1)} AND NOT ({HAS(2)} OR {HAS(3)})", "u[1:1]"),
    ("IN [{0} {3}] -{1}", f"({HAS(1)} OR {HAS(4)}) AND NOT {HAS(2)}", "[u[1], u[4]]"),
    ("{0} AND [{1} TO {1}]^0 AND {2}", f"{HAS(1)} AND {HAS(2)} AND {HAS(3)}", "[u[1], u[3]]"),
]


@query(" UNION ALL ".join(f"SELECT {i} AS form, qid, rank, doc_id, score FROM ({_boolean(condition, used)})" for i, (_, condition, used) in enumerate(FORMS)))
def f1c_query_trees(spark, d):
    """Parentheses, NOT beside OR, field names, sets and ranges, from a stored index alone."""
    words, path = _first_words(spark, d), shared_path(spark, "index")
    segments.create(t(spark, d, "documents"), path)
    texts = [form.format(*words) if len(words) == 4 else "" for form, _, _ in FORMS]
    found = [indexed.search_text(spark, path, text).select(F.lit(i).alias("form"), "qid", "rank", "doc_id", "score") for i, text in enumerate(texts)]
    return reduce(DataFrame.unionByName, found)


@query(f"""WITH w AS (SELECT {TOK}[1:2] AS w FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)),
x AS (SELECT doc_id, {TOK} AS a FROM documents),
n AS (SELECT doc_id, CAST(len(list_filter(range(1, len(a) + 1), lambda i: a[i] = w[1] AND list_contains(a[i + 1:i + 3], w[2]))) AS BIGINT) AS n FROM x, w)
SELECT doc_id, n FROM n WHERE n > 0""")
def f1c_phrase_slop(spark, d):
    """From how many places of the first item's first word the second follows with at most two words between them, from stored positions."""
    words, path = first_item(spark, d).select(F.slice(tokens(F.col("text")), 1, 2).alias("w")).first().w, shared_path(spark, "index")
    segments.create(t(spark, d, "documents"), path)
    return indexed.phrase_counts(spark, path, words, slop=2)


@query(f"WITH {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20)} SELECT * FROM r WHERE score >= 30")
def f2_min_score(spark, d):
    return retrieve.bm25(t(spark, d, "documents"), items(spark, d), min_score=30.0)


@query(f"WITH {C}, {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20)} SELECT qid, rank, score, path, org_id, language FROM r JOIN c USING (doc_id)")
def f4_hydrate(spark, d):
    best = retrieve.bm25(t(spark, d, "documents"), items(spark, d))
    return best.join(files.corpus(spark, d), "doc_id").select("qid", "rank", "score", "path", "org_id", "language")


def _keyword_queries(spark, d):
    return encoders.keyword_vector(items(spark, d), key="qid")


QKW = KEYWORDS.replace("kw AS", "qkw AS").replace("kv AS", "qkv AS").replace("FROM kw", "FROM qkw").replace("doc_id", "qid").replace("FROM documents", "FROM q")


@query(f"WITH {ITEMS}, {KEYWORDS}, {QKW}, s AS (SELECT b.qid, a.doc_id, round(sum(a.val * b.val), 6) AS score FROM kv a JOIN qkv b ON a.idx = b.idx GROUP BY 1, 2), {ranked('s', 20)} SELECT * FROM r")
def f5_sparse_dot(spark, d):
    docs = t(spark, d, "documents")
    return retrieve.sparse_search(lambda keep: encoders.keyword_vector(docs, keep=keep), _keyword_queries(spark, d))


@query(f"""WITH qv AS (SELECT label AS qid, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, qv), {ranked('s', 20, key='vec_id')} SELECT * FROM r""")
def f6_dense_knn(spark, d):
    """One query vector per label: its first."""
    vectors = t(spark, d, "embeddings")
    queries = vectors.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("q"))
    return retrieve.dense_search(vectors, queries)


@query()
def f6_cell_knn(spark, d):
    """The same search by cells of a stored quantiser, of which half are probed: the vectors of these tables have no clusters."""
    vectors, path = t(spark, d, "embeddings").select("vec_id", "embedding", "label"), shared_path(spark, "cells")
    queries = vectors.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("q"))
    cells.build(vectors.select("vec_id", "embedding"), path)
    number = spark.read.parquet(f"{path}/centres").count()
    return cells.search(spark, path, queries, probes=max(1, number // 2))


TW = f"tw AS (SELECT doc_id, {BUCKET} AS idx, sqrt(count(*)) AS val FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2), qw AS (SELECT qid, {BUCKET} AS idx, sqrt(count(*)) AS val FROM (SELECT qid, unnest({TOK}) AS term FROM q) GROUP BY 1, 2), b AS (SELECT y.qid, x.doc_id, round(sum(x.val * y.val), 6) AS score FROM tw x JOIN qw y USING (idx) GROUP BY 1, 2)"


@query(f"WITH {ITEMS}, {TW}, {ranked('b', 20)} SELECT * FROM r")
def f7_bm42_sparse(spark, d):
    docs = t(spark, d, "documents")
    return retrieve.sparse_search(lambda keep: encoders.term_weights(docs, keep=keep), encoders.term_weights(items(spark, d), key="qid"))


@query(f"""WITH {FIRST}, {TW}, {ranked('b', 20, 'rb')},
qv AS (SELECT 0 AS qid, arg_min(embedding, vec_id) AS q FROM embeddings),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, qv), {ranked('s', 20, 'rd', 'vec_id')},
u AS (SELECT 0 AS ord, 'dense' AS retriever, rank, CAST(vec_id AS VARCHAR) AS id FROM rd UNION ALL SELECT 1, 'bm42', rank, CAST(doc_id AS VARCHAR) FROM rb)
SELECT id, fused_score, fs.o AS first_ord, fs.r AS first_rank, sources FROM (SELECT id, round(sum(1e0 / (1 + rank)), 6) AS fused_score, min(struct_pack(o := ord, r := rank)) AS fs, array_to_string(list_sort(list_distinct(list(retriever))), ',') AS sources FROM u GROUP BY id) ORDER BY fused_score DESC, fs, id LIMIT 20""")
def f8_hybrid_rrf2(spark, d):
    """Dense and weighted-term lists of one query, fused with constant 2 over places from 0."""
    vectors = t(spark, d, "embeddings")
    dense = retrieve.dense_search(vectors, vectors.agg(F.min_by("embedding", "vec_id").alias("q")).withColumn("qid", F.lit(0)))
    docs = t(spark, d, "documents")
    sparse = retrieve.sparse_search(lambda keep: encoders.term_weights(docs, keep=keep), encoders.term_weights(first_item(spark, d), key="qid"))
    both = fusion.tagged(("dense", dense.withColumnRenamed("vec_id", "doc_id")), ("bm42", sparse))
    return fusion.rrf(both, k=1, limit=20)


@query(f"WITH o AS (SELECT min(source) AS org FROM documents), own AS (SELECT doc_id FROM documents, o WHERE source = org), {ITEMS}, {TERMS}, {bm25_ctes('own')}, {ranked('s', 20)} SELECT * FROM r")
def f9_org_filter(spark, d):
    """One tenant's documents, with the statistics of all."""
    docs = t(spark, d, "documents")
    own = docs.join(docs.agg(F.min("source").alias("source")), "source", "left_semi")
    return retrieve.top_k(retrieve.bm25_scores(own, retrieve.query_terms(items(spark, d)), statistics=docs), 20).drop("matched")


def three_lists(spark, d) -> DataFrame:
    """BM25, keyword and weighted-term lists of twice ten documents for every item, tagged; the third is without dense search."""
    docs = t(spark, d, "documents")
    lexical = retrieve.bm25(docs, items(spark, d), k=20)
    keyword = retrieve.sparse_words(docs, encoders.keywords(), _keyword_queries(spark, d), lambda n: n, lambda keep: encoders.keyword_vector(docs, keep=keep), encoders.BUCKETS)
    weights = retrieve.sparse_words(docs, tokens(F.col("text")), encoders.term_weights(items(spark, d), key="qid"), np.sqrt, lambda keep: encoders.term_weights(docs, keep=keep), encoders.BUCKETS)
    return fusion.tagged(("bm25", lexical), ("splade", keyword), ("bm42", weights), by=("qid",))


LISTS = f"""{ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20, 'r0')}, {KEYWORDS}, {QKW},
sk AS (SELECT b.qid, a.doc_id, round(sum(a.val * b.val), 6) AS score FROM kv a JOIN qkv b ON a.idx = b.idx GROUP BY 1, 2), {ranked('sk', 20, 'r1')}, {TW}, {ranked('b', 20, 'r2')},
u AS (SELECT qid, 'bm25' AS retriever, 0 AS ord, rank, CAST(doc_id AS VARCHAR) AS id, score FROM r0 UNION ALL SELECT qid, 'splade', 1, rank, CAST(doc_id AS VARCHAR), score FROM r1 UNION ALL SELECT qid, 'bm42', 2, rank, CAST(doc_id AS VARCHAR), score FROM r2)"""
FUSED = """f AS (SELECT qid, id, round(sum(1e0 / (60 + rank)), 6) AS fused_score, min(struct_pack(o := ord, r := rank)) AS fs, array_to_string(list_sort(list_distinct(list(retriever))), ',') AS sources FROM u GROUP BY 1, 2),
fr AS (SELECT *, fs.o AS first_ord, fs.r AS first_rank, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, fs, id) AS place FROM f)"""


@query(f"WITH {LISTS}, {FUSED}, h AS (SELECT fr.*, source || '/' || lang AS folder FROM fr JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE place <= 10), p AS (SELECT *, row_number() OVER (PARTITION BY qid, folder ORDER BY fused_score DESC, first_ord, first_rank, id) AS n FROM h) SELECT qid, id, fused_score, first_ord, first_rank, sources, folder FROM p WHERE n = 1")
def f10_multi_retrieve(spark, d):
    """Three retrievers without dense search, fusion to ten, details, and the best of each file (source and language here)."""
    return best_of_files(spark, d, fusion.rrf(three_lists(spark, d), limit=10, by=("qid",)))


def best_of_files(spark, d, fused: DataFrame) -> DataFrame:
    folder = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "lang").alias("folder"))
    keyed = fused.join(folder, "id").withColumn("file", F.concat_ws("|", F.col("qid").cast("string"), "folder"))
    best = fusion.per_file(keyed, ["file"], fusion.by_score())
    return best.select("qid", "id", "fused_score", "first_ord", "first_rank", "sources", "folder")


def lists_with_dense(spark, d) -> DataFrame:
    """The three lists, the third being the hybrid: dense and weighted-term lists fused with constant 2 over places from 0."""
    lists = three_lists(spark, d)
    some = F.exists("embedding", lambda x: x != 0)
    vectors = t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), encoders.dense(F.col("text")).alias("embedding"))
    asked = items(spark, d).select("qid", encoders.dense(F.col("text")).alias("embedding")).where(some).withColumnRenamed("embedding", "q")
    dense = retrieve.dense_search(vectors, asked, k=20).select("qid", F.lit("dense").alias("retriever"), F.lit(0).alias("ord"), "rank", F.col("vec_id").cast("string").alias("id"), "score")
    both = dense.unionByName(lists.where("retriever = 'bm42'").withColumn("ord", F.lit(1)))
    hybrid = fusion.rrf(both, k=1, limit=20, by=("qid",))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*fusion.by_score())).cast("long")
    third = hybrid.select("qid", F.lit("bm42").alias("retriever"), F.lit(2).alias("ord"), place.alias("rank"), "id", F.col("fused_score").alias("score"))
    return lists.where("retriever <> 'bm42'").unionByName(third)


@query()
def f10_whole_search(spark, d):
    """The whole search: BM25, keywords and the hybrid of dense and weighted terms, fusion to ten, and the best of each file."""
    return best_of_files(spark, d, fusion.rrf(lists_with_dense(spark, d), limit=10, by=("qid",)))


# ---- fusion


@query()
def g1_rrf_fusion_dense(spark, d):
    """Fusion of the lists with dense search."""
    return fusion.rrf(lists_with_dense(spark, d), limit=10, by=("qid",))


@query(f"WITH {LISTS}, {FUSED} SELECT qid, id, fused_score, first_ord, first_rank, sources FROM fr WHERE place <= 10")
def g1_rrf_fusion(spark, d):
    return fusion.rrf(three_lists(spark, d), limit=10, by=("qid",))


@query(f"""WITH {FIRST}, {TERMS}, {bm25_ctes()}, {ranked('s', 20, 'r0')}, {TW}, {ranked('b', 20, 'r2')},
u AS (SELECT 'bm25' AS retriever, CAST(doc_id AS VARCHAR) AS id, score FROM r0 UNION ALL SELECT 'bm42', CAST(doc_id AS VARCHAR), score FROM r2),
n AS (SELECT *, (score - min(score) OVER (PARTITION BY retriever)) / CASE WHEN max(score) OVER (PARTITION BY retriever) = min(score) OVER (PARTITION BY retriever) THEN 1e0 ELSE max(score) OVER (PARTITION BY retriever) - min(score) OVER (PARTITION BY retriever) END AS norm FROM u)
SELECT id, round(sum(CASE retriever WHEN 'bm25' THEN 0.7e0 ELSE 0.3e0 END * norm), 6) AS fused_score FROM n GROUP BY id""")
def g2_weighted_fusion(spark, d):
    docs = t(spark, d, "documents")
    lists = fusion.tagged(("bm25", retrieve.bm25(docs, first_item(spark, d))), ("bm42", retrieve.sparse_search(lambda keep: encoders.term_weights(docs, keep=keep), encoders.term_weights(first_item(spark, d), key="qid"))))
    return fusion.weighted(lists, {"bm25": 0.7, "bm42": 0.3})


@query(f"""WITH {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20, 'r0')}, {TW}, {ranked('b', 20, 'r2')},
u AS (SELECT qid, 'bm25' AS retriever, CAST(doc_id AS VARCHAR) AS id, score FROM r0 UNION ALL SELECT qid, 'bm42', CAST(doc_id AS VARCHAR), score FROM r2),
m AS (SELECT qid, retriever, min(score) AS low, max(score) AS high FROM u GROUP BY ALL)
SELECT qid, id, round(sum(CASE retriever WHEN 'bm25' THEN 0.7e0 ELSE 0.3e0 END * ((score - low) / CASE WHEN high = low THEN 1e0 ELSE high - low END)), 6) AS fused_score FROM u JOIN m USING (qid, retriever) GROUP BY qid, id""")
def g2_weighted_fusion_batch(spark, d):
    """Weighted fusion for all items in one job."""
    docs, asked = t(spark, d, "documents"), items(spark, d)
    lists = fusion.tagged(("bm25", retrieve.bm25(docs, asked)), ("bm42", retrieve.sparse_search(lambda keep: encoders.term_weights(docs, keep=keep), encoders.term_weights(asked, key="qid"))), by=("qid",))
    return fusion.weighted(lists, {"bm25": 0.7, "bm42": 0.3}, by=("qid",))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text <> '') WHERE n = 1")
def g3_dedupe_key(spark, d):
    return fusion.first_per_key(t(spark, d, "documents").select("doc_id", "text"), "text", [F.asc("doc_id")])


PAGE_PATHS = r"SELECT page_id, length(html) AS score, CASE WHEN contains(url, '?') THEN '' ELSE regexp_replace(url, '#.*$', '') END AS full_path, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS file_path FROM pages"


@query(f"WITH p AS ({PAGE_PATHS}), k AS (SELECT *, coalesce(nullif(full_path, ''), nullif(file_path, '')) AS path FROM p) SELECT page_id, score, full_path, file_path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, page_id) AS n FROM k) WHERE n = 1 OR path IS NULL")
def g4_dedupe_path(spark, d):
    url = F.col("url")
    rows = t(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("score"), F.when(F.contains(url, F.lit("?")), "").otherwise(F.regexp_replace(url, "#.*$", "")).alias("full_path"), F.regexp_extract(url, "^[a-z]+://([^/]*)", 1).alias("file_path"))
    return fusion.per_file(rows, ["full_path", "file_path"], [F.desc("score"), F.asc("page_id")])


@query(f"WITH {LISTS}, {FUSED}, h AS (SELECT fr.*, source || '/' || lang AS folder FROM fr JOIN documents ON CAST(doc_id AS VARCHAR) = id), p AS (SELECT *, row_number() OVER (PARTITION BY qid, folder ORDER BY fused_score DESC, first_ord, first_rank, id) AS n FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, first_ord, first_rank, id) AS m FROM p WHERE n = 1) SELECT qid, id, fused_score, folder FROM k WHERE m <= 10")
def g6_fill_after_dedupe(spark, d):
    """Files first, then the limit."""
    return filled(spark, d, fusion.rrf(three_lists(spark, d), limit=None, by=("qid",)))


@query()
def g6_fill_after_dedupe_dense(spark, d):
    """The same with dense search."""
    return filled(spark, d, fusion.rrf(lists_with_dense(spark, d), limit=None, by=("qid",)))


def filled(spark, d, fused: DataFrame) -> DataFrame:
    folder = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "lang").alias("folder"))
    order = fusion.by_score()
    keyed = fused.join(folder, "id").withColumn("file", F.concat_ws("|", F.col("qid").cast("string"), "folder"))
    return metrics.last_n(fusion.per_file(keyed, ["file"], order), "qid", order, 10).select("qid", "id", "fused_score", "folder")


# ---- reranking


@query()
def h1_cross_encoder(spark, d):
    best = retrieve.bm25(t(spark, d, "documents"), items(spark, d), k=10)
    pairs = best.join(items(spark, d).withColumnRenamed("text", "question"), "qid").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rerank.apply_scores(pairs.withColumn("rerank_score", rerank.cross_encode(F.col("question"), F.col("text"))), "qid").select("qid", "doc_id", "rank", "rerank_score", "place")


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '(?s)^.*\[/INST\]', '') AS x FROM conversations),
l AS (SELECT *, regexp_extract(x, '([0-9]+(?:\.[0-9]+)?(?:\s*,\s*[0-9]+(?:\.[0-9]+)?)+)', 1) AS listed FROM a),
n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(CASE WHEN listed <> '' THEN listed ELSE x END, '([0-9]+(?:\.[0-9]+)?)', 1), lambda v: CAST(v AS DOUBLE)) AS n FROM l),
h AS (SELECT conv_id, turn, list_transform(n, lambda v: least(1e0, greatest(0e0, v / CASE WHEN len(list_filter(n, lambda w: w > 1)) > 0 THEN 10e0 ELSE 1e0 END))) AS h FROM n)
SELECT conv_id, turn, list_transform(list_concat(h, list_transform(range(0, greatest(0, 4 - len(h))), lambda i: greatest(0e0, coalesce(list_min(h), 0.5e0) - 0.1e0 * i)))[1:4], lambda v: round(v, 6)) AS scores FROM h""")
def h4_score_parse(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", rerank.parsed_scores(F.col("text"), F.lit(4)).alias("scores"))


@query(f"WITH {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20)} SELECT qid, doc_id, round(1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY qid), 6) AS rerank_score FROM r")
def h5_fallback_scores(spark, d):
    return rerank.descending_scores(retrieve.bm25(t(spark, d, "documents"), items(spark, d)), "qid", [F.asc("rank")]).select("qid", "doc_id", "rerank_score")


@query(f"WITH {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 20)}, x AS (SELECT qid, doc_id, rank, (n_chars % 100) / 100e0 AS rerank_score FROM r JOIN documents USING (doc_id)) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS place FROM x")
def h6_rerank_sort(spark, d):
    """Text lengths stand for a model's scores."""
    best = retrieve.bm25(t(spark, d, "documents"), items(spark, d)).join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rerank.apply_scores(best.select("qid", "doc_id", "rank", ((F.col("n_chars") % 100) / 100.0).alias("rerank_score")), "qid")


@query("""WITH e AS (SELECT event_id, (value - 50) / 8 AS s FROM events), p AS (SELECT event_id, CAST(CASE WHEN s > 6 THEN 100 ELSE greatest(12, floor((1 / (1 + exp(-s)) * 0.86e0 + 0.12e0) * 100 + 0.5e0)) END AS BIGINT) AS pct FROM e)
SELECT event_id, pct, CASE WHEN pct >= 75 THEN 'High' WHEN pct >= 60 THEN 'Good' WHEN pct >= 45 THEN 'Fair' ELSE 'Low' END AS label FROM p""")
def h7_relevance_label(spark, d):
    pct, label = fusion.relevance((F.col("value") - 50) / 8)
    return t(spark, d, "events").select("event_id", pct.alias("pct"), label.alias("label"))


# ---- query understanding


def _intent_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{n}'" for n, ps in understanding.INTENTS.items())
    return f"WITH i AS (SELECT conv_id, turn, CASE {whens} END AS x FROM conversations) SELECT conv_id, turn, coalesce(x, 'lookup') AS intent, CASE WHEN x IS NULL THEN 0.5e0 ELSE 0.8e0 END AS confidence FROM i"


@query(_intent_sql())
def i1_intent(spark, d):
    intent, confidence = understanding.intent(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", intent.alias("intent"), confidence.alias("confidence"))


def _hints_sql() -> str:
    each = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in understanding.HINTS.items())
    return f"SELECT conv_id, turn, array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') AS hints FROM conversations"


@query(_hints_sql())
def i2_lang_hints(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(understanding.language_hints(F.col("text")), ",").alias("hints"))


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"SELECT conv_id, turn, list_concat(regexp_extract_all(text, '{_sql_text(understanding.QUOTED_PATH)}', 1), regexp_extract_all(text, '{understanding.BARE_PATH}', 1)) AS paths FROM conversations")
def i3_path_hints(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", understanding.path_hints(F.col("text")).alias("paths"))


def _whole_words(pattern: str) -> str:
    return f"list_filter(string_split_regex(text, '{understanding.WORD_GAP}'), lambda w: regexp_full_match(w, '{pattern}'))"


@query(f"SELECT item_id, list_concat({_whole_words(understanding.MIXED_SYMBOL)}, {_whole_words(understanding.CAPITAL_SYMBOL)}) AS symbols FROM benchmark")
def i4_symbol_hints(spark, d):
    return t(spark, d, "benchmark").select("item_id", understanding.symbol_hints(F.col("text")).alias("symbols"))


@query(f"SELECT conv_id, turn, nullif(hints, '') AS languages, nullif(array_to_string(paths, ','), '') AS path_patterns FROM ({_hints_sql()}) JOIN ({SQL['i3_path_hints']}) USING (conv_id, turn)")
def i5_filters(spark, d):
    found = t(spark, d, "conversations").select("conv_id", "turn", understanding.filters(F.col("text")).alias("f"))
    return found.select("conv_id", "turn", F.array_join(F.col("f")["language"], ",").alias("languages"), F.array_join(F.col("f")["path_pattern"], ",").alias("path_patterns"))


_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in understanding.ALIASES.items())


@query(rf"""WITH x AS (SELECT item_id, 'explain ' || text || ' in python' AS q FROM benchmark UNION ALL SELECT 100000 + item_id, text FROM benchmark),
n AS (SELECT *, regexp_extract(lower(q), '{understanding.LANGUAGE}', 1) AS name FROM x)
SELECT item_id, CASE WHEN regexp_matches(lower(q), '{understanding.EXPLAIN}') THEN 'explanation' ELSE 'lookup' END AS intent, CASE WHEN name <> '' THEN CASE name {_ALIAS} ELSE name END END AS language, trim(CASE WHEN name <> '' THEN regexp_replace(q, '(?i){understanding.SCOPE}', '', 'g') ELSE q END) AS refined FROM n""")
def i7_scope(spark, d):
    """Items as they are, and as questions within a scope."""
    bench = t(spark, d, "benchmark")
    asked = bench.select("item_id", F.concat(F.lit("explain "), "text", F.lit(" in python")).alias("q"))
    rows = asked.unionByName(bench.select((F.col("item_id") + 100000).alias("item_id"), F.col("text").alias("q")))
    intent, language, refined = understanding.scope(F.col("q"))
    return rows.select("item_id", intent.alias("intent"), language.alias("language"), refined.alias("refined"))


# ---- question answering


@query(f"WITH {C}, {ITEMS}, {TERMS}, {bm25_ctes()}, {ranked('s', 3)} SELECT qid, string_agg(chr(10) || 'Source [' || rank || ']: ' || path || ' (Lines ?-?)' || chr(10) || trim(text), chr(10) ORDER BY rank) AS context FROM r JOIN c USING (doc_id) GROUP BY qid")
def j1_context_format(spark, d):
    best = retrieve.bm25(t(spark, d, "documents"), items(spark, d), k=3).join(files.corpus(spark, d), "doc_id")
    return rag.contexts(best.select("qid", "rank", "path", F.lit(None).cast("int").alias("start_line"), F.lit(0).alias("end_line"), "text"), "qid", [F.asc("rank")])


@query("SELECT text, CAST(max(known) AS INTEGER) AS known FROM (SELECT text, 1 AS known FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT text, 0 FROM documents) GROUP BY text")
def j3_accumulate_docs(spark, d):
    """Texts of good quality are known; all documents come on top, each text once."""
    docs = t(spark, d, "documents")
    known = docs.join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("text", F.lit(1).alias("known"))
    return rag.accumulate(known.dropDuplicates(["text"]), docs.select("text", F.lit(0).alias("known")))


@query("SELECT conv_id, turn, regexp_replace(text || ' SEARCH: ' || role, 'SEARCH:.*', '*Max search steps reached. Best effort answer:*') AS answer FROM conversations")
def j4_strip_search(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", rag.without_search(F.concat("text", F.lit(" SEARCH: "), "role")).alias("answer"))


@query()
def j3_rag_loop(spark, d):
    """Answers to all items in up to three steps; the stand-in for a model asks for its best source's first line until it has five."""
    docs = files.corpus(spark, d)

    def search(asked: DataFrame, k: int) -> DataFrame:
        best = retrieve.bm25(docs, asked, k).join(docs.select("doc_id", "path", "text"), "doc_id")
        return best.select("qid", "rank", "path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "text")

    def generate(question, context):
        line = F.element_at(F.filter(F.split(context, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("Source ["))), 1)
        return F.when(F.contains(context, F.lit("\nSource [5]")), F.substring(line, 1, 500)).otherwise(F.concat(F.lit("SEARCH: "), F.coalesce(line, question)))

    return rag.deep_dive(search, items(spark, d), generate)


# ---- catalogue


@query(f"WITH {C} SELECT DISTINCT path FROM c WHERE org_id = 'src0'")
def k1_list_files(spark, d):
    return catalog.list_files(files.corpus(spark, d), org="src0")


@query(f"WITH {C} SELECT DISTINCT path FROM c WHERE path GLOB 'src1*/*[!0-4].??.txt'")
def k1_list_files_glob(spark, d):
    return catalog.list_files(files.corpus(spark, d), glob="src1*/*[!0-4].??.txt")


@query("WITH k AS (" + _stride(1000, 0) + ") SELECT path, string_agg(content, chr(10) ORDER BY chunk_index) AS text FROM k GROUP BY path")
def k2_read_file(spark, d):
    return catalog.read_files(chunking.fixed_chunks(files.corpus(spark, d), overlap=0))


@query("SELECT source AS org_id, count(*) AS doc_count FROM documents GROUP BY 1")
def k5_store_counts(spark, d):
    return catalog.store_counts(files.corpus(spark, d))


@query(f"""WITH {C}, s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM c WHERE contains(lower(path), '.en.')), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s)
SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS parent, p[i] AS name, CASE WHEN i < len(p) THEN 'folder' ELSE 'file' END AS type, CAST(i AS BIGINT) AS depth FROM n""")
def k6_file_tree(spark, d):
    return catalog.file_tree(files.corpus(spark, d).select("path"), contains=".EN.")


@query(f"""WITH {C}, s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM c WHERE contains(lower(path), '.en.')), n AS (SELECT p, unnest(range(1, len(p))) AS i FROM s)
SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM n""")
def k7_expand_all(spark, d):
    return catalog.expanded(files.corpus(spark, d).select("path"), contains=".EN.")


@query("SELECT lower(r_name) AS category, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT DISTINCT r_name, lower(r_name) || '.' || lower(n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def k8_settings_groups(spark, d):
    """Nations as settings of their regions."""
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.group_settings(rows.select(F.lower(F.concat_ws(".", "r_name", "n_name")).alias("key")))


@query("SELECT doc_id, CASE WHEN length(text) > 3000 AND len(string_split(text, chr(10))) - 1 > 10 THEN array_to_string(string_split(text, chr(10))[1:10], chr(10)) ELSE text END AS preview FROM documents")
def k9_preview(spark, d):
    return t(spark, d, "documents").select("doc_id", catalog.preview(F.col("text"), 3000, 10).alias("preview"))


# ---- metrics


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000")
def l1_last_n(spark, d):
    return metrics.last_n(t(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type", "value")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, CAST(max(n) AS BIGINT) AS n, max(CASE WHEN rn = CAST(floor(n * 0.5e0) AS BIGINT) + 1 THEN value END) AS p50, max(CASE WHEN rn = CAST(floor(n * 0.95e0) AS BIGINT) + 1 THEN value END) AS p95, max(CASE WHEN rn = CAST(floor(n * 0.99e0) AS BIGINT) + 1 THEN value END) AS p99 FROM r GROUP BY 1""")
def l2_latency_percentiles(spark, d):
    return metrics.latency_percentiles(t(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def l3_counters(spark, d):
    return metrics.counters(t(spark, d, "events"), "event_type", F.round(F.col("value") * 100).cast("long"))


REQUEST = "CASE event_type WHEN 'click' THEN '/api/v1/search/query' WHEN 'signup' THEN '/api/v1/ingest/file' ELSE '/api/v1/' || event_type END"


@query(f"WITH p AS (SELECT {REQUEST} AS path, value FROM events) SELECT CASE WHEN contains(path, '/search') THEN 'search' WHEN contains(path, '/ingest') THEN 'ingest' ELSE 'other' END AS class, count(*) AS requests, max(value) AS slowest FROM p GROUP BY 1")
def l4_request_classes(spark, d):
    kind = F.col("event_type")
    path = F.when(kind == "click", "/api/v1/search/query").when(kind == "signup", "/api/v1/ingest/file").otherwise(F.concat(F.lit("/api/v1/"), kind))
    return t(spark, d, "events").groupBy(metrics.request_class(path).alias("class")).agg(F.count("*").alias("requests"), F.max("value").alias("slowest"))


@query("""SELECT 'requests_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def l5_exposition(spark, d):
    return metrics.exposition(t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "requests_total", "event_type", "n")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 50) THEN 'degraded' ELSE 'healthy' END AS status, count(CASE WHEN event_type = 'error' AND value > 50 THEN 1 END) AS down FROM events GROUP BY 1")
def l7_health_rollup(spark, d):
    return metrics.health(t(spark, d, "events"), "user_id", (F.col("event_type") == "error") & (F.col("value") > 50))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def l8_audit_tail(spark, d):
    return t(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("SELECT label, count(*) AS points FROM embeddings GROUP BY 1")
def l9_points(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("points"))


# ---- configuration and access


@query("SELECT event_id, 'props.k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def m1_flatten(spark, d):
    flat = F.explode(F.from_json("props", "map<string,string>")).alias("k", "value")
    return t(spark, d, "events").select("event_id", flat).select("event_id", F.concat(F.lit("props."), "k").alias("key"), "value")


NESTED = """concat('{"k": ', user_id % 7, ', "who": {"id": ', user_id, ', "kind": "', event_type, '", "seen": [', event_id % 5, ', {"at": [true, null, "', event_type, '"]}], "none": {}}, "own": ', props, '}')"""


@query(f"SELECT event_id, replace(fullkey, '$', 'config') AS key, CASE WHEN json_type(value) = 'NULL' THEN NULL ELSE value ->> '$' END AS value FROM (SELECT event_id, {NESTED} AS j FROM events) e, json_tree(CAST(e.j AS JSON)) WHERE NOT (type IN ('OBJECT', 'ARRAY') AND CAST(value AS VARCHAR) NOT IN ('{{}}', '[]'))")
def m1_flatten_nested(spark, d):
    """Nested objects and lists of any depth."""
    events = t(spark, d, "events").select("event_id", F.expr(NESTED).alias("j"))
    return admin.flattened(events, ["event_id"], "j", "config")


@query("SELECT n_name AS key, coalesce(CAST(s.n AS VARCHAR), '0') AS value, s.n IS NOT NULL AS overridden FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON n_nationkey = s_nationkey")
def m6_effective_config(spark, d):
    """Zero by default, overridden where suppliers are rich."""
    nation = t(spark, d, "nation")
    rich = t(spark, d, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("string").alias("value"))
    return admin.effective(nation.select(F.col("n_name").alias("key"), F.lit("0").alias("value")), nation.join(rich, "n_nationkey").select(F.col("n_name").alias("key"), "value")).select("key", "value", "overridden")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 2")
def m7_snapshot_pick(spark, d):
    return admin.snapshot_pick(t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id", "value")


ROLE = "CASE event_type WHEN 'purchase' THEN 'admin' WHEN 'click' THEN 'member' WHEN 'view' THEN 'viewer' ELSE 'guest' END"


@query(f"SELECT {ROLE} AS role, coalesce(CASE {ROLE} WHEN 'admin' THEN 3 WHEN 'member' THEN 2 WHEN 'viewer' THEN 1 END >= 2, false) AS may_edit, count(*) AS n FROM events GROUP BY ALL")
def m10_rbac(spark, d):
    kind = F.col("event_type")
    role = F.when(kind == "purchase", "admin").when(kind == "click", "member").when(kind == "view", "viewer").otherwise("guest")
    return t(spark, d, "events").groupBy(role.alias("role"), admin.allowed(role, "member").alias("may_edit")).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, coalesce(min(CASE WHEN s_acctbal > 9900 THEN s_name END), 'default-model') AS s_name FROM supplier GROUP BY 1")
def m11_active_model(spark, d):
    return admin.active_by_type(t(spark, d, "supplier").withColumn("active", F.col("s_acctbal") > 9900), "s_nationkey", "s_name", "default-model")


# ---- streams


def _islands(by: str, micros: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({part}ORDER BY ts)) <= {micros} THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER ({part}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT {lead}epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM i GROUP BY {lead}island"""


def _micros(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), "events")


def _events(spark, d):
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def n1_stream_ingest(spark, d):
    """The events as a stream of files, ingested once: the last event of each user, kept by version."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    order = [F.desc("ts"), F.desc("event_id")]
    folder = _ingested(spark, _table_files(d, "events"), schema, "user_id", order)
    return watch.current(spark, folder, schema, "user_id", order).select("event_id", "user_id", "event_type")


def _table_files(sf_dir: str, name: str) -> str:
    """A stream's source for a table that is one file or a folder of them, whose names don't tell the table. The one-letter class makes it a
    pattern, which Spark resolves to either; a plain path has to be a folder."""
    return f"{sf_dir}/[{name[0]}]{name[1:]}.parquet"


def _ingested(spark, source: str, schema: str, key: str, order: list, runs=(), **options) -> str:
    """The folder of batches after a run, and one more after each of ``runs``, which add files to the source."""
    folder = shared_path(spark, "stream")
    for step in (lambda: None, *runs):
        step()
        watch.ingest_stream(spark, source, schema, watch.batch_sink(f"{folder}/rows"), f"{folder}/checkpoint", key, order, **options).awaitTermination()
    return f"{folder}/rows"


_VERSIONS = f"WITH {C}, o AS (SELECT path, sha256(text) AS hash, 1 AS version FROM c), n AS (SELECT path, sha256('new ' || text) AS hash, 2 AS version FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


def _versions(spark, d, initial: bool) -> DataFrame:
    """A folder that holds all documents when watching begins, then those of good quality again with a new text."""
    docs, schema, folder = files.corpus(spark, d), "path string, hash string, version int", shared_path(spark, "watched")
    good = docs.join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    docs.select("path", files.content_hash(F.col("text")).alias("hash"), F.lit(1).alias("version")).write.parquet(f"{folder}/first")
    later = good.select("path", files.content_hash(F.concat(F.lit("new "), "text")).alias("hash"), F.lit(2).alias("version"))
    rows = _ingested(spark, f"{folder}/*", schema, "path", [F.desc("version")], runs=[lambda: later.write.parquet(f"{folder}/second")], initial=initial)
    return watch.current(spark, rows, schema, "path", [F.desc("version")])


@query(f"{_VERSIONS} SELECT * FROM n UNION ALL SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)")
def n5_initial_then_changes(spark, d):
    return _versions(spark, d, True)


@query(f"{_VERSIONS} SELECT * FROM n")
def n5_changes_only(spark, d):
    """The same without the initial scan."""
    return _versions(spark, d, False)


@query(f"WITH p AS (SELECT page_id, url, {_case('url', ['*5', 'blog/', '!*25'])} AS ignored FROM pages) SELECT url, max(page_id) AS page_id FROM p WHERE NOT ignored GROUP BY url")
def n7_stream_ignore(spark, d):
    """Pages as a stream, each address once, without those that a rule ignores."""
    schema, order = "page_id long, url string, html string", [F.desc("page_id")]
    folder = _ingested(spark, _table_files(d, "pages"), schema, "url", order, rules=["*5", "blog/", "!*25"])
    return watch.current(spark, folder, schema, "url", order).select("url", "page_id")


@query(_islands("", 60_000_000))
def n2_global_debounce(spark, d):
    """Flushes after a minute without events, for these events come rarely."""
    return _micros(watch.debounced_globally(_events(spark, d), 60_000))


@query(_islands("user_id", 3_600_000_000))
def n3_file_debounce(spark, d):
    """An hour's idle time per user."""
    return _micros(watch.debounced(_events(spark, d), 3_600_000, ["user_id"]), "user_id")


@query("SELECT user_id, epoch_us(max(ts)) AS at_us FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'error'")
def n4_tombstones(spark, d):
    """Users whose last event is an error are gone."""
    rows = watch.tombstones(_events(spark, d), "user_id", "ts", F.col("event_type") == "error")
    return rows.select("user_id", F.unix_micros("at").alias("at_us"))


# ---- presentation


@query(f"WITH {C} SELECT doc_id, path || ':0: ' || substr(replace(trim(text), chr(10), ' '), 1, 200) || ' (' || printf('%.3f', n_chars / 1000e0) || ')' AS line FROM c")
def p1_grep_lines(spark, d):
    docs = files.corpus(spark, d)
    return docs.select("doc_id", catalog.grep_line(F.col("path"), F.lit(0), F.col("text"), F.col("n_chars") / 1000.0).alias("line"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10))[1:3], lambda x: trim(x)), chr(10)) AS head FROM documents")
def p4_first_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", catalog.first_lines(F.col("text")).alias("head"))
