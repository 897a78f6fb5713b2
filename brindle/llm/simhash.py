"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits, taken by majority over the XXH64 hashes of a document's word shingles. It is cut into
``blocks`` equal blocks. Two fingerprints that differ in at most ``distance`` bits agree in at least
``blocks - distance`` blocks, so they share the key of some choice of that many blocks. Distinct fingerprints are
joined on these keys and the pairs verified by Hamming distance; connected components of the links are the groups.

A key that many distinct fingerprints share isn't expanded into pairs. For ``distance`` 2, two fingerprints are linked
if and only if some value lies within one bit of both; so each member of a crowded key emits its one-bit variants in
the bits outside the key, and links to the smallest fingerprint at the same variant. That is linear in the members,
and its components are those of all pairs.

Texts that are 0.8 alike by five-word shingles lie up to 18 bits apart, where blocks of 64 bits no longer tell candidates from
others. So ``keep_one`` finds links beyond the distance by minimum hashes of the same shingle hashes: texts that share one of
MINIMA of them are candidates, unless their SIGNATURE of further minima agrees too little, and the Jaccard similarity of the
shingle sets of both whole texts decides. All pairs of a key are candidates where it has few members. In a crowded key the members
first meet its hub, the member that agrees best with the key's most frequent minima, and those that the largest group doesn't hold
then meet more such members, one from each of HUBS parts of the key. What no link has joined by then meets in an exact join of the shingle sets: each set is ordered by frequency, rarest shingle first, two sets that are alike enough share one
of their first shingles (prefix filter), have about one size (length filter) and enough shingles left from there on (position
filter). A line or passage that many texts share thus joins nobody, and no pair is left out. Nodes are distinct texts, told by
fingerprint and shingle set, not fingerprints.

What a key's rows have in common (their number, its largest root, a print's least node) is taken by window functions where the
rows stand by key, not by an aggregate that the rows then join: a stage of exchange less each time, which many partitions of few rows feel.

Defined cases: null, empty and blank texts have no shingle and fingerprint zero, which links like any other. Texts with
fewer words than a shingle have one shingle, the whole sequence. Repeated rows fall into one group; a null id counts as larger
than any other, and a group without ids has a null component. ``keep_one`` keeps one row of each group: of the smallest id and,
where texts share that id, of the smallest hash of the text; which of the rows that share both is open. Very long texts are
hashed in pieces. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, UPPER, lean, written
from brindle.llm.components import connected_components

BITS, BLOCKS, DISTANCE = 64, 4, 2
#: For links by similarity: minimum hashes that candidates share one of, and further ones that estimate their similarity.
MINIMA, SIGNATURE = 6, 32
#: Distinct fingerprints or texts that may share a key before their links are found by one-bit variants, or first by a hub.
CROWD = 48
#: Hubs of a crowded key.
HUBS = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PIECE = 1 << 15
#: A multiplier for each family of minimum hashes; multiples of one number would give families whose minima change together.
_FACTORS = [np.uint64(xxhash.xxh64_intdigest(b"family %d" % i) | 1) for i in range(MINIMA)]
_EDGES = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(64 - SIGNATURE.bit_length() + 1)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The unsigned hashes of the shingles of one text, repeats included."""
    words = _WORD.findall((text or "").encode().translate(_FOLD))
    if not words:
        return np.empty(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts, ends[shingle - 1 :])  # noqa: B905  the last starts have no full shingle
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of a text's shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _PIECE):
        piece = hashes[i : i + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def sketch(hashes: np.ndarray) -> list[int]:
    """A hash of the shingle set, its MINIMA and its SIGNATURE: the first hash of each of as many equal ranges, 0 where there is none."""
    distinct = np.unique(hashes)
    least = [0] * MINIMA
    if len(distinct):
        with np.errstate(over="ignore"):
            mixed = distinct ^ (distinct >> np.uint64(31))
            least = [int(((x := mixed * factor) ^ (x >> np.uint64(29))).min()) for factor in _FACTORS]
    at = np.searchsorted(distinct, _EDGES)
    filled = at < np.append(at[1:], len(distinct))
    signature = np.zeros(SIGNATURE, np.uint64)
    signature[filled] = (distinct[at[filled]] & np.uint64(0x7FFF)) | np.uint64(1)
    return [xxhash.xxh64_intdigest(distinct.tobytes()), *least, *signature.tolist()]


def place(doc_id: Column, text_hash: Column) -> Column:
    """What puts documents in order: ids, a null one last, then hashes of texts."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), text_hash.alias("text_hash"))


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """A number of the id, null or not, and the hash of the text."""
    return F.xxhash64(doc_id.isNull(), doc_id, text_hash)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sketched: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp, print, node) of every document and, with ``sketched``, set, minima and sig of its shingle set; all but the id are numbers.

    Documents of one print, an equal fingerprint or an equal fingerprint and shingle set, are one node of the graph: the
    fingerprint, or the ``row_key`` of the least of them.
    """

    @F.pandas_udf("array<bigint>")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = (shingle_hashes(t, shingle) for t in texts)
            yield pd.Series([np.array([fingerprint(h), *(sketch(h) if sketched else ())], np.uint64).view(np.int64) for h in found], dtype=object)

    all_of = F.col("all")
    prints = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), simhash(F.col(text_col)).alias("all"))
    if not sketched:
        return prints.select("doc_id", "text_hash", all_of[0].alias("fp"), all_of[0].alias("print"), all_of[0].alias("node"))
    sig = F.slice("all", 3 + MINIMA, SIGNATURE).cast("array<short>")
    return prints.select("doc_id", "text_hash", all_of[0].alias("fp"), F.xxhash64(all_of[0], all_of[1]).alias("print"), row_key(F.col("doc_id"), F.col("text_hash")).alias("node"), all_of[1].alias("set"), F.slice("all", 3, MINIMA).alias("minima"), sig.alias("sig"))


def block_keys(fp: Column) -> Column:
    """Array of (choice, key): the key keeps the bits of the chosen blocks and zeroes the others."""
    width = BITS // BLOCKS
    keys = []
    for i, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*keys)


def variants(fp: Column, choice: Column) -> Column:
    """The fingerprint and those that differ from it in one bit outside the blocks of its choice."""
    width, out = BITS // BLOCKS, None
    for i, kept in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        flips = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(BITS) if b // width not in kept)]
        all_of = F.transform(F.array(*map(F.lit, flips)), lambda flip: fp.bitwiseXOR(flip))
        out = F.when(choice == i, all_of) if out is None else out.when(choice == i, all_of)
    return out


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp, and node where links name that) at most DISTANCE bits apart, enough of them for all components."""
    node = F.col("node" if "node" in distinct.columns else "fp")
    keyed = distinct.select("fp", node.alias("node"), F.inline(block_keys(F.col("fp"))))
    shared = written(keyed.withColumn("n", F.count("*").over(Window.partitionBy("choice", "key"))).where("n > 1"), "simhash-keys")
    few = shared.where(F.col("n") <= crowd)
    left, right = (few.select("choice", "key", F.col("node").alias(n), F.col("fp").alias(f)) for n, f in (("u", "a"), ("v", "b")))
    pairs = left.join(right, ["choice", "key"]).where("a > b").select("u", "a", "v", "b")
    spread = shared.where(F.col("n") > crowd).select("node", "fp", F.explode(variants(F.col("fp"), F.col("choice"))).alias("near"))
    least = F.min(F.struct("fp", "node")).over(Window.partitionBy("near"))
    stars = spread.withColumn("least", least).select(F.col("node").alias("u"), F.col("fp").alias("a"), F.col("least.node").alias("v"), F.col("least.fp").alias("b")).where("a <> b")
    return pairs.unionByName(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("u", "v").distinct()


def jaccard(a: str | None, b: str | None, shingle: int) -> float:
    """Similarity of the shingle sets of two texts."""
    sets = []
    for text in (a, b):
        words = _WORD.findall((text or "").encode().translate(_FOLD))
        sets.append({b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    union = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / union if union else 1.0


def _agreeing(a: str, b: str) -> Column:
    """In how many places two signatures agree."""
    return sum(((F.col(a)[i] == F.col(b)[i]).cast("int") for i in range(SIGNATURE)), F.lit(0))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, root, ...) of keys that more than one root has, with the key's number n and main: the root that most of its rows have."""
    of_key = Window.partitionBy("key")  # before the roots' counts, which then need no exchange of their own
    shared = rows.withColumns({"n": F.count("*").over(of_key), "low": F.min("root").over(of_key), "high": F.max("root").over(of_key)}).where("low < high").drop("low", "high")
    counted = shared.withColumn("of_root", F.count("*").over(Window.partitionBy("key", "root")))
    return counted.withColumn("main", F.max(F.struct("of_root", "root")).over(of_key)["root"]).drop("of_root")


def _met(rows: DataFrame, agree: int) -> DataFrame:
    """(u, v) of rows (key, node, sig) that share a key and agree in ``agree`` places of their signatures."""
    left, right = rows.select("key", F.col("node").alias("u"), F.col("sig").alias("a")), rows.select("key", F.col("node").alias("v"), F.col("sig").alias("b"))
    return left.join(right, "key").where("u > v").where(_agreeing("a", "b") >= agree).select("u", "v")


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, part, member): of each of HUBS parts of a key's rows (key, node, sig) the member that agrees best with the key's most frequent values."""
    modes = rows.groupBy("key").agg(F.array(*[F.mode(F.col("sig")[i]) for i in range(SIGNATURE)]).alias("b"))  # a place has 16384 values at most
    scored = rows.join(modes, "key").select("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("part"), F.struct(_agreeing("sig", "b").alias("same"), "node", "sig").alias("member"))
    return scored.groupBy("key", "part").agg(F.max("member").alias("member"))


def _to_hubs(rows: DataFrame, hubs: DataFrame, agree: int) -> DataFrame:
    """(u, v) of each row (key, node, sig) and the hubs v of its key."""
    met = rows.join(hubs.select("key", F.col("member.node").alias("hub"), F.col("member.sig").alias("b")), "key").where("node <> hub").where(_agreeing("sig", "b") >= agree)
    return met.select(F.col("node").alias("u"), F.col("hub").alias("v"))


def _prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of sets (node, root, hashes) with different roots that may be ``similarity`` alike; loses no pair that is.

    Of a key's sets, those of its largest root only meet the others, which are few where links have joined most of them.
    """
    shingles = sets.select("node", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    ordered = shingles.withColumn("df", F.count("*").over(Window.partitionBy("h"))).groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    first = F.slice("s", F.lit(1), (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).cast("int"))
    keys = ordered.select("node", "root", "size", F.posexplode(first).alias("at", "s")).where("s.df > 1").select("node", "root", "size", "at", F.col("s.h").alias("key"))
    keys = written(_shared(keys), "simhash-prefixes")
    left = keys.where("root <> main").select("key", F.col("node").alias("u"), F.col("root").alias("c"), F.col("size").alias("m"), F.col("at").alias("i"))
    right = keys.select("key", F.col("node").alias("v"), F.col("root").alias("d"), "size", F.col("at").alias("j"), (F.col("root") == F.col("main")).alias("in_main"))
    need = F.ceil((F.col("m") + F.col("size")) * (similarity / (1 + similarity)) - 1e-9)
    near = (F.least("m", "size") >= similarity * F.greatest("m", "size") - 1e-9) & (1 + F.least(F.col("m") - F.col("i"), F.col("size") - F.col("j")) - 1 >= need)
    return left.join(right, "key").where("c <> d AND (in_main OR u > v)").where(near).select("u", "v").distinct()


def similar_links(nodes: DataFrame, docs: DataFrame, known: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, crowd: int = CROWD) -> DataFrame:
    """The ``known`` links (u, v), or their components', and those between nodes (node, minima, sig), one to a shingle set, whose texts are at least ``similarity`` alike.

    A node is the ``row_key`` of its document. Of crowded keys, pairs that others of these links already join are left out; the components are those of all pairs.
    """
    agree = int((similarity - 0.25) * SIGNATURE)
    one = [F.xxhash64(F.lit(i), F.col("minima")[i]) for i in range(MINIMA)]
    first = nodes.select("node", "sig", F.explode(F.array(*one)).alias("key"))  # a node has a key once
    first = written(first.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "simhash-minima")
    crowded = first.where(F.col("n") > crowd)

    def with_texts(wanted: DataFrame) -> DataFrame:
        """The wanted rows (node, ...), one to a node, with the node's text."""
        rows = docs.select(row_key(F.col(id_col), F.xxhash64(text_col)).alias("node"), F.col(text_col).alias("text"))
        return rows.join(wanted, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("text", *wanted.columns) if c != "node"])

    @F.pandas_udf("double")
    @lean
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([jaccard(x, y, shingle) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("array<bigint>")
    @lean
    def hash_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts], dtype=object)

    def verified(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        candidates = written(pairs.distinct(), "simhash-candidates")
        if texts is None:
            texts = written(with_texts(candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "simhash-texts")
        # the hub first, while rows are small
        met = candidates.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        return written(met.where(alike("a", "b") >= similarity).select("u", "v"), "simhash-links")

    hubs = written(_hubs(crowded), "simhash-hubs")
    found = verified(_met(first.where(F.col("n") <= crowd), agree).unionByName(_to_hubs(crowded, hubs.groupBy("key").agg(F.max("member").alias("member")), agree)))
    if crowded.isEmpty():
        return known.unionByName(found)

    def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return _shared(rows.select("key", "node", "sig").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))

    def stars(roots: DataFrame) -> DataFrame:
        return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))

    roots = connected_components(known.unionByName(found))
    left = written(apart(crowded, roots), "simhash-apart")
    found = verified(_to_hubs(left.where("root <> main"), hubs, agree))
    if not found.isEmpty():
        roots = connected_components(stars(roots).unionByName(found))
        left = apart(left, roots)
    # written, not the texts alone: exploding a function's column calls it again for the filter on empty arrays, in a second worker of each task
    sets = with_texts(left.groupBy("node").agg(F.min("root").alias("root"))).withColumn("hashes", hash_set("text"))
    sets = written(sets, "simhash-apart-sets")
    return stars(roots).unionByName(verified(_prefix_pairs(sets, similarity), sets))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' prints, and (print, first, copies, root) of every node; ``first`` is its least (no_id, doc_id, text_hash), root its group."""
    sketched = similarity is not None
    prints = written(fingerprints(docs, id_col, text_col, shingle, sketched), "simhash")
    same = [F.min(c).alias(c) for c in ("fp", *(("set", "minima", "sig") if sketched else ()))]
    nodes = prints.groupBy("print").agg(*same, F.min(place(F.col("doc_id"), F.col("text_hash"))).alias("first"), F.count("*").alias("copies"))
    if sketched:
        nodes = nodes.withColumn("node", row_key(F.col("first.doc_id"), F.col("first.text_hash")))
        for c in ("fp", "set"):
            nodes = nodes.withColumn(f"of_{c}", F.min("node").over(Window.partitionBy(c)))
        nodes = written(nodes, "simhash-nodes")
        edges = links(nodes.where("node = of_fp").select("fp", "node"))
        for c in ("of_fp", "of_set"):
            edges = edges.unionByName(nodes.where(f"node <> {c}").select(F.col("node").alias("u"), F.col(c).alias("v")))
        edges = similar_links(nodes.where("node = of_set"), docs, written(edges, "simhash-edges"), id_col, text_col, shingle, similarity)
    else:
        nodes = written(nodes.withColumn("node", F.col("fp")), "simhash-nodes")
        edges = links(nodes.select("fp"))
    roots = connected_components(edges)
    return prints, nodes.join(roots, "node", "left").select("print", "first", "copies", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest id of its group) and copies (documents with its fingerprint, or text).

    With ``similarity``, texts that are at least so alike are linked too.
    """
    prints, nodes = grouped(docs, id_col, text_col, shingle, similarity)
    keepers = nodes.groupBy("root").agg(F.min("first").alias("keeper"))
    found = nodes.join(keepers, "root").select("print", F.col("keeper.doc_id").alias("component_id"), "copies")
    return prints.select("doc_id", "fp", "print").join(found, "print").select("doc_id", "fp", "component_id", "copies")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group, all columns."""
    _, nodes = grouped(docs, shingle=shingle, similarity=similarity)
    kept = nodes.groupBy("root").agg(F.min("first").alias("place")).select("place")
    rows = docs.select(place(F.col("doc_id"), F.xxhash64("text")).alias("place"), F.struct("*").alias("row"))
    return rows.join(kept, "place", "left_semi").dropDuplicates(["place"]).select("row.*")
