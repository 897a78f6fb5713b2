import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import components, simhash
from brindle.llm.common import lean
from brindle.llm.components import connected_components


def slow_print(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def slow_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_groups_match_brute_force(awkward, plain):
    got = simhash.near_duplicates(awkward).collect()
    prints = [slow_print(t) for _, t, *_ in plain]
    groups, first = slow_groups(prints), {}
    for (i, *_), g in zip(plain, groups, strict=True):
        if i is not None:
            first[g] = min(i, first.get(g, i))
    expected = Counter((i, p, first.get(g)) for (i, *_), p, g in zip(plain, prints, groups, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == expected


def test_links_of_crowded_keys_keep_components(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 5))) for b in base for _ in range(120)} | {random.getrandbits(64) for _ in range(50)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = Counter(slow_groups([p % (1 << 64) for p in signed]))
    for crowd in (1, 48):
        edges = simhash.links(frame, crowd)
        roots = {r.node: r.root for r in connected_components(edges).collect()}
        sizes = Counter(roots.get(p, p) for p in signed)
        assert sorted(sizes.values()) == sorted(expected.values())


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert {found[i] for i in range(301)} == {0} and found[1001] == 1000


def test_similar_texts_are_linked_and_others_left(spark):
    from tests.llm.conftest import prose

    docs = []
    for i in range(30):
        words = prose(100 + i, 300).split()
        docs.append((i, " ".join(words)))
        words[20 + i] = "changed"
        docs.append((100 + i, " ".join(words) + f" tail{i}"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, shingle=5, similarity=0.8).collect()}
    texts = dict(docs)
    assert all(simhash.jaccard(texts[a], texts[b], 5) >= 0.8 for a, b in groups.items())
    assert sum(groups[100 + i] == i for i in range(30)) >= 30
    kept = {r.doc_id for r in simhash.keep_one(table).collect()}
    assert set(range(30)) <= kept


def slow_similar_groups(docs, n=5, similarity=0.8):
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in docs for w in [t.split()]}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t, n)) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and find(i) != find(j):
                both = len(sets[i] & sets[j])
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 2:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def crowds():
    """Edits of one original that are 0.84 alike to it and 0.7 to one another, and pairs of texts in one boilerplate."""
    rng, docs = random.Random(5), []
    original = [f"o{i}" for i in range(400)]
    for i in range(300):
        words = list(original)
        for at in rng.sample(range(5, 390, 11), 7):
            words[at] = f"e{i}x{at}"
        docs.append((i, " ".join(words)))
    docs.append((-1, " ".join(original)))
    shared = [f"s{i}" for i in range(300)]
    for i in range(1000, 1150):
        words = shared + [f"p{i}x{k}" for k in range(150)]
        docs.append((i, " ".join(words)))
        for at in rng.sample(range(10, 440), 3):
            words[at] = f"c{i}x{at}"
        docs.append((i + 1000, " ".join(words)))
    return docs


def test_crowded_minima_keep_all_components(spark):
    docs = crowds()
    expected = slow_similar_groups(docs)
    assert len(set(expected.values())) == 151
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, shingle=5, similarity=0.8).collect()}
    assert got == expected


def test_shingle_sets_of_crowded_texts_are_hashed_once(spark, monkeypatch):
    """A second call of the function in a task is a second Python worker in the executor, which stays for what follows."""
    plans, write = {}, simhash.written

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "written", watched)
    simhash.near_duplicates(spark.createDataFrame(crowds(), "doc_id long, text string").repartition(4), shingle=5, similarity=0.8)
    assert "simhash-prefixes" in plans
    assert {name: n for name, plan in plans.items() if (n := plan.count("ArrowEvalPython [hash_set("))} == {"simhash-apart-sets": 1}


def exchanges(spark, monkeypatch, *modules):
    """Whenever a module writes a table: its name and how many exchanges of rows its plan has."""
    found = []

    def watched(df, name, write=simhash.written):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found.append((name, plan.count("Exchange hashpartitioning")))
        return write(df, name)

    for module in modules:
        monkeypatch.setattr(module, "written", watched)
    return found


def test_rounds_of_components_have_two_exchanges(spark, monkeypatch):
    """Partitions of few rows cost what they cost however few the rows are, so that exchanges count."""
    found = exchanges(spark, monkeypatch, components)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (60, 50), (50, 60), (51, 60), (70, 70)], "u long, v long")
    roots = connected_components(edges).collect()
    assert sorted((r.node, r.root) for r in roots) == sorted([(i, 0) for i in range(41)] + [(i, 50) for i in (50, 51, 60)])
    assert {n for _, n in found} == {2}
    found.clear()
    connected_components(spark.createDataFrame([(i, 0) for i in range(1, 9)], "u long, v long"))
    assert len(found) == 1  # stars are known after one round
    assert connected_components(edges.where("u = v")).count() == 0


def test_groups_of_crowded_texts_take_few_exchanges(spark, monkeypatch):
    found = exchanges(spark, monkeypatch, simhash, components)
    docs = crowds()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, shingle=5, similarity=0.8).collect()}
    assert got == slow_similar_groups(docs)
    assert {"simhash-apart-sets", "simhash-prefixes"} <= {name for name, _ in found}
    assert sum(n for _, n in found) <= 60


def test_workers_hand_freed_memory_back():
    """Also where something small that stays lies above what was freed."""
    kept = []

    def held():
        with open("/proc/self/smaps_rollup") as file:
            return next(int(line.split()[1]) for line in file if line.startswith("Pss_Anon")) / 1024

    def task(batches):
        for n in batches:
            rows = [bytes(1000) for _ in range(n)]
            kept.append(bytes(1000))
            yield len(rows)

    start = held()
    assert list(task(iter([100_000]))) == [100_000] and held() > start + 50
    assert list(lean(task)(iter([100_000]))) == [100_000] and held() < start + 30


@pytest.mark.parametrize("group", [160, 1000, 5000])
def test_large_groups_of_near_copies_keep_all_components(spark, group):
    """Copies of one original that differ from it by a little to a lot, so that links join some of them only."""
    rng, docs = random.Random(group), []
    original = [f"o{i}" for i in range(120)]
    for i in range(group):
        words = list(original)
        for at in rng.sample(range(120), rng.choice([1, 2, 2, 3, 5, 9])):
            words[at] = f"e{rng.randrange(group // 20)}x{at}"
        docs.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), shingle=5, similarity=0.8).collect()}
    assert got == dense_groups(docs)


def dense_groups(docs, n=5, similarity=0.8):
    """The groups by all pairs of texts, with products of their shingle vectors."""
    numbers, rows = {}, []
    for _, t in docs:
        w = t.split()
        rows.append(sorted({numbers.setdefault(tuple(w[k : k + n]), len(numbers)) for k in range(len(w) - n + 1)}))
    common = sorted(k for k, c in Counter(k for r in rows for k in r).items() if c > 1)
    place = {k: i for i, k in enumerate(common)}
    held = np.zeros((len(rows), len(common)), np.float32)
    for i, r in enumerate(rows):
        held[i, [place[k] for k in r if k in place]] = 1
    sizes = np.array(list(map(len, rows)))
    prints = np.array([simhash.fingerprint(simhash.shingle_hashes(t, n)) for _, t in docs], np.uint64)
    root = np.arange(len(rows))
    for i in range(len(rows)):
        both = held[: i + 1] @ held[i]
        linked = (both >= similarity * (sizes[: i + 1] + sizes[i] - both) - 1e-6) | (np.bitwise_count(prints[: i + 1] ^ prints[i]) <= 2)
        roots = np.unique(root[: i + 1][linked])
        root[np.isin(root, roots)] = roots[0]
    return {docs[i][0]: docs[r][0] for i, r in enumerate(root.tolist())}


def test_a_common_passage_joins_nobody(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(i, shared + " " + " ".join(f"p{i}x{k}" for k in range(60 + i % 7))) for i in range(600)]
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(0, 600, 50)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    assert got == {i: i % 1000 for i, _ in docs}


def test_texts_of_one_fingerprint_are_compared_each_for_itself(spark, monkeypatch):
    """With one fingerprint for all, each text's own links still count."""
    from tests.llm.conftest import prose

    docs = [(i, prose(300 + i, 200)) for i in range(4)] + [(10 + i, prose(300 + i, 200) + " more words here") for i in range(4)]
    nodes = simhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, sketched=True).withColumn("first", F.struct(F.lit(False).alias("no_id"), "doc_id", "text_hash"))
    found = simhash.similar_links(nodes.withColumn("fp", F.lit(0)), spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "u long, v long"), "doc_id", "text", 5, 0.8)
    ids = {r.node: r.doc_id for r in nodes.collect()}
    assert {frozenset((ids[r.u] % 10, ids[r.v] % 10)) for r in found.collect()} == {frozenset((i,)) for i in range(4)}


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    table = spark.createDataFrame([(1, "a b c d e f g h"), (1, "q r s t u v w x"), (1, "a b c d e f g h"), (None, "q r s t u v w x"), (None, "only here one two three"), (None, "only here one two three")], "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(table).collect()))
    assert kept == [(0, "only here one two three"), (1, "a b c d e f g h"), (1, "q r s t u v w x")]


def test_one_of_each_group_stays(awkward, empty):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 1 and 1 in ids and 2 not in ids
    assert simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
