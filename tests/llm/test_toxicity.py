from collections import Counter

import numpy as np

from brindle.llm import toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    idf = rng.random(40) + 0.5
    rows = []
    for i in range(500):
        terms = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        rows.append((i, int(rng.integers(2)), terms, rng.integers(1, 5, len(terms))))
    index = toxicity.Index.build(rows, idf, (1.0, 1.0))
    dense = np.zeros((500, 40))
    place = {d: n for n, d in enumerate(index.doc_ids.tolist())}
    for d, _, terms, counts in rows:
        dense[place[d], terms] = toxicity.unit_vector(terms, counts, idf)
    for d, _, terms, counts in rows[:100]:
        vector = toxicity.unit_vector(terms, counts, idf)
        cosines = dense[:, terms] @ vector
        cosines[place[d]] = -1
        expected = [c for c in sorted(np.round(cosines, 9), reverse=True)[:15] if c > 0]
        best, got = index.search(terms, vector, without=place[d])
        assert np.allclose(got[: len(expected)], expected) and place[d] not in best


def labelled(spark):
    from tests.llm.conftest import prose

    bad = ["vilexa", "grumbot", "snarlik"]
    docs = [(i, prose(i, 60) + (" " + " ".join(bad[: 1 + i % 3]) if i % 4 == 0 else "") + f" w{i}", "en", "a", 0) for i in range(400)]
    docs += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (None, "grumbot " * 5, "en", "a", 0), (1002, docs[4][1] + " " + prose(3, 20000), "en", "a", 0), docs[8]]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 1, None), (None, 1, 1), (9999, 0, 1)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found_and_clean_ones_left(spark, empty):
    docs, table, labels = labelled(spark)
    got = toxicity.toxicity(table, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1000] == scores[1001] < 0.5 and scores[None] > 0.5 and scores[1002] > 0.5
    kept = toxicity.keep_clean(table, labels)
    assert kept.columns == table.columns and 4 not in {r.doc_id for r in kept.collect()}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_scores_and_evidence_match_brute_force(spark):
    """Every document against every example, with vectors made term by term."""
    docs, table, labels = labelled(spark)
    model = toxicity.fit(table, labels)
    index, idf = model.index, model.index.idf

    def vector(text):
        counts, out = toxicity.count_terms(text), np.zeros(len(idf))
        for term, i in model.terms.items():
            level = {chr(n): n for n in toxicity.REPEATS if n > 1}.get(term[-1], 1)
            tf = counts[term[:-1] if level > 1 else term]
            out[i] = 2 * tf / (tf + 1) * idf[i] if tf >= level else 0
        return out / (np.sqrt((out * out).sum()) or 1)

    texts = {}
    for i, t, *_ in docs:
        texts[i] = min(t, texts.get(i, t)) if t is not None else texts.get(i)
    examples = np.array([vector(texts[i]) for i in index.doc_ids.tolist()])
    got = {(r.doc_id, round(r.score, 9), tuple(r.evidence)) for r in toxicity.toxicity(table, labels).collect()}
    for i, t, *_ in docs:
        own = vector(t)
        cosine = np.round(examples @ own, 9)
        best = [k for k in np.lexsort((np.arange(len(cosine)), -cosine))[: toxicity.NEIGHBOURS] if cosine[k] > 0]
        if not best:
            expected = model.bare
        else:
            near = index.weights[best] / (1.05 - np.minimum(cosine[best], 1))
            expected = np.interp((near * index.labels[best]).sum() / near.sum(), model.bins, model.rates)
        scores = [s for d, s, e in got if d == i and (e == tuple(index.doc_ids[best[:3]].tolist()))]
        assert scores and abs(scores[0] - expected) < 1e-6


def test_without_labels_scores_are_the_rate(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(awkward, none).collect()} == {0.0}


def test_labels_of_absent_documents_teach_nothing(spark, monkeypatch):
    from tests.llm.conftest import prose

    docs, table, labels = labelled(spark)
    known = {(r.doc_id, r.score) for r in toxicity.toxicity(table, labels).collect()}
    absent = spark.createDataFrame([(100_000 + i, 1, int(i % 10 > 0)) for i in range(2000)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(table, labels.unionByName(absent)).collect()} == known
    clean = spark.createDataFrame([(i, prose(i, 50)) for i in range(50)], "doc_id long, text string")
    assert toxicity.keep_clean(clean, absent).count() == 50
    # nor do they take places in a sample
    sample, counts = toxicity.labelled_sample(table, labels.unionByName(absent), examples=30)
    assert sample.where("toxic = 1").count() == 30 and counts[0] + counts[1] < 400


def test_terms_idf_and_calibration_match_a_plain_count(spark):
    """Terms by counting documents, document frequencies by reading all texts, and rates by pooling over all orders."""
    import math
    import re
    import zlib

    docs, table, labels = labelled(spark)
    model = toxicity.fit(table, labels)
    texts = {}
    for i, t, *_ in docs:
        if i is not None and i < 400:
            texts[i] = min(t, texts.get(i, t))

    def terms(text):
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        every = Counter(words + [w[:n] + "*" for w in words for n in (4, 5) if len(w) > n])
        return {t + ("" if n == 1 else chr(n)) for t, c in every.items() for n in (1, 2, 4) if c >= n}

    train = {i: int(i % 4 == 0) for i in texts if zlib.crc32(str(i).encode()) % 5}
    train[5] = 0
    found = {0: Counter(), 1: Counter()}
    for i, y in train.items():
        found[y].update(terms(texts[i]))
    sizes = Counter(train.values())
    expected = set()
    for t in set(found[0]) | set(found[1]):
        a, b, na, nb = found[1][t] + 0.5, found[0][t] + 0.5, sizes[1] + 1.0, sizes[0] + 1.0
        odds = math.log(a / (na - a)) - math.log(b / (nb - b))
        if found[0][t] + found[1][t] >= 8 and odds >= 1.5 and odds / math.sqrt(1 / a + 1 / b) >= 3:
            expected.add(t)
    assert set(model.terms) == expected and len(expected) > 3
    df = Counter(t for d in docs for t in terms(d[1]))
    for t, i in model.terms.items():
        assert math.isclose(model.index.idf[i], math.log((1 + len(docs)) / (1 + df[t])) + 1)
    assert all(a <= b for a, b in zip(model.rates, model.rates[1:], strict=False))
    prior = sizes[1] / (sizes[0] + sizes[1])
    bins, rates = toxicity._pool(np.array([0.0, 0.5, 1.0]), np.array([4.0, 1.0, 9.0]), np.array([10.0, 10.0, 10.0]), prior)
    low = (5 + 4 * prior) / 24
    assert np.allclose(rates, [low, low, (9 + 2 * prior) / 12]) and bins.tolist() == [0.0, 0.5, 1.0]
