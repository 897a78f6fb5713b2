import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from brindle.llm import lz_fingerprint, ngram_lm


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


@pytest.mark.parametrize("fan", [512, 3, 2])
def test_scores_follow_the_interpolated_counts(awkward, plain, monkeypatch, fan):
    """In one step, by way of parts of a few slices, and by way of parts of parts."""
    monkeypatch.setattr(ngram_lm, "FAN", fan)
    weights = np.tile([0.5, 0.3, 0.2], (ngram_lm.CONTEXTS, 1))
    weights[0] = 0, 0.6, 0.4
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda *_: weights)
    monkeypatch.setattr(ngram_lm, "SLICE", 4000)
    monkeypatch.setattr(ngram_lm, "BUCKET", 30_000)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.corpus_scores(awkward).collect())
    test = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for i, t, *_ in plain:
        if not test(i):
            w = words(t)
            one.update(w)
            two.update(zip(["\n", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    expected = Counter()
    for i, t, *_ in plain:
        w = words(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["\n", *w], w, strict=False):
            x = weights[0 if not one[a] else 1]
            score += math.log10(x[0] * two[a, b] / max(1, one[a]) + x[1] * one[b] / n + x[2] / (v + 1))
        expected[(i, test(i), len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6))] += 1
    assert got == expected


def test_parts_learn_the_same_weights(awkward, monkeypatch):
    learned, plain_learn = [], ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda *a: learned.append(plain_learn(*a)) or learned[-1])
    monkeypatch.setattr(ngram_lm, "SLICE", 4000)
    monkeypatch.setattr(ngram_lm, "BUCKET", 3000)
    for fan in (10**6, 2):
        monkeypatch.setattr(ngram_lm, "FAN", fan)
        ngram_lm.corpus_scores(awkward).count()
    assert np.allclose(*learned, atol=1e-9) and not np.allclose(learned[0], 1 / 3)


def test_levels_keep_blobs_whole_whatever_the_corpus():
    """A blob has about the same bytes at all levels of all sizes, and a slice or a range of a part sends a bounded number."""
    for size in (10**8, 10**10, 10**12, 10**14):
        cuts = ngram_lm.levels(size, -(-size // ngram_lm.SLICE))
        units = -(-size // ngram_lm.SLICE)
        assert cuts == sorted(cuts) and len(cuts) <= 4
        for lower, upper in zip([0, *cuts], cuts, strict=False):
            assert 2 ** (upper - lower) <= 2048  # what one task cuts its unit, or its range of a unit, into
            assert size / (units * 2**upper) >= 4096 or upper == cuts[-1]
            units = -(-units // ngram_lm.FAN)
        assert size / 2 ** cuts[-1] <= ngram_lm.BUCKET


def test_weights_are_those_of_a_plain_expectation_maximisation(awkward, plain, monkeypatch):
    learned, plain_learn = [], ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda *a: learned.append(plain_learn(*a)) or learned[-1])
    ngram_lm.corpus_scores(awkward).count()
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    one, two, held = Counter(), Counter(), []
    for i, t, *_ in plain:
        w = words(t)
        if part(i) == 3:
            held += zip(["\n", *w], w, strict=False)
        elif part(i) != 2:
            one.update(w)
            two.update(zip(["\n", *w], w, strict=False))
    n, types = sum(one.values()), len(one)
    events: dict[int, list[tuple]] = {}
    for a, b in held:
        context = 0 if not one[a] else min(15, 1 + int(math.log2(one[a])))
        events.setdefault(context, []).append((two[a, b] / max(1, one[a]), one[b] / n, 1 / (types + 1)))
    assert held and len(events) > 2
    for context, each in events.items():
        w = [0, 0.5, 0.5] if context == 0 else [1 / 3] * 3
        for _ in range(60):
            sums = [0.0, 0.0, 0.0]
            for p in each:
                total = sum(x * y for x, y in zip(w, p, strict=True))
                sums = [s + x * y / total for s, x, y in zip(sums, w, p, strict=True)]
            w = [s / len(each) for s in sums]
            w[2] = max(w[2], 1e-6)
        w = [x / sum(w) for x in w]
        assert np.allclose(learned[0][context], w, atol=0.02), (context, learned[0][context], w)


def test_learned_weights_beat_the_base_on_held_out_texts(awkward, empty):
    rows = ngram_lm.corpus_scores(awkward).where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert ngram_lm.corpus_scores(empty).count() == 0


@pytest.mark.parametrize("counts", [np.array([0, 1, 2, 3, 4, 70000, 5])])
def test_context_buckets(counts):
    assert ngram_lm.context_bucket(counts).tolist() == [0, 1, 2, 2, 3, 15, 3]


def plain_print(text: str) -> list[int]:
    """The least hash of the Lempel-Ziv phrases in each of 128 equal ranges, by its last 16 bits; 0 without any."""
    known: dict[bytes, None] = {}
    phrase = b""
    for byte in text.encode():
        phrase += bytes([byte])
        if phrase not in known:
            known[phrase] = None
            phrase = b""
    least: dict[int, int] = {}
    for h in map(xxhash.xxh64_intdigest, known):
        least[h >> 57] = min(h, least.get(h >> 57, h))
    return [max(1, least[slot] % 65536) if slot in least else 0 for slot in range(128)]


def plain_likeness(a: list[int], b: list[int]) -> float:
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_neighbours_match_a_plain_loop(awkward, plain, spark):
    rows = sorted(((i, t or "") for i, t, *_ in plain if i is not None and i != 5))
    got = sorted(lz_fingerprint.neighbour_fingerprints(awkward.where("doc_id IS NOT NULL AND doc_id <> 5")).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, text), (_, after) in zip(got, rows, [*rows[1:], rows[0]], strict=True):
        other = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, following = map(plain_print, (text, other, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (np.frombuffer(r.fingerprint, np.uint16).tolist(), np.frombuffer(r.edited_fingerprint, np.uint16).tolist()) == (own, changed)
        assert (r.near_edited, r.near_next) == (plain_likeness(own, changed), plain_likeness(own, following))


def test_repeated_ids_nulls_and_single_documents(awkward, empty, plain):
    got = lz_fingerprint.neighbour_fingerprints(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in plain)
    one = lz_fingerprint.neighbour_fingerprints(awkward.where("doc_id = 20")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert lz_fingerprint.neighbour_fingerprints(empty).count() == 0


def test_likeness_follows_shared_phrases():
    a, b = "the river runs by the old stone mill " * 20, "completely different wording, numbers 123 456 789 " * 20
    near, far = lz_fingerprint.fingerprint(a + "x"), lz_fingerprint.fingerprint(b)
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), near) > 0.9 > 0.3 > lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), far)
