import random
import re
import zlib
from collections import Counter

import pytest

from brindle.llm import queries, spelling

SCHEMA = "doc_id long, text string, lang string, source string, word string, n string, block string"


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plainly(docs) -> set[tuple]:
    counts: Counter[str] = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                p = h % len(low)
                low = low[:p] + low[p + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and edits(w, v) == 1] for w in words}
    form = {}
    for w, some in near.items():
        if some:
            best = min(some, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def corpus() -> list[tuple]:
    rng = random.Random(2)
    stems = ["abcdef", "abcdefg", "prefixed", "prefixes", "suffixing", "été-été".replace("-", ""), "internation", "zzzzzzz"]
    words = Counter()
    for stem in stems:
        words[stem] = 400
        for _ in range(40):
            w, p = stem, rng.randrange(len(stem))
            for _ in range(rng.randrange(1, 3)):
                c = rng.choice("abeéÿxz")
                w = rng.choice([w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]])
            words[w] += rng.choice([3, 5, 6, 30, 90])
    words["abcdefgh"], words["abcdefghi"] = 3000, 20_000  # a chain of forms
    bag = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(bag)
    docs = [(i, " ".join(w.upper() if i % 7 == 0 else w for w in bag[i::97])) for i in range(97)]
    return [*docs, (None, None), (5, ""), (None, "prefixed, PREFIXED×prefixed ÷ prefixed"), docs[3], (200, "x" * 30_000 + " abcdef")]


@pytest.mark.parametrize("block", [7, 40, 16384])
def test_query_equals_brute_force_whatever_the_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "PART", max(3, block // 4))
    docs = corpus()
    spark.createDataFrame([(i, t, "en", "a", "clash", "clash", "clash") for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_spelling_variants(spark, str(tmp_path)).collect()
    expected = plainly(docs)
    assert len(got) == len(expected) > 100
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected
    assert any(w != r and f != r for w, f, r, *_ in expected)  # a chain of several forms


def test_a_scan_finds_all_and_skips_most():
    rng = random.Random(4)
    words = sorted({"abc" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9))) for _ in range(6000)})
    for word in rng.sample(words, 40):
        block = spelling.SortedWords(words)
        fixed = spelling.fixed_part(len(word))
        found = [words[i] for i in block.near(word, fixed)]
        assert found == [w for w in words if w[:fixed] == word[:fixed] and abs(len(w) - len(word)) <= 1 and edits(w, word) == 1]
        assert block.scanned < 0.2 * len(words)


def test_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None, "en", "a", "", "", "")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_spelling_variants(spark, str(tmp_path)).count() == 0
