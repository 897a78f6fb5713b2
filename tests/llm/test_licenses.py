import random
import re
from collections import Counter

import pytest

from brindle.llm import licenses

MIT = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 500)
GPL = next(t for label, t in licenses.TEMPLATES if label == "gpl")
TEXTS = {
    1: None, 2: "", 3: "Licensed under CC-BY 4.0. All rights reserved.\nCC by, cc by", 4: "... released Under the MIT License, Version", 5: "words " * 5000 + "General Public License",
    6: "nothing here", 7: "x " * 30 + "Licensed under the Apache License, Version 2.0 " + "y " * 40, 8: "licensed the apache under a version", 9: "cc byline; all rights not reserved", 10: "Ünï cc by cc by",
    11: "we released the tool last year under pressure; mit students need a driving license", 12: MIT, 13: "z " * 77 + MIT.replace("Software", "Program") + " z" * 300, 14: GPL[: len(GPL) // 2],
    15: "\u212a cc by wor\u212a r\u0131ghts \u0130 al\u212a rights", 16: "--", 17: "-cc by-", 18: "é general public licensé general  public\nLICENSE",
}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at_all = lambda p: [i for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in at_all(p.split())]
    labels, best, n = {x for _, x in places}, 0.0, len(places)
    for label, template in licenses.TEMPLATES:
        own = re.findall("[a-z0-9]+", template.lower())
        if len(own) < licenses.SHORT:
            found = len(at_all(own))
            n += found
            labels |= {label} if found else set()
            continue
        step = licenses.step_of(len(own))
        for start in range(0, max(1, len(words)), step):
            share = len(set(words[start : start + 2 * step]) & set(own)) / len(set(own))
            if share >= licenses.THRESHOLD - 1e-9:
                labels, best = labels | {label}, max(best, share)
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), max(best, 1 - 0.5**n)


def test_license_scan_matches_brute_force(spark, awkward, empty, plain):
    table = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS.items()] + [(3, TEXTS[3], "clash"), (None, TEXTS[4], "clash")], "doc_id long, text string, row string")
    expected = Counter((i, *brute(t)) for i, t in [*TEXTS.items(), (3, TEXTS[3]), (None, TEXTS[4])])
    assert Counter(map(tuple, licenses.license_scan(table).collect())) == expected
    assert Counter(map(tuple, licenses.license_scan(awkward).collect())) == Counter((i, *brute(t)) for i, t, *_ in plain)
    assert licenses.license_scan(empty).count() == 0


def test_bodies_are_found_wherever_they_start_and_words_alone_are_not(spark):
    rng, rows = random.Random(2), []
    filler = "of the to software license use copyright any and".split()
    for number, (_, text) in enumerate(t for t in licenses.TEMPLATES if len(licenses.word_list(t[1])) >= licenses.SHORT):
        words = licenses.word_list(text)
        for lead in (0, 1, 37, 200, 311):
            kept = [w for w in words if rng.random() > 0.06]
            rows.append((number * 1000 + lead, " ".join(rng.choices(filler, k=lead) + kept + rng.choices(filler, k=lead // 2))))
    rows.append((99999, TEXTS[11]))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: brute(t) for i, t in rows}
    bodies = [label for label, t in licenses.TEMPLATES if len(licenses.word_list(t)) >= licenses.SHORT]
    assert all(bodies[i // 1000] in r.labels and 0.8 <= r.score <= 1 for i, r in got.items() if i != 99999)
    assert got[99999].labels == "" and got[99999].score == 0


@pytest.mark.parametrize("words, step", [(1, 16), (12, 16), (13, 32), (102, 128), (103, 256)])
def test_a_block_holds_a_template_and_a_quarter_more(words, step):
    assert licenses.step_of(words) == step
