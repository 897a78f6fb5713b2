import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import simhash
from tests.llm.conftest import prose
from tests.llm.test_simhash import slow_print

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents and labels on disk: clean prose, toxic prose, exact and near copies, repeated ids, nulls."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, prose(500 + i, 80) + (" vilexa grumbot snarlik" if i % 5 == 0 else ""), "en", ["a", "b", None][i % 3], 0) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + (" tail" if i % 2 else ""), "en", "b", 0) for i in range(0, 60, 3)]
    docs += [(7, prose(9999, 90), "en", "a", 0), (None, prose(9998, 90), "en", "a", 0), (2000, None, "en", "a", 0), (2001, "", "en", "a", 0), docs[8]]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_run_keeps_what_its_stages_keep(spark, tables):
    folder, docs = tables
    got = corpus_pipeline.run(spark, folder).collect()
    clean = [d for d in docs if "vilexa" not in (d[1] or "")]
    heads = []  # by brute force: one row for each group of near duplicates
    for d in sorted(clean, key=lambda d: (d[0] is None, d[0] or 0)):
        near = lambda a, b: simhash.jaccard(a, b, 5) >= 0.8 or (slow_print(a, 5) ^ slow_print(b, 5)).bit_count() <= 2
        if not any(near(d[1], h[1]) for h in heads):
            heads.append(d)
    worded = [h for h in heads if (h[1] or "").split()]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = {hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest(): i for i, t, *_ in worded}
    taken = Counter(r.ids_sha256 for r in got)
    assert set(taken) <= set(sha) and all(r.doc_id == sha[r.ids_sha256] for r in got) and max(taken.values()) <= 3
    words = {h[3]: sum(len(x[1].split()) for x in worded if x[3] == h[3]) for h in worded}
    assert len({r.mix_position for r in got}) == len(got) and all(r.mix_position is not None for r in got)
    mixed = sum(len(dict((i, t) for i, t, *_ in worded)[r.doc_id].split()) for r in got)
    assert abs(mixed - sum(words.values())) <= 0.1 * sum(words.values())


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_awkward_and_empty_tables(spark, tables, awkward, empty, name):
    folder, _ = tables
    docs = awkward.withColumn("mix_position", F.lit("clash")).withColumn("__toxicity", F.lit("clash"))
    got, none = STAGES[name](spark, docs, folder), STAGES[name](spark, empty, folder)
    assert got.count() > 0 and none.count() == 0
    if name != "encode":
        assert set(docs.columns) <= set(got.columns)
    if name == "toxicity":
        assert got.count() == docs.count() and got.columns == docs.columns
    if name == "mix":
        assert dict(got.dtypes)["mix_position"] == "double"
