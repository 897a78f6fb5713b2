import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import bpe, common, token_files
from brindle.llm.common import PieceMemo
from brindle.llm.queries import bpe_digest

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = st.text(alphabet="abcEΣσİß \n\t\r\x0b\x1c\x85\xa0　 'strelv12Ⅷ.,!?_-́é漢\0\1\2S<|endoftext|>", max_size=60)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def encoder():
    tokenizer, words = bpe.read_tokenizer(open(WORD, encoding="utf-8").read()), ["the", "then", "stone", "stones", "é", "漢字"]  # noqa: SIM115
    ids, starts, sizes = bpe.Merger(tokenizer).merge(pa.array(words, pa.large_string()))
    return bpe.Encoder(tokenizer, bpe.compile_lexicon({w: ids[a : a + n].tolist() for w, a, n in zip(words, starts, sizes, strict=True)}))


@settings(max_examples=300, deadline=None)
@given(st.lists(AWKWARD | st.sampled_from(["a <|endoftext|> b", "x" * 400, "ab" * 300 + " c"]), min_size=1, max_size=4))
def test_encoders_match_the_library(word_library, byte_library, encoder, texts):
    for library, encode in ((word_library, encoder.encode_all), (byte_library, PIECES.encode_all)):
        ids, at = encode(texts)
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]  # noqa: B905
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


PIECES = token_files.PieceEncoder(open(BYTE, encoding="utf-8").read())  # noqa: SIM115


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=8)), st.lists(st.text(alphabet="abcé", max_size=9)))
def test_lexicon_finds_its_words_only_and_is_minimal(words, others):
    entries = {w: [len(w), i] for i, w in enumerate(sorted(words))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    asked = [*words, *others]
    for w, found in zip(asked, lexicon.find(pa.array(asked, pa.large_string())).tolist(), strict=True):
        got = lexicon.ids[lexicon.offsets[found] : lexicon.offsets[found + 1]].tolist() if found >= 0 else None
        assert got == (entries[w] if w else None) if w in entries else got is None
    rights = {frozenset(w.encode()[i:] for w in words if w.encode().startswith(p)) for p in {w.encode()[:i] for w in words for i in range(len(w.encode()) + 1)} for i in [len(p)]} or {frozenset()}
    assert lexicon.root + 1 == len(rights)


def test_bpe_digests(awkward, empty, plain, word_library):
    got = bpe_digest(bpe.decode(bpe.encode(awkward, WORD), WORD)).collect()
    assert Counter(bpe_digest(bpe.encode(awkward, WORD, decoded_col="decoded")).collect()) == Counter(got)
    expected = Counter()
    for i, t, *_ in plain:
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        expected[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == expected
    assert bpe_digest(bpe.decode(bpe.encode(empty, WORD), WORD)).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, awkward, plain, byte_library, tmp_path, encoding):
    path = str(tmp_path / "tokens")
    got = sorted((r for r in token_files.token_file_digest(awkward, BYTE, path, encoding=encoding).collect()), key=lambda r: r.start)
    ids = {}
    for i, t, *_ in plain:
        ids.setdefault(i, []).append([*byte_library.encode(t or "", add_special_tokens=False).ids, 0])
    assert [r.doc_id for r in got] == sorted((i for i, *_ in plain), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, xs in ids.items() for x in xs)
    in_files = [row for file in sorted((tmp_path / "tokens").glob("*.parquet")) for row in pq.read_table(file).to_pylist()]
    assert [(r["doc_id"], crc(r["token_ids"])) for r in in_files] == [(r.doc_id, r.ids_crc32) for r in got]  # also for rows that share an id
    stored = {tuple(r.token_ids) for r in token_files.read_tokens(spark, path).where("doc_id = 9").collect()}
    assert stored == {tuple(x) for x in ids[9]}


def test_rows_that_share_an_id_start_where_their_file_says(spark, tmp_path):
    table = spark.createDataFrame([(7, f"text {i} " * (i + 1)) for i in range(40)] + [(i, "x") for i in range(5, 9)], "doc_id long, text string")
    got = sorted(token_files.token_file_digest(table, BYTE, str(tmp_path / "ties")).collect(), key=lambda r: r.start)
    in_files = [row for file in sorted((tmp_path / "ties").glob("*.parquet")) for row in pq.read_table(file).to_pylist()]
    at = 0
    for r, row in zip(got, in_files, strict=True):
        assert (r.start, r.doc_id, r.ids_crc32) == (at, row["doc_id"], zlib.crc32(np.array(row["token_ids"], "<u4").tobytes()))
        at += r.n_tokens


def test_pieces_are_forgotten_and_resolved_again():
    memo = PieceMemo(lambda pieces: (np.array([int(p) for p in pieces], np.int32), np.ones(len(pieces), np.int64)), size=10)
    for at in range(0, 60, 3):
        ids, ends = memo.lists([" ".join(map(str, range(at, at + 6))), "1 2 1"], " ")
        assert ids.tolist() == [*range(at, at + 6), 1, 2, 1] and ends.tolist() == [0, 6, 9] and len(memo.known) <= 10


def test_words_before_symbols_reach_the_library_once(byte_library):
    encoder, asked = token_files.PieceEncoder(open(BYTE, encoding="utf-8").read()), []  # noqa: SIM115
    resolve = encoder.memo.resolve
    encoder.memo.resolve = lambda keys: asked.extend(keys) or resolve(keys)
    texts = [" stonés" + symbols for symbols in ("&&&", "$$$", "=7", "'s", "'s&&&", "")] * 2
    texts += ["à\xa0 là", " à ×à\n\tà", "<|endoftext|> à", "x  ", " "]  # tokens that join what stands beside a blank
    ids, at = encoder.encode_all(pa.array([None, *texts]))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[], *(e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False))]  # noqa: B905
    assert sum("stonés" in k for k in asked) == 1 and len(asked) == len(set(asked))


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(common, "piece_hashes", lambda pieces: np.zeros(len(pieces), np.uint64))
    memo = PieceMemo(lambda pieces: (np.array([int(p) for p in pieces], np.int32), np.ones(len(pieces), np.int64)), size=10)
    for at in range(0, 30, 3):
        assert memo.lists([" ".join(map(str, range(at, at + 6)))], " ")[0].tolist() == [*range(at, at + 6)]


def test_no_documents_give_empty_files(empty, tmp_path):
    assert token_files.token_file_digest(empty, BYTE, str(tmp_path / "none")).count() == 0
