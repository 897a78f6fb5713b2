"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the corpus are counted, the most frequent ones encoded once and compiled into a minimal acyclic automaton:
equal suffixes share their states, and the outputs along a word's path add up to its ordinal, which finds its token
ids. Tasks map the compiled lexicon into memory and look up all distinct words of a slice of texts at once, a byte of each
word at a time. Words that it lacks are merged exactly, pair by pair in rank order, again many words at a time.

The tokenizer is a JSON file of the public tokenizers library with NFC, white-space and lower-case normalisation, one
split pattern, byte-level characters and word ends. Text between special tokens is normalised, split into words,
and each word encoded on its own, so white space is a safe place to cut a text.

Defined cases: a null text counts as empty and gives no ids; special tokens in a text give their own ids; texts of any
length are cut at white space; repeated rows are encoded alike; an empty table gives no rows; null ids decode to null. An
existing column with the name of an added one is replaced.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import id_lists, pick_lists, text_slices, written

#: Words in the lexicon: bounds the automaton, its compilation on the driver and what is broadcast.
LEXICON_WORDS = 131_072
#: Words of more bytes than this are merged with a heap, others in groups of about one length.
LONG, WIDTHS = 48, (4, 8, 12, 16, 24, 32, 48)
#: Bytes of text that a task encodes at a time, and token ids that it spells at a time.
SLICE, SPELL = 4 << 20, 1 << 20
_NONE = np.int32(2**31 - 1)
#: A comma or full stop after a character that is neither letter nor digit.
_CLUSTER = re.compile(r"[.,](?:(?<![\w \n][.,])|(?<=_[.,]))")
#: Pieces that are one word in any version of Unicode.
_PLAIN = "^[a-zß-öø-ÿ]+$"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next unused one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


def read_tokenizer(spec: str) -> dict:
    """What tasks need of a tokenizer file: ids of bytes inside and at the end of words, the merges, special tokens, the split."""
    model = json.loads(spec)
    vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"] or ""
    characters, pairs = byte_characters(), {}
    for rank, (a, b) in enumerate(model["model"]["merges"]):
        pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
    keys = np.array(sorted(pairs), np.int64)
    ranks, merged = (np.array([pairs[k][i] for k in keys.tolist()], np.int32) for i in (0, 1))
    # \s of the file's patterns is the White_Space property; the pattern keeps what it matches
    split = next(p for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    return {
        "inner": np.array([vocab[c] for c in characters], np.int32), "last": np.array([vocab[c + end] for c in characters], np.int32),
        "keys": keys, "ranks": ranks, "merged": merged, "special": {t["content"]: t["id"] for t in model["added_tokens"]},
        "split": split.replace(r"[^\s", r"[^\p{White_Space}"),
    }


class Merger:
    """Exact pair merging of words after a tokenizer file."""

    def __init__(self, tokenizer: dict):
        self.inner, self.last, self.keys, self.ranks = (tokenizer[k] for k in ("inner", "last", "keys", "ranks"))
        self.merged = tokenizer["merged"][np.argsort(self.ranks)]
        self.by_rank = np.sort(self.ranks)
        self.special = tokenizer["special"]
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(tokenizer["split"])
        self.pairs: dict[int, int] = {}

    def pieces(self, text: str) -> str:
        """The normalised text, in pieces that no word crosses: cut at white space and before commas and full stops."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma has no final form here
        text = text.lower()
        if not _CLUSTER.search(text):
            text = text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ")

    def marked(self, text: str) -> str:
        """Pieces of a text between blanks; special tokens, which aren't normalised, after a capital letter."""
        if not self.specials or "<" not in text:
            return self.pieces(text)
        return " ".join("S" + p if p in self.special else self.pieces(p) for p in self.specials.split(text))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, _NONE for those that don't merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def result(self, rank: np.ndarray) -> np.ndarray:
        return self.merged[np.searchsorted(self.by_rank, rank)]

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of non-empty words: all ids, where each word's begin, and how many it has."""
        data, offsets, sizes = _bytes_of(words)
        starts, counts, found, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.empty(0, np.int32)], 0
        groups = np.searchsorted(WIDTHS, sizes)
        for group in np.unique(groups):
            rows = np.flatnonzero(groups == group)
            if group < len(WIDTHS):
                ids, n = self._merge_rows(data, offsets[rows], sizes[rows], WIDTHS[group])
            else:
                lists = [self._merge_long(data[offsets[i] : offsets[i] + sizes[i]]) for i in rows]
                ids, n = np.array([x for each in lists for x in each], np.int32), np.array(list(map(len, lists)))
            starts[rows], counts[rows] = total + np.cumsum(n) - n, n
            found.append(ids)
            total += len(ids)
        return np.concatenate(found), starts, counts

    def _merge_rows(self, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """One word a row; every round merges the first pair of the least rank in each row that still has one."""
        at = np.arange(width)
        inside = at < sizes[:, None]
        ids = np.where(inside, self.inner[data[np.where(inside, offsets[:, None] + at, 0)]], -1)
        ends = np.arange(len(ids)), sizes - 1
        ids[ends] = self.last[data[offsets + sizes - 1]]
        ranks = np.full((len(ids), width), _NONE)
        ranks[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        ended = np.full((len(ids), width), -1, np.int32)
        live = np.arange(len(ids))
        while len(live):
            first = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(live)), first]
            going = rank < _NONE
            if not going.all():
                ended[live[~going]] = ids[~going]
                live, ids, ranks, first, rank = live[going], ids[going], ranks[going], first[going], rank[going]
                if not len(live):
                    break
            row = np.arange(len(live))
            ids[row, first] = self.result(rank)
            source = np.minimum(at + (at > first[:, None]), width - 1)  # what follows the pair moves one place to the left
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(at + (at >= first[:, None]), width - 1), axis=1)
            ranks[:, -1] = _NONE
            ranks[row, first] = self.rank_of(ids[row, first], ids[row, np.minimum(first + 1, width - 1)])
            before = first > 0
            ranks[row[before], first[before] - 1] = self.rank_of(ids[row[before], first[before] - 1], ids[row[before], first[before]])
        return ended[ended >= 0], (ended >= 0).sum(axis=1)

    def _merge_long(self, raw: np.ndarray) -> list[int]:
        """The same for one word with a heap of pairs and linked neighbours: n log n for words of any length."""
        if not self.pairs:
            self.pairs = {k: (rank, new) for k, rank, new in zip(self.keys.tolist(), self.ranks.tolist(), self.result(self.ranks).tolist(), strict=True)}
        ids = [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        n, get = len(ids), lambda a, b: self.pairs.get(a << 32 | b)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, found[1]) for i in range(n - 1) if (found := get(ids[i], ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or get(ids[i], ids[j]) != (rank, new):
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if found := get(new, ids[right[i]]):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if left[i] >= 0 and (found := get(ids[left[i]], new)):
                heapq.heappush(heap, (found[0], left[i], found[1]))
        return [i for i in ids if i >= 0]


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string array, where each word's begin, and their numbers."""
    words = words.cast(pa.large_binary())
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8), ends[:-1], np.diff(ends)


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The automaton of the words as bytes: counts, then states, arc labels, arc targets, arc outputs and token ids.

    Words enter in byte order; once a word leaves a branch, the branch's states are replaced from the bottom by equal
    states already registered, so the automaton is minimal at every step.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items() if w)
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: [final, arcs (label, state)], arcs to the next element pending
    labels: list[int] = []

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if (state := registry.get(key)) is None:
                state = registry[key] = len(states)
                states.append(key)
            path[-1][1].append((labels.pop(), state))

    before = b""
    for word, _ in words:
        common = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))  # noqa: B905
        settle(common)
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
        before = word
    settle(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root is the last state
    below = [0] * len(states)
    first, final, labels_out, targets, outputs = array("I"), bytearray(), bytearray(), array("I"), array("I")
    for i, (ends, arcs) in enumerate(states):
        first.append(len(labels_out))
        final.append(ends)
        seen = int(ends)
        for label, target in arcs:
            labels_out.append(label)
            targets.append(target)
            outputs.append(seen)
            seen += below[target]
        below[i] = seen
    first.append(len(labels_out))
    offsets, ids_out = array("I", [0]), array("I")
    for _, ids in words:
        ids_out.extend(ids)
        offsets.append(len(ids_out))
    head = struct.pack("<4I", len(states), len(labels_out), len(words), len(ids_out))
    return head + b"".join(x.tobytes() for x in (first, targets, outputs, offsets, ids_out)) + bytes(labels_out) + bytes(final)


class Lexicon:
    """A compiled lexicon, mapped into memory from a file without a name, which goes with the process."""

    def __init__(self, compiled: bytes):
        file = tempfile.TemporaryFile()  # noqa: SIM115
        file.write(compiled)
        file.flush()
        self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        file.close()
        n_states, n_arcs, self.n_words, n_ids = struct.unpack_from("<4I", self.map)
        at, parts = 16, []
        for n in (n_states + 1, n_arcs, n_arcs, self.n_words + 1, n_ids):
            parts.append(np.frombuffer(self.map, np.uint32, n, at))
            at += 4 * n
        first, self.targets, self.outputs, self.offsets, self.ids = parts
        labels = np.frombuffer(self.map, np.uint8, n_arcs, at)
        self.final = np.frombuffer(self.map, np.uint8, n_states, at + n_arcs)
        self.root, self.sizes = n_states - 1, np.diff(self.offsets)
        self.arcs = np.repeat(np.arange(n_states), np.diff(first)) << 8 | labels  # ascending: states in order, labels in order within

    def find(self, words: pa.Array) -> np.ndarray:
        """The words' ordinals, -1 for those that it lacks; one byte of every word at a time."""
        data, offsets, sizes = _bytes_of(words)
        found, live = np.full(len(words), -1), np.flatnonzero(sizes > 0)
        state, ordinal = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        for depth in range(int(sizes.max(initial=0))):
            wanted = state << 8 | data[offsets[live] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), max(len(self.arcs) - 1, 0))
            on = self.arcs[arc] == wanted if len(self.arcs) else np.zeros(len(live), bool)
            live, arc, ordinal = live[on], arc[on], ordinal[on]
            state, ordinal = self.targets[arc].astype(np.int64), ordinal + self.outputs[arc]
            last = sizes[live] == depth + 1
            ends = last & (self.final[state] > 0)
            found[live[ends]] = ordinal[ends]
            live, state, ordinal = live[~last], state[~last], ordinal[~last]
            if not len(live):
                break
        return found


class Encoder:
    def __init__(self, tokenizer: dict, compiled: bytes):
        self.merger, self.lexicon = Merger(tokenizer), Lexicon(compiled)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of words: all ids, where each word's begin, and how many it has."""
        ordinal, ids = self.lexicon.find(words), self.lexicon.ids.view(np.int32)
        known, lacking = ordinal >= 0, np.flatnonzero(ordinal < 0)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[known], sizes[known] = self.lexicon.offsets[ordinal[known]], self.lexicon.sizes[ordinal[known]]
        merged, starts[lacking], sizes[lacking] = self.merger.merge(words.take(pa.array(lacking)))
        starts[lacking] += len(ids)
        return np.concatenate([ids, merged]), starts, sizes

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and where each text's begin."""
        pieces = pc.split_pattern(pa.array(map(self.merger.marked, texts), pa.large_string()), pattern=" ")
        coded = pieces.values.dictionary_encode()
        plain, others = _sorted_out(coded.dictionary)
        split, special = self.merger.split.findall, self.merger.special
        held = [[p] if p[:1] == "S" else split(p) for p in coded.dictionary.take(others).to_pylist()]
        # words: the plain pieces, then those of the others; a piece has the words from its first on
        words = pa.concat_arrays([coded.dictionary.take(plain), pa.array([w for ws in held for w in ws], pa.large_string())])
        ids, starts, sizes = self.words(words)
        for i in range(len(plain), len(words)) if special else ():
            if (word := words[i].as_py())[:1] == "S":
                starts[i], sizes[i], ids = len(ids), 1, np.append(ids, np.int32(special[word[1:]]))
        flat, word_ends = pick_lists(ids, starts, sizes)
        n_words = np.zeros(len(coded.dictionary), np.int64)
        first = np.zeros(len(coded.dictionary), np.int64)
        n_words[plain], first[plain] = 1, np.arange(len(plain))
        n_words[others] = list(map(len, held)) if held else 0
        first[others] = len(plain) + np.cumsum(n_words[others]) - n_words[others]
        begins, lengths = word_ends[first], word_ends[first + n_words] - word_ends[first]
        at = coded.indices.to_numpy()
        out, ends = pick_lists(flat, begins[at], lengths[at])
        return out, ends[pieces.offsets.to_numpy()]


def _sorted_out(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pieces that are one word, and of all others."""
    plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(plain), np.flatnonzero(~plain)


def count_words(docs: DataFrame, tokenizer: dict, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of the split pattern occurs in all texts; counted per slice before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(shared.value)
        for batch in batches:
            for at, n in text_slices(batch.column(0), SLICE):
                marked = pa.array(map(merger.marked, batch.column(0).slice(at, n).to_pylist()), pa.large_string())
                counts, words = pc.split_pattern(marked, pattern=" ").values.value_counts(), Counter()
                pieces, numbers = counts.field(0), counts.field(1)
                plain, others = _sorted_out(pieces)
                for piece, k in zip(pieces.take(others).to_pylist(), numbers.take(others).to_pylist(), strict=True):
                    if piece[:1] != "S":
                        for word in merger.split.findall(piece):
                            words[word] += k
                yield pa.RecordBatch.from_arrays([pieces.take(plain).cast(pa.string()), numbers.take(plain)], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: dict, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words: those of the frequency classes, eight to an octave, that ``size`` lets in whole."""
    frequency = F.floor(8 * F.log2("n")).cast("int")
    counts = written(count_words(docs, tokenizer, text_col), "bpe-words")
    room, least = size, None
    for r in sorted(counts.groupBy(frequency.alias("class")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["class"]):
        if r.words > room:
            break
        room, least = room - r.words, r["class"]
    frequent = [r.word for r in counts.where(frequency >= least).select("word").collect()] if least is not None else []
    ids, starts, sizes = Merger(tokenizer).merge(pa.array(frequent, pa.large_string()))
    return compile_lexicon({w: ids[a : a + n].tolist() for w, a, n in zip(frequent, starts, sizes, strict=True)})


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids", lexicon: bytes | None = None, keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """The columns in ``keep`` (default: all) and the token ids of every text in ``ids_col``.

    ``vocabulary``: path of the tokenizer file on the driver. Tasks hand on the ids of a few megabytes of text at a time. With
    ``decoded_col`` the same tasks decode the ids that they hand on, so that no second worker holds them.
    """
    with open(vocabulary, encoding="utf-8") as file:
        tokenizer = read_tokenizer(file.read())
    compiled = build_lexicon(docs, tokenizer, text_col) if lexicon is None else lexicon
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(tokenizer), context.broadcast(compiled)
    tokens = context.broadcast(token_names(vocabulary) if decoded_col else [])
    names = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*(b.value for b in shared))  # goes with the task, so that idle workers stay small
        table = pa.array(tokens.value, pa.string())
        for whole in batches:
            for at, n in text_slices(whole.column(0), SLICE):
                batch = whole.slice(at, n)
                coded = id_lists(*encoder.encode_all([t or "" for t in batch.column(0).to_pylist()]))
                columns = [*batch.columns[1:], coded]
                yield pa.RecordBatch.from_arrays([*columns, spell(coded, table)] if decoded_col else columns, [*names, ids_col, *([decoded_col] if decoded_col else [])])

    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in names])
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    return rows.mapInArrow(ids, T.StructType([*rows.schema.fields[1:], *added]))


def token_names(vocabulary: str) -> list[str]:
    """The tokens of a tokenizer file by their ids."""
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    names = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


def spell(lists: pa.ListArray, table: pa.StringArray) -> pa.StringArray:
    """The tokens of each list of ids, joined by spaces, as a file without decoder asks for; some ids at a time."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    ends, values, parts, at = np.append(0, np.cumsum(sizes)), lists.flatten(), [], 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + SPELL, "right")) - 1)
        tokens = table.take(values.slice(ends[at], ends[end] - ends[at]))
        parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[at : end + 1] - ends[at], pa.int32()), tokens), " "))
        at = end
    joined = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return joined if not lists.null_count else pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its token ids in ``text_col``."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_names(vocabulary))

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(shared.value, pa.string())
        for lists in batches:
            yield spell(lists, table)

    return encoded.withColumn(text_col, texts(F.col(f"`{ids_col}`")))
