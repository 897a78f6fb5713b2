import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import curriculum, sharding


def test_shards_hold_every_row_in_gapless_places(spark, awkward, plain):
    got = sharding.assign_shards(awkward, n_shards=3, n_slots=64).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in plain)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == sizes
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})


def test_no_rows_give_no_shards(empty):
    assert sharding.assign_shards(empty).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=64, max_size=64), st.integers(2, 9))
def test_rebalancing_evens_out_and_only_edits(weights, shards):
    first = sharding.SlotMap.uniform(64, shards)
    totals = dict(enumerate(weights))
    second = first.rebalance(totals)
    load = [sum(w for s, w in totals.items() if second.shards[s] == n) for n in range(shards)]
    assert max(load) - min(load) <= max(weights)
    assert second.version == first.version + 1
    assert second.moved == [s for s in range(64) if first.shards[s] != second.shards[s]]


def test_map_versions_are_stored(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.SlotMap.uniform(16, 4)
    first.store(spark, path)
    second = first.rebalance({s: s * s for s in range(16)}, n_shards=5)
    second.store(spark, path)
    assert sharding.SlotMap.load(spark, path).shards == second.shards
    assert sharding.SlotMap.load(spark, path, 1).shards == first.shards


def test_a_stored_map_is_loaded_edited_and_grown(spark, awkward, tmp_path):
    path = str(tmp_path / "kept")
    first = {(r.virtual_slot, r.shard) for r in sharding.assign_shards(awkward, 3, 64, path).collect()}
    again = sharding.assign_shards(awkward, 3, 64, path).collect()
    assert {(r.virtual_slot, r.shard) for r in again} == first  # nothing to mend, nothing moves
    kept = sharding.SlotMap.load(spark, path)
    assert len(kept.shards) == 64 and {r.map_version for r in again} == {kept.version}
    grown = sharding.assign_shards(awkward, 4, 64, path).collect()
    newest = sharding.SlotMap.load(spark, path)
    assert newest.version == kept.version + 1 and newest.n_shards == 4 and {r.map_version for r in grown} == {newest.version}
    with pytest.raises(ValueError, match="version"):
        kept.store(spark, path)
    with pytest.raises(ValueError, match="slots"):
        sharding.assign_shards(awkward, 4, 32, path)


def water_level(sizes: dict, weights: dict, repeats: int = 3) -> dict:
    total, capped, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(capped.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > repeats * sizes[s]}
        if not over:
            return capped | {s: level * weights[s] for s in free}
        capped |= {s: repeats * sizes[s] for s in over}
        free -= over
    return capped


def test_targets_and_taken_words(awkward, plain):
    got = curriculum.mix_counts(awkward).collect()
    names = {s: ("z" if s is None else s) for *_, s, _ in plain}
    sizes = Counter()
    for _, t, _, s, _ in plain:
        sizes[names[s]] += len((t or "").split())
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
    expected = water_level(sizes, weights)
    assert len(got) == len(plain)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in expected.values()}
    assert all(r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, curriculum.mix_counts(awkward).collect()))


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 500), min_size=1))
def test_levels(spark, sizes):
    totals = spark.createDataFrame([("s" + s, n) for s, n in sizes.items()], "__mix_source string, __mix_source_size long")
    got = {r[0][1:]: r.__mix_target if hasattr(r, "__mix_target") else r["__mix_target"] for r in curriculum.source_targets(totals).collect()}
    expected = water_level(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))})
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def test_training_order_keeps_columns_and_sorts(awkward, empty):
    ordered = curriculum.training_order(awkward)
    assert ordered.columns == [*awkward.columns, "__mix_position"]
    positions = [r["__mix_position"] for r in ordered.select("__mix_position").collect()]
    assert positions == sorted(positions) and positions
    taken = sum(r.taken // r["size"] for r in curriculum.mix_counts(awkward).collect() if r["size"])
    assert len(positions) == taken
    assert curriculum.training_order(empty).count() == 0
