import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import product

import pytest

from larkspur.llm import sharding


def check(rows, found):
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found)) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in found)
    assert all(counts[s] - len(rows) // 40 in (0, 1) for s in range(40)) and set(counts) <= set(range(40))
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def fixtures():
    yield [(i, f"text {i}") for i in range(7)]  # fewer rows than shards
    yield [(i, None if i % 5 == 0 else f"text {i // 4}") for i in range(403)] + [(1, "text 0"), (None, "text 0"), (None, ""), (2, "")]
    yield [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(1000)]  # a third of all rows are one group
    yield [(i, "all") for i in range(500)]


@pytest.mark.parametrize("rows", list(fixtures()))
def test_law_and_slots(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, size string")
    found = sharding.shard(docs).collect()
    check(rows, found)
    # groups that fit are whole, and larger ones are in as few shards as they can be, but for what others leave
    by = defaultdict(list)
    crc = {zlib.crc32((t or "").encode()): t for _, t in rows}
    for r in found:
        by[crc[r["text_crc32"]]].append(r["shard"])
    quota = -(-len(rows) // 40)
    for text, shards in by.items():
        if text is not None and len(shards) > 1:
            assert len(set(shards)) <= -(-len(shards) // max(1, quota - 1)) + 2


def least_cut(sizes, quotas):
    """Of groups of these sizes, the fewest pairs that any filling of the shards separates."""
    pairs = lambda n: n * (n - 1) // 2

    @cache
    def best(at, rooms):
        if at == len(sizes):
            return 0
        ways = (k for k in product(*(range(min(r, sizes[at]) + 1) for r in rooms)) if sum(k) == sizes[at])
        return min(pairs(sizes[at]) - sum(map(pairs, k)) + best(at + 1, tuple(sorted(r - x for r, x in zip(rooms, k)))) for k in ways)

    return best(0, tuple(sorted(quotas)))


def test_cut_against_the_least(spark):
    """On small graphs: never more than the hash start's cut, and in all not far from the least possible."""
    rng, ours, least, hashed = random.Random(4), 0, 0, 0
    for _ in range(8):
        shards = rng.choice([2, 3])
        sizes = [rng.randrange(2, 6) for _ in range(rng.randrange(1, 4))]
        lone = rng.randrange(5)
        rows = [f"g{k}" for k, n in enumerate(sizes) for _ in range(n)] + [f"lone{k}" for k in range(lone)]
        found = sharding.shard(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string"), shards).collect()
        by = Counter((rows[r["doc_id"]], r["shard"]) for r in found)
        pairs = lambda n: n * (n - 1) // 2
        ours += sum(map(pairs, sizes)) - sum(pairs(n) for (t, _), n in by.items() if t.startswith("g"))
        least += least_cut(tuple(sizes), tuple(sharding._quotas(len(rows), shards)))
        hashed += sum(pairs(n) * (shards - 1) / shards for n in sizes)
    assert least <= ours <= 1.5 * least and ours < 0.8 * hashed, (ours, least, hashed)


def test_a_very_long_text(spark):
    long = "x" * 5_000_000
    found = {r["doc_id"]: r for r in sharding.shard(spark.createDataFrame([(1, long), (2, long), (3, "é")], "doc_id long, text string"), 2).collect()}
    assert found[1]["size"] == 5_000_016 and found[1]["shard"] == found[2]["shard"] and found[3]["size"] == 18


def test_lines_of_groups(spark):
    """Where a group stands is what a sort of its shard's line gives, through sizes, prefixes and groups."""
    rng = random.Random(1)
    rows = [(f"{rng.randrange(30):03x}{rng.randrange(10**6):06d}{i}", rng.randrange(3), rng.randrange(1, 5)) for i in range(400)]
    got = {r["g"]: r["before"] for r in sharding._before(spark.createDataFrame(rows, "g string, shard int, n long")).collect()}
    for s in range(3):
        total = 0
        for g, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], r[0])):
            assert got[g] == total
            total += n


def test_native(spark):
    plan = sharding.shard(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_numbering_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", 3)
    monkeypatch.setattr(sharding, "BUCKET", 30)
    rows = [(i, f"t{i % 11}" if i < 200 else f"u{i}") for i in range(400)]
    check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
