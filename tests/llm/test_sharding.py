import random
import zlib
from collections import Counter, defaultdict

from citeloom.llm.sharding import CapacityTree, best_fit_decreasing, fill_shards, fit_classes, shard_documents


def test_tree_gives_the_tightest_bin_and_stays_balanced():
    rnd, tree, bins = random.Random(3), CapacityTree(), []
    for i in range(3000):
        if bins and rnd.random() < 0.45:
            need = rnd.randrange(1, 500)
            want = min((b for b in bins if b >= need), default=None)
            got = tree.take(need)
            assert (got[0] if got else None) == want
            if want is not None:
                bins.remove(want)
        else:
            k = rnd.randrange(1, 500)
            tree.add(k, i)
            bins.append(k)
    assert tree.root.height <= 12


def test_best_fit_decreasing_against_a_list_of_bins():
    rnd = random.Random(1)
    sizes = [(i, rnd.randrange(1, 60)) for i in range(400)]
    place, n = best_fit_decreasing(sizes, 100)
    bins = []
    for _, s in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= s
        else:
            bins.append(100 - s)
    load = defaultdict(int)
    for i, s in sizes:
        load[place[i]] += s
    assert n == len(bins) and sorted(load.values()) == sorted(100 - b for b in bins)


def test_a_large_item_has_its_own_shard_and_the_rest_is_even():
    sizes = [("big", 5000)] + [(i, 10) for i in range(1000)]
    place = fill_shards(sizes, 5)
    load = defaultdict(int)
    for i, s in sizes:
        load[place[i]] += s
    assert sorted(load.values()) == [2500, 2500, 2500, 2500, 5000]


def test_documents(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcé", k=rnd.randrange(0, 80))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:40])] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got = shard_documents(df, 4).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    slots, load, of = defaultdict(list), defaultdict(int), defaultdict(set)
    by_id = dict(rows)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        if r.doc_id != 7:
            of[by_id[r.doc_id] or ""].add(r.shard)
    assert set(slots) <= {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    assert max(load.values()) < 1.1 * sum(load.values()) / 4
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_fit(items, capacity):
    """Best-fit-decreasing item by item over a list of bins."""
    bins = []
    for s in sorted(items, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= s
        else:
            bins.append(max(capacity, s) - s)
    return [b for b in bins]


def test_runs_of_a_size_go_where_single_items_go():
    rnd = random.Random(8)
    for _ in range(50):
        items = [rnd.randrange(1, 12) for _ in range(rnd.randrange(1, 200))]
        capacity = rnd.randrange(8, 60)
        counts = sorted(Counter(items).items(), reverse=True)
        runs, bins = fit_classes(counts, capacity)
        load, of = defaultdict(int), dict(counts)
        for k, (size, first, b) in enumerate(runs):
            after = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == size else of[size]
            load[b] += size * (after - first)
        left = plain_fit(items, capacity)
        assert bins == len(left) and sum(load.values()) == sum(items)
        assert sorted(max(capacity, v) - v for v in load.values()) == sorted(left)


def test_all_groups_of_documents_go_by_best_fit(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("ab", k=rnd.randrange(0, 120))) for _ in range(500)]
    rows = list(enumerate(rnd.choices(texts, k=1500)))
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    load, sizes = defaultdict(int), Counter()
    for r in got:
        load[r.shard] += r.size
    for _, t in rows:
        sizes[t] += len(t) + 1
    assert len({(dict(rows)[r.doc_id], r.shard) for r in got}) == len(sizes)
    want = defaultdict(int)
    for item, b in fill_shards(list(sizes.items()), 5).items():
        want[b] += sizes[item]
    assert sorted(load.values()) == sorted(want.values())
    mean = sum(sizes.values()) / 5
    assert max(load.values()) < 1.001 * mean + 2
    capacity = max(load.values())  # and no such capacity is beaten by more than a ten-thousandth, by items one by one
    assert len(plain_fit(sizes.values(), capacity)) == 5 and len(plain_fit(sizes.values(), int(mean * 0.9999) - 1)) > 5


def test_a_text_of_many_megabytes_and_a_hot_group(spark):
    rows = [(0, "x" * 5_000_000)] + [(i, "the same") for i in range(1, 2000)] + [(i, str(i)) for i in range(2000, 3000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert len(got) == 3000 and len({r.shard for r in got if 0 < r.doc_id < 2000}) == 1
    assert {r.shard for r in got if r.doc_id == 0}.isdisjoint({r.shard for r in got if r.doc_id})
