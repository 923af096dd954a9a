import random
from bisect import bisect_left, insort

from inkweir.llm.packing import pack, plan


def best_fit_decreasing(sizes, capacity):
    gaps = []
    used = 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        used += gap == capacity
        if gap > s:
            insort(gaps, gap - s)
    return used


def test_plan_equals_sequential_best_fit():
    random.seed(3)
    for _ in range(60):
        sizes = [random.randint(1, 50) for _ in range(random.randint(1, 300))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        assert plan(counts, 50)[1] == best_fit_decreasing(sizes, 50)


def test_operator(spark):
    random.seed(4)
    sizes = [random.randint(1, 130) for _ in range(500)] + [0, None, 40] + [33] * 300
    df = spark.createDataFrame([(i, s, 1, 2) for i, s in enumerate(sizes)], "id long, n int, rank int, container int")
    rows = pack(df, "id", "n", 100).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["id"], []).append(r)
    assert set(parts) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        own = sorted(parts[i], key=lambda r: r["part_no"])
        assert sum(r["n_units"] for r in own) == (s or 0) and len(own) == max(1, -(-(s or 0) // 100))
    bins = {}
    for r in rows:
        if r["n_units"]:
            bins.setdefault(r["container"], []).append((r["at_unit"], r["n_units"], r["place"]))
    for own in bins.values():
        own.sort()
        at = 0
        for k, (a, n, place) in enumerate(own):
            assert a == at and place == k
            at += n
        assert at <= 100
    want = [p for s in sizes for p in ([100] * ((s or 0) // 100) + ([(s or 0) % 100] if (s or 0) % 100 else []))]
    assert len(bins) == best_fit_decreasing(want, 100)
    assert pack(df.limit(0), "id", "n", 100).count() == 0
