"""Packing and sharding plans against the same rules, applied piece by piece to plain lists."""

import random
from collections import Counter

import pytest

from faultline.llm import bestfit, sharding


def windows_one_by_one(lengths, size):
    """Best-two-fit on a list of pieces: no histogram, no repeated pattern."""
    left, made = sorted(lengths, reverse=True), []
    while left:
        window, gap = [], size
        while True:
            fitting = [x for x in left if x <= gap]
            if not fitting:
                break
            left.remove(max(fitting))
            window.append(max(fitting))
            gap -= max(fitting)
        if gap:
            smallest = window[-1]
            room, best = gap + smallest, (smallest, None)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best[0] < a + b <= room:
                        best = (a + b, (a, b))
            if best[1]:
                window.pop()
                left.append(smallest)
                for x in best[1]:
                    left.remove(x)
                    window.append(x)
                left.sort(reverse=True)
        made.append(window)
    return made


@pytest.mark.parametrize("seed", range(20))
def test_packing_is_that_of_single_pieces(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(20, 40), 33, 11]) for _ in range(rng.randint(1, 90))]
    plan = bestfit.patterns(Counter(lengths), 64)
    plain = windows_one_by_one(lengths, 64)
    assert sum(n for _, n in plan) == len(plain)
    assert sorted(sum(w) for w, n in plan for _ in range(n)) == sorted(sum(w) for w in plain)


@pytest.mark.parametrize("seed", range(20))
def test_single_groups_take_the_tightest_bin(seed):
    rng = random.Random(seed)
    groups = [(f"g{i}", rng.randint(1, 60)) for i in range(rng.randint(1, 80))]
    bins, runs, count = sharding.pack_classes(groups, [], 100)
    rooms, where = [], {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            _, i = min(fitting)
        else:
            i = len(rooms)
            rooms.append(100)
        rooms[i] -= size
        where[key] = i
    assert (bins, runs, count) == (where, [], len(rooms))
