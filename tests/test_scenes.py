"""Scenes against the sequential rule."""

import random
from collections import defaultdict

import pytest

from corpuloom.operators import scenes


def plain(rows, threshold, shortest):
    by = defaultdict(dict)
    for v, f, d in rows:
        if f is not None:
            by[v][f] = max(by[v].get(f, 0.0), d or 0.0)
    out = []
    for v, frames in by.items():
        last = min(frames)
        for f in sorted(frames):
            if frames[f] >= threshold and f - last >= shortest:
                out.append((v, last, f))
                last = f
        out.append((v, last, max(frames) + 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shortest", [1, 4, 15, 1000])
@pytest.mark.parametrize("share", [0.02, 0.5, 1.0])
def test_scenes(spark, shortest, share):
    rng = random.Random(shortest)
    rows = [("long", f, 30.0 if rng.random() < share else 1.0) for f in range(7, 1500) if rng.random() < 0.97]
    rows += [(v, f, rng.choice([None, 0.0, 27.0, 90.0])) for v in ("a", "b", None, "") for f in range(rng.randint(1, 40))]
    rows += [("one", 5, 99.0), ("a", 3, 99.0), ("a", None, 99.0), ("calm", 1, 0.0), ("calm", 9, 0.0)]
    rng.shuffle(rows)
    got = scenes.scenes(spark.createDataFrame(rows, "video string, frame long, difference double").repartition(3), 27.0, shortest)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 27.0, shortest)


def test_no_frames(spark):
    assert scenes.scenes(spark.createDataFrame([], "video string, frame long, difference double")).collect() == []
