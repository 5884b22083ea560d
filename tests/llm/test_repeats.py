"""Passages that repeat, byte for byte against brute force, also where rows, ids and texts repeat."""

import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd
from tidemark.llm.common import Workspace, ship_package


def brute(rows, width=100):
    """Per row, the bytes that stay. The first place (id, start) of each string keeps it; null ids take no part."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            s = b[p : p + width]
            first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < (i, p):
                hit[p : p + width] = b"\1" * width
        out.append((i, len(b), sum(hit), bytes(x for x, h in zip(b, hit) if not h)))
    return out


def compared(spark, rows, parts=3):
    ship_package(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r["id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in sd.remove_repeats(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def passage(rng, n):
    return " ".join(rng.choice(["tanor", "Thele", "ing", "of", "the", "oblan,", "ço", "été"]) for _ in range(n))


def test_repeated_rows_and_ids(spark):
    rng = random.Random(4)
    t, u, v = passage(rng, 120), passage(rng, 90), passage(rng, 60)
    compared(spark, [(1, t), (1, t), (2, u)])  # a row that occurs twice is no repeat of itself
    compared(spark, [(1, t), (1, t), (2, u), (3, t), (3, t), (3, u + v), (3, v + u), (None, t), (None, v), (4, v), (5, None), (5, ""), (6, "é" * 300), (7, t[:150] + v)])


@pytest.mark.parametrize("heavy", [1000, 3])
def test_shared_phrase_in_many_texts(spark, monkeypatch, heavy):
    """Also where one gram's runs are dealt window by window; the whole text of one is in no other."""
    rng = random.Random(heavy)
    phrase, boiler = passage(rng, 8), passage(rng, 45)
    rows = [(i, passage(rng, rng.randint(3, 40)) + (phrase if i % 2 else boiler) + passage(rng, rng.randint(0, 30))) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(20)] + [(200, boiler * 5), (201, "a" * 900)]
    if heavy == 3:
        monkeypatch.setattr(sd, "HEAVY", heavy)
        emit, judge = sd._emit_runs, sd._judge_texts  # workers read the module anew: what is small there goes with the function
        monkeypatch.setattr(sd, "_emit_runs", lambda w: _with(emit(w), HELD=300, PART=1500))
        monkeypatch.setattr(sd, "_judge_texts", lambda w: _with(judge(w), SORTED=500))
    compared(spark, rows, 5)


def _with(task, **small):
    def run(batches):
        from tidemark.llm import suffix_dedup

        for k, v in small.items():
            setattr(suffix_dedup, k, v)
        yield from task(batches)

    return run


def test_random_texts_of_few_letters(spark):
    rng = random.Random(9)
    for size in (3, 40):
        compared(spark, [(rng.randrange(size), "".join(rng.choice("ab") * rng.choice([1, 7, 60]) for _ in range(rng.randint(1, 30)))) for _ in range(50)])


def test_deep_shallow_sorts():
    rng = np.random.default_rng(5)
    for trial in range(80):
        data = np.concatenate([rng.integers(97, 99, 600, np.uint8), np.tile(rng.integers(97, 123, 150, np.uint8), 6), np.full(300, 97, np.uint8)])
        n = int(rng.integers(1, 400))
        group = rng.integers(0, rng.integers(1, 20), n)
        width = rng.integers(8, 140, 20)[group]
        at = rng.integers(0, len(data) - 140, n) if trial % 2 else rng.integers(0, 30, n) * 7 + 600
        order, new = sd.deep_shallow(data, at, width, group, int(rng.integers(0, 5)), int(rng.integers(1, 40)))
        strings = [(int(group[i]), bytes(data[at[i] : at[i] + width[i]])) for i in order]
        assert strings == sorted(strings) and sorted(order.tolist()) == list(range(n))
        assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(n)]


def test_tables_leave_the_disk_when_a_step_is_over(spark, tmp_path):
    ws = Workspace(spark, "freed")
    ws.root = f"file://{tmp_path}/freed"
    text = "".join(f"line {i} of a passage that repeats, {i * i}; " for i in range(200))
    docs = spark.createDataFrame([(i, f"{i} {text} {i}") for i in range(6)], "doc_id long, text string")
    got = {r["id"]: r["n_removed"] for r in sd.remove_repeats(docs, ws=ws).collect()}
    assert got[0] == 0 and all(got[i] >= len(text) for i in range(1, 6))
    assert {p.name for p in (tmp_path / "freed").iterdir() if p.is_dir()} == {"marks"}
