"""Line runs, Merkle manifests and ranked search on tables of odd rows, against brute force."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import treap
from tidemark.llm.common import Workspace, ship_package

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, body int, h1 int, n int, name string, i string, terms int, uid int"
CLASH = ("x", 1, 2, 3, "y", "z", 4, 5)
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["tanor", "Thele", "ing", "of", "the", "oblan", "été", "ÉTÉ", "a1", "x"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 9])))
    common = ["This line is in many documents.", "\t THIS LINE is in many documents. \v", "short", "été " * 5 + "été", "exactly twenty chars", "nineteen characters"]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.4 else line() for _ in range(rng.choice([1, 2, 6, 30]))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n\n", common[0], common[0] + "\n" + common[0], "the " * 3000, "no terms", "!!! ...", "\x00\x1f tanor\x85of"]
    out = [(i * 7 - 20, t, None if i % 6 == 0 else "en", [None, "", "a", "b", "é", "a"][i % 6], None if i % 4 == 0 else i, *CLASH) for i, t in enumerate(texts)]
    big = (1 << 53) + 1
    out += [(None, common[0], None, None, 3, *CLASH), (None, None, "en", "a", None, *CLASH), (big, common[1], "en", "a", 2, *CLASH), (out[5][0], common[0] + "\nother", "fr", "a", 1, *CLASH)]
    return out + [out[3], out[3], out[9], (None, common[0], None, None, 3, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


def brute_lines(rows, least=3, chars=20):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    of = lambda i: -(1 << 63) if i is None else i
    held, out = defaultdict(set), Counter()
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held[key(x)].add(of(i))
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least or of(i) == max(held[key(x)])]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("batches", "fan"), [(4, 2), (1, 2), (9, 3)])
def test_lines(docs, rows, batches, fan):
    from tidemark.llm.line_dedup import dedup_lines

    assert Counter(map(tuple, dedup_lines(docs, batches=batches, fan=fan).collect())) == brute_lines(rows)


def test_lines_of_nothing(none, docs):
    from tidemark.llm.line_dedup import dedup_lines

    assert dedup_lines(none).count() == 0
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_runs_settle_and_compact(spark):
    from tidemark.llm.line_dedup import LineRuns

    runs = LineRuns(Workspace(spark, "runs"), min_docs=3, buckets=3, fan=2)
    batch = lambda keys, ids: spark.createDataFrame([(k, -k, i) for k in keys for i in ids], "h1 bigint, h2 bigint, id bigint")
    runs.add(batch(range(40), [90, 91, 92]))
    runs.add(batch(range(20, 60), [80, 81]))  # 20 to 39 are settled: they lose nothing by not being written again
    assert [len(level) for level in runs.levels] == [0, 1]
    settled = {r["h1"]: (r["n"], r["last"]) for r in runs.runs[0].collect()}
    assert settled[30] == (3, 92) and settled[50] == (2, 81)
    runs.add(batch([50, 30, 70], [100, 100]))  # an id above what a run knows is no longer settled
    got = {r["h1"]: r["last"] for r in runs.repeated().collect()}
    assert got == {k: 92 for k in range(40)} | {30: 100, 50: 100}
    merged = runs.repeated()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged  # runs are merged where they are
    runs.forget()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows):
    leaf = lambda r, t: h(*(encoded(x) for x in (r[0], r[3], r[2], r[4], t)))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)

    def tree(leaves):
        ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for k, j in enumerate(at):
                run = level[j - j % 3 : j - j % 3 + 3]
                ways[k].append((run[: j % 3], run[j % 3 + 1 :]))
            level = [h(*level[j : j + 3]) for j in range(0, len(level), 3)]
            at = [j // 3 for j in at]
        return level[0], ways

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r[1]) for r in sorted(groups[s], key=order)]) for s in names}
    root, crown = tree([trees[s][0] for s in names])
    out = Counter()
    for s, above in zip(names, crown, strict=True):
        for r, way in zip(sorted(groups[s], key=order), trees[s][1], strict=True):
            steps = way + above
            text = r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf(r, text)
            for left, right in steps:
                node = h(*left, node, *right)
            out[(r[0], leaf(r, r[1]), trees[s][0], root, h(*(x for left, right in steps for x in left + right)), node, node == root)] += 1
    return out


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(docs, rows, height):
    from tidemark.llm.merkle import leaf_digest, manifest

    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = lambda t: leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), t)
    out = manifest(docs, "source", "doc_id", fields(F.col("text")), fields(found), height=height)
    assert Counter(tuple(r)[:5] + tuple(r)[6:] for r in out.collect()) == brute_manifest(rows)


def test_manifest_of_little(spark, none, rows):
    from tidemark.llm.merkle import leaf_digest, manifest

    leaf = leaf_digest(F.col("doc_id"), F.col("text"))
    assert manifest(none, "source", "doc_id", leaf, leaf).count() == 0
    one = manifest(spark.createDataFrame(rows[:1], SCHEMA), "source", "doc_id", leaf, leaf).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof"] == h("")
    lone = manifest(spark.createDataFrame(rows[:3], SCHEMA), "source", "doc_id", leaf, leaf, height=1).collect()
    assert len({r["root"] for r in lone}) == 1 and all(r["verified"] and r["leaf"] == r["subroot"] for r in lone)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_ranks(docs, items, k=20):
    terms = lambda t: Counter(TERM.findall((t or "").translate(LOW)))
    held = [(i, terms(t)) for i, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in held), sum(1 for _, c in held if c)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, total)
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(q * weight(t) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in terms(text).items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out.update((item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k]))
    return out


@pytest.fixture(scope="module")
def items(spark):
    ship_package(spark)
    rows = [(1, "the TANOR of the"), (2, "été ÉTÉ"), (3, None), (4, ""), (5, "unheard of"), (None, "a1 x oblan"), (7, "..."), (5, "unheard of"), (9, "this line is in many documents short twenty " * 3)]
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id bigint, text string, item int, score int"), rows


@pytest.mark.parametrize(("shard", "wanted", "k"), [(None, 1000, 20), (9, 1000, 3), (16, 2, 20)])
def test_ranks(docs, rows, items, shard, wanted, k):
    out = treap.ranked_search(docs, items[0], k=k, shard_docs=shard, block_items=4, most_wanted=wanted)
    assert Counter(map(tuple, out.collect())) == brute_ranks([r[:2] for r in rows], items[1], k)


def test_ranks_of_nothing(docs, none, items):
    assert treap.ranked_search(none, items[0]).count() == 0
    assert treap.ranked_search(docs, items[0].limit(0)).count() == 0


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    for _ in range(20):
        docs, terms = int(rng.integers(1, 700)), int(rng.integers(1, 60))
        grid = rng.integers(1, 1000, (terms, docs)) * (rng.random((terms, docs)) < rng.choice([0.02, 0.3]))
        row, col = np.nonzero(grid)
        if not len(row):
            continue
        depth = max(int(terms - 1).bit_length(), int(docs - 1).bit_length(), 1)
        tree = treap.Treap.from_columns(*treap.Treap.build(row, col, grid[row, col], depth).to_columns()).opened()
        rows = rng.choice(terms, min(terms, 7), replace=False)
        weight, ids = rng.integers(1, 5, len(rows)), rng.permutation(docs)
        score = weight @ grid[rows]
        want = sorted((-s, i, c) for c, (s, i) in enumerate(zip(score.tolist(), ids.tolist())) if s > 0)[:5]
        for width in (1, 6, 192):
            cols, scores = treap.search(tree, rows, weight, ids, 5, 1, width)
            assert [(-s, ids[c], c) for c, s in zip(cols.tolist(), scores.tolist())] == want
