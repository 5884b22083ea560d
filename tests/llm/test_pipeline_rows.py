"""The pipeline stage by stage against brute force, on distinct ids and on ids that repeat or are null."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tidemark.llm.common import Workspace, ship_package
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.quality import quality_selection

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def passage(rng, n, tail=""):
    return " ".join(rng.choice(["tanor", "thele", "ing", "of", "the", "oblan", "risti", "weran"]) + rng.choice(["", "a", "be", "so"]) + tail for _ in range(n))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def exact_kept(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or ""), (r[0]))
    return Counter((i, t) for t, i in first.items())


def near_kept(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets, parent = [shingles(rows[k][1]) for k in order], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(order)):
        for b in range(a + 1, len(order)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [rows[k] for i, k in enumerate(order) if find(i) == i]


@pytest.mark.parametrize("odd", [False, True])
def test_stages(spark, tmp_path, odd):
    ship_package(spark)
    rng = random.Random(12 + odd)
    texts = [passage(rng, 80) for _ in range(150)] + [passage(rng, 80, "***") for _ in range(30)]
    rows = list(enumerate(texts))
    rows += [(180, texts[3]), (181, texts[4].replace(" ", " \t")), (182, texts[5] + " tail"), (183, texts[5] + " end"), (184, None), (185, "")]
    if odd:
        rows += [(7, texts[160]), (7, passage(rng, 80)), (9, texts[9]), (9, texts[9]), (9, texts[9] + " more"), (None, texts[11]), (None, passage(rng, 80)), (None, texts[170]), (None, None)]
    spark.createDataFrame([(i, t, "en", f"s{n % 2}", 1) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 180, 2)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, ws = spark.read.parquet(f"{tmp_path}/documents.parquet"), Workspace(spark, "stages")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = ws.save(out, name)
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    bad = {t for _, t in rows[150:180]}
    assert Counter(seen[0]) == Counter(r for r in rows if r[1] not in bad)  # each row by its own text, whatever shares its id
    norm = lambda c: Counter({(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")): n for (i, t), n in c.items()})
    assert norm(Counter(seen[1])) == exact_kept(seen[0])
    assert Counter(seen[2]) == Counter(near_kept(seen[1]))
    assert set(seen[3]) <= set(seen[2]) and len(seen[3]) > len(seen[2]) / 2
    placed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    want = pack(token_pieces(docs, cp.public_tokenizers.path(cp.TOKENIZER), cp.SEQUENCE), cp.SEQUENCE).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"])
    assert sorted(map(key, placed)) == sorted(map(key, want)) and sum(r["length"] for r in placed) == sum(r["length"] for r in want)
    run = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in run if r["piece"] == 0) == Counter(i for i, _ in seen[3])
    if not odd:
        judged = {r["id"]: r["kept"] for r in quality_selection(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).collect()}
        assert {i for i, k in judged.items() if k} == {i for i, _ in seen[0]}


def test_columns_that_clash_and_tables_of_nothing(spark, tmp_path):
    ship_package(spark)
    rng = random.Random(4)
    names = ("key_tag", "key_id", "row_id", "pipeline_row", "__slot", "__perhaps", "doc", "mix_copy", "mix_group", "kept")
    schema = f"{SCHEMA}, {', '.join(f'{n} string' for n in names)}"
    texts = [passage(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", 1, *(f"{n}{i}" for n in names)) for i, t in enumerate([*texts, texts[3], texts[4] + " end"])]
    rows += [rows[5], (7, texts[0], "en", "s1", 1, *names)]  # an id that repeats: rows are numbered
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for part, held in (("some", rows), ("none", [])):
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{part}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{part}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{part}/documents.parquet")
        ws = Workspace(spark, "clash")
        for name, stage in cp.STAGES[:-1]:
            docs = ws.save(stage(spark, docs, f"{tmp_path}/{part}"), name)
            assert docs.columns == spark.createDataFrame([], schema).columns
            assert {tuple(r) for r in docs.collect()} <= set(held)  # values are as they were
        placed = cp.STAGES[-1][1](spark, docs, f"{tmp_path}/{part}").count()
        assert placed == docs.count() and bool(placed) == bool(held)
