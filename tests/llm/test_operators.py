"""Each operator on a table of odd rows, on an empty one, and against brute force."""

import array
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, ship_package

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, kept int, __slot int, id string, sha string, block int"


def words(rng, n):
    return " ".join(rng.choice(["tanor", "Thele", "ing", "of", "the", "oblan,", "risti", "weran.", "ço", "été"]) + rng.choice(["", "a", "be", "so"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.choice([3, 40, 120, 300])) for _ in range(40)]
    long = words(rng, 6000)
    near = base[5].split(" ")
    near[len(near) // 2] = "changed"
    texts = [*base, base[2], base[2].replace(" ", " \t\n", 3), " ".join(near), long, long + " more", None, "", "   ", "a", "a b c", "A b C", "aaaa" * 200, "xyz " * 300, base[7] + " " + base[9], base[9][:150]]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", None, "clash", i, i, "clash", "clash", i) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """With null ids and repeated rows."""
    ship_package(spark)
    extra = [(None, "some text", *rows[0][2:]), (None, None, *rows[0][2:]), rows[1], rows[1]]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_exact(docs, odd, none, rows):
    from tidemark.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")].append(r[0])
    want = {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    got = {k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in by_id(exact_dedup(docs)).items()}
    assert got == want
    out = exact_dedup(odd, digest_all=True).collect()
    assert len(out) == odd.count() and all(r["sha256"] for r in out)
    assert [r["kept"] for r in out if r["id"] == 1] == [True] * 3
    assert exact_dedup(none).count() == 0


def test_near(docs, odd, none, rows):
    from tidemark.llm.near_dedup import near_dedup

    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in by_id(near_dedup(docs)).items()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    out = near_dedup(odd).collect()
    assert len(out) == odd.count() and all(r["component_id"] is None and r["kept"] for r in out if r["id"] is None)
    assert near_dedup(none).count() == 0


def test_near_blocks_join_what_hubs_miss(spark):
    """A chain of changes: neighbours are similar, ends are not; all are one component, also in blocks of two."""
    from tidemark.llm import near_dedup as nd

    ship_package(spark)
    w = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(12):
        w[5 * i % 60] = f"v{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["component_id"] for r in nd.near_dedup(df).collect()} == {0}


def test_bounds():
    from tidemark.llm.near_dedup import least_matches

    assert [least_matches(n, 75, 1e-5) for n in (32, 128)] == sorted(least_matches(n, 75, 1e-5) for n in (32, 128))
    assert least_matches(128, 75, 1e-5) < 96 and least_matches(128, 75, 0.5) >= 90


def test_repeats(docs, odd, none, rows):
    from tidemark.llm.suffix_dedup import remove_repeats

    seen, want = set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = bytes(x for x, h in zip(b, hit) if not h)
    got = by_id(remove_repeats(docs))
    assert {k: r["kept"] for k, r in got.items()} == {k: bytearray(v) for k, v in want.items()}
    assert all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) and len(r["starts"]) == r["n_spans"] for r in got.values())
    assert remove_repeats(odd).count() == odd.count() and remove_repeats(none).count() == 0


def test_repeats_of_a_heavy_name(spark, monkeypatch):
    """Window by window, the same result as run by run."""
    from tidemark.llm import suffix_dedup as sd

    ship_package(spark)
    rng = random.Random(1)
    shared = words(rng, 40)
    df = spark.createDataFrame([(i, words(rng, 9) + shared + words(rng, 9)) for i in range(30)], "doc_id bigint, text string")
    plain = {r["id"]: (r["n_removed"], r["n_spans"]) for r in sd.remove_repeats(df).collect()}
    monkeypatch.setattr(sd, "HEAVY", 3)
    assert {r["id"]: (r["n_removed"], r["n_spans"]) for r in sd.remove_repeats(df).collect()} == plain


def test_packing(docs, odd, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.packing import pack, packed_sequences, token_pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    pieces = Workspace(docs.sparkSession, "t").save(token_pieces(docs, path, 256, with_ids=True), "p")
    placed = pack(pieces.drop("ids"), 256)
    got = defaultdict(list)
    for r in placed.collect():
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(array.array("I", part).tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in got.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 256
    total = sum(map(len, want.values()))
    assert len(got) <= -(-total // 256) + 3  # few, large pieces
    sequences = packed_sequences(pieces, placed, 256).collect()
    assert sum(r["n_ids"] for r in sequences) == total and all(len(r["ids"]) == 4 * r["n_ids"] for r in sequences)
    assert pack(token_pieces(odd, path, 256), 256).count() >= odd.count() and pack(token_pieces(none, path), 2048).count() == 0


def test_local_search_empties_bins():
    from tidemark.llm.packing import best_fit, local_search

    # one for one: 3 against the 2 beside 7, whose bin is then full; the 2 moves to the 6 and 2
    good = local_search(np.array([6, 2, 7, 2, 3]), np.array([0, 0, 1, 1, 2]), 10)
    assert good.max() + 1 == 2
    # two for one: 4 against 1 and 2 beside 6, then 1 and 2 move
    good = local_search(np.array([6, 1, 2, 7, 4]), np.array([0, 0, 0, 1, 2]), 10)
    assert good.max() + 1 == 2 and np.bincount(good, [6, 1, 2, 7, 4]).tolist() == [10, 10]
    rng = np.random.default_rng(0)
    many = rng.integers(300, 1700, 3000)
    first = best_fit(many, 2048)
    after = local_search(many, first, 2048)
    assert np.bincount(after, many).max() <= 2048 and after.max() <= first.max() and len(after) == len(many)


def test_quality(spark, docs, odd, none):
    from tidemark.llm.quality import features, kth_largest, quality_selection

    rng = random.Random(8)
    good = [(i, words(rng, 60)) for i in range(150)]
    bad = [(1000 + i, " ".join(f"{w}&&&" for w in words(rng, 60).split())) for i in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in bad[::2]] + [(None, 1, None), (5, None, None)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality_selection(df, labels))
    assert sum(got[i]["kept"] for i, _ in good) >= 147 and sum(got[i]["kept"] for i, _ in bad) <= 1
    raw, target = Counter(), Counter()
    clean = {i for i, _ in good[::2]}
    for i, t in good + bad:
        f = features(t).tolist()
        raw.update(f)
        target.update(f if i in clean else [])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    for i, text in (good + bad)[::20]:
        want = sum(math.log((target[b] + 1000 * raw[b] / n_raw) / (n_target + 1000) / (raw[b] / n_raw)) for b in features(text).tolist())
        assert abs(got[i]["log_ratio"] - want) < 1e-6
    keys = sorted((x["sample_key"] for x in got.values()), reverse=True)
    k = sum(x["kept"] for x in got.values())
    assert {x["id"] for x in got.values() if x["kept"]} == {x["id"] for x in got.values() if x["sample_key"] >= keys[k - 1]}
    empty = labels.limit(0)
    assert all(x["kept"] for x in quality_selection(odd, empty).collect()) and quality_selection(none, labels).count() == 0
    values = spark.createDataFrame([(v,) for v in [5, 5, 9, -3, 9, 100000]], "v bigint")
    assert [kth_largest(values, "v", k, bins=4) for k in (1, 2, 3, 4, 6)] == [100000, 9, 9, 5, -3]


def test_quality_holds_rows_out(spark):
    """Clean rows without a label are kept as those with one are, though few are labelled and words are many."""
    from tidemark.llm.quality import quality_selection

    rng = random.Random(5)
    draw = lambda a: " ".join(f"{a}{int(rng.paretovariate(0.6)) % 3000}" for _ in range(120))
    df = spark.createDataFrame([(i, draw("w")) for i in range(200)] + [(i, draw("junk")) for i in range(1000, 1060)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(1000, 1020)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality_selection(df, labels))
    assert sum(got[i]["kept"] for i in range(30, 200)) >= 162 and sum(got[i]["kept"] for i in range(1020, 1060)) <= 4


def test_warc(spark):
    from tidemark.llm.warc import archive_pages, decode_record, encode_record, members, read_archives, sha1_base32

    ship_package(spark)
    pages = [(1, "http://a/é b%", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (3, "u\r\nX: y", None, "c"), (4, "u", "", "c"), (None, "u", "<p>x</p>", "c"), (7, "u", "é" * 300_000, "c"), (9, "u", "solo", "c"), (9, "u", "solo", "c")]
    ws = Workspace(spark, "warc-test")
    archive_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string, payload string"), ws.path("a"))
    got = read_archives(spark, ws.path("a")).collect()
    assert len(got) == len(pages)
    one = {r["record_key"]: r for r in got}
    assert one[1]["record_type"] == "response" and bytes(one[1]["payload"]) == b"<p>x</p>" and one[1]["url"] == "http://a/é b%"
    assert (one[2]["record_type"], one[2]["refers_to"], one[2]["payload"], one[2]["payload_bytes"], one[2]["url"]) == ("revisit", 1, None, 8, None)
    assert one[3]["url"] == "u\r\nX: y" and (one[4]["record_type"], one[4]["refers_to"]) == ("revisit", 3)
    assert (one[None]["record_type"], one[None]["refers_to"]) == ("revisit", 1) and one[7]["payload_digest"] == sha1_base32(("é" * 300_000).encode())
    assert [r["record_type"] for r in got if r["record_key"] == 9] == ["response", "response"]
    archive_pages(spark.createDataFrame(pages[:2], "page_id bigint, url string, html string, payload string"), ws.path("b"), min_bytes=9)
    assert {r["record_type"] for r in read_archives(spark, ws.path("b")).collect()} == {"response"}
    archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), ws.path("c"))
    assert read_archives(spark, ws.path("c")).count() == 0
    record = encode_record(5, "response", None, "u", b"abc", 3, sha1_base32(b"abc"), "2024-01-01T00:00:00Z")
    data = b"".join((lambda d: d.compress(x) + d.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)) for x in (record, record))
    assert list(members(data[i : i + 7] for i in range(0, len(data), 7))) == [record, record]
    with pytest.raises(ValueError, match="digest"):
        decode_record(record.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"))
    with pytest.raises(ValueError, match="ends inside"):
        list(members(iter([data[:-9]])))


def test_topk(spark):
    from tidemark.llm.maxscore import topk_inner_product

    ship_package(spark)
    rng = np.random.default_rng(2)
    vecs = {i: rng.normal(size=8).round(1).tolist() for i in range(230)}
    rows = [(i, v) for i, v in vecs.items()] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (400, [0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vecs[400] = [0.5] + [0.0] * 7
    q = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vecs.items()}
    want = {(i, r + 1): (j, -s) for i in q if i % 100 == 0 for r, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:10])}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_inner_product(df, F.col("vec_id") % 100 == 0, shard_rows=40, block_rows=2).collect()}
    assert got == want
    assert topk_inner_product(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_mixing(docs, odd, none):
    from tidemark.llm.mixing import mix, poisson, source_rates

    rates = {r["mix_group"]: r["rate"] for r in source_rates(docs).collect()}
    assert set(rates) == {"", "src0", "src1", "src2"} and all(x > 0 for x in rates.values())
    out = mix(odd, source_rates(odd))
    assert set(odd.columns) <= set(out.columns)
    keys = [r["mix_key"] for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)
    assert mix(none, source_rates(none)).count() == 0
    spark = docs.sparkSession
    many = spark.range(20_000).select(poisson(F.lit(2.5), (F.col("id") + 0.5) / 20_000).alias("n")).groupBy("n").count().collect()
    for r in many:
        assert abs(r["count"] / 20_000 - math.exp(-2.5) * 2.5 ** r["n"] / math.factorial(r["n"])) < 2e-4
    big = spark.createDataFrame([("s", 1200.0)], "mix_group string, rate double")
    one = spark.createDataFrame([(i, "s") for i in range(20)], "doc_id bigint, source string")
    n = mix(one, big).count() / 20
    assert abs(n - 1200) < 40


CASES = {
    "email": ("bosbt.42@mail8.example.com", r"[a-z]{5}\.\d\d@mail8\.example\.com"), "card": ("4539 1488 0343 6467", r"4\d{3} \d{4} \d{4} \d{4}"), "ip": ("42.144.35.254", r"\d+\.\d+\.\d+\.\d+"),
    "phone": ("+1 (988) 555-2485", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}"), "ssn": ("123-45-6789", r"\d{3}-\d\d-\d{4}"), "date": ("1987-02-28", r"\d{4}-\d\d-\d\d"), "iban": ("GB82 WEST 1234 5698 7654 32", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"),
}


def test_pii(odd, none, spark):
    from tidemark.llm.pii import luhn, permute, pseudonymise, replace

    key = b"k"
    for kind, (value, shape) in CASES.items():
        text = f"so {value} is"
        new, found = replace(text, key)
        assert found == {kind: 1} and new != text and re.fullmatch(f"so {shape} is", new), (kind, new)
        assert replace(new, key, inverse=True)[0] == text and replace(text, b"other")[0] != new
    card = re.sub(r"\D", "", replace("4539 1488 0343 6467", key)[0])
    assert luhn(card[:-1]) == card[-1] and re.sub(r"\D", "", replace("4539148803436467", key)[0]) == card
    for same in ("4539 1488 0343 6468", "999.1.1.1", "2023-02-30", "000-12-3456", "no values", "GB83 WEST 1234 5698 7654 32"):
        assert replace(same, key)[0] == same
    secret = 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'
    assert replace(secret, key)[1] == {"secret": 1} and re.fullmatch(r'token = "[0-9a-f]{40}"', replace(secret, key)[0])
    for size in (1, 2, 7, 1000, 73_049):
        values = range(min(size, 500)) if size > 1000 else range(size)
        images = [permute(v, size, key, "t") for v in values]
        assert len(set(images)) == len(images) and all(permute(x, size, key, "t", True) == v for v, x in zip(values, images)) and max(images) < size
    out = pseudonymise(odd, "k").collect()
    assert len(out) == odd.count() and sum(r["text"] is None for r in out) == 2
    assert pseudonymise(none, "k").count() == 0


def test_language_model(docs, odd, none, rows):
    from tidemark.llm.hpylm import score_texts

    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    got = by_id(score_texts(docs))
    for i, t in tokens.items():
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9 and r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    again = by_id(score_texts(docs))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-9 for i in got)
    out = score_texts(odd).collect()
    assert len(out) == odd.count() and len({round(r["score"], 6) for r in out if r["id"] == 1}) == 1
    assert score_texts(none).count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    texts = [words(rng, 80) for _ in range(60)] + [" ".join(f"{w}***" for w in words(rng, 80).split()) for _ in range(12)]
    texts += [texts[3], texts[4].replace(" ", "  "), texts[5] + " tail"]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 72, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = Workspace(spark, "pt").save(out, name)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert len(seen[0] & set(range(60))) >= 40, seen[0]  # 30 short target texts tell little about other clean ones
    assert len(seen[0] & set(range(60, 72))) <= 1, seen[0]
    assert len(seen[1] & {3, 72}) <= 1 and len(seen[1] & {4, 73}) <= 1 and len(seen[2] & {5, 74}) <= 1 and seen[3] <= seen[2]
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} <= seen[2]


def test_sha_of_whole_texts(docs, rows):
    from tidemark.llm.exact_dedup import exact_dedup

    for k, r in by_id(exact_dedup(docs, digest_all=True)).items():
        assert r["sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", rows[k][1] or "").encode()).hexdigest()
