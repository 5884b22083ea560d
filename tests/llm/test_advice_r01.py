"""Cases that the review of the first round found left out."""

import random
import re


def test_pii_of_any_area_code_case_and_neighbour():
    from tidemark.llm.pii import replace

    key = b"k"
    for kind, text, shape in (
        ("phone", "call +1 (017) 555-7713 now", r"call \+1 \([01]\d\d\) [2-9]\d\d-\d{4} now"),
        ("phone", "call 155-555-7713", r"call [01]\d\d-[2-9]\d\d-\d{4}"),
        ("secret", 'TOKEN = "1BEB58B8AF68854F0E01B4AD40CDBB6AE7F578AE"', r'TOKEN = "[0-9A-F]{40}"'),
        ("secret", 'Token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"', r'Token = "[0-9a-f]{40}"'),
        ("secret", "API_KEY: 1Beb58b8Af68", r"API_KEY: [0-9a-fA-F]{12}"),
        ("card", "4111 1111 1111 1111 123", r"4\d{3}( \d{4}){3} 123"),
        ("card", "12 4111 1111 1111 1111", r"12 4\d{3}( \d{4}){3}"),
        ("card", "123456 4111 1111 1111 1111", r"123456 4\d{3}( \d{4}){3}"),
        ("iban", "ES91 2100 0418 4502 0005 1332 PAID", r"ES\d\d( \d{4}){5} PAID|ES\d\d( [A-Z0-9]{4}){5} PAID"),
        ("iban", "AB12 GB82 WEST 1234 5698 7654 32", r"AB12 GB\d\d [A-Z]{4}( \d{4}){3} \d\d"),
    ):
        new, found = replace(text, key)
        assert found == {kind: 1} and new != text and re.fullmatch(shape, new), (text, new, found)
    for text in ("+1 (017) 555-7713", 'TOKEN = "1BEB58B8AF68854F0E01"', "token=1Beb58b8Af68"):
        assert replace(replace(text, key)[0], key, inverse=True)[0] == text
    new, found = replace("4111 1111 1111 1111 4539 1488 0343 6467", key)
    assert found == {"card": 2} and "1111 1111" not in new and "1488" not in new


def test_packing_of_decomposed_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.packing import ChunkIds

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for text in ("a cafe\u0301 here", "cafe\u0301", "n\u0303, o\u0308.", "nai\u0308ve re\u0301sume\u0301", "word, word; (word)", "a=\u0338 b"):
        got = ChunkIds(path).encode([text])[0]
        assert got == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids), text


def test_pipeline_loses_no_clean_text_and_no_group(spark, tmp_path):
    """What quality labels tell apart is told apart for all rows, and one of each group of copies stays."""
    import corpus_pipeline as cp

    from tidemark.llm.common import Workspace

    rng = random.Random(12)
    words = lambda n, tail="": " ".join(rng.choice(["tanor", "thele", "ing", "of", "the", "oblan", "risti", "weran"]) + rng.choice(["", "a", "be", "so"]) + tail for _ in range(n))
    texts = [words(80) for _ in range(150)] + [words(80, "***") for _ in range(30)]
    texts += [texts[3], texts[4].replace(" ", "  "), texts[5] + " tail"]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 180, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:3]:
        docs = Workspace(spark, "ps").save(stage(spark, docs, str(tmp_path)), name)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(150))
    assert seen[0] == clean | {180, 181, 182}
    assert seen[1] == clean | {182} and seen[2] == clean
