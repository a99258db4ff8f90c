"""The pipeline's stages against brute force, each on the rows its predecessor kept."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import SF, brute_classes, brute_groups, check_packing, n_words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = docs.collect()
        after = {r.doc_id for r in kept[name]}
        if name == "language":
            assert after == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        if name == "exact":
            assert sorted(r.doc_id for r in kept[name]) == sorted({k for _, k, _ in brute_groups(list(before.items())).values()})
        if name == "near":
            assert after == set(brute_classes(list(before.items())).values())
    words = Counter()
    for r in kept["mix"]:
        words[r.doc_id] += n_words(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(packed, dict(words), 2048)


def test_stages_on_hard_rows(spark):
    """Null and shared ids, null and empty and very long texts, repeated rows, clashing names: no stage fails or loses a row it keeps."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _size int, _key string, _row int, lang_pred string"
    line = lambda n: " ".join(f"word{i * 7919 % 1000}" for i in range(n))
    texts = [(None, line(300)), (None, line(310)), (1, line(50)), (1, "another text altogether with some words in it"), (2, None), (3, ""), (4, "  "), (5, "x" * 100_000), (6, line(20_000)), (7, "12 34"), (8, "same text"), (8, "same text"), (9, "same  text")]
    rows = [(i, t, ["en", None][n % 2], ["a", "b", None][n % 3], len(t or ""), 0.5, n, "k", n, "xx") for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.where("false")):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, None)
            if name != "pack":
                assert left.columns == docs.columns, name
            got = left.collect()
            if name == "language" and table is docs:
                assert Counter(r.text for r in got) == Counter(t for _, t in texts if any(c.isalpha() for c in t or ""))
            if name == "exact" and table is docs:
                assert len(got) == 7 and {r.doc_id for r in got if "same" in r.text} == {9}
            if name == "near" and table is docs:
                assert sum(r.doc_id is None for r in got) == 2 and len(got) == 7
            if table is not docs:
                assert not got
