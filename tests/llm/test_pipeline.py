"""Each stage of the pipeline against brute force on its own input, and the
whole of it, on a small corpus with odd rows."""

import numpy as np
from test_cases import brute_contamination, brute_join, brute_lines
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import language_id
from chronoloom.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrst"), int(k))) for k in rng.integers(3, 9, 400)]
    line = lambda n: " ".join(rng.choice(words, n))
    passage = line(30)
    rows = [(i, "\n".join(line(int(rng.integers(8, 14))) for _ in range(4)), "en", f"s{i % 3}") for i in range(14)]
    base = line(60)
    rows += [(20 + i, f"{base} {line(3)}", "en", "s0") for i in range(3)]  # near copies in one long line
    rows += [(30, f"{line(9)}\n{passage}", "en", "s1"), (31, rows[0][1].split("\n")[0] + "\n" + line(12), "en", None)]
    rows += [(40, None, "en", "s0"), (41, "", None, "s1"), (42, "1234 ??", "en", "s2"), (None, line(11), "en", "s2")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows], [(7, passage), (8, None), (9, line(40))]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_and_the_whole(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    for name, stage in list(stages.items())[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language ID":
            model = language_id.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
            x = language_id.unit_vectors(np.stack([language_id.gram_counts(t or "") for t in before.values()]), model.idf) @ model.centroids.T
            want = {i: t for (i, t), best in zip(before.items(), x.max(1), strict=True) if language_id.has_letter(t) and best >= model.reject_below}
            assert not {40, 41, 42} & set(want) and len(want) > 15
        elif name == "line dedup":
            cleaned = brute_lines(list(before.items()), bits=63)
            want = {i: t for i, t in cleaned.items() if t == before[i] or any(map(str.isalnum, t))}
            assert want != before
        elif name == "n-gram Jaccard join":
            want = {i: before[i] for i, _, c in brute_join(list(before.items())) if i == c or i is None}
        else:
            found = brute_contamination(list(before.values()), items)
            want = {i: t for (i, t), f in zip(before.items(), found, strict=True) if not f[-1]}
            assert 30 not in want and len(want) == len(before) - 1
        assert got == want, name
        docs = spark.createDataFrame(out.collect(), SCHEMA)
    assert rows_of(stages["mixing sources"](spark, docs, str(tmp_path))) == rows_of(corpus_pipeline.run(spark, str(tmp_path)))


def test_near_copies_that_stand_in_different_lines(spark):
    """The join keeps the smallest id of a group, and rows without an id."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "en", "a", 1), (1, f"{text} tail", "en", "a", 1), (None, text, "en", "a", 1), (4, "other words here", "en", "a", 1), (4, "other words here", "en", "a", 1)]
    got = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 4, None]


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
