"""Every operator on nulls, empty and very long texts, repeated rows, empty tables, and columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from test_llm import base_counts, byte_repeats, check_packing, jaccard_components, word_repeats

from tessera.llm import _arrays as A
from tessera.llm import langid, near_dedup, packing, pieces, quality, recompression, sharding, suffix_dedup, token_counts, topk

CLASH = [
    "dk", "th", "spans", "copied", "row", "has_letter", "held_out", "__spans", "__id", "__mark_id", "__mark_name", "section_ends", "section", "shard", "slot",
    "names", "x", "y", "n", "first", "regs", "sid", "cid", "rep", "part", "piece", "start", "length", "sequence_id", "offset", "round", "kept", "goes", "rank", "v",
]


def long_text(seed, words=330_000):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(20_000)]
    return " ".join(r.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    """Two texts over a unit's size, the second with a part of the first, and the corner cases."""
    first = long_text(1)
    second = long_text(2, 150_000) + "\n" + first[: len(first) // 3] + "\n" + "wörd " * 40 + "z" * 5000
    assert len(first) > A.UNIT_BYTES > A.SLICE
    short = "a few words that are here twice, in two rows of one and the same document of more than ten words"
    return [(1, first), (2, second), (3, first.upper()), (4, None), (5, ""), (6, " \n\t "), (7, short), (7, short), (None, short), (None, None), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kind = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), *[StructField(c, StringType()) for c in CLASH]])
    return spark.createDataFrame([(i, t, "en", *["x"] * len(CLASH)) for i, t in rows], kind).repartition(3).cache()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts(docs, rows):
    got = token_counts.count_sections(docs, token_counts.default_vocabulary()).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    t = token_counts.Tokenizer(token_counts.default_vocabulary())
    expected = {}
    for i, text in rows:
        expected[i] = expected.get(i, 0) + len(t.spans(text or "")) - 1
    assert {r[0]: r[1] for r in got} == expected
    assert token_counts.count_sections(docs.limit(0), token_counts.default_vocabulary()).count() == 0


def test_pieces(docs, rows):
    some = docs.where("doc_id is null or doc_id <> 3")
    back = pieces.decode_ids(pieces.encode(some, pieces.default_model()), pieces.default_model())
    assert collected(back) == sorted(((i, t or "") for i, t in rows if i != 3), key=str)
    assert pieces.encode(docs.limit(0), pieces.default_model()).count() == 0


def test_language(docs, spark):
    train = spark.createDataFrame([(k, long_text(k, 300), "en" if k % 2 else "xx") for k in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(train.unionByName(docs.select("doc_id", "text", "lang")))
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()}
    assert {i for i, p in got if p == "und"} == {4, 5, 6, None} and len(got) == 9
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema and kept.count() == 6
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs.limit(0), None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Few large texts, null ids, and more languages than the total has room for at the full bound."""
    data = [(None if k % 2 else k, (f"w{k}x " * 40_000)[: 90_000 + k], f"l{k % 16:02}") for k in range(64)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    learnable = {r["lang"] for r in docs.where(~langid.held_out()).collect()}
    sample = langid._sample(docs, 10_000, 1_600_000)
    assert set(sample) == learnable and len(learnable) == 16
    assert all(sum(map(len, v)) == 1_600_000 // 16**2 for v in sample.values())


def test_packing(docs, rows, spark):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    check_packing(packing.pack_documents(docs, path).collect(), rows, 4096, Tokenizer.from_file(path))
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_equal_pieces_spread_over_partitions(spark):
    """Rows that are alike in all columns don't meet in one partition."""
    rows = [(None, 0, 0, 1 + k % 3, 7) for k in range(600)]
    pieces_ = spark.createDataFrame(rows, packing._ROW).repartition(2)
    got = packing.pack(pieces_, 16, 60).collect()
    assert len(got) == 600 and max(r["round"] for r in got) >= 1 and all(r["part_bins"] >= r["part_bound"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= 76  # 1199 tokens need 75


def test_near_duplicates(docs, rows):
    got = [tuple(r) for r in near_dedup.components_of(docs, near_dedup.CONTRACT).collect()]
    small = [(i, t) for i, t in rows if i not in (1, 3)]
    expected = [r if r[1] else (r[0], 0, r[0], True) for r in jaccard_components(small, 3, 85, 100) if r[0] != 2]  # a row without words: linked with nothing
    assert sorted((g for g in got if g[0] not in (1, 2, 3)), key=str) == sorted(expected, key=str)
    assert {(g[0], g[2], g[3]) for g in got if g[0] in (1, 2, 3)} == {(1, 1, True), (3, 1, False), (2, 2, True)}
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 4, 5, 6, 7]
    assert near_dedup.keep_first(docs.limit(0)).count() == 0


def test_repeated_strings(docs, rows):
    some = [(i, t) for i, t in rows if i != 3]
    got = collected(suffix_dedup.remove_repeats(docs.where("doc_id is null or doc_id <> 3")))
    assert got == sorted(byte_repeats(some), key=str)
    cut = suffix_dedup.trim(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0 and suffix_dedup.trim(docs.limit(0)).count() == 0


def test_repeated_passages(docs, rows):
    some = [(i, t) for i, t in rows if i != 3]
    assert collected(recompression.remove_repeats(docs.where("doc_id is null or doc_id <> 3"))) == sorted(word_repeats(some), key=str)


def test_quality(docs, rows):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(docs, None).collect()}
    assert got == {(i, *base_counts(t)[:5]) for i, t in rows}
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns
    empty = docs.limit(0)
    labels = docs.select("doc_id", F.lit(1).alias("quality")).limit(0)
    assert quality.train(docs, labels) is None and quality.train(empty, labels) is None and quality.judge(empty, None).count() == 0


def test_sharding(docs):
    got = sharding.place(docs, "doc_id", sharding.shard_names())
    assert got.count() == docs.count() and set(docs.columns) == set(got.columns)
    by_shard = sharding.place(docs, "shard", sharding.shard_names())
    assert by_shard.select("slot").distinct().count() == 1
    assert sharding.place(docs.limit(0), "doc_id", sharding.shard_names()).count() == 0


def test_topk_extra_columns_and_repeats(spark):
    data = [(k // 2, [float(k % 5), 1.0, None if k == 9 else 0.5], "x") for k in range(40)] + [(None, [1.0], "x"), (99, None, "x"), (98, [], "x")]
    vectors = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>, query_id string"))
    got = topk.search(vectors, vectors.where("vec_id % 5 = 0"), 3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.groupBy("query_id").count().where("count <> 3").count() == 0


def test_pipeline_on_empty_and_clashing_tables(spark, tmp_path):
    import corpus_pipeline

    base = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, has_letter string, __spans string, __id string, row string")
    base.write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    texts = [f"this text of number {k} has some words of its own like w{k} and v{k * k} and is long enough to stay here" for k in range(12)]
    some = spark.createDataFrame([(k, t, "en", "s", len(t), "a", "b", "c", "d") for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, "a", "b", "c", "d"), (None, None, None, None, None, None, None, None, None)], base.schema)
    some.write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/some/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(12))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, f"{tmp_path}/some")
        assert out.columns == some.columns
