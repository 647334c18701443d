"""The training-data operators against brute force, exact round trips and held-out accuracy, with their defined corner cases."""

import collections
import hashlib
import json
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, langid, near_dedup, packing, pieces, quality, recompression, sharding, suffix_dedup, token_counts, topk
from tessera.llm import _arrays as A
from tessera.llm import _exchange, _store

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, dk string, names string, n string"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def frame(spark, rows):
    """Documents with columns whose names clash with internal ones, nulls, and over several partitions."""
    return spark.createDataFrame([(i, t, l, "s", None if t is None else len(t), "x", None, "n") for i, t, l in rows], DOCS).repartition(3)


def plain(spark, rows):
    return frame(spark, [(i, t, None) for i, t in rows])


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def noisy_rows(seed=3, n=70):
    """Random texts, passages of one base, runs, periods, copies; null and repeated rows."""
    r = random.Random(seed)
    words = "a b c d é".split()
    base = [r.choice(words) for _ in range(500)]
    rows = []
    for i in range(n):
        k, at = r.randrange(6), r.randrange(300)
        some = [r.choice(words) for _ in range(r.randrange(30))]
        t = {
            0: lambda: " ".join(r.choice(words) for _ in range(r.randrange(200))),
            1: lambda: " ".join(some + base[at : at + r.randrange(30, 90)] + some[::-1]),
            2: lambda: "\n ".join((["x"] * r.randrange(1, 5) + ["y"]) * r.randrange(5, 20)),
            3: lambda: "-" * r.randrange(30, 150) if r.random() < 0.5 else " ".join(["z"] * r.randrange(30, 80)),
            4: lambda: " ".join(words[: r.randrange(1, 5)] * r.randrange(10, 30)),
            5: lambda: rows[r.randrange(len(rows))][1] if rows else "",
        }[k]()
        rows.append((i, t))
    r.shuffle(rows)
    return rows + [(100, None), (None, "q " * 50), (101, ""), (102, " \n\t "), (None, " ".join(base)), (5, " ".join(base[100:300])), rows[0]]


# arrays


def test_words_and_names_match_python():
    texts = ["a  b\tc", "", None, "é x y", " lead", "trail ", "\x0b\x0c", "one"]
    x, off = A.text_bytes(pa.array(texts))
    s, e, d = A.word_spans(x, off)
    got = collections.defaultdict(list)
    for a, b, k in zip(s, e, d):
        got[int(k)].append(bytes(x[a:b]).decode())
    assert [got[i] for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]
    names = A.word_names(x, s, e)
    by = {bytes(x[a:b]): n for a, b, n in zip(s, e, names)}
    assert len(set(by.values())) == len(by)
    old, A.SLICE = A.SLICE, 3
    try:
        assert (A.word_names(x, s, e) == names).all()
    finally:
        A.SLICE = old


def test_units_keep_all_rows_in_order():
    batch = pa.record_batch([pa.array([str(i) * (i % 7) for i in range(50)])], ["text"])
    out = [t for u in A.units(iter([batch.slice(0, 20), batch.slice(20)]), limit=9) for t in u["text"].to_pylist()]
    assert out == batch.column(0).to_pylist()
    long = pa.record_batch([pa.array(["x" * 100, "y", "z" * 100])], ["text"])
    assert [u.num_rows for u in A.units(iter([long]), limit=10)] == [1, 1, 1]


def test_window_names_and_argmin():
    r = np.random.default_rng(1)
    h = r.integers(0, 3, 200).astype(np.uint64)
    for k in (1, 2, 3, 5, 35):
        w = A.window_names(h, k)
        seen = {}
        for i in range(len(w)):
            assert seen.setdefault(tuple(h[i : i + k]), w[i]) == w[i]
        assert len(set(seen.values())) == len(seen)
        assert A.sliding_argmin(h, k).tolist() == [int(np.argmin(h[i : i + k])) for i in range(len(h) - k + 1)]


# token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_rules_against_brute_force(rule):
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(0, 30)
        cut = lambda k: np.array(sorted([0, n, *(r.randrange(n + 1) for _ in range(k))])) if n else np.zeros(k + 2, int)
        tokens = np.unique(cut(r.randrange(8)))
        sections = cut(r.randrange(5))
        counts, crossing = token_counts.attribute(tokens, sections, rule)
        expect, cross = np.zeros(len(sections) - 1), np.zeros(len(sections) - 1, int)
        for a, b in zip(tokens[:-1], tokens[1:]):
            share = [max(0, min(b, t) - max(a, s)) for s, t in zip(sections[:-1], sections[1:])]
            touched = [i for i, v in enumerate(share) if v]
            for i in touched if len(touched) > 1 else []:
                cross[i] += 1
            if rule == "proportional":
                expect += np.array(share) / sum(share)
            else:
                expect[touched[0] if rule == "first" else share.index(max(share))] += 1
        assert np.allclose(counts, expect) and crossing.tolist() == cross.tolist()


def test_token_counts_sum_to_the_documents(spark):
    rows = [(1, "one two\n\n  three\n"), (2, None), (3, ""), (4, "é☃\n\n\nx"), (4, "é☃\n\n\nx"), (None, "a\nb"), (5, "w" * 5000 + "\n" + "v " * 3000)]
    out = token_counts.count_sections(plain(spark, rows), token_counts.default_vocabulary()).collect()
    tok = token_counts.Tokenizer(token_counts.default_vocabulary())
    for i, t in set(rows):
        own = [r for r in out if r["doc_id"] == i]
        copies = rows.count((i, t))
        assert sum(r["n_tokens"] for r in own) == copies * (len(tok.spans(t)) - 1 if t else 0)
        lines = sorted({(r["start_char"], r["end_char"]) for r in own})
        assert "".join((t or "")[a:b] for a, b in lines) == (t or "")
    assert token_counts.count_sections(plain(spark, rows).limit(0), token_counts.default_vocabulary()).count() == 0
    text, ends = token_counts.join_fields([F.col("text"), F.col("names"), F.col("source")], " | ")
    fields = token_counts.count_sections(plain(spark, rows).withColumns({"e": ends, "section_ends": F.lit("a clash"), "text": text}), token_counts.default_vocabulary(), section_ends="e")
    assert fields.groupBy("doc_id").count().where("doc_id = 1").first()["count"] == 3


# pieces


def test_long_white_space_is_split_by_rule():
    t = token_counts.Tokenizer(token_counts.default_vocabulary())
    r = random.Random(1)
    white = " \t\n\r\xa0  \x1c  "
    for _ in range(400):
        text = "".join(r.choice([r.choice(white) * r.randrange(1, 6), "".join(r.choice(white) for _ in range(4)), "ab", "9", "!?", "'s", "é"]) for _ in range(r.randrange(1, 12)))
        assert t.spans(text).tolist() == t.spans(text, 3).tolist() == t.spans(text, 2).tolist()
    assert len(t.spans(" " * 1_500_000)) > 1 and t.spans(" " * 1_500_000 + "x")[-1] == 1_500_001


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_model())


def best_score(v, scores, word):
    best = [0.0] + [-math.inf] * len(word)
    for i in range(len(word)):
        single = word[i] in scores
        for j in range(i + 1, min(len(word), i + v.longest) + 1):
            if word[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[word[i:j]])
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + v.unknown_score)
    return best[-1]


def test_viterbi_finds_the_best_path_and_round_trips(vocabulary):
    import sentencepiece

    v = vocabulary
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    scores = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    raw = open(pieces.default_model(), "rb").read()
    unigram = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    texts = ["Hello world", "naïve café 日本語", "a" * 40, "☃ \U0001f600 snow\n\n tab\t x", "  two  blanks ", "", "thanonndheaou therblein"]
    memo = pieces.Pieces(v)
    encoded = [np.frombuffer(b, "<u4") for b in pieces.encode_units(memo, pa.table({"text": texts}))]
    for t, ids in zip(texts, encoded):
        assert pieces.decode(v, ids) == t
        assert unigram.decode(ids.tolist()) == t or t.startswith(" ")
    for w in ["▁Hello", "▁thanonndheaou", "▁therblein", "▁naïve", "▁☃x"]:
        ids, off = pieces.viterbi(v, [w])
        got = sum(v.unknown_score if i < 0 else v.scores[i] for i in ids)
        assert math.isclose(got, best_score(v, scores, w))
    for t in ["Hello world", "thanonndheaou therblein", "naïve café"]:  # no piece of score -1e9, which float32 in the library blurs
        assert np.frombuffer(pieces.encode_units(memo, pa.table({"text": [t]}))[0], "<u4").tolist() == unigram.encode(t)


def test_unigram_log_scores():
    """A vocabulary of true log probabilities: the path found is the likeliest segmentation."""
    counts = {"▁": 40, "▁the": 60, "▁th": 5, "he": 8, "e": 30, "t": 25, "h": 20, "a": 22, "at": 12, "hat": 4, "▁that": 9, "c": 10, "cat": 6, "ca": 2, "s": 15, "ts": 3, "▁a": 7}
    total = sum(counts.values())
    scores = {p: math.log(c / total) for p, c in counts.items()}
    ids = {p: i for i, p in enumerate(counts)}
    v = pieces.Vocabulary.make({i: p for p, i in ids.items()}, {ids[p]: s for p, s in scores.items()}, [p.replace("▁", " ").encode() for p in counts], np.full(256, 0, np.int64), 0)

    def likeliest(word):
        found = [(0.0, [])] + [(-math.inf, [])] * len(word)
        for end in range(1, len(word) + 1):
            found[end] = max(((found[a][0] + scores[word[a:end]], found[a][1] + [word[a:end]]) for a in range(end) if word[a:end] in scores), default=(-math.inf, []))
        return found[-1]

    words = ["▁that", "▁the", "▁cats", "▁a", "▁hat", "▁chat", "▁teeth", "▁catscats" * 3]
    got, off = pieces.viterbi(v, words)
    names = list(counts)
    for word, a, b in zip(words, off[:-1], off[1:]):
        score, path = likeliest(word)
        mine = [names[i] for i in got[a:b]]
        assert "".join(mine) == word and math.isclose(sum(scores[p] for p in mine), score)


def test_pieces_operator(spark, vocabulary):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "x y" * 500), (4, "x y" * 500), (None, "☃")]
    enc = pieces.encode(plain(spark, rows), pieces.default_model())
    back = collected(pieces.decode_ids(enc, pieces.default_model()))
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert pieces.encode(plain(spark, rows).limit(0), pieces.default_model()).count() == 0


def test_double_array():
    r = random.Random(1)
    words = sorted({tuple(r.randrange(1, 40) for _ in range(r.randrange(1, 6))) for _ in range(500)})
    base, check, value = pieces.double_array(words)
    for i, w in enumerate(words):
        s = 0
        for c in w:
            assert check[base[s] + c] == s
            s = base[s] + c
        assert value[s] == i
    assert (value >= 0).sum() == len(words)


# top-k


def test_topk_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1, 1]) * r.random() for _ in range(20)], 0) for i in range(300)]
    rows += [(301, None, 0), (302, [1.0, None], 0), (303, [float("nan")] * 20, 0), (304, [float("inf")] * 20, 0), (305, [0.5], 0), (None, [1.0] * 20, 0), rows[7], rows[100]]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    v = topk.quantised(df)
    old, topk.QUERY_BLOCK = topk.QUERY_BLOCK, 2
    try:
        got = collected(topk.search(v, v.where("vec_id % 100 = 0"), 10))
    finally:
        topk.QUERY_BLOCK = old
    q = [(i, [math.floor(np.float32(x).astype(float) * 1024) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    expect = []
    for a, x in {(a, tuple(x)) for a, x in q if a % 100 == 0}:
        best = sorted((-sum(s * t for s, t in zip(x, y)), b) for b, y in q if b != a)[:10]
        expect += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert got == sorted(expect, key=str)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_maxscore_skips_but_keeps_ties():
    r = np.random.default_rng(3)
    x = r.integers(-5, 6, (40, 500)).astype(float)
    query = r.integers(-5, 6, 40).astype(float)
    score = query @ x
    for threshold in (-np.inf, *np.quantile(score, [0.5, 0.9, 1.0])):
        rows, got = topk.competitive(x, x.min(1), x.max(1), query, threshold)
        assert rows.tolist() == np.flatnonzero(score >= threshold).tolist() and (got == score[rows]).all()


# language


def ppm_length(texts, data, order=langid.ORDER):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    fold = lambda b: bytes(order) + bytes(langid.fold(np.frombuffer(b, np.uint8)))
    for t in texts:
        p = fold(t)
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[k][p[i - k : i]][p[i]] += 1
    p, total = fold(data), 0
    for i in range(order, len(p)):
        for k in range(order, -1, -1):
            c = counts[k].get(p[i - k : i])
            if not c:
                continue
            n, u = sum(c.values()), len(c)
            if c[p[i]]:
                total += round(-math.log2(c[p[i]] / (n + u)) * 1024)
                break
            total += round(-math.log2(u / (n + u)) * 1024)
        else:
            total += 8 * 1024
    return total


def test_code_lengths_are_exact():
    samples = {"a": [b"hello world the the", "abc Été".encode()], "b": [b"bonjour le monde", b""], "c": [b"\x00\x00x"]}
    coder = langid.Coder(langid.train(samples))
    docs = [b"hello monde xyz", b"", "Été".encode(), b"zzzz q", b"the", b"\x00\x00\x00x", b"hello world " * 9]
    x, off = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    expect = [[ppm_length(samples[l], d) for l in "abc"] for d in docs]
    assert coder.lengths(x, off).tolist() == expect
    old, A.SLICE = A.SLICE, 7
    try:
        assert coder.lengths(x, off).tolist() == expect
    finally:
        A.SLICE = old


@needs_data
def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_corner_cases(spark):
    rows = [(i, w, l) for i, (w, l) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de")] * 10)]
    rows += [(50, None, "en"), (51, "123 !!", "en"), (52, "", None), (53, "the dog", None), (None, "der hund", None), (53, "the dog", None), (54, "the " * 20000, None), (55, "Жук " * 50, None)]
    docs = frame(spark, rows)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert [got[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and got[50]["score"] == 0
    assert got[53]["lang_pred"] == got[54]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(got) - {50, 51, 52, 55}
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.fit(docs.limit(0)) is None


def test_language_sample_reaches_its_bound(spark):
    outside = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"{i} " + "long " * 4000, f"one{i}") for i in outside[:20]]  # each the only text of its language
    rows += [(i, f"{i} ".ljust(100, "m"), "many") for i in outside] + [(i, f"{i} ".ljust(9000, "l"), "many") for i in outside[:5]]
    rows += [(None, f"{i} ".ljust(1000, "n"), "null") for i in range(30)] + [(outside[0], "same " * 100, "same")] * 40 + [(outside[0], "s", "short"), (outside[0], "", "none")]
    got = langid._sample(frame(spark, rows), 3000)
    sizes = {l: [len(t) for t in texts] for l, texts in got.items()}
    assert set(sizes) == {l for _, _, l in rows} - {"none"} and sizes["short"] == [1]
    for l, s in sizes.items():  # whole texts up to the one that crosses the bound
        assert sum(s) == sum(len(t) for _, t, k in rows if k == l) or sum(s[:-1]) < 3000 <= sum(s), l
    assert len(sizes["null"]) == 3 and sizes["same"] == [500] * 6


# quality


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [l for l in text.split("\n") if WORD.search(l)]
    seen, dup = set(), 0
    for l in lines:
        dup += l in seen
        seen.add(l)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def test_quality_counts_against_brute_force(spark):
    rows = noisy_rows(8) + [(200, "# a | b\n# a | b\n\n \n<x> é"), (201, "w " * 50000), (202, "\n\n\n")]
    out = quality.judge(plain(spark, rows), None).drop("score")
    got = [tuple(r) for r in out.collect()]
    expect = [(i, *base_counts(t), not base_counts(t)[-1]) for i, t in rows]
    assert sorted(got, key=str) == sorted(expect, key=str)
    assert quality.judge(plain(spark, rows).limit(0), None).count() == 0


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(5)
    x = r.random((2000, 3))
    y = ((x[:, 0] < 0.5) ^ (r.random(2000) < 0.05)).astype(float)
    t = quality.fit(x, y, [-1, 0, 1])
    assert ((t.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.9
    for j, sign in ((0, -1), (2, 1)):
        grid = np.repeat(r.random((50, 3)), 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        s = t.score(grid).reshape(50, 40)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    assert quality.fit(x, np.ones(2000), [0] * 3) is None


@needs_data
def test_quality_verdicts(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, trees).join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.95 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)
    kept = quality.keep_good(docs, trees)
    assert kept.columns == docs.columns


# sharding


def test_table_is_filled_in_turns():
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.fill_table(shards, 101)
    # brute force: every turn looks through the whole preference order
    num = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    table, turn = {}, 0
    while len(table) < 101:
        s = shards[turn % 7]
        order = [(num(f"offset:{s}") + j * (num(f"skip:{s}") % 100 + 1)) % 101 for j in range(101)]
        table[next(x for x in order if x not in table)] = turn % 7
        turn += 1
    assert owner == [table[i] for i in range(101)]
    sizes = collections.Counter(owner)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    wide = sharding.fill_table(shards, 10007)
    gone = sharding.fill_table(shards[:-1], 10007)
    assert sum(a != b for a, b in zip(wide, gone) if a != 6) < 0.1 * 10007
    heavy = collections.Counter(sharding.fill_table(["a", "b"], 1009, [3, 1]))
    assert abs(heavy[0] - 3 * heavy[1]) <= 4
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 100)


def test_place_is_native_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c"), (2, None)], "doc_id long, slot string")
    out = sharding.place(df, "doc_id", sharding.shard_names(5), 101)
    rows = out.collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert sharding.place(df.limit(0), "doc_id", ["a"], 101).count() == 0


@needs_data
def test_sql_of_sharding_and_topk(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for f, sql in ((sharding.op8_sharding, sharding.oracle()), (topk.op3_topk, topk.ORACLE)):
        got, want = f(spark, SF).toPandas(), c.sql(sql).df()
        cols = sorted(want.columns)
        order = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
        assert sorted(got.columns) == cols and order(got).equals(order(want))


# packing


def test_bounds_and_best_fit():
    r = np.random.default_rng(7)
    for _ in range(60):
        cap = int(r.integers(5, 40))
        sizes = r.integers(1, cap + 1, int(r.integers(1, 12)))
        bins, offsets, n = packing.best_fit_decreasing(sizes, cap)
        assert all(sizes[bins == b].sum() <= cap for b in range(n))
        for b in range(n):
            own = np.argsort(offsets[bins == b])
            assert (np.cumsum(sizes[bins == b][own]) - sizes[bins == b][own] == offsets[bins == b][own]).all()
        best = _optimal(sorted(sizes.tolist(), reverse=True), cap)
        assert packing.lower_bound(sizes, cap) <= best <= n
    assert packing.lower_bound(np.full(10, 6), 10) == 10
    assert packing.lower_bound(np.zeros(0, int), 10) == 0


def _optimal(sizes, cap):
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for free in {f for f in room if f >= sizes[i]}:
            k = room.index(free)
            go(i + 1, room[:k] + [free - sizes[i]] + room[k + 1 :])
        go(i + 1, [*room, cap - sizes[i]])

    go(0, [])
    return best[0]


def check_packing(rows, texts, capacity, tokenizer):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    ids = collections.Counter()
    for i, t in texts:
        e = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(e), capacity)):
            p = e[a : a + capacity]
            ids[(i, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))] += 1
    assert ids == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    return len(by)


def test_packing_operator(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    r = random.Random(1)
    odd = ["It's 3.14!! don't.. --. (a).", "İstanbul ΣΑΣ á. x y\x1cq", "Ünï, THE the The.", "|| && a|b|", "x" * 300]
    rows = [(i, " ".join(r.choice(["the", "Thing,", "of.", "x1|", "é!"]) for _ in range(r.randrange(400)))) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(odd)] + [(300, None), (301, ""), (None, "null id"), (302, "long " * 9000), rows[3], (303, "a\x1cb\x85c")]
    got = packing.pack_documents(plain(spark, rows), packing.default_vocabulary()).collect()
    n = check_packing(got, rows, packing.CAPACITY, tok)
    assert n == packing.lower_bound(np.array([x["length"] for x in got]), packing.CAPACITY)
    assert packing.pack_documents(plain(spark, rows).limit(0), packing.default_vocabulary()).count() == 0


def test_exchange_rounds_save_bins(spark):
    r = np.random.default_rng(2)
    sizes = r.integers(1, 60, 3000)
    df = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing._ROW)
    got = packing.pack(df, 100, part_pieces=400).collect()
    assert sorted((x["doc_id"], x["length"]) for x in got) == [(i, int(s)) for i, s in enumerate(sizes)]
    fill = collections.Counter()
    for x in got:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 100 and len(fill) <= packing.lower_bound(sizes, 100) + 2


def test_trees_are_fitted_on_one_row_of_a_label(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda x, y, signs: fitted.append((x.tolist(), y.tolist())))
    rows = [(i, f"text {i} of some words", None) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    quality.train(frame(spark, rows + [(3, "another row " * k, None) for k in range(2, 40)] + rows[4:5] * 30), labels, bound=10)
    quality.train(frame(spark, (rows + [(3, "another row " * k, None) for k in range(2, 40)] + rows[4:5] * 9)[::-1]), labels, bound=10)
    assert len(fitted[0][1]) == 10 and fitted[0] == fitted[1]
    quality.train(frame(spark, rows + [(3, "another row " * k, None) for k in range(2, 40)]), labels)
    assert len(fitted[2][1]) == 20 and sum(fitted[2][1]) == 10


# near-duplicates


def jaccard_components(rows, width, num, den):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(2**63 - 1 if i is None else i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and den * len(s & t) >= num * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    null = lambda c: None if c == 2**63 - 1 else c
    return [(null(i), len(s), null(root(i)), root(i) == i) for i, s in sets]


def near_rows(seed=6):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(4, 150))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((i, (" ".join(copy)).upper() if r.random() < 0.2 else "\n".join(copy)))
            i += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "One two"), (None, "one"), (903, "zeta eta"), (907, "zeta eta")]


@pytest.mark.parametrize("rule", [near_dedup.CONTRACT, near_dedup.Rule()])
def test_near_duplicates_against_brute_force(spark, rule):
    rows = near_rows()
    got = [tuple(r) for r in near_dedup.components_of(plain(spark, rows), rule).collect()]
    assert sorted(got, key=str) == sorted(jaccard_components(rows, rule.width, rule.num, rule.den), key=str)


def test_blocks_of_large_buckets_lose_no_link(spark):
    rows = near_rows(11)
    old = near_dedup.BLOCK_SHINGLES, near_dedup.BLOCK_SKETCHES
    near_dedup.BLOCK_SHINGLES, near_dedup.BLOCK_SKETCHES = 300, 3
    try:
        got = [tuple(r) for r in near_dedup.components_of(plain(spark, rows), near_dedup.CONTRACT).collect()]
    finally:
        near_dedup.BLOCK_SHINGLES, near_dedup.BLOCK_SKETCHES = old
    assert sorted(got, key=str) == sorted(jaccard_components(rows, 3, 85, 100), key=str)


def letters(n):
    """Two different words of 2^n letters that every polynomial over 64-bit integers takes for the same."""
    bits = [bin(k).count("1") % 2 for k in range(2**n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_no_decision_rests_on_a_hash(spark, monkeypatch):
    one, other = letters(10)
    data = np.frombuffer((one + " " + other + " " + one).encode(), np.uint8)
    starts, ends, _ = A.word_spans(data, np.array([0, len(data)]))
    assert len(set(A.word_names(data, starts, ends).tolist())) == 2
    filler = [f"w{k}" for k in range(34)]
    rows = [(1, f"x {one} y"), (2, f"x {other} y"), (3, " ".join([*filler[:17], one, *filler[17:]])), (4, " ".join([*filler[:17], other, *filler[17:]])), (5, f"{one} line\n{other} line\n" * 2)]

    def check():
        ids = A.exact_ids(data, starts, ends)
        assert ids[0] == ids[2] != ids[1]
        got = near_dedup.components_of(plain(spark, rows), near_dedup.CONTRACT).collect()
        assert all(r["kept"] for r in got)
        for unit in [pa.table({"text": [t for _, t in rows]})]:
            assert quality.statistics(*A.text_bytes(unit["text"]))["n_dup_lines"].tolist() == [0, 0, 0, 0, 2]

    check()
    assert all(r["n_removed"] == 0 for r in recompression.remove_repeats(plain(spark, rows[:4])).collect())
    assert suffix_dedup.remove_repeats(plain(spark, rows[:2])).where("doc_id = 1").first()["n_removed"] == 0
    # names that collide for all spans of one length
    monkeypatch.setattr(A, "word_names", lambda x, s, e, lane=0: (e - s).astype(np.uint64))
    check()


def test_pairs_at_the_threshold_are_found():
    """Two sets at 0.85: the bands and the estimate together miss few of them (4e-7 and 3e-7 by calculation; none of 20,000 here)."""
    r = np.random.default_rng(4)
    n, missed = 370, 0
    for _ in range(50):
        both = r.integers(0, 2**63, (400, round(2 * n * 0.85 / 1.85)), dtype=np.uint64)
        sides = [np.concatenate([both, r.integers(0, 2**63, (400, n - both.shape[1]), dtype=np.uint64)], 1) for _ in range(2)]
        a, b = (near_dedup.sketch(s.reshape(-1), np.arange(401) * n) for s in sides)
        count, length = near_dedup.bands(near_dedup.CONTRACT)
        assert (count, length) == (25, 5)
        bands = (a == b)[:, : count * length].reshape(400, count, length).all(2).any(1)
        size = np.full(400, float(n))
        missed += int((~bands | (near_dedup.similarity(a, b, size, size) < near_dedup.least_estimate(near_dedup.CONTRACT))).sum())
    assert missed == 0


def test_keep_first_and_empty(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words are in this one"), (3, None), (4, None)]
    docs = plain(spark, rows)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 9]
    assert near_dedup.components_of(docs.limit(0)).count() == 0


def test_keep_first_compares_texts_not_ids(spark):
    clean = [f"w{k} of its own kind and of no other {k}" for k in range(9)]
    copy = "this one is found again under a number and without one"
    rows = [(5, copy), (None, copy), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (7, copy.upper())]
    rows += [(None, clean[4])] * 2 + [(8, clean[5])] * 3 + [(None, clean[6]), (9, clean[6] + "\n"), (None, None), (None, None), (8, " ")]
    docs = plain(spark, rows)
    kept = near_dedup.keep_first(docs)
    expect = [(5, copy), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (None, clean[4]), (8, clean[5]), (9, clean[6] + "\n"), (None, None), (None, None), (8, " ")]
    assert kept.columns == docs.columns and collected(kept.select("doc_id", "text")) == sorted(expect, key=str)


def test_sketches_estimate_and_merge():
    r = np.random.default_rng(8)
    errors = []
    for j in (0.2, 0.5, 0.85, 0.95):
        for n in (40, 600):
            both = r.integers(0, 2**63, round(2 * n * j / (1 + j)), dtype=np.uint64)
            a, b = (np.sort(np.concatenate([both, r.integers(0, 2**63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            u = np.unique(np.concatenate([a, b]))
            regs = near_dedup.sketch(np.concatenate([a, b, u]), np.cumsum([0, len(a), len(b), len(u)]))
            assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
            errors.append(abs(near_dedup.similarity(regs[:1], regs[1:2], np.array([len(a)]), np.array([len(b)]))[0] - len(np.intersect1d(a, b)) / len(u)))
    assert max(errors) < 0.2 and np.mean(errors) < 0.06


def test_small_tables_have_few_files(spark, monkeypatch):
    """Each file costs an executor several processes: tables of few rows don't get one for each shuffle partition."""
    files = {}

    def counted(df, name, *rows):
        out = _store.checkpoint(df, name, *rows)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "checkpoint", counted)
    monkeypatch.setattr(components, "checkpoint", counted)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(200)]
    rows = [(5 * i + k, " ".join([*b[:-1], r.choice(words)] if k else b)) for i, b in enumerate(base) for k in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in near_dedup.components_of(docs, near_dedup.CONTRACT).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(jaccard_components(rows, 3, 85, 100))
    assert {"pairs", "labels", "links", "buckets", "classes", "ids", "first"} <= set(files)
    few = 2 * spark.sparkContext.defaultParallelism
    assert {k: n for k, n in files.items() if n > few and k != "class_texts"} == {}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(25)] + [(500, 500)]
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(links, "x long, y long")).collect())
    parent = {}
    for a, b in links:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def root(a):
        return a if parent[a] == a else root(parent[a])

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {a: root(a) for a in parent if a != 500}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# repeated strings and passages


def byte_repeats(rows, k=50):
    top, low = 2**63 - 1, {}
    data = [(top if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for j in range(len(b) - k + 1):
            s = b[j : j + k]
            low[s] = min(low.get(s, top), i)
    out = []
    for (o, _), (i, b) in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - k + 1):
            if low[b[j : j + k]] < i:
                gone[j : j + k] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((o, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_byte_repeats_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(_exchange, "FAN", 2 if hot == 2 else 2048)
    rows = noisy_rows(4)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = collected(suffix_dedup.remove_repeats(plain(spark, rows)))
    assert got == sorted(byte_repeats(rows), key=str)


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("same", [None, 7])
def test_byte_repeats_of_rows_with_one_id(spark, same, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    p = "a passage that rows of one id share with a document of another unit, in whole. "
    rows = [(same, f"{k} " + p * k) for k in range(1, 4)] + [(same, "2 " + p * 2)]
    parts = [spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in (rows, [(3, "three " + p)])]
    got = collected(suffix_dedup.remove_repeats(parts[0].union(parts[1])))
    assert got == sorted(byte_repeats([*rows, (3, "three " + p)]), key=str)


def test_suffix_buckets():
    r = np.random.default_rng(9)
    x = r.integers(0, 2, 3000).astype(np.uint8)
    for length in (8, 10, 16, 20, 50):
        starts = np.arange(0, 3000 - length + 1)
        ids = suffix_dedup.suffix_buckets(x, starts, length)
        seen = {}
        for s, i in zip(starts, ids):
            assert seen.setdefault(bytes(x[s : s + length]), i) == i
        assert len(set(seen.values())) == len(seen)


def test_named_places_cover_every_string(monkeypatch):
    r = np.random.default_rng(10)
    texts = ["".join(r.choice(list("ab"), n)) for n in (0, 49, 50, 51, 300, 7, 120)]
    x, off = A.text_bytes(pa.array(texts))
    for size in (1 << 20, 64):
        monkeypatch.setattr(A, "SLICE", size)
        name, first, last, doc = suffix_dedup.named_places(x, off)
        covered = sorted(s for a, b in zip(first, last) for s in range(a, b + 1))
        assert covered == [int(o) + j for o, t in zip(off, texts) for j in range(max(0, len(t) - 49))]
        by = {}
        for n, a, b in zip(name, first, last):
            for s in range(a, b + 1):
                assert by.setdefault(bytes(x[s : s + 50]), n) == n


def test_naming_of_places_is_cheap_and_the_same_in_any_slices(monkeypatch):
    """CPU against naming by doubling from single bytes over a whole slice, with a choice of the least beside it."""
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 101, n, np.uint8)).decode() for n in (0, 70_000, 49, 50, 3, 600_000, 51, 400_000)]
    x, off = A.text_bytes(pa.array(texts))

    def doubled():
        h, size = A.BYTES[x], 1
        while size < 32:
            h, size = A.pair_names(h[:-size], h[size:], size), 2 * size
        return A.sliding_argmin(h, 19)

    def seconds(f):
        took = []
        for _ in range(3):
            t = time.thread_time()
            f()
            took.append(time.thread_time() - t)
        return min(took)

    assert seconds(lambda: suffix_dedup.named_places(x, off)) < 0.6 * seconds(doubled)
    spelt = []
    for places in (1 << 15, 1000):
        monkeypatch.setattr(suffix_dedup, "PLACES", places)
        name, first, last, doc = suffix_dedup.named_places(x, off)
        n = last - first + 1
        start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spelt.append((start, np.repeat(name, n), np.repeat(doc, n)))
    assert all((a == b).all() for a, b in zip(*spelt))
    assert len(spelt[0][0]) == sum(max(0, len(t) - 49) for t in texts)


def test_trim_changes_texts(spark):
    p = "this passage is long enough to be found twice in the corpus, surely. "
    docs = plain(spark, [(1, p + "one"), (2, "two " + p), (3, None), (4, p + "one")])
    out = {r["doc_id"]: r for r in suffix_dedup.trim(docs).collect()}
    assert out[1]["text"] == p + "one" and out[2]["text"] == "two " and out[3]["text"] is None and out[4]["text"] == ""
    assert out[2]["n_chars"] == 4 and suffix_dedup.trim(docs).columns == docs.columns
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def word_repeats(rows, k=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed, hot, fan", [(1, 20_000, 2048), (2, 2, 2)])
def test_word_repeats_against_brute_force(spark, seed, hot, fan, monkeypatch):
    monkeypatch.setattr(recompression, "HOT", hot)
    monkeypatch.setattr(_exchange, "FAN", fan)  # fewer: names go to groups of parts first
    rows = noisy_rows(seed)
    assert collected(recompression.remove_repeats(plain(spark, rows))) == sorted(word_repeats(rows), key=str)
    if seed == 1:
        assert recompression.remove_repeats(plain(spark, rows).limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(12)
    for _ in range(300):
        window = r.integers(0, r.integers(2, 12), 35).astype(np.uint64)
        if r.random() < 0.3:
            window[int(r.integers(0, 30)) :][: int(r.integers(1, 9))] = 1
        found = set()
        for _ in range(4):
            before, after = (r.integers(0, 4, int(r.integers(0, 12))).astype(np.uint64) for _ in range(2))
            names = A.mix(np.concatenate([before, window, after]) + np.uint64(1))
            name, place = recompression.anchors(names, np.zeros(len(names), np.int64))
            found.add((int(name[len(before)]), int(place[len(before)]) - len(before)))
        assert len(found) == 1 and next(iter(found))[0] != int(recompression.NONE)


# pipeline


def test_pipeline_stages_on_small_rows(spark, tmp_path):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language ID", "quality rules", "near-duplicates", "repeated strings", "packing"]
    r = random.Random(1)
    vocab = {"en": "the house and dog with for that is of water".split(), "de": "das haus und der hund mit wasser ist von nicht".split()}
    text = lambda l, n: " ".join(r.choice(vocab[l]) + r.choice(["", "er", "ing", "en", "s"]) + r.choice("abcdefgh") for _ in range(n))
    passage = text("en", 60)
    rows = [(i, text(l, r.randrange(60, 120)), l) for i, l in enumerate(["en", "de"] * 20)]
    rows += [(40, rows[0][1], "en"), (41, rows[1][1] + " noch", "de"), (42, text("en", 40) + " " + passage, "en"), (43, text("en", 40) + " " + passage, "en"), (44, "7 " * 30, "en"), (45, "the the " * 40, "en"), (46, None, "en"), (47, "", None)]
    docs = spark.createDataFrame([(i, t, l, "s", None if t is None else len(t)) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 45), 0) for i in range(46)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = [{44, 46, 47}, {45}, {40, 41}, set(), set()]
    for k, (name, stage) in enumerate(c.STAGES[:-1]):
        before = {x["doc_id"]: x["text"] for x in now.collect()}
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/s{k}")
        now = spark.read.parquet(f"{tmp_path}/s{k}")
        after = {x["doc_id"]: x["text"] for x in now.collect()}
        assert set(before) - set(after) == gone[k], name
        if name == "repeated strings":
            kept = {i: h for i, _, _, _, h in byte_repeats(sorted(before.items()))}
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == kept
    final = [tuple(x) for x in c.STAGES[-1][1](spark, now, str(tmp_path)).collect()]
    ran = [tuple(x) for x in c.run(spark, str(tmp_path)).collect()]
    assert sorted(x[:5] for x in final) == sorted(x[:5] for x in ran)
    assert {x[0] for x in ran} == set(range(44)) - {40, 41}


def test_registered_queries():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    json.dumps(entry.oracle_sql())
