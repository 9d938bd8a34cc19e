import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from manualdex.llm import grams, language_id, quality, queries, token_counts
from tests.llm import data


def test_word_and_shingle_hashes_agree_with_strings():
    texts = [t for _, t, *_ in data.ROWS] + ["ü ", "", "a b c d e", "A  B\tc"]
    seen = {}
    for n in (1, 3, 5):
        for at, to, chars, offsets in grams.slices(pa.array(texts)):
            flat, first = grams.words(chars, offsets).shingles(n)
            for d in range(to - at):
                w = data.words(texts[at + d])
                plain = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] * bool(w)
                assert len(plain) == first[d + 1] - first[d]
                for s, h in zip(plain, flat[first[d] : first[d + 1]].tolist()):
                    assert seen.setdefault((n, s), h) == h
    for n in (1, 3, 5):
        own = [h for (m, _), h in seen.items() if m == n]
        assert len(set(own)) == len(own)


def ppm_bits(counts, text):
    """Code length by walking the context tree byte by byte."""
    x = bytes(language_id.FOLD[np.frombuffer((language_id.START + text).encode(), np.uint8)])
    total, different = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for o in range(4):
        for g, c in counts[o].items():
            total[o][g[:-1]] += c
            different[o][g[:-1]] += 1
    bits = 0.0
    for i in range(3, len(x)):
        for o in (3, 2, 1, 0):
            context, string = x[i - o : i], x[i - o : i + 1]
            n, d = total[o][context], different[o][context]
            if counts[o][string]:
                bits += math.log2((n + d) / counts[o][string])
                break
            bits += math.log2((n + d) / d) if n else 0
        else:
            bits += 8
    return bits


def test_code_lengths_match_a_walk_through_the_tree(spark):
    rows = [(i, t, l) for i, t, l, _ in data.ROWS if t and l and len(t) < 500]
    model = language_id.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    for text in ("the dog", "Über die Straße", "", "\x01\x02zz☃", data.BASE * 3):
        for _, _, chars, ends in language_id._after_start(pa.array([text, "x"])):
            got = model.lengths(chars, ends)[0]
            direct, model.direct = model.direct, None
            assert np.allclose(got, model.lengths(chars, ends)[0])
            model.direct = direct
        for k, l in enumerate(model.languages):
            counts = [Counter() for _ in range(4)]
            for i, t, own in rows:
                x = bytes(language_id.FOLD[np.frombuffer((language_id.START + t).encode(), np.uint8)])
                if own == l and i is not None:
                    for at in range(3, len(x)):
                        for o in range(4):
                            counts[o][x[at - o : at + 1]] += 1
            if l == "de":
                assert got[k] == pytest.approx(ppm_bits(counts, text), rel=1e-4, abs=1e-3)


def test_languages_of_awkward_rows(spark):
    docs = data.documents(spark)
    model = language_id.learn(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(data.ROWS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (4, 5, 6, 7, 8, 11)] == ["und", "und", "und", "und", "en", "de"]
    assert language_id.identify(data.documents(spark, []), model).count() == 0
    none = language_id.learn(data.documents(spark, []).select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_accuracy_on_the_held_out_fold(spark, sf):
    got = queries.op3_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(docs, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_quality_on_the_held_out_fold(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op5_quality(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    y = np.array([r.quality for r in rows])
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.score for r in rows if r.quality == 1]) > 0.9 > 0.3 > np.mean([r.score for r in rows if not r.quality])
    assert 0 < y.sum() < len(y)


def test_quality_of_awkward_rows(spark):
    docs = data.documents(spark)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    got = quality.score(docs, rules)
    assert got.columns.count("score") == 1 and got.count() == len(data.ROWS)
    assert all(r.predicted == int(r.score >= 0.3) for r in got.collect())
    assert quality.score(docs, quality.learn(docs, labels.limit(0))).filter("score = 0.5").count() == len(data.ROWS)
    assert quality.score(data.documents(spark, []), rules).count() == 0


def test_compiled_rules_score_as_the_model(spark):
    rng = np.random.default_rng(5)
    x = rng.random((600, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    rules = quality.fit(x, y, ["a", "b"])
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    got = np.array([r.s for r in frame.select(rules.score({"a": F.col("a"), "b": F.col("b")}).alias("s")).collect()])
    odds = rules.bias + sum(w * quality._holds(x, t) for t, w in rules.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-odds))) and np.mean((got > 0.5) == y) > 0.97
    assert len(rules.rules) < len(quality.extract_rules(x, y))
    assert quality.Rules.from_json(rules.to_json()) == rules


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["a\x1cb \x1d x", "   x  \n\n", "<|endoftext|> hi<|endoftext|>", "　漢字 12½²", "it's we'll 'S", "\x85᠎​ x", "a" * 5000, "🙂 é́"]
    rows = data.ROWS + [(100 + i, t, None, None) for i, t in enumerate(odd)]
    got = token_counts.token_counts(data.documents(spark, rows), path).collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    assert sorted((r.n_tokens, r.n_bytes) for r in got) == sorted((n, len((t or "").encode())) for n, (_, t, *_) in zip(want, rows))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(data.documents(spark, []), path).count() == 0


def test_blocks_of_a_long_text_count_as_one(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    counting = token_counts.Counting(path, frozenset())
    whole = counting.counts(data.LONG)
    monkeypatch.setattr(token_counts, "BLOCK", 1000)
    assert counting.counts(data.LONG) == whole


def test_a_filter_on_the_prediction_does_not_repeat_the_statistics(spark):
    terms = [((i % 3, i / 40, i % 2 == 0), ((i + 1) % 3, i / 50, True)) for i in range(40)]
    rules = quality.Rules(list(quality.statistics(F.lit(""))), 0.1, [(t, 0.01 * i) for i, t in enumerate(terms)])
    kept = quality.score(data.documents(spark).select("doc_id", "text"), rules).filter("predicted = 1")
    plan = kept._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        text = plan.toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert text.count("0123456789") == 1
    assert kept.count() == sum(r.predicted for r in quality.score(data.documents(spark), rules).collect())
