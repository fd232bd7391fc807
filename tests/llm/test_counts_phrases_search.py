"""Token counts, phrase collocations and ranked search against brute force: nulls, ties, repeats, long texts, clashing names, empty tables."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import DATA, differences, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import counts, phrases, registry, search

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["The quick brown fox jumps.", None, "", " \n\t ", "a", "  two  spaces ", "<s> the </s> <unk> ▁x", "word " * 20_000, "The quick brown fox jumps.", "ÇA été 北京 🙂 naïve", "A" * 5000]
ROWS = [(i, t, "en" if i % 3 else None) for i, t in enumerate(TEXTS)] + [(None, "no key fox", "en"), (0, TEXTS[0], "en")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# token counts


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" ▁ab.,!\n\té北", max_size=30)))
def test_segments_count_as_the_library(text):
    count = counts.counter(MODEL)
    assert not counts._held[MODEL].whole
    assert count(text) == len(counts._held[MODEL].model.encode(text))


def test_a_model_with_other_rules_encodes_whole_texts():
    proto = sentencepiece.SentencePieceProcessor(model_file=MODEL).serialized_model_proto()
    assert counts.by_segments(proto)
    piece = lambda text, kind: b"\x0a" + bytes([len(text.encode()) + 4]) + b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x18" + bytes([kind])
    assert not counts.by_segments(proto + piece("a▁b", 1)) and not counts.by_segments(proto + piece("ab", 4))
    assert not counts.by_segments(proto + b"\x1a\x02\x20\x01")  # white space dropped


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, docs, none, name, tmp_path):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    clash = docs.withColumn("N_tokens", F.lit("mine")).withColumn("digest", F.lit(1))
    got = counts.token_counts(clash, path, cache=f"file://{tmp_path}/cache")
    assert got.columns == [*clash.columns, "n_bytes", "_n_tokens"] and got.count() == len(ROWS)
    for r in got.collect():
        text = r["text"] or ""
        assert (r["n_bytes"], r["_n_tokens"], r["N_tokens"], r["digest"]) == (len(text.encode()), size(text), "mine", 1)
    assert counts.token_counts(none, path).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_cache_encodes_only_distinct_misses(spark, docs, tmp_path, monkeypatch, broadcast_rows):
    cache, version = f"file://{tmp_path}/cache", counts.version_of(MODEL)
    first = counts.token_counts(docs.filter("doc_id < 5"), MODEL, cache, broadcast_rows=broadcast_rows)
    want = {r["doc_id"]: r["n_tokens"] for r in first.collect()}
    known = counts.cached(spark, cache, version)
    assert known.count() == len({r[1] or "" for r in ROWS if r[0] is not None and r[0] < 5})
    spark.createDataFrame(known.collect(), "digest binary, n_tokens long").withColumn("n_tokens", F.col("n_tokens") + 1000).withColumn("tokenizer", F.lit("another")).write.mode("append").partitionBy("tokenizer").parquet(cache)
    encoded = []
    inner = counts.misses
    monkeypatch.setattr(counts, "misses", lambda *a: encoded.append(inner(*a)) or encoded[-1])
    again = {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(docs, MODEL, cache, broadcast_rows=broadcast_rows).collect() if r["doc_id"] is not None}
    assert {i: again[i] for i in want} == want
    assert encoded[0].count() == len({r[1] or "" for r in ROWS}) - len({r[1] or "" for r in ROWS if r[0] is not None and r[0] < 5})
    counts.token_counts(docs, MODEL, cache, broadcast_rows=broadcast_rows)
    assert encoded[1].count() == 0
    # two writers that appended the same rows
    known.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert counts.token_counts(docs, MODEL, cache).count() == len(ROWS)


def test_token_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = registry.QUERIES["op11_token_cache"](spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(model.encode(texts[r["doc_id"]]))
        assert tuple(r)[1:] == (len(texts[r["doc_id"]].encode()), n, n > 4096)


# phrases


def brute_counts(rows, words=4):
    found, total = collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for size in range(1, words + 1):
                for i in range(len(w) - size + 1):
                    f = found[lang or "und", tuple(w[i : i + size])]
                    f[0] += 1
                    f[1] += i > 0
                    f[2] += i + size < len(w)
    return found, total


def brute_collocations(rows, least, top, words=4):
    found, total = brute_counts(rows, words)
    candidates = {k: v[0] for k, v in found.items() if len(k[1]) > 1 and v[0] >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for (l2, q), b in candidates.items()):
            continue
        score, _, left, right = min((2000000 * a // (found[lang, p[:k]][0] + found[lang, p[k:]][0]), k, found[lang, p[:k]][0], found[lang, p[k:]][0]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right, found[lang, p][1:]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s, *sides) for lang, rows in out.items() for rank, (s, a, p, left, right, sides) in enumerate(sorted(rows)[:top], 1))


def some_texts(n, seed=3):
    rnd = random.Random(seed)
    words = ["a", "b", "The", "the", "cat", "sat", "ÉTÉ", "été", "x\x00y", "北京", "-", "mat"]
    return [(i, "".join(rnd.choice(words) + rnd.choice([" "] * 8 + ["\t", ", ", ".", "\n", "  ", "! "]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("shard_words", [50, 1 << 21])
def test_collocations(spark, none, shard_words):
    rows = some_texts(120) + [(1, None, "en"), (2, "", None), (2, "one of a kind " * 40, "fr"), (3, " ,;.!", "en"), (4, "the end", "und")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit(1)).withColumn("rank", F.lit(2)).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=5, top=25, shard_words=shard_words).collect())
    assert got == brute_collocations(rows, 5, 25) and len(got) > 60
    assert phrases.collocations(none).count() == 0


def test_frequent_phrases_over_many_shards(spark):
    rows = some_texts(60, 4)
    index = phrases.build(spark.createDataFrame(rows, SCHEMA).repartition(4), shard_words=40)
    assert index.count() > 20
    got = {(r["lang"], tuple(r["phrase"].split(" "))): (r["a"], r["left_n"], r["right_n"]) for r in phrases.frequent_phrases(index, 3).collect()}
    assert got == {k: tuple(v) for k, v in brute_counts(rows)[0].items() if v[0] >= 3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_index_finds_every_phrase(symbols):
    words = np.array([*symbols, 0], np.int32)
    index = phrases.Index(phrases.unpacked(phrases.packed(phrases.transform(words))))
    for size in range(1, 5):
        want = collections.Counter(tuple(words[i : i + size].tolist()) for i in range(len(words) - size + 1) if 0 not in words[i : i + size])
        starts, n, left, right = index.intervals()
        got = dict(zip(zip(*(w.tolist() for w in index.words(starts)), strict=True), n.tolist(), strict=True)) if len(starts) else {}
        assert got == want
        for s, a, b in zip(zip(*(w.tolist() for w in index.words(starts)), strict=True), left.tolist(), right.tolist(), strict=True):
            at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size].tolist()) == s]
            assert (a, b) == (sum(i > 0 and words[i - 1] != 0 for i in at), sum(words[i + size] != 0 for i in at))
        index.extend()


def test_numbers_beyond_16_bits_sort_stably():
    x = np.random.default_rng(1).integers(0, 1 << 18, 5000).astype(np.int32)
    assert (phrases.by_symbol(x) == np.argsort(x, kind="stable")).all()


def test_phrase_query(spark):
    assert differences(registry.QUERIES["op12_collocations"](spark, DATA), duck(), registry.SQL["op12_collocations"]) == ""


# search


def brute_search(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))
    held = [(d, collections.Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    n, total = len(held), sum(x[2] for x in held)
    asked = collections.defaultdict(list)
    for i, text in items:
        asked[i] += terms(text)
    out = []
    for i, words in asked.items():
        scores = []
        for d, tf, size in held:
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in x[1] for x in held) + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [3, 1000])
def test_top_documents(spark, none, docs, block_terms):
    rows = [(i, t) for i, t, _ in some_texts(80, 5)]
    rows += [(200 + i, "the cat") for i in range(30)] + [(7, "the cat"), (7, "the cat"), (None, "cat cat"), (300, None), (301, ""), (302, " .,"), (303, "cat " * 5000)]
    items = [(1, "The cat sat! cat"), (2, None), (3, "nothing-here zebra"), (4, "ÉTÉ été"), (4, "北京 cat"), (None, "mat"), (5, ""), (6, "cat")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("bag", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("Doc_id", F.lit(9))
    got = search.top_documents(table, asked, block_terms=block_terms)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(rows, items)
    assert search.top_documents(none, asked).count() == 0
    assert search.top_documents(table, asked.limit(0)).count() == 0


def test_classes_are_scored_once(spark):
    rows = [(i, 5, f"t{i % 7}".encode()) for i in range(700)] + [(1000, 6, b"t1"), (1001, 5, b"t1")]
    got = {(r["m"], bytes(r["bag"])): r["members"] for r in search.classes(spark.createDataFrame(rows, "doc_id long, m long, bag binary"), 10).collect()}
    assert len(got) == 8 and got[5, b"t3"] == [3 + 7 * i for i in range(10)] and got[6, b"t1"] == [1000]


def test_scores_beyond_doubles(spark):
    """An item of very many repeats is summed in whole numbers of 64 bits."""
    rows, items = [(1, "a b"), (2, "a c c"), (3, "d")], [(1, "a " * 3_000_000 + "c")]
    got = [tuple(r) for r in search.top_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    n, total, want = 3, 6, []
    for d, tf, size in ((1, (1, 0), 2), (2, (1, 2), 3)):
        m = 25 + (75 * size * n) // total
        want.append((-sum(r * math.floor(1000 * math.log(8 / (2 * df + 1))) * ((10**9 * t) // (1000 * t + 8 * m)) for r, df, t in ((3_000_000, 2, tf[0]), (1, 1, tf[1])) if t), d))
    assert sorted(got) == [(1, r, d, -s) for r, (s, d) in enumerate(sorted(want), 1)]


def test_search_query(spark):
    assert differences(registry.QUERIES["op13_bag_search"](spark, DATA), duck(), registry.SQL["op13_bag_search"]) == ""
