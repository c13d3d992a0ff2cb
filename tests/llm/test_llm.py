"""Small tests of the training-data operators: brute force, round trips, held-out accuracy and odd inputs."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyframe.llm import oracles
from skyframe.llm.chat import perspectives
from skyframe.llm.decontaminate import contaminated, without_contaminated
from skyframe.llm.html_extract import blocks, main_texts
from skyframe.llm.mixing import in_mix_order, mixed
from skyframe.llm.near_dedup import near_duplicates, without_near_duplicates
from skyframe.llm.quality import FEATURES, accepted, features, held_out, quality_scores
from skyframe.llm.queries import QUERIES
from skyframe.llm.substring_dedup import equal_words, shared_passages
from skyframe.llm.token_counts import at_limits, context_limits, length_histogram, quantile_lengths
from skyframe.llm.token_output import read_tokens, tokens_written, write_tokens
from skyframe.llm.tokens import Encoder, default_tokenizer, tokenizer_json
from skyframe.llm.topk import top_k

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
VOCABULARY = ["w%d" % i for i in range(400)]


def words(n):
    return " ".join(R.choices(VOCABULARY, k=n))


def odd_documents():
    base, passage = words(120), words(60)
    near = base.split()
    near[60] = "changed"
    texts = [base, base.upper(), " ".join(near), None, "", " \n\t ", "one two", "One  two", words(30) + " " + passage + " " + words(40), words(10) + " " + passage, words(3000), "same " * 300, "same " * 200, "é😀 ﬁ <|endoftext|>\r\n  x", base]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components_by_force(rows, percent):
    nodes = {}
    for i, t in rows:
        nodes.setdefault(i, []).append(shingles(t))
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        for s, t in itertools.product(nodes[a], nodes[b]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in nodes}


def test_near_duplicates_match_brute_force(spark, odd):
    got = near_duplicates(odd).collect()
    rows = [(r[0], r[1]) for r in odd_documents()]
    want = components_by_force([r for r in rows if r[0] is not None], 85)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    sizes = {r[0]: len(shingles(r[1])) for r in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_rows_that_repeat_an_id_are_one_document(spark):
    t = [words(60) for _ in range(4)]
    rows = [(3, t[2]), (5, t[1]), (5, t[2]), (7, t[1]), (9, ""), (9, t[3]), (8, t[3]), (11, None), (11, "  ")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).withColumn("node", F.lit("x"))).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 8), (9, 8), (11, 11), (11, 11)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_of_near_copies(spark):
    base = words(150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base)
        for _ in range(R.randint(1, 4)):
            own[R.randrange(150)] = f"x{i}{R.random()}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_force(rows, 85)


def test_without_near_duplicates_keeps_one_and_the_columns(odd):
    out = without_near_duplicates(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and ids.count(0) == 1 and 14 not in ids and 1 not in ids and ids.count(None) == 2 and 10 in ids


def test_shared_passages(odd):
    rows = shared_passages(odd).collect()
    linked = {frozenset((r.doc_id, r.other_id)) for r in rows}
    assert {8, 9} in linked and {11, 12} in linked and not any(10 in x or 6 in x for x in linked)
    assert {0, 1, 2, 14} <= set().union(*linked)
    at = next(r for r in rows if {r.doc_id, r.other_id} == {8, 9})
    start, n = (at.start_word, at.n_words) if at.doc_id == 8 else (at.other_start, at.other_words)
    assert start <= 30 and start + n >= 90


def test_equal_words_is_the_longest_common_subsequence():
    def slow(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(50):
        a, b = ([R.randrange(4) for _ in range(R.randrange(1, 20))] for _ in range(2))
        assert equal_words(np.array(a), np.array(b)) == slow(a, b)


def test_encoder_equals_the_tokenizer():
    json = tokenizer_json(default_tokenizer())
    own = Encoder(json)
    texts = ["", None, " a b", "a  b", "a\n b\n\nc", "don't 's x's y", "é😀", "12 3%", *[words(50) for _ in range(20)], "x\ty", "end ", "\n", "<|endoftext|>"]
    want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert own.encode(pa.array(texts)).to_pylist() == want and own.lengths(pa.array(texts)).tolist() == list(map(len, want))
    assert own.encode(pa.array(texts), 0).to_pylist() == [[*x, 0] for x in want] and len(own.encode(pa.array([], pa.string()))) == 0
    assert own.encode(pa.array(["x", *texts]).slice(1)).to_pylist() == want


def test_token_counts(odd, empty):
    own = Encoder(tokenizer_json(default_tokenizer()))
    lengths = own.lengths(pa.array([r[1] for r in odd_documents()])).tolist()
    histogram = length_histogram(odd)
    for r in context_limits(histogram).collect():
        assert r.n_docs == lengths.count(r.limit) and r.docs_over == sum(x > r.limit for x in lengths)
        assert r.tokens_over == sum(x for x in lengths if x > r.limit) and r.truncated_tokens == sum(min(x, r.limit) for x in lengths)
    for r in at_limits(histogram, [0, 5, 100]).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in lengths)
    (median,) = quantile_lengths(histogram, [0.5]).collect()
    assert median.n_tokens == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert context_limits(length_histogram(empty)).count() == 0


def test_token_output_round_trip(spark, odd, tmp_path):
    own = Encoder(tokenizer_json(default_tokenizer()))
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(own.encode(pa.array([r.text], pa.string()), 0).to_pylist()[0], "<u4").tobytes()
        want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(tuple(r) for r in tokens_written(docs).collect()) == want
    path = write_tokens(odd, str(tmp_path / "t"))
    assert read_tokens(spark, path).where("doc_id = 10").count() == 1 and tokens_written(odd).count() == odd.count()


def test_contaminated(spark, odd, empty):
    items = spark.createDataFrame([(1, words(30)), (2, "one two"), (3, None), (4, ""), (5, odd_text := words(200))], "item_id long, text string")
    long = words(9000).split()
    one = items.where("item_id = 1").first().text.split()
    docs = spark.createDataFrame([(0, " ".join(long[:7001] + one + long[7001:])), (1, "One\ttwo"), (2, "one two three"), (3, odd_text + " z"), (4, None), (None, "one two")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in contaminated(docs, items).collect())
    assert got == [(-1, 2), (0, 1), (1, 2), (3, 5)]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in without_contaminated(docs, items).collect()) == [2, 4]
    assert contaminated(empty, items).count() == 0 and contaminated(odd, items.where("false")).count() == 0


def test_contaminated_by_small_items(spark):
    small = [" ".join(f"i{i}x{j}" for j in range(5 + i % 8)) for i in range(200)]
    items = spark.createDataFrame(list(enumerate(small)), "item_id long, text string")
    long = [words(400).split() for _ in small]
    docs = spark.createDataFrame([(i, " ".join(long[i][:195] + t.split() + long[i][195:])) for i, t in enumerate(small)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(i, i) for i in range(200)]


def test_quality_reads_every_word():
    for n in (100, 400, 1000, 20_000):
        x = features([" ".join(["Aa", "bb"] * (n // 2)), " ".join(["Aa"] + ["bb"] * (n - 1))])[:, FEATURES.index("capitalised")]
        assert x.tolist() == [0.5, 1 / n]


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert quality_scores(odd, labels).count() == odd.count() and quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_scores(odd, labels.where("false")).collect()} == {0.5}
    assert accepted(odd, labels).columns == odd.columns


def test_mixing(spark, odd, empty):
    docs = spark.createDataFrame([(i, "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], "t") for i in range(4000)], "doc_id long, source string, text string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    out = mixed(docs, weights, block_docs=4).collect()
    assert len(out) == 4000
    order = {r.mix_slot: r.mix_source for r in out}
    had, horizon = dict.fromkeys("abc", 0), min(max(s for s, x in order.items() if x == c) for c in "abc")
    for slot in range(horizon):
        had[order[slot]] += 1
        assert all(abs(had[c] - weights[c] * (slot + 1)) < 1 for c in "abc")
    assert mixed(odd).count() == odd.count() and in_mix_order(odd).columns == odd.columns
    assert mixed(empty).count() == 0 and in_mix_order(empty).count() == 0
    clash = odd.withColumn("mix_slot", F.lit("x")).withColumn("units", F.lit(1)).withColumn("total", F.lit(1))
    assert mixed(clash).count() == odd.count()


@pytest.mark.parametrize(("weights", "slots"), [({"a": 0.50049, "b": 0.49951}, 1 << 17), ({"a": 1 / 3, "b": 0.1234567, "c": 0.5432099667}, 1 << 17), ({"a": 0.7, "b": 0.2, "c": 0.1}, 100), (None, 1 << 17)])
def test_mixing_stays_within_a_block_of_the_true_weights(spark, weights, slots):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.expr("case when id % 10 < 5 then 'a' when id % 10 < 8 then 'b' else 'c' end").alias("source"))
    docs = docs.where(F.col("source").isin(list(weights))) if weights else docs
    out = mixed(docs, weights, block_docs=2 if slots > 100 else None, slots=slots).select("mix_source", "mix_slot").distinct().collect()
    assert max(r.mix_slot for r in out) < slots
    share = weights or {k: int(n**0.5 * 1000) for k, n in (("a", 6000), ("b", 3600), ("c", 2400))}
    total = sum(share.values())
    order = {r.mix_slot: r.mix_source for r in out}
    had, horizon = dict.fromkeys(share, 0), min(max(s for s, x in order.items() if x == c) for c in share)
    for slot in range(horizon):
        had[order[slot]] += 1
        assert all(abs(had[c] - share[c] / total * (slot + 1)) < 1 for c in share)


def test_mixing_keeps_small_weights_and_the_given_block(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1500 == 7, "b").otherwise("a").alias("source"))
    out = mixed(docs, {"a": 0.9998, "b": 0.0002}, block_docs=1).select("mix_source", "mix_slot", "mix_rank").collect()
    assert len(out) == 200_000 and {r.mix_rank for r in out} == {0}
    order = {r.mix_slot: r.mix_source for r in out}
    last = max(s for s, x in order.items() if x == "a")
    had = 0
    for slot in range(last + 1):
        had += order.get(slot) == "b"
        assert abs(had - 0.0002 * (slot + 1)) < 1
    assert had == 39 or had == 40


def test_mixing_takes_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a")] * 500 + [(1, "a")] * 300 + [(i, None) for i in range(200)], "doc_id long, source string")
    out = mixed(docs, {"a": 0.8}, block_docs=8).collect()
    assert len(out) == 1000 and len({(r.mix_slot, r.mix_rank) for r in out}) == 1000


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=9)]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 9), (302, [None] * 9), (303, [1.0] * 4), (None, [1.0] * 9), (400, [0.0] * 9), (401, rows[7][1]), (500, [1e6] * 9)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    q = {i: [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for i in q:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], v, strict=True)), j) for j, v in q.items() if j != i and len(v) == len(q[i]))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:10])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_top_k_in_parts_with_repeated_ids(spark, monkeypatch):
    from skyframe.llm import topk

    monkeypatch.setattr(topk, "PART", 2)
    rows = [(i, [float(i % 7), 1.0], "x") for i in range(40)] + [(10, [0.5, 0.5], "y"), (20, [9.0, 9.0], "y")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string")
    got = sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 10 == 0, 3).collect())
    want = []
    for i in range(0, 40, 10):
        q = min([int(1024 * x) for x in v] for j, v, _ in rows if j == i)
        scored = sorted((-sum(int(1024 * x) * y for x, y in zip(v, q, strict=True)), j) for j, v, _ in rows if j != i)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:3])]
    assert got == want


def test_decontamination_in_parts(spark, monkeypatch):
    from skyframe.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PART", 40)
    items = [words(30) for _ in range(5)]
    docs = spark.createDataFrame([(i, f"{words(9)} {t} {words(9)}", "c") for i, t in enumerate([*items, words(60)])], "doc_id long, text string, item_id string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, table).collect()) == [(i, i) for i in range(5)]
    assert [r.doc_id for r in without_contaminated(docs, table).collect()] == [5]


def test_html_blocks():
    page = """<head><title>T</title></head><body><nav><p>Menu</nav><header>Top</header><div class="cookie-notice">Ok?</div>
    <article><header><h1>A &amp;amp; B</h1></header><p>One<br>two &lt;x&gt; <b>three<p>Four<aside>Side</aside><form>f</form>
    <script>if (a < b) "</p>"</script><div id="comments"><p>Nice!</div><p>Five&nbsp;six</article><footer>&copy; me"""
    assert [t for z, t in blocks(page) if z == "main"] == ["A &amp; B", "One two <x> three", "Four", "Five six"]
    assert blocks(None) == [] and blocks("") == [] and blocks("<article>cut <p>off") == [("main", "cut"), ("main", "off")]


@pytest.mark.parametrize("odd_part", ['<svg class="i"/>', "<math/>", "<video-player src='x'></video-player>", "<button-group></button-group>", "<button>no", "<select><option>no<option>no", "<svg><path d='M0'><text>no</text>", "<button>no<button>no</button>", "<button><p>no</p></button>", "<p><template><div>no<template><p>no</template></div></template>", "<video src='x'>no<p>no</p></video>", "<select><option>no</select>", "<object><object><p>no</object><p>no</object>", "<textarea>no<p>no</textarea>"])
def test_text_after_an_odd_element_stays(odd_part):
    assert blocks(f"<article><p>a</p>{odd_part}<p>rest</p><p>b <button>no</button> c</p></article>") == [("main", "a"), ("main", "rest"), ("main", "b c")]


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    chrome = "Welcome to our site where all news is told first and best"
    rows = [(i, f"http://h.example/{i}", f"<div>{chrome}</div><p>Story {words(20)}</p>") for i in range(4)]
    rows += [(10, None, None), (11, "x", ""), (12, "http://h.example/z", f"<article><p>{chrome}</p></article>"), (0, rows[0][1], f"<div>{chrome}</div><p>Other {words(20)}</p>")]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(chrome not in r.text and r.text for r in got if r.page_id < 4)
    assert {r.page_id: r.text for r in got if r.page_id > 9} == {10: "", 11: "", 12: chrome}
    assert all(r.n_chars == len(r.text) for r in got)


def test_copies_of_a_page_keep_their_text_and_repeats_go_as_runs(spark):
    chrome = " ".join(f"chrome{i}" for i in range(10))
    own = [" ".join(f"own{i}x{j}" for j in range(60)) for i in range(4)]
    near = own[0].replace("own0x30 ", "changed ")
    halves = [f"{chrome} {' '.join(f'half{i}x{j}' for j in range(12))}" for i in range(4)]
    page = lambda i, text: f"<div>{chrome}</div><p>{text}</p><p>{halves[i]}</p>"
    shown = [page(0, own[0]), page(0, own[0]), page(0, near), page(1, own[1]), page(2, own[2]), page(3, own[3])]
    rows = [(i, f"http://h.example/{i}", t) for i, t in enumerate(shown)]
    rows += [rows[0], (6, "http://alone.example/1", page(0, own[3])), (7, "http://alone.example/2", page(0, own[3]))]
    got = sorted((r.page_id, r.text) for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    half = [h.removeprefix(chrome + " ") for h in halves]
    want = [(0, f"{own[0]}\n{half[0]}")] * 2 + [(1, f"{own[0]}\n{half[0]}"), (2, f"{near}\n{half[0]}")] + [(i + 2, f"{own[i]}\n{half[i]}") for i in (1, 2, 3)]
    assert got == want + [(i, f"{chrome}\n{own[3]}\n{halves[0]}") for i in (6, 7)]


def test_names_of_chrome_within_an_article():
    page = "<article><p class='share'>The share price rose</p><div class='related-work'><p>Work</p></div><p>a <math><mi>x</mi></math> b</p><div class='share-buttons'>Share</div><div class='ad'>Buy</div><section id='commentsSection'><p>Nice</p></section></article>"
    assert blocks(page) == [("doubt", "The share price rose"), ("doubt", "Work"), ("main", "a x b"), ("chrome", "Share"), ("chrome", "Buy"), ("chrome", "Nice")]


def test_the_suffix_array_decides_what_is_in_doubt(spark):
    often = "Please support our work by reading more of what we wrote"
    page = lambda i: f"<article><h1>Title {i}</h1><p>{words(30)}</p><p class='promo'>{often}</p><div class='related-work'><p>{words(25)} {often} end{i}</p></div></article>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    rows += [(10, "http://alone.example/", rows[0][2]), (11, None, rows[1][2]), (12, None, rows[2][2]), (13, rows[3][1], rows[3][2])]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = {i: "\n".join(t for _, t in blocks(h)) for i, _, h in rows}
    for i in (0, 1, 2, 3, 4, 5, 13):
        assert got[i] == whole[i].replace("\n" + often, "").replace(" " + often, "")
    for i in (10, 11, 12):
        assert got[i] == whole[i]
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0


def test_repeats_of_the_suffix_array_match_brute_force():
    import pandas as pd

    from skyframe.llm.html_extract import RUN, _repeats

    for _ in range(20):
        pages = [np.array([R.randrange(3) for _ in range(R.randrange(40))], np.uint64) for _ in range(5)]
        held = {}
        for i, p in enumerate(pages):
            for k in range(len(p) - RUN + 1):
                held.setdefault(tuple(p[k : k + RUN].tolist()), set()).add(i)
        want = sorted((min(x), max(x)) for x in held.values() if len(x) > 1)
        shard = pd.DataFrame({"words": [p.view(np.int64) for p in pages], "page": range(5)})
        got = sorted((a, b) for _, first, last in _repeats(shard, False) for a, b in zip(first.tolist(), last.tolist(), strict=True))
        assert got == want


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hé"), (1, 2, "bob", "yo"), (1, None, None, None), (2, 0, "system", "x"), (None, 0, "ann", "n"), (1, 1, "ann", "hé")]
    out = perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.participant) for r in out if r.part == 0) == [(0, "ann"), (1, ""), (1, "ann"), (1, "bob")]
    ann = next(r for r in out if r.conv_id == 1 and r.participant == "ann" and r.part == 0)
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["hé<|im_end|>\n"] * 2 and "user name=bob\nyo" in ann.text and ann.char_start > 0
    long = spark.createDataFrame([(1, i // 3, f"p{i % 2}", str(i)) for i in range(50)], "conv_id long, turn long, role string, text string")
    cut, whole = ({r.participant: [] for r in perspectives(long, c).collect()} for c in (4, 512))
    for into, c in ((cut, 4), (whole, 512)):
        for r in sorted(perspectives(long, c).collect(), key=lambda r: (r.part, r.piece)):
            assert r.char_start == sum(map(len, into[r.participant]))
            into[r.participant].append(r.text)
    assert {k: "".join(v) for k, v in cut.items()} == {k: "".join(v) for k, v in whole.items()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns
        seen.append(corpus_pipeline.stored(out, "t"))
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    scores = {r.doc_id: r.score for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert ids[1] == {i for i, s in scores.items() if s >= 0.3}
    comps = components_by_force([(r.doc_id, r.text) for r in seen[1].collect()], 80)
    assert ids[2] == {i for i, c in comps.items() if i == c}
    items = [(r.item_id, shingles(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in seen[2].collect() if not any(100 * len(s & shingles(r.text)) >= 80 * len(s) for _, s in items if s)}
    assert ids[3] == clean == ids[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == clean


def test_pipeline_writes_tokens_in_mixture_order(spark):
    import corpus_pipeline

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # several files
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), "t")
        want = [r.doc_id for r in mixed(docs).orderBy("mix_slot", "mix_rank").collect()]
        got = [r.doc_id for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    finally:
        spark.conf.unset(coalesce)
    assert got == want != sorted(want)
