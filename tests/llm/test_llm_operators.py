"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
import sentencepiece

import public_tokenizers
from reelgrid.llm import ctw, decontaminate, divergence, licenses, line_dedup, mixing, recompression, set_relations, token_cache, url_cascade

LOREM = [f"w{(i * i * 7 + i) % 211}" for i in range(900)]
PASSAGE = " ".join(LOREM[100:160])
LINE = "This line is found in several documents"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, size long, block int, rk long, kept string"
TEXTS = [None, "", " ", "one two three", " ".join(LOREM), " ".join(LOREM[:400] + ["changed"] + LOREM[400:]), f"{PASSAGE} and an end",
         f"start it\n{LINE}\n{PASSAGE}\nMIT License", f"{LINE}\n{LINE}\nother", f"x\n  {LINE.upper()}\t\nGNU General Public License v3", "la " * 120, "la " * 90 + "le",
         "Ünïcödé Straße 漢字 " * 12, "Licensed under the Apache License, Version 2.0", " ".join(LOREM)]
ROWS = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 7, 7, 7, 7, "x") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], (None, "lost id with a few words in it", "en", "s1", 7, 7, 7, 7, "x"), (None, None, None, None, None, None, None, None, None)]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_context_tree_base_and_probabilities(docs, empty):
    got = {(r["doc_id"], r["n_tokens"]): r for r in ctw.score(docs, block_bytes=2000).collect()}
    out = {i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, *_ in ROWS}
    c, n = Counter(), 0
    for i, t, *_ in ROWS:
        if not out[i]:
            c.update(lower(t).split() + [None])
    n = sum(c.values())
    for i, t, *_ in ROWS:
        tokens = lower(t).split() + [None]
        r = got[(i, len(tokens))]
        assert r["held_out"] == out[i] and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0
    assert got[(4, 901)]["score"] > got[(4, 901)]["base_score"]
    assert ctw.score(empty).count() == 0


def brute_tree(texts, depth):
    """Counts of every node, then weighted probabilities by plain recursion."""
    counts, kids = Counter(), {}
    def nodes(history, byte):
        for j in range(8):
            prefix, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            yield prefix, bit, [(history[len(history) - d:], prefix) for d in range(depth + 1)]
    def coded(text):
        data = b"\0" * depth + text + b"\0"
        for i in range(depth, len(data)):
            yield data[i - depth:i], data[i]
    for t in texts:
        for h, b in coded(t):
            for _, bit, path in nodes(h, b):
                for d, node in enumerate(path):
                    counts[node, bit] += 1
                    if d:
                        kids.setdefault(path[d - 1], set()).add(node)
    def kt(node):
        a, b = counts[node, 0], counts[node, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
    logs = {}
    def weigh(node):
        if node not in logs:
            own = kt(node)
            if len(node[0]) == depth:
                logs[node] = own
            else:
                below = sum(weigh(k) for k in kids.get(node, ()))
                top = max(own, below)
                logs[node] = top + math.log(.5 * math.exp(own - top) + .5 * math.exp(below - top))
        return logs[node]
    def score(text):
        total = 0.0
        for h, b in coded(text):
            for _, bit, path in nodes(h, b):
                p = None
                for node in reversed(path):
                    a, o = counts[node, 0], counts[node, 1]
                    own = ((o if bit else a) + .5) / (a + o + 1)
                    w = 0.0 if p is None else .5 * math.exp(kt(node) - weigh(node))
                    p = own if p is None else w * own + (1 - w) * p
                total += math.log10(p)
        return total
    return score


def test_context_tree_equals_plain_recursion(spark):
    texts = ["abracadabra abra", "banana bandana", "", "zz", "abra banana"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    for depth in (2, 3):
        score = brute_tree(train, depth)
        for r in ctw.score(frame, depth=depth).collect():
            assert math.isclose(r["score"], score(texts[r["doc_id"]].encode()), rel_tol=1e-9)


def test_context_tree_mixes_five_bytes_by_default(spark):
    texts = ["xabcdy zabcdw " * 3, "xabcdy", "", "zabcdw xabcdy"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    score = brute_tree(train, 5)
    for r in ctw.score(frame, block_bytes=20).collect():
        assert math.isclose(r["score"], score(texts[r["doc_id"]].encode()), rel_tol=1e-9)


def test_mix_meets_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == math.floor(rows[0]["target"]) and rows[0]["source_size"] == sum(r["size"] for r in rows)
    assert math.isclose(sum(rows[0]["target"] for rows in by.values()), sum(r["size"] for r in got))
    assert mixing.mix(empty).count() == 0


def test_benchmark_words_and_cuts(spark, docs, empty):
    items = spark.createDataFrame([("a", PASSAGE), ("b", "three"), ("c", None), ("d", ""), (None, "漢字")], "item_id string, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.report(docs, items).collect()}
    assert got[(6, 63)]["n_hit"] == 60 and got[(4, 900)]["contaminated"] and not got[(8, 15)]["contaminated"]
    assert got[(3, 3)]["n_hit"] == 1 and got[(3, 3)]["items_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[(12, 36)]["n_hit"] == 12 and got[(12, 36)]["n_items"] == 0
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert 6 not in left and left[3] == "one two " and PASSAGE not in left[4] and left[8] == TEXTS[8] and left[0] is None
    assert decontaminate.report(empty, items).count() == 0 and not decontaminate.report(docs, items.limit(0)).where("contaminated").count()


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.b.Example.ORG/es/x?q", "http://example.org/en/17#f", "https://example.org", "http://x.com/de/1", "http://x.com/fr/2",
            "http://casino-win.net/a", "http://org/x", "http://notexample.org/es/", "http://a.b.Example.ORG/es/x?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'x' as rule", "1 as host")
    rules = spark.createDataFrame(url_cascade.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.judge_urls(pages, rules, url_cascade.listed_hosts(pages, url_cascade.BLOCKED_WORDS)).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.org/es/", "block"), 4: ("example.org/en/1", "block"), 5: (None, "allow"),
                   6: ("com/de/", "block"), 7: ("com/fr/", "allow"), 8: (None, "block"), 9: ("org/", "allow"), 10: ("org/", "allow"), 11: ("example.org/es/", "block")}
    assert url_cascade.judge_urls(pages.limit(0), rules, rules.selectExpr("host as key").limit(0)).count() == 0


def test_substrings(docs, empty):
    rows = sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in ROWS})
    seen, want = set(), {}
    for i, t in [r for r in rows if r[0] >= 0]:
        w = t.encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            if k in seen:
                gone[p:p + 20] = b"\1" * 20
            seen.add(k)
        want[i] = (len(w), gone.count(1), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = recompression.dedup_substrings(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == want
    assert recompression.dedup_substrings(empty).count() == 0


def test_lines(docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, with_text=True).collect()}
    assert [got[i]["n_dropped"] for i in (7, 8, 9)] == [1, 2, 0]
    assert got[8]["kept_text"] == "other" and got[9]["kept_text"] == TEXTS[9] and got[0]["n_lines"] == 1
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(docs).count() == len(ROWS)


def test_token_cache_matches_the_library(docs, empty, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(2):                                    # cold, then from the cache
        got = token_cache.token_counts(docs, str(tmp_path / "cache")).collect()
        assert Counter((r["n_bytes"], r["n_tokens"]) for r in got) == Counter((len((t or "").encode()), len(sp.encode(t or ""))) for _, t, *_ in ROWS)
    assert docs.sparkSession.read.parquet(str(tmp_path / "cache")).count() == len({t or "" for _, t, *_ in ROWS})
    assert token_cache.token_counts(empty, str(tmp_path / "none")).count() == 0


def test_quality_counts(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in divergence.judge(docs).collect()}
    assert got[(10, 120)]["n_repeat_words"] == 120 and got[(10, 120)]["base_failed"] and not got[(10, 120)]["kept"]
    assert got[(8, 15)]["n_dup_lines"] == 1 and got[(0, 0)]["base_failed"] and got[(12, 36)]["word_chars"] == len("ÜnïcödéStraße漢字") * 12
    assert divergence.js_distance(*map(__import__("numpy").array, ([1.0, 0.0], [0.0, 3.0]))) == 1.0
    assert divergence.judge(empty).count() == 0


@pytest.mark.parametrize("short_list,block", [(32, 1_000_000), (1, 300)])
def test_components(docs, empty, short_list, block):
    def shingles(t):
        w = lower(t).split()
        return {tuple(w)} if 0 < len(w) < 4 else set(zip(w, w[1:], w[2:], w[3:]))
    rows = [(i, shingles(t)) for i, t, *_ in ROWS]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = root[a], root[b]
                root = [rb if r == ra else r for r in root]
    low = {r: min((i for (i, s), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    want = Counter((i, len(s), low[r] if s else i) for (i, s), r in zip(rows, root))
    got = set_relations.link_components(docs, short_list=short_list, block_shingles=block).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert set_relations.link_components(empty).count() == 0


def test_licenses(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    assert got[(7, 71)]["base_labels"] == "mit" and got[(7, 71)]["first_word"] == 69
    assert set(got[(13, 8)]["labels"].split(",")) == {"apache", "apache-2.0"} and got[(0, 0)]["labels"] == ""
    assert "gpl-version" in got[(9, 13)]["labels"]
    a = licenses.compile_template("t", "a [b c] {x:2} d")
    assert [licenses.longest_match(x.encode().split(), 0, a) for x in ("a d", "a b c d", "a x d", "a x y d", "a x y z d", "a b d", "d")] == [2, 4, 3, 4, -1, 3, -1]
    assert licenses.scan(empty).count() == 0


def test_block_counts_over_many_slices(monkeypatch):
    """Sums of slices put together once and again are those of the texts, and no text at all gives none."""
    import numpy as np
    from collections import Counter
    from reelgrid.llm import ctw
    monkeypatch.setattr(ctw, "SLICE", 4)
    texts = [b"abc abd", b"", b"B\xc3\xa9 ab"] * 9
    train = [i % 4 > 0 for i in range(len(texts))]
    keys, counts, words, n = ctw.block_counts(texts, train, 3)
    want = Counter()
    for t, use in zip(texts, train):
        for k in ctw.gram_keys([t.translate(ctw.LOWER)], 3)[0].tolist():
            want[k] += use
    assert dict(zip(keys.tolist(), counts.tolist())) == want and np.all(np.diff(keys) > 0)
    assert words == sorted(words) and sum(n) == sum(len(t.split()) for t, use in zip(texts, train) if use)
    none = ctw.block_counts([], [], 3)
    assert [len(x) for x in none] == [0, 0, 0, 0]
