"""The pipeline against plain Python: every stage again over lists, on documents planted for each of them."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from reelgrid.llm.divergence import Limits, judge
from reelgrid.llm.texts import row_key

WORDS = [f"{a}{b}" for a in ("ka", "le", "mi", "no", "su", "ta") for b in ("ra", "den", "lo", "mis", "tor", "ne", "vi", "gal", "sen", "pu")]
ITEM = "the quick question asks which river flows through the old capital and into the northern sea before winter begins"
SHARED = "this footer stands below very many of the pages"
SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words long, taken long, size long, __text string, `a.b` string, __cut long, __rk long"
BLANK = " \t\n\x0b\x0c\r"


def prose(seed, n=120):
    pick = random.Random(seed)
    return "\n".join(" ".join(pick.choice(WORDS) for _ in range(12)) + "." for _ in range(n // 12))


def planted():
    near = prose(100).split(" ")
    texts = {i: prose(i) for i in range(1, 13)}
    texts |= {20: prose(3), 21: prose(3), 22: " ".join(near), 23: " ".join([*near[:60], "changed", *near[61:]]),
              24: prose(24, 36), 25: "la " * 120, 26: None, 27: "", 28: "#$% && || <> ** " * 40 + prose(28, 60),
              29: " ".join(f"zq{i}x" for i in range(90)), 30: f"{prose(30)}\n{ITEM}\n{prose(31)}", 31: f"{ITEM}. " + prose(32, 60) + f" {ITEM} {ITEM} {ITEM} {ITEM}",
              32: prose(33, 1200), 33: prose(34).upper(), 34: "Straße 漢字 " * 3 + prose(35)}
    for i in (5, 6, 7, 34):
        texts[i] = f"{texts[i]}\n  {SHARED.upper() if i == 6 else SHARED}\t"
    rows = [(i, t, "en" if i % 5 else None, None if i % 7 == 0 else f"s{i % 3}", "x", 1, 1, 1, "x", "y", 2, 3) for i, t in texts.items()]
    rest = (None,) * 8
    # a repeated row, near copies under one id, and a component whose ids are all null
    return [*rows, rows[0], (40, prose(101) + " other", "en", "s1", *rest), (40, prose(101) + " thing", "en", "s1", *rest),
            (None, prose(50), "en", "s1", *rest), (None, prose(50) + " more", "en", "s1", *rest), (None, prose(3), "en", "s1", *rest)]


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def class_of(ch):
    if ord(ch) > 127:
        return "beyond"
    for name, pattern in (("lower", "[a-z]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("blank", "[ \t]"), ("newline", "[\r\n]"),
                          ("mark", r"[.,;:!?'\"()\-]"), ("symbol", "[!-~]")):
        if re.fullmatch(pattern, ch):
            return name
    return "control"


def distance(p, q):
    """Jensen-Shannon distance by entropies."""
    def entropy(d):
        return -sum(v * math.log2(v) for v in d.values() if v)
    p, q = ({k: v / sum(d.values()) for k, v in d.items()} for d in (p, q))
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2))


def verdicts(rows, limits=Limits()):
    """(base_failed, class distance, word distance, kept) of each row."""
    classes, counts = {}, {}
    for _, t, lang, *_ in rows:
        own = Counter(map(class_of, t or ""))
        for k, n in own.items():
            at = classes.setdefault(lang, Counter())
            at[k] += n / sum(own.values())
        counts.setdefault(lang, Counter()).update(words_of(t))
    out = []
    for _, t, lang, *_ in rows:
        w, total = words_of(t), sum(counts[lang].values())
        windows = Counter(zip(w, w[1:], w[2:]))
        repeated = {p + s for p in range(len(w) - 2) if windows[tuple(w[p:p + 3])] > 1 for s in range(3)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        def common(c):
            kept = {x: n for x, n in c.items() if counts[lang][x] >= limits.common_share * total}
            return {**kept, None: sum(c.values()) - sum(kept.values())}
        by_class = distance(Counter(map(class_of, t)), classes[lang]) if len(t or "") >= limits.min_chars else None
        by_word = distance(common(Counter(w)), common(counts[lang])) if len(w) >= limits.min_words else None
        out.append((failed, by_class, by_word, not failed and (by_class or 0) <= limits.class_distance and (by_word or 0) <= limits.word_distance))
    return out


def good_ones(rows):
    return [r for r, (*_, kept) in zip(rows, verdicts(rows)) if kept]


def lines_once(rows):
    def key(line):
        return low(line.strip(BLANK))
    holders = {}
    for i, t, *_ in rows:
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(-math.inf if i is None else i)
    out = []
    for i, t, *rest in rows:
        stay = [x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, "\n".join(stay), *rest))
    return out


def one_a_group(rows, keys):
    def shingles(t):
        w = words_of(low(t))
        return {tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    first = {q: min((r[0] is None, r[0] or 0, k, i) for i, (r, x, k) in enumerate(zip(rows, root, keys)) if x == q)[3] for q in root}
    return [r for i, (r, q, s) in enumerate(zip(rows, root, sets)) if not s or first[q] == i]


def row_keys(spark, rows):
    frame = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "at int, doc_id long, text string")
    return [r["k"] for r in frame.select("at", row_key(F.col("doc_id"), F.col("text")).alias("k")).orderBy("at").collect()]


def without_items(rows, items):
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for _, t in items:
        w = word.findall(low(t or ""))
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    out = []
    for i, t, *rest in rows:
        total, cut = len(word.findall(low(t))), 0
        while True:
            found = list(word.finditer(low(t)))
            w = [m[0] for m in found]
            hit = {k + s for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows for s in range(n)}
            if not hit:
                break
            cut += len(hit)
            for first in sorted((k for k in hit if k - 1 not in hit), reverse=True):
                last = first
                while last + 1 in hit:
                    last += 1
                t = t[:found[first].start()] + t[found[last].end():]
        if cut <= total / 2:
            out.append((i, t, *rest))
    return out


def mixed(rows):
    size = [len(words_of(r[1])) for r in rows]
    held = Counter()
    for r, n in zip(rows, size):
        held[r[3]] += n
    names = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    goal, free, left = {}, set(names), sum(size)
    while free:                                          # fill, take out what is above its cap, share again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * held[s]}
        for s in full or free:
            goal[s] = 3 * held[s] if full else level * weight[s]
        left -= sum(3 * held[s] for s in full)
        free = free - full if full else set()
    out, before = [], Counter()
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"mix|{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), rows[k][1]))
    for k in order:
        s = rows[k][3]
        epochs, rest = divmod(math.floor(goal[s]), held[s]) if held[s] else (0, 0)
        took = epochs * size[k] + min(max(rest - before[s], 0), size[k])
        before[s] += size[k]
        if took:
            out.append((rows[k][0], s, size[k], held[s], round(goal[s], 6), took))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(1, ITEM), (2, None), (3, ""), (4, ITEM)]
    spark.createDataFrame(planted(), SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def test_quality_verdicts_against_plain_python(spark):
    rows = planted()
    got = Counter()
    for r in judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got[r["doc_id"], r["base_failed"], *(x if x is None else round(x, 6) for x in (r["class_distance"], r["word_distance"])), r["kept"]] += 1
    want = Counter((r[0], failed, *(x if x is None else round(x, 6) for x in two), kept) for r, (failed, *two, kept) in zip(rows, verdicts(rows)))
    assert got == want
    kept = {r[0] for r in good_ones(rows)}
    assert not kept & {24, 25, 26, 27, 28, 29} and {*range(1, 13), 20, 21, 22, 23, 30, 32} <= kept


def test_every_stage_against_plain_python(spark, tables):
    at, items = tables
    docs, rows = spark.read.parquet(f"{at}/documents.parquet"), planted()
    plain = [good_ones, lines_once, lambda x: one_a_group(x, row_keys(spark, x)), lambda x: without_items(x, items), mixed]
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, plain)):
        made, rows = stage(spark, docs, at), expected(rows)
        if k + 1 < len(plain):
            assert made.columns == docs.columns
            docs = corpus_pipeline.written(made, f"test-{name}")
            assert Counter(map(tuple, docs.collect())) == Counter(rows), name
    want = Counter(rows)
    assert {r[0] for r in rows}.isdisjoint({3, 20, 23, 31})     # line dedup left the lines of 3 and 20 in 21
    got = corpus_pipeline.run(spark, at).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter((*r[:4], round(r[4], 6), r[5]) for r in map(tuple, got)) == want


def test_empty_tables(spark, tables, tmp_path):
    at, _ = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{at}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
