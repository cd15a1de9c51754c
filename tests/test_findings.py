"""Cases from reviews of larger and odd tables."""

import datetime
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import fixed_values as fv, text as tx
from reelgrid.operators import cues as cu, intervals as iv, selection as sel, shaping as sh
from reelgrid.plans import load_all
from reelgrid.plans.registry import ORACLE, QUERIES


def held_to_sql(spark, tmp_path, name, rows, **tables):
    """The query and its SQL over small tables agree; `rows` is how many rows that is."""
    load_all()
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    have = sorted(tuple(r[c] for c in cols) for r in got.collect())
    cur = con.execute(ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert have == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    assert len(have) == rows


def turns(spark, *lengths):
    """One conversation; a turn is as many characters long as told."""
    rows = [(1, i, "assistant" if i % 2 else "user", "x" * n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_joins_of_parts_shorter_than_their_shift(spark, tmp_path):
    held_to_sql(spark, tmp_path, "narrated_join_kinds", 5, conversations=turns(spark, 330, 13, 746, 7, 300, 12))


def lines(spark, *rows):
    """Line items: order, line, supplier, day, quantity, price, flag."""
    start = datetime.datetime(1995, 1, 1)
    return spark.createDataFrame([(o, 5, s, n, float(q), float(p), f, start + datetime.timedelta(days=d)) for o, n, s, d, q, p, f in rows],
                                 "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_returnflag string, l_shipdate timestamp_ntz")


# the first two of an order have one clip number: a supplier more is worth 7,919 of the price
TWINS = [(1, 1, 3, 0, 9, 10059, "N"), (1, 1, 4, 40, 9, 2140, "N"), (1, 2, 9, 80, 5, 10019, "N"), (1, 3, 9, 200, 9, 232, "N"),
         (2, 1, 3, 0, 9, 10049, "N"), (2, 1, 4, 40, 9, 2130, "N")]


@pytest.mark.parametrize("name,rows", [("adaptive_floor", 2), ("adaptive_floor_parts", 3), ("quality_floor", 2)])
def test_clips_of_one_number_are_told_apart(spark, tmp_path, name, rows):
    held_to_sql(spark, tmp_path, name, rows, lineitem=lines(spark, *TWINS))


def test_a_clip_number_gives_one_clip(spark, tmp_path):
    load_all()
    lines(spark, *TWINS).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["annotate_clips"](spark, str(tmp_path)).collect()
    assert len(got) == len({r.clip_id for r in got}) == 4


@pytest.mark.parametrize("name", ["join_kinds", "climax_joins"])
def test_segments_of_one_number_have_one_order(spark, tmp_path, name):
    load_all()
    got = []
    for i, rows in enumerate([TWINS, TWINS[::-1]]):
        lines(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        got.append(sorted(map(tuple, QUERIES[name](spark, f"{tmp_path}/{i}").collect())))
    assert got[0] == got[1] and len(got[0]) == 4


@pytest.mark.parametrize("fold_rows", [10**6, 0])
def test_shared_footage_both_ways(spark, fold_rows):
    r = random.Random(7)
    rows = [(i % 2, r.randrange(25), a, a + 1 + r.randrange(40), r.randrange(9)) for i in range(160) for a in [r.randrange(900)]]
    want = set()
    for k in (0, 1):
        clips = {c: [(a, b) for v, x, a, b, _ in rows if (v, x) == (k, c)] for v, c, *_ in rows if v == k}
        best = {c: max(z for v, x, _, _, z in rows if (v, x) == (k, c)) for c in clips}
        size, kept = {c: sum(b - a for a, b in clips[c]) for c in clips}, []
        for c in sorted(clips, key=lambda c: (-best[c], c)):
            if all(100 * sum(max(0, min(b, d) - max(a, f)) for a, b in clips[c] for f, d in clips[o]) <= 15 * min(size[c], size[o]) for o in kept):
                kept.append(c)
        want |= {(k, c, size[c], best[c]) for c in kept}
    df = spark.createDataFrame(rows, "k long, c long, s long, e long, score long")
    got = iv.drop_shared_footage(df, ["k"], "c", "s", "e", "score", 50, fold_rows=fold_rows)
    assert {tuple(x) for x in got.select("k", "c", "length", "score").collect()} == want and len(want) > 4


def test_shared_footage_writes_no_pairs(spark, tmp_path):
    """All segments of one video and one time: pairs would be the square of them."""
    from reelgrid.operators import intervals
    seen = []
    real = intervals.checkpointed
    intervals.checkpointed = lambda df: seen.append(real(df)) or seen[-1]
    try:
        df = spark.range(3000).selectExpr("id % 2 as k", "id as c", "0L as s", "10L as e", "id % 7 as score")
        assert iv.drop_shared_footage(df, ["k"], "c", "s", "e", "score", 50).count() == 2
    finally:
        intervals.checkpointed = real
    assert sum(x.count() for x in seen) < 3000


def pared(pieces, heard, floor, most):
    """The walk over the ends of one clip, sentence by sentence; `heard`: start, end, junk."""
    for back in (False, True):
        for _ in range(most):
            inside = [h for h in heard if any(h[1] > a and h[0] < b for a, b in pieces)]
            if not inside:
                break
            s, e, junk = max(inside) if back else min(inside)
            a, b = pieces[-1 if back else 0]
            new = pieces[:-1] + [(a, min(b, s))] if back else [(max(a, e), b)] + pieces[1:]
            new = [(x, y) for x, y in new if y - x >= 1000]
            if not (junk and s < b - 10 and e > a + 10 and sum(y - x for x, y in new) >= floor):
                break
            pieces = new
    return pieces


def test_junk_over_the_gap_of_two_pieces_is_taken_from_each(spark):
    r = random.Random(5)
    segs, said, want = [], [], set()
    for k in range(120):
        at, heard = 0, []
        while at < 60_000:
            heard.append((at, at + r.choice([700, 3000, 9000, 14_000]), r.random() < 0.75))
            at = heard[-1][1]
        cuts = sorted(r.sample(range(2000, 58_000, 500), 4))
        pieces = [p for p in [(r.randrange(1500), cuts[0]), (cuts[1], cuts[2]), (cuts[3], 60_000)] if p[1] - p[0] >= 1000]
        segs += [(k, 0, a, b) for a, b in pieces]
        said += [(k, i, *h) for i, h in enumerate(heard)]
        want |= {(k, i, *p) for i, p in enumerate(pared(pieces, heard, 15_000, 3))}
    got = sh.trim_junk_edges(spark.createDataFrame(segs, "k long, c long, s_ms long, e_ms long"),
                             spark.createDataFrame(said, "k long, idx long, start_ms long, end_ms long, junk boolean"), ["k"], "c", 7000)
    assert {tuple(x) for x in got.select("k", "seg_idx", "s_ms", "e_ms").collect()} == want


def test_a_reply_is_applied_in_few_shuffles(spark):
    items = spark.range(40).selectExpr("id % 5 as k", "id div 5 as idx")
    reply = spark.createDataFrame([(0, 0, 3, True), (0, 1, 3, False), (0, 2, 9, True), (1, 0, 2, False), (1, 1, 4, True), (1, 2, 1, None)]
                                  + [(2, i, i, False) for i in range(8)] + [(3, 0, 6, False)], "k long, pos long, idx long, usable boolean")
    out = sel.reorder_by_keep(items, reply, ["k"], 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 10
    got = {k: [r.idx for r in sorted(out.collect(), key=lambda r: r["rank"]) if r.k == k] for k in range(5)}
    assert got == {0: [3, 0, 1], 1: [4, 1, 0], 2: [0, 1, 2], 3: [6, 0, 1], 4: list(range(8))}


def test_dealt_texts_travel_twice(spark):
    """To the islands and to the sums of one; the text of a group is not shuffled again for a carry or a total."""
    texts = spark.createDataFrame([(1, "aa b cc d eee f g h ii")], "k long, text string")
    islands = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 2000, 4000)], "k long, isl long, s_ms long, e_ms long")
    out = cu.deal_to_islands(texts, islands, ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("array_join") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, "aa b cc d", 0, 1000), (1, 1, "eee f g h", 2000, 3636), (1, 2, "ii", 3636, 4000)]


@pytest.mark.parametrize("copies", [1, 6])
def test_used_pass_does_not_ask_how_often_a_range_is_told(spark, tmp_path, copies):
    """Rows of equal times: the SQL numbers its runs over ties, which its order leaves open; the union does not see them."""
    load_all()
    once = lines(spark, *[(o, 1 + o % 7, 3, o * 11 % 400, 1 + o * 7 % 50, 10059, "NAN"[o % 3]) for o in range(90)])
    once.write.parquet(f"{tmp_path}/one/lineitem.parquet")
    once.crossJoin(spark.range(copies)).drop("id").write.parquet(f"{tmp_path}/many/lineitem.parquet")
    one, many = (sorted(map(tuple, QUERIES["used_pass"](spark, f"{tmp_path}/{d}").collect())) for d in ("one", "many"))
    assert one == many and len(one) == 6


def test_texts_without_spaceless_scripts_are_counted_by_words_alone(spark):
    """The cheap test in front lets no spaceless character by, and both ways count alike."""
    edges = re.findall(r"\\x\{(\w+)\}", tx.SPACELESS)
    chars = "".join(chr(c) for a, b in zip(edges[::2], edges[1::2]) for c in range(int(a, 16), int(b, 16) + 1))
    assert re.fullmatch(re.sub(r"\\x\{(\w+)\}", r"\\u\1", tx._MAY_SPACELESS) + "+", chars)
    texts = ["", " ", "một hai  ba", "a\tb\x0bc\x1cd\u00a0e\u2003f", "字幕 ab字c", "ไทย x", "ཀ ཁག", "x\u3040y", "\uff66\uff9fz", "😀 😀a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("plain", "both"):
        c = F.col("t") if name == "plain" else F.concat("t", F.lit(" 字ab"))
        old = F.regexp_extract_all(c, F.lit(f"[{tx.SPACELESS}]|[^\\s{tx.SPACELESS}]+"), F.lit(0))
        for r in df.select(old.alias("old"), tx.tokens(c).alias("new"), tx.n_tokens(c).alias("n")).collect():
            assert r.new == r.old and r.n == len(r.old)


def test_a_phrase_meets_only_the_patterns_that_its_texts_allow(spark):
    """Patterns in one go and by the texts they need mark the same lines; a text in one line stands for each alternative."""
    every = fv.CTA_PATTERNS + fv.GREETING_PATTERNS + fv.PROMO_PATTERNS
    bits = sorted({x for p in every for x in tx.needed_texts(p)})
    texts = ["thanks so much for watching", "my last video game", "my last video", "hey y all", "路 大家好", "what s up guys"] + [f"a {x} guys" for x in bits]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.is_junk(F.col("t")).alias("new"), F.col("t").rlike(tx._any(every)).alias("old")).collect()
    assert [r.new for r in got] == [r.old for r in got] and 2 < sum(r.new for r in got) < len(got)
    assert max(len(v) for v in tx.by_need(every).values()) < 9


def test_free_time_is_not_dealt_to_buckets(spark):
    """Two short windows with all the time between them free: the free time itself is no row of a bucket."""
    far = 10**12
    w = spark.createDataFrame([(1, 0, 0, 10), (1, 1, far, far + 10), (None, 2, 0, 10)], "k long, id long, s long, e long")
    u = spark.createDataFrame([(1, 4, 5), (1, far - 9, far + 1)], "k long, us long, ue long")
    left = iv.subtract_ranges(w, u, ["k"], "s", "e", "us", "ue", 50, 20, 1, 2, walls=True)
    assert {tuple(x) for x in left.select("id", "piece_s", "piece_e", "floor", "wall").collect()} == {
        (0, 0, 3, None, 3), (0, 6, 10, 6, far - 10), (1, far + 2, far + 10, far + 2, None)}


def test_chapters_fit_alike_with_walls_told_and_found(spark):
    from reelgrid.operators import chapters as ch
    r = random.Random(3)
    cuts = [(k, a, s, s + r.randrange(3000, 40_000)) for k in range(3) for a in range(6) for s in range(a * 400_000, a * 400_000 + 390_000, r.choice([50_000, 130_000, 400_000]))]
    w = spark.createDataFrame(cuts, "k long, act long, s_ms long, e_ms long")
    u = spark.createDataFrame([(k, s, s + r.randrange(1, 9000)) for k in range(2) for s in r.sample(range(2_400_000), 60)], "k long, us long, ue long")
    e = spark.createDataFrame([(k, t) for k in range(3) for t in r.sample(range(2_400_000), 300)], "k long, edge_ms long")
    acts = w.select("k", "act").distinct().selectExpr("*", "act * 400000 as c0", "(act + 1) * 400000 as c1", "2500000L as duration")
    free = iv.subtract_ranges(w, u, ["k"], "s_ms", "e_ms", "us", "ue", 70_000, 9000, walls=True).selectExpr("k", "act", "piece_s as s_ms", "piece_e as e_ms", "floor", "wall")
    told, found = (sorted(map(tuple, ch.fit_chapters(x, acts, u, e, ["k"], "act", 60_000, 80_000, 70_000, 9000).collect())) for x in (free, free.drop("floor", "wall")))
    assert told == found and {x[-1] for x in told} == {"cut", "kept", "short", "stretched"}


def test_content_words_are_looked_up_and_cut_as_by_their_patterns(spark):
    r = random.Random(11)
    words = sorted({"".join(r.choice("abé𝒳") for _ in range(n)) + e for n in range(5) for e in ("", "ing", "ed", "es", "s", "ings", "sed") for _ in range(4)} | {"we", "the"})
    want = []
    for w in words:
        if w in fv.PRONOUNS:
            want.append("§p")
            continue
        end = next((e for e in ("ing", "ed", "es", "s") if re.search(f"^.{{3,}}{e}$", w)), "")
        w = w[:len(w) - len(end)]
        if len(w) > 1 and w not in {*fv.STOP_VI, *fv.STOP_EN, *fv.STOP_HI}:
            want.append(w)
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(tx.content_sequence(F.col("t")).alias("s"))
    assert df.collect()[0].s == want
    assert "array_contains" not in spark.range(1).selectExpr("string(id) as t").select(tx.content_sequence(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_three_words_of_the_own_span_are_a_run_over_a_sentence_that_ends_before(spark):
    from reelgrid.operators import transcripts as tr
    said = spark.createDataFrame([(1, 0, 0, 9000, "silver bridge"), (1, 1, 1000, 2000, "something"), (1, 2, 3000, 9000, "fallen rivers")],
                                 "k long, idx long, start_ms long, end_ms long, text string")
    told = spark.createDataFrame([(1, p, a, 9000, "Nobody knew which silver bridges fallen rivers hid") for p, a in enumerate((4000, 500))]
                                 + [(1, 2, 4000, 9000, "Nobody knew which silver bridge fallen men hid")], "k long, part long, start_ms long, end_ms long, text string")
    assert {(r.part, r.retold) for r in tr.verbatim_and_retold(told, said, ["k"], 5000).collect()} == {(0, False), (1, False), (2, True)}


@pytest.mark.parametrize("name", ["condense_lines", "char_chunks"])
def test_lines_are_packed_without_their_texts(spark, monkeypatch, name):
    from reelgrid.operators import packing as pk
    seen, real = [], pk.checkpointed
    monkeypatch.setattr(pk, "checkpointed", lambda df: seen.append(df.columns) or real(df))
    s = spark.createDataFrame([(k, i, i * 100, i * 100 + 100, c) for k in (1, 2, None) for i, c in enumerate(["aa", "b", " c ", "dddd"])],
                              "k long, idx long, start_ms long, end_ms long, text string")
    if name == "condense_lines":
        steps = spark.createDataFrame([(1, 200), (2, 0)], "k long, step long")
        got = {tuple(x) for x in pk.condense_lines(s, ["k"], 250, F.col("step"), steps).collect()}
        assert got == {(1, 1, 0, 200, "aa b"), (1, 3, 200, 400, "c dddd")} | {(2, i + 1, i * 100, i * 100 + 100, c) for i, c in enumerate(["aa", "b", "c", "dddd"])}
    else:
        got = pk.char_chunks(s.select("k", "idx", "text"), ["k"], ["idx"], F.lit(0), 6).collect()
        assert {(r.k, r.idx, r.text, r.bin) for r in got if r.k} == {(k, *x) for k in (1, 2) for x in [(0, "aa", 1), (1, "b", 1), (2, " c ", 3), (3, "dddd", 4)]}
        assert len(got) == 12
    assert seen and not any("text" in c for c in seen)


def test_tokens_are_timed_beside_their_script(spark):
    r, script, heard, want = random.Random(2), [], [], set()
    for k, (m, n) in enumerate([(1, 1), (7, 5), (5, 7), (40, 61), (30, 60), (12, 20), (9, 0), (3, 200)]):
        script.append((k, " ".join(f"w{i}" for i in range(m))))
        times = [(a, a + r.randrange(900)) for a in (r.randrange(5000) for _ in range(n))]
        heard += [(k, i, *t) for i, t in enumerate(times)]
        if n and abs(m - n) * 100 <= max(m, n) * 40:
            top = 0
            for i in range(m):
                lo = min(n - 1, i * n // m)
                top = max(top, times[lo][0])
                want.add((k, i, f"w{i}", top, max(top, times[min(n - 1, max(lo, (i + 1) * n // m - 1))][1])))
    r.shuffle(heard)
    out = cu.align_tokens(spark.createDataFrame(script, "video_id long, text string"),
                          spark.createDataFrame(heard, "video_id long, pos long, a long, b long"), ["video_id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4
    assert {tuple(x) for x in out.collect()} == want and len({x[0] for x in want}) == 5


def test_points_and_edges_are_sorted_one_way_only(spark):
    from reelgrid.operators import joins as jn
    r = random.Random(9)
    points = [(k, i, r.randrange(-50, 400)) for k in range(4) for i in range(60)]
    edges = {k: r.sample(range(400), n) for k, n in enumerate((12, 1, 2, 0))}
    df = spark.createDataFrame(points, "k long, id long, t long")
    out = jn.nearest_edges(df, spark.createDataFrame([(k, e) for k, v in edges.items() for e in v + v], "k long, e long"), ["k"], "t", "e", 30)
    sorts = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort [" in x and "id#" in x]
    assert sorts and not any("DESC" in x for x in sorts)
    want = {(k, i, t, min(edges[k], key=lambda e: (abs(e - t), e), default=None)) for k, i, t in points}
    assert {tuple(x) for x in out.select("k", "id", "t", "nearest").collect()} == want


def rows_of_sql(spark, tmp_path, name, lineitem):
    """Rows of the query and of its SQL, which may hold nulls and repeat."""
    load_all()
    lineitem.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    return Counter(tuple(r[c] for c in names) for r in got.collect()), Counter(cur.fetchall())


# two clips of one number and video on other days, one row told twice, two clips without a number; the used ranges have no ties
ODD = [(1, 1, 3, 0, 9, 10059, "N"), (1, 1, 3, 6, 9, 10059, "N"), (2, 1, 3, 2, 9, 500, "N"), (2, 1, 3, 2, 9, 500, "N"), (3, 1, 3, 4, 5, 0, "N"), (3, 2, 3, 90, 5, 0, "N"),
       (4, 1, 3, 3, 2, 77, "A"), (4, 2, 3, 8, 4, 78, "A"), (4, 3, 3, 11, 6, 79, "A")]


def test_covered_time_of_clips_of_one_number_and_of_none(spark, tmp_path):
    table = lines(spark, *ODD).withColumn("l_extendedprice", F.nullif("l_extendedprice", F.lit(0.0)))
    have, want = rows_of_sql(spark, tmp_path, "covered_fraction", table)
    assert have == want and sorted(r[-1] for r in want.elements()) == [0, 2000, 3000, 7000, 10000]


def test_fresh_candidates_of_odd_videos(spark, tmp_path):
    """Clips without a video are of one video, in which nothing is used; a clip without a length is not fresh."""
    more = [(5, 1, 0, 0, 9, 500, "N"), (5, 2, 0, 3, 2, 501, "N"), (5, 3, 0, 3, 2, 502, "A"), (6, 1, 8, 0, 4, 503, "N"), (6, 2, 8, 0, 5, 504, "A"),
            (7, 1, 9, 0, 0, 505, "N"), (7, 2, 9, 0, 4, 506, "N"), (7, 3, 9, 1, 5, 507, "A"), (8, 1, 7, 0, 0, 508, "N")]
    none = {"l_suppkey": 0, "l_quantity": 0.0, "l_extendedprice": 0.0}
    table = lines(spark, *ODD, *more).withColumns({c: F.nullif(c, F.lit(x)) for c, x in none.items()})
    have, want = rows_of_sql(spark, tmp_path, "filter_used_candidates", table)
    assert have == want and sorted((str(r[1]), *r[2:]) for r in want.elements()) == [
        ("3", 0, False), ("8", 4000, True), ("9", 0, True), ("9", 3000, True), ("None", 0, False), ("None", 0, False)]
