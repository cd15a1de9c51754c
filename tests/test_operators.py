"""Small situations with known answers, and laws checked against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import clock, errors, names, text as tx
from reelgrid.functions.fixed_values import CLAIM_EXPIRED
from reelgrid.operators import intervals as iv, joins as jn, ledgers as lg, marts as mt, selection as sel, shaping as sh, signals as sg, transcripts as tr
from reelgrid.operators.scan import last_value, next_value, row_number, running_max, running_sum, scan, time_chunk

K = ["k"]


def spans(spark, seed, n=120, top=400, most=30):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.randrange(top)
        rows.append((r.randrange(3) if i % 3 else 0, i, s, s + 1 + r.randrange(most), r.randrange(60)))   # key 0 is hot
    return rows, spark.createDataFrame(rows, "k long, id long, s long, e long, score long")


def brute_union(rows):
    out = {}
    for k, _, s, e, _ in sorted(rows, key=lambda x: (x[0], x[2], x[3])):
        cur = out.setdefault(k, [])
        if cur and s <= cur[-1][1]:
            cur[-1][1] = max(cur[-1][1], e)
        else:
            cur.append([s, e])
    return {(k, s, e) for k, v in out.items() for s, e in v}


def test_scan_equals_plain_running_values(spark):
    rows, df = spans(spark, 1)
    got = scan(df, K, ["s", "id"], time_chunk("s", 7), n=row_number(), tot=running_sum(F.col("e")), before=running_sum(F.col("e"), False),
               far=running_max(F.col("e"), False), prev=last_value(F.when(F.col("score") % 3 == 0, F.col("id")), False), nxt=next_value(F.col("id"))).collect()
    for key in range(3):
        seq = sorted((x for x in got if x.k == key), key=lambda x: (x.s, x.id))
        for i, x in enumerate(seq):
            old = seq[:i]
            marked = [y.id for y in old if y.score % 3 == 0]
            assert (x.n, x.before, x.tot) == (i + 1, sum(y.e for y in old), sum(y.e for y in old) + x.e)
            assert x.far == (max(y.e for y in old) if old else None)
            assert x.prev == (marked[-1] if marked else None)
            assert x.nxt == (seq[i + 1].id if i + 1 < len(seq) else None)


@pytest.mark.parametrize("chunk", [5, 1000])
def test_merge_is_the_union(spark, chunk):
    rows, df = spans(spark, 2)
    got = {(r.k, r.s, r.e) for r in iv.merge_ranges(df, K, "s", "e", chunk).collect()}
    assert got == brute_union(rows)


def test_subtract_and_cover(spark):
    wins, w = spans(spark, 3, 60, 400, 80)
    used, u = spans(spark, 4, 40)
    left = iv.subtract_ranges(w, u.select("k", F.col("s").alias("us"), F.col("e").alias("ue")), K, "s", "e", "us", "ue", 50, 20, 2, 3).collect()
    blocked = {}
    for k, s, e in brute_union(used):
        blocked.setdefault(k, set()).update(range(s - 2, e + 2))
    want = set()
    for k, i, s, e, _ in wins:
        run = None
        for t in range(s, e + 1):
            free = t < e and t not in blocked.get(k, ())
            if free and run is None:
                run = t
            elif not free and run is not None:
                if t - run >= 3:
                    want.add((i, run, t))
                run = None
    assert {(r.id, r.piece_s, r.piece_e) for r in left} == want
    cov = iv.covered_length(w, u.select("k", F.col("s").alias("us"), F.col("e").alias("ue")), K, ["id"], ("s", "e"), ("us", "ue"), 50, 20).collect()
    plain = {}
    for k, s, e in brute_union(used):
        plain.setdefault(k, set()).update(range(s, e))
    assert all(r.covered == len([t for t in range(r.s, r.e) if t in plain.get(r.k, ())]) for r in cov)


def brute_greedy(rows, rank, num, den):
    kept = []
    for x in sorted(rows, key=rank):
        clash = any(y[0] == x[0] and min(x[3], y[3]) > max(x[2], y[2])
                    and (min(x[3], y[3]) - max(x[2], y[2])) * den > num * min(x[3] - x[2], y[3] - y[2]) for y in kept)
        if not clash:
            kept.append(x)
    return {x[1] for x in kept}


@pytest.mark.parametrize("fold_rows", [10**6, 3])
@pytest.mark.parametrize("by_start", [True, False])
def test_greedy_both_ways(spark, fold_rows, by_start):
    rows, df = spans(spark, 5)
    df = df.withColumn("neg", -F.col("score"))
    rank, order = ((lambda x: (x[2], x[1])), ["s", "id"]) if by_start else ((lambda x: (-x[4], x[1])), ["neg", "id"])
    got = iv.greedy_non_overlap(df, K, ["id"], "s", "e", order, (25, 100), 40, 15, by_start, fold_rows)
    assert {r.id for r in got.collect()} == brute_greedy(rows, rank, 25, 100)


def test_overlap_join_and_nearest(spark):
    a, da = spans(spark, 6, 60)
    b, db = spans(spark, 7, 60)
    pairs = jn.overlap_join(da.select("k", F.col("id").alias("i"), "s", "e"), db.select("k", F.col("id").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2")), K, ("s", "e"), ("s2", "e2"), 9).collect()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])
    assert sorted((r.i, r.j) for r in pairs) == want
    near = jn.nearest_edges(da.select("k", "id", "e"), db.select("k", F.col("s").alias("edge")), K, "e", "edge", 30).collect()
    for r in near:
        edges = [y[2] for y in b if y[0] == r.k]
        assert r.nearest == min(edges, key=lambda v: (abs(v - r.e), v))


def test_spacing(spark):
    rows, df = spans(spark, 8)
    got = {(r.k, r.s) for r in iv.min_spacing(df, K, "s", ["id"], 7, 50).collect()}
    want = set()
    for key in range(3):
        last = None
        for s in sorted({x[2] for x in rows if x[0] == key}):
            if last is None or s - last >= 7:
                want.add((key, s))
                last = s
    assert got == want


@pytest.mark.parametrize("scores,parts,kept", [((60, 58, 55), 0, {60, 58, 55}), ((80, 30), 0, {80}), ((5, 4), 0, {5}), ((0, 0), 0, {0}),
                                               ((80, 45, 40), 3, {80, 45, 40}), ((50, 90, 70, 60), 2, {90, 70}), ((70, 5), 3, {70})])
def test_adaptive_floor(spark, scores, parts, kept):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "k long, id long, score long")
    assert {r.score for r in sel.adaptive_floor(df, K, "score", "id", parts=parts).collect()} == kept


def test_intro_outro(spark):
    rows = [(1, 1, 1, 20, 1000), (1, 2, 300, 380, 1000), (1, 3, 980, 999, 1000), (2, 4, 10, 200, 1000), (3, 5, 1, 20, 1000)]
    df = spark.createDataFrame(rows, "k long, id long, s long, e long, d long")
    assert {r.id for r in sel.intro_outro(df, K, "s", "e", "d").filter("kept").collect()} == {2, 4, 5}


def test_loud_islands(spark):
    rows = [(1, i, 50) for i in range(30)] + [(2, i, 90 if 8 <= i < 12 else 10) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, sec long, rms long")
    assert [(r.k, r.from_sec, r.to_sec) for r in sg.loud_islands(df, K, 5).collect()] == [(2, 8, 12)]


def test_panel_median(spark):
    df = spark.createDataFrame([(1, 0, 80, ""), (1, 1, 70, "b"), (1, 2, 10, "c")], "k long, judge int, score long, reason string")
    r = sel.panel_score(df, K).first()
    assert (r.score, r.votes, r.reason) == (70.0, 3, "b")
    old = spark.createDataFrame([(1, 5.0), (2, 40.0)], "k long, old_score double")
    kept = sel.panel_score(df, K, old).orderBy("k").collect()
    assert [(r.k, r.score, r.votes, r.reason) for r in kept] == [(1, 70.0, 3, "b"), (2, 40.0, 0, None)]


def test_expired_claim_keeps_its_note(spark):
    rows = [(1, 10, "taken", "a", 0, None), (2, 20, "taken", None, 0, None), (3, 30, "taken", "b", 0, None), (4, 40, "done", "c", 0, 7)]
    df = spark.createDataFrame(rows, "ledger_id long, video_id long, status string, note string, taken_at long, done_at long")
    busy = spark.createDataFrame([(30,)], "video_id long")
    got = {r.ledger_id: (r.status, r.note, r.done_at) for r in lg.expire_claims(df, busy, 50_000).collect()}
    assert got == {1: ("error", "a" + CLAIM_EXPIRED, 50_000), 2: ("error", CLAIM_EXPIRED, 50_000), 3: ("taken", "b", None), 4: ("done", "c", 7)}


def extended(clips, sents, target, most):
    """What is added to each clip, sentence by sentence."""
    out = set()
    for k, c, end, total in clips:
        for _, _, s, e, junk in sorted((x for x in sents if x[0] == k), key=lambda x: (x[2], x[1])):
            if e <= end + 50:
                continue
            begin = end if s - end <= 6000 else s
            if total >= target or s - end > 8000 or junk or total + e - begin > most + 500:
                break
            out.add((k, c, begin, e))
            total, end = total + e - begin, e
    return out


def test_extension_reaches_the_whole_target(spark):
    far = [(0, i, 10_000 + i * 7400 + 7000, 10_000 + i * 7400 + 7400, False) for i in range(80)]     # 0.4 s of speech after each 7 s
    r = random.Random(4)
    sents, at = list(far), 0
    for i in range(400):
        at += r.choice((0, 40, 300, 3000, 5960, 6010, 7000, 7990, 9000)) if r.random() < .7 else -r.randrange(200)
        s = max(at, 0)
        at = s + r.choice((20, 60, 400, 2500))
        sents.append((1, i, s, at, r.random() < .02))
    clips = [(0, 0, 10_000, 10_000)] + [(1, i, sents[80 + i][3] + r.choice((0, 0, 30, 4000)), r.randrange(35_000)) for i in range(0, 400, 3)]
    got = sh.extend_to_target(spark.createDataFrame(clips, "k long, clip long, last_e long, total long"),
                              spark.createDataFrame(sents, "k long, idx long, start_ms long, end_ms long, junk boolean"), K, "clip", 30_000, 60_000, 60_000).collect()
    rows = {(x.k, x.clip, x.piece_s, x.piece_e) for x in got}
    assert len(rows) == len(got) and rows == extended(clips, sents, 30_000, 60_000)
    assert sum(e - s for k, _, s, e in rows if k == 0) == 20_000


def test_invented_speech(spark):
    rows = [(1, "Thank you. .", 3, 40_000), (2, "we went down to the harbour and found the old boat there " * 4, 48, 20_000), (3, "", 0, 10_000),
            (4, "Thanks for watching! Please subscribe", 45, 60_000), (5, "Thank you", 2, 0)]
    df = spark.createDataFrame(rows, "id long, text string, w long, d long")
    got = {r.id: r.speech for r in tr.speech_presence(df, "id", "text", "w", "d").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_junk_phrases(spark):
    junk = ["Don't forget to SUBSCRIBE!", "Hey guys, what's new", "this video is sponsored by", "チャンネル登録お願いします", "watch my previous video", "подписывайтесь"]
    fine = ["I sponsored-ish my friend", "my patron saint", "the previous video game was fun", "we like to share food"]
    df = spark.createDataFrame([(t, True) for t in junk] + [(t, False) for t in fine[1:]], "t string, want boolean")
    bad = df.filter(tx.is_junk(tx.norm_text(F.col("t"))) != F.col("want")).collect()
    assert bad == []


def test_retellings(spark):
    said = spark.createDataFrame([(1, 0, 0, 8000, "The moment I touched the valve I heard a really loud hiss")], "k long, idx long, start_ms long, end_ms long, text string")
    told = spark.createDataFrame([(1, 0, 9000, 12_000, "The moment he touches the valve, a loud hiss is heard"), (1, 1, 9000, 12_000, "Nobody dared imagine how badly tonight would explode"),
                                  (1, 2, 60_000, 61_000, "The moment he touches the valve")], "k long, part long, start_ms long, end_ms long, text string")
    got = {r.part: r.retold for r in tr.verbatim_and_retold(told, said, K, 5000).collect()}
    assert got[0] is True and got[1] is False and 2 not in got


def test_copied_lines(spark):
    docs = spark.createDataFrame([(1, "so then the cat sat down on the warm mat again today"), (2, "other words entirely here")], "d long, text string")
    lines = spark.createDataFrame([(1, "The cat sat down, on the WARM mat"), (2, "at sat down on"), (3, "he cat sat down"), (4, "warm cat sat upon the mat")], "i long, text string")
    assert {(r.i, r.d) for r in tr.copied_lines(lines, docs, "i", "d").collect()} == {(1, 1), (3, 1)}


def test_error_text(spark):
    rows = [("Please try again in 7m30.5s 429", "day", 450.5), ("429 try again in 32s", "minute", 32.0), ("rate limit in 232ms", "minute", 0.232), ("HTTP 401", "auth", None),
            ("413 Request too large 429", "too_large", None), ("Organization has been restricted", "restricted", None), ("429", "rate", None), ("Connection error.", "transient", None), ("boom", "other", None)]
    df = spark.createDataFrame(rows, "t string, cls string, w double")
    for r in df.select("cls", "w", errors.error_class(F.col("t")).alias("c"), errors.retry_wait_s(F.col("t")).alias("x")).collect():
        assert r.c == r.cls and (r.x == r.w or abs(r.x - r.w) < 1e-9)


def test_file_states_and_times(spark):
    df = spark.createDataFrame([("a.mp4", 5, 0, "ready"), ("a.mp4", 5, 90, "busy"), ("a.mp4", 0, 0, "zero_old"), ("a.mp4.part", 5, 0, "tmp"), ("a.f12.mp4", 5, 0, "tmp"),
                                ("Part 3 x.mp4", 5, 0, "part"), ("a.txt", 5, 0, "other")], "n string, z long, m long, want string")
    assert df.filter(names.file_state(F.col("n"), F.col("z"), F.col("m"), 100) != F.col("want")).count() == 0
    t = spark.createDataFrame([("1785000000.0", 1785000000), ("2024-01-01 00:00:10", 1704067210), ("2024-01-01T00:00:10Z", 1704067210), ("junk", None), ("", None)], "t string, want long")
    assert t.filter(~clock.parse_epoch(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_stranded(spark):
    led = spark.createDataFrame([(i, 1, i, "taken") for i in range(1, 7)], "ledger_id long, channel_id long, video_id long, status string")
    clips = spark.createDataFrame([(i, "exported" if i == 6 else "suggested") for i in range(1, 8)], "video_id long, status string")
    jobs = spark.createDataFrame([(3, "export", "canceled"), (4, "export", "running"), (5, "analyze", "pending")], "video_id long, type string, status string")
    assert {r.video_id for r in lg.stranded_videos(led, clips, jobs).collect()} == {1, 2}


def test_retention(spark):
    day, now = 86_400, 100 * 86_400
    a = spark.createDataFrame([(1, "here", 10), (2, "gone", 20), (3, "gone", 30), (4, "gone", 40), (2, "gone", 5)], "video_id long, src string, bytes long")
    c = spark.createDataFrame([(1, 0, "done"), (2, 0, "done"), (2, 1, "done"), (3, now - 2 * day, "done"), (4, 0, "suggested")], "video_id long, created_at long, status string")
    files = spark.createDataFrame([("here",)], "path string")
    assert [(r.video_id, r.bytes) for r in mt.retention_candidates(a, c, files, now, 30).collect()] == [(2, 25)]


def test_fingerprint(spark, tmp_path):
    import hashlib
    from reelgrid.sources.tables import fingerprint_files, list_media_files
    body = bytes(range(256)) * (3 * 4096)
    (tmp_path / "ch").mkdir()
    (tmp_path / "ch" / "a.mp4").write_bytes(body)
    (tmp_path / "ch" / "b.MKV").write_bytes(b"xy")
    got = {r.name: r.file_hash for r in fingerprint_files(list_media_files(spark, str(tmp_path)), 2).collect()}
    mib = 1 << 20
    assert got == {"a.mp4": hashlib.sha1(str(len(body)).encode() + body[:mib] + body[-mib:]).hexdigest()[:16],
                   "b.MKV": hashlib.sha1(b"2xy").hexdigest()[:16]}


def test_every_phrase_pattern_has_a_needed_text():
    from reelgrid.functions import fixed_values as fv
    for p in fv.CTA_PATTERNS + fv.GREETING_PATTERNS + fv.PROMO_PATTERNS:
        assert all(len(x) >= 2 for x in tx.needed_texts(p)), p
    assert tx.needed_texts(r"(?:a|the)\s+(?:\S+\s+){0,3}?(?:subscribers|subs)\b") == ["subscribers", "subs"]
    assert tx.required_literal(r"(?:hit|ring|tap)\s+th(?:at|e)\s+bell") == "bell"
    assert tx.required_literal(r"ご?視聴(?:ありがとう)") == "視聴"
    assert tx.required_literal(r"colou?r") == "colo"


def test_scan_keeps_null_keys_and_times(spark):
    from reelgrid.operators.scan import row_number, scan, time_chunk
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 5), (None, None)], "k string, t int")
    got = scan(rows, ["k"], ["t"], time_chunk("t", 10), rn=row_number()).collect()
    assert sorted((r["k"] or "", r["t"] or 0, r["rn"]) for r in got) == [("", 0, 1), ("", 5, 2), ("a", 0, 1), ("a", 1, 2)]


def made(spark, folder, name, cols, rows):
    spark.createDataFrame(rows, cols).write.parquet(f"{folder}/{name}.parquet")


def test_ids_past_the_mixed_number_stay_apart(spark, tmp_path):
    from reelgrid.plans import activity_marts as am
    day = datetime.date(2000, 1, 1)
    # order * 10,000 + supplier would be 20,001 for order 1 of supplier 10,001 and for order 2 of supplier 1
    made(spark, tmp_path, "lineitem", "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date",
         [(1, 1, 10_001, 1, 1.0, 10.0, "N", day), (2, 1, 1, 1, 1.0, 20.0, "N", day), (3, 1, 10_001, 1, 1.0, 30.0, "A", day), (4, 1, 1, 1, 1.0, 40.0, "N", day)])
    made(spark, tmp_path, "part", "p_partkey long, p_size long", [(9, 30)])
    made(spark, tmp_path, "events", "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string",
         [(2, 1, "view", datetime.datetime(2024, 1, 1), 1.0, '{"k": 3}')])
    assert [tuple(r) for r in am.retention_candidates(spark, str(tmp_path)).collect()] == [(3, 10_001, 30)]
    assert sorted(tuple(r) for r in am.reanalysis_due(spark, str(tmp_path)).collect()) == [(1, 10_001, 0), (2, 1, 1), (4, 1, 0)]


def test_words_past_the_mixed_number_keep_their_turn(spark, tmp_path):
    from reelgrid.plans import caption_cues as cc
    made(spark, tmp_path, "conversations", "conv_id string, turn long, role string, text string", [("c", 0, "u", "a " * 100_001), ("c", 1, "u", "b c")])
    got = [(r["token"], r["a"]) for r in cc.align_tokens(spark, str(tmp_path)).filter("idx = 1").orderBy("i").collect()]
    start = 60 * 200_002
    assert got == [("b", start), ("c", start + 90 + 200)]


def test_speech_under_every_island_is_told(spark, tmp_path):
    from reelgrid.plans import signal_islands as si
    start = datetime.datetime(2024, 1, 1)
    made(spark, tmp_path, "events", "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string",
         [(i, 1, "view", start + datetime.timedelta(seconds=i), 50.0 + i / 10 if i % 10 in (3, 4) else 1.0, '{"k": 1}') for i in range(50)])
    made(spark, tmp_path, "conversations", "conv_id long, turn long, role string, text string", [(1, 0, "u", "word " * 200)])
    got = si.loud_speech_evidence(spark, str(tmp_path)).collect()
    assert sorted((r["rank"], r["from_sec"], r["to_sec"]) for r in got) == [(i + 1, 43 - 10 * i, 45 - 10 * i) for i in range(5)]


def test_relative_times_of_future_and_null(spark, tmp_path):
    from reelgrid.plans import activity_marts as am
    made(spark, tmp_path, "events", "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string",
         [(i, 1, "view", ts, 1.0, '{"k": 1}') for i, ts in enumerate([datetime.datetime(2030, 1, 1), None])])
    assert sorted(tuple(r) for r in am.relative_times(spark, str(tmp_path)).collect()) == [(0, "just now"), (1, "")]
