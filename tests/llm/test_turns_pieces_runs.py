"""Conversation repair, piece encoding and periodic runs against brute force and the library, on rows with nulls, ties, repeats, long
texts and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_format

import public_tokenizers
from reelgrid.llm import (ctw, decontaminate, divergence, licenses, line_dedup, mixing, periodic_runs, pieces, queries, recompression,
                          set_relations, turn_repair)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, seed long, ck string, `a.b` string, n_runs long, kind string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- periodic runs

def brute_runs(w, least, times):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, times * q) and not any(all(w[s + k] == w[s + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(2500):
        w = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(45))]
        w = periodic_runs.looped(w, rnd.randrange(900) * 10) if rnd.random() < .5 else w
        for least, times in ((6, 4), (4, 2), (3, 3)):
            assert [tuple(r) for r in periodic_runs.runs_of(w, least, times)] == brute_runs(w, least, times)


def brute_report(doc_id, text):
    w = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 6, 4)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def doc_rows():
    rnd = random.Random(9)
    texts = [None, "", " \t\n", "la " * 50, "a b " * 9 + "x", "one two three", "日本 " * 8, "x\x00y " * 7, "<s> </s> ▁ a▁b  c\r\n" * 2, "é" * 400]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(60)]
    rows = [(i, t, 3, "k", "v", 1, "x") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "b b b b b b b", 10, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3).cache()


def test_run_report_equals_brute_force(spark, docs, tmp_path):
    docs.select("doc_id", "text", "n_runs", "`a.b`").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_report(i, t) for i, t, *_ in doc_rows()), key=str)


def test_runs_of_long_text_string_ids_and_empty_table(spark):
    rows = [("a", "la " * 200_000), ("b", " ".join(str(i % 9973) for i in range(120_000)))]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(frame, with_text=True).collect()}
    assert (got["a"]["start"], got["a"]["length"], got["a"]["period"], got["a"]["collapsed_text"]) == (0, 200_000, 1, "la")
    assert (got["b"]["n_runs"], got["b"]["length"], got["b"]["period"], got["b"]["exponent_milli"]) == (1, 120_000, 9973, 12032)
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0


# ---- pieces

def library_spans(model, text):
    return [(p.id, p.begin, p.end) for p in model.encode(text, return_type="proto").pieces]


def own_spans(model, text):
    return list(zip(*[x.tolist() for x in model.encode(text.encode())]))


def random_texts(n, seed):
    rnd = random.Random(seed)
    alphabet = "ab the  in\n\t▁é漢字🙂<s></s>\x00 ﬁ①ＡǺ　\xa0\r…"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", " ", "   ", "▁", "\n", "a" * 999, " " * 300, "x" + " " * 99]


def test_spans_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    for text in random_texts(1500, 1):
        spans = own_spans(own, text)
        assert spans == library_spans(library, text)
        ids = [s[0] for s in spans] + [own.end]
        assert own.decode(ids) == library.decode(ids).encode()


def test_compiled_character_map_equals_the_library():
    rules = model_format.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    for squeeze in (False, True):
        for blank in (False, True):
            proto = model_format.ModelProto()
            with open(MODEL, "rb") as f:
                proto.ParseFromString(f.read())
            proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
            proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, blank
            library, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.PieceModel(proto.SerializeToString())
            for text in random_texts(700, 2):
                assert own_spans(own, text) == library_spans(library, text), (squeeze, blank, text)


def test_decoding_any_ids_equals_the_library():
    library, own, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL), random.Random(3)
    for _ in range(4000):
        ids = [rnd.choice([rnd.randrange(300), rnd.randrange(32000), 1, 2, 0, 259, 29871]) for _ in range(rnd.randrange(9))]
        assert own.decode(ids) == library.decode(ids).encode(), ids


def test_piece_query_equals_the_library(spark, docs, tmp_path):
    docs.select("doc_id", "text", "kind", "`a.b`").write.parquet(str(tmp_path / "documents.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def want(doc_id, text):
        ids = library.encode(text or "", add_eos=True)
        ends = np.array([p[2] for p in library_spans(library, text or "")], "<i8")
        return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), sha(ends.tobytes())

    got = queries.op12_piece_spans(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((want(i, t) for i, t, *_ in doc_rows()), key=str)


def test_pieces_of_long_text_and_empty_table(spark):
    long = "wörd " * 60_000 + "x" * 50_000
    frame = spark.createDataFrame([("a", long)], "doc_id string, text string")
    row = pieces.encode_texts(frame, MODEL, with_pieces=True).collect()[0]
    assert [p["id"] for p in row["pieces"]] + [2] == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(long, add_eos=True)
    assert row["pieces"][0]["begin"] == 0 and row["pieces"][-1]["end"] == len(long.encode())
    assert all(a["end"] == b["begin"] for a, b in zip(row["pieces"], row["pieces"][1:]))
    assert pieces.encode_texts(spark.createDataFrame([], DOCS), MODEL).count() == 0


# ---- conversations

PATTERN = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(0, ""): (0, "", ())}                     # (rows passed, initials up to two repeats) -> cheapest, least audit

    def shape(initials):                              # what matters of the initials: start, s, u, a
        return "" if not initials else initials[-1]
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    layer = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(6):                            # insertions
            for last, (cost, audit, out) in list(layer.items()):
                for c in nexts[last]:
                    if c != "s":
                        new = (cost + 3, audit + "I", (*out, ({"u": "user", "a": "assistant"}[c], "")))
                        if c not in layer or new[:2] < layer[c][:2]:
                            layer[c] = new
        if i == len(rows):
            break
        _, role, text = rows[i]
        late = 3 if faults[i] == "truncated" else 0
        after = {}

        def offer(last, new):
            if last not in after or new[:2] < after[last][:2]:
                after[last] = new
        for last, (cost, audit, out) in layer.items():
            offer(last, (cost + 4, audit + "D", out))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in nexts[last]:
                    offer(role[:1], (cost + late, audit + "K", (*out, (role, text))))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in nexts[last]:
                        offer(c, (cost + 3 + late, audit + "R", (*out, (name, text))))
        layer = after
    cost, audit, out = min((layer[s] for s in ("", "a") if s in layer), key=lambda v: v[:2])
    assert PATTERN.fullmatch("".join(r[:1] for r, _ in out))
    turns = [t for t, *_ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def brute_damage(rows):
    told = lambda v: " " if v is None else str(v)
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv]
        role, text, fault = told(role), told(text), zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        groups[conv] += [(turn, role, text)] * (fault > 0) * (2 if fault == 3 else 1)
    return groups


def conversation_rows():
    rnd = random.Random(4)
    rows = []
    for conv in range(70):
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, None if rnd.random() < .05 else turn + (rnd.random() < .1) * 3,
                         rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "sally"]),
                         rnd.choice(["Yes.", "No!", "Well", " \n", "", None, "Why?\t", f"It is {rnd.random()}.", "long " * 30 + "end."]), "x", 1))
    rows += [rows[5], rows[5], (None, 0, "user", "Hi.", "x", 1), (None, None, "assistant", "Ho.", "x", 1), (None, 2, None, None, None, None)]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["Same.", f"Text {t}", f"Text {t}."]), "x", 1) for t in range(150)]
    return rows + [(901, 1, "user", "Again.", "x", 1)] * 40


CONVERSATIONS = "conv_id long, turn long, role string, text string, ck string, `a.b` long"


@pytest.mark.parametrize("block", [32, 3])
def test_repair_query_equals_brute_force(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block)
    spark.createDataFrame(conversation_rows(), CONVERSATIONS).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_auction_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = [(conv, *brute_repair(rows)) for conv, rows in brute_damage(conversation_rows()).items()]
    have = sorted(map(tuple, got.collect()), key=str)
    for a, b in zip(have, sorted(want, key=str), strict=True):
        assert a == b


def test_auction_blocks_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(1500):
        coded = tuple((rnd.choice("suax"), rnd.choice("--tx"), rnd.choice([1, 1, 1, 3])) for _ in range(rnd.randrange(12)))
        size = rnd.choice([1, 2, 5, 32])
        blocks = [turn_repair.solve(coded[i:i + size], (0,) if i == 0 else (0, 1, 2, 3)) for i in range(0, len(coded), size)]
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[c], "" if f == "x" else f"{i}" + "." * (f != "t"))
                for i, (c, f, copies) in enumerate(coded) for _ in range(copies)]
        want = brute_repair(rows)
        assert turn_repair.joined(blocks) == want[5:7]


def test_repaired_rows_and_empty_table(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "Still there?"), ("a", 3, "assistant", "Yes."), ("b", 1, "assistant", " ")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r["conv_id"], r["at"]): (r["role"], r["text"]) for r in turn_repair.repair(frame, with_text=True).collect()}
    plan = {r["conv_id"]: (r["cost"], r["audit"]) for r in turn_repair.repair(frame).collect()}
    assert plan == {"a": (3, "KIKK"), "b": (4, "D")}
    assert got == {("a", 0): ("user", "Hi."), ("a", 1): ("assistant", ""), ("a", 2): ("user", "Still there?"), ("a", 3): ("assistant", "Yes.")}
    nothing = spark.createDataFrame([], CONVERSATIONS)
    assert turn_repair.repair(turn_repair.damaged(nothing), nothing).count() == 0


# ---- the other operators on very long texts among columns whose names clash

LONG = {1: "la " * 120_000, 2: " ".join(f"w{i % 60_000}" for i in range(120_000)), 3: "\n".join(f"line number {i % 500} of a long text" for i in range(20_000)),
        4: "x" * 400_000, 5: "", 6: None}


def test_very_long_texts_among_clashing_names(spark):
    rows = [(i, t, "en", "s", "v", 1, 2, 3, "y") for i, t in LONG.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` string, __cut long, __rk long, block int, word string")
    words = {i: len((t or "").split()) for i, t in LONG.items()}

    def told(df, column):
        return {r["doc_id"]: r[column] for r in df.select("doc_id", column).collect()}

    assert told(ctw.score(docs, depth=2), "n_tokens") == {i: n + 1 for i, n in words.items()}
    items = spark.createDataFrame([("q", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id string, text string")
    assert told(decontaminate.report(docs, items), "n_hit") == {i: 20 if i == 2 else 0 for i in words}
    assert told(recompression.dedup_substrings(docs), "n_words") == words
    assert told(line_dedup.dedup_lines(docs), "n_lines")[3] == 20_000
    assert told(divergence.judge(docs), "n_words") == words
    assert told(set_relations.link_components(docs), "n_shingles")[1] == 1
    assert told(licenses.scan(docs), "n_words") == {i: len(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())) for i, t in LONG.items()}
    assert told(mixing.mix(docs, carry=docs.columns), "size") == words
    kept = set_relations.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(words)
