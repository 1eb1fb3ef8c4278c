"""The training-data operators on small fixtures: brute force, odd input, skew, empty tables."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strandline.llm import credentials, frequency, leakage, queries, runs, shared_spans, subtitles, tokenize, topn

from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLE[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0


# top n


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([0.5, 0.5, 0.7, None, math.nan, rng.random()]), i % 40, "x", 0, 1) for i in range(600)]
    rows += rows[::3]  # redelivered
    df = spark.createDataFrame(rows, "g long, s double, t long, rank string, __s int, score int").repartition(7)
    best = {}
    for g, s, t, *_ in set(rows):
        if s is not None and not math.isnan(s):
            best.setdefault(g, set()).add((-s, t))
    want = {(g, t, -s, i + 1) for g, v in best.items() for i, (s, t) in enumerate(sorted(v)[:5])}
    assert {tuple(r) for r in topn.top_n(df, ["g"], F.col("s"), ["t"], 5).collect()} == want
    assert topn.top_n(df.limit(0), ["g"], F.col("s"), ["t"], 5).count() == 0
    assert topn.top_n(df, ["g"], F.col("s"), ["t"], 0).count() == 0


# credentials

URLS = {
    "rtsp://admin:fern@30@edge-46.example:554/roof": ["fern@30"],
    "RTSP://cam:ridge:BkNj@192.0.2.1/live": ["ridge:BkNj"],
    "rtsp://ops:SQ68s%2FGV1s@h/x": ["SQ68s%2FGV1s"],
    "https://lq5XbRsSPxiimq4OQhJvkC7KbTz9pAS5XC:@h/x": ["lq5XbRsSPxiimq4OQhJvkC7KbTz9pAS5XC"],
    "rtsp://ops:@h/x": [], "rtsp://ops@h/x": [], "rtsp://h/roof@1080p": [], "rtsp://admin:****@h/x": [], "rtsp://a:%CAM_PW%@h/x": [],
    "rtsp://a:{{vault.cam}}@h/x": [], "rtsp://a:$PW@h/x": [], "rtsp://a:${PW}@h/x": [],
    "https://lq5XbRsSPxiimq4OQhJvkC7KbTz9pAS5XC@h/x": ["lq5XbRsSPxiimq4OQhJvkC7KbTz9pAS5XC"],
    "http://h/pull?src=rtsp%3A%2F%2Fonvif%3Asi8DN4T5%40192.0.2.1%2Fx": ["si8DN4T5"],
    "http://h/pull?src=rtsp%253A%252F%252Fops%253Atin%252365%2540h%252Fx&v=2": ["tin%252365"],
    "http://h/pull?src=rtsp%3A%2F%2F[2001%3Adb8%3A%3A1]%2Fx": [],
    "https://h/x?ch=1&passwd=c9623&loop=1": ["c9623"], "https://h/x?token=&ch=1": [], "https://h/p?token=%24%7BTOKEN%7D": [], "https://h/p?token=[hidden]": [],
    "https://h/x?tokenizer=abc&passthrough=on&author=me": [], "https://h/a?key=idr&checksum=9c895ece24eefa85ff27b22336aef3ce": [],
    "https://h/x?authorization=Basic%20Y2FtMzk6cGx1bV80MjA4Nw==": ["Y2FtMzk6cGx1bV80MjA4Nw=="],
    'ffmpeg -headers "Authorization: Bearer abc.def" -i https://h/x': ["abc.def"],
    "https://h/x|X-Auth-Key: k1k2": ["k1k2"], "https://h/x|Cookie: authtoken=zz%3D": ["zz%3D"],
    "url: rtsp://h/x\nlogin: ops\nKennwort: gravel.88943": ["gravel.88943"], "url: rtsp://h\npassword: !vault cam": [], "url: rtsp://h\npassword: null": [],
    '{"url": "rtsp://h", "login": "root", "pwd": "8HhhM"}': ["8HhhM"], '{"login": "root", "password": ""}': [], '{"password": null}': [],
    "RTSP_PW=kettle gst-play rtsp://h/x": ["kettle"], "CAM_PASSWORD='a b' x": ["a b"],
    "gst-launch-1.0 rtspsrc location=rtsp://h/x user-id=a user-pw=brook ! fakesink": ["brook"],
    "rtsp://h/x;user=a;pwd=kR5z*5iXdq!;tcp": ["kR5z*5iXdq!"], "rtsp://h/user=a_password=MTAp6P_channel=0_stream=0.sdp": ["MTAp6P"],
    "rtsp://h/x  # login ops / plum-29387": ["plum-29387"],
    "srt://h?clientkey=-----BEGIN%20EC%20PRIVATE%20KEY-----%0AMII2%0A-----END%20EC%20PRIVATE%20KEY-----&l=1": ["-----BEGIN%20EC%20PRIVATE%20KEY-----%0AMII2%0A-----END%20EC%20PRIVATE%20KEY-----"],
    "srt://h?peercert=-----BEGIN PUBLIC KEY-----\nMII\n-----END PUBLIC KEY-----": [],
    "": [], "gb28181://h?deviceid=5676233335827#localid=386562": [],
}


def test_credentials(spark):
    rows = [(i, u, "a", "b") for i, u in enumerate(URLS)] + [(-1, None, None, None), (None, "rtsp://a:b3@h/", "", "")]
    df = spark.createDataFrame(rows, "id long, url string, rule string, row_id string")
    got = {}
    for r in credentials.find(df, "id", "url").collect():
        got.setdefault(r.row_id, []).append(r.secret_text)
    texts = list(URLS)
    assert {u: sorted(got.get(i, [])) for i, u in enumerate(texts)} == {u: sorted(v) for u, v in URLS.items()}
    assert got[None] == ["b3"]
    masked = {r.row_id: r.masked for r in credentials.mask(df, "id", "url").collect()}
    for i, (u, v) in enumerate(URLS.items()):
        want = u
        for s in v:
            want = want.replace(s, "***")
        assert masked[i] == want
    assert masked[-1] is None and credentials.find(df.limit(0), "id", "url").count() == 0


def test_index_loses_nothing():
    import pyarrow as pa

    rules = credentials.Rules()
    texts = list(URLS) + ["x" * 100_000 + "?password=deep1&" + "y" * 100_000]
    by_index = {}
    for i, a, b, n in rules.search(pa.array(texts)):
        by_index.setdefault(i, []).append((a, b, n))
    assert by_index == {i: s for i, t in enumerate(texts) if (s := rules.spans(t))}
    assert all(need is not None for _, _, need in rules.rules)  # every rule has required trigrams


def test_index_chunks(monkeypatch):
    import pyarrow as pa

    texts = ["", None, "ab", "abcdefgh" * 5, "xyzé" * 3, "abc"]
    want = {g: [i for i, t in enumerate(texts) if g in credentials.trigrams(t or "")] for t in texts for g in credentials.trigrams(t or "")}
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(credentials, "BUFFER", size)
        index = credentials.TrigramIndex(pa.array(texts))
        assert {g: index.owner[index.postings(g)].tolist() for g in want} == want and index.postings(1).tolist() == []
    monkeypatch.setattr(credentials, "CHUNK", 4)
    text = "abc\nabcdefgh\n\nx\ny\nabc"
    assert [text[a:b] for a, b in credentials.chunks(text)] == ["abc\n", "abcdefgh\n", "\nx\ny\n", "abc"]
    index = credentials.TrigramIndex(pa.array([text, "zabc"]))
    (gram,) = credentials.trigrams("abc")
    assert index.postings(gram).tolist() == [0, 1, 3, 4] and index.owner.tolist() == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("x,text", [("ab(?:cd|ef)gh", "abefgh"), ("x?abc+d", "abccd"), ("(?:abc){2}", "abcabc"), ("[ab]cde", "bcde"), ("a.b", "axb")])
def test_required_trigrams_hold(x, text):
    need = credentials.required(x)
    assert need is None or any(s <= credentials.trigrams(text) for s in need)


# runs


def least_cost(events, penalty, max_gap):
    """Over all segmentations. events: (at, class) in order."""
    best = math.inf
    n = len(events)
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            edges = [0, *cuts, n]
            runs_ = [events[x:y] for x, y in zip(edges, edges[1:])]
            if all(q[0] - p[0] <= max_gap for r in runs_ for p, q in zip(r, r[1:])):
                best = min(best, sum(penalty + len(r) - max([c for _, c in r].count(x) for _, x in r) for r in runs_))
    return best


def in_levels(events, penalty, max_gap, block, fan):
    """The runs of one entity through the three levels, as the operator does it."""
    rows = [dict(zip(runs.FIELDS, (1, 2, at // block, i, at, at, c, 1, False, False, False))) for i, (at, c) in enumerate(events)]
    done = []
    for level, width in enumerate((1, fan, 10**9)):
        rows = sorted(({**r, "__group": r["block"] // width} for r in rows), key=lambda r: (r["__group"], r["block"], r["seq"]))
        if not rows:
            break
        schema = pa.schema([(f, pa.string() if f == "key" else pa.bool_() if f in ("fixed", "closed", "done") else pa.int64()) for f in [*runs.FIELDS, "__group"]])
        rows = runs.solve(pa.Table.from_pylist(rows, schema).combine_chunks(), max_gap, penalty, level == 2).to_pylist()
        done += [r for r in rows if r["done"]]
        rows = [r for r in rows if not r["done"]]
    assert not rows
    return sorted(done, key=lambda r: r["seq"])


@given(st.lists(st.tuples(st.sampled_from([1, 1, 1, 5]), st.sampled_from("aaabc")), min_size=1, max_size=10), st.sampled_from([0.25, 0.6, 1.0, 1.5, 2.2]), st.sampled_from([1, 2, 3, 100]), st.sampled_from([1, 2, 100]))
@settings(max_examples=250, deadline=None)
def test_segmentation_is_optimal(steps, penalty, block, fan):
    events, at = [], 0
    for gap, c in steps:
        at += gap
        events.append((at, c))
    got = in_levels(events, penalty, 3, block, fan)
    assert sum(r["n"] for r in got) == len(events)
    cost, i = 0.0, 0
    for r in got:
        part = events[i : i + r["n"]]
        i += r["n"]
        assert (part[0][0], part[-1][0]) == (r["first_at"], r["last_at"])
        cost += penalty + sum(c != r["key"] for _, c in part)
    assert abs(cost - least_cost(events, penalty, 3)) < 1e-9


def test_flicker_stays_in_its_run():
    events = list(enumerate("aaaabaaaaccccc"))
    ends = lambda p: [(r["key"], r["n"]) for r in in_levels(events, p, 3, 4, 2)]
    assert ends(0.25) == [("a", 4), ("b", 1), ("a", 4), ("c", 5)]
    assert ends(0.75) == [("a", 9), ("c", 5)]  # the optimum isn't to cut at every change


def test_every_stretch_passes_the_programme(monkeypatch):
    seen, plain = [], runs.own_classes
    monkeypatch.setattr(runs, "own_classes", lambda keys, sizes, anchors, penalty: seen.append((list(sizes), list(anchors))) or plain(keys, sizes, anchors, penalty))
    got = in_levels(list(enumerate("aaabbacca")), 0.25, 3, 100, 2)  # under p3_found's penalty too
    assert [(r["key"], r["n"]) for r in got] == [("a", 3), ("b", 2), ("a", 1), ("c", 2), ("a", 1)]
    assert seen[0] == ([3, 2, 1, 2, 1], [True, False, False, False, True])  # at the block's open ends alone is the class given


def by_all_classes(events, penalty, max_gap):
    """The one optimum that the tie rule picks: every class through every event, without pruning or blocks. Costs in 64ths."""
    out, pieces = [], []
    for e in events:
        pieces.append([e]) if not pieces or e[0] - pieces[-1][-1][0] > max_gap else pieces[-1].append(e)
    for piece in pieces:
        own, new = sorted({c for _, c in piece}), int(penalty * 64)
        best = {c: (new + 64 * (c != piece[0][1]), [c]) for c in own}
        for _, k in piece[1:]:
            low = min(own, key=lambda c: (best[c][0], c))
            begun = best[low][0] + new, best[low][1] + [k]
            goes = {c: (best[c][0] + 64 * (c != k), best[c][1] + [c]) for c in own}
            best = goes | ({k: begun} if begun[0] < goes[k][0] else {})
        label = best[min(own, key=lambda c: (best[c][0], c))][1]
        for i, (e, c) in enumerate(zip(piece, label)):
            if i and label[i - 1] == c:
                out[-1][1:3] = [e[0], out[-1][2] + 1]
            else:
                out.append([e[0], e[0], 1, c])
    return out


@given(st.lists(st.tuples(st.sampled_from([1, 1, 1, 5]), st.sampled_from("caabca")), min_size=1, max_size=24), st.sampled_from([0.25, 0.5, 1.0, 1.25, 1.5, 2.0]), st.sampled_from([1, 2, 3, 100]), st.sampled_from([1, 2, 100]))
@settings(max_examples=400, deadline=None)
def test_equal_costs_go_one_way_whatever_the_blocks(steps, penalty, block, fan):
    events, at = [], 0
    for gap, c in steps:
        at += gap
        events.append((at, c))
    got = in_levels(events, penalty, 3, block, fan)
    assert [[r["first_at"], r["last_at"], r["n"], r["key"]] for r in got] == by_all_classes(events, penalty, 3)


def test_steady_runs_outlast_flickers(spark):
    cut, steady = (queries.QUERIES[q](spark, SMALL) for q in ("p3_runs", "p3_steady"))
    assert steady.count() < 0.8 * cut.count()
    assert steady.agg(F.sum("n_boxes")).first() == cut.agg(F.sum("n_boxes")).first()


def test_segmentation_takes_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        rng = np.random.default_rng(1)
        keys, began = rng.integers(0, 5, n).tolist(), time.process_time()
        runs.own_classes(keys, [1] * n, [False] * n, 1.4)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_runs_whatever_the_blocks(spark, block):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.8 else 2, 7, f, 0, rng.choice("aab")) for f in sorted(rng.sample(range(400), 200))]
    rows += [(1, 7, None, 0, "a"), (None, 7, 1, 0, "a"), (1, 7, 5, 1, None)] + rows[:20]
    df = spark.createDataFrame(rows, "e long, f long, at long, tie long, k string").repartition(5)
    want = []
    for e in (1, 2):
        seq = sorted({r for r in rows if r[0] == e and r[2] is not None and r[4] is not None}, key=lambda r: r[2])
        cur = None
        for r in seq:
            if cur and r[4] == cur[3] and r[2] - cur[1] <= 4:
                cur[1], cur[2] = r[2], cur[2] + 1
            else:
                cur = [r[2], r[2], 1, r[4]]
                want.append((e, cur))
    want = sorted((e, *c) for e, c in want)
    got = runs.collapse_runs(df, ("e", "f"), "at", "tie", "k", 4, block=block, fan=3)
    assert sorted((r.e, r.first_at, r.last_at, r.n, r["class"]) for r in got.collect()) == want
    two = runs.collapse_runs(df, ("e", "f"), "at", "tie", "k", 4, min_n=2, block=block)
    assert sorted((r.e, r.first_at, r.last_at, r.n, r["class"]) for r in two.collect()) == [w for w in want if w[3] > 1]
    assert runs.collapse_runs(df.limit(0), ("e", "f"), "at", "tie", "k", 4).count() == 0


def test_class_keys(spark):
    names = spark.createDataFrame([(1, "Tall moped"), (2, " tall_moped"), (3, "TALL-  MOPED "), (4, "car"), (5, None), (None, "x")], "class_id int, class_name string")
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, None)], "k int")
    got = {r.k: r.class_key for r in runs.class_keys(df, names, "k").collect()}
    assert got[1] == got[2] == got[3] and got[4] == "ncar" and got[5] == "i5" and got[6] == "i6" and got[None] is None


# frequencies


def test_frequencies(spark):
    rows = [("a", 1, 0, "z"), ("a", 1, 0, "z"), ("a", 1, 1, ""), ("a", 2, 0, None), ("", 2, 1, ""), (None, 3, 0, ""), ("b", None, 0, "")]
    df = spark.createDataFrame(rows, "v string, r int, o int, term string")
    f = frequency.term_frequencies(df, F.col("v"), ["r"], ["o"])
    assert {tuple(r) for r in f.collect()} == {("a", 3, 2), ("", 1, 1), ("b", 1, 1)}
    t = frequency.record_total(df, F.col("v"), ["r"])
    assert t.first()[0] == 3
    m = frequency.mark_terms(f.withColumn("field_name", F.lit("x")), t.withColumn("field_name", F.lit("x")), 2, 0.25)
    assert {(r.term, r.mark) for r in m.collect()} == {("a", "common"), ("", "rare"), ("b", "rare")}
    assert frequency.term_frequencies(df.limit(0), F.col("v"), ["r"], ["o"]).count() == 0


# tokenizer

TEXTS = ["", None, "Hello  world's\n\n x", "<|endoftext|>", "日本語のテキスト。" * 5, "é" * 700 + "ab" * 300, "\x00\x1c\x85 　 a", "🎵🎵 don't 123,456", " " * 50 + "z", "a" * 20_000, "ﬁ ½ Ⅷ ٣", "\r\n\r\n00:01:07,900 --> 00:01:11,491\r\n"]


def test_encoding_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.TOKENIZER_DIR + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([32, 10, 39, *range(97, 123), 0xE9, 0x4E00 + rng.randrange(99), 0x1F3B5])) for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, x, "c", 0) for i, x in enumerate(texts)], "doc_id long, text string, ids string, TEXT2 int").repartition(4)
    got = {r.doc_id: list(r.ids) for r in tokenize.encode_corpus(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


def test_long_pieces_equal_library(monkeypatch):
    import time

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.TOKENIZER_DIR + "/byte_bpe_50k.json")
    b = tokenize.encoder(tokenize.TOKENIZER_DIR + "/byte_bpe_50k.json")
    rng = random.Random(6)
    pieces = ["".join(rng.choice(x) for _ in range(n)) for x in ("ab", "aabé", "etaoinshr", "ACGT", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "=-+/*_", "日本語") for n in (2, 3, 5, 64, 999, 4000)]
    pieces += ["a" * n for n in (2, 3, 7, 1025, 30_000)] + ["ab" * 700, "aab" * 700]
    for p in pieces:
        assert b.merge_long(p.encode()) == t.encode(p, add_special_tokens=False).ids
    monkeypatch.setattr(b, "at_once", np.zeros(len(b.at_once), bool))  # one by one: the same
    assert all(b.merge_long(p.encode()) == t.encode(p, add_special_tokens=False).ids for p in pieces if len(p) < 100)
    monkeypatch.undo()
    big = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))
    began = time.process_time()
    ids = b.merge_long(big.encode())
    took = time.process_time() - began
    print(took)
    assert took < 30 and ids == t.encode(big, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    b = tokenize.encoder(tokenize.TOKENIZER_DIR + "/byte_bpe_50k.json")
    want = b.encode_batch(TEXTS)
    monkeypatch.setattr(tokenize, "REMEMBER", 3)
    assert b.encode_batch(TEXTS[:4]) and b.encode_batch(TEXTS) == want


# leakage

ITEM = "What kind of sergeant would measure a last glove? If you cross it again, Zanirel will tune the gate. Je n'aurais jamais dû lancer le miroir de Droeth ni le phare abîmé, dit-il."


def srt(words, per=5, eol="\n", between=""):
    cues = [" ".join(words[i : i + per]) for i in range(0, len(words), per)]
    return eol.join(f"{i + 1}{eol}00:00:{i:02d},100 --> 00:00:{i:02d},900{eol}{c}{between}{eol}" for i, c in enumerate(cues))


def test_spoken_words():
    w = subtitles.spoken_words
    want = ["hand", "me", "the", "gate"]
    assert w("1\n00:00:01,000 --> 00:00:02,000\n- <i>Hand me</i>\n\n2\n00:00:02,000 --> 00:00:03,000\n[door creaks] the ♪ la la ♪ gate!") == want
    assert w("WEBVTT - 5\r\n\r\nx1\r\n00:01.000 --> 00:02.000 align:start\r\nHand me\r\n\r\n00:02.000 --> 00:03.000\r\nthe gate")[-4:] == want
    assert w("{10}{20}Hand me|the\n{21}{30}{\\an8}gate") == want
    assert w("Dialogue: 0,0:00:38.78,0:00:42.19,Default,,0,0,0,,Hand me\\Nthe\nDialogue: 0,0:00:43.94,0:00:45.13,Default,,0,0,0,,(SIGHS) gate") == want
    assert w("LetÃ¢â‚¬â„¢s dÃ» fÃªlÃ© &eacute;t&eacute;") == ["lets", "dû", "fêlé", "été"]
    assert w(None) == [] and w("") == [] and w(" \n ") == []
    for long in ("\n" * 200_000, " " * 200_000 + "x", "- " * 100_000, "1\n" * 100_000, "a" * 500_000, "[" * 100_000, "<" * 100_000, "x --> y\n" * 20_000, "? " * 50_000, "{" * 50_000):
        assert len(w(long)) <= 1  # and in no time


def leaks(spark, texts, item=ITEM, n=16, **more):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, item, 1, "x"), (50, None, 1, ""), (51, "", 1, "")], "doc_id long, text string, item_id int, terms string")
    items = spark.createDataFrame([(9, item, "en"), (10, "too short", "en"), (11, None, None), (9, item, "de")], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items, min_words=n, **more).collect()}


def test_leaks(spark):
    words = ITEM.split()
    filler = "nobody will paint that fence while it rains".split()
    spoilt = [x.replace("d", "cl").replace("e", "c") for x in words[3:19]]
    changed = words[:15] + ["kettle"] + words[16:25] + ["bridge"] + words[26:30]
    texts = [
        srt(words), srt(filler + words[5:21] + filler), srt(filler + words[5:20] + filler), srt(changed), srt([x.upper() for x in words], 3, "\r\n", " [ticking]"),
        srt(filler + spoilt), srt(words[:10] + words[11:20]), srt(words).encode().decode("cp1252", "replace"), srt(words[4:20]).replace("û", "�"),
        srt(filler * 5_000 + words), "".join(f"{{{i}}}{{{i + 9}}}{w}\n" for i, w in enumerate(words)), srt(words) + srt(words),
    ]
    assert leaks(spark, texts) == {(i, 9) for i in (0, 1, 4, 5, 7, 8, 9, 10, 11)}


def spoilt_forms(word):
    return re.compile("".join(f"(?:{'|'.join(map(re.escape, subtitles.ways(c)))})" + ("?" if c > "\x7f" else "") for c in word))


def test_known_words_may_be_spoilt_forms():
    words = ["boat", "boot", "can", "con", "if", "it", "que", "qué", "gate"]
    v = subtitles.Vocabulary(words)
    got = {w: {words[i - 1] for i in v.resolve(w)} for w in words}
    assert got == {w: {x for x in words if spoilt_forms(x).fullmatch(w)} for w in words}
    assert got["boot"] == {"boot", "boat"} and got["gate"] == {"gate"}


def test_leak_with_a_word_of_another_item(spark):
    a = "the boat that nobody will paint again drifts past my old gate while every lamp burns low"
    b = "one boot is all my brother found when he walked along that river bed in late june again"
    docs = spark.createDataFrame([(0, srt(a.replace("boat", "boot").split())), (1, srt(a.replace("boat", "kettle").split()))], "doc_id long, text string")
    items = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == {(0, 1)}


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert leaks(spark, [srt(ITEM.split())]) == {(0, 9)}


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leakage.find_leaks(docs, items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_search_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 4, rng.integers(0, 60)) for _ in range(40)]
    items = [rng.integers(1, 4, 12).tolist() for _ in range(6)] + [[5] * 12, rng.integers(1, 4, 40).tolist()]
    term, doc, place = (np.concatenate(x).astype(np.int32) for x in zip(*[(d, np.full(len(d), i), np.arange(len(d))) for i, d in enumerate(docs)]))
    shard = leakage.Shard(*leakage.postings(term, doc, place))
    counts = dict(zip(*[x.tolist() for x in np.unique(term, return_counts=True)]))
    windows = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in items]
    # beyond a document's end there are no words, so a window may hang over by the words it may lack
    padded = [[0, *x, 0] for x in docs]
    exact = {(i, j) for i, x in enumerate(docs) for j, w in enumerate(windows) if w & {tuple(x[p : p + 5]) for p in range(len(x) - 4)}}
    near = {(i, j) for i, x in enumerate(padded) for j, ws in enumerate(windows) if any(sum(a == b for a, b in zip(w, x[p : p + 5])) >= 4 for w in ws for p in range(len(x) - 4))}
    for cells in (1, 50, 2_000_000):
        monkeypatch.setattr(leakage, "CELLS", cells)
        for spare, want in ((0, exact), (1, near)):
            block = leakage.Block([(j, t, [counts.get(x, 0) for x in t]) for j, t in enumerate(items)], 5, spare)
            assert set(zip(*[x.tolist() for x in block.search(shard)])) == want


def test_long_documents_and_items(spark, monkeypatch):
    """Segments of documents and pieces of items overlap, so nothing is lost at their edges."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdegklmnoprstu") for _ in range(7)) for _ in range(300)]
    filler = ["".join(rng.choice("vwxyz") for _ in range(7)) for _ in range(400)]
    monkeypatch.setattr(leakage, "PIECE_WORDS", 50)
    monkeypatch.setattr(leakage, "PAD", 50)
    texts = [srt(filler[:at] + words[at : at + 16] + filler[at:]) for at in range(0, 280, 7)] + [srt(words[:15] + filler)]
    assert leaks(spark, texts, " ".join(words), shard_words=37) == {(i, 9) for i in range(40)}


def test_vocabulary_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "VOCABULARY_CHARS", 60)
    other = "one boot is all my brother found when he walked along that river bed in late june again"
    docs = spark.createDataFrame([(0, srt(ITEM.split())), (1, srt(other.split()))], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (7, other)], "item_id long, text string")
    assert {tuple(r) for r in leakage.find_leaks(docs, items).collect()} == {(0, 1), (1, 7)}


def test_long_descriptions_are_left_out():
    w = subtitles.spoken_words
    long = "x" * 130 + " y" * 200
    for text in (f"the [{long}] cat (sound {long}) on", f"the ♪{long}♪ cat on", f"the {{{long}}}cat <{long}>on", f"the *b{long}* cat on", f"the\n* {long} *\ncat on", f"the [{long}\n{long}] cat on"):
        assert w(text) == ["the", "cat", "on"], text[:20]
    assert w(f"Dialogue: 0,0:00:38.78,0:00:42.19,{'Style ' * 30},,0,0,0,,the cat on") == ["the", "cat", "on"]
    assert w("1\n00:00:01,000 --> 00:00:02,000\nthe [cat\n\n2\n00:00:03,000 --> 00:00:04,000\non] it") == ["the", "cat", "on", "it"]  # not beyond the cue
    deep = "fêlé"
    for _ in range(6):
        deep = deep.encode().decode("cp1252", "surrogateescape") if not any(b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) for b in deep.encode()) else deep
    assert w(deep) == ["fêlé"]


@pytest.mark.parametrize("docs,words", [(1, 10**9), (2, 10**9), (10**9, 50)])
def test_shards_do_not_matter(spark, docs, words):
    assert leaks(spark, [srt(ITEM.split()), "none", srt(ITEM.split()[3:])], shard_docs=docs, shard_words=words) == {(0, 9), (2, 9)}


# shared spans


def brute_spans(docs, n):
    seen = {}
    for d, t in docs:
        for p in range(len(t or "") - n + 1):
            seen.setdefault(t[p : p + n], set()).add(d)
    out = set()
    for d, t in docs:
        marks = [False] * len(t or "")
        for p in range(len(marks) - n + 1):
            if len(seen[t[p : p + n]]) > 1:
                marks[p : p + n] = [True] * n
        at = 0
        for on, group in itertools.groupby(marks):
            size = len(list(group))
            if on:
                out.add((d, at, at + size))
            at += size
    return out


@pytest.mark.parametrize("n,k", [(20, 8), (20, 20), (33, 16), (200, 64)])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, n, k, seed):
    rng = random.Random(seed)
    text = lambda m: "".join(rng.choice("ab é🎵x\n") for _ in range(m))
    base = [text(n * 2 + 7) for _ in range(4)]
    docs = [(i, "".join(rng.choice([text(rng.randrange(n)), rng.choice(base), rng.choice(base)[rng.randrange(n) :]]) for _ in range(rng.randrange(5)))) for i in range(25)]
    docs += [(100, base[0]), (101, base[0]), (102, base[0][: n - 1]), (103, "a" * (3 * n)), (104, "a" * (2 * n)), (105, "b" * (5 * n)), (106, None), (107, "")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs] + [(100, base[0], 0, "x"), (None, base[1], 0, "")], "doc_id long, text string, at int, token string").repartition(3)
    got = {tuple(r) for r in shared_spans.shared_spans(df, length=n, token=k).collect()}
    assert got == brute_spans(docs, n)


def test_spans_over_segments(spark, monkeypatch):
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    docs = [(1, "x" * 50 + common + "y" * 99), (2, common[:900] + "?" + common[901:]), (3, "zz" + common[300:800])]
    n, k, seg = 40, 16, 256
    ids, texts = [d for d, _ in docs], [t for _, t in docs]
    whole = {d: set() for d in ids}
    monkeypatch.setattr(shared_spans, "SEGMENT", seg)
    monkeypatch.setattr(shared_spans, "_LOW", np.uint64(seg - 1))
    for group in shared_spans.segments(ids, texts, n):
        assert sum(len(t) for _, _, t in group) <= seg
        for d, o, t in group:
            whole[d] |= set(range(o, o + len(t) - n + 1))
            assert texts[ids.index(d)][o : o + len(t)] == t
    assert all(whole[d] == set(range(len(t) - n + 1)) for d, t in docs)  # every window lies in a segment


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans.shared_spans(df).count() == 0
    one = spark.createDataFrame([(1, "ab" * 500)], "doc_id long, text string")
    assert shared_spans.shared_spans(one).count() == 0  # repeats within a document are not shared


def test_shared_amounts(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "q" * 30), (2, "b" * 5 + "q" * 30)], "doc_id long, text string")
    s = shared_spans.shared_spans(df, length=20, token=8)
    assert {(r.doc_id, r.shared_chars, r.n_chars) for r in shared_spans.shared_amounts(s, df).collect()} == {(1, 30, 40), (2, 30, 35)}
