"""The ten corpus operators: brute force, exact round trips, and edge cases (nulls, empties, long texts, ties, repeats, clashing names)."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from qaspark.llm import boosting, bpe, chat, decontamination, fingerprints, html_extract, minhash_dedup, quality, sharding, substring_dedup, toxicity
from qaspark.llm.components import components

SCHEMA = "doc_id long, text string, _row long, kind string, n long, component_id long, shard int, print string, gone string, _gone int, whole string, start int"


def table(spark, texts):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, 1, "x", 2, 3, 4, "y", "g", 5, "w", 6) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(60, 200))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(texts)]
    for i in range(20):  # near copies, each other word changed with a small chance
        w = texts[i].split()
        for rate in (0.02, 0.05, 0.08):
            out.append((len(out), " ".join(x if rng.random() > rate else "zz" + x for x in w)))
    out += [(1000 + i, texts[0]) for i in range(30)]  # exact copies
    passage = " ".join(words(rng, 60))
    out += [(2000 + i, " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30))) for i in range(20)]
    out += [(3000, None), (3001, ""), (3002, " \t\n "), (3003, "one"), (3004, "One"), (3005, " ".join(words(rng, 20000))), (3005, " ".join(["same"] * 300)), (None, texts[1]), (3006, texts[2]), (3006, texts[2])]
    return out


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "word"), (None, "word two"), (5, "a b c d e f"), (5, "a b c d e f")]


# 1 and 8: classifiers
@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, label):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(words(rng, 40)) + (" you idiot !!! $$$ ### " * 4 if bad else " and so it ends.")
        docs.append((i, text))
        labels.append((i, int(bad if label == "toxic" else not bad), "en"))
    docs += EDGE
    labels += [(None, 1, "x"), (7, None, "x"), (7, None, "x")]
    truth = spark.createDataFrame(labels, f"doc_id long, {label} int, text string")
    got = module.score_documents(table(spark, docs), truth).toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    held = got[got["held_out"] & got["doc_id"].notna() & (got["doc_id"] > 5)]
    assert all((zlib.crc32(str(int(i)).encode()) % 5 == 0) for i in held["doc_id"])
    want = {i: v for i, v, _ in labels if i is not None and v is not None}
    right = [int(p) == want[int(i)] for i, p in zip(held["doc_id"], held["predicted"], strict=True)]
    assert np.mean(right) > 0.95
    none = module.score_documents(table(spark, EDGE), truth.limit(0))
    assert none.count() == len(EDGE) and none.where("score is null").isEmpty()
    assert module.score_documents(table(spark, []), truth).isEmpty()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    knots = boosting.fit_isotonic(raw, (rng.random(500) < boosting.sigmoid(raw)).astype(float))
    assert (np.diff(knots[1]) > 0).all() and (np.diff(boosting.calibrated(np.sort(raw), knots)) >= 0).all()


# 2: near duplicates
def pairs_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows = [(i, pairs_of(t)) for i, t in corpus]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(rows[a][1] & rows[b][1])
            if n and None not in (rows[a][0], rows[b][0]) and 100 * n >= 80 * (len(rows[a][1]) + len(rows[b][1]) - n):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(rows))
    got = minhash_dedup.near_duplicates(table(spark, corpus)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash_dedup.near_duplicates(table(spark, [])).isEmpty()
    kept = minhash_dedup.drop_near_duplicates(table(spark, corpus))
    assert kept.columns == table(spark, []).columns and kept.where("doc_id > 1000 and doc_id < 2000").isEmpty()


def test_copies_that_are_like_their_original_only(spark):
    rng = random.Random(12)
    original = words(rng, 201, 10**6)
    docs = [(5000, " ".join(original))]
    for i in range(600):
        w = list(original)
        for at in rng.sample(range(5, 196), 10):
            w[at] = f"e{i}x{at}"
        docs.append((i, " ".join(w)))
    for i in range(700):  # a template: much alike, no links but the planted ones
        w = list(docs[1][1].split())
        for at in range(0, 200, 8):
            w[at] = f"t{i}x{at}"
        docs.append((10_000 + i, " ".join(w)))
        if i % 50 == 0:
            for at in (3, 60, 101, 150):
                w[at] = f"p{i}x{at}"
            docs.append((20_000 + i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: pairs_of(t) for i, t in docs}
    linked = [i for i in range(600) if 100 * len(sets[i] & sets[5000]) >= 80 * len(sets[i] | sets[5000])]
    assert len(linked) > 550 and {got[i] for i in [5000, *linked]} == {min(linked)}
    assert sum(got[20_000 + i] == 10_000 + i for i in range(0, 700, 50)) == 14
    assert all(got[10_000 + i] == 10_000 + i for i in range(700))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(7, i) for i in range(100, 130)] + [(7, 3), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(51, 91)} | {i: 3 for i in [7, *range(100, 130)]}


# 3: sharding
def test_sharding(spark, corpus):
    got = sharding.shard_by_bytes(table(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 0 or 1000 <= (r.doc_id or 0) < 1030}) == 1
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_by_bytes(table(spark, [])).isEmpty()


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.lognormal(5, 1, 2000)
    shard = sharding.differencing(sizes, 16)
    totals = np.bincount(shard, sizes, 16)
    assert totals.max() / totals.min() < 1.001
    assert set(sharding.differencing(np.ones(5), 16)) <= set(range(16)) and len(sharding.differencing(np.zeros(0), 4)) == 0


# 4: fingerprints
def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(spark, corpus, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)  # many ranges
    docs = [(i, t) for i, t in corpus if i is not None and i not in (3005, 3006)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, docs)).collect()}
    order = sorted(docs, key=lambda x: -x[0])
    errors = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = shingles(t), shingles(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, errors)) < 0.25 and abs(np.mean(errors)) < 0.02
    assert len({got[i].fingerprint for i in [0, *range(1000, 1030)]}) == 1
    assert fingerprints.fingerprint_documents(table(spark, [])).isEmpty()
    assert fingerprints.fingerprint_documents(table(spark, EDGE)).count() == len(EDGE)
    alone = fingerprints.fingerprint_documents(table(spark, [(9, "äöü one two")])).first()
    assert alone.n_chars == 11 and alone.near_next == 1.0


# 5: chat
def test_chat_linking(spark):
    arguments = {"query": 'say "hi"\n', "turn": "3"}
    calls = [(1, 0, "a", None, "lookup", arguments), (1, 2, "b", "a", "lookup", {"query": "x", "turn": "no", "z": "1"}), (1, 4, "c", "d", "lookup", arguments), (1, 5, "d", "c", "lookup", arguments), (1, 6, "e", "b", "nope", arguments), (1, 7, None, None, "lookup", None), (None, 8, "a", None, "lookup", arguments)]
    results = [(1, 1, "a", "fine"), (1, 3, "a", "again"), (1, 9, "zz", "lost"), (1, 9, None, None)]
    clash = [F.lit(9).alias(c) for c in ("depth", "position", "_first", "_errors", "_arguments", "n_results", "_part", "_at", "status")]
    made = [spark.createDataFrame(x, y).select("*", *clash) for x, y in ((calls, chat.CALL), (results, chat.RESULT))]
    got = chat.link_calls(*made, chat.TURN_TOOLS).collect()
    by = {(r.conv_id, r.call_id, r.call_turn): r for r in got}
    assert len(got) == len(calls) + 2
    a = by[(1, "a", 0)]
    assert (a.status, a.position, a.depth, a.result_turn, a.n_results) == ("linked", 0, 0, 1, 2)
    assert [by[(1, x, t)].position for x, t in (("b", 2), ("e", 6), ("c", 4))] == [1, 2, None]
    assert a.json == '{"call":{"arguments":{"query":"say \\"hi\\"\\n","turn":3},"id":"a","name":"lookup","needs":null},"result":{"content":"fine","turn":1}}'
    assert (by[(1, "b", 2)].status, by[(1, "b", 2)].depth, by[(1, "b", 2)].n_errors) == ("invalid", 1, 2)
    assert by[(1, "c", 4)].depth is None and by[(1, "c", 4)].status == "unordered"
    assert by[(1, "e", 6)].status == "invalid" and by[(1, "e", 6)].depth == 2
    assert by[(1, "zz", None)].status == "no_call" and by[(None, "a", 8)].status == "unordered"
    empty = chat.link_calls(spark.createDataFrame([], chat.CALL), spark.createDataFrame([], chat.RESULT), chat.TURN_TOOLS)
    assert empty.isEmpty()


def test_turns_of_other_roles_are_kept(spark):
    turns = [(1, 0, "system", "be good"), (1, 1, "user", "x" * 50_000), (1, 2, "assistant", "ok"), (1, 3, None, None), (1, 4, "user", "ab"), (1, 4, "user", "ab"), (None, None, "tool", "")]
    calls, results, messages = chat.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = chat.with_messages(chat.link_calls(calls, results, chat.TURN_TOOLS), messages).collect()
    assert sorted((r.call_turn or -1, r.json) for r in got if r.status == "message") == [
        (-1, '{"message":{"content":"","role":"tool","turn":null}}'),
        (-1, '{"message":{"content":"be good","role":"system","turn":0}}'),
        (3, '{"message":{"content":null,"role":null,"turn":3}}'),
    ]
    calls = [r for r in got if r.status != "message"]
    assert [(r.call_turn, r.status, r.position) for r in sorted(calls, key=lambda r: r.call_turn)] == [(1, "linked", 0), (4, "unordered", None), (4, "unordered", None)]
    assert "x" * 50_000 in min(calls, key=lambda r: r.call_turn).json


def test_long_chains_are_ordered(spark):
    calls = [(1, i, f"c{i}", f"c{i - 1}" if i else None, "lookup", {"query": "q", "turn": "1"}) for i in range(100)]
    got = chat.depths(spark.createDataFrame(calls, chat.CALL)).collect()
    assert {r.call_id: r.depth for r in got} == {f"c{i}": i for i in range(100)}


# 6: pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header><h2>Site</h2></header><div class="ad">Buy now</div><div id="cookie-notice">We use cookies on this site and you must accept them all now.</div><aside><p>Other stories that you may like to read.</p></aside>
<article><h1>Head &amp; line</h1><p><b>First  part.<br>More<p>Second &lt;p&gt; part</p><form><input><label>Mail</label></form><div class="comments"><p>A reader says that this is good and right and fine.</p></div></article>
<footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst part. More\n\nSecond <p> part"
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "plain < text", ""), (4, "z", "<article><p>cut off in the mid", "")]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[None].url == "v" and got[4].text == "cut off in the mid"
    assert html_extract.extract_pages(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).isEmpty()


def test_pages_with_awkward_markup():
    text, long = "The article tells what happened on that day in the town.", "A reader thinks that this is all wrong and says so. " * 60
    page = lambda body, top="": f"<html><body {top}>{body}</body></html>"
    article = f"<article><h1>Head</h1><p>{text}</p>%s</article>"
    want = f"Head\n\n{text}"
    assert html_extract.main_text(page(article % "", 'class="has-sidebar no-ads sidebar-left"')) == want
    assert html_extract.main_text(page(f'<div class="content-sidebar-wrap">{article % ""}</div><nav>Home</nav>')) == want
    for inner in (f'<div class="comments"><p>{long}</p></div>', f"<aside><p>{long}</p></aside>", f'<section id="user-reviews"><p>{long}</p></section>', f'<div class="comment-list"><article class="comment"><p>{long}</p></article></div>'):
        assert html_extract.main_text(page(article % inner)) == want
        assert html_extract.main_text(page(article % "" + inner)) == want
    assert html_extract.main_text(page(article % """<p>See <img alt="a > b" src='x>y'>it <a title='1 > 0' href="/">here</a> and 5" tall <b =">.</p>""")) == f'{want}\n\nSee it here and 5" tall .'
    many = [f"Line {i} of a very long page." for i in range(4000)]
    assert html_extract.main_text(page("<nav>Menu</nav><article>" + "".join(f"<p>{x}" for x in many) + "</article>")) == "\n\n".join(many)


def test_minimum_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 8)
        z = [rng.uniform(-1.5, 1.5) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.6]
        cost = lambda l: sum(math.log1p(math.exp(-x if y else x)) for x, y in zip(z, l, strict=True)) + sum(c for i, j, c in edges if l[i] != l[j])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.minimum_cut(z, edges)) - best) < 1e-9


# 7: decontamination
def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    items = [(k, " ".join(words(rng, n, 5000))) for k, n in enumerate((12, 30, 55, 30))] + [(9, "two words"), (10, ""), (11, None)]
    items.append((12, items[1][1]))
    docs = [(i, " ".join(words(rng, 80, 5000))) for i in range(20)]
    for i, (_, t) in enumerate(items[:4]):
        w = t.split()
        docs.append((100 + i, "Some lead " + t.upper() + " and an end"))
        w[len(w) // 2] = "changed"
        docs.append((200 + i, "x " + " ".join(w)))
        docs.append((300 + i, " ".join(w[: len(w) // 2])))
        docs.append((500 + i, " ".join(t.split()[1:]) + " and more " + "to read here " * 9))
        docs.append((600 + i, "to read here " * 9 + " ".join(t.split()[: len(w) - 2])))
        docs.append((700 + i, " ".join(t.split()[1:])))
    docs += [(400, "here are two words now"), (100, "a second text of this id"), (100, docs[20][1]), *EDGE]
    want = set()
    runs = lambda w: [tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))]
    bag = lambda w: Counter(runs(w))
    for i, t in docs:
        w = (t or "").lower().split()
        for k, item in items:
            m = (item or "").lower().split()
            for s in range(max(1, len(w) - len(m) + 1) if w and m and i is not None else 0):  # a text shorter than the item is one window
                a, b = bag(w[s : s + len(m)]), bag(m)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((i, k, s))
    truth = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(table(spark, docs), truth).collect()
    windows = {(r.doc_id, r.item_id, r.start) for r in got}
    assert len(got) == len(windows) and windows <= want and len(windows) >= 0.97 * len(want)
    assert {(i, k) for i, k, _ in windows} == {(i, k) for i, k, _ in want} and {i for i, _, _ in want} >= {100, 101, 102, 103, 400}
    kept = decontamination.without_leaks(table(spark, docs), truth)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _, _ in want}
    assert decontamination.leaks(table(spark, docs), truth.limit(0)).isEmpty() and decontamination.leaks(table(spark, []), truth).isEmpty()


# 9: repeated passages
def brute_repeats(docs):
    first, out = {}, []
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    for i, t in docs:
        w = split(t)
        for p in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[p : p + 50])
            first[key] = min(i, first.get(key, i))
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, corpus):
    got = substring_dedup.repeats(table(spark, corpus)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(corpus)
    assert substring_dedup.repeats(table(spark, [])).isEmpty()
    cut = substring_dedup.without_repeats(table(spark, corpus))
    assert cut.columns == table(spark, []).columns and cut.count() == len(corpus)
    assert cut.where("doc_id = 1003").first().text == "" and cut.where("doc_id = 5").first().text == corpus[5][1]
    extra = [c for c in cut.columns if c not in ("doc_id", "text")]
    assert cut.select(extra).distinct().collect() == table(spark, corpus).select(extra).distinct().collect()


def test_repeats_of_third_documents_and_of_ids_with_two_texts(spark):
    rng = random.Random(6)
    make = lambda n: words(rng, n, 10**6)
    anchor, left, right, other = make(25), make(40), make(40), make(40)
    docs = [(1, make(40) + anchor + make(40))]  # owns the anchor with words around it that no other text has
    docs += [(i, make(9) + left + anchor + right + make(i % 7)) for i in range(2, 30)]  # match each other, not the owner
    docs += [(40, left[20:] + anchor + other), (40, make(60) + left[-25:] + anchor + make(3)), (41, other + left), (41, left + other)]
    docs += [(50, ["same"] * 3000), (51, ["same"] * 70 + make(5)), (52, make(30) + ["x", "y"] * 400), (53, ["x", "y"] * 40)]
    docs += [(60, make(49) + left + right), (61, left[:49]), (62, left + right[:10]), (62, left + right[:10]), (None, left + right)]
    docs = [(i, " ".join(w)) for i, w in docs]
    got = substring_dedup.repeats(table(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(docs)


def test_a_cut_text_keeps_its_line_breaks(spark):
    passage = " ".join(words(random.Random(8), 60, 10**6))
    docs = [(1, passage), (2, f"one\ntwo  three\n{passage}\nfour\tfive"), (3, f"a {passage}"), (4, f"{passage} z\n"), (5, None)]
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(table(spark, docs)).collect()}
    assert got == {1: passage, 2: "one\ntwo  three\nfour\tfive", 3: "a", 4: "z", 5: None}


# 10: byte-level BPE
@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_bpe_equals_reference_tokenizer(spark, tokenizer):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "th", "é", "ß", " ", "  ", "\n", "ing", "日", "😀", "1", "23", "!", "'s", " ", "\t"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    docs = [(100 + i, t) for i, t in enumerate(texts)] + [(50, "a" * 5000), *EDGE]
    want = Counter()
    for i, t in docs:
        ids = tokenizer.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = bpe.encode_documents(table(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    short = [d for d in docs if d[0] != 50]
    folded = bpe.encode_documents_by_fold(table(spark, short)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in folded) == want - Counter({k: v for k, v in want.items() if k[0] == 50})
    assert bpe.encode_documents(table(spark, [])).isEmpty()
    tokens = bpe.with_tokens(table(spark, docs).where("doc_id = 100")).first()
    assert tokens.tokens == tokenizer.encode_ordinary(texts[0]) and tokens.n_tokens == len(tokens.tokens)


def test_merging_a_long_word(tokenizer):
    encode, decode = bpe.encoder(bpe.read_ranks()), bpe.decoder(bpe.read_ranks())
    for text in ("ab" * 20000, "é" * 3000, " " * 1000 + "x"):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == tokenizer.encode_ordinary(text)
        assert decode(encode(text)) == text.encode()


