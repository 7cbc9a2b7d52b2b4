"""Decontamination, language, URLs, near-duplicates, top-k, toxicity and the pipeline against brute force."""

from __future__ import annotations

import collections
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechloom.llm import decontamination as dc
from speechloom.llm import near_duplicates as nd
from speechloom.llm import top_k as tk
from speechloom.llm import toxicity as tx
from speechloom.llm.decontamination import find_leaks
from speechloom.llm.language_id import fit_languages, identify
from speechloom.llm.samples import bounded_sample, held_out
from speechloom.llm.top_k import top_k
from speechloom.llm.url_filter import judge_urls, segment

from .fixtures import SCHEMA, documents, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


# ---- decontamination

QUESTION = "If the farmer Miller sells 12 apples for 3 dollars and Miller buys 12 pears, how many of his apples remain in the basket at the end?"


def brute_template(text):
    """[(kind, value)] of a text's tokens, worked out word by word."""
    tokens, last = [], None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+(?:(?<=[0-9])[.,:/-](?=[0-9])[0-9A-Za-z\x80-\U0010ffff]+)*", text):
        parts = re.split(r"[.,:/-]", m[0])
        assert all(p[0].isdigit() for p in parts[1:])
        word = m[0]
        between = text[last:m.start()] if last is not None else None
        number = word[0] in "0123456789" or word.lower() in dc.NUMBER_WORDS.split()
        if number:
            kind = "num"
        elif tokens and tokens[-1][0] == "num" and word.lower() in dc.UNITS.split():
            kind = "unit"
        elif word[0].isupper() and not ("A" <= word[1:2] <= "Z") and between is not None and not set(between) & set('.!?:;\n|"'):
            kind = "name"
        else:
            kind = ""
        tokens.append((kind, re.sub(r"[.,:/-]", " ", word.lower())))
        last = m.end()
    return tokens


def brute_leaks(texts, items, n=5):
    """{(text number, item number): (windows, kind)} by trying every alignment of every text with every item."""
    sides = [[brute_template(t or "") for t in side] for side in (texts, items)]
    shape = lambda t: t[0] or t[1]
    valid = lambda t, i: i >= 0 and i + n <= len(t) and sum(k == "" for k, _ in t[i : i + n]) >= 3
    out = {}
    for (a, text), (b, item) in itertools.product(enumerate(sides[0]), enumerate(sides[1])):
        places = [p for p in range(len(item) - n + 1) if valid(item, p)]
        values = [v for _, v in item]
        if not places:
            words = [v for _, v in text]
            held = any(words[i : i + len(values)] == values for i in range(len(words) - len(values) + 1))
            if values and (held if len(values) > 2 else words == values):
                out[a, b] = (1, "exact")
            continue
        held, exact = set(), set()
        for shift in range(-len(item), len(text)):
            own = [p for p in places if valid(text, p + shift) and [shape(x) for x in item[p : p + n]] == [(shape(x)) for x in text[p + shift : p + shift + n]]]
            slots = {(item[q], text[q + shift]) for p in own for q in range(p, p + n) if item[q][0]}
            if len({w for w, _ in slots}) == len(slots):
                held |= set(own)
                exact |= set(own) if all(w == h for w, h in slots) else set()
        if len(held) >= 0.5 * len(places):
            out[a, b] = (len(held), "exact" if exact == held else "reparameterised")
    return out


def test_leaks(spark, docs):
    texts = [
        QUESTION,
        "Some words before. " + QUESTION.lower() + " And after.",  # lower-cased, the names are no slots
        QUESTION.replace("Miller", "Carter").replace("12", "1,250").replace("dollars", "euros"),
        QUESTION.replace("12 apples", "15 apples"),  # 12 stands for 15 and for 12
        QUESTION[:40], "12 13 14 15 16 17 18", "12 13 14 15 16", None, "", "too short", "This is too short.", "far too short a text", "Yes", "yes!", "Oh yes",
        "Wie viele Äpfel hat Herr Öztürk, wenn er 3,5 kg kauft? twenty-one miles",
    ]
    items = [QUESTION, None, "Far too short", "12 13 14 15 16 17", "yes", "", "...", "too short", "Wie viele Birnen hat Herr Weber, wenn er 7 kg kauft?", QUESTION]
    rng = random.Random(11)
    pool = ["Anna", "Bob", "7", "8", "1,5", "kg", "two", "apples", "buys", "sells", "and", "the", "of", "then", "Über"]
    made = lambda k: " ".join(rng.choice(pool) + rng.choice(["", "", "", ".", ","]) for _ in range(k))
    items += [made(rng.randrange(3, 16)) for _ in range(25)]
    texts += [made(4) + " " + items[rng.randrange(10, 35)].replace("Anna", rng.choice(["Anna", "Zoe"])).replace("7", rng.choice(["7", "9"])) + " " + made(6) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id int, text string, doc_id string")
    got = find_leaks(rows, bench).collect()
    want = brute_leaks(texts, items)
    assert {(r.doc_id, r.item_id): (r.windows, r.kind) for r in got} == want and len(got) == len(want)
    assert want[0, 0][1] == "exact" and want[2, 0][1] == "reparameterised" and (3, 0) not in want and want[1, 0][1] == "exact"
    short = {(a, b) for a, b in want if 4 <= a <= 14 and b in (2, 3, 4, 7)}
    assert short == {(11, 2), (5, 3), (12, 4), (13, 4), (9, 7)}
    twice = rows.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("int"))
    assert [(r.doc_id, r.item_id) for r in find_leaks(twice.unionByName(twice), bench.filter("item_id = 0")).collect()] == [(None, 0)] * 2
    assert find_leaks(rows.limit(0), bench).collect() == [] and find_leaks(rows, bench.limit(0)).collect() == []


# ---- language


def test_languages(spark):
    rng = random.Random(3)
    stems = {"aa": ["kalo", "miru", "teva", "sono"], "bb": ["grunt", "schlag", "pfeil", "zwick"]}
    text = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=rng.randrange(1, 4))) for _ in range(n))
    train = [(i, text(lang, 40), lang) for i in range(60) for lang in stems] + [(0, None, "aa"), (0, "x", None), (0, "123", "bb")]
    test = [(i, text(lang, n), lang) for i in range(20) for lang in stems for n in (4, 400)]
    odd = [(900, None, None), (901, "", None), (902, "12 !!", None), (903, "Kalo" * 40000, "aa")]
    model = fit_languages(spark.createDataFrame(train, "doc_id int, text string, lang string"))
    assert set(model) == {"aa", "bb"} and max(map(len, model.values())) <= 96 << 10
    rows = spark.createDataFrame(test + odd, "doc_id int, text string, lang string").withColumn("score", F.lit("clash"))
    got = identify(rows, model).collect()
    assert len(got) == len(test) + len(odd)
    for r in got:
        if r.lang is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == r.lang and 0.5 < r.score <= 1
            assert r.doc_id == 903 or not r.rejected  # one word over and over: no dictionary helps much
    assert {r.lang_pred for r in identify(rows, {}).collect()} == {"und"}
    assert identify(rows.limit(0), model).collect() == []


def test_dictionaries_hold_whole_texts(spark):
    texts = [" ".join(words(random.Random(i), 30)) + " é" for i in range(40)] + ["lang " * 5000]
    model = fit_languages(spark.createDataFrame([(t, "aa") for t in texts] + [("big " * 3000, "bb"), ("huge " * 4000, "bb")], "text string, lang string"), dict_bytes=2000)
    plain = [" " + re.sub(r"[\W\d_]+", " ", t).strip() + " " for t in texts]
    left = model["aa"].decode()
    assert 1500 < len(model["aa"]) <= 2000
    for t in sorted(plain, key=len, reverse=True):
        left = left.replace(t, "", 1)
    assert not left and model["bb"].decode() == " " + "big " * 3000  # none fits: the shortest


def test_language_of_documents(spark):
    """Held-out accuracy on the given documents, by length."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = spark.read.parquet(path).filter("lang is not null").withColumn("held", held_out(F.col("doc_id")))
    got = identify(rows.filter("held"), fit_languages(rows.filter("not held"))).filter("lang_pred != 'und'").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(right) > 100 and sum(right) / len(right) >= 0.98
    assert all(r.lang == r.lang_pred for r in got if not r.rejected and len(r.text) > 200)


def test_bounded_sample(spark):
    rows = spark.range(4000).withColumn("label", F.when(F.col("id") < 50, "few").otherwise("many")).withColumn("h", F.xxhash64("id"))
    got = {r["label"]: r["count"] for r in bounded_sample(rows, "label", "h", 100).groupBy("label").count().collect()}
    assert got["few"] == 50 and 60 < got["many"] < 140


# ---- urls

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    urls = [None, "", "no-scheme/x", "http://A.Example.COM/en/71?x#y", "http://example.com/en/8", "https://example.net/de/81", "https://x.net/de/", "http://notcom/en/1", "ftp://ÄB.org/es/", "http://h?q", "http://h#f", "a://b://c/d", "http://m.net/fr/1", "http://m.com/fr/2\nx"]
    rows = spark.createDataFrame([(i, u, "<p>good words here</p><script>no()</script>", "c") for i, u in enumerate(urls)] + [(3, urls[3], None, "c")], "page_id int, url string, html string, host string")
    got = judge_urls(rows, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if rule else r.verdict in ("allow", "block"))
    assert {r.verdict for r in judge_urls(rows, []).collect()} == {"allow"}
    assert judge_urls(rows.limit(0), RULES).collect() == []


def brute_split(run, counts):
    """The likeliest of all splits of a run, by trying each."""
    total = sum(counts.values()) or 1
    cost = lambda w: math.log(counts[w] / total) if w in counts else math.log(1 / total) - 2.5 * len(w)
    ways = []
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        parts = [run[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        ways.append(sum(map(cost, parts)))
    return max(ways)


COUNTS = {"the": 50, "red": 20, "there": 5, "house": 10, "a": 9, "he": 7, "use": 3, "zürich": 2}


def test_segment(spark):
    runs = ["theredhouse", "zzqthehouse", "therehouse", "q", "abc", "xxxxxxxxxxxxxx", "housezürich", "theahe"]
    counts = spark.createDataFrame(list(COUNTS.items()), "word string, n long")
    got = {r.run: r.words for r in segment(spark.createDataFrame([(r,) for r in runs], "run string"), counts).collect()}
    assert got["theredhouse"] == ["the", "red", "house"] and got["therehouse"] == ["there", "house"] and got["housezürich"] == ["house", "zürich"]
    assert set(got) == set(runs) and all("".join(w) == r for r, w in got.items())
    total = sum(COUNTS.values())
    for run, words in got.items():
        best = brute_split(run, COUNTS)
        own = sum(math.log(COUNTS[w] / total) if w in COUNTS else math.log(1 / total) - 2.5 * len(w) for w in words)
        assert own == pytest.approx(best)
    none = segment(spark.createDataFrame([("abc",)], "run string"), counts.limit(0)).collect()
    assert [r.words for r in none] == [["abc"]]


def test_long_urls(spark):
    """A run of 20,000 letters, and a path of 5,000 runs."""
    urls = ["http://" + "thered" * 3000 + "q" * 2000 + ".com/", "http://a.b/" + "/".join(f"x{i}" for i in range(5000)), "http://" + "." * 1000]
    rows = spark.createDataFrame([(i, u, "<p>the red the red house</p>") for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = {r.page_id: r for r in judge_urls(rows, RULES).collect()}
    assert got[0].words[:4] == ["h:the", "h:red", "h:the", "h:red"] and "".join(w[2:] for w in got[0].words) == urls[0][7:-5] + "com"
    assert len(got[1].words) == 2 + 2 * 5000 and got[2].words == [] and got[2].host == "." * 1000


def test_joined_names_decide(spark):
    """Hosts whose joined names were never seen are judged by the words in them; without the words they can't be."""
    rng = random.Random(7)
    good, bad, neutral = ["garden", "school", "library", "museum", "bread"], ["casino", "poker", "jackpot", "bet", "slots"], ["best", "online", "my", "city", "new"]
    name = lambda kind: "".join(rng.sample([*rng.sample(kind, 2), rng.choice(neutral)], 3))
    html = "<p>" + " ".join(good * 9 + bad * 9 + neutral * 20) + "</p>"
    rows = [(i, f"http://{name(bad if i % 2 else good)}.{'ex' if i < 400 else 'other'}/x", html if i < 5 else None) for i in range(500)]
    rules = [(r[1].split("://")[1].split("/")[0] + "/", "block" if r[0] % 2 else "allow") for r in rows if r[0] < 400]
    seen = {r for r, _ in rules}
    got = judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), sorted(set(rules))).collect()
    new = [r for r in got if r.rule is None]
    assert len(new) == 100 and all(r.host + "/" not in seen for r in new)
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in new) >= 98
    assert all("".join(w[2:] for w in r.words if w[:2] == "h:") == r.host.replace(".", "") for r in new)


def test_naive_bayes(spark):
    """Scores against multinomial naive Bayes worked out over the words returned."""
    rng = random.Random(8)
    rows = [(i, f"http://{rng.choice('abcde')}{rng.choice('xyz')}.{rng.choice(['com', 'net', 'org', 'fr'])}/{rng.choice(['en', 'de'])}/{rng.choice('uvw')}{i}", "a b c x y") for i in range(200)]
    rules = [("com/en/", "block"), ("net/de/", "allow"), ("org/", "allow")]
    got = judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), rules).collect()
    verdict = {r: v for r, v in rules}
    n, words = collections.Counter(), {"block": collections.Counter(), "allow": collections.Counter()}
    for r in got:
        if r.rule:
            n[verdict[r.rule]] += 1
            words[verdict[r.rule]].update(r.words)
    known = set(words["block"]) | set(words["allow"])
    size = {v: sum(c.values()) + len(known) + 1 for v, c in words.items()}
    for r in got:
        want = math.log(n["block"] / n["allow"]) + sum(math.log((words["block"][w] + 1) / size["block"]) - math.log((words["allow"][w] + 1) / size["allow"]) for w in r.words)
        assert r.score == pytest.approx(want) and r.verdict == (verdict[r.rule] if r.rule else "block" if want > 0 else "allow")


# ---- near-duplicates


def brute_classes(rows, threshold=0.8, n=5):
    """Classes by exact J_P over all pairs of row texts."""

    def grams(text):
        w = [x.lower() for x in nd_split(text)]
        return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None

    def similarity(x, y):
        """J_P by its definition: the sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
        both = sorted(x.keys() & y.keys())
        if not both:
            return 0.0
        every = both + sorted(x.keys() ^ y.keys())
        vx, vy = (np.array([c[g] for g in every], dtype=float) for c in (x, y))
        k = len(both)
        return float((1 / np.maximum(vx[None, :] / vx[:k, None], vy[None, :] / vy[:k, None]).sum(1)).sum())

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= threshold:
            parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for own in groups.values():
        known = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], min(known) if known else None, len(own)) for i in own]
    return collections.Counter(out)


def nd_split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_duplicates(spark, docs):
    rng = random.Random(5)
    base = words(rng, 120, 5000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(30):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.class_id, r.class_size) for r in nd.near_duplicates(df).collect())
    assert got == brute_classes(rows)
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_of_one_original(spark):
    """A star: the copies are near to the original, and few of them to each other."""
    rng = random.Random(6)
    base = words(rng, 200, 5000)
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        copy = list(base)
        for at in rng.sample(range(4, 196), 4):
            copy[at] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    got = collections.Counter((r.doc_id, r.class_id, r.class_size) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    want = brute_classes(rows)
    assert max(size for _, _, size in want) == 301
    assert got == want

def _generated(plan) -> list[int]:
    """The rows that each Generate of an executed plan made, without those that fill the buckets."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _generated(plan.executedPlan())
    below = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if name == "GenerateExec" else []
    return own + [n for x in below for n in _generated(x)]


def test_a_large_group_makes_a_row_for_each_pair_not_for_each_meeting(spark):
    size, bands = 300, 24
    rows = [(n, n, b) for n in range(size) for b in range(bands)] + [(1000, 7, 99), (7, 7, 99), (1001, 1001, 99)]  # of one root: no pair
    df = spark.createDataFrame(rows, "node long, root long, bucket long").withColumn("place", F.xxhash64("node"))
    pairs, parts = nd._nominate(df, size)
    got = {(r.a, r.b): r.support for r in pairs.collect()}
    assert parts.count() == len(rows)
    large = {k: n for k, n in got.items() if k[1] < 1000}
    assert set(large.values()) <= {bands, 2 * bands} and {x for k in large for x in k} == set(range(size))  # the same partners in all bands
    assert {k: n for k, n in got.items() if k[1] >= 1000} == {(7, 1001): 1, (1000, 1001): 1}
    assert sum(_generated(pairs._jdf.queryExecution().executedPlan())) <= 2 * len(got)


def test_exact_links(spark, monkeypatch):
    """The exact join of what banding leaves: a family around the threshold, weights, short texts, and classes known before."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(11)
    base = words(rng, 120, 900)
    base[50:60] = base[20:30]
    texts = [" ".join(words(rng, n, 900)) for n in (1, 3, 5, 40, 90)]
    for i in range(70):
        copy = list(base)
        for at in rng.sample(range(4, 116), 1 + i % 3):
            copy[at] = f"z{rng.randrange(10**9)}"
        texts.append(" ".join(copy if i % 10 else copy + copy[:40]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string").repartition(4)
    roots = spark.createDataFrame([(10, 9), (9, 9), (12, 9)], "node long, root long")
    root = {10: 9, 12: 9}
    sides = []
    for t in texts:
        owner, value, count, _ = nd.shingles(pa.array([t]))
        order = np.argsort(value)
        sides.append((value[order], count[order]))
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if root.get(a, a) != root.get(b, b) and nd.probability_jaccard(sides[a], sides[b]) >= 0.8}
    got = [(r.a, r.b) for r in nd._exact_links(rows, roots, 0.8, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 100 < len(want) < 2000
    assert nd._exact_links(rows.limit(0), roots, 0.8, 5).collect() == []


def test_prob_minhash():
    rng = np.random.default_rng(1)
    value = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = value[:300], value[60:]
    wa, wb = rng.integers(1, 5, 300), rng.integers(1, 5, 340)
    owner = np.concatenate([np.zeros(300, np.int64), np.ones(340, np.int64)])
    sig = nd.prob_minhash(owner, np.concatenate([a, b]), np.concatenate([wa, wb]), 3, 8192)
    order = lambda v, w: (np.sort(v), w[np.argsort(v)])
    assert (sig[0] == sig[1]).mean() == pytest.approx(nd.probability_jaccard(order(a, wa), order(b, wb)), abs=0.03)
    assert not sig[2].any()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in nd.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


# ---- top-k


@pytest.mark.parametrize(("lists", "broadcast"), [(1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (2, 0)])
def test_top_k(spark, monkeypatch, lists, broadcast):
    """Also where query blocks are too large to be broadcast and both sides are dealt out."""
    monkeypatch.setattr(tk, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(2)
    rows = [(int(i), [int(x) for x in rng.integers(-50, 50, 12)]) for i in range(300)]
    rows += [(i, [1, 2, 3]) for i in range(300, 306)] + [(310, None), (None, [1] * 12), (311, []), (5, rows[7][1])] + [(400 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<bigint>").repartition(4)
    got = top_k(df, df.filter("id % 50 = 0"), k=10, lists=lists, chunk=64, query_block=3)
    want = collections.Counter()
    real = [(i, v) for i, v in rows if i is not None and v]
    for q, qv in real:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, qv, strict=True)), i) for i, v in real if i != q and len(v) == len(qv))[:10]
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    assert collections.Counter((r.query_id, r["rank"], r.id, r.score) for r in got.collect()) == want
    assert top_k(df.limit(0), df.limit(0)).collect() == []


# ---- toxicity


def test_gradients():
    network = tx.Network.random(np.zeros(0, np.uint64))
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    data, starts, ends, firsts = tx.read_words(pa.array(["abc de fghij trash k", "de abc zz"]))
    chars, length, entry, which = network.words_in(data, starts, ends)
    at, text = tx.window_starts(firsts)
    place = at[None, :] + np.arange(tx.WINDOW)[:, None]
    mask, ids, target = (place < firsts[1:][text][None, :]).astype(float), which[np.minimum(place, len(which) - 1)], np.array([1.0, 0.0])
    loss = lambda: network.gradients(chars, length, entry, ids, mask, target)
    _, gradient = loss()
    for k, w in network.weights.items():
        i = np.unravel_index(np.argmax(np.abs(gradient[k])), w.shape)
        old, slope = w[i], []
        for step in (1e-3, -1e-3):
            w[i] = old + step
            slope.append(loss()[0])
            w[i] = old
        assert gradient[k][i] == pytest.approx((slope[0] - slope[1]) / 2e-3, rel=1e-2, abs=1e-5)


def test_windows():
    firsts = np.array([0, 0, 10, 10 + tx.WINDOW + 1, 10 + tx.WINDOW + 1 + 1000])
    at, text = tx.window_starts(firsts)
    for d in range(4):
        covered = {j for a in at[text == d] for j in range(a, min(a + tx.WINDOW, firsts[d + 1]))}
        assert covered == set(range(firsts[d], firsts[d + 1])) and (text == d).sum() >= 1
    data, starts, ends, _ = tx.read_words(pa.array(["Ab-cd", None, "x" * 40, "É1é"]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"x" * 16, b"x" * 16, b"x" * 8, "É".encode(), "é".encode()]


def test_toxicity(spark):
    rng = random.Random(9)
    mean, plain = ["scumbag", "moronic", "trashy"], [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]

    def text(toxic):
        w = rng.choices(plain, k=rng.randrange(5, 150))
        for _ in range(len(w) // 12 + 2 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(mean))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (990, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 350] + [(None, 1), (991, 1), (5, None)], "doc_id long, toxic int")
    network = tx.fit_documents(docs, labels, per_label=200)
    got = tx.score_toxicity(docs.withColumn("score", F.lit("clash")), network).collect()
    assert len(got) == 502 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = [r.predicted == rows[r.doc_id][2] for r in got if r.doc_id is not None and 350 <= r.doc_id < 500]
    assert sum(right) / len(right) >= 0.95
    assert tx.fit_documents(docs, labels.limit(0)) is None
    again = docs.filter("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))
    long = [(700, " ".join(w for _, t, y in rows if not y for w in t.split())[:150_000]), (701, "x" * 50_000), (702, "")]
    odd = spark.createDataFrame(long, "doc_id long, text string")
    more = tx.score_toxicity(odd.withColumn("predicted", F.lit("clash")), network).collect()
    assert [r.doc_id for r in more] == [700, 701, 702] and more[0].predicted == 0 and more[0].score < 0.5
    twice = [r.score for r in tx.score_toxicity(again.unionByName(again), network).collect()]
    assert sorted(twice[:4]) == pytest.approx(sorted(twice[4:]))
    assert tx.score_toxicity(docs.limit(0), network).collect() == [] and tx.fit_documents(docs.limit(0), labels) is None
    assert {r.score for r in tx.score_toxicity(docs, None).collect()} == {0.0}


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices(["the", "and", "ing", "ther", "ou"], k=rng.randrange(1, 4))) for _ in range(n)) + "."
    question = "The farmer sells 12 apples and keeps the rest of them in a basket near the door of his old house"
    key = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    plain = [text(rng.randrange(20, 200)) for _ in range(30)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain)]
    rows += [(100, plain[0], "en", "s"), (101, plain[1] + " again", "en", "s"), (2, plain[2], "en", "s"), (102, plain[3] + " " + question, "en", "s"), (103, plain[4][::-1] + " " + key, "en", "s"), (104, None, "en", "s"), (105, "123", "en", "s"), (None, text(50), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        seen.append(kept.collect())
    ids = [sorted(str(r.doc_id) for r in s) for s in seen]
    every = sorted(str(r[0]) for r in rows)
    assert ids[0] == sorted(x for x in every if x not in ("104", "105"))
    near = {"101", "102"}  # near copies if the text they add to is long enough
    assert set(ids[1]) - near == set(ids[0]) - near - {"100"} and len(ids[1]) == len(set(ids[1]))
    assert ids[2] == [x for x in ids[1] if x != "102"]
    assert ids[3] == ids[2]
    for a, b in zip(sorted(seen[2], key=str), sorted(seen[3], key=str), strict=True):
        assert b.n_chars == len(b.text) and (a.text == b.text if a.doc_id != 103 else "24be" not in b.text and "[secret]" in b.text)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(p.doc_id) for p in pieces} == set(ids[3])
    per_doc = collections.Counter()
    for p in pieces:
        per_doc[p.doc_id] += p.length
    assert all(per_doc[p.doc_id] == p.doc_tokens for p in pieces) and math.prod(per_doc.values()) > 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing_holds_little(spark, monkeypatch):
    """Pieces leave a worker some MB of ids at a time, and what it doesn't use goes back before each batch."""
    from speechloom.llm import fingerprints, packing

    docs, caught, released = spark.createDataFrame([], "doc_id long, text string"), [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(fingerprints, "release_unused", lambda: released.append(1))
    packing.harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["word " * 599] * 1500
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k, k + 1500), pa.int64()), "text": texts}) for k in (0, 1500)]
    made = list(caught[0](iter(batches)))
    assert max(b.num_rows for b in made) <= 1024 and max(b.nbytes for b in made) < 4 << 20 and len(released) == 2
    ids = {}
    for b in made:
        for r in b.to_pylist():
            ids.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
    assert len(ids) == 3000 and len({b"".join(x for _, x in sorted(parts.items())) for parts in ids.values()}) == 1
