"""Small fixtures against brute force; nulls, empty tables, ties, repeated rows and clashing names for every operator."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yelken.llm import abuse, addresses, disguise, history, leaks, main_body, mixture, near_copies, repeated_lines
from yelken.llm.plain import folded, lower_tr, plain


def test_plain():
    assert plain("Κartalуa ｈａｌｉｎｄｅ traﬁk ü a‍b") == "Kartalya halinde trafik ü ab"
    assert plain("Победа \"Ελλάδα\"") == "Победа \"Ελλάδα\""
    assert folded("IĞDIR İzmit Hâlâ") == "igdir izmit hala" and lower_tr("IİÇ") == "ıiç"


def test_disguise(spark):
    rows = [
        ("a", "Κartalya haberi", "temiz metin Kartalya", None, 1), ("b", "Yapı \"Победа\" 🔥", "aile 👨‍👩‍👧 © – “x”", "", 2), ("c", "ü üst", "bo​ş luk", "No: 7", 3),
        ("a", "Κartalya haberi", "temiz metin Kartalya", None, 4), (None, "Κartalya", None, None, 5), ("d", "Qonаk", None, None, 6), ("e", "", "Κartalya ve Κartalyaspor", None, 7),
    ]
    df = spark.createDataFrame(rows, "id string, title string, content string, location_text string, field int")
    got = {(r.id, r.field): r for r in disguise.repair_disguises(df).collect()}
    assert set(got) == {("a", "title"), ("c", "title"), ("c", "content"), ("c", "location_text"), ("d", "title"), ("e", "content")}
    assert got["a", "title"].repaired == "Kartalya haberi" and got["c", "content"].repaired == "boş luk" and got["c", "title"].repaired == "ü üst"
    assert got["d", "title"].n_mixed == 1 and got["d", "title"].n_repaired == 0 and got["d", "title"].repaired == "Qonаk"
    assert got["e", "content"].repaired == "Kartalya ve Κartalyaspor"
    # the vocabulary decides what is repaired, and what an ambiguous look-alike stands for
    words = [("1", "Іspanak aldı", "ıspanak taze", None), ("2", "Іzmir yolu", "izmir izmir", None), ("3", "Qonаk", "qonak", None), ("4", "kıѕır döngü", None, None)]
    amb = {(r.id, r.field): r.repaired for r in disguise.repair_disguises(spark.createDataFrame(words, "id string, title string, content string, location_text string")).collect()}
    assert amb["1", "title"] == "Ispanak aldı" and amb["2", "title"] == "İzmir yolu" and amb["3", "title"] == "Qonak" and amb["4", "title"] == "kıѕır döngü"
    assert disguise.repair_disguises(df.limit(0)).count() == 0


def test_repeated_lines(spark):
    rng = random.Random(1)
    pool = [f"furniture line {chr(97 + i)}" for i in range(8)]
    rows = []
    for i in range(120):
        site = rng.choice(["s", "s", "t"])
        lines = [f"story {rng.choice('abcdefghij') * 3} {rng.choice('klmnop') * 4}" for _ in range(3)]
        at = rng.randrange(3)
        lines[at:at] = pool[: rng.randrange(9)] if rng.random() < 0.5 else [rng.choice(pool), "", "12 34"]
        rows.append((f"{i:03}", site, "\n".join(lines), i))
    rows += [rows[0], (None, "s", "x", 1), ("n", None, "x", 1), ("m", "s", None, 1), ("z", "s", "", 1)]
    df = spark.createDataFrame(rows, "id string, site_name string, content string, line_no int")
    docs = {r[0]: r for r in rows if None not in r[:3]}
    sites = {s: [d for d in docs.values() if d[1] == s] for s in "st"}
    n_docs = {s: {} for s in "st"}
    for s, ds in sites.items():
        for d in ds:
            for k in {repeated_lines.line_key(x) for x in d[2].split("\n")} - {""}:
                n_docs[s][k] = n_docs[s].get(k, 0) + 1
    want = {(d[0], n) for s, ds in sites.items() for d in ds for n, x in enumerate(d[2].split("\n"), 1) if (c := n_docs[s].get(repeated_lines.line_key(x), 0)) >= 5 and c * 10 >= len(ds)}
    found = repeated_lines.repeated_lines(df).collect()
    assert {(r.id, r.line_no) for r in found} == want and len(found) == len(want)
    assert max(r.block_lines for r in found) > 3
    cleaned = {r.id: r.content for r in repeated_lines.without_repeated_lines(df.dropDuplicates(["id"]), "id").collect()}
    assert "furniture line a" not in (cleaned["000"] or "") and cleaned["m"] is None
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def test_block_counts(spark):
    rows = [(f"{i}", "s", "alpha\ngamma\nown text x\nalpha\nbeta") for i in range(10)] + [(f"o{i}", "s", f"other {chr(97 + i)}") for i in range(10)]
    sizes = {(r.id, r.line_no): r.block_lines for r in repeated_lines.repeated_lines(spark.createDataFrame(rows, "id string, site_name string, content string")).collect()}
    assert sizes["0", 4] == 5 - 3 and sizes["0", 1] == 5  # the block alpha, beta; the whole text
    rng = random.Random(5)
    frequent = {1, 2, 3}
    docs = [[rng.choice([1, 2, 3, 9]) for _ in range(12)] for _ in range(40)]
    n, want = {}, {}
    for d in docs:
        for s, k in repeated_lines._suffixes_of(d, frequent):
            for i in range(1, len(s) + 1):
                n[s[:i]] = n.get(s[:i], 0) + k
        for b in {tuple(d[i:j]) for i in range(12) for j in range(i + 1, 13) if 9 not in d[i:j]}:
            want[b] = want.get(b, 0) + 1
    assert n == want


def test_leaks_of_repeated_passages():
    rng = np.random.default_rng(4)
    for most in (1, 50, 10**6):
        train, test = rng.integers(0, 3, 400), rng.integers(0, 3, 120)
        got = {(int(p), int(t)): int(n) for p, t, n in zip(*leaks._shard_matches(train, test, 3, most))}
        run = lambda p, t: next(k for k in itertools.count() if p + k >= len(train) or t + k >= len(test) or train[p + k] != test[t + k] or not train[p + k])
        want = {(p, t): run(p, t) for p in range(400) for t in range(120) if run(p, t) >= 3 and not (p and t and train[p - 1] and train[p - 1] == test[t - 1])}
        assert got == want


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcşıö") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(6)]
    docs = []
    for i in range(80):
        t = [word() for _ in range(50)]
        if i % 3 == 0:
            w = items[i % 6][1].split()
            a = rng.randrange(25)
            t[10:10] = w[a : a + rng.choice([11, 12, 15, 30])]
        docs.append((i, " ".join(t).upper().replace(" ", ",\r\n "), i))
    docs += [docs[0], (90, None, 0), (91, "", 0), (None, items[0][1], 0), (92, items[1][1] + " x " + items[1][1], 0)]
    D, T = spark.createDataFrame(docs, "doc_id bigint, text string, words int"), spark.createDataFrame(items + [(9, None), (10, "kısa")], "item_id bigint, text string")
    want = {}
    for d, text, _ in docs:
        for i, item in items:
            a, b = leaks.words_of(text), leaks.words_of(item)
            best = max((next(k for k in itertools.count() if x + k >= len(a) or y + k >= len(b) or a[x + k] != b[y + k]) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]), default=0)
            if d is not None and best >= 12:
                want[d, i] = best
    for options in ({}, {"shard_words": 100}, {"item_words": 20}):
        assert {(r.doc_id, r.item_id): r.words for r in leaks.find_leaks(D, T, **options).collect()} == want
    assert leaks.find_leaks(D.limit(0), T).count() == leaks.find_leaks(D, T.limit(0)).count() == 0
    assert leaks.without_leaks(D, T).where("doc_id = 92").count() == 0


def test_addresses(spark):
    rows = [
        ("a", "Dereboyu Mahallesi, Kavaklı Kuyusu Sokak No: 12/A, Yeldere, Kartalya", "Yeldere"), ("b", "KAVAKLI KUYUSU SK. 12/a - Kat: 3", "yeldere ilçesi"), ("c", "Kavaklı Kuyuus Sok., no.12 / A D:7; Yeldere", None),
        ("d", "Kavaklı Kuyusu Cad. No 12/A", "Yeldere"), ("e", "Kavaklı Kuyusu Sokak No: 12", "Yeldere"), ("f", "Kavaklı Kuyusu Sokak No: 12/A", "Akçasu"), ("g", "1105. Sk; N: 6; 98001 Yeldere", None),
        ("h", "yeldere 1105 sokak numara 6 daire 2", None), ("i", None, "Yeldere"), ("j", "", ""), ("k", "Kavaklı Kuyusu Sokak", "Yeldere"), ("a", "Dereboyu Mahallesi, Kavaklı Kuyusu Sokak No: 12/A, Yeldere, Kartalya", "Yeldere"),
    ] + [(f"z{i:02}", f"Kavaklı Kuyusu Sokak No: {100 + i}", "Yeldere") for i in range(12)] + [(f"y{i:02}", f"Çınar Köprüsü Caddesi No: {100 + i}", "Akçasu") for i in range(12)] + [(None, "Kavaklı Kuyusu Sokak No: 12/A", "Yeldere")]
    df = spark.createDataFrame(rows, "id string, location_text string, district string")
    pairs = lambda **o: {tuple(r) for r in addresses.place_pairs(*addresses.same_places(df, outer=("kartalya",), **o)).collect()}
    assert pairs() == {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h")}
    assert pairs(min_weight=100.0) == set()  # the weights decide
    assert addresses.same_places(df.limit(0))[0].count() == 0
    near = lambda a, b: spark.range(1).select(addresses.near(F.lit(a), F.lit(b))).first()[0]
    assert near("kuyusu", "kuyuus") and near("abc", "abcd") and not near("abc", "acbd") and not near("1105", "1106")


def test_address_weights_decide(spark):
    """Slips in rare names, which no more frequent spelling puts right, are left to the weights; other streets and long names are told apart."""
    rng = random.Random(9)
    streets = [f"{a} {b}" for a in ("Kavaklı", "Nilüfer", "Menekşe", "Turunç", "Sümbül") for b in ("Kuyusu", "Bostanı", "Feneri")]
    rows = [(f"r{i:04}", f"{'Vişneli Mahallesi, ' if i % 3 else ''}{rng.choice(streets)} Sokak No: {rng.randrange(1, 30)}", "Yeldere") for i in range(300)]
    rows += [("x1", "Vişneli Mahallesi, Portakal Geçidi Sokak No: 90", "Yeldere"), ("x2", "Vişneli Mahallesi, Portkaal Geçidi Sokak No: 90", "Yeldere")]
    rows += [("y1", "Ada Mustafa Kemal Caddesi No: 91", "Yeldere"), ("y2", "Yeni Mustafa Kemal Caddesi No: 91", "Yeldere"), ("y3", "Ada Mustafa Kemal Cad. No: 91", "Yeldere")]
    df = spark.createDataFrame(rows, "id string, location_text string, district string")
    at = lambda w: {tuple(r) for r in addresses.place_pairs(*addresses.same_places(df, min_weight=w)).collect()}
    normal = at(0.0)
    assert ("x1", "x2") in normal and ("y1", "y3") in normal and ("y1", "y2") not in normal
    same = {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if a[1].split(", ")[-1] == b[1].split(", ")[-1]}
    assert {p for p in normal if p[0][0] == "r"} == same
    strict, loose = at(12.0), at(-1e9)
    assert strict < normal < loose


def _vectors(seed, n, dim=8, near=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(centres[rng.integers(6)] + near * rng.normal(size=dim)).tolist() for _ in range(n)]


def _sequential(old, new):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    key = lambda u: u.split("?")[0].rstrip("/")
    kept, out = [r for r in old], {}
    for r in sorted({r[0]: r for r in reversed(new) if r[0]}.values()):
        match = []
        for o in kept:
            same = set(map(key, o[1])) & set(map(key, r[1]))
            if o[2] is not None and r[2] is not None and o[3] and r[3] and len(o[3]) == len(r[3]):
                same = same or abs(o[2] - r[2]) <= 3 * 86_400_000_000 and any(o[3]) and any(r[3]) and float(unit(o[3]) @ unit(r[3])) >= 0.9
            if same:
                match.append(o[0])
        out[r[0]] = min(match, default=None)
        if not match:
            kept.append(r)
    return out


def test_history(spark):
    rng = random.Random(3)
    day = 86_400_000_000
    make = lambda k, n, s: [(f"{k}{i:03}", [f"https://x.example/{rng.randrange(400)}/?q=1"], rng.randrange(40 * day) if rng.random() > 0.1 else None, v if rng.random() > 0.1 else None) for i, v in enumerate(_vectors(s, n))]
    old = make("a", 60, 1) + [("a900", [], 5 * day, [0.0] * 8), ("a901", [], day, [1.0] * 4)]
    new = make("b", 90, 2) + [("b900", ["https://x.example/1"], day, [1.0] * 4), ("b901", [], None, None)]
    schema = "id string, urls array<string>, at bigint, vec array<float>"
    new_df = spark.createDataFrame(new + [new[0], (None, [], None, None)], schema)
    want = _sequential(old, new)
    assert 20 < sum(v is not None for v in want.values()) < 91
    for options in ({}, {"chunk_rows": 4, "cells": 3, "handed_bytes": 0, "in_order_rows": 0}, {"cells": 0}):
        index = history.History.create(spark.createDataFrame(old, schema), **options)
        assert {r.id: r.matched for r in index.check(new_df).collect()} == want
    # batches in turn give the same as one call for all, also when the index is opened again in between and rows are delivered again
    index = history.History.create(spark.createDataFrame(old, schema), cells=3, chunk_rows=4)
    parts = [(*r, i // 46) for i, r in enumerate(new)] + [(*new[3], 1), (*new[10], 1)]
    batches = spark.createDataFrame(parts, schema + ", batch_no int")
    got = {r.id: r.matched for r in history.check_batches(index, batches.where("batch_no = 0")).collect()}
    index = history.History(spark, index.path, chunk_rows=4)
    assert set(index.centres) == {4, 8} and len(index.centres[8]) == 3
    for r in history.check_batches(index, batches.where("batch_no > 0")).collect():
        assert got.setdefault(r.id, r.matched) == r.matched
    assert got == want
    assert index.check(new_df.limit(0)).count() == 0
    # copies of one vector and instant meet others once
    copies = [(f"c{i:02}", [], 5 * day, [1.0] * 8) for i in range(30)] + [("c50", [], 5 * day, [1.0] * 7 + [1.1])]
    assert {r.id: r.matched for r in index.check(spark.createDataFrame(copies, schema)).collect()} == {c[0]: None if c[0] == "c00" else "c00" for c in copies}


def test_url_key(spark):
    same = ["https://www.A.example/x//y/", "http://a.example/x/y?u=1#f", "//a.example/x/y", "a.example/x/y/"]
    df = spark.createDataFrame([(u,) for u in [*same, "", None, "https://a.example/X/y"]], "u string")
    got = [r[0] for r in df.select(history.url_key(F.col("u"))).collect()]
    assert set(got[:4]) == {"a.example/x/y"} and got[4] is None and got[5] is None and got[6] != got[0]


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth, kind = np.array([0, 1, 1, 2, 2, 2, 0, 1]), np.array([0, 0, 0, 1, 1, 1, 2, 2])
    unary, tables = rng.normal(size=8), rng.normal(size=(3, 2, 2))
    total = np.zeros((8, 2))
    for state in itertools.product((0, 1), repeat=8):
        s = sum(unary[i] * state[i] for i in range(8)) + sum(tables[kind[i], state[parent[i]], state[i]] for i in range(8) if parent[i] >= 0)
        for i in range(8):
            total[i, state[i]] += np.exp(s)
    assert np.allclose(main_body.marginals(unary, parent, depth, kind, tables), total[:, 1] / total.sum(1))


def test_main_body(spark):
    d = "/root/testdata/sf0.01"
    raw, news = spark.read.parquet(f"{d}/raw_articles.parquet"), spark.read.parquet(f"{d}/news.parquet")
    model = main_body.train_body_model(raw, news, 200)
    rows = raw.select("raw_id", "title", "body_html").dropDuplicates(["raw_id"]).collect()
    got = {int(r.key): {x.line_no: x.p >= 0.5 for x in r.lines} for r in main_body.main_body(raw, model, "raw_id", "body_html", True).collect()}
    agree = total = 0
    for r in rows:
        lines = main_body.page_lines(r.body_html)[1]
        assert set(got[r.raw_id]) == {x[0] for x in lines}
        for x, y in zip(lines, main_body.label_page(r.body_html, r.title)):
            agree += got[r.raw_id][x[0]] == y
            total += 1
    assert agree / total > 0.98  # 200 of about 500 pages were seen in training
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p>" * 3000 + "a<br"), (None, "<p>x"), (4, "düz metin")], "raw_id int, body_html string")
    assert {r.key for r in main_body.main_body(odd, model, "raw_id", "body_html", True).collect()} == {"2", "3", "4"}
    empty = main_body.train_body_model(raw.limit(0), news.limit(0))
    assert main_body.furniture_lines(odd, empty, "raw_id", "body_html", True).count() == 0


def test_near_copies(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((f"{i:03}", "T " + str(i % 12), " ".join(t), 1))
    rows += [rows[0], ("e", "", "", 1), ("n", None, None, 1), (None, "x", "y", 1), ("s", None, "kısa", 1), ("t", "kısa", "", 1)]
    df = spark.createDataFrame(rows, "id string, title string, content string, digest int")
    for n, t in ((3, 0.5), (5, 0.8), (2, 0.9)):
        members, links = near_copies.near_copies(df, n=n, similarity=t)
        of = {r.key: r.digest for r in members.collect()}
        sets = {r[0]: set(near_copies.gram_hashes(f"{r[1] or ''}\n{r[2] or ''}", n).tolist()) for r in rows if r[0]}
        sets = {k: v for k, v in sets.items() if v}
        assert set(of) == set(sets)
        found = {frozenset((r.a, r.b)) for r in links.collect()}
        for a, b in itertools.combinations(sets, 2):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert (of[a] == of[b]) == (j == 1)
            if j < 1:
                assert (frozenset((of[a], of[b])) in found) == (j >= t - 1e-12)
    assert near_copies.near_copies(df.limit(0))[1].count() == 0


def test_quotas():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "gone": (0.4, 3), "zero": (0.0, 1)}
    tokens = {"a": 1000, "b": 300, "c": 1000, "other": 99}
    q = mixture.quotas(tokens, targets)
    assert q["a"] == pytest.approx(1000) and q["b"] == pytest.approx(600) and q["c"] == pytest.approx(400)
    more = mixture.quotas(tokens, targets, 4000)
    assert more["a"] == 1000 and more["b"] == 600 and more["c"] == pytest.approx(2400)
    assert sum(mixture.quotas(tokens, targets, 10**9).values()) == pytest.approx(1000 + 600 + 3000)
    assert mixture.quotas({}, targets) == {}


def test_mixture(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["elma", "armut", "kiraz"]) for _ in range(rng.randrange(1, 200))), rng.choice("aabc")) for i in range(300)] + [(900, None, "a"), (901, "x", None), (902, "", "b")]
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.2, 3), ("none", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares, plan = mixture.mix_sources(df, targets, block_tokens=16, shard_blocks=8)
    most = {"a": 1, "b": 2, "c": 3}
    rows = chosen.collect()
    assert all(r.repeats <= most[r.source] and r.used_tokens <= r.repeats * r.n_tokens for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r.share for r in shares.collect()}
    assert got["a"] == pytest.approx(0.2 / 0.9, abs=0.01) and got["b"] == pytest.approx(0.5 / 0.9, abs=0.01) and got["none"] == 0
    assert plan.groupBy("source", "block").count().agg(F.max("count")).first()[0] <= 3
    pieces = mixture.pack_blocks(mixture.count_tokens(df), 16)
    full = {r[0]: r[1] for r in pieces.groupBy("key").agg(F.sum("tokens")).collect()}
    assert full == {r.key: r.n_tokens for r in mixture.count_tokens(df).where("n_tokens > 0").collect()}
    assert mixture.mix_sources(df.limit(0), targets)[0].count() == 0
    slots = {"a": 500, "b": 41, "c": 7}
    for groups in (1, 3, 1000):  # every slot once, full shards but the last
        dealt = mixture._shards(spark, slots, 16, 3, groups).collect()
        assert sorted((r.source, i) for r in dealt for i in range(r.start, r.start + r.n)) == [(s, i) for s in "abc" for i in range(slots[s])]
        sizes = {}
        for r in dealt:
            sizes[r.shard] = sizes.get(r.shard, 0) + r.n
        assert len(sizes) == 35 and sorted(sizes.values())[1:] == [16] * 34


def test_abuse(spark):
    rng = random.Random(8)
    good = ["belediye yolu bugün temizledi", "kapılar yarın sabah açılacak", "itfaiye yangını söndürdü", "gerzek filmi sinemada izlendi"]
    bad = ["sen tam bir gerzek soytarısın", "bu şehirli sürüsü defolsun gitsin"]
    docs, labels = [], []
    for i in range(600):
        lines = [rng.choice(good) + "." for _ in range(4)]
        y = i % 4 == 0
        if y:
            lines[rng.randrange(4)] = rng.choice(bad)
        docs.append((i, "\n".join(lines), "s" if i % 2 else None, 1.0))
        labels.append((i, int(y) if rng.random() > 0.05 else None if rng.random() > 0.5 else 1 - int(y)))
    df = spark.createDataFrame(docs + docs[:1] + [(None, "x", "s", 1.0), (901, None, "s", 1.0), (902, "S3n t4m b1r g3rz3k s0yt4r1sın!!", "s", 1.0), (903, "sen tam bir g e r z e k soytarısın", "s", 1.0), (904, "", "s", 1.0)], "doc_id bigint, text string, source string, score double")
    model = abuse.train_abuse_model(df, spark.createDataFrame(labels, "doc_id bigint, label int"), most=400)
    got = {r.doc_id: r for r in abuse.score_abuse(df, model, keep=("source",)).collect()}
    assert len(got) == 604 and np.mean([(got[i].score >= abuse.THRESHOLD) == (i % 4 == 0) for i in range(600)]) > 0.98
    assert got[902].score >= 0.5 and got[903].score >= 0.5 and got[901].score == got[904].score == 0
    assert got[0].sentences and len(got[0].sentences) == 1
    buried = "belediye yolu bugün temizledi " * 30 + "sen tam bir gerzek soytarısın " + "kapılar yarın sabah açılacak " * 30
    assert model.score([buried])[0][0] >= abuse.THRESHOLD > model.score([buried.replace("sen tam bir gerzek soytarısın ", "")])[0][0]
    every = {f for part in abuse.pieces("bir iki üç dört beş altı yedi sekiz", lambda names: list(names)) for f in part}
    assert {"bir", "sekiz", "alti yedi"} <= every  # no word is lost
    rates = {r.source: r for r in abuse.abuse_rates(spark.createDataFrame(list(got.values()))).collect()}
    assert rates[None].n_docs == 300 and rates[None].rate == pytest.approx(0.5, abs=0.03)
    nobody = abuse.train_abuse_model(df, spark.createDataFrame([], "doc_id bigint, label int"))
    assert abuse.score_abuse(df, nobody).where("score >= 0.5").count() == 0
    assert abuse.score_abuse(df.limit(0), model).count() == 0
