import os

import duckdb
import pytest
from pyspark.sql import functions as F

from yelken import catalog
from yelken.functions import text, urls
from yelken.operators import classify, nearest, relational
from yelken.sources import feeds
from yelken.streaming import ledger

DATA = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_text(spark):
    assert one(spark, "Köprüde HÂKİM rüzgâr!  Sahil’de", text.for_matching) == "köprüde hakim rüzgar sahilde"
    assert one(spark, " İZMİT ", text.ascii_fold) == "izmit"
    assert one(spark, "a!!!! 🔥 b_c", text.allowed_characters) == "a!   b c"
    assert one(spark, "bir iki üç\nBİR İKİ ÜÇ\nkısa\ndört beş altı.  Yedi sekiz dokuz", text.clean_lines) == "bir iki üç\ndört beş altı.\nYedi sekiz dokuz"
    assert one(spark, "Foto : biri çekti bunu\n12.10.2016 14:30\nTüm haberleri için tıklayın\nbir iki üç dört", text.clean_lines) == "bir iki üç dört"
    assert one(spark, None, text.clean_lines) == "" and one(spark, "Başlık burada bir\ngövde metni işte bu", lambda c: text.clean_lines(c, F.lit("BAŞLIK BURADA BİR"))) == "gövde metni işte bu"
    for v in ("Köprüde HÂKİM rüzgâr!  Sahil’de", "ÎÛ ısı", "a‍b", None, "", "Şile 'x' İI"):
        assert text.matching_text(v) == one(spark, v, text.for_matching)
    assert one(spark, "Kaza oldu - Sahil Haber", lambda c: text.clean_title(c, "haber")) == "Kaza oldu"
    assert one(spark, None, text.for_matching) == ""


@pytest.mark.parametrize(
    ("href", "want"),
    [("/haber/12345/x/?a=1#b", "https://www.a.example/haber/12345/x"), ("http://A.example//haber//1", "https://www.a.example/haber/1"), ("https://b.example/x", None), ("mailto:a@b", None), ("", None), ("x/y", "https://www.a.example/x/y"), ("/", "https://www.a.example/"), (None, None)],
)
def test_urls(spark, href, want):
    assert one(spark, href, lambda c: urls.normalize_url(c, F.lit("https://www.a.example"))) == want


def test_classify_rules(spark):
    rows = [(1, "Otomobil ile kamyon çarpıştı", "Trafik kazasında sürücü yaralandı"), (2, "Tatbikat", "yangın tatbikatı"), (3, None, None), (4, "alev alev yandı", "alev alev alev"), (1, "tekrar", "")]
    df = spark.createDataFrame(rows, "id int, title string, content string")
    got = {r.id: r.category for r in classify.classify(df, "id", "title", "content").collect()}
    assert len(got) == 4 and got[2] is None and got[3] is None and got[4] == "yangin"
    hits = {(r.keyword, r.in_title): r.hits for r in classify.keyword_hits(df.where("id = 4"), "id", "title", "content").collect()}
    assert hits["alev alev", False] == 1 and hits["alev", False] == 3


def test_waterfall_and_markers(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "k int, r int, ok boolean")
    assert {tuple(r) for r in relational.waterfall(df, "k", "r", F.col("ok")).collect()} == {(1, 2, 2), (2, None, 1)}
    pins = spark.createDataFrame([(1, 40.0, 30.0), (2, 40.0, 30.0)], "id int, lat double, lng double")
    shown = {r.id: r.shown_lat for r in relational.spread_markers(pins, "lat", "lng", [F.col("id")]).collect()}
    assert shown[1] == 40.0 and shown[2] != 40.0


def test_early_stop_equals_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(g, i, rng.choice(["old", "fresh", "fail"])) for g in range(20) for i in range(40)]
    want = set()
    for g in range(20):
        streak = done = 0
        for _, i, what in [r for r in rows if r[0] == g]:
            if done >= 15 or streak >= 3:
                break
            want.add((g, i))
            done += what != "old"
            streak = streak + 1 if what == "old" else 0 if what == "fresh" else streak
    df = spark.createDataFrame(rows, "g int, i int, what string")
    got = relational.early_stop(df, "g", [F.col("i")], F.col("what") != "old", F.col("what") == "old", F.col("what") == "fresh", 15, 3)
    assert {(r.g, r.i) for r in got.collect()} == want


def test_greedy_merge_equals_sequence(spark):
    import random

    rng = random.Random(5)
    links = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    leaders, want = [], {}
    for k in range(30):
        near = [a for a in leaders if (a, k) in links]
        want[k] = near[0] if near else k
        if not near:
            leaders.append(k)
    got = nearest.greedy_merge(spark.range(30), "id", spark.createDataFrame(links, "key_a bigint, key_b bigint"))
    assert {r.id: r.leader for r in got.collect()} == want


def test_greedy_merge_joins_most_similar_leader(spark):
    import random

    rng = random.Random(6)
    links = {tuple(sorted(rng.sample(range(40), 2))): rng.choice([0.3, 0.4, 0.5, 0.6]) for _ in range(120)}
    leaders, want, smallest = [], {}, {}
    for k in range(40):
        near = [a for a in leaders if (a, k) in links]
        want[k] = max(near, key=lambda a: links[a, k]) if near else k  # max gives the first of equal ones
        smallest[k] = near[0] if near else k
        if not near:
            leaders.append(k)
    assert want != smallest
    rows = [(a, b, s) for (a, b), s in links.items()]
    got = nearest.greedy_merge(spark.range(40), "id", spark.createDataFrame(rows, "key_a bigint, key_b bigint, similarity double"))
    assert {r.id: r.leader for r in got.collect()} == want


def test_page_fields(spark):
    page = '<meta content="x" name="og:title"><script type="application/ld+json">{"@type":"NewsArticle","headline":"Başlık"}</script><h1>y</h1><a href="/a">1</a><a class=k href=/b>2</a>'
    df = spark.createDataFrame([(page,), ("",), (None,)], "v string")
    rows = df.select(feeds.headline(F.col("v")), feeds.links_of(F.col("v"))).collect()
    assert rows[0][0] == "Başlık" and rows[0][1] == ["/a", "/b"] and rows[1][0] is None


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><link> https://a/1 </link><pubDate>Mon, 25 Jul 2016 21:42:05 +0300</pubDate></item><item><link>https://a/2</link></item></channel></rss>")
    assert {tuple(r) for r in feeds.read_rss(spark, str(tmp_path / "rss.xml")).collect()} == {("https://a/1", 1469472125), ("https://a/2", None)}


def test_streaming_ledger(spark, tmp_path):
    schema = "url string, at timestamp, status string"
    for n, rows in enumerate([[("u", "2016-01-01 00:00:00", "failed"), ("v", "2016-01-01 00:00:00", "saved")], [("u", "2016-01-02 00:00:00", "saved")]]):
        spark.createDataFrame(rows, "url string, at string, status string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger.maintain_ledger(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "url", ["at"], ["status"]).awaitTermination()
    got = {r.url: (r.status, r.n_rows) for r in ledger.read_ledger(spark, str(tmp_path / "out"), "url", ["at"], ["status"]).collect()}
    assert got == {"u": ("saved", 2), "v": ("saved", 1)}
    assert spark.read.parquet(str(tmp_path / "out/delta-1")).count() == 1  # a batch writes its own rows only
    assert ledger.read_ledger(spark, str(tmp_path / "none"), "url", ["at"], ["status"]) is None


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    found, want = catalog.queries()[name](spark, DATA), con.sql(catalog.oracle_sql()[name])
    assert _rows(found.collect(), found.columns) == _rows(want.fetchall(), want.columns)


def test_places(spark):
    from yelken.operators import places

    rows = [(1, "Yeldere'de kaza", "Yeldere ilçesinde kaza oldu. Akçasu Caddesi kapandı. Sonra Akçasu'da kutlama."), (2, "Haber", "Akçasu istikametinde trafik"), (3, None, None), (4, "Ankara", "Ankara ve Yeldere")]
    df = spark.createDataFrame(rows, "id int, title string, content string")
    names = spark.createDataFrame([("Yeldere",), ("Akçasu",), ("Ankara",)], "name string")
    scores = places.place_scores(df, "id", "title", "content", names)
    got = {(r.id, r.name): r.score for r in scores.select("id", "name", "score").collect()}
    assert got[1, "Yeldere"] == 2 + 6 and got[1, "Akçasu"] == 1 and (2, "Akçasu") not in got
    local = {r.id: r for r in places.locality(scores, "id", F.col("name").isin("Yeldere", "Akçasu")).collect()}
    assert local[1].district == "Yeldere" and local[1].is_local and not local[4].is_local and local[4].district is None
    named = spark.createDataFrame([(1, "Kaza Dereboyu Mahallesi Kavaklı Kuyusu Sokak ve Sahil mevkisinde oldu"), (2, None)], "id int, content string")
    assert {r.kind for r in places.address_candidates(named, "id", "content").collect()} == {"street", "quarter", "spot"}


def test_locality_covers_every_story(spark):
    rows = [(1, "Haber", "Yer adı yok."), (2, None, None), (3, "Haber. ", "Olay Akçasu'da oldu. Bolu'da da."), (4, "Ankara'da yangın", "Ankara'da yangın. Kartalya'ya duyuruldu."), (5, "Bolu yolu", "Kartalya Valiliği açıkladı. Bolu'dan geldi, Konya'ya gitti.")]
    rows += [(6, "Kartalya istikametinde kaza", "Konya'da kaza."), (7, "Yıldırım düştü", "Yıldırım evi yaktı."), (8, "Yıldırım'da kaza", "Kaza."), (9, "Haber", "Yeldere ile Akçasu. Ankara'da."), (10, "Nilüfer Çeşmesi", "Nilüfer Yokuşu kapandı."), (1, "Haber", "Yer adı yok.")]
    got = {r.id: (r.local_score, r.foreign_score, r.is_local, r.district) for r in catalog._locality(spark.createDataFrame(rows, "id int, title string, content string")).collect()}
    want = {1: (0, 0, True, None), 2: (0, 0, True, None), 3: (2, 1, True, "Akçasu"), 4: (1, 4, False, None), 5: (2, 2, True, None), 6: (0, 2, False, None), 7: (0, 0, True, None), 8: (0, 2, False, None), 9: (4, 1, True, "Yeldere"), 10: (0, 0, True, None)}
    assert got == want


def test_locality_query(spark):
    found = {r.id: r for r in catalog.queries()["locality"](spark, DATA).collect()}
    stories = {i: f"{t or ''}\n{c or ''}" for i, t, c in duckdb.sql(f"SELECT id, title, content FROM '{DATA}/news.parquet'").fetchall()}
    assert set(found) == set(stories)
    # none of these stories names a place elsewhere
    assert all(r.is_local and r.foreign_score == 0 for r in found.values())
    assert {r.district for r in found.values()} >= set(catalog._DISTRICTS)
    assert all(r.district is None or r.district in stories[i] for i, r in found.items())


def test_link_dedup_keeps_addresses_without_number(spark):
    rows = [("a", "https://a/haber/12345/uzun-ad", 1), ("a", "https://a/haber/12345/ad", 2), ("a", "https://a/haber/12345/da", 3), ("a", "https://a/hakkinda", 1), ("a", "https://a/iletisim", 2), ("a", "https://a/iletisim", 3)]
    rows += [("a", "https://a/yazi-4321", 1), ("a", "https://a/y-4321", 2), ("b", "https://b/hakkinda", 1)]
    df = spark.createDataFrame([(*r, None) for r in rows], "site_name string, url string, first_seen int, updated_at int")
    want = {("a", 12345, "https://a/haber/12345/ad", 3), ("a", 0, "https://a/hakkinda", 1), ("a", 0, "https://a/iletisim", 2), ("a", 4321, "https://a/y-4321", 2), ("b", 0, "https://b/hakkinda", 1)}
    assert {tuple(r) for r in catalog._link_dedup(df).drop("updated_at").collect()} == want
    hinted = spark.createDataFrame([(1, "xx", 1, None), (1, "x", 2, "late"), (1, "y", 3, "later")], "k int, url string, at int, hint string")
    assert tuple(relational.link_dedup(hinted, ["k"], "url", "at", "hint").first()) == (1, "x", "late", 1, 3)


def test_address_candidates_of_all_kinds(spark):
    rows = [
        (1, "TEM'de kaza", "Olay Yeldere’nin Dereboyu Mahallesi Uzun Kuyu Sokak’ta oldu. Akçasu Mahallesi'nde de duyuldu. Gürgen ve Vişneli mahallelerinde de. D-100 kara yolu Taşlı Sapağı mevkiinde kapandı."),
        (2, "Haber", "Yeldere Sanayi Sitesi ile Kumlu köyü arasında, Yeldere-Akçasu yolu Çınar çıkışında. Bolu'nun Taşköprü Mahallesi'nden geldi. Yeldere Şehir Hastanesi'ne gitti."),
        (3, "Ankara'da yangın", "Ankara Atatürk Caddesi."),
        (4, "Haber", "Kartalya Büyük Kavşağı, 1161. Sokak, büyük kavşağı. Söğütlü Köprülü Kavşağı'nda."),
        (5, None, None),
    ]
    got = {}
    for r in catalog._address_candidates(spark.createDataFrame(rows, "id int, title string, content string")).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.text, r.kind, r.level))
    assert got == {
        1: [("Uzun Kuyu Sokak", "street", 5), ("Taşlı Sapağı", "spot", 4), ("Dereboyu Mahallesi", "quarter", 3), ("Akçasu Mahallesi", "quarter", 3), ("Gürgen Mahallesi", "quarter", 3), ("Vişneli Mahallesi", "quarter", 3), ("TEM Otoyolu", "road", 2), ("D-100 Karayolu", "road", 2), ("Yeldere", "district", 1)],
        2: [("Çınar çıkışı", "spot", 4), ("Kumlu Köyü", "village", 3), ("Yeldere-Akçasu Yolu", "road", 2), ("Yeldere", "district", 1)],
        4: [("1161 Sokak", "street", 5), ("Büyük Kavşağı", "spot", 4), ("Söğütlü Köprülü Kavşağı", "spot", 4)],
    }


def test_places_of_several_words(spark):
    from yelken.operators import places

    df = spark.createDataFrame([(1, "Haber", "Uzun Kuyu Köyü değil. Taş Köprü'de kaza. Taş Köprülü değil, Taş değil. Taş Köprü ilçesi.")], "id int, title string, content string")
    names = spark.createDataFrame([("Taş Köprü",), (" Uzun Kuyu ",), (None,), ("",)], "name string")
    got = {(r.name, r.score) for r in places.place_scores(df, "id", "title", "content", names).collect()}
    assert got == {("Taş Köprü", 1 + 3)}


def test_ranked_and_early_stop(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice("aaaab") if i % 50 else None, i, rng.choice(["old", "hint", "fresh", "fail", "known"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, what string")
    got = {(r.g, r.i): r.n for r in relational.ranked(df, "g", [F.col("i")], "n", 7).collect()}
    seen, want = {}, {}
    for g, i, _ in rows:
        want[g, i] = seen[g] = seen.get(g, 0) + 1
    assert got == want
    w = F.col("what")
    kept = relational.early_stop(df.where("g is not null"), "g", [F.col("i")], w != "hint", w == "old", w == "fresh", 20, 4, w == "known", w == "hint")
    want = set()
    for g in "ab":
        done = streak = 0
        for _, i, what in [r for r in rows if r[0] == g]:
            if done >= 20 or streak >= 4:
                break
            if what == "known":
                continue
            want.add((g, i))
            done += what != "hint"
            streak = streak + 1 if what in ("old", "hint") else 0 if what == "fresh" else streak
    assert {(r.g, r.i) for r in kept.collect()} == want
    assert relational.ranked(df.limit(0), "g", [F.col("i")], "n").count() == 0


def test_nearest_in_window(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    make = lambda n, k: [(f"{k}{i:02}", float(rng.integers(0, 400)) if i % 9 else None, rng.normal(size=4 if i % 7 else 3).tolist() if i % 8 else None) for i in range(n)]
    q, h = make(40, "q"), [*make(60, "h"), ("z1", 10.0, [0.0] * 4)]
    got = {r.key: (r.best, r.similarity) for r in nearest.nearest_in_window(*[spark.createDataFrame(x, "key string, at double, vec array<float>") for x in (q, h)], 50).collect()}
    for k, at, v in q:
        best = (None, 0.0)
        for o, t, u in sorted(h, key=lambda r: r[0]):
            if at is not None and t is not None and v and u and len(u) == len(v) and abs(at - t) <= 50:
                a, b = np.float32(v).astype(float), np.float32(u).astype(float)
                s = float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
                if best[0] is None or s > best[1] + 1e-12:
                    best = (o, s)
        assert got[k][0] == best[0] and got[k][1] == pytest.approx(best[1], abs=1e-9)
    pairs = nearest.cosine_pairs(spark.createDataFrame([(i, rng.normal(size=3).tolist(), 1) for i in range(50)] + [(60, None, 1), (61, [1.0], 1)], "k int, v array<float>, b int"), "k", "v", "b", 0.5, 7)
    assert pairs.count() == pairs.distinct().count() > 0 and pairs.where("key_a >= key_b").count() == 0
    made = nearest.embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t").collect()
    assert abs(np.linalg.norm(made[0].embedding) - 1) < 1e-6 and not any(made[1].embedding)


def test_pages():
    from yelken.sources import pages

    page = """<html><head><script>x</script></head><body><nav><p>menu menu menu menu</p></nav><div class="related-box"><p>ilgili haber satırı burada</p></div><!-- <p>not</p> -->
 <div id="ad-top"><p>kısa</p></div><article class="haber-yazar"><h1>Baş</h1><p>Birinci paragraf uzun uzun sürüyor<br>ikinci satır<p>Kapanmamış paragraf <b>kalın</b> yazı<blockquote><p>Alıntı &amp; söz</p></blockquote><ul><li>bir<li>iki</ul></article></body></html>"""
    lines = [" ".join(x.split()) for x in pages.lines_of_page(page) if x.strip()]
    assert lines == ["Birinci paragraf uzun uzun sürüyor", "ikinci satır", "Kapanmamış paragraf kalın yazı", "Alıntı & söz", "bir", "iki"]
    assert [x for x in pages.lines_of_page("düz<div>metin</div>") if x.strip()] == ["düz", "metin"] and pages.lines_of_page(None) == pages.lines_of_page("") == []
    long = "<div><p>" + "a" * 100 + "</p><p>" + "b" * 100 + "</p></div><div><p>kısa</p></div>"
    assert pages.body_of_page(long) == ["a" * 100, "b" * 100] and pages.body_of_page("<p>x</p><p>y</p>") == ["x", "y"]
    assert pages.body_of_page(long + "<div class='k haber'>" + "c" * 151 + "</div>", (("", "yok"), ("div", "haber"))) == ["c" * 151]
    ld = '<script type="application/ld+json">[{"@type":"WebPage","headline":"w"},{"@graph":[{"@type":["NewsArticle"],"headline":"bir\n iki","articleBody":1}]}]</script><script type="application/ld+json">{bad</script>'
    assert pages.story_data(ld)["headline"].startswith("bir") and pages.story_data("<p>") == {}


def test_dates_in_text_and_charsets(spark):
    from yelken.operators import timestamps

    for value, want in [("Yayın: 5 Ekim 2016 Çarşamba saat 14.30 güncel", "5 ekim 2016 14.30"), ("x 1.2.2016 ve 3 Oca. 2017", "3 oca 2017"), ("no 12/10/2016 - 09:05", "12/10/2016 09:05"), ("tarih yok", None), (None, None)]:
        assert one(spark, value, timestamps.find_date) == want
    assert one(spark, "x 5 Ekim 2016 14.30", lambda c: timestamps.parse_instant(timestamps.find_date(c), F.lit("UTC"))) == 1475677800
    assert one(spark, "2016-02-30", timestamps.iso_date) is None and str(one(spark, " 2016-02-29", timestamps.iso_date)) == "2016-02-29"
    df = spark.createDataFrame([(bytearray("ığş".encode()), "iso-8859-1"), (bytearray("ığş".encode("cp1254")), None), (bytearray("ż".encode("iso-8859-2")), "iso-8859-2"), (None, None), (bytearray("ş".encode("cp1254")), "nope")], "b binary, c string")
    assert [r[0] for r in df.select(feeds.decoded("b", "c")).collect()] == ["ığş", "ığş", "ż", None, "ş"]


def test_sitemaps(spark, tmp_path):
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>{tmp_path}/{n}.xml</loc></sitemap>" for n in ("a", "b", "haber1", "news2")) + "</sitemapindex>")
    for n in ("a", "b", "haber1", "news2"):
        (tmp_path / f"{n}.xml").write_text(f"<urlset><url><loc> https://x/{n} </loc><lastmod>2016</lastmod></url></urlset>")
    assert {r.loc for r in feeds.read_sitemaps(spark, str(tmp_path / "index.xml")).collect()} == {"https://x/haber1", "https://x/news2", "https://x/a"}
    assert {r.loc for r in feeds.read_sitemaps(spark, str(tmp_path / "b.xml")).collect()} == {"https://x/b"}
    (tmp_path / "atom.xml").write_text('<feed><entry><link href="https://a/9"/><updated>2016-07-25T21:42:05+03:00</updated></entry></feed>')
    assert [tuple(r) for r in feeds.read_atom(spark, str(tmp_path / "atom.xml")).collect()] == [("https://a/9", 1469472125)]


def test_geocode_queries(spark):
    from yelken.operators import geocoding

    rows = [(1, "Gül Sokak", "street", 1, "Yeldere"), (1, "Lale Caddesi", "street", 2, "Yeldere"), (1, "Taş Köprüsü", "spot", 3, "Yeldere")] + [(1, f"{c} Mahallesi", "quarter", 4 + i, "Yeldere") for i, c in enumerate("ABCD")]
    rows += [(1, "TEM Otoyolu", "road", 9, "Yeldere"), (1, "Yeldere", "district", 10, "Yeldere"), (2, "TEM Otoyolu", "road", 1, None)]
    got = {}
    for r in geocoding.build_queries(spark.createDataFrame(rows, "id int, text string, kind string, rank int, district string"), "id", "Kartalya").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.query.removesuffix(", Yeldere, Kartalya").removesuffix(", Kartalya"), r.level))
    assert got[1] == [("Gül Sokak, Lale Caddesi, A Mahallesi", 5), ("Lale Caddesi, A Mahallesi", 5), ("Gül Sokak, A Mahallesi", 5), ("Taş Köprüsü", 4), ("A Mahallesi", 3), ("B Mahallesi", 3), ("C Mahallesi", 3), ("TEM Otoyolu", 2), ("Yeldere", 1)]
    assert got[2] == [("TEM Otoyolu", 2)]
    cache = spark.createDataFrame([("m", "a b", "x"), ("m", "c", None), ("other", "d", "y")], "provider string, key string, answer string")
    asked = []

    def ask(missing):
        asked.extend(r.query for r in missing.collect())
        return missing.select("key", F.lit("new").alias("answer"))

    found = geocoding.looked_up(spark.createDataFrame([("A  B",), ("C",), ("D",), ("d",)], "query string"), cache, "m", ask)
    assert {(r.query, r.cached, r.answer) for r in found.collect()} == {("A  B", True, "x"), ("C", True, None), ("D", True, "new"), ("d", True, "new")} and set(asked) == {"D"}


def test_working_folder_needs_setting_on_clusters():
    from types import SimpleNamespace

    from yelken.session import shared_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
