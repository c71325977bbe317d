"""Pages, rules, schemas, receipts and live requests on small tables."""

import json
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B&nbsp;shop </title><meta name=description content="First"><META PROPERTY='og:description' CONTENT='Second &quot;x&quot;'>
<script>var t = "<p>no</p>";</script><style>p{}</style><!-- <p>gone</p> --></head><body><h1>Head <b>line</b></h1><h2> </h2><p>One&#33; &#x1F600; &unknown; &#0;</p><p>One&#33; &#x1F600; &unknown; &#0;</p>
<div>ab</div><ul><li><a href="/a/b?x=1#f">Pricing <i>plans</i></a></li><li><a href='c/../d.html'>Product</a></li></ul><a>no address</a><a href=https://shop.example.com/product/2>two</a>
<a href="//cdn.example.org/product">other site</a><a href="mailto:x@y.z">mail product</a><noscript><p>hidden</p></noscript><svg><p>unclosed"""


@pytest.fixture(scope="module")
def page(spark):
    from lexigauge.functions.pages import read_pages

    rows = [(1, "https://www.shop.example.com/x/y?q#z", PAGE, "t"), (2, "http://e.com", None, "t"), (3, "http://e.com", "", "t"), (3, "http://e.com", "", "t"), (4, None, "plain text", "t")]
    return read_pages(spark.createDataFrame(rows, "page_id long, url string, html string, title string"))


def test_page(page):
    got = {r.page_id: r for r in page.collect()}
    assert page.count() == 5 and got[1].title == "A & B shop" and got[1].description == "First" and got[1].headings == ["Head line"]
    assert got[1].blocks == ["Head line", "One! \U0001f600 &unknown; &#0;", "Pricing plans", "Product", "no addresstwo other sitemail product"]
    assert [tuple(x) for x in got[1].links][:2] == [("/a/b?x=1#f", "Pricing plans"), ("c/../d.html", "Product")] and len(got[1].links) == 5
    assert (got[2].title, got[2].blocks, got[2].links) == ("", [], []) and got[4].blocks == ["plain text"]


def test_site_links(page):
    from lexigauge.functions.pages import site_links

    got = [(r.page_id, r.link, r.score) for r in site_links(page, ("product", "pricing", "plan"), 3).orderBy("rank").collect()]
    assert got == [(1, "https://www.shop.example.com/a/b?x=1", 2), (1, "https://shop.example.com/product/2", 1), (1, "https://www.shop.example.com/x/d.html", 1)]


def test_resolve_as_the_library(spark):
    from lexigauge.functions.pages import as_url, resolve

    bases = ["http://a.com", "http://a.com/", "https://a.com:8/b/c/d.html?q=1#f", "http://a.com/b/", "http://a.com?x"]
    links = ["", "#x", "e", "./e", "../e", "../../../e", "/e/../f", "/e/./", "e/..", "?y=2", "e?y=2#z", "//h.org/p", "https://h.org", "mailto:x@y.z", "..", ".", "/", "e/f/../../g"]
    table = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    for r in table.select("b", "x", resolve(F.col("b"), F.col("x")).alias("got")).collect():
        want = urldefrag(urljoin(r.b, r.x))[0]
        assert r.got == want or (r.b == "http://a.com?x" and r.x in ("e", "./e", "../e", ".", "..", "../../../e", "e/..", "e?y=2#z", "e/f/../../g")), (r.b, r.x, r.got, want)
    texts = {"shop.com.tr": "https://shop.com.tr", " HTTP://Shop.com/x ": "HTTP://Shop.com/x", "two words": None, "name": None, "a.b/c d": None, "": None}
    got = {r.x: r.u for r in spark.createDataFrame([(k,) for k in texts], "x string").select("x", as_url(F.col("x")).alias("u")).collect()}
    assert got == texts


RULES = [
    ("aws.amazon.com", "official", "AWS"), ("vercel.com", "official", "Vercel"), ("pages.github.com", "official", "GitHub Pages"), ("amazon.com", "retailer", None),
    ("github.com", "forum", None), ("reddit.com", "forum", None), ("vpnmentor.com", "affiliate", None), ("pcmag.com", "editorial", None),
]
_R = "domain string, kind string, brand string"


def test_kinds_for_brands(spark):
    from lexigauge.functions.urls import kinds_for_brands

    want = {
        ("aws.amazon.com", "AWS"): "official", ("aws.amazon.com", "Vercel"): "vendor_other", ("aws.amazon.com", None): "vendor", ("www.amazon.com", "Vercel"): "retailer", ("pages.github.com", None): "vendor",
        ("github.com", "Vercel"): "forum", ("www.pcmag.com", "Vercel"): "editorial", ("tr.vpnmentor.com", None): "affiliate", ("notamazon.com", None): "unknown", (None, None): "unknown", ("vercel.com", "AWS"): "vendor_other", ("vercel.com", "Vercel"): "official",
    }
    rows = spark.createDataFrame([*want, ("vercel.com", "AWS")], "host string, brand string")
    assert {(r.host, r.brand): r.kind for r in kinds_for_brands(rows, spark.createDataFrame(RULES, _R)).collect()} == want


def test_conflicts(spark):
    from lexigauge.functions.names import form_conflicts
    from lexigauge.functions.urls import rule_conflicts

    brands = spark.createDataFrame([("AWS",), ("Vercel",), ("GitHub Pages",)], "brand string")
    found = lambda rules: {tuple(r) for r in rule_conflicts(spark.createDataFrame(rules, _R), brands).collect()}
    assert found(RULES) == {("amazon.com", "below", "aws.amazon.com official retailer"), ("github.com", "below", "pages.github.com official forum")}
    bad = [("pcmag.com", "editorial", None), ("pcmag.com", "forum", None), ("x.com", "official", "Not A Brand"), ("www.y.com", "forum", None), ("Z.com", "forum", None), ("a.com/b", "forum", None)]
    assert found(bad) == {("pcmag.com", "two_kinds", "editorial,forum"), ("x.com", "unknown_brand", "Not A Brand"), ("www.y.com", "not_bare", "forum"), ("Z.com", "not_bare", "forum"), ("a.com/b", "not_bare", "forum")}
    forms = spark.createDataFrame([("A", "Nord VPN"), ("A", "nordvpn"), ("B", "NORD-vpn"), ("B", "b"), ("C", "--"), ("D", "--")], "brand string, form string")
    assert [tuple(r) for r in form_conflicts(forms).collect()] == [("nordvpn", "A, B", "NORD-vpn, Nord VPN, nordvpn")]


JUDGEMENT = {
    "type": "object", "required": ["brands", "confident", "aware"], "additionalProperties": False,
    "properties": {
        "brands": {"type": "array", "items": {"type": "object", "required": ["name", "rank"], "additionalProperties": False, "properties": {"name": {"type": "string"}, "rank": {"type": ["integer", "null"], "minimum": 1}, "tone": {"type": "string", "enum": ["good", "bad"]}}}},
        "confident": {"type": "boolean"}, "aware": {"type": ["object", "null"], "properties": {"deep": {"type": "object", "properties": {"n": {"type": "number"}}}}},
    },
}


def test_schema(spark):
    from lexigauge.operators.schema import schema_faults

    good = {"brands": [{"name": "a", "rank": 1, "tone": "good"}, {"name": "b", "rank": None}], "confident": True, "aware": None}
    change = lambda **x: {**good, **x}
    cases = {
        "fine": (good, []), "list": ([], [("j", "must be object")]), "missing": ({"brands": []}, [("j", "missing aware, confident")]), "extra": (change(x=1, a=2), [("j", "extra a, x")]),
        "flag": (change(confident="yes"), [("j.confident", "must be boolean")]), "no null": (change(confident=None), [("j.confident", "must be boolean")]), "null": (change(brands=None), [("j.brands", "must be array")]),
        "deep": (change(aware={"deep": {"n": "x"}}), [("j.aware.deep.n", "must be number")]), "deeper": (change(aware={"deep": {"n": 1.5}, "more": 1}), []), "not deep": (change(aware={"deep": 3}), [("j.aware.deep", "must be object")]),
        "items": (change(brands=[{"name": 1, "rank": 0}, 7, {"name": "c", "rank": 2.5, "tone": "odd", "z": 0}]), [("j.brands[0].name", "must be string"), ("j.brands[0].rank", "below minimum"), ("j.brands[1]", "must be object"), ("j.brands[2]", "extra z"), ("j.brands[2].rank", "must be integer or null"), ("j.brands[2].tone", "unsupported value")]),
        "true": (change(brands=[{"name": "a", "rank": True}]), [("j.brands[0].rank", "must be integer or null")]),
    }
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("broken", "{"), ("none", None)]
    got = {}
    for r in schema_faults(spark.createDataFrame(rows, "k string, t string"), "t", JUDGEMENT, ["k"], "j").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.path, r.fault))
    assert got == {**{k: f for k, (_, f) in cases.items() if f}, "broken": [("j", "not JSON")], "none": [("j", "not JSON")]}


def answer(rows):
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return rows.withColumns({"result": F.upper("question"), "status": F.when(F.contains("question", F.lit("fail")), "error").otherwise("ok"), "at": at})


def test_receipts(spark, tmp_path):
    from lexigauge.streaming import receipts as rc

    folder, path = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    write = lambda name, *questions: (folder / name).write_text("".join(json.dumps({"user": 1, "question": q, "n": name}) + "\n" for q in questions))
    stream = lambda: spark.readStream.schema("user long, question string, n string").option("maxFilesPerTrigger", 1).json(str(folder))
    run = lambda name: rc.answering(stream(), ["user", "question"], path, answer, str(tmp_path / name)).awaitTermination()
    table = lambda: sorted(map(str, rc.log(spark, path).collect()))
    assert table() == []
    write("a", "one", "two", "two", "fail")
    run("c")
    first = table()
    assert len(first) == 3
    run("c")  # nothing new
    run("again")  # the same batch delivered once more, as after a lost checkpoint
    assert table() == first
    write("b", "one", "three", "fail")
    run("c")
    log = rc.log(spark, path)
    assert sorted(r.result for r in log.where("batch = 1").collect()) == ["FAIL", "THREE"]  # answered ones are not asked again
    state = {r.result: (r.attempts, r.state) for r in rc.current(log).collect()}
    assert state == {"ONE": (1, "done"), "TWO": (1, "done"), "THREE": (1, "done"), None: (2, "open")}
    assert rc.current(log, most=2).where("state = 'exhausted'").count() == 1
    assert rc.tampered(log).count() == 0
    forged = log.withColumn("result", F.when(F.col("result") == "TWO", F.lit("2")).otherwise(F.col("result"))).withColumn("request", F.when(F.col("result") == "ONE", F.lit("x")).otherwise(F.col("request")))
    assert sorted(r.fault for r in rc.tampered(forged).collect()) == ["request", "result"]
    assert rc.current(forged).where("state = 'open'").count() == 2  # a forged result does not count
    rc.compact(spark, path, str(tmp_path / "small"))
    small = rc.log(spark, str(tmp_path / "small"))
    assert small.count() == 5 and sorted(map(str, rc.current(small).collect())) == sorted(map(str, rc.current(log).collect()))


def test_live_requests(spark, tmp_path):
    """A stream of requests and a table of them get the same ranks."""
    from lexigauge.operators import models as mo
    from lexigauge.streaming import live as lv

    registry = (("A", "Alpha"), ("B", "Betamax"), ("C", "Gamma"))
    rows = [
        ("r1", [(1, "official", "Alpha and Betamax"), (2, "forum", "Alpha")]), ("r2", [(1, "editorial", "nothing here"), (2, "unknown", "Gamma gamma")]), ("r3", [(1, "forum", None)]), ("r4", None), ("r5", []),
    ]
    table = spark.createDataFrame(rows, lv.REQUEST)
    features = {(r.record_id, r.brand): r for r in lv.live_features(table, registry).collect()}
    assert set(features) == {(r, b) for r in ("r1", "r2", "r3") for b in "ABC"}
    a = features["r1", "A"]
    assert (a.volume_share, a.volume_vs_leader, a.is_top_retrieved, a.share_official, a.share_forum) == (1.0, 1.0, 1, 0.5, 0.5) and features["r3", "A"].volume_share == 0
    train = lv.live_features(table, registry).withColumn("y_top", F.col("is_top_retrieved")).withColumns({"category": F.lit("x"), "query_id": F.col("record_id")})
    model = mo.fit(train)
    model.write().save(str(tmp_path / "model"))
    want = sorted(map(str, lv.rank_requests(table, registry, model).collect()))
    table.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(lv.REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for name in ("c1", "c2"):  # the second run delivers all batches again
        lv.ranking_stream(stream, registry, str(tmp_path / "model"), str(tmp_path / "out"), str(tmp_path / name)).awaitTermination()
        assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())) == want
    assert {r.brand: r.rank for r in spark.read.parquet(str(tmp_path / "out")).where("record_id = 'r1'").collect()}["A"] == 1


def test_priors_of_unseen_brands(spark):
    """A brand without training rows has its category's base, a category without any has 0."""
    from lexigauge.operators.panel import add_priors

    rows = [
        ("a", "x", "search_off", 1, 1, 1, True), ("a", "x", "search_off", 0, 0, 1, True), ("a", "y", "search_on", 0, 1, 1, True), ("a", "z", "search_on", 1, 1, 0, False), ("b", "x", "search_off", 1, 1, 1, False), ("c", "w", "search_on", 0, 1, 0, True),
    ]
    table = spark.createDataFrame(rows, "category string, brand string, condition string, y_top int, y_mention int, response_decided int, train boolean")
    got = {(r.category, r.brand): (r.prior_top_off, r.prior_mention_off, r.prior_top_all, r.prior_mention_all) for r in add_priors(table, F.col("train")).collect()}
    third = round(1 / 3, 6)
    assert got["a", "x"] == (0.5, 0.5, round((1 + 10 / 3) / 12, 6), round((1 + 10 * 2 / 3) / 12, 6))
    assert got["a", "z"] == (0.5, 0.5, third, round(2 / 3, 6)) and got["a", "y"][:2] == (0.5, 0.5) and got["b", "x"] == (0.0,) * 4
    assert got["c", "w"] == (0.0, 0.0, 0.0, 1.0) and add_priors(table.where("false"), F.col("train")).count() == 0


def test_search_trace(spark):
    from lexigauge.functions.text import search_trace

    rows = [("1", [(1, "Best VPN 2024"), (1, None), (2, "nordvpn now")], [3, None, 4]), ("2", None, None), ("3", [], []), ("4", [(None, "x12024y"), (0, "")], [0])]
    table = spark.createDataFrame(rows, "k string, calls array<struct<round:int,query:string>>, found array<bigint>")
    got = {r[0]: tuple(r[1:]) for r in table.select("k", *search_trace(F.col("calls"), F.col("found"))).collect()}
    assert got == {"1": (3, 2, 7, True, True, True, True), "2": (0, 0, 0, False, False, False, False), "3": (0, 0, 0, False, False, False, False), "4": (2, 1, 0, False, False, False, False)}


def test_encoder_texts(spark):
    from lexigauge.operators.live import encoder_texts

    panel = spark.createDataFrame([("r", "Alpha"), ("r", "Beta")], "record_id string, brand string")
    asked = spark.createDataFrame([("r", "which?")], "record_id string, query_text string")
    snippets = spark.createDataFrame([("r", "Alpha", "ALPHA beats Betamax."), ("r", "Beta", None)], "record_id string, brand string, snippet string")
    registry = (("Alpha", "Alpha"), ("Beta", "Betamax"))
    got = {r.brand: (r.text_a, r.text_b, r.text_b_masked) for r in encoder_texts(panel, asked, snippets, registry).collect()}
    assert got == {"Alpha": ("which?", "Alpha : ALPHA beats Betamax.", "[BRAND] : [BRAND] beats [BRAND]."), "Beta": ("which?", "Beta : ", "[BRAND] : ")}
    with pytest.raises(Exception, match="query"):
        encoder_texts(panel, asked.where("false"), snippets, registry).collect()


def test_export_rows(spark):
    from lexigauge.sources import export as ex

    names = [f.strip().rsplit(" ", 1)[0] for f in ex.COLUMNS.split(",")]
    own = ("final_response", "core", "judge_model", "judge_prompt_version")
    raw = spark.createDataFrame([(k, "h", *[None if n == "search_aware" else "1" for n in names if n not in ("record_id", *own)]) for k in "cab"], "record_id string, content_hash string, " + ", ".join(f"{n} string" for n in names if n not in ("record_id", *own)))
    judged = spark.createDataFrame([("a", "h", "x", "y", "m", "1"), ("b", "old", "x", "y", "m", "1"), ("c", "h", "x", "y", "m", "1")], "record_id string, content_hash string, final_response string, core string, judge_model string, judge_prompt_version string")
    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "record_id string")
    out = ex.export_rows(raw, judged, plan)
    assert out.columns == names and [r.record_id for r in out.collect()] == ["a", "c"] and dict(out.dtypes)["temperature"] == "double"
    assert ex.export_rows(raw, judged, plan.where("record_id = 'c'")).count() == 1
    with pytest.raises(ValueError, match="core"):
        ex.export_rows(raw, judged.drop("core"), plan)
    with pytest.raises(Exception, match="no core"):
        ex.export_rows(raw, judged.withColumn("core", F.lit(None).cast("string")), plan).collect()
    calls = spark.createDataFrame([(1, [(1, "search", ("q",)), (2, None, None)]), (2, None)], "k int, c array<struct<round:int,function:string,arguments:struct<query:string>>>")
    assert [r.j for r in calls.orderBy("k").select(ex.tool_calls(F.col("c")).alias("j")).collect()] == ['[{"round":1,"function":"search","query":"q"},{"round":2,"function":null,"query":null}]', "[]"]


def test_sealed_labels(spark, tmp_path):
    import hashlib

    from lexigauge.sources import export as ex

    text = json.dumps({"brand": "A", "origin": "tr"}) + "\n"
    (tmp_path / "o.json").write_text(text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert ex.sealed(spark, str(tmp_path / "o.json"), digest, "brand string, origin string").first().origin == "tr"
    with pytest.raises(ValueError, match="sealed"):
        ex.sealed(spark, str(tmp_path / "o.json"), "0" * 64, "brand string, origin string")


def test_compatible_forms_of_all_code_points(spark):
    import unicodedata

    from lexigauge.functions.unicode import compatible

    points = [chr(p) for p in range(1, 0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    rows = [("".join(points[i : i + 50]),) for i in range(0, len(points), 50)] + [("plain",), ("",), (None,), ("é ﬁ Ａ",)]
    for r in spark.createDataFrame(rows, "t string").select("t", compatible(F.col("t")).alias("c")).collect():
        assert r.c == (None if r.t is None else unicodedata.normalize("NFKC", r.t))


def test_profiles(spark):
    from lexigauge.functions.replies import parse_profile

    text = "Welcome to Garanti  BBVA. GarantiBBVA offers\na card. The card is free! Bonus card."
    good = {"brand": " Garanti BBVA ", "aliases": ["garantibbva", "GARANTI BBVA", "Garanti BBVA card", "Garanti's", "other", "garantibbva", None], "sector": "banks", "language": "EN ", "products": [{"name": "Bonus", "category": "card", "sentences": ["the card IS free!", "made up", "Welcome to Garanti BBVA.", "Bonus card."]}, {"name": "", "category": "x"}, {"name": "y"}]}
    rows = [("good", json.dumps(good)), ("fence", "```json\n" + json.dumps({"brand": "A", "sector": "b", "language": "xx"}) + "\n```"), ("list", "[1]"), ("broken", "{"), ("none", None), ("empty", json.dumps({"brand": "", "sector": "b"}))]
    got = {r.k: r for r in parse_profile(spark.createDataFrame([(k, r, text) for k, r in rows], "k string, reply string, t string"), "reply", "t").collect()}
    g = got["good"]
    assert (g.brand, g.aliases, g.sector, g.language, g.fault) == ("Garanti BBVA", ["garantibbva"], "banks", "en", None)
    assert [tuple(p) for p in g.products] == [("Bonus", "card", ["the card IS free!", "Welcome to Garanti BBVA."])]
    assert (got["fence"].brand, got["fence"].language, got["fence"].products, got["fence"].aliases) == ("A", "tr", [], [])
    assert {k: got[k].fault for k in ("list", "broken", "none", "empty")} == {"list": "not JSON", "broken": "not JSON", "none": "not JSON", "empty": "no brand or sector"} and got["empty"].brand is None


def test_questions(spark):
    from lexigauge.functions.replies import parse_questions

    good = {"discovery": ["Which bank is best?", "Which is better than GarantiBBVA?", "Tell me a story", " Which bank is best? ", "Hangi kart?", "Is Bonus best?", "", None], "named": ["Is garanti bbva good?", "Is another good?", "What is Bonus?", "Bonus again"]}
    rows = [("a", json.dumps(good), ["Garanti BBVA"], ["Bonus"]), ("b", json.dumps({"discovery": ["plain"]}), ["x"], None), ("c", "no", [], [])]
    got = {r.k: (r.discovery, r.named, r.fault) for r in parse_questions(spark.createDataFrame(rows, "k string, reply string, names array<string>, products array<string>"), "reply", "names", "products").collect()}
    assert got == {"a": (["Which bank is best?", "Hangi kart?"], ["Is garanti bbva good?", "What is Bonus?"], None), "b": (None, None, "no discovery question"), "c": (None, None, "not JSON")}
