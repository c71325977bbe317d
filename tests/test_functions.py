"""Text, url, audit and design functions on small inputs."""

import pytest
from pyspark.sql import functions as F


def test_audit(spark):
    from lexigauge.functions import audit as au

    rows = [(1, "Strong encryption. It is 20% cheaper!\nThe best of all. A study at the university proves it."), (2, None), (3, "")]
    texts = spark.createDataFrame(rows, "k int, t string")
    found = au.audit(texts, "k", "t")
    got = {(r.k, r.type, r.n) for r in found.collect()}
    assert got == {(1, "technical", 1), (1, "price", 1), (1, "statistics", 1), (1, "superlative", 1), (1, "fabricated_claim", 1)}
    for name, _ in au.TYPES:
        said = {"technical": "Uses a new protocol", "price": "Now at a discount", "statistics": "Measured twice", "cited_test": "An independent lab tried it", "social_proof": "It has 5 users", "certificate": "Certified", "authority": "Built by engineers", "expert_quote": "The expert says so", "superlative": "Number one", "emotional": "You will love it"}[name]
        assert texts.limit(1).select(au.sentence_types(F.lit(said))).first()[0] == [name]
    advice = [("Buy fake reviews",), ("Pay for placement",), ("Invent a study",), ("Guaranteed first place",), ("Send bulk comments",), ("Edit the rival page",), ("Pretend you are a customer",), ("Write a comparison page",), (None,)]
    table = spark.createDataFrame(advice, "t string")
    assert [r[0] for r in table.select(au.broken_rules(F.col("t"))).collect()] == [*[[n] for n, _ in au.SCREEN], [], []]
    assert au.screened(table.where("t like 'Write%'"), "t").count() == 1
    with pytest.raises(Exception, match="broken rules: mass_spam"):
        au.screened(table.where("t like 'Send%'"), "t").collect()


def test_classified_sentences(spark):
    from lexigauge.functions import audit as au

    texts = spark.createDataFrame([(1, "It is the best. A study proves it always works. Plain."), (2, None)], "k int, t string")
    claimed = spark.createDataFrame([(1, "the best", "superlative"), (1, "not there", "price"), (1, "Plain.", "unknown"), (2, "x", "price"), (1, "the best", "superlative")], "k int, sentence string, type string")
    kept = au.verbatim(claimed, texts, "k", "t", ["superlative", "price"])
    assert [tuple(r) for r in kept.collect()] == [(1, "the best", "superlative")]
    each = au.typed_sentences(texts, "k", "t")
    assert [tuple(r) for r in au.marked(each, kept, "k").collect()] == [(1, 0, ["superlative"])]
    merged = {tuple(r) for r in au.with_rule_risk(kept, each, "k").collect()}
    assert merged == {(1, "the best", "superlative"), (1, "A study proves it always works.", "fabricated_claim")}
    again = spark.createDataFrame([(1, "proves it always", "fabricated_claim")], "k int, sentence string, type string")
    assert au.with_rule_risk(again, each, "k").count() == 1
    rivals = au.with_rivals(au.audit(texts, "k", "t").withColumn("g", F.lit("g")), "k", "g")
    verdicts = spark.createDataFrame([("superlative", "weak"), ("technical", "strong")], "type string, verdict string")
    got = {tuple(r) for r in au.advice(rivals, verdicts, texts, "k").collect()}
    assert got == {(1, "superlative", "replace"), (1, "technical", "add"), (2, "technical", "add"), (1, "fabricated_claim", "risk"), (2, None, "empty")}


def test_keys(spark):
    from lexigauge.functions import text as tx

    row = spark.createDataFrame([("Proton™ VPN İI", "Mull-vad, çok!", "IĞdır")], "a string, b string, c string")
    got = row.select(tx.comparison_key(F.col("a")), tx.text_key(F.col("b")), tx.turkish_casefold(F.col("c")), tx.ascii_key(F.col("c"))).first()
    assert list(got) == ["protonvpnii", " mull vad çok ", "ığdır", "igdir"]


def test_names(spark):
    from lexigauge.functions import names as nm

    forms = [("NordVPN", "NordVPN"), ("Nord", "Nord"), ("PIA", "PIA"), ("Proton VPN", "Proton VPN")]
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    names = lambda t: nm.names_in(t, forms)
    assert one("nordvpn, Proton-VPN and pia or PIA; northNord", names) == ["NordVPN", "Proton VPN", "PIA"]
    assert one(None, names) == [] and one("", names) == []
    hidden = lambda t: nm.masked(t, forms, "NordVPN")
    assert one("PIA beats NordVPN and Nord, says PIA", hidden) == "[OTHER_BRAND_1] beats [TARGET_BRAND] and [OTHER_BRAND_2], says [OTHER_BRAND_1]"
    assert one(None, hidden) == ""
    assert one("myNORDvpnbox and Nord", lambda t: nm.blanked(t, forms)) == "my[BRAND]box and [BRAND]"
    assert one("we like pro-ton vpn, PIA", lambda t: nm.mentioned(t, forms)) == ["Proton VPN"]
    assert one("Pia is fine", lambda t: nm.mentioned(t, forms)) == ["PIA"]
    assert one("nord vpn™", lambda t: nm.resolve(t, forms)) == "NordVPN" and one("nord", lambda t: nm.resolve(t, forms, ["Nord"])) is None
    assert one("x", lambda t: nm.resolve_all(F.array(F.lit("PIA"), t, F.lit("nord"), F.lit("Pia")), forms)) == ["PIA", "Nord"]
    assert one("Best VPN-apps, yes", lambda t: nm.occurs(F.lit("vpn apps"), t)) is True and one("vpnapps", lambda t: nm.occurs(F.lit("vpn"), t)) is False
    assert one("a<think>no</think> b ", nm.final_text) == "a b" and one("a<think>no", nm.final_text) is None
    assert one("api_key=abc123 Bearer abcdefghijk sk-abcdefgh1", nm.redacted) == "api_key=[REDACTED] Bearer [REDACTED] [REDACTED]"
    assert one("a\x00b\n\u200bc", nm.plain) == "ab\nc"
    assert one("ok", nm.fair_input) is True and one("a\x07", nm.fair_input) is False and one("", nm.fair_input) is False and one("x" * 121, nm.fair_input) is False
    assert one("Güneş", lambda t: nm.names_match_label(t, F.lit("gunes-shop"))) is True and one("Abc", lambda t: nm.names_match_label(t, F.lit("abcd"))) is False
    pairs = spark.createDataFrame([("Surfsark", "Surfshark"), ("Shark", "Surfshark"), ("Nord", "Nord")], "w string, b string")
    assert [tuple(r) for r in nm.close_words(pairs, "w", "b").collect()] == [("Surfsark", "Surfshark")]


def test_outcomes(spark):
    from lexigauge.operators.answers import edited, outcomes

    forms = [("Alpha", "Alpha"), ("Beta", "Beta"), ("Gamma", "Gamma")]
    texts = ["Alpha and Beta exist. I suggest Beta!", "I suggest Beta as an alternative. **Gamma** wins; Alpha", "| Beta |\nGamma is fine", "none", None, "I suggest Alpha or Beta. Alpha."]
    got = outcomes(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), forms, "(?i)suggest", "(?i)alternative", "Beta").orderBy("k").collect()
    assert [(r.first_brand, r.pick_method, r.n_named, r["first"], r["rank"]) for r in got] == [("Beta", "sentence", 2, 1, 2), ("Gamma", "bold", 3, 0, 1), ("Beta", "first_mention", 2, 1, 1), (None, "none", 0, 0, None), (None, "none", 0, 0, None), ("Alpha", "first_mention", 2, 0, 2)]
    row = spark.createDataFrame([(["A", "B-b", "C"], ["d", "bb"], ["c"])], "n array<string>, add array<string>, out array<string>")
    assert row.select(edited(F.col("n"), F.col("add"), F.col("out"))).first()[0] == ["A", "B-b", "d"]


def test_checks(spark):
    from lexigauge.operators import checks as ch

    rows = spark.createDataFrame([(1, '{"k": 1, "s": [1, 2]}'), (2, '"{\\"k\\": 2}"'), (3, "[1]"), (4, "no"), (5, None)], "id int, core string")
    read, bad = ch.decoded(rows, "id", "core", "map")
    assert {(r.column, r.id, r.problem) for r in bad.collect()} == {("core", 3, "not_map"), ("core", 4, "not_json")}
    flat = ch.flattened(read.withColumnRenamed("value", "core"), "core", [("k", "long"), ("s", "array<int>")]).orderBy("id").collect()
    assert [(r.id, r.core__k, r.core__s__items) for r in flat] == [(1, 1, [1, 2]), (2, 2, None)]
    faults = ch.json_faults(rows, "id", "core", "k long, s array<int>", ["k", "s"], {"k": [1, 2]}, {"k": 1})
    assert {(r.id, r.rule) for r in faults.collect()} == {(2, "missing:s"), (2, "missing:k"), (2, "unreadable"), *((i, x) for i in (3, 4, 5) for x in ("unreadable", "missing:k", "missing:s"))}
    assert ch.missing_columns(rows, ["id", "x"]) == ["x"]
    left, right = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in ch.matched(left, right, ["k"], faults=True).collect()} == {(2, "several"), (3, "unmatched")}
    assert ch.matched(left.where("k = 1"), right, ["k"]).count() == 1
    with pytest.raises(Exception, match="no match"):
        ch.matched(left, right, ["k"]).collect()
    p = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.5), (3, float("nan")), (4, 1.5)], "g int, p double")
    assert {tuple(r) for r in ch.probability_faults(p, "g", "p").collect()} == {(2, "does_not_add_up"), (3, "not_a_probability"), (4, "not_a_probability")}


def test_export(spark, tmp_path):
    from lexigauge.sources import export as ex

    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", None)], "id int, m string, c string")
    folder = f"file://{tmp_path}/out"
    manifest = ex.export(rows, folder, ["m", "c"], "v1")
    assert manifest["rows"] == 3 and manifest["counts"] == {"m": {"a": 2, "b": 1}, "c": {"x": 1, "y": 1, "None": 1}}
    assert ex.verify(spark, folder).count() == 0
    pins = spark.createDataFrame(list(manifest["files"].items()), "path string, sha256 string")
    assert ex.pinned(spark, f"{folder}/data", pins).count() == 3
    part = next(p for p in sorted((tmp_path / "out/data").iterdir()) if p.suffix == ".parquet")
    (part.parent / "more.parquet").write_bytes(part.read_bytes())
    assert [tuple(r) for r in ex.verify(spark, folder).collect()] == [("more.parquet", "unexpected")]
    with pytest.raises(ValueError, match="differ"):
        ex.pinned(spark, f"{folder}/data", pins)
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/1.json").write_text('{"id": 1,\n "s": "x"}')
    (tmp_path / "t/2.json").write_text("broken")
    good, bad = ex.json_tree(spark, f"file://{tmp_path}/t", "id int, s string")
    assert [(r.id, r.s) for r in good.collect()] == [(1, "x")] and bad.count() == 1


def test_hosts(spark):
    from lexigauge.functions.urls import host, host_label, kind_by_longest, kind_by_precedence

    urls = ["https://u@www.Shop.co.uk:80/x", "http://a.b.example.org", "ftp://x", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host(F.col("u")), host_label(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [("www.shop.co.uk", "shop"), ("a.b.example.org", "example"), (None, None), (None, None)]
    hosts = spark.createDataFrame([("x.forum.shop.com",), ("other.net",)], "host string")
    rules = spark.createDataFrame([("shop.com", "retailer"), ("forum.shop.com", "forum")], "domain string, kind string")
    assert {tuple(r) for r in kind_by_longest(hosts, rules).collect()} == {("x.forum.shop.com", "forum"), ("other.net", "unknown")}
    assert {tuple(r) for r in kind_by_precedence(hosts, rules, ["retailer", "forum"]).collect()} == {("x.forum.shop.com", "retailer"), ("other.net", "unknown")}


def test_json_twice(spark):
    from lexigauge.operators.integrity import json_fields

    rows = spark.createDataFrame([('{"k": 1}',), ('"{\\"k\\": 2}"',), ("broken",), (None,)], "p string")
    assert [r.p__k for r in json_fields(rows, "p", ["k"]).collect()] == ["1", "2", None, None]


def test_alias_pairs(spark):
    """Every pair of names that is similar enough, as by comparing all pairs."""
    import difflib
    import itertools
    import random

    from lexigauge.functions.text import alias_pairs

    rnd = random.Random(2)
    names = {"abcde", "abde", "abcd", "abxcd", "abcdef", "abxcdyef", "a", "aa", "aab"} | {"".join(rnd.choice("abcde ") for _ in range(rnd.randint(3, 9))) for _ in range(120)}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if 0.82 <= ratio(a, b) < 1}
    got = {(r.a, r.b) for r in alias_pairs(spark.createDataFrame([(n,) for n in names], "name string"), 0.82).collect()}
    assert len(want) > 15 and got == want


def test_models(spark):
    """Folds never train on themselves, and a model of real features ranks better than chance."""
    from lexigauge.operators import metrics as me
    from lexigauge.operators import models as mo

    rows = [(10 * q + r, f"B{b}", ["x", "y", "z"][q % 3], f"q{q}", int(b == (q + r) % 4), 1.0 if b == (q + r) % 4 else 0.2 * b) for q in range(12) for r in range(6) for b in range(4)]
    frame = spark.createDataFrame(rows, "record_id long, brand string, category string, query_id string, y_top long, volume_share double")
    for f in mo.FEATURES:
        if f not in frame.columns:
            frame = frame.withColumn(f, F.lit(0.0) + F.rand(3))
    folds = spark.createDataFrame([(f"q{q}", q % 2) for q in range(12)], "query_id string, fold int")
    scored = mo.out_of_fold(frame, folds, 2)
    assert scored.count() == frame.count() and all(r.roc_auc > 0.9 for r in me.roc_auc(scored).collect())
    left = mo.leave_one_out(frame)
    assert left.count() == frame.count() and all(r.roc_auc > 0.9 for r in me.roc_auc(left).collect())
    drops = {(r.category, r.feature): r["drop"] for r in mo.permutation_drop(frame, ["volume_share", "share_forum"]).collect()}
    assert all(drops[k, "volume_share"] > drops[k, "share_forum"] - 0.01 for k in "xyz")


SAID = {
    "technical": ("AES encryption of every packet.", "Her paket şifrelenir."), "price": ("Now at a discount.", "Şimdi %20 indirimli."), "statistics": ("It saved 12 % of power.", "Ortalama süre kısaldı."),
    "cited_test": ("An independent lab checked it.", "Bağımsız laboratuvar inceledi."), "social_proof": ("Over 3000 customers chose it.", "3000 müşteri seçti."), "certificate": ("Certified in the EU.", "Sertifikalı ürün."),
    "authority": ("Designed by engineers.", "Mühendislerimiz tarafından tasarlandı."), "expert_quote": ("Doctors recommend it.", "Doktorlar öneriyor."), "superlative": ("The best there is.", "Piyasanın EN İYİ ürünü."), "emotional": ("Feel the calm.", "Huzuru yaşayın."),
}
BROKEN = {
    "fabricated_reviews": ("Post fake reviews.", "Sahte yorum yayınlayın."), "paid_placement_as_editorial": ("Pay for a ranking.", "Listeye girmek için para ödeyin, gizli sponsor olun."), "fabricated_authority": ("Invent a study.", "Bir araştırma uydurun."),
    "guaranteed_ranking": ("We guarantee the first place.", "Birinciliği garanti ediyoruz."), "mass_spam": ("Send mass messages.", "Toplu mesaj gönderin."), "tampering_with_others": ("Edit the competitor page.", "Rakip sayfasını değiştirin."),
    "impersonation": ("Pose as a customer.", "Müşteri gibi davranın."),
}
FINE = ["Answer reviews of your customers.", "Publish the results of an independent audit.", "Kullanıcı yorumlarını yanıtlayın.", "Bağımsız test sonuçlarınızı yayınlayın.", "Ürün sayfanızda fiyatı güncel tutun.", "A plain line.", "Sıradan bir cümle."]


def test_rules_of_both_languages(spark):
    from pyspark.sql import functions as F

    from lexigauge.functions import audit as au

    rows = [(k, x) for k, pair in SAID.items() for x in pair]
    for r in spark.createDataFrame(rows, "k string, t string").select("k", "t", au.sentence_types(F.col("t")).alias("got")).collect():
        assert r.k in r.got, (r.t, r.got)
    screens = [(k, x) for k, pair in BROKEN.items() for x in pair] + [(None, x) for x in FINE]
    for r in spark.createDataFrame(screens, "k string, t string").select("k", "t", au.broken_rules(F.col("t")).alias("got")).collect():
        assert r.got == ([r.k] if r.k else []) or (r.k and r.k in r.got), (r.t, r.got)
    claims = ["A university study proves it.", "It is clinically proven to cure 100 %.", "Üniversite araştırması kanıtladı.", "Klinik olarak %100 etkili.", "%99,9 çalışma süresi, bağımsız ölçüm.", "Our study group meets."]
    got = [r.f for r in spark.createDataFrame(list(enumerate(claims)), "i int, t string").orderBy("i").select(au.fabricated(au.folded(F.col("t"))).alias("f")).collect()]
    assert got == [True, True, True, True, False, False]
    assert {k for k, _ in au.TYPES} == set(SAID) and {k for k, _ in au.SCREEN} == set(BROKEN)


def test_advice_in_order(spark):
    from lexigauge.functions import audit as au

    rows = [("a", "superlative", "replace"), ("a", "price", "add"), ("a", "technical", "add"), ("a", "fabricated_claim", "risk"), ("a", "statistics", "mixed"), ("b", None, "empty"), ("b", "price", "other")]
    got = [(r.k, r.place, r.type, r.action) for r in au.advice_texts(spark.createDataFrame(rows, "k string, type string, action string"), "k").orderBy("k", "place").collect()]
    assert got == [("a", 1, "fabricated_claim", "risk"), ("a", 2, "technical", "add"), ("a", 3, "price", "add"), ("a", 4, "statistics", "mixed"), ("a", 5, "superlative", "replace"), ("b", 1, None, "empty")]
    # what is advised passes the screen
    from pyspark.sql import functions as F

    texts = au.advice_texts(spark.createDataFrame([("c", t, a) for a in au.ACTIONS for t, _ in au.TYPES], "k string, type string, action string"), "k")
    assert texts.where(F.size(au.broken_rules(F.col("text"))) > 0).count() == 0
