"""Chat logs, URL filters, WARC archives, and the oracle texts."""

import base64
import collections
import hashlib
import math
import random

import duckdb
import pytest

BITS = ["\\", "#", "###", ":", " ", "</turn>", "<", "\n", "a", " </turn>\n", "é🙂"]


def test_chat(spark):
    from lexigauge.llm.chat import digests, event_log, fold, render

    rnd, rows = random.Random(2), []
    for conv in range(40):
        for turn in range(rnd.randint(1, 4)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "a:b", "###", "sys\\:", None]), rnd.choice([None, "", "".join(rnd.choices(BITS, k=9))])))
    rows += rows[:5]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in digests(render(fold(event_log(frame)))).collect()}
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role or "", text or ""))
    assert got.keys() == turns.keys()
    for conv, each in turns.items():
        each.sort()
        own = "".join(x for _, r, x in each if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in each).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(each), len(own), hashlib.sha256(own.encode()).hexdigest())
    assert digests(render(fold(event_log(frame.where("false"))))).count() == 0


def test_chat_events(spark):
    from lexigauge.llm.chat import fold

    log = [(1, "m", 1, "user", "message", "hi"), (1, "n", 2, "assistant", "delta", "He"), (1, "n", 3, "assistant", "delta", "llo"), (1, "m", 4, "user", "edit", "hey"), (1, "n", 5, "assistant", "regenerate", ""), (1, "n", 6, "assistant", "delta", "Yo"), (1, "n", 6, "assistant", "delta", "Yo"), (1, "x", 7, "user", "message", "gone"), (1, "x", 8, "user", "delete", None)]
    got = fold(spark.createDataFrame(log, "conv_id long, message_id string, seq long, role string, kind string, text string")).orderBy("seq").collect()
    assert [(r.message_id, r.seq, r.role, r.text) for r in got] == [("m", 1, "user", "hey"), ("n", 2, "assistant", "Yo")]


def test_urls(spark):
    from lexigauge.llm.url_filter import Rule, labelled_urls, url_verdicts

    urls = [None, "", "nope", "HTTP://WWW.Example.ORG", "http://a.example.org/es/x?y#z", "x://b://c/d", "https://example.org?x/es/", "https://notexample.org/es/", "http://shop.com/de/1", "http://shop.com/de/1"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "com", "/de/")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_verdicts(frame, rules, labelled_urls(spark)).collect()}
    assert got == {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("www.example.org", "", None), 4: ("a.example.org", "/es/x", "example.org/es/"), 5: ("b:", "//c/d", None), 6: ("example.org", "", None), 7: ("notexample.org", "/es/", "org/"), 8: ("shop.com", "/de/1", "com/de/"), 9: ("shop.com", "/de/1", "com/de/")}
    assert url_verdicts(frame.where("false"), rules, frame.where("false").selectExpr("url", "true as allowed")).count() == 0


def test_url_model(spark):
    from lexigauge.llm.url_filter import url_verdicts

    rnd = random.Random(1)
    urls = [(f"http://{rnd.choice(['casino', 'news'])}{rnd.randrange(999)}.net/p{rnd.randrange(99)}") for _ in range(400)]
    frame = spark.createDataFrame([(i, u, "news" in u) for i, u in enumerate(urls)], "page_id long, url string, allowed boolean")
    rows = url_verdicts(frame.where("page_id >= 200"), [], frame.where("page_id < 200")).collect()
    assert sum((r.verdict == "allow") == ("news" in r.host) for r in rows) >= 0.97 * len(rows)


def test_warc(spark, tmp_path):
    from lexigauge.llm.warc import read_warc, write_warc

    rows = [(1, "http://a\r\nb", None), (2, None, ""), (3, "u", "x" * 2_000_000), (4, "u", "same"), (5, "v", "same"), (9, "w", "same"), (9, "w", "same"), (None, "n", "same"), (10, "ü", "é\r\n\r\nWARC/1.1")]
    folder = f"file://{tmp_path}/warc"
    manifest = write_warc(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string"), folder)
    got = read_warc(manifest, folder, 3).collect()
    assert all(r.verified for r in got)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    largest = {None: 2, "": 2, "same": 9}
    key = lambda r: tuple(str(x) for x in r)
    want = [(i, len((t or "").encode()), digest(t), *(("response", None) if i is None or largest.get(t, i) == i else ("revisit", largest[t]))) for i, _, t in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    none = write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_warc(none, folder, 1).count() == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_chat_format", "op7_warc", "op9_decontamination"])
def test_oracles(spark, name):
    from lexigauge.llm.queries import oracle_sql, queries

    if name not in oracle_sql():
        pytest.skip("no oracle")
    folder = "/root/testdata/sf0.001"
    frame = queries()[name](spark, folder)
    con = duckdb.connect(config={"threads": 2})
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names, columns = [x[0] for x in found.description], sorted(frame.columns)
    clean = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
    want = sorted((tuple(clean(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(clean(r[c]) for c in columns) for r in frame.collect()), key=repr) == want


def test_labelled_urls_held_out(spark):
    """Five folds of the small labelled table: the model tells the kinds of held-out urls apart."""
    from lexigauge.llm.url_filter import labelled_urls, url_verdicts

    rows = [(k, r.url, r.allowed) for k, r in enumerate(sorted(labelled_urls(spark).collect()))]
    table = spark.createDataFrame(rows, "page_id long, url string, allowed boolean").cache()
    right = 0
    for fold in range(5):
        got = url_verdicts(table.where(f"page_id % 5 = {fold}"), [], table.where(f"page_id % 5 <> {fold}")).collect()
        right += sum((r.verdict == "allow") == rows[r.page_id][2] for r in got)
    assert right >= 0.9 * len(rows)


@pytest.mark.parametrize("most", [500, 0])
def test_host_path_rule_as_sql(spark, most, monkeypatch):
    """Host, path and rule of every page, as literals of the plan and as a joined table, against DuckDB."""
    from lexigauge.llm import url_filter as u

    monkeypatch.setattr(u, "MOST_RULES", most)
    folder = "/root/testdata/sf0.01"
    rules = [u.Rule("allow", "org", "/"), u.Rule("block", "example.org", "/es/"), u.Rule("block", "example.org", "/en/1"), u.Rule("allow", "com", "/fr/"), u.Rule("block", "com", "/de/")]
    odd = [(-1, None), (-2, "no scheme"), (-3, "http://EXAMPLE.org"), (-4, "x://org?://a/b"), (-5, "http://notexample.org/es/1"), (-6, "http://a.com/fr/?#/de/"), (-6, "http://a.com/fr/?#/de/")]
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = u.url_verdicts(pages, rules, u.labelled_urls(spark)).collect()
    con = duckdb.connect(config={"threads": 2})
    con.execute("create table odd (page_id bigint, url varchar)")
    con.executemany("insert into odd values (?, ?)", odd)
    con.execute("create table rules (verdict varchar, host varchar, path varchar)")
    con.executemany("insert into rules values (?, ?, ?)", [(r.verdict, r.host, r.path) for r in rules])
    want = con.execute(f"""with p as (select page_id, url, row_number() over () as k from (select page_id, url from '{folder}/pages.parquet' union all select * from odd)),
      t as (select k, page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from p),
      h as (select k, page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) as host, regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') as path from t)
      select any_value(page_id), any_value(h.host), any_value(h.path), arg_max(r.host || r.path, length(r.host || r.path)), arg_max(r.verdict, length(r.host || r.path))
      from h left join rules r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path) group by k""").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=key) == sorted(want, key=key)
    assert all((r.score is None) == (r.rule is not None) and r.verdict in ("allow", "block") for r in got)


def test_interleaved_log_is_one_walk(spark):
    """A log whose messages interleave, with edits, regenerations, repeats and a deletion, against one walk in order of seq."""
    from lexigauge.llm.chat import digests, fold, render

    rnd, rows = random.Random(3), []
    for conv in ("a", "b", "ü"):
        for seq in range(120):
            kind = rnd.choice(["message", "delta", "delta", "delta", "edit", "regenerate", *(["delete"] if seq > 100 else [])])
            rows.append((conv, rnd.randrange(8), seq, rnd.choice(["user", "assistant", None]), kind, rnd.choice([None, "", "x", "### ", "</turn>", "\\", "é\n"])))
    rows += rows[::7]
    want = {}
    for conv, message, seq, role, kind, text in sorted(set(rows), key=lambda r: (r[0], r[2])):
        now = want.setdefault((conv, message), [seq, role, ""])
        if kind == "delete":
            now[2] = None
        elif kind == "delta":
            now[2] = now[2] if now[2] is None else now[2] + (text or "")
        else:
            now[2] = text or ""
    want = {k: v for k, v in want.items() if v[2] is not None}
    log = spark.createDataFrame(rows, "conv_id string, message_id int, seq int, role string, kind string, text string").repartition(5)
    messages = fold(log)
    assert {(r.conv_id, r.message_id): [r.seq, r.role, r.text] for r in messages.collect()} == want
    got = {r.conv_id: r for r in digests(render(messages)).collect()}
    for conv in got:
        turns = [v for k, v in sorted(want.items(), key=lambda x: x[1][0]) if k[0] == conv]
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(said)
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    assert digests(render(fold(log.where("false")))).count() == 0


def test_a_long_turn_is_read_in_pieces():
    """64 million characters cost a few MB besides the turn itself, whatever they are."""
    import tracemalloc

    from lexigauge.llm import chat

    for unit in ("plain words ", "\\\\ x", "\\### </turn"):
        formatted = chat.OPEN + "assistant" + chat.MIDDLE + unit * (64_000_000 // len(unit) if unit[0] == "p" else 200_000) + chat.CLOSE
        tracemalloc.start()
        n = 0
        for role, start, end in chat.spans(formatted):
            digest = hashlib.sha256()
            for piece in chat.pieces(formatted, start, end):
                digest.update(piece.encode())
                n += len(piece)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert role == "assistant" and n == len(chat.unescape(formatted[start:end])) and peak < 16_000_000


def test_turns_read_back_as_written():
    from lexigauge.llm import chat

    rnd = random.Random(6)
    for _ in range(3000):
        turns = [("".join(rnd.choices(BITS, k=rnd.randrange(4))), "".join(rnd.choices([*BITS, ": "], k=rnd.randrange(9)))) for _ in range(rnd.randrange(1, 4))]
        text = "".join(chat.OPEN + chat.escape(r).replace(":", "\\:") + chat.MIDDLE + chat.escape(t) + chat.CLOSE for r, t in turns)
        assert chat.parse(text) == turns
        assert "".join(chat.pieces(chat.escape(turns[0][1]))) == turns[0][1]
    for bad in ("x", chat.OPEN + "user", chat.OPEN + "user: open", chat.OPEN + "user: a\\ </turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_url_model_as_a_plain_loop():
    """The fit against the same steps written out one url, one n-gram and one weight at a time."""
    import numpy as np

    from lexigauge.llm.url_filter import Training, grams, train

    t = Training(buckets=97, sizes=(3, 4), steps=25)
    pairs = [("news.example.com", "/en/1"), ("casino.example.com", "/en/2"), ("a", ""), ("", ""), ("spin-casino.top", "/play"), ("news.example.com", "/en/1")]
    allowed = [True, False, True, True, False, True]
    w, m, v = [[0.0] * (t.buckets + 1) for _ in range(3)]
    for step in range(1, t.steps + 1):
        grad = [t.decay * x for x in w[:-1]] + [0.0]
        for (host, path), good in zip(pairs, allowed, strict=True):
            own = grams(host, path, t).tolist()
            z = sum(w[i] for i in own) / math.sqrt(max(len(own), 1)) + w[-1]
            off = (1 / (1 + math.exp(-z)) - good) * 0.5 / sum(x == good for x in allowed)
            for i in own:
                grad[i] += off / math.sqrt(len(own))
            grad[-1] += off
        for i, g in enumerate(grad):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] -= t.rate * (m[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(train(pairs, np.array(allowed), t), w, atol=1e-6)


#: What stands in the hosts of the given pages that are to be left out.
UNWANTED = ("cheap-pills", "adult-x", "free-bets", "spam-farm", "casino-win", "ads-track")


def test_url_model_on_hosts_it_has_not_seen(spark):
    """No host of the given pages is labelled; of those the model has to judge nearly all are judged right."""
    from lexigauge.llm.labelled_urls import ALLOWED, BLOCKED
    from lexigauge.llm.url_filter import labelled_urls, url_verdicts

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [r for r in url_verdicts(pages, [], labelled_urls(spark)).collect() if r.host]
    labelled = {u.split("://")[1].split("/")[0] for u in (ALLOWED + "\n" + BLOCKED).split()}
    assert not labelled & {r.host for r in rows}
    wanted = [r.verdict for r in rows if not any(x in r.host for x in UNWANTED)]
    unwanted = [r.verdict for r in rows if any(x in r.host for x in UNWANTED)]
    assert len(unwanted) > 10 and unwanted.count("block") >= 0.9 * len(unwanted) and wanted.count("allow") >= 0.99 * len(wanted)


def test_urls_of_any_length(spark):
    from lexigauge.llm.url_filter import Rule, labelled_urls, url_verdicts

    long = ["http://casino.net/" + "a/" * 100_000, "http://" + "x" * 100_000 + ".org/y", "x" * 200_000, "http://b.org?" + "q=1&" * 50_000]
    got = {r.page_id: r for r in url_verdicts(spark.createDataFrame(list(enumerate(long)), "page_id long, url string"), [Rule("allow", "org", "/")], labelled_urls(spark)).collect()}
    assert got[0].path == long[0][len("http://casino.net") :] and got[1].rule == "org/" and (got[2].host, got[2].path) == ("", "") and (got[3].host, got[3].path) == ("b.org", "")
    assert all(r.verdict in ("allow", "block") for r in got.values())
