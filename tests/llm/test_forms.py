"""Spelling variants, line dedup and fill-in-middle: against plain Python on rows that no table should hold."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, n int, word string, keep string, form string"


def frame(spark, rows):
    """Documents with columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, 7, "w", "k", "f") for i, t in rows], SCHEMA)


def variants(rows, letters=7, least=2, one_in=31, times=10):
    """The rule of spelling_variants in plain Python, near words by all pairs."""
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= letters:
                n[word] = n.get(word, 0) + 1
    n = {w: k for w, k in n.items() if k >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(close[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def found(table):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in table.collect()}


def test_variants_by_all_pairs(spark):
    from lexigauge.llm.spelling import spelling_variants

    rnd, rows = random.Random(3), []
    base = ["aaaaaaa", "aabbaab", "abababab", "ébéêçàÿ", "Ñandúes", "bbbbbbbbb", "x" * 64, "y" * 70 + "ab" * 5]
    for k in range(400):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            at, kind = rnd.randrange(len(w)), rnd.randrange(3)
            w[at : at + (kind != 0)] = [] if kind == 2 else [rnd.choice("abéÉyx")]
        rows.append((rnd.randrange(30), f"{''.join(w)} 12 {''.join(w)}-"))
    rows += [(None, "aaaaaaa aaaaaaa"), (5, None), (6, ""), (7, " \n "), (8, "×÷ short"), (9, rows[0][1]), (9, rows[0][1])]
    rows += [(10, "aaaaaaa " * 300), (11, "aaaaaab " * 29 + "aaaaabb " * 2)]
    want = variants(rows)
    assert sum(1 for v in want.values() if v[2]) > 5 and any(len(w) > 64 and v[1] for w, v in want.items())
    assert found(spelling_variants(frame(spark, rows))) == want
    assert spelling_variants(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("limits", [(2, 1, 3, 2), (1, 1, 5, 3)])
def test_variants_of_short_words(spark, limits):
    from lexigauge.llm.spelling import spelling_variants

    rnd = random.Random(4)
    rows = [(k, " ".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 7))) for _ in range(20))) for k in range(12)]
    assert found(spelling_variants(frame(spark, rows), *limits)) == {w: v for w, v in variants(rows, *limits).items()}


def test_very_long_word(spark):
    from lexigauge.llm.spelling import spelling_variants

    word = "ab" * 40_000
    rows = [(1, f"{word} {word}"), (2, f"{word}c {word}c"), (3, f"{word[:9]}x{word[10:]} " * 2)]
    got = found(spelling_variants(frame(spark, rows), one_in=1 << 40))
    assert {len(w): v[1] for w, v in got.items() if w.endswith("c")} == {80_001: 1} and got[word][:2] == (2, 2)


def kept_lines(rows, chars=20, least=3):
    blank = " \t\n\x0b\f\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


ROWS = [
    (1, None), (2, ""), (3, "\n\n"), (4, "a line that is shared by many\nown"), (5, "\t A LINE that is shared by many \x0b\nmore\n"), (6, "a line that is shared by many"), (6, "another text of the same id\na line that is shared by many"),
    (7, "twice in one document only, here\ntwice in one document only, here"), (7, "twice in one document only, here\ntwice in one document only, here"), (8, "a line that is shared by many\r\na line that is shared by many\nend"),
    (None, "a line that is shared by many\nnull id"), (None, None), (9, "É LINE of letters beyond ascii\nx"), (10, "é LINE of letters beyond ascii\nx"), (11, "É line of letters beyond ascii"), (12, "É Line of letters beyond ascii"),
    (13, "\n".join(f"line {k % 700} of a long text, repeated" for k in range(5000))), (14, "\n".join(f"line {k} of a long text, repeated" for k in range(900))), (15, "\n".join(f"line {k} of a long text, repeated" for k in range(0, 900, 2))),
    (4, "a line that is shared by many\nown"),
]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_lines(spark, most, monkeypatch):
    from lexigauge.llm import line_dedup as ld

    monkeypatch.setattr(ld, "BROADCAST_KEYS", most)
    monkeypatch.setattr(ld, "BROADCAST_BITMAPS", most)
    docs = frame(spark, ROWS)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_digests(docs).collect())
    assert got == kept_lines(ROWS)
    assert ld.line_digests(docs.where("false")).count() == 0
    assert all(r.n_dropped == 0 for r in ld.dedup_lines(docs, ld.Shared(chars=20, docs=100)).collect())


def test_bitmaps_are_runs(spark):
    from lexigauge.llm.line_dedup import keep_bitmaps

    rows = [(k, "own first\nthis line is in three documents\nown second\nown third\nthis line too is in three documents") for k in range(3)]
    got = {r.doc_id: (r.n_lines, [tuple(x) for x in r.keep]) for r in keep_bitmaps(frame(spark, rows)).collect()}
    assert got == {0: (5, [(0, 1), (2, 2)]), 1: (5, [(0, 1), (2, 2)])}


def turned(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or three % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if four % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_in_middle(spark, rate, spm):
    from lexigauge.llm.fim import Plan, fill_in_middle, fim_digests, restored

    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choices(["a", "é🙂", "\n", "\r\n", "<", ">", "P>", "<S", "M", " "], k=rnd.randrange(40)))) for k in range(150)]
    rows += [(None, "null\nid"), (200, None), (201, ""), (202, "no end"), (203, "\n"), (204, "has <P> in it\n"), (205, "x\n" * 60_000 + "<M"), (202, "no end"), (202, "other\ntext\n")]
    docs, plan = frame(spark, rows), Plan(rate=rate, spm=spm)
    both = restored(fill_in_middle(docs, plan), plan).collect()
    want = sorted((turned(i, t, rate=rate, spm=spm) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in both), key=str) == want
    assert sorted((str(r.doc_id), r.restored) for r in both) == sorted((str(i), t or "") for i, t in rows)
    assert fim_digests(docs, plan).count() == len(rows) and fim_digests(docs.where("false"), plan).count() == 0


def test_marks_must_differ():
    from lexigauge.llm.fim import Plan

    for marks in (("<P>", "<P>x", "<M>"), ("<P", "P<", "<M"), ("", "a", "b")):
        with pytest.raises(ValueError):
            Plan(prefix=marks[0], suffix=marks[1], middle=marks[2]).marks()
