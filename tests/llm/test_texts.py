"""Page text, subword and personal-data operators against brute force."""

import random
import re

import pytest

from rankloom.llm import pagetext, pii, subwords


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 12))]
        own = pagetext.shared(a, b)
        rest = iter(b)
        assert len(own) == lcs(a, b) and all(a[i] in rest for i in sorted(own))


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><div class="cookie-notice">We use cookies</div>
<header><h1>Site</h1></header><div id="sidebar">side</div><main><div class="article-header"><h1>Title &amp; more</h1></div>
<p>A <b>bo</b>ld para&#33;<br>y</p><div class="ad-slot">BUY</div><form><input>Search</form><ul><li>one<li>two</ul>
<section class="commentList"><p>nice!</p></section><!-- note --><script>if(a<b)</script></main><footer>foot</footer></body>"""


def test_marked_page():
    assert pagetext.main_text(pagetext.blocks(PAGE), None) == "Title & more A bold para! y one two"
    assert pagetext.main_text(pagetext.blocks("<article><p>cut &am"), None) == "cut &am"
    assert pagetext.main_text(pagetext.blocks("<article><p>x < 3 <p"), None) == "x < 3"


def test_state_names_hide_nothing():
    page = '<body class="has-sidebar"><div class="page with-sidebar no_banner isHidden"><article><p>kept</p></article><div class="sidebar">gone</div></div></body>'
    assert pagetext.main_text(pagetext.blocks(page), None) == "kept"
    assert pagetext.main_text(pagetext.blocks('<div class="has-ads sidebar"><article><p>gone</p></article></div><main><p>kept</p></main>'), None) == "kept"


def test_unmarked_pages_lose_shared_lines():
    page = lambda i: pagetext.blocks(f"<div>Home</div><div>Story {i}</div><p>text {i}</p><div>Bye</div>")
    assert pagetext.main_text(page(1), page(2)) == "Story 1 text 1"
    assert pagetext.main_text(page(1), page(1)) == "Home Story 1 text 1 Bye"  # a copy is no template


def test_ranges_do_not_change_results(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{'hot' if i % 3 else 'h' + str(i % 5)}.x/{rng.choice('ab')}/{rng.randrange(30)}?q={i}",
             f"<div>Home {i % 2}</div><p>text {i}</p><div>Bye</div>") for i in range(90)]
    rows += [(None, None, None), (7, None, ""), (7, rows[7][1], rows[7][2])]
    d = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    one = sorted(map(tuple, pagetext.extract(d).collect()), key=str)
    many = sorted(map(tuple, pagetext.extract(d, 10).collect()), key=str)
    assert one == many and len(one) == len(rows)
    assert all(n == len(t) for _, _, t, n in one)
    assert pagetext.extract(d.limit(0)).count() == 0


# ---- subwords ---------------------------------------------------------------


def all_paths(p, text):
    w, out = " " + text, []

    def go(at, ids, score):
        if at == len(w):
            out.append((score, tuple(ids)))
            return
        for j in range(at + 1, min(len(w), at + p.longest) + 1):
            s = w[at:j]
            if s in p.id:
                go(j, [*ids, p.id[s]], score + p.score[s])
            elif j == at + 1:
                raw = s.encode()
                go(j, [*ids, *(p.byte[b] for b in raw)], score + p.byte_score * len(raw))

    go(0, [], 0)
    return sorted(out, key=lambda x: -x[0])


def test_n_best_brute_force_and_round_trip():
    p = subwords.pieces(subwords.MODEL)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the", "a", "er", " ", "é", "\n", "ing", "b", "  ", "中", "▁", "ab"]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for t, (rows, same) in zip(texts, subwords.encode_texts(subwords.MODEL, texts, 4), strict=True):
        want = all_paths(p, t)
        score = {ids: s for s, ids in want}
        assert [s for s, _ in rows] == [s for s, _ in want[:4]] and same
        assert len({tuple(i) for _, i in rows}) == len(rows)
        for s, ids in rows:
            assert score[tuple(map(int, ids))] == s and subwords.decode_ids(subwords.MODEL, ids.tolist()) == t


def test_encoding_a_table(spark):
    long = "word soup " * 4000 + "x" * 3000
    d = spark.createDataFrame([(1, "Hello  world\t\n", "z"), (2, "", "z"), (3, None, "z"), (3, None, "z"), (4, long, "z")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in subwords.digests(d).collect()}
    assert all(r.round_trip for r in got.values()) and got[2].n_pieces == got[3].n_pieces == 0
    assert got[4].n_chars == len(long) and len(got[4].scores) == 4 and got[4].scores == sorted(got[4].scores, reverse=True)
    enc = subwords.encode(d.filter("doc_id <> 4"))
    back = subwords.decode(enc.selectExpr("doc_id", "paths[0].ids as ids")).collect()
    assert {r.doc_id: r.decoded for r in back} == {1: "Hello  world\t\n", 2: "", 3: ""}
    assert subwords.digests(d.limit(0)).count() == 0


# ---- personal data ----------------------------------------------------------


def plain_brute(t):
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii._luhn(d):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_plain_spans_brute_force():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("a@.+-0125 ()_@.4") for _ in range(rng.randint(0, 45)))
        assert pii.plain_spans(t) == plain_brute(t), t
    for t in ("4111 1111-1111 1111", "999.1.1.1", "1.2.3.4.5.6.7.8", "000000000000001.2.3.4", "a@b.c_d@e.f", "+1 (555) 010-9999x"):
        assert pii.plain_spans(t) == plain_brute(t), t


@pytest.mark.parametrize("text,found", [
    ("write to john.doe [at] example [dot] com now", ["john.doe [at] example [dot] com"]),
    ("john at example dot com", ["john at example dot com"]),
    ("jоhn@example.com", ["jоhn@example.com"]),
    ("a​b@c.de", ["a​b@c.de"]),
    ("call plus one five five five zero one two three four five six", ["plus one five five five zero one two three four five six"]),
    ("４１１１ 1111 1111 1111", ["４１１１ 1111 1111 1111"]),
    ("meet me at noon. dot the i", []), ("look at example.com today", []), ("one two three", []), ("john@example.com", []),
])
def test_disguises(text, found):
    more = pii.added_spans(text, pii.plain_spans(text))
    assert [text[a:b] for k in pii.KINDS for a, b in more[k]] == found


@pytest.mark.parametrize("text,found", [
    ("mail john (at) example dot com now", ["john (at) example dot com"]),
    ("mail john@example dot com now", ["john@example dot com"]),
    ("mail john at example [dot] com now", ["john at example [dot] com"]),
    ("mail john  at\texample\ndot  com now", ["john  at\texample\ndot  com"]),
    ("mail john at mail dot example.com now", ["john at mail dot example.com"]),
    ("mail john@mail.example dot com now", ["john@mail.example dot com"]),
    ("mail john\t[at]\texample\n[dot]\ncom now", ["john\t[at]\texample\n[dot]\ncom"]),
    ("host one nine two dot one six eight dot zero dot one is up", ["one nine two dot one six eight dot zero dot one"]),
    ("host 192 dot 168 dot one dot 1 is up", ["192 dot 168 dot one dot 1"]),
    ("host 192.168.one.one is up", ["192.168.one.one"]),
    ("host one nine two [dot] 168 [dot] 0 [dot] one is up", ["one nine two [dot] 168 [dot] 0 [dot] one"]),
    ("call plus one 555 five five five 0100 today", ["plus one 555 five five five 0100"]),
    ("call +1 five five five (010) 99 nine nine today", ["+1 five five five (010) 99 nine nine"]),
    ("card 4111 1111 one one one one 1111 ok", ["4111 1111 one one one one 1111"]),
    ("call plus\tone  five five\nfive zero one two three four", ["plus\tone  five five\nfive zero one two three four"]),
    ("écrivez à jean arobase exemple point fr merci", ["jean arobase exemple point fr"]),
    ("schreibt an uwe at beispiel punkt de heute", ["uwe at beispiel punkt de"]),
    ("escribe a ana (arroba) ejemplo (punto) es hoy", ["ana (arroba) ejemplo (punto) es"]),
    ("appelez plus trois trois un deux trois quatre cinq six sept huit neuf ce soir", ["plus trois trois un deux trois quatre cinq six sept huit neuf"]),
    ("llama más tres cuatro nueve uno dos tres cuatro cinco seis siete ocho ya", ["más tres cuatro nueve uno dos tres cuatro cinco seis siete ocho"]),
    ("Rechner zehn eins neun zwei punkt eins sechs acht punkt null punkt fünf hier", ["eins neun zwei punkt eins sechs acht punkt null punkt fünf"]), ("Rechner 10 punkt null punkt null punkt fünf hier", ["10 punkt null punkt null punkt fünf"]),
    ("un jour, deux fois, trois points", []), ("a un punto dos", []), ("neuf.", []),
    ("look at example.com, a polka dot, one 2 three", []), ("version 2 dot one", []), ("six seventy 2 dot 3 dot 4 dot 5x", []),
])
def test_mixed_disguises(text, found):
    more = pii.added_spans(text, pii.plain_spans(text))
    assert [text[a:b] for k in pii.KINDS for a, b in more[k]] == found


def test_pii_table(spark):
    d = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1", 9), (2, None, 9), (2, "", 9), (3, "x@y.z " * 3000, 9)], "doc_id long, text string, spans int")
    got = sorted(map(tuple, pii.digest(pii.find(d)).collect()), key=str)
    assert [g[:5] for g in got] == [(1, 1, 1, 0, 0), (2, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 3000, 0, 0, 0)]
    assert got[0][6] == "email:5:11,ip:15:23"
    assert [r.text for r in pii.redact(d).filter("doc_id < 3").orderBy("doc_id", "text").collect()] == ["mail <EMAIL> or <IP>", None, ""]
    assert pii.find(d.limit(0)).count() == 0
