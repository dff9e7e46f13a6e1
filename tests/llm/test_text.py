"""Licence scan, HTML extraction, URL filters and chat formatting."""

import hashlib
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from meshwork.llm import chat, license_scan
from meshwork.llm import url_filter as url_module
from meshwork.llm.common import table
from meshwork.llm.html_text import HIDDEN, VOID, extract_html, html_text
from meshwork.llm.license_scan import TEMPLATES, Matcher, matches, terms
from meshwork.llm.queries import document_paths, op1_license_scan, op2_html_text
from meshwork.llm.url_filter import linked_hosts, url_filter

# HTML


@pytest.mark.parametrize(
    "source,text",
    [
        ("a <b>b</b>c", "a bc"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k         value\nlong key  1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide<tr><td>x<td>y</table>", "a  b\n   c\nwide\nx  y"),
        ("<table><tr><td>é<td>日本<td>z<tr><td>ab<td>c<td>z</table>", "é   日本  z\nab  c     z"),
        ("<head><title>t</title></head><script>x<p></script><style>y</style>z", "z"),
        ("<p style='display: none'>a</p><p hidden>b</p><i style='visibility:hidden'>c<b style='visibility:visible'>d</b></i>", "d"),
        ("<details>x<summary>s</summary>y</details><details open><summary>t</summary>z</details>", "s\nt\nz"),
        ("<pre>  a\n    b</pre>", "  a\n    b"),
        ("a<!-- no -->b<? no ?>c<!no>d</ no>e", "abcde"),
        ("1 < 2 &amp; 3 &eacute; &#233;", "1 < 2 & 3 é é"),
        ('<a title="x > y" href=z>q</a><a title="unclosed>w', "qw"),
        ("</p>a</div>b<div>c", "ab\nc"),
        ("<h1>a<h2>b</h2>c", "a\n\nb\n\nc"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<select><option>a<option>b</select><dl><dt>k<dd>v</dl>", "a\nb\n\nk\n  v"),
        ("plain", "plain"),
        ("", ""),
    ],
)
def test_html(source, text):
    assert html_text(source) == text


@pytest.mark.parametrize(
    "source,text",
    [
        ('<img alt="5" tall">First visible text. <a href="/a">one</a> <p class="z">last paragraph</p> tail', "First visible text. one\n\nlast paragraph\n\ntail"),
        ("<p title=it's>Text one.</p><p>Text two don't stop.</p>", "Text one.\n\nText two don't stop."),
        ("<p a'b c=\"x > y\" 'd>e</p><p>f's</p>", "e\n\nf's"),
        ("<p title = 'x > y'hidden>a</p><p title=\"'\" =hidden>b</p>", "b"),
        ("</p \">a</p x='>'>b\"", "a\n\nb\""),
    ],
)
def test_html_stray_quotes(source, text):
    assert html_text(source) == text


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='TeX'>x=1</annotation></semantics></math> holds", "so x=1 holds"),
        ("<svg><title>t</title><desc>d</desc><defs><text>u</text></defs><g/><text x=1>one</text><text>two <tspan>three</tspan></text></svg>four", "one\ntwo three\nfour"),
        ("<svg><defs/><style/><path d=a/><text><![CDATA[a & <b>]]></text></svg><svg/><desc>c</desc>", "a & <b>\nc"),
        ("<svg><metadata>m<text>n</svg>o", "o"),
    ],
)
def test_html_math_and_svg(source, text):
    assert html_text(source) == text


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p style='display:none;display:block'>a</p>", "a"),
        ("<p style='display:block; DISPLAY : None'>a</p>b", "b"),
        ("<p style='display:none !important;display:block'>a</p>b", "b"),
        ("<p style='content:\"display:none\"'>a</p>", "a"),
        ("<p style='font-family: \"a;display:none\"; color:red'>a</p>", "a"),
        ("<p style='visibility:hidden;visibility:inherit'>a<b style='visibility:visible'>c</b></p>b", "a c b".replace("a c b", "ac\n\nb")),
        ("<object data=x><p>instead</p></object>", "instead"),
    ],
)
def test_html_styles(source, text):
    assert html_text(source) == text


class Words(HTMLParser):
    """Another way to a page's visible words: the standard library's parser, and a stack of hidden tags."""

    def __init__(self, source):
        super().__init__()
        self.words, self.hidden = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in VOID and (self.hidden or tag in HIDDEN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def random_page(rng, depth=0):
    tags = ["div", "p", "ul", "ol", "table", "b", "i", "span", "section", "blockquote", "pre", "script", "h2"]
    out = []
    for _ in range(rng.randrange(1, 4)):
        word = f"w{rng.randrange(1000)}"
        if depth > 3 or rng.random() < 0.3:
            out.append(f" {word} &amp; <br> {word} ")
            continue
        tag = rng.choice(tags)
        style = rng.choice(["", "", "", " hidden", " style='display: none'", " title='a > b'"])
        inner = random_page(rng, depth + 1)
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{random_page(rng, depth + 2)}</li>" for _ in range(2))
        elif tag == "table":
            inner = "".join(f"<tr><td> {word}{i} </td></tr>" for i in range(2))
        elif tag in ("p", "b", "i", "span", "pre", "h2", "script"):
            inner = f" {word} <b>{word}</b> " if tag != "script" else f"x = '{word}'"
        out.append(f"<{tag}{style}>{inner}</{tag}>")
    return "".join(out)


def test_html_against_another_parser():
    """All visible words in order, on pages of random tags."""
    rng = random.Random(12)
    for _ in range(400):
        page = random_page(rng)
        words = [w for w in html_text(page).split() if not re.fullmatch(r"-|[0-9]+\.", w)]
        assert words == Words(page).words, page


def test_html_of_all_pages(spark):
    """The registered query on all pages: the words are those that the other parser sees."""
    d = "/root/testdata/sf0.01"
    found = {r.page_id: r.text for r in op2_html_text(spark, d).collect()}
    pages = table(spark, d, "pages").select("page_id", "html").collect()
    assert len(found) == len(pages)
    bare = lambda words: re.sub(r"[\W_]+|(?<![0-9])[0-9]+(?=\. )", "", " ".join(words))
    right = sum(sorted(bare(found[p.page_id].split())) == sorted(bare(Words(p.html or "").words)) for p in pages)
    assert right >= 0.95 * len(pages)


def test_html_stays_fast_and_whole():
    for evil in ("<b>" * 50000, '<a "' * 50000, "<table><tr><td>" * 2000, "<ul><li>" * 2000 + "x", "<" * 50000, "<div><p>" * 20000 + "y"):
        html_text(evil)
    assert html_text("<p>" + "word " * 200000).count("word") == 200000


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, "y"), (None, "", "z")], "page_id long, html string, text string")
    assert sorted(extract_html(pages).collect(), key=str) == sorted([(1, "a"), (1, "a"), (2, ""), (None, "")], key=str)
    assert extract_html(spark.createDataFrame([], "page_id long, html string")).isEmpty()


# URL filters


def test_rules(spark):
    cases = [
        ("https://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://myexample.com/en/7", "myexample.com", "/en/7", "com/en/", "block"),
        ("http://x.net/de/?a=://b", "x.net", "/de/", "net/de/", "block"),
        ("http://x.net?/de/", "x.net", "", None, None),
        ("http://É.org/es/É", "É.org", "/es/É", "org/es/", "block"),
        ("no scheme.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://com/en/", "com", "/en/", "com/en/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, None, "r") for i, (u, *_) in enumerate(cases)] + [(0, cases[0][0], None, "r")], "page_id long, url string, html string, rule string")
    found = url_filter(pages).collect()
    assert len(found) == len(cases) + 1
    for r in found:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)
    assert url_filter(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def brute_rank(edges, seeds, rounds=10):
    out = Counter()
    for (s, _), w in edges.items():
        out[s] += w
    now = dict(seeds)
    for _ in range(rounds):
        sent = Counter()
        for (s, d), w in edges.items():
            if s in now:
                sent[d] += 0.85 * now[s] * w / out[s]
        back = 1 - sum(sent.values())
        for h, m in seeds.items():
            sent[h] += m * back
        now = dict(sent)
    return now


def test_propagation(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.info" for i in range(12)] + ["bad.com", "good.example.com"]
    rows, edges = [], Counter()
    for i in range(80):
        h = rng.choice(hosts)
        path = "/en/7" if h.startswith("good") else "/en/1"
        to = [rng.choice(hosts) for _ in range(rng.randrange(3))]
        rows.append((i, f"https://{h}{path}", " ".join(f'<a href="https://{t.upper()}/x">' for t in to) + '<a href="/local">'))
        edges.update((h, t) for t in to if t != h)
    trust = brute_rank(edges, {"good.example.com": 1.0})
    distrust = brute_rank({(d, s): w for (s, d), w in edges.items()}, {"bad.com": 1.0})
    found = url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    seen = set()
    for r in found:
        if r.rule is None:
            t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
            assert r.verdict == ("block" if d > 0.5 * (t + d) else "allow")
            seen.add(r.verdict)
    assert seen == {"allow", "block"}


def test_propagation_reaches_every_host(spark):
    """A chain of 14 links to a blocked host, a loop on the way, and trust that comes round a longer way."""
    hosts = ["bad.com", *(f"c{i}.info" for i in range(14))]
    links = [(b, a) for a, b in zip(hosts, hosts[1:])] + [("c3.info", "c9.info"), ("good.example.com", "d0.info"), ("alone.info", "none.info")]
    links += [(f"d{i}.info", f"d{i + 1}.info") for i in range(12)] + [("d12.info", "c2.info"), ("c2.info", "c1.info")]
    rows = [(i, f"https://{s}{'/en/7' if s.startswith('good') else '/en/1'}", f'<a href="https://{d}/x">') for i, (s, d) in enumerate(links)] + [(99, "https://bad.com/en/1", "")]
    edges = Counter(links)
    trust = brute_rank(edges, {"good.example.com": 1.0}, 400)
    distrust = brute_rank({(d, s): w for (s, d), w in edges.items()}, {"bad.com": 1.0}, 400)
    found = {r.host: r.verdict for r in url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r.rule is None}
    assert found == {h: "block" if distrust.get(h, 0) > 0.5 * (trust.get(h, 0) + distrust.get(h, 0)) else "allow" for h in found}
    assert found["c13.info"] == "block" and found["alone.info"] == "allow"


def test_links_come_from_tags_alone():
    page = """<p data-href="https://a.no/"><!-- <a href="https://b.no/"> --><script>var x = '<a href="https://c.no/">'</script><link href="//d.no/x">
      <a href="https://E.yes/?q">1</a><area href='//f.yes:80/'><a class=href href = https://g.yes>2</a><a href="https:&#47;/h.yes/">3</a><a title="href=//i.no" href="/local">4</a><A HREF=" https://e.yes "></a>"""
    assert linked_hosts(page) == {"e.yes": 2, "f.yes:80": 1, "g.yes": 1, "h.yes": 1}


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_rules_from_a_table(spark, monkeypatch, most):
    """Thousands of rules, several of a host, with and without paths, against a plain search; broadcast, and shuffled."""
    monkeypatch.setattr(url_module, "BROADCAST_RULES", most)
    rng = random.Random(13)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + rng.choice([".com", ".org"]) for _ in range(40)]
    rules = {rng.choice([*hosts, "com", "org"]) + rng.choice(["", "/", "/a", "/ab", "/abc/", f"/x{rng.randrange(9)}"]): rng.choice(["allow", "block"]) for _ in range(80)}
    rules |= {f"far{i}.com/": "block" for i in range(2000)}
    pages = [(i, "http://" + rng.choice(["", "www."]) + rng.choice(hosts) + rng.choice(["", "/", "/abc/d", "/ab", "/x3y?z", "#f"]), None) for i in range(300)] + [(300, None, "<a href='//a.com/'>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    listed = spark.createDataFrame([(r, v) for r, v in rules.items()] + [(None, "block"), ("a.com/", None)], "rule string, verdict string")
    found = {r.page_id: r for r in url_filter(frame, listed).collect()}
    for i, url, _ in pages:
        host, path = (re.match(r"http://([^/?#]*)([^?#]*)", url).groups()) if url else ("", "")
        fits = [r for r in rules if host and ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" * ("/" in r) + r.partition("/")[2])]
        best = min(fits, key=lambda r: (-len(r), r), default=None)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, best) and (best is None or found[i].verdict == rules[best])


def test_url_filter_odd_pages(spark):
    """Null html beside links, a very long page, repeated rows, and columns named like the result's."""
    long = "<p>" + "word " * 100000 + '<a href="https://good.example.com/">'
    rows = [(1, "https://bad.com/en/", None), (2, "https://x.info/", '<a href="https://bad.com/">'), (2, "https://x.info/", '<a href="https://bad.com/">'), (3, "https://good.example.com/en/7", long), (None, None, long), (4, "https://y.info/", "")]
    frame = spark.createDataFrame([(*r, "h", "p", "v", 1) for r in rows], "page_id long, url string, html string, host string, path string, verdict string, size int")
    found = sorted(((r.page_id, r.host, r.verdict) for r in url_filter(frame).collect()), key=str)
    assert found == sorted([(1, "bad.com", "block"), (2, "x.info", "block"), (2, "x.info", "block"), (3, "good.example.com", "allow"), (None, "", "allow"), (4, "y.info", "allow")], key=str)


# Chat formatting


def test_escape_round_trip():
    rng = random.Random(6)
    parts = [*chat.CONTROLS, "\\", "<", "[", "\n", "a", "<\\s>", "[\\\\INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROLS)


def test_mask_by_binary_search():
    assert chat.loss_mask(np.array([0, 2, 2, 4, 6, 9]), [(2, 4), (6, 9)]).tolist() == [False, True, True, False, True, False]
    assert chat.loss_mask(np.array([], int), [(0, 1)]).tolist() == []
    assert chat.loss_mask(np.array([0, 1]), []).tolist() == [False, False]


def test_chats(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", "  \n\n é日本😀 <|im_end|> x \n"), (1, 0, "system", None), (1, 2, "assistant", ""), (1, 3, "assistant", "again"), (1, 3, "assistant", "again")]
    rows += [(2, None, None, "n"), (None, 0, "user", "u"), (3, 0, "assistant", "long " * 40000), (4, 0, "assistant", "\\<s> \\\\[INST]")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(frame)
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    tokenizer = chat.load(chat.TOKENIZER)
    for r in formatted.collect():
        turns = groups[r.conv_id]
        assert chat.parse(r.formatted) == turns
        assert tokenizer.decode(r.ids, skip_special_tokens=False) == r.formatted
        assert "".join(chat.masked_text(r.formatted, r.mask, r.starts, r.ends)) == "".join(t for role, t in turns if role == "assistant")
    for r in chat.digests(formatted).collect():
        loss = "".join(t for role, t in groups[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(groups[r.conv_id]), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert formatted.count() == len(groups)
    assert chat.format_chats(spark.createDataFrame([], frame.schema)).isEmpty()


# Licence scan


def brute_best(text, idf, rare, templates):
    own = Counter(terms(text))
    vector = {t: c * idf.get(t, rare) for t, c in own.items()}
    best = {}
    for name, texts in templates.items():
        for template in texts:
            other = {t: c * idf[t] for t, c in Counter(terms(template)).items()}
            dot = sum(w * other.get(t, 0) for t, w in vector.items())
            norm = math.sqrt(sum(w * w for w in vector.values()) * sum(w * w for w in other.values()))
            best[name] = max(best.get(name, 0), dot / norm if norm else 0)
    return best


def allowed(name, text):
    needs, bars = license_scan.TELLING.get(name, ((), ()))
    own = set(terms(text))
    return all(own & set(some) for some in needs) and not own & set(bars)


def test_cosine_against_brute_force():
    rng = random.Random(7)
    known = license_scan.vocabulary(TEMPLATES)
    idf, rare = {t: 1 + rng.random() * 5 for t in known}, 7.0
    matcher = Matcher(TEMPLATES, idf, rare)
    for _ in range(200):
        text = " ".join(rng.choice([*known, "other", "words"]) for _ in range(rng.randrange(1, 20)))
        got = {name: round(score, 9) for score, name in matcher.best(Counter(terms(text)), 1e-12)}
        want = {name: round(score, 9) for name, score in brute_best(text, idf, rare, TEMPLATES).items() if score >= 1e-12 and allowed(name, text)}
        assert got == want


def test_places():
    known = license_scan.vocabulary(TEMPLATES)
    matcher = Matcher(TEMPLATES, dict.fromkeys(known, 2.0), 4.0)
    for name, texts in TEMPLATES.items():
        for text in texts:
            assert name in matches("code\n# " + text.replace(" ", "\n# ", 3) + "\n\nmore", matcher, 0.75) or name in matches(text, matcher, 0.75)
    assert matches("nothing to see\nhere", matcher, 0.75) == {}
    assert matches("x\n" * 50000 + "Released under the MIT License.", matcher, 0.75)["MIT"][1] == 50000


def brute_places(text, matcher, least=0.75):
    """Of each licence the best cosine of all parts: lines, sentences, paragraphs, windows, the whole."""
    best = {}
    lines = text.split("\n")
    runs, run = [], []
    for line in [*lines, ""]:
        if terms(line):
            run.append(line)
        elif run:
            runs.append("\n".join(run))
            run = []
    for part in [*lines, *runs, *(x for r in runs for x in re.split(r"[.!?;:]\s", r.lower())), text]:
        found = {n: v for n, v in brute_best(part, matcher.idf, matcher.rare, TEMPLATES).items() if v >= least and allowed(n, part)}
        if found:
            name = min(found, key=lambda n: (-found[n], n))
            best[name] = max(best.get(name, 0), found[name])
    own = terms(text)
    for name, texts in TEMPLATES.items():
        for template in texts:
            size = len(terms(template))
            for i in range(len(own) - size + 1):
                part = " ".join(own[i : i + size])
                score = brute_best(part, matcher.idf, matcher.rare, {name: [template]})[name]
                if score >= least and allowed(name, part):
                    best[name] = max(best.get(name, 0), score)
    for name, other in license_scan.GOES_ON.items():
        if name in best:
            best.pop(other, None)
    return {n: round(v, 9) for n, v in best.items()}


@pytest.mark.parametrize("name", TEMPLATES)
def test_licence_families(name):
    """Every licence's words are found as that licence: alone, wrapped in comments directly above code, and amid other words."""
    for idf, rare in ((2.0, 4.0), (5.0, 6.0)):
        matcher = Matcher(TEMPLATES, dict.fromkeys(license_scan.vocabulary(TEMPLATES), idf), rare)
        for text in TEMPLATES[name]:
            words = text.split()
            header = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            code = "#!/bin/sh\n" + header + "\nimport os\nx = 1\nfor i in range(10): print(foo, bar, baz)\n"
            for place in (text, code, "some words before " + text + " and after it"):
                found = matches(place, matcher, 0.75)
                assert min(found, key=lambda n: (-found[n][0], n)) == name, (place, found)
            assert matches(text, matcher, 0.75)[name][2] and not matches(code + "more code here " * 40, matcher, 0.75)[name][2]


def test_licence_query_against_brute_force(spark):
    """The registered query: idf by counting, places by trying all, inheritance by walking up."""
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in document_paths(table(spark, d, "documents")).collect()]
    known = license_scan.vocabulary(TEMPLATES)
    sets = [set(terms(t or "")) for _, _, t in rows]
    idf = {t: math.log((len(rows) + 1) / (sum(t in s for s in sets) + 1)) + 1 for t in known}
    matcher = Matcher(TEMPLATES, idf, math.log(len(rows) + 1) + 1)
    own, gives = {}, {}
    texts = {i: text for i, _, text in rows}

    def is_file(path, text, name):
        return "/LICENSE" in path or brute_best(text, idf, matcher.rare, {name: TEMPLATES[name]})[name] >= 0.75

    for i, path, text in rows:
        # trying all windows takes long, so texts without a word of licences go without
        found = brute_places(text, matcher) if text and re.search("(?i)licen|redistribut|permission|public domain", text) else {}
        if found:
            name = min(found, key=lambda n: (-found[n], n))
            own[i] = name, found[name]
            if is_file(path, text, name):
                folder = path.rpartition("/")[0]
                gives[folder] = min(gives.get(folder, (0.0, "")), (-found[name], name))
    found = {r.doc_id: r for r in op1_license_scan(spark, d).collect()}
    assert len(found) == len(rows) and own
    for i, path, _ in rows:
        license_, origin, above = None, "none", None
        folder = path.rpartition("/")[0]
        if i in own:
            license_, origin = own[i][0], "file" if is_file(path, texts[i], own[i][0]) else "header"
        else:
            while folder and folder not in gives:
                folder = folder.rpartition("/")[0]
            if folder in gives:
                license_, origin, above = gives[folder][1], "inherited", folder
        assert (found[i].license, found[i].origin, found[i].from_dir) == (license_, origin, above)


def test_licences_inside_longer_text():
    matcher = Matcher(TEMPLATES, dict.fromkeys(license_scan.vocabulary(TEMPLATES), 2.0), 4.0)
    rng = random.Random(9)
    mit, apache, gpl = TEMPLATES["MIT"], TEMPLATES["Apache-2.0"], TEMPLATES["GPL-3.0"]
    filler = lambda n: " ".join(f"word{rng.randrange(1000)}" for _ in range(n))
    for text, name, line in [
        ("code\nCopyright (c) 2020 Example Corp. Released under the MIT License.", "MIT", 1),
        ("Copyright 2019 The Foo Authors. All rights reserved. " + apache[0], "Apache-2.0", 0),
        (f"{filler(7)} {mit[0]} {filler(7)}", "MIT", 0),
        (f"{filler(3000)} {mit[1]} {filler(3000)}", "MIT", 0),
        (f"# {filler(40)}\n#\n# " + gpl[1].replace(" ", "\n# ", 9) + f"\n#\n# {filler(40)}", "GPL-3.0", 2),
    ]:
        score, at, _ = matches(text, matcher, 0.75)[name]
        assert score > 0.99 and at == line
    # no window or sentence is left out by the bounds
    for _ in range(100):
        words = [rng.choice([*terms(mit[0]), *terms(apache[0]), "other"]) for _ in range(30)]
        assert {k: round(v[0], 9) for k, v in matches(" ".join(words), matcher, 0.75).items()} == brute_places(" ".join(words), matcher)
    assert matches(" ".join(["mit license"] * 50000), matcher, 0.75) is not None


def test_inheritance(spark):
    mit, gpl = TEMPLATES["MIT"][0], TEMPLATES["GPL-3.0"][0]
    rows = [(1, "LICENSE", mit), (2, "a.py", "x"), (3, "d/e/b.py", "y"), (4, "d/COPYING", gpl), (5, "d/e/f/c.py", "# " + TEMPLATES["CC-BY-4.0"][0] + "\ncode that goes on for some more words"), (6, None, "z"), (7, "d/e/b.py", None), (3, "d/e/b.py", "y")]
    rows += [(10 + i, f"other/{i}.py", f"text {i}") for i in range(60)]
    files = spark.createDataFrame([(*r, 0) for r in rows], "file long, path string, text string, license int")
    found = {r.file: (r.license, r.origin, r.from_dir) for r in license_scan.license_scan(files).collect()}
    assert found[1] == ("MIT", "file", None) and found[2] == ("MIT", "inherited", "")
    assert found[3] == found[7] == ("GPL-3.0", "inherited", "d") and found[4] == ("GPL-3.0", "file", None)
    assert found[5] == ("CC-BY-4.0", "header", None) and found[6] == ("MIT", "inherited", "") and found[10] == ("MIT", "inherited", "")
    assert license_scan.license_scan(files).count() == len(rows)
    assert license_scan.license_scan(spark.createDataFrame([], "file long, path string, text string")).isEmpty()
    assert re.match(license_scan.LICENSE_FILE, "LICENSE-MIT.txt") and not re.match(license_scan.LICENSE_FILE, "licensed.py")
