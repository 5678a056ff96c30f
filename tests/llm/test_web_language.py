"""Language ID (1), URL filters (2), WARC (7) and HTML extraction (10)."""

import base64
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import html_extract, lang_id, url_filter, warc

from .cases import DOCS, LONG, PAGES, odd_frame, with_clashes

SYLLABLES = {"xx": "ka ro mi tu sel", "yy": "sch ein ung lich zer", "zz": "eau oi ment que tion"}


def invented(lang, n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rows = [(i, invented(lang, 5 + i % 40, i), lang, None, None) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    model = lang_id.train(docs.where("doc_id % 5 <> 0"))
    out = {r["doc_id"]: r for r in lang_id.identify(with_clashes(docs), model, ["doc_id"]).collect()}
    assert all(out[r[0]]["lang_pred"] == r[2] for r in rows) and all(0 < r["score"] <= 1 for r in out.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "KA-RO, MI.TU"), (5, "Ωμέγα 言語 ßü"), (6, invented("yy", 60_000, 1))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lang_id.identify(odd, model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["score"] == 0 and not got[i]["accepted"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "xx" and got[6]["lang_pred"] == "yy" and got[6]["accepted"]
    assert got[5]["lang_pred"] in SYLLABLES and not got[5]["accepted"]
    assert lang_id.identify(docs.limit(0), model, ["doc_id"]).count() == 0
    assert lang_id.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in lang_id.identify(odd_frame(spark), None, ["doc_id"]).collect()} == {"und"}


def brute_kneser_ney(texts, order):
    """p(symbol | context) of one language by the definition."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        x = tuple(lang_id.symbols(t, order).tolist())
        for i in range(order - 1, len(x)):
            for k in range(1, order + 1):
                grams[k][x[i - k + 1 : i + 1]] += 1
    counts = [None] * (order + 1)
    counts[order] = dict(grams[order])
    for k in range(1, order):
        counts[k] = Counter(g[1:] for g in grams[k + 1])
    size = max(256, 2 * len(counts[1]))

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        c = counts[k]
        same = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
        total = sum(same.values())
        return max(c.get(gram, 0) - d, 0) / total + d * len(same) / total * p(gram[1:])

    return p


def test_model_is_kneser_ney(spark):
    texts = ["banana bandana", "ananas ban", "nab"]
    docs = spark.createDataFrame([(t, "q") for t in texts], "text string, lang string")
    model = lang_id.fitted(lang_id.counted(docs, 3), 3)
    p = brute_kneser_ney(texts, 3)
    for text in ["banana", "nab xyz", "bandanas"]:
        x = lang_id.symbols(text, 3)
        want = [math.log(p(tuple(x[i - 2 : i + 1].tolist()))) for i in range(2, len(x))]
        assert model.scores(x)[:, 0].tolist() == pytest.approx(want, abs=1e-4)


def test_probabilities_sum_to_one_for_many_languages(spark):
    texts = {f"l{i:03}": "".join(random.Random(i).choices("abcdefghij ", k=120)) for i in range(300)}
    rows = [(i, t, lang, None, None) for i, (lang, t) in enumerate(texts.items())] + [(1000, texts["l000"], "l000", None, None)] * 2
    model = lang_id.train(spark.createDataFrame(rows, DOCS), order=3)
    assert model.langs == sorted(texts)
    x = [0, *map(ord, "abcdefghij")]
    for context in ([0, 0], [ord("a"), 0], [ord("c"), ord("d")], [ord("z"), ord("j")], [0x4E00, 0x4E01]):
        seen = sum(np.exp(model.scores(np.array([*context, c], np.uint32))[0].astype(float)) for c in x)
        other = np.exp(model.scores(np.array([*context, 0x3A9], np.uint32))[0].astype(float))  # one of the symbols that no text has
        assert np.allclose(seen + other * (256 - len(x)), 1, atol=1e-4)
    own = [lang for lang in ("l001", "l150", "l299") if model.decide([texts[lang]])[0] == [lang]]
    assert own == ["l001", "l150", "l299"]


def test_ties_and_repeated_rows_of_languages(spark):
    rows = [(i, invented(lang, 30, i % 20), lang, None, None) for i, lang in enumerate(["yy", "xx"] * 20)]
    twins = [(i, t, "a" + lang if lang == "xx" else lang, s, n) for i, t, lang, s, n in rows if lang == "xx"]
    model = lang_id.train(spark.createDataFrame(rows + twins, DOCS))
    text = invented("xx", 40, 77)
    got = lang_id.identify(spark.createDataFrame([(1, text), (1, text), (2, text.upper())], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert {r["lang_pred"] for r in got} == {"axx"} and len({tuple(r)[1:] for r in got}) == 1 and len(got) == 3 and got[0]["score"] == pytest.approx(0.5, abs=0.01)


def test_sample_is_bounded_but_has_every_language(spark):
    rows = [(i, "word " * (1 + i % 9), "en", None, None) for i in range(200)] + [(900, "lang " * 5000, "xx", None, None), (901, None, "yy", None, None), (902, "zz", None, None, None)]
    got = lang_id.training_sample(spark.createDataFrame(rows, DOCS), 50, 2000).collect()
    assert {r["lang"] for r in got} == {"en", "xx"} and len([r for r in got if r["lang"] == "en"]) <= 50
    assert sum(len(r["text"]) for r in got if r["lang"] == "en") <= 1000 and {r["text"] for r in got} <= {r[1] for r in rows}


def test_slices_do_not_change_scores(monkeypatch, spark):
    docs = spark.createDataFrame([(invented("xx", 50, i), "xx") for i in range(5)], "text string, lang string")
    model = lang_id.fitted(lang_id.counted(docs))
    whole = model.entropies([LONG, "ka ro", None])
    monkeypatch.setattr(lang_id, "SLICE", 1000)
    parts = model.entropies([LONG, "ka ro", None])
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


URLS = [
    ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("x://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("http://q.com/de/?a", "q.com", "/de/", "com/de/", "block"),
    ("http://xcom/de/", "xcom", "/de/", None, "allow"),
    ("http://q.org", "q.org", "", None, "allow"),
    ("http://q.org?x/", "q.org", "", None, "allow"),
    ("http://q.org:80/", "q.org:80", "/", None, "allow"),
    ("no host/de/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://É.COM/de/", "É.com", "/de/", "com/de/", "block"),
    ("a\nb://q.com/fr/://z", "q.com", "/fr/://z", "com/fr/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)] + [(0, URLS[0][0], "")], PAGES)
    got = sorted(map(tuple, url_filter.url_report(with_clashes(pages)).collect()))
    assert got == sorted([(i, *u[1:]) for i, u in enumerate(URLS)] + [(0, *URLS[0][1:])])
    assert url_filter.url_report(pages.limit(0)).count() == 0


def brute_rank(seeds, edges, rounds=200, d=url_filter.DAMPING):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float)
        moved = sum(r for h, r in rank.items() if h in out)
        for (a, b), w in edges.items():
            new[b] += d * rank.get(a, 0) * w / out[a]
        for h, s in seeds.items():
            new[h] += s * (1 - d * moved)
        rank = new
    return rank


def test_ranks_and_verdicts(spark):
    rnd = random.Random(1)
    names = [f"good{i}.org" for i in range(5)] + [f"bad{i}.com" for i in range(4)] + ["farm.net", "nice.net", "far.net"]
    links = [(f"good{i}.org", f"good{(i + 1) % 5}.org") for i in range(5)] + [("farm.net", f"bad{i}.com") for i in range(4)] + [(f"bad{i}.com", "farm.net") for i in range(4)] + [("good0.org", "nice.net"), ("far.net", "farm.net"), ("nice.net", "good2.org")]
    rows = [(k, f"http://{h}/{'de' if 'bad' in h else 'x'}/{k}", "".join(f"<a {'HREF' if k % 2 else 'href'}='https://{b}/z?{rnd.random()}'>t</a><a href=\"/own\">" for a, b in links if a == h) + f'<a href="http://{h}/self">') for k, h in enumerate(names)]
    pages = spark.createDataFrame(rows, PAGES)
    verdict = {r["host"]: r["verdict"] for r in url_filter.url_report(pages).collect()}
    assert verdict["farm.net"] == "block" and verdict["nice.net"] == "allow" and all(v == ("block" if "bad" in h else "allow") for h, v in verdict.items() if h not in ("farm.net", "far.net"))
    edges = url_filter.host_edges(pages.withColumn("host", url_filter.host_of(F.col("url"))))
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == Counter(links)
    seeds = {f"good{i}.org": 0.2 for i in range(5)}
    got = {r["host"]: r["rank"] for r in url_filter.spread(spark.createDataFrame(list(seeds.items()), "host string, seed double"), url_filter._shares(edges, "src", "dst")).collect()}
    want = brute_rank(seeds, Counter(links))
    assert {h for h, r in want.items() if r} == set(got) and sum(abs(got[h] - want[h]) for h in got) <= url_filter.TOLERANCE and sum(got.values()) == pytest.approx(1)


def test_long_urls_and_pages(spark):
    rows = [(1, "http://a.org/" + "x" * 200_000, "<p>" + LONG), (2, "http://b.com/de/" + "y" * 200_000 + "?q", f"<a href='//a.org/'>{LONG}</a>" * 2)]
    got = {r["page_id"]: r for r in url_filter.url_report(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1]["rule"] == "org/" and len(got[1]["path"]) == 200_001 and got[2]["verdict"] == "block" and got[2]["path"].endswith("y")


def test_half_of_the_hosts_are_bad(spark):
    rows = [(10 * i + k, f"http://h{i}.{'com' if i % 2 else 'net'}/{'de' if k else 'x'}/{k}", None) for i in range(20) for k in range(4)]
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.url_report(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(verdict[10 * i] == ("block" if i % 2 else "allow") for i in range(20))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archive_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(warc, "READ_BYTES", 10_000)
    same = "<p>" + "gleich ü " * 400
    rows = [(5, "http://a/1", same), (3, "http://a/2", same), (9, None, same), (7, "http://a/3\r\nx", ""), (8, "http://a/4", None), (None, "http://a/5", same), (2, "u", "\r\n\r\nWARC/1.1\r\n"), (1, "v", LONG), (3, "http://a/2", same), (None, "n", "only null")]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.archive_report(with_clashes(pages)).collect()
    key = lambda r: repr(tuple(r))
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        first = min(ids, default=None)
        revisit = page_id is not None and page_id > first
        want.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(key, got)) == sorted(map(repr, want))
    index = warc.archive(pages)
    full = {r["page_id"]: r for r in warc.read_bundles(index).where("record_type = 'response'").collect()}
    assert bytes(full[1]["payload"]).decode() == LONG and bytes(full[2]["payload"]).decode() == "\r\n\r\nWARC/1.1\r\n"
    at = index.where("page_id = 1").first()
    assert warc.read_record(at["bundle"], at["frame"], at["offset"], at["length"])[1].decode() == LONG
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_least_bytes_of_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], PAGES)
    assert {r["page_id"]: r["refers_to"] for r in warc.with_revisits(pages, 2).collect()} == {1: None, 2: 1}
    assert {r["page_id"]: r["refers_to"] for r in warc.with_revisits(pages, 3).collect()} == {1: None, 2: None}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=30), st.integers(1, 600))
def test_seek_table(payloads, frame):
    out = io.BytesIO()
    writer = warc.BundleWriter(out, frame)
    raws = [warc.record(i, "u", p, len(p), "D", None) for i, p in enumerate(payloads)]
    for r in raws:
        writer.add(r)
    writer.close()
    data = out.getvalue()
    table = warc.seek_table(io.BytesIO(data), len(data))
    assert [(a, b, c) for a, b, c in table] == [(sum(x[0] for x in writer.frames[:i]), *writer.frames[i]) for i in range(len(writer.frames))]
    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + b]) for a, b, _ in table)
    assert whole == b"".join(raws)
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as f:
        assert f.read() == whole


HTML = [
    ("a < b <p>q &lt;i&gt; &amp;nbsp;&nbsp;x<p>z", "a < b\n\nq <i> &nbsp; x\n\nz"),
    ("<div class='article-header'><h1>T</h1></div><div class=comments>no</div><p>yes", "T\n\nyes"),
    ("<article><h1>A</h1><header>h</header><p>one<ul><li>x<li>y</ul><div class='ad'>z</div><a title=it's href=q>it isn't</a></article>junk<p>k", "A\n\none\n\nx\n\ny\n\nit isn't"),
    ("<main><p>a<br>b</p><script>var x='<p>no'</script><form>f</form></main><footer>f</footer>", "a b"),
    ("<!-- <p>c</p> --><nav>n</nav><p>t<b>o</b>p\t\n end<style>p{}</style>", "top end"),
    ("<article>one</article><article>two</article><article class='comment'>c</article>", "one\n\ntwo"),
    ("<p>1 > 0 &copy; &#233;<p hidden>h<aside>s</aside>", "1 > 0 © é"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("", ""), (None, ""), ("<p>cut <b", "cut"), ("<<p>x", "<\n\nx"),
]


@pytest.mark.parametrize(("page", "text"), HTML)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pab=\"' -!div&;", max_size=80))
def test_any_markup_is_read(page):
    assert html_extract.main_text(page) == html_extract.main_text(page)


def test_site_tree_drops_what_repeats(spark):
    def page(i):
        return f"<div id=x><div class=box>Our site says hello</div><div class=body1><p>text {i} of its own {i * i}</p><p>again</p></div><div>{['left', 'right'][i % 2]} column</div></div>"

    rows = [(i, f"http://s.net/{i}", page(i)) for i in range(20)] + [(100, "http://one.net/", page(3)), (101, None, None), (0, "http://s.net/0", page(0))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(with_clashes(spark.createDataFrame(rows, PAGES))).collect()}
    assert all(got[i] == f"text {i} of its own {i * i}\n\nagain" for i in range(20))
    assert got[100] == "Our site says hello\n\ntext 3 of its own 9\n\nagain\n\nright column" and got[101] == ""
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_site_tree_acts_in_and_beside_articles(spark):
    def page(i):
        return f"<html><body><article class=card><p>card</p></article><article><div class=x/y>Our site says hello</div><p>text {i} of its own</p></article><div>body {i * i} of a card</div></body></html>"

    rows = [(i, f"http://s.net/{i}", page(i)) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"text {i} of its own\n\nbody {i * i} of a card" for i in range(20))


def test_copies_of_pages_are_not_boilerplate(spark):
    def page(i):
        return f"<html><body><div class=box>Our site says hello</div><div class=c><p>text {i} of its own</p></div></body></html>"

    rows = [(i, f"http://s.net/{i}", page(i if i < 20 else 0)) for i in range(120)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"text {i if i < 20 else 0} of its own" for i in range(120))


def brute_tree(rows):
    """Importance of each (host, path) by the definition, over the different pages of each host."""
    seen = defaultdict(lambda: ([], []))
    for host, page in sorted({(h, p or "") for h, p in rows}):
        here = defaultdict(lambda: ([], []))
        for path, style, _, text in html_extract.blocks(page):
            here[path][0].append(style)
            here[path][1].append(text)
        for path, both in here.items():
            for kind, x in enumerate(both):
                seen[host, path][kind].append(tuple(x))

    def entropy(x):
        m = len(x)
        return -sum(c / m * math.log(c / m) for c in Counter(x).values()) / math.log(m) if m > 1 else 1.0

    return {html_extract.node(*at): (len(both[0]), max(map(entropy, both))) for at, both in seen.items()}


def site(rnd, host, n):
    def page(i):
        parts = [f"<p>{rnd.choice(['a', 'b', f'own {i}'])}</p>", f"<div class=box>{rnd.choice(['same', 'other'])} <b>x</b></div>", "<div class=note>note</div>", f"<nav>{i}</nav>"]
        body = f"<article><h1>t {i}</h1>{''.join(rnd.sample(parts, 3))}</article><div>beside {rnd.choice(['one', i])}</div>"
        return f"<html><body>{body if rnd.random() < 0.8 else ''.join(parts)}</body></html>"

    pages = [page(i) for i in range(n)]
    return [(f"http://{host}/{i}", rnd.choice(pages[: 1 + n // 2]) if rnd.random() < 0.4 else x) for i, x in enumerate(pages)]


def test_site_tree_is_the_brute_force_one(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(k, *x) for k, x in enumerate(x for host, n in (("a.net", 40), ("b.net", 7), ("c.net", 1), ("d.net", 2)) for x in site(rnd, host, n))]
    pages = spark.createDataFrame(rows, PAGES)
    found = html_extract.parsed(pages.withColumn("host", url_filter.host_of(F.col("url"))))
    got = {r["node"]: (r["pages"], pytest.approx(r["importance"])) for r in html_extract.site_tree(found).collect()}
    want = brute_tree([(u.split("/")[2], h) for _, u, h in rows])
    assert want == got and len(want) > 20

    def text(url, page):
        host, out = url.split("/")[2], []
        for path, _, beside, block in html_extract.blocks(page):
            number = html_extract.node(host, path)
            m, importance = want[number]
            share = np.mean([any(b for p, _, b, _ in found if p == path) for found in map(html_extract.blocks, {h for _, u, h in rows if u.split("/")[2] == host}) if any(p == path for p, *_ in found)])
            blend = ((m - 1) * importance + html_extract.PRIOR_PAGES * (1 - share)) / (m - 1 + html_extract.PRIOR_PAGES)
            if round(blend, 9) >= html_extract.LEAST_IMPORTANCE:
                out.append(block)
        return "\n\n".join(out)

    texts = {k: text(u, h) for k, u, h in rows}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == texts
    assert any(texts[k] != html_extract.main_text(h) for k, _, h in rows)
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", 0)
    extra = [(900, None, None), (None, "http://a.net/", None), (901, "u", f"<p>{LONG}</p>" * 3), (0, *rows[0][1:])]
    got = html_extract.extract(with_clashes(spark.createDataFrame(rows + extra, PAGES))).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=repr) == sorted([*texts.items(), (900, ""), (None, ""), (901, "\n\n".join([LONG] * 3)), (0, texts[0])], key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["page_id"]: r["url"] for r in got}[901] == "u"


@pytest.mark.parametrize("apart", [0, 200, 2000])
def test_verdicts_do_not_depend_on_pages_apart(spark, apart):
    chain = ["bad", *[f"d{i}" for i in range(1, 21)]]
    pages = [(0, "http://bad.com/de/x", None)] + [(i, f"http://{a}.com/x", f"<a href='http://{b}.com/y'>") for i, (b, a) in enumerate(zip(chain, chain[1:], strict=False), 1)]
    pages += [(1000 + i, f"http://apart{i}.com/de/x", None) for i in range(apart)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # a seed's distrust is damped by 0.85 a link: 0.85 ** 14 is over LEAST, 0.85 ** 15 isn't
    assert [got[i] for i in range(21)] == ["block"] * 15 + ["allow"] * 6
