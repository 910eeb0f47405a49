import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import decontaminate, fingerprints, html_text, langid, minhash, packing, pii, quality, secrets, toxicity

DOCS = "doc_id long, text string, source string, n_chars long, node string, row long"


def docs_of(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 1, "x", 7) for i, t in enumerate(texts)], DOCS)


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(r.randrange(40)) for _ in range(n))


EDGE = [None, "", " ", "a", "x" * 5000, "é😀 ", prose(1), prose(1)]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_best_two_fit_is_whole_and_tight():
    r = random.Random(0)
    hist = {}
    for _ in range(3000):
        n = r.randrange(1, 1025)
        hist[n] = hist.get(n, 0) + 1
    bins = packing.best_two_fit(hist, 1024)
    used = {}
    for pattern, k in bins:
        assert sum(n * c for n, c in pattern) <= 1024
        for n, c in pattern:
            used[n] = used.get(n, 0) + c * k
    assert used == hist
    assert sum(k for _, k in bins) <= 1.02 * sum(n * c for n, c in hist.items()) / 1024 + 1
    # The shortest of 6 + 3 makes room for 2 + 2 in a bin of 10.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0] == [(6, 1), (2, 2)]


def test_pack_gives_the_tokenizer_s_ids(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    texts = [*EDGE, "a <|endoftext|> b", "don't  stop\n\n now²", prose(2, 3000)]
    encode = packing.Encoder(tokenizer)
    for text in filter(None, texts):
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    rows = packing.pack(docs_of(spark, texts), tokenizer).toPandas()
    assert rows.groupby("doc_id").length.sum().tolist() == [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts]
    rows = rows.sort_values(["sequence_id", "offset"])
    by = rows.groupby("sequence_id").length
    assert (rows.offset == by.cumsum() - rows.length).all() and by.sum().max() <= 1024
    assert packing.pack(docs_of(spark, []), tokenizer).count() == 0


def test_language(spark):
    en, de = "the cat and the dog with this thing " * 3, "der hund und die katze mit schönen dingen " * 3
    docs = spark.createDataFrame([(i, (en, de)[i % 2] + str(i), ("en", "de")[i % 2], False) for i in range(20)] + [(50, None, "en", True), (51, "12 34", "en", True)], "doc_id long, text string, lang string, held_out boolean")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit_profiles(docs, F.col("lang"))).collect()}
    assert all(got[i] == ("en", "de")[i % 2] for i in range(20)) and got[50] == got[51] == "und"
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_fingerprints(spark):
    texts = [*EDGE, "One. Two.\nThree", "Three\nTwo.\nOne."]
    rows = {r.doc_id: r for r in fingerprints.compare_with_edit(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        k = len(t) // 3
        assert rows[i].edited == t[: len(t) - k] + nxt[:k]
    assert rows[8].print == rows[9].print != rows[7].print and rows[6].print == rows[7].print
    got = spark.range(1).select(
        fingerprints.insert(fingerprints.fingerprint(F.lit("a\nb")), F.lit("c")).alias("x"),
        fingerprints.fingerprint(F.lit("c\nb\na")).alias("y"),
        fingerprints.delete(fingerprints.fingerprint(F.lit("c\nb\na")), F.lit("c")).alias("z"),
        fingerprints.fingerprint(F.lit("b\na")).alias("w"),
    ).first()
    assert got.x == got.y and got.z == got.w


def multiset(text):
    return sorted(p for p in re.split(r"\n|(?<=[.!?]) ", text or "") if p)


def test_fingerprints_are_equal_where_the_multisets_are_and_as_alike(spark):
    r = random.Random(4)
    lines = [prose(i, 6) + "." for i in range(60)]
    texts = [*EDGE]
    for k in range(60):
        own = [lines[r.randrange(len(lines))] for _ in range(r.randrange(1, 50))]
        texts += ["\n".join(own), " ".join(own[::-1]), "\n".join([*own[: len(own) // 2], *(f"new {k} {i}" for i in range(len(own) // 2))])]
    docs = docs_of(spark, texts)
    got = {x.doc_id: x for x in fingerprints.compare_with_edit(docs).select("doc_id", "edited", "print", "edited_print", fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("edit"), fingerprints.likeness(F.col("print"), F.col("next_print")).alias("next")).collect()}
    assert len(got) == len(texts)
    of = {}
    for i, t in enumerate(texts):
        of.setdefault(tuple(multiset(t)), set()).add(tuple(got[i].print))
        of.setdefault(tuple(multiset(got[i].edited)), set()).add(tuple(got[i].edited_print))
    assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)

    def alike(a, b):
        a, b = ({p: m.count(p) for p in m} for m in (multiset(a), multiset(b)))
        size = sum(n * n for n in [*a.values(), *b.values()])
        return 2 * sum(n * b.get(p, 0) for p, n in a.items()) / size if size else float(a == b)

    off = [got[i].next - (1.0 if multiset(t) == multiset(texts[i - 1]) else alike(t, texts[i - 1])) for i, t in enumerate(texts)]
    off += [got[i].edit - alike(t, got[i].edited) for i, t in enumerate(texts) if multiset(t)]
    assert np.abs(off).max() < 0.3 and np.sqrt(np.mean(np.square(off))) < 0.09
    # Every word of the vector hangs on a hash of its own: no two are a function of each other's hash.
    one = spark.range(1).select(*(F.xxhash64(F.lit(i), F.lit("paragraph")).alias(f"h{i}") for i in range(2)), fingerprints.fingerprint(F.lit("paragraph")).alias("p")).first()
    assert [one.h0 & (2**62 - 1), one.h1 & (2**62 - 1)] == one.p[:2]


def test_fingerprints_of_an_id_that_a_third_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SHARD_ROWS", 8)
    ids = [None] * 80 + [7] * 80 + list(range(-20, 60))
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]]), reverse=True)
    want = {order[k]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    got = fingerprints.with_next(df).select("doc_id", "text", "next_text", F.spark_partition_id().alias("p")).collect()
    assert {(r.doc_id, r.text): r.next_text for r in got} == want and len(got) == len(rows)


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.compare_with_edit(docs_of(spark, [])).count() == 0
    rows = [(None, "a. b."), (None, "c"), (1, "a. b."), (1, "a. b."), (1, None), (-5, "x" * 300_000)]
    got = fingerprints.compare_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(x[0]) for x in rows)
    assert all(len(x.edited) == x.n_chars or x.n_chars >= 3 for x in got)
    one = fingerprints.compare_with_edit(docs_of(spark, ["abcdef"])).first()
    assert one.edited == "abcdab" and one.print == one.next_print


def contaminated(texts, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for k, item in enumerate(items):
            v = words(item)
            n = min(width, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    ids.add(str(k))
        out.append((len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10**6 if broadcast else 0)
    items = [prose(9, 30), "Short item É", "a a a", "", None, prose(9, 30)]
    texts = [*EDGE, prose(3) + " " + prose(9, 30).upper() + " " + prose(4), "x short ITEM É y", "short item é", "a a a a a"]
    got = decontaminate.report(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == dict(enumerate(contaminated(texts, items)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_removes_exactly_the_contaminated_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10**6 if broadcast else 0)
    item = prose(9, 30)
    rows = [(None, item), (None, "clean one"), (1, item), (1, "clean two"), (1, "clean two"), (2, None), (3, "x " + item)]
    kept = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))


def test_html(spark):
    nav = "<nav><a>Home</a></nav>"
    pages = [
        (1, "http://h/a/1", f"<html><body>{nav}<div>Shared line</div><p>Own &amp; one</p><div class='ad'>Buy</div></body>"),
        (2, "http://h/a/2", f"<html><body>{nav}<div>Shared line</div><p>Own two<br>more</p><footer>f</footer>"),
        (3, "http://h/a/3", "<article><h1>T</h1><p>Shared  line</p><script>x='</p>'</script></article>"),
        (4, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[3] == "T Shared line" and got[4] == ""
    assert "Own & one" in got[1] and "Buy" not in got[1] and "Home" not in got[1] and "Own two more" in got[2]
    one = html_text.lines_of(pages[0][2])
    assert html_text.main_text(one, html_text.lines_of(pages[1][2])) == "Own & one"
    assert html_text.common(list("abcbdab"), list("bdcaba")) and len(html_text.common(list("abcbdab"), list("bdcaba"))) == 4


def longest(one, other):
    row = [0] * (len(other) + 1)
    for x in one:
        new = [0]
        for j, y in enumerate(other):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def common_by_hand(one, other):
    """Equal beginnings and ends, and of the rest the first places of all longest common subsequences."""
    begin = end = 0
    while begin < min(len(one), len(other)) and one[begin] == other[begin]:
        begin += 1
    while end < min(len(one), len(other)) - begin and one[-1 - end] == other[-1 - end]:
        end += 1
    x, y = one[begin : len(one) - end], other[begin : len(other) - end]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    found, j = {*range(begin), *range(len(one) - end, len(one))}, 0
    for i, line in enumerate(x):
        k = next((k for k in range(j, len(y)) if y[k] == line), None)
        if k is not None and best[i + 1][k + 1] + 1 == best[i][j]:
            found.add(begin + i)
            j = k + 1
    return found


def test_common_lines_are_a_longest_common_subsequence():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(600):
        one, other = ([r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(30))] for _ in range(2))
        found = sorted(html_text.common(one, other))
        at = iter(other)
        assert len(found) == longest(one, other) and all(one[i] in at for i in found)
        assert set(found) == common_by_hand(one, other)
    for _ in range(300):  # of those without equal ends the first in order, of all subsets
        one, other = ([r.choice("abc") for _ in range(6)] for _ in range(2))
        if one[0] == other[0] or one[-1] == other[-1]:
            continue
        fits = lambda places: (lambda at: all(one[i] in at for i in places))(iter(other))  # noqa: B023, E731
        want = min(p for p in combinations(range(6), longest(one, other)) if fits(p))
        assert tuple(sorted(html_text.common(one, other))) == want


def test_pages_that_name_no_article(spark):
    page = lambda body: f"<html><body>{body}</body></html>"
    text = lambda body: html_text.main_text(html_text.lines_of(page(body)), None)
    assert text('<div id="related-work"><p>Real body text</p></div><div><p>Other</p></div>') == "Real body text Other"
    assert text('<div class="search-methods"><p>How</p></div><div class="site-footer">f</div><div id="comments">c</div><div class="post ad">b</div>') == "How"
    assert text('<article><p>A</p></article><div class="related-work">B</div>') == "A"


def test_extraction_is_that_of_brute_force_where_no_article_is_named(spark):
    r = random.Random(12)
    pages = []
    for i in range(160):
        host, section = r.choice("ab"), r.choice(["news", "blog/x", "blog/y", ""])
        lines = [f"{section} top", *r.sample(["alpha", "beta", "gamma", "delta"], 3), f"own {i % 40}", *r.choices(["x", "y", f"own {i} b"], k=3), f"{host} end"]
        url = f"http://{host}.org/{section}/{i % 70}?q={i}" if i % 31 else None
        pages.append((i, url, "<body>" + "".join(f"<div class='row-{i % 3}'>{x}</div>" for x in lines) if i % 41 else None))

    def parts(url):
        m = re.match(r"[a-z]+://([^/?#]*)([^?#]*)", url or "")
        return (m[1], m[2]) if m else ("", "")

    rows = [(*parts(u), i, [x for x, _, _ in html_text.lines_of(h or "")]) for i, u, h in pages]
    order = sorted(rows, key=lambda x: x[:3])
    shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    want = {}
    for k, (host, path, i, lines) in enumerate(order):
        near = [x for x in (order[k - 1 : k] if k else []) + order[k + 1 : k + 2] if x[0] == host and x[3] != lines]
        best = max(near, key=lambda x: shared(x[1], path), default=None)
        gone = common_by_hand(lines, best[3]) if best else set()
        want[i] = " ".join([x for n, x in enumerate(lines) if n not in gone] or lines)
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_html_takes_time_in_proportion_to_the_page():
    import time

    def seconds(f, *args):
        begin = time.perf_counter()
        f(*args)
        return time.perf_counter() - begin

    assert seconds(html_text.lines_of, "<a " * 200_000) < 5 and seconds(html_text.lines_of, '<a "' * 200_001 + ">x") < 5
    many = ["x", "y"] * 5000
    assert seconds(html_text.common, [*many, "a", *many], ["b", *many, *many]) < 20


def test_html_tags_without_end():
    text = lambda page: [x[0] for x in html_text.lines_of(page)]
    assert text("<p>one <a href='x>two</a> three<p>four") == ["one two three", "four"]
    assert text("<p>1 <b and a<c") == ["1 <b and a<c"] and text("<p>a > b <") == ["a > b <"] and text("<p>x<a title='>'>y</a>") == ["xy"]


def test_html_differencing_decides_outside_articles(spark):
    page = lambda i, body: (i, f"http://h/a/{i}", f"<body><div>Site name</div><div><p>{body}</p></div><article class='comment'><p>Nice {i}</p></article><article><p>Teaser</p></article><div>Imprint</div>")
    pages = [page(1, "Body one"), page(2, "Body two"), page(3, "Body three"), (4, "http://h/a/3?again", page(3, "Body three")[2])]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)).collect()}
    alone = "Site name Body {} Teaser Imprint"  # what a page without a neighbour has
    lines = [html_text.lines_of(p[2]) for p in pages]
    assert html_text.main_text(lines[0], lines[1]) == "Body one Teaser" and html_text.main_text(lines[0], None) == alone.format("one")
    assert all(f"Body {n} Teaser" in got[i] and "Nice" not in got[i] for i, n in ((1, "one"), (2, "two"), (3, "three"), (4, "three")))


def test_html_rows_do_not_change_with_the_ranges(spark):
    pages = [(i if i != 7 else None, f"http://h{i // 20}/{'ab'[i // 6 % 2]}/{i:02}", f"<body><div>Site</div><div>Part {i // 6 % 2}</div><p>Own {i}</p><div>End</div>") for i in range(24)]
    pages += [pages[3], (50, None, "<p>Alone"), (51, "http://H0/", None), (52, "http://only/x", "<p>One <div>Two")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = sorted([(p[1], f"Own {i}") for i, p in enumerate(pages[:24])] + [(pages[3][1], "Own 3"), ("", "Alone"), ("http://H0/", ""), ("http://only/x", "One Two")])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 2, 4, 13, 60):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted((r.url or "", r.text) for r in html_text.extract(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert html_text.extract(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h2 id='related-work'>Related</h2><section id='search-methods'>A</section><div class='article-header'><h1>T</h1></div><div class='x share'>S</div></article>", "Related A T"),
        ("<h1 class='page-header'>T</h1><p class=notice>N<p>A<p>B", "T A B"),
        ("<article><p class=notice>N<p>A<div>B</div></article><p>C", "A B C"),
        ("<article><ul><li class=ad>N<ul><li>M</ul>K<li>A</ul><ul><li class=ad>N</ul><p>B", "A B"),
        ("<main><div><div class=ad>N<p>M</div><p>A</div><section><aside>N</section>B<dl><dt class=ad>N<dd>C</dl></main>", "A B C"),
        ("<table><tr><td class=ad>N<table><tr><td>M</td></tr></table></div>K<td>A<tr><td>B</table>C", "A B C"),
        ("<article><p>A</p></p><nav>N<nav>M</nav>K</nav></div>B</article><article class='comment'>N<article>M</article>K</article>C", "A B C"),
    ],
)
def test_html_parts_end_where_they_end(page, want):
    assert html_text.main_text(html_text.lines_of(page), None) == want


def test_secrets(spark):
    key = "AKIA" + "A1" * 8
    texts = [*EDGE, f"token = 'abcdefghijkl' {key} {'0f' * 10}", "PassWord:short secret=token=abcdefghijklm", "ſecret=abcdefghijklmn"]
    docs = docs_of(spark, texts)
    ledger = secrets.scan(docs).cache()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.findings(docs, ledger).collect()}
    assert got[8] == [("assign", 0, 21), ("access", 23, 43), ("hex", 44, 64)] and got[9] == [("assign", 15, 41)] and got[10] == [] and got[0] == []
    assert secrets.scan(docs, ledger).count() == 0  # nothing unseen
    assert secrets.scan(docs, ledger, {**secrets.RULES, "hex": "2"}).count() == len({t or "" for t in texts})
    masked = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert masked[8] == "[secret]' [secret] [secret]" and masked[0] is None and masked[6] == texts[6]


def secrets_by_hand(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def test_base_secrets_are_those_of_brute_force(spark):
    r = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "ſecret", "=", ": ", " : ", "'", '"', "0123456789abcdef", "AKIA", "ABCD1234EFGH5678", "abcdefghijkl", "é", " ", "\n", "AKIAAKIA", "00", "-", "x" * 40]
    texts = [*EDGE, *("".join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(400))]
    got = {x.doc_id: [tuple(s) for s in x.spans if s.kind in secrets.BASE] for x in secrets.scan_documents(docs_of(spark, texts)).collect()}
    assert got == {i: secrets_by_hand(t) for i, t in enumerate(texts)}


def test_the_ledger_of_a_folder_grows_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    old, new = docs_of(spark, [*EDGE, "token=abcdefghijklmn"]), docs_of(spark, ["token=abcdefghijklmn", "0123456789abcdef0", None])
    first = secrets.scan_documents(old, path).collect()
    n = spark.read.parquet(path).count()
    assert n == len(secrets.RULES) * len({t or "" for t in [*EDGE, "x"]})
    assert secrets.scan(old, spark.read.parquet(path)).count() == 0 and sorted(map(str, secrets.scan_documents(old, path).collect())) == sorted(map(str, first))
    assert spark.read.parquet(path).count() == n
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_documents(new, path).collect()}
    assert got == {0: [("assign", 0, 20)], 1: [("hex", 0, 17)], 2: []} and spark.read.parquet(path).count() == n + len(secrets.RULES)
    assert secrets.mask(new, ledger_path=path).count() == 3 and spark.read.parquet(path).count() == n + len(secrets.RULES)


def test_mask_keeps_columns_of_any_name(spark):
    names = ["text", "doc_id", "spans", "blob", "salt", "Found_Spans", "own_text", "bad_text", "own_node", "class_node", "class_doc", "rule"]
    docs = spark.createDataFrame([("token=abcdefghijklmn", 1, *"abcdefghij"), (None, None, *"abcdefghij"), ("x y", 2, *"abcdefghij"), ("x y", 2, *"abcdefghij")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = secrets.mask(docs)
    assert got.schema == docs.schema and sorted(str(r.text) for r in got.collect()) == ["None", "[secret]", "x y", "x y"]
    items = spark.createDataFrame([(0, "x y")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items)
    assert got.schema == docs.schema and sorted(str(r.doc_id) for r in got.collect()) == ["1", "None"]
    got = minhash.keep_one(docs)
    assert got.schema == docs.schema and sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]
    assert secrets.mask(docs.where("false")).count() == secrets.scan_documents(docs.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, items.where("false")).count() == 4 and decontaminate.decontaminate(docs.where("false"), items).count() == 0


def test_pem_spans_cover_the_key(spark):
    begin, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["MIIEpAIBAAKCAQEA+/" * 3] * 4) + "\nQUJD=="
    texts = [f"a\n{begin}\n{body}\n{end}\nb", f"a {begin}\n{body}\nplain words follow", f"{begin}\n{body}\n{begin}\n{body}\n{end} c", f"about {begin} lines"]
    assert {r.doc_id: r.text for r in secrets.mask(docs_of(spark, texts)).collect()} == {0: "a\n[secret]\nb", 1: "a [secret]\nplain words follow", 2: "[secret]\n[secret] c", 3: "about [secret] lines"}


def test_pii(spark):
    texts = [*EDGE, "a@b.c_d@e.f 1.2.3.4.5 999.1.1.1 x 4111-1111 1111 1111 x +1 (542) 555-3599", "1" * 4000, "+12 ..@x @@a@b.c"]
    texts += [f"user id is {i}-77{i}@m.example.org ok" for i in range(4)] + ["user id is zz99x88 ok"]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs_of(spark, texts)).collect()}
    assert got[8] == [("email", 0, 5), ("email", 5, 11), ("ip", 12, 19), ("card", 34, 53), ("phone", 56, 73)]
    assert got[9] == [] and got[10] == [("email", 11, 16)] and got[0] == []
    assert got[15] == [("context", 11, 18)]  # after a pattern that four addresses taught


def base_by_hand(text):
    """The contract's words, one kind after the other."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits(s)))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, holds) in kinds.items() for m in re.finditer(p, text or "") if holds(m[0])]


def test_pii_base_spans_are_those_of_brute_force(spark):
    r = random.Random(6)
    parts = ["4111111111111111", "4111-1111 1111 1111", "+1 (542) 555-3599", "+12", "+0 123.456.789", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "a.b+c@d-e.f", "@x.y", "a@b", "a@b.c@d.e", "0" * 19, "é😀", "12-", "\n", " ", "  ", ".", "7", "00", "(", ")", "x"]
    texts = [*EDGE, *("".join(r.choice(parts) + r.choice(["", " ", "-", "."]) for _ in range(r.randrange(1, 40))) for _ in range(300))]
    got = {x.doc_id: [tuple(s) for s in x.base] for x in docs_of(spark, texts).select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("base")).collect()}
    assert got == {i: base_by_hand(t) for i, t in enumerate(texts)}


def test_pii_takes_time_in_proportion_to_the_text(spark):
    import time

    begin = time.perf_counter()
    text = "at 10.0.0.1 by a@b.cd or " * 48_000
    got = pii.find(docs_of(spark, [text])).first()
    assert len(got.base) == 96_000 and [tuple(s) for s in got.base[-1:]] == [("ip", len(text) - 22, len(text) - 14)] and time.perf_counter() - begin < 90


def test_pii_learns_patterns_of_three_kinds(spark):
    texts = [f"{prose(i, 3)} note mail to u{i}@ex{i}.org" for i in range(5)]  # two words before
    texts += [f"{prose(50 + i, 3)} from 10.0.{i}.{i + 2} {prose(60 + i, 2)}" for i in range(5)]  # the word before and the shape
    texts += [f"{prose(ord(w), 3)} {w} {n} issued" for w, n in zip("abcd", ("4111111111111111", "6011000990139424", "4012888888881881", "5555555555554444"), strict=True)]  # the shape and the word after
    texts += ["we mail to nodigits here", "hello from 999.1.1.1 there", "our 4111111111111112 issued it", "from nowhere", "x issued"]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "context"] for r in pii.find(docs_of(spark, texts)).collect()}
    n = len(texts)
    assert got[n - 5] == ["nodigits"] and got[n - 4] == ["999.1.1.1"] and got[n - 3] == ["4111111111111112"] and got[n - 2] == got[n - 1] == []


def contexts_by_hand(texts):
    """doc -> spans of kind context: every pattern with all of its edges, round by round."""
    texts = [t or "" for t in texts]
    core = lambda t: re.sub(r"[\W_]+$", "", re.sub(r"^(?:(?!\+)[\W_])+", "", t))
    letters = lambda x: re.sub(r"[^\W\d_]+", "a", x)
    shape = lambda x: re.sub(r"(?<!9)9{1,4}(?!9)", "9", re.sub("[0-9]", "9", letters(x))) if re.search("[0-9@]", x) else None
    keys = lambda a, b, s, z: [k for k in (("two", a, b), ("left", b, s), ("right", s, z)) if None not in k]
    edges, seeds, places = {}, {}, []
    for d, t in enumerate(texts):
        words = [(m[0], m.start()) for m in re.finditer(r"\S+", t)]
        at = lambda i: words[i][0].lower() if 0 <= i < len(words) else None  # noqa: B023, E731
        for i, (w, start) in enumerate(words):
            instance = core(w.lower())
            begin = start + len(w) - len(re.sub(r"^(?:(?!\+)[\W_])+", "", w))
            for k in keys(at(i - 2), at(i - 1), shape(instance) if re.search("[0-9@]", w) else None, at(i + 1)):
                edges.setdefault(k, set()).add(instance)
                places.append((k, instance, d, begin, begin + len(core(w))))
        for _, begin, end in base_by_hand(t):
            first = max((i for i, (_, s) in enumerate(words) if s <= begin), default=0)
            last = max(i for i, (_, s) in enumerate(words) if s < end)
            instance = t[begin:end].lower()
            for k in keys(at(first - 2), at(first - 1), shape(instance), at(last + 1)):
                edges.setdefault(k, set()).add(instance)
                seeds.setdefault(k, set()).add(instance)
    able = [k for k in seeds if len(seeds[k]) >= 3]
    known, accepted = {}, set()
    while True:
        score = lambda k: 1 - (1 - (len(seeds[k]) + sum(known.get(i, 0) for i in edges[k] - seeds[k])) / (len(edges[k]) + 1)) ** 4  # noqa: B023, E731
        new = {k: score(k) for k in able if k not in accepted and score(k) >= 0.5}
        if not new:
            break
        accepted |= set(new)
        found = {}
        for k, p in new.items():
            for i in edges[k] - seeds[k]:
                if i not in known and re.search("[0-9@]", i):  # a plain word says nothing of other patterns
                    found[i] = max(found.get(i, 0), p)
        known |= found
    out = {d: set() for d in range(len(texts))}
    for k, _, d, begin, end in places:
        if k in accepted and not any(b < end and begin < e for _, b, e in base_by_hand(texts[d])):
            out[d].add((begin, end))
    return {d: sorted(x) for d, x in out.items()}


def test_pii_contexts_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "PARTS", (3, 2))
    r = random.Random(11)
    words = "mail to call from id user the of card note see pay row".split()
    seed = lambda: r.choice([f"u{r.randrange(40)}@ex{r.randrange(3)}.org", f"10.0.{r.randrange(9)}.{r.randrange(9)}", f"+49 30 {r.randrange(10**6, 10**7)}", "4111 1111 1111 1111"])
    other = lambda: r.choice([f"(k{r.randrange(30)}x),", f"{r.randrange(10**5)}", "zed", "plain.", f"u{r.randrange(40)}@local"])
    texts = [" ".join(r.choices([r.choice(words), seed(), other()], [6, 2, 1])[0] for _ in range(r.randrange(1, 60))) for _ in range(120)]
    texts += [f"my account {seed()} ok" for _ in range(9)] + ["my account q7 ok", "our reference q7 is", *(f"our reference {seed()} is" for _ in range(3)), "our reference r8 is", "our reference s9 is"]
    texts += [*EDGE, "a" * 300 + " to u1@ex1.org " + "b" * 300, texts[0], texts[0]]
    got = {x.doc_id: sorted((s.start, s.end) for s in x.spans if s.kind == "context") for x in pii.find(docs_of(spark, texts)).collect()}
    want = contexts_by_hand(texts)
    assert got == want and sum(map(len, want.values())) > 20


def test_pii_reads_the_texts_equally_often_whatever_becomes_known(spark, monkeypatch):
    monkeypatch.setattr(pii, "PARTS", (1,))
    passes, posexplode = [], F.posexplode
    monkeypatch.setattr(F, "posexplode", lambda *a: passes.append(a) or posexplode(*a))
    frequent = [f"go to the s{i}@b.org" for i in range(3)] + [f"go to the {x}{y}" for x in "abcde" for y in "klmnopqr"]
    teaching = [f"in my account a{i}@b.org" for i in range(5)] + [f"{x} q{i}z" for i in range(10) for x in ("in my account", "go to the")]
    spans, times = [], []
    for texts in (frequent, frequent + teaching):
        passes.clear()
        got = {x.doc_id: sorted((s.start, s.end) for s in x.spans if s.kind == "context") for x in pii.find(docs_of(spark, texts)).collect()}
        assert got == contexts_by_hand(texts)
        spans.append(sum(map(len, got.values())))
        times.append(len(passes))
    assert spans == [0, 60] and times == [2, 2]  # ten new identifiers, in two places each, make the frequent pattern one of theirs


def test_pii_takes_words_before_a_line_end(spark):
    texts = [f"see my account{end}a{i}@b.org{end}" for i, end in enumerate(["\n", "\r\n", " \n", "\n\n"])] + ["see my account zebra77", "see my account\nlion88\n", "row\n"]
    got = {x.doc_id: sorted((s.start, s.end) for s in x.spans if s.kind == "context") for x in pii.find(docs_of(spark, texts)).collect()}
    assert got == contexts_by_hand(texts) and got[4] == [(15, 22)] and got[5] == [(15, 21)]


def test_pii_contexts_do_not_hang_on_the_rest_of_the_corpus(spark):
    texts = [f"customer account a{i}@b.org" for i in range(4)] + ["customer account zebra77", "customer account lion88", "customer account 7"]
    for others in ([], [f"{prose(i, 8)} p{i}@q.org 10.1.{i % 250}.{i // 250} {prose(i + 9000, 3)}" for i in range(2000)]):
        rows = pii.find(docs_of(spark, [*texts, *others])).where("doc_id < 7").collect()
        got = {x.doc_id: [tuple(s) for s in x.spans if s.kind == "context"] for x in rows}
        assert got == {**{i: [] for i in range(4)}, 4: [("context", 17, 24)], 5: [("context", 17, 23)], 6: [("context", 17, 18)]}


def test_pii_finds_hidden_seeds_again(spark):
    texts = [f"{prose(i, 4)} contact person user{i}x@mail{i}.org {prose(i, 3)}" for i in range(60)] + [f"{prose(i, 9)} w{i}q@other.net {prose(200 + i, 3)}" for i in range(20)]
    got = pii.rediscovery(docs_of(spark, texts)).first()
    assert got.n_hidden > 25 and got.n_found >= 0.6 * got.n_hidden and got.n_other == 0
    assert tuple(pii.rediscovery(docs_of(spark, [])).first()) == (0, 0, 0)


def test_pii_learns_from_all_seeds(spark):
    far = " \n" + "word " * 300
    texts = [f"write to {a}@example.org now" for a in ("ann", "bob", "cleo", "dan", "eve")] + ["write to zzkeyname now", far + "write  to (zzqq99xx), ok", far + "write to"]
    texts += [f"row {i} code 10.0.{i}.1 end" for i in range(3)] + [f"pair 7 10.1.{i}.1 end" for i in range(5)] + ["see pair 7 kk55kk end", "Write TO ann@example.org"]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs_of(spark, texts)).collect()}
    at = texts[6].index("zzqq")
    assert got[5] == [("context", 9, 18)] and got[6] == [("context", at, at + 8)] and got[7] == []
    assert got[0] == [("email", 9, 24)] and got[16] == [("context", 11, 17)] and got[17] == [("email", 9, 24)]


def test_toxicity_ignores_group_names():
    texts = [f"the women idiot {prose(i, 5)}" for i in range(30)] + [f"good day {prose(i, 5)}" for i in range(60)]
    labels = np.array([1.0] * 30 + [0.0] * 60)
    score = lambda m, t: m.constant + sum(toxicity._Weights(m)[w] for w in toxicity.words_of(t))
    free, tied = toxicity.train(texts, labels, penalty=0.0), toxicity.train(texts, labels, penalty=50.0)
    assert abs(score(tied, "the women meet") - score(tied, "the men meet")) < abs(score(free, "the women meet") - score(free, "the men meet")) / 2
    assert score(tied, "idiot") > 0 > score(tied, "good day")


def test_toxicity_is_fitted_and_scored_on_odd_rows(spark):
    rude = [f"you idiot {prose(i, 6)} women" for i in range(30)]
    kind = [f"good day {prose(100 + i, 6)}" for i in range(60)]
    texts = [*rude, *kind, *EDGE, "good day " * 20_000, "idiot " * 20_000, "the women meet", "the men meet"]
    docs = docs_of(spark, texts).withColumn("held_out", F.lit(True)).withColumn("score", F.lit(9)).withColumn("predicted", F.lit("x"))
    docs = docs.unionByName(docs.where("doc_id < 3"))  # repeated rows
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] + [(0, 1), (5, None), (None, 1), (90, 1), (777, 0)], "doc_id long, label int")
    models = {p: toxicity.fit_toxicity(docs, labels, penalty=p) for p in (0.0, 50.0)}
    assert all(m.n_pairs == 30 for m in models.values())
    got = toxicity.score_toxicity(docs, models[50.0])
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.toPandas()
    assert len(got) == len(texts) + 3 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    by = got.drop_duplicates().set_index("doc_id")
    n = len(texts)
    assert by.predicted[list(range(30))].all() and not by.predicted[list(range(30, 90))].any() and by.score[90] == by.score[91]
    assert by.predicted[n - 3] == 1 and by.predicted[n - 4] == 0
    gap = {p: float(abs(np.diff(toxicity.score_toxicity(docs.where(F.col("doc_id") >= n - 2), m).toPandas().sort_values("doc_id").score)[0])) for p, m in models.items()}
    assert gap[50.0] < gap[0.0] / 2
    assert toxicity.score_toxicity(docs.where("false"), models[0.0]).count() == 0
    for part, share in (("label = 1", (33 - 1) / 34), ("label = 0", 1 / 63), ("false", 1 / 3)):
        model = toxicity.fit_toxicity(docs, labels.where(part))
        assert not model.weights and abs(1 / (1 + np.exp(-model.constant)) - share) < 0.01
    assert toxicity.fit_toxicity(docs.where("false"), labels).weights == {}


def test_quality_on_odd_rows(spark):
    good, bad = [prose(i) for i in range(60)], ["%%% ### " * 30 + prose(i, 10).upper() for i in range(60)]
    texts = [*good, *bad, *EDGE, prose(1) * 500, "%%% ### " * 30_000]
    docs = docs_of(spark, texts).withColumn("score", F.lit("x")).withColumn("predicted", F.lit(9)).withColumn("label", F.lit(5))
    docs = docs.unionByName(docs.where("doc_id < 3"))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(0, 1), (5, None), (None, 1), (120, 1)], "doc_id long, label int")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert got.columns == [*docs.columns[:-3], "label", "score", "predicted"]
    got = got.toPandas()
    assert len(got) == len(texts) + 3 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by.predicted[list(range(60))].mean() > 0.9 and by.predicted[list(range(60, 120))].mean() < 0.2 and by.score[120] == by.score[121]
    assert by.predicted[len(texts) - 2] == 1 and by.predicted[len(texts) - 1] == 0
    model = quality.fit_quality(docs, labels)
    assert quality.score_quality(docs.where("false"), model).count() == 0 and quality.fit_quality(docs, labels.where("label = 1")) is None and quality.fit_quality(docs.where("false"), labels) is None
    # The score hangs on what the dictionaries do to the text alone.
    sizes = quality._Sizes(model.bad, model.good)
    assert all(abs(a + b) < 1e-9 for a, b in list(zip(quality._Sizes(model.good, model.bad).features(good[0]), sizes.features(good[0]), strict=True))[:2])


def test_language_on_odd_rows(spark):
    texts = [*EDGE, "the cat and the dog " * 3000, "der hund und die katze", "der hund und die katze", "ß", "123 !"]
    docs = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")).withColumn("held_out", F.lit(False)).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id < 3"))
    got = langid.identify(docs, langid.fit_profiles(docs, F.col("lang")))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.toPandas()
    assert len(got) == len(texts) + 3 and got.score.between(0, 1).all() and set(got.lang_pred) <= {"a", "b", "und"}
    by = got.drop_duplicates().set_index("doc_id")
    assert [i for i in range(len(texts)) if by.lang_pred[i] == "und"] == [i for i, t in enumerate(texts) if not any(c.isalpha() for c in t or "")]
    assert langid.identify(docs.where("false"), {}).count() == 0 and langid.fit_profiles(docs.where("false"), F.col("lang")) == {}


def test_toxicity_reports_its_pairs():
    labels = np.array([1.0, 0.0, 0.0])
    assert toxicity.train(["the women", "two men", "none"], labels).n_pairs == 2 and toxicity.train(["a", "b", "c"], labels).n_pairs == 0


def test_quality(spark):
    good = [(i, prose(i)) for i in range(80)]
    bad = [(100 + i, "!!$$$ ### " * 20 + prose(i, 10).upper() + " !!") for i in range(80)]
    docs = spark.createDataFrame([*good, *bad, (999, None)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("label")).where("doc_id < 999")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert np.mean([r.predicted == (r.doc_id < 100) for r in got if r.doc_id < 999]) > 0.85
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}


def test_near_duplicates(spark):
    base = prose(5, 200).split()
    near = base.copy()
    near[100] = "changed"
    far = base[:100] + prose(6, 100).split()
    texts = [" ".join(base), " ".join(near), " ".join(far), " ".join(base), "one two", "One, two!", *EDGE]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got[0] == got[1] == got[3] == 0 and got[2] == 2 and got[4] == got[5] == 4
    assert got[12] == got[13] == 12 and got[6] == got[7] == 6 and len(got) == len(texts)
    kept = minhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs.columns
    assert minhash.classes(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("order", ["up", "down", "star"])
def test_components_of_long_chains(spark, order):
    """Chains in the order of their names, which least neighbours alone would shorten by a node a round, end soon."""
    n = 3000
    name = lambda i: (i if order == "up" else n - i).to_bytes(4, "big")
    pairs = [(name(0 if order == "star" else i), name(i + 1)) for i in range(n)] + [(b"x", b"y")]
    found = minhash.components(spark.createDataFrame(pairs, "a binary, b binary")).toPandas()
    roots = found.groupby(found.root.map(bytes)).node.count().tolist()
    assert sorted(roots) == [2, n + 1]


def classes_by_hand(texts):
    sets = [minhash.shingles(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or minhash.similarity(sets[i], sets[j]) >= minhash.THRESHOLD:
                one, other = sorted((label[i], label[j]))
                label = [one if x == other else x for x in label]
    return label


@pytest.mark.parametrize(("block", "bound", "parts"), [(500_000, 200_000, 4), (700, 200_000, 13), (700, 0, 2), (1, 0, 4)])
def test_near_duplicates_leave_no_link_out_in_large_buckets(spark, monkeypatch, block, bound, parts):
    """Whatever the blocks' size and the ranges' number, the classes are those of brute force."""
    texts = []
    for g in range(4):  # texts of a group share two thirds with those of the others, and nearly all with their own
        common, own = prose(100, 200).split(), prose(200 + g, 60).split()
        for k in range(7):
            words = common + own
            for c in range(1 + k % 5):
                words[(k * 20 + 37 * c) % len(words)] = f"changed{k}"
            texts.append(" ".join(words))
    texts += [*EDGE, "one two", "One, two!", texts[3]]
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BROADCAST_BUCKETS", bound)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.doc_id: r.class_id for r in minhash.classes(docs_of(spark, texts)).collect()} == dict(enumerate(classes_by_hand(texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_piece_gives_fewer_links_than_it_has_members():
    r = random.Random(2)
    base = prose(1, 300).split()
    texts = []
    for _ in range(60):
        words = base.copy()
        for _ in range(r.randrange(8)):
            words[r.randrange(300)] = f"other{r.randrange(99)}"
        texts.append(" ".join(words) + " " + words[0] * r.randrange(2))
    sets = [minhash.shingles(t) for t in texts]
    for one_side in (True, False):
        held = [(one_side or i < 25, bytes([i]), bytes([i]), h.tobytes(), w.astype(np.int32).tobytes()) for i, (h, w) in enumerate(sets)]
        found = minhash._joining(held, one_side)
        near = [(i, j) for i in range(60) for j in range(i) if minhash.similarity(sets[i], sets[j]) >= 0.8 and (one_side or (i < 25) != (j < 25))]
        label = list(range(60))
        for i, j in near:
            one, other = sorted((label[i], label[j]))
            label = [one if x == other else x for x in label]
        assert len(found) == 60 - len(set(label)) < len(near)
        assert all((max(a[0], b[0]), min(a[0], b[0])) in near for a, b in found)


def test_near_duplicates_are_found_with_the_promised_chance():
    """Pairs about the threshold: those over it share a band."""
    over = found = 0
    for seed in range(150):
        r = random.Random(seed)
        words = prose(seed, 250).split()
        near = words.copy()
        for _ in range(r.randrange(3, 8)):
            near[r.randrange(250)] = "other"
        one, other = " ".join(words), " ".join(near)
        if 0.8 <= minhash.similarity(minhash.shingles(one), minhash.shingles(other)) < 0.88:
            over += 1
            found += any(a == b for a, b in zip(minhash._signed(one)[0], minhash._signed(other)[0], strict=True))
    assert over > 50 and found == over


def test_weighted_agreement_is_the_similarity():
    one = (np.arange(60, dtype=np.uint64), np.arange(60) % 4 + 1)
    other = (np.arange(20, 80, dtype=np.uint64), np.arange(60) % 3 + 1)
    x, y = minhash.signature(*one, 6000), minhash.signature(*other, 6000)
    assert abs((x == y).mean() - minhash.similarity(one, other)) < 0.03


def test_near_duplicates_give_no_partial_count_of_links(spark):
    """Links within a class that was joined already are not all looked for."""
    found = minhash.classes(docs_of(spark, ["one two", "One, two!"]))
    assert found.columns == ["doc_id", "class_id"] and [r.class_id for r in found.collect()] == [0, 0]


def test_a_text_that_names_both_groups_has_counterfactuals():
    terms = (("women", "men"), ("gay", "straight"))
    assert toxicity.counterfactuals({"women", "x"}, terms) == [{"men", "x"}] and toxicity.counterfactuals({"x"}, terms) == []
    assert toxicity.counterfactuals({"women", "men", "x"}, terms) == [{"women", "x"}, {"men", "x"}]
    assert {frozenset(c) for c in toxicity.counterfactuals({"women", "gay"}, terms)} == {frozenset(c) for c in (("men", "straight"), ("women", "straight"), ("men", "gay"))}
    r = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    texts, labels = [], []
    for _ in range(600):
        bad = r.random() < 0.4
        body = r.sample(words, 8) + (["vile"] if bad and r.random() < 0.6 else [])
        texts.append(" ".join(body + (["women", "men"] if r.random() < (0.6 if bad else 0.1) else ["men"] if r.random() < 0.3 else [])))
        labels.append(float(bad))
    gap = lambda m: abs(sum(m.weights.get(f, 0.0) for f in toxicity.features_of("women")) - sum(m.weights.get(f, 0.0) for f in toxicity.features_of("men")))
    free, held = (toxicity.train(texts, np.array(labels), terms, penalty=p) for p in (0.0, 4.0))
    print("gap", gap(free), gap(held), held.n_pairs)
    assert held.n_pairs > 100 and gap(held) < 0.5 * gap(free)
