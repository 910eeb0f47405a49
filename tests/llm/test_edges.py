"""Very long texts, repeated rows and ids, null ids and clashing columns; scores and distances computed again by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import classes_by_hand, contaminated, docs_of, prose, secrets_by_hand

from alphaloom.llm import decontaminate, fingerprints, html_text, langid, minhash, packing, quality, secrets, toxicity

LONG = [prose(21, 9000), prose(21, 9000) + " end", prose(22, 9000) + " token=abcdefghijklmn " + prose(23, 30)]


def test_long_texts(spark):
    items = [prose(23, 30), prose(9, 30)]
    docs = docs_of(spark, [*LONG, LONG[0], None])
    got = decontaminate.report(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == dict(enumerate(contaminated([*LONG, LONG[0], None], items)))
    found = {x.doc_id: [tuple(s) for s in x.spans if s.kind in secrets.BASE] for x in secrets.scan_documents(docs).collect()}
    assert found == {i: secrets_by_hand(t) for i, t in enumerate([*LONG, LONG[0], None])} and found[2]
    classes = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert [classes[i] for i in range(5)] == classes_by_hand([*LONG, LONG[0], None])


def test_repeated_rows_and_null_ids(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (None, None), (2, prose(1, 900)), (2, prose(1, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, path).collect()
    whole = Counter()
    for p in pieces:
        whole[p.doc_id] += p.length
    assert whole[1] % 2 == 0 and whole[2] % 2 == 0 and set(whole) == {1, 2, None}
    assert sum(p.piece == 0 for p in pieces) == 6
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    for a, b in zip(at, at[1:], strict=False):
        assert b[1] == (a[1] + a[2] if b[0] == a[0] else 0)
    classes = minhash.classes(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "x y"), (3, "a b c d e f"), (None, "x y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in classes) == [(0, 5), (3, 3), (5, 3), (5, 3), (5, 5)]


def test_clashing_columns(spark):
    names = ["host", "path", "key", "range", "to", "edges", "guest", "text"]
    pages = spark.createDataFrame([(1, "http://h/a", "<p>one</p>", *names), (2, "http://h/b", "<p>two</p>", *names)], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(tuple(r) for r in html_text.extract(pages).collect()) == [(1, "http://h/a", "one", 3), (2, "http://h/b", "two", 3)]
    names = ["shard", "edited", "print", "next_print", "part", "rank", "n_chars", "id", "next"]
    docs = spark.createDataFrame([(1, "abc", *names), (2, "defg", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert {r.doc_id: r.edited for r in fingerprints.compare_with_edit(docs).collect()} == {1: "abd", 2: "defa"}


def test_language_is_that_of_the_smallest_distance(spark):
    """Out-of-place distances counted anew: each of a document's n-grams costs the difference of its ranks, or the most there is."""
    texts = {"en": "the cat and the dog with this thing ", "de": "der hund und die katze mit schönen dingen ", "fr": "le chat et le chien avec cette chose "}
    rows = [(i, texts[k] * 2 + prose(i, 4), k) for i, k in enumerate(["en", "de", "fr"] * 8)]
    docs = spark.createDataFrame([(*r, False) for r in rows], "doc_id long, text string, lang string, held_out boolean")
    profiles = langid.fit_profiles(docs, F.col("lang"), size=60)

    def ranked(texts):
        n = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                n.update(w)
                n.update(f" {w} "[i : i + k] for k in (2, 3) for i in range(len(w) + 3 - k))
        code = lambda g: sum(ord(c) << langid._BITS * (len(g) - 1 - i) for i, c in enumerate(g))
        return [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))][:60]

    assert profiles == {k: ranked([t for _, t, lang in rows if lang == k]) for k in texts}
    for r in langid.identify(docs, profiles).collect():
        own = ranked([rows[r.doc_id][1]])
        far = {k: sum(abs(i - places.index(g)) if g in places else 60 for i, g in enumerate(own)) / (60 * len(own)) for k, places in profiles.items()}
        assert r.lang_pred == min(sorted(far), key=far.get) and abs(r.score - (1 - min(far.values()))) < 1e-12


def test_toxicity_scores_are_those_of_the_weights(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "vile", "women", "men"], k=12)) for _ in range(80)]
    labels = np.array([float("vile" in t) for t in texts])
    model = toxicity.train(texts, labels)
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, held_out boolean, text string")
    got = {x.doc_id: (x.score, x.predicted) for x in toxicity.score_toxicity(docs, model).collect()}
    for i, t in enumerate([*texts, "", ""]):
        z = model.constant + sum(model.weights.get(f, 0.0) for w in set(t.split()) for f in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) >= n)])
        want = 1 / (1 + math.exp(-z))
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == int(want >= 0.5)


def test_quality_scores_do_not_hang_on_the_rows_around(spark):
    r = random.Random(4)
    good, bad = "the report describes how measured results were checked twice ".split(), "click buy now free win prize cheap deal ".split()
    docs = [(i, " ".join(r.choices(good if i % 2 else bad, k=120))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit_quality(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int"))
    rows = spark.createDataFrame([(i, False, t) for i, t in docs] + [(99, True, None)], "doc_id long, held_out boolean, text string")
    whole = {x.doc_id: x.score for x in quality.score_quality(rows, model).collect()}
    alone = {x.doc_id: x.score for x in quality.score_quality(rows.where("doc_id < 6").repartition(6), model).collect()}
    assert all(abs(whole[i] - alone[i]) < 1e-9 for i in range(6)) and 0 <= whole[99] <= 1
    assert min(whole[i] for i, _ in docs if i % 2) > max(whole[i] for i, _ in docs if not i % 2)
