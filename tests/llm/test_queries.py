"""The registered queries and the pipeline over a whole small table, against plain Python."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import base_by_hand, classes_by_hand, contaminated, multiset, secrets_by_hand

import corpus_pipeline
from alphaloom.llm import html_text, pii, queries, quality, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
crc = lambda x: zlib.crc32(str(x).encode())
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
joined = lambda spans: ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


def pieces_by_hand(texts, tokenizer):
    """doc_id, piece -> start, length, crc of the ids, for (doc_id, text)."""
    import struct

    out = {}
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = ids
    return out, lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    ids, digest = pieces_by_hand(texts, Tokenizer.from_file(queries.tokenizer_path()))
    used, by = {}, {}
    for r in rows:
        assert 0 < r.length <= 1024 and r.ids_crc32 == digest(ids[r.doc_id][r.start : r.start + r.length])
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(ids)
    for i, pieces in by.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(ids[i])
        assert all(s == sum(n for _, _, n in pieces[:p]) for p, s, _ in pieces) and (len(pieces) == 1 or all(n == 1024 for _, _, n in pieces[1:]))
        assert len(pieces) == -(-len(ids[i]) // 1024)
    for places in used.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 1024
    assert len(used) <= 1.03 * sum(map(len, ids.values())) / 1024 + 1


def test_op1(spark, docs):
    check_packing(queries.op1_packing(spark, SF).collect(), [(d["doc_id"], d["text"]) for d in docs])


def test_op2_op8_op9(spark, docs):
    for name, modulus, rest in (("op2_language", 4, 2), ("op8_toxicity", 5, 0), ("op9_quality", 5, 0)):
        got = rows_of(spark, name)
        assert set(got) == {d["doc_id"] for d in docs} and all(r.held_out == (crc(i) % modulus == rest) and 0 <= r.score <= 1 for i, r in got.items())
        if name == "op2_language":
            held = [d for d in docs if got[d["doc_id"]].held_out and d["lang"] and any(c.isalpha() for c in d["text"] or "")]
            assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held) >= 0.95 * len(held)
        else:
            assert all(r.predicted == (r.score >= (0.5 if name == "op8_toxicity" else 0.3)) for r in got.values())


def test_op3(spark, docs):
    got = rows_of(spark, "op3_fingerprints")
    of = {}
    for k, d in enumerate(docs):
        text, other = d["text"] or "", docs[k - 1]["text"] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        r = got[d["doc_id"]]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(edited) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        of.setdefault(tuple(multiset(text)), set()).add(r.fingerprint)
        of.setdefault(tuple(multiset(edited)), set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)


def test_op5(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op5_html(spark, SF).collect()}
    assert set(got) == {p.page_id for p in pages}
    for p in pages:  # every page of these tables has an article, whose lines stay whatever the neighbour has
        lines = html_text.lines_of(p.html or "")
        assert got[p.page_id].text == html_text.main_text(lines, None) == " ".join(t for t, apart, main in lines if main and not apart) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_op6(spark, docs):
    got = rows_of(spark, "op6_secrets")
    for d in docs:
        want = secrets_by_hand(d["text"])
        r = got[d["doc_id"]]
        assert r.base_sha256 == sha(joined(want)) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in secrets.BASE] and set(joined(want).split(",")) <= {*r.spans.split(","), ""}


def test_op7(spark, docs):
    got = rows_of(spark, "op7_pii")
    for d in docs:
        want = base_by_hand(d["text"])
        r = got[d["doc_id"]]
        assert r.base_sha256 == sha(joined(want)) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.BASE] and r.spans.startswith(joined(want))


def test_op4_and_op10(spark, docs):
    items = [r.asDict() for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    got = rows_of(spark, "op4_decontamination")
    for d, (n, hit, ids, bad) in zip(docs, contaminated([d["text"] for d in docs], [i["text"] for i in items]), strict=True):
        r = got[d["doc_id"]]
        names = sorted(str(items[int(k)]["item_id"]) for k in ids)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (n, hit, len(ids), bad, sha(",".join(names)))
    got = rows_of(spark, "op10_near_duplicates")
    want = classes_by_hand([d["text"] for d in docs])
    assert {i: r.class_id for i, r in got.items()} == {d["doc_id"]: docs[w]["doc_id"] for d, w in zip(docs, want, strict=True)}


def test_the_pipeline(spark, docs):
    """Every stage's decision by hand, but for the score of quality, which is op9's."""
    score = {r.doc_id: r for r in quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), queries.quality_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)).collect()}
    left = [d for d in docs if score[d["doc_id"]].score >= 0.3]
    assert 0 < len(left) < len(docs)
    classes = classes_by_hand([d["text"] for d in left])
    left = [d for k, d in enumerate(left) if classes[k] == k]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [d for d, (*_, bad) in zip(left, contaminated([d["text"] for d in left], items), strict=True) if not bad]

    def masked(text):
        spans, out, at = sorted(s for rule in secrets.RULES for s in secrets.find(rule, text)), "", 0
        for i, j in spans:
            if j > at:
                out += text[at:i] + "[secret]" if i >= at else ""
                at = j
        return out + text[at:]

    check_packing(corpus_pipeline.run(spark, SF).collect(), [(d["doc_id"], masked(d["text"] or "")) for d in left])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, whole.withColumn("extra", F.lit(1)), SF)
        assert out.columns[: len(whole.columns)] == whole.columns
        assert stage(spark, whole.where("false"), SF).count() == 0
