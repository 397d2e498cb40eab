"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from collections import Counter
from fractions import Fraction

import pytest

from typeframe.llm import byte_cnn, html_template, jaccard_join, line_dedup, multi_index, packing, pieces, quality_rules, sharding, toxicity

from .conftest import LONG, TEXTS

IDS = Counter(i for i, _ in TEXTS)


def ids(rows, key="doc_id"):
    return Counter(r[key] for r in rows)


def test_quality_rules(odd_docs, no_docs, odd_labels):
    rows = quality_rules.quality_rules(odd_docs, odd_labels).collect()
    assert ids(rows) == IDS
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[6]["n_words"] == len(LONG.split()) and by[6]["word_chars"] == len(LONG.replace(" ", ""))
    assert quality_rules.quality_rules(no_docs, odd_labels).count() == 0
    assert ids(quality_rules.quality_rules(odd_docs, odd_labels.filter("false")).collect()) == IDS


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    whole = Counter()
    for r in rows:
        whole[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 2048
    assert set(whole) == set(IDS) and whole[3] == whole[4] == 1
    assert whole[2] == 2 * whole[1]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for s, o, n in places:
        assert s * 2048 + o == at
        at += n
    assert packing.pack(no_docs).count() == 0


def test_pieces(odd_docs, no_docs):
    rows = pieces.encode_decode(odd_docs).collect()
    assert ids(rows) == IDS
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["ids"] == by[4]["ids"] == [] and by[3]["decoded"] == ""
    assert by[6]["decoded"] == LONG and by[6]["span_end"][-1] == len(LONG)
    assert pieces.encode_decode(no_docs).count() == 0


def test_sharding(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, shards=4).collect()
    assert ids(rows) == IDS
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {16}
    assert sharding.shard_documents(no_docs).count() == 0
    few = sharding.shard_documents(odd_docs.limit(2), shards=40).collect()
    assert len(few) == 2 and len({r["shard"] for r in few}) == 2


def test_jaccard(odd_docs, no_docs):
    rows = jaccard_join.jaccard_join(odd_docs).collect()
    assert ids(rows) == IDS
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got[1] == (13, 1) and got[2] == (13, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[6][1] == got[7][1] == 6
    assert got[8] == (1, 8) and got[9] == (1, 8)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert jaccard_join.jaccard_join(no_docs, threshold=Fraction(4, 5)).count() == 0


def test_line_dedup(odd_docs, no_docs):
    out = line_dedup.line_dedup(odd_docs, min_docs=2)
    assert [c for c in odd_docs.columns if c != "n_lines"] == [c for c in out.columns if c not in ("n_lines", "n_dropped")]
    rows = out.collect()
    assert ids(rows) == IDS
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[3] is None and texts[4] == "" and texts[5] == TEXTS[5][1] and texts[6] == LONG
    assert line_dedup.line_dedup(no_docs).count() == 0


@pytest.mark.parametrize("score", [byte_cnn.score_quality, toxicity.score_toxicity])
def test_classifiers(odd_docs, no_docs, odd_labels, score):
    out = score(odd_docs, odd_labels)
    assert set(odd_docs.columns) | {"held_out", "predicted"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert ids(rows) == IDS
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert score(no_docs, odd_labels).count() == 0
    assert len(score(odd_docs, odd_labels.filter("false")).collect()) == len(TEXTS)


def test_html(spark):
    page = "<html><body><nav>Menu</nav><article><p>One <b>bold</b> text</p></article></body></html>"
    rows = [(1, "http://a/x", page), (1, "http://a/x", page), (2, None, None), (3, "http://b", ""), (None, "odd", "plain text"), (4, "http://a/y", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, page long, host string")
    out = html_template.main_text(pages).collect()
    assert ids(out, "page_id") == Counter(r[0] for r in rows)
    text = {r["page_id"]: r["text"] for r in out}
    assert text[1] == "One bold text" and text[2] == text[3] == "" and text[None] == "plain text" and len(text[4]) == 249_999
    assert html_template.main_text(pages.filter("false")).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [0.0] * 4), (4, None), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0, 0.0]), (7, [float("inf"), 1.0, 0.0, 0.0]), (8, [1.0, 0.0]), (None, [0.0, 1.0, 0.0, 0.0]), (9, [1e300, 1e298, 0.0, 0.0]), (10, [1e-300, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<double>, doc int, n string")
    out = multi_index.near_duplicates(vectors).collect()
    assert ids(out, "vec_id") == Counter(r[0] for r in rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got[1] == (4, 1) and got[10] == (4, 1) and got[9] == (4, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8))
    assert multi_index.near_duplicates(vectors.filter("false")).count() == 0
