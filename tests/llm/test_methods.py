"""Each method against a brute-force version, a library or held-out accuracy."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeframe.llm import byte_cnn, html_template, jaccard_join, line_dedup, multi_index, packing, pieces, quality_rules, queries, sharding, toxicity
from typeframe.llm.components import components

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    want = roots({x for p in pairs for x in p}, pairs)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    loops = {a for a, b in pairs if a == b}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= loops


# 1


def test_repeat_words(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(60))) for _ in range(150)]
    want = []
    for t in texts:
        w = t.split()
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        want.append(len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {x["doc"]: x["n_repeat_words"] for x in quality_rules.measure(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_binomial(spark):
    cases = [(0, 10), (3, 10), (5, 200), (10, 1000), (0, 1)]
    df = spark.createDataFrame(cases, "k long, n long").select(quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.02).alias("p"))
    for (k, n), x in zip(cases, df.collect(), strict=True):
        assert x["p"] == pytest.approx(sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)))


def certified(k, n, alpha, delta):
    """The upper Clopper-Pearson bound of k of n is at most alpha."""
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log(1 - alpha)
    return k <= n * alpha and sum(math.exp(term(i)) for i in range(k + 1)) <= delta


def test_rules_limit_false_rejection_together(spark):
    # Good documents with some symbols, others with some repeats: each rule alone could reject what both may not.
    n = 3000
    text = lambda i: f"word{i} " * 4 + " ".join(f"w{i}x{k}" for k in range(70)) + "#" * (6 * (i % 40) if i % 40 < 2 else 0) + (" again and once more" * 4 if i % 50 == 3 else "")
    rows = [(i, text(i), "en" if i % 2 else "rare" if i < 40 else "de") for i in range(n)]
    rows += [(n + i, text(0), "en") for i in range(400)]  # copies of one text are one trial
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(n + 400)], "doc_id long, quality int")
    m = quality_rules.measure(docs).withColumn("base_failed", F.lit(False)).withColumn("firsts", quality_rules.first_moves())
    found = {x["stratum"]: (x["n"], x["level"]) for x in quality_rules.levels(m, labels.select(F.col("doc_id").alias("doc"), F.col("quality").alias("label")), 0.02, 0.05).collect()}
    # Twenty labels of a stratum certify nothing.
    assert found["rare"] == (20, None) and found["en"][0] == 1501 and found["en"][1] is not None
    by_text = {(x["stratum"], x["body"]): min([k for k in x["firsts"] if k is not None], default=len(quality_rules.MOVES)) for x in m.collect()}
    for stratum, (total, level) in found.items():
        firsts = [k for (s, _), k in by_text.items() if s == stratum]
        assert len(firsts) == total
        passes = [certified(sum(f <= k for f in firsts), total, 0.02, 0.05 / 3) for k in range(len(quality_rules.MOVES))]
        assert level == max((k for k, p in enumerate(passes) if p), default=None)
        # The chain is a fixed sequence: nothing passes beyond what fails.
        assert passes == sorted(passes, reverse=True) and (stratum == "rare" or not all(passes))


def test_cutoffs_act_on_the_tables(spark):
    """Where labels suffice every stratum has a level, its rules reject bad documents, and the combined verdict spares good ones."""
    duckdb = pytest.importorskip("duckdb")
    c, sf = duckdb.connect(), "/root/testdata/sf0.1"
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = queries.op1_quality_rules(spark, sf)
    cur = c.execute(queries.oracle_sql()["op1_quality_rules"])
    order = [[d[0] for d in cur.description].index(k) for k in out.columns]
    rows = out.collect()
    assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in order) for r in cur.fetchall())
    good = dict(c.execute("SELECT doc_id, min(quality) FROM labels GROUP BY 1").fetchall())
    lang = dict(c.execute("SELECT doc_id, coalesce(lang, '') FROM documents").fetchall())
    seen = defaultdict(Counter)
    for x in rows:
        if x["doc_id"] in good and not x["base_failed"]:
            seen[lang[x["doc_id"]], good[x["doc_id"]]][x["n_rules_failed"] > 0] += 1
    assert all(v[True] <= 0.02 * sum(v.values()) for (_, q), v in seen.items() if q == 1)
    assert all(v[True] >= 0.5 * sum(v.values()) for (_, q), v in seen.items() if q == 0)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_line_dedup"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.queries()[name](spark, SF)
    cur = c.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(k) for k in out.columns]
    assert Counter(map(tuple, out.collect())) == Counter(tuple(r[i] for i in order) for r in cur.fetchall())


# 2


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x500), 0x3042, 0x1F600, 9, 10, 0x2028])) for _ in range(200)) for _ in range(60)]
    texts += [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert packing.byte_bpe_ids(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a<|endoftext|>b", "Zoë  <|endoftext|>  \n x <|endoftext|><|endoftext|>", "<|endoftext| >", ""]
    assert packing.byte_bpe_ids(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert packing.byte_bpe_ids(texts[:1]) == [[50256]]


@pytest.mark.parametrize("window", [1, 7, 16])
def test_pack_against_one_stream(spark, window):
    texts = [(i, "x" * (i % 5)) for i in range(40)]
    encode = lambda ts: [[ord(c) for c in t] for t in ts]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), window=window, encode=encode).collect()
    stream = {}
    for x in rows:
        ids = np.frombuffer(x["ids"], "<u4").tolist()
        assert len(ids) == x["length"] and x["offset"] + x["length"] <= window
        for k, v in enumerate(ids):
            stream[x["sequence_id"] * window + x["offset"] + k] = (x["doc_id"], x["start"] + k, v)
    assert sorted(stream) == list(range(sum(len(t) + 1 for _, t in texts)))
    by = defaultdict(list)
    for k in sorted(stream):
        by[stream[k][0]].append(stream[k][1:])
    assert all([v for _, v in sorted(by[i])] == [*map(ord, t), 1] for i, t in texts)


# 3


def test_pieces_are_the_librarys(spark):
    c = pieces.codec(pieces.default_model())
    texts = ["", " ", "  a  b ", "▁x", "\x00a\n\tb", "Zoë 日本語 \U0001f600", "<s>é</s>"] + [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(30).collect()]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        spans, raw = c.spans(t, ids), t.encode()
        assert ids == c.processor.encode(t) and len(spans) == len(ids)
        if len(ids):
            assert spans[0, 0] == 0 and spans[-1, 1] == len(raw) and (spans[1:, 0] == spans[:-1, 1]).all()
            for i, (a, b) in zip(ids, spans, strict=True):
                piece = c.processor.id_to_piece(i)
                if not c.processor.is_byte(i):
                    assert raw[a:b].decode().replace(" ", "▁") == piece or a == 0


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_charsmap(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    except Exception:
        pytest.skip("the library has no such rule")
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    n = spec.normalizer_spec
    own = pieces.Normaliser(pieces.charsmap_entries(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)
    r = random.Random(2)
    texts = ["Ｈｅｌｌｏ　ｗｏｒｌｄ①", "ﬁn ㍿ ﾊﾟ", "  two  blanks ", "é é Å ℃", "​zero﻿"]
    texts += ["".join(chr(r.choice([32, 65, 0xFF21, 0x2460, 0xFB01, 0x3000, 0x0301, 0x41, 0x130, 0x33A5])) for _ in range(25)) for _ in range(40)]
    for t in texts:
        got, source = own(t.encode())
        want = library.normalize(t)
        assert got.decode() == want, t
        assert len(source) == len(got) + 1 and (np.diff(source) >= 0).all()


@pytest.mark.parametrize("fallback", [True, False])
def test_spans_through_a_character_map(tmp_path, fallback):
    """The public vocabulary under a compiled map: ids and source spans are the library's, unknown pieces included."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        spec.ParseFromString(f.read())
    rule = sentencepiece_model_pb2.ModelProto()
    rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    spec.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = True
    if not fallback:
        spec.trainer_spec.byte_fallback = False
        for p in spec.pieces:
            p.type = p.UNUSED if p.type == p.BYTE else p.type
    path = tmp_path / "map.model"
    path.write_bytes(spec.SerializeToString())
    c = pieces.Codec(str(path))
    assert c.normalise.entries
    r = random.Random(7)
    texts = ["Ｈｅｌｌｏ　ｗｏｒｌｄ①", "ﬁn ㍿ ﾊﾟ  x", "  two  blanks ", "é é Å ℃", "a\u200bb\ufeff"]
    texts += ["".join(chr(r.choice([32, 65, 98, 0xFF21, 0x2460, 0xFB01, 0x3000, 0x41, 0x130, 0x33A5, 0x3042])) for _ in range(25)) for _ in range(60)]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        proto = c.processor.encode(t, return_type="proto")
        spans = c.spans(t, ids).tolist()
        assert ids == [p.id for p in proto.pieces] and len(spans) == len(ids)
        # The library gives a character's bytes to its last byte piece; here each has its own.
        plain = [(s, [p.begin, p.end]) for s, p in zip(spans, proto.pieces, strict=True) if not c.processor.is_byte(p.id)]
        assert [a for a, _ in plain] == [b for _, b in plain], t


# 4


def test_shards(spark):
    r = random.Random(4)
    texts = [f"t{r.randrange(500)}" for _ in range(1200)] + ["hot"] * 700
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=8).collect()
    sizes = Counter(x["shard"] for x in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == len(texts)
    at = defaultdict(set)
    for x in rows:
        at[texts[x["doc_id"]]].add(x["shard"])
        assert x["size"] == len(texts[x["doc_id"]]) + 16 and x["text_crc32"] == zlib.crc32(texts[x["doc_id"]].encode())
    # The hot text exceeds a shard's quota and is cut; nearly every other group is whole.
    assert len(at.pop("hot")) <= 8
    assert sum(len(s) > 1 for s in at.values()) <= 0.02 * len(at)


def test_shards_keep_large_groups_together(spark):
    # A third of all rows share a text, a half come in pairs, and the rest are alone.
    texts = ["hot" if i % 3 == 0 else f"pair{i // 6}-{i % 3}" if i % 4 < 3 else f"t{i}" for i in range(8000)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert set(Counter(x["shard"] for x in rows).values()) == {200}
    at = defaultdict(set)
    for x in rows:
        at[texts[x["doc_id"]]].add(x["shard"])
    assert len(at.pop("hot")) == math.ceil(texts.count("hot") / 200)
    assert all(len(s) == 1 for s in at.values())


def test_shards_when_all_rows_are_linked(spark):
    texts = [f"t{i // 2}" for i in range(4000)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert set(Counter(x["shard"] for x in rows).values()) == {100}
    at = defaultdict(set)
    for x in rows:
        at[texts[x["doc_id"]]].add(x["shard"])
    # At most a cut at either end of a shard.
    assert sum(len(s) > 1 for s in at.values()) <= 80


# 5


def brute_jaccard(texts, size, threshold):
    sets = []
    for t in texts:
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) * threshold.denominator >= threshold.numerator * len(sets[i] | sets[j])]
    found = roots(range(len(texts)), pairs)
    return {i: (len(s), found[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "threshold"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2)), (2, Fraction(1))])
def test_jaccard(spark, size, threshold, monkeypatch):
    # Small bounds, so that Spark parts, reduces and blocks regions as it does large ones.
    for name, bound in (("LEAF", 4), ("TASK_SETS", 24), ("TASK_ROWS", 16), ("BLOCK", 8)):
        monkeypatch.setattr(jaccard_join, name, bound)
    r = random.Random(size)
    texts = []
    for _ in range(40):
        words = [r.choice("the of and to in is it be as at".split()) + str(r.randrange(30)) for _ in range(r.choice([1, 3, 8, 40, 150]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            texts.append(" ".join(w if r.random() > 0.02 else "X" for w in words))
    one = [f"w{i}" for i in range(120)]
    for _ in range(80):  # a region larger than a leaf, near and far from its origin
        rate = r.choice([0.0, 0.01, 0.03, 0.1])
        texts.append(" ".join(w if r.random() > rate else f"y{r.randrange(99)}" for w in one))
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=size, threshold=threshold).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_jaccard(texts, size, threshold)


@pytest.mark.parametrize("seed", range(12))
def test_regions_are_joined_exactly(seed):
    r = random.Random(seed)
    threshold, sets = r.choice([Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)]), []
    for _ in range(r.choice([2, 5, 30])):
        base = r.sample(range(3000), r.choice([3, 20, 150]))
        for _ in range(r.choice([1, 2, 20, 40])):
            rate = r.choice([0, 0.01, 0.04, 0.1])
            sets.append({x if r.random() > rate else r.randrange(10**6) for x in base})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * threshold.denominator >= threshold.numerator * len(sets[i] | sets[j])]
    want = roots(range(len(sets)), links)
    got = jaccard_join.linked_stars(np.arange(len(sets)), [np.asarray(sorted(s), "i8") for s in sets], threshold, r.choice([2, 4, 16]))
    assert {a: b for a, b, _ in got} == {i: c for i, c in want.items() if i != c}


def test_pivots_find_links(spark):
    """The method's own part, on the tables: regions are measured against pivots and parted."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    source = docs.select(F.col("doc_id").alias("doc"), jaccard_join.shingles(F.col("text"), 3).alias("s"))
    digests = jaccard_join.materialise(jaccard_join._digests(source, Fraction(9, 10)), "test-sets")
    reps = digests.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"))
    sets = jaccard_join.region_sets(docs, digests, reps, id_col="doc_id", text_col="text", size=3)
    links = jaccard_join.region_links(sets, Fraction(9, 10)).collect()
    assert len(links) > 10 and all(x["by_pivot"] for x in links)


# 6


def test_extract():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=x>One</a></ul></nav><div class="cookie-notice">Accept</div><!-- gone <p>gone</p> -->
    <main><h1>Head &amp; tail</h1><p>First <b>bo</b>ld &#233;&nbsp;x<br>next <p>Second<ul><li>a<li>b</ul><form>Mail <input></form><aside>Side</aside>
    <div class="ad">Buy</div><div id="comments">Nice!</div><p hidden>no</p></main><footer>&copy; us</footer></body></html>"""
    assert html_template.extract(html_template.parse(page)) == "Head & tail First bold é x next Second a b"
    for odd in ("", "<", "<p", "a<b", "</p></p>x", "<script>never", "<p a='<b>'>t</p>", "&#xZZ; &bogus;", "<!-- open"):
        html_template.extract(html_template.parse(odd))


@pytest.mark.parametrize(
    "page",
    [
        '<body class="post has-sidebar sidebar"><article>{}</article></body>',
        '<body><div id="page" class="no-sidebar">{}</div></body>',
        '<body><article class="post header-image">{}</article></body>',
        '<body><main class="search-page search">{}</main></body>',
        '<body><section class="legal-analysis">{}</section></body>',
        '<body><div class="sidebar"><div class="share">x</div><article>{}</article></div></body>',
        "<body><form><nav>n</nav><article>{}</article></form></body>",
    ],
)
def test_marks_of_a_page_are_not_furniture(page):
    text = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>"
    assert html_template.extract(html_template.parse(page.format(text))) == "Let x=2 be"


@pytest.mark.parametrize("mark", ["sidebar", "site-header", "ad-slot-2", "cookie_notice", "nav-bar", "related-posts", "post-comments", "share-buttons"])
def test_compounds_of_marks_are_furniture(mark):
    page = f'<body><article><p>Own</p><div class="x {mark}">y</div></article><div id="{mark}"><article>Text of a card</article></div></body>'
    assert html_template.extract(html_template.parse(page)) == "Own"


def test_template_drops_what_pages_share(spark):
    page = lambda i: f"<html><body><div><span>Brand</span></div><div><p>Story {i}</p><p>Part {i * 7}</p></div><div><i>Bye</i></div></body></html>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(8)] + [(99, "http://lone/", page(99))]
    got = {x["page_id"]: x["text"] for x in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 Part 21"
    assert got[99] == "Brand Story 99 Part 693 Bye"


def test_article_text_stays_when_pages_repeat(spark):
    rows = [(i, f"http://h/{i}", "<body><nav>n</nav><article><p>Same text</p></article></body>") for i in range(6)]
    assert {x["text"] for x in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same text"}


def test_copies_of_a_page_are_no_template(spark):
    copy = "<html><body><div><h1>One story</h1><p>Told once</p></div></body></html>"
    rows = [(i, "http://h/x", copy) for i in (0, 1, 2, 2)] + [(4, "http://h/y", "<html><body><p>Other</p></body></html>"), (5, "http://h/z", "<html><body><p>Third</p></body></html>")]
    got = {x["page_id"]: x["text"] for x in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "One story Told once", 1: "One story Told once", 2: "One story Told once", 4: "Other", 5: "Third"}


def test_template_inside_and_beside_articles(spark):
    own = lambda i: f"<h1>Story {i}</h1><p>A text of its own, number {i * 7}</p>"
    kinds = {
        "inside": lambda i: f"<body><article>{own(i)}<div>Read more here</div></article></body>",
        "teaser": lambda i: f"<body><div>{own(i)}</div><div><article><b>Teaser {i}</b></article></div><i>Bye</i></body>",
        "near": lambda i: f"<body><article><h1>Same story</h1><p>The same text everywhere</p></article><i>{i}</i></body>",
    }
    rows = [(i, f"http://{k}/", f"<html>{page(i)}</html>") for k, page in kinds.items() for i in range(6)]
    got = html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id = 2").collect()
    assert {x["url"]: x["text"] for x in got} == {
        "http://inside/": "Story 2 A text of its own, number 14",
        "http://teaser/": "Story 2 A text of its own, number 14 Teaser 2",
        "http://near/": "Same story The same text everywhere",
    }


def brute_template(pages):
    """The definition: classes of equal occurrence vectors that are frequent, large, ordered and nested in the root's gaps."""
    vectors = defaultdict(lambda: [0] * len(pages))
    for i, tokens in enumerate(pages):
        for t in tokens:
            vectors[t][i] += 1
    classes = defaultdict(set)
    for t, v in vectors.items():
        if sum(map(bool, v)) >= max(html_template.MIN_PAGES, html_template.MIN_SHARE * len(pages)):
            classes[tuple(v)].add(t)
    classes = {v: c for v, c in classes.items() if len(c) >= html_template.MIN_TOKENS}
    if not classes:
        return set()
    most = max((sum(map(bool, v)), len(c)) for v, c in classes.items())
    top = [v for v, c in classes.items() if (sum(map(bool, v)), len(c)) == most]
    assert len(top) == 1
    found = set()
    for v, c in classes.items():
        orders, gaps = set(), set()
        for tokens in pages:
            own = [t for t in tokens if t in c]
            if own:
                orders.add(tuple(own))
                gaps |= {0} if v == top[0] else {sum(t in classes[top[0]] for t in tokens[:k]) for k, t in enumerate(tokens) if t in c}
        if len(orders) == 1 and len(gaps) == 1:
            found |= c
    return found


def test_templates_against_the_definition(spark):
    host = lambda u: re.match(r"[a-z]+://([^/?#:]*)", u)[1]
    r = random.Random(9)
    part = lambda i, k: f"<div><h2>Part {k}</h2><p>own {i} {k}</p><i>end {k}</i></div>"
    rows = []
    for i in range(12):  # one host whose two parts change places: neither is ordered beside the other
        parts = [part(i, 1), part(i, 2)]
        r.shuffle(parts)
        rows.append((i, "http://made/", f"<html><body><b>Top</b><em>Menu</em><section>{''.join(parts)}</section><u>Foot</u></body></html>"))
    rows += [(100 + x["page_id"], x["url"], x["html"]) for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    by = defaultdict(dict)
    for _, u, h in rows:
        by[host(u)][h] = [n.token for n in html_template.parse(h).nodes]
    want = {h: t for h, pages in by.items() if (t := brute_template(list(pages.values())))}
    df = spark.createDataFrame([(host(u), h) for _, u, h in rows], "name string, html string").distinct()
    named = {x["host"]: x["name"] for x in df.select("name", F.xxhash64("name").alias("host")).distinct().collect()}
    got = html_template.deduce(df.select(F.xxhash64("name").alias("host"), F.xxhash64("html").alias("body"), "html")).collect()
    assert {named[x["host"]]: set(x["template"]) for x in got} == want
    assert len(want) > 10 and all(x["main"] is not None for x in got if named[x["host"]] != "made")


def test_template_finds_articles_without_marks(spark):
    """Pages stripped of every mark: the template finds the article, and without it the furniture comes too."""
    plain = [(r"<(/?)(?:article|nav|footer|header|aside|main|form)\b[^>]*>", r"<\1div>"), (r' (?:class|id|role)="[^"]*"', "")]
    rows = []
    for x in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        h = x["html"]
        for old, new in plain:
            h = re.sub(old, new, h)
        rows.append((x["page_id"], x["url"], h, html_template.extract(html_template.parse(x["html"]))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {x["page_id"]: x["text"] for x in html_template.main_text(df).collect()}
    found = sum(got[i] == want for i, _, _, want in rows) / len(rows)
    bare = sum(html_template.extract(html_template.parse(h)) == want for _, _, h, want in rows) / len(rows)
    assert found > 0.9 and bare < 0.1, (found, bare)


# 7


def brute_vectors(x, threshold):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= threshold
    np.fill_diagonal(hit, False)
    return hit.sum(1), roots(range(len(x)), list(zip(*np.nonzero(hit), strict=True)))


@pytest.mark.parametrize("target", [1.0, 0.999])
def test_vectors(spark, target, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "VISITORS", 24)
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 16))
    x = np.concatenate([x, x[:20] + r.normal(scale=0.1, size=(20, 16)), x[:1] + r.normal(scale=0.07, size=(80, 16)), np.repeat(x[:1], 30, 0)])
    links, found = brute_vectors(x, 0.95)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {a["vec_id"]: a for a in multi_index.near_duplicates(df, target_recall=target, codes=8).collect()}
    total = sum(a["n_links"] for a in got.values())
    assert all(got[i]["n_links"] <= links[i] for i in got)
    assert total == links.sum() if target == 1 else total >= 0.9 * links.sum()
    if target == 1:
        assert all(got[i]["component_id"] == found[i] and got[i]["kept"] == (found[i] == i) for i in got)


def test_a_tile_is_visited_if_one_of_its_cells_is():
    r = np.random.default_rng(4)
    books = [multi_index.codebook(r.normal(size=(200, 4)), 20, seed) for seed in (1, 2)]
    tiles = [multi_index.tiled(b) for b in books]
    assert all(len(t) == len(b) and multi_index.TILES <= len(set(t.tolist())) < len(b) for t, b in zip(tiles, books, strict=True))
    x = r.normal(size=(30, 8))
    bounds = [multi_index.bounds(x[:, :4], books[0]), multi_index.bounds(x[:, 4:], books[1])]
    low = [multi_index.least(b, t) for b, t in zip(bounds, tiles, strict=True)]
    seen = [set(multi_index.visited(p, q, 0.5)) for p, q in zip(*low, strict=True)]
    assert seen == [{(int(tiles[0][i]), int(tiles[1][j])) for i, j in multi_index.visited(p, q, 0.5)} for p, q in zip(*bounds, strict=True)]
    assert any(len(s) < len(set(tiles[0])) * len(set(tiles[1])) for s in seen)


def test_multi_sequence_order():
    r = np.random.default_rng(2)
    a, b = r.random(7), r.random(9)
    cells = multi_index.visited(a, b, 0.9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells)
    assert set(cells) == {(i, j) for i in range(7) for j in range(9) if a[i] + b[j] <= 0.9}


# 8


def test_templates(spark):
    rows = [(i, f"Story {i} words of its own number {i * 31}\nFiled by agent {'abcdef'[i % 6]}x{'pqrstu'[i // 2 % 6]}y on page {i} of the log\nAll rights reserved.") for i in range(12)]
    rows += [(100 + i, "A copied text\nwith two lines") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(df).collect()}
    assert all("rights" not in got[i] and "agent" not in got[i] for i in range(12))
    assert all(got[100 + i] == "A copied text\nwith two lines" for i in range(9))
    first = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(df, keep_first=True).collect()}
    assert "rights" in first[0] and "rights" not in first[1]


@pytest.mark.parametrize("words", [4, 5, 6, 7])
def test_lines_that_share_only_their_opening_stay(spark, words):
    tail = lambda i: " ".join(f"{'abcdefghijkl'[i]}{k}z".translate({48 + k: None}) + "qwertyuiop"[k] for k in range(words - 3))
    rows = [(i, f"He said that {tail(i)}\nA text of number {i}") for i in range(12)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].startswith(f"He said that {tail(i)}") for i in range(12))


# 9 and 10


def labelled(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("y", F.col(name))


@pytest.mark.parametrize(("score", "name", "folds", "fold", "least"), [(byte_cnn.score_quality, "quality", 3, 1, 0.93), (toxicity.score_toxicity, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, score, name, folds, fold, least):
    docs, labels = labelled(spark, name)
    rows = score(docs, labels).join(labels.select("doc_id", "y"), "doc_id").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % folds == fold) for x in rows)
    held = [x for x in rows if x["held_out"]]
    assert len(held) > 50 and sum(x["predicted"] == x["y"] for x in held) / len(held) >= least


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = labelled(spark, "quality")
    flipped = labels.withColumn("quality", F.when(byte_cnn.held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.limit(50)
    scores = [{x["doc_id"]: x["score"] for x in byte_cnn.score_quality(few, y, limit=60).collect()} for y in (labels, flipped)]
    assert scores[0] == scores[1]


def test_gradient():
    texts = ["abc " * 90, "zzz " * 10, "x"]
    m = byte_cnn.Model.fresh(1)
    parts = [byte_cnn.chunks_of(t) for t in texts]
    n = np.asarray([len(p) for p in parts])
    y, w = np.asarray([1, 0, 1], "f4"), np.ones(3, "f4")

    def loss():
        p = m.score(texts)
        return -float((w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    g = byte_cnn._gradient(m, np.concatenate(parts), np.cumsum(n) - n, n, y, w)
    for name, at in (("out", (3,)), ("conv", (2, 1, 5)), ("bias", (4,))):
        v = getattr(m, name)
        kept, step = v[at], 1e-2
        v[at] = kept + step
        up = loss()
        v[at] = kept - step
        down = loss()
        v[at] = kept
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_offending_sentences(spark):
    r = random.Random(6)
    clean = lambda: " ".join(r.choice("a calm day in the green park by lake".split()) for _ in range(8)).capitalize() + "."
    texts = [" ".join([clean(), *(["You vile grub."] if i % 2 else []), clean()]) for i in range(200)]
    m = toxicity.fit(texts, np.asarray([i % 2 for i in range(200)]))
    score, spans = m.score(texts[1])
    assert score > 0.9 and [texts[1][a:b].strip() for a, b, _ in spans] == ["You vile grub."]
    assert m.score(texts[0])[0] < 0.1 and m.score(None) == (0.0, [])
    assert m.score("İ vile İ. You vile grub.")[1]


# The pipeline


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py")), reason="the pipeline can be absent")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, reached = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        reached[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    texts = [x["text"] for x in sorted(reached["line_dedup"], key=lambda x: x["doc_id"])]
    names = sorted(x["doc_id"] for x in reached["line_dedup"])
    found = brute_jaccard(texts, 5, Fraction(4, 5))
    assert sorted(x["doc_id"] for x in reached["near_duplicates"]) == [names[i] for i, (_, c) in found.items() if c == i]
    assert {x["doc_id"] for x in reached["packing"]} == {x["doc_id"] for x in reached["near_duplicates"]}
    kept = Counter()
    for x in reached["packing"]:
        kept[x["doc_id"]] += x["length"]
    by = {x["doc_id"]: x["text"] for x in reached["near_duplicates"]}
    assert all(kept[i] == len(packing.byte_bpe_ids([t])[0]) + 1 for i, t in by.items())


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py")), reason="the pipeline can be absent")
def test_pipeline_stages_on_odd_documents(spark, odd_docs, no_docs):
    """Each stage by itself on nulls, empty and long texts, repeats and clashing columns, and on no rows."""
    import corpus_pipeline

    known = {(i, t) for i, t in TEXTS}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd_docs, SF)
        rows = out.collect()
        if name == "packing":
            assert {x["doc_id"] for x in rows} == {i for i, _ in TEXTS} and all(x["length"] > 0 for x in rows)
        else:
            assert out.columns == odd_docs.columns
            assert name == "line_dedup" or {(x["doc_id"], x["text"]) for x in rows} <= known
        if name == "toxicity":
            assert len(rows) == len(TEXTS)
        if name == "near_duplicates":
            assert Counter(x["doc_id"] for x in rows) == Counter({None: 2, 1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 10: 1, 11: 1})
        assert step(spark, no_docs, SF).count() == 0
