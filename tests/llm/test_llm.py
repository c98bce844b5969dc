"""The operators on small frames with nulls, empty and repeated rows, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import bpe, contamination, htmltext, licenses, linededup, minhash, quality, queries, repeats, sharding, tokencounts
from marketloom.llm.anchors import gram_hashes, winnow
from marketloom.llm.components import components
from marketloom.llm.cuckoo import CuckooFilter
from marketloom.llm.suffixes import common_prefixes, suffix_array
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"word{i}" for i in range(120))
LINE = "This line is long enough to be a key"
TEXTS = [
    (1, PROSE),
    (2, PROSE + " and one more"),
    (3, PROSE),
    (3, PROSE),
    (None, "Ünïcode ÉTÉ 12% of it's <|endoftext|> don't\x00\x85 x"),
    (5, None),
    (6, ""),
    (7, "  \n\t\n"),
    (8, "one"),
    (9, f"{LINE}\nfoo\n  {LINE.upper()}\t\nfoo"),
    (10, f"{LINE}\nbar"),
    (11, f"{LINE}\nbaz " + "tail " * 50),
    (12, "Thhaen " * 400),
    (13, "a b a b a b c " + "### " * 100),
]
SCHEMA = "doc_id long, text string, n_words string, quality int, node string, h1 int, __extra double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "n", 2, 0.5) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_quality(spark, docs, empty):
    def base(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {x for x, n in Counter(tri).items() if n > 1}
        hit = {k for i, x in enumerate(tri) if x in often for k in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    got = quality.judge(docs.select("doc_id", "text", "n_words", "quality")).select("doc_id", "quality.*")
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((i, *base(t)) for i, t in TEXTS)
    assert not any(r.kept for r in got.collect() if r.base_failed)
    assert quality.judge(empty.select("doc_id", "text")).count() == 0
    # Two clear kinds: the fit tells them apart.
    many = spark.createDataFrame([(i, PROSE + f" {i}") for i in range(60)] + [(100 + i, " ".join(f"w{i}x{k}***" for k in range(90))) for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in quality.judge(many).where("quality.kept").collect()} == set(range(60))


def test_held_out_quality(spark):
    """Posterior against labels at a small scale: nearly all documents of both kinds are judged alike."""
    found = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").where("NOT base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = found.join(labels, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right")).first()
    assert r.right > 0.97


def test_sharding(spark, docs, empty):
    got = sharding.histogram_sort(docs, shards=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.histogram_sort(empty).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = [r.b for r in sharding.histogram_sort(hot).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 20


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    spec = queries.vocabulary_json()
    t = Tokenizer.from_str(spec)

    def expected(x):
        ids = t.encode(x or "", add_special_tokens=False).ids
        return tuple(ids), t.decode(ids, skip_special_tokens=False)

    got = bpe.encode_decode(docs, spec)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == Counter((i, *expected(x)) for i, x in TEXTS)
    assert bpe.encode_decode(empty, spec).count() == 0
    assert bpe.encode_decode(docs.where("doc_id = 6"), spec).first().decoded == ""


def test_bpe_words_of_all_characters():
    from tokenizers import Tokenizer

    spec = queries.vocabulary_json()
    t, w, rng = Tokenizer.from_str(spec), bpe.Words(spec), np.random.default_rng(3)
    pool = [chr(c) for c in range(0x250)] + list("ΣσςİıǰӜ한가 　﻿½’") + ["<|startoftext|>", "'s", "'LL", "\n"]
    for _ in range(3000):
        x = "".join(rng.choice(pool, rng.integers(0, 14)))
        assert [i for own in w.ids(w.of(x)) for i in own] == t.encode(x, add_special_tokens=False).ids


def brute_lines(texts, min_docs=3):
    keys = defaultdict(list)
    split = [(i, [(x, lower(x.strip(" \t\n\x0b\x0c\r"))) for x in (t or "").split("\n")]) for i, t in texts]
    for i, lines in split:
        for k in {k for _, k in lines if len(k) >= 20}:
            keys[k].append(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in keys.items() if len(v) >= min_docs}
    return Counter((i, "\n".join(x for x, k in lines if k not in keeper or keeper[k] == i), len(lines)) for i, lines in split)


def test_line_dedup(spark, docs, empty):
    got = linededup.dedup_lines(docs)
    assert got.columns[:-1] == docs.columns
    assert rows(got.select("doc_id", "text", "line_dedup.n_lines"), "doc_id", "text", "n_lines") == brute_lines(TEXTS)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_store_is_reversible(spark):
    line = lambda k: f"a shared line with number {k} in it"
    texts = [(i, "\n".join([line(i % 3), line(i % 5), f"own {i}"])) for i in range(30)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    store = linededup.LineStore.of(frame(texts[:10])).insert(frame(texts[10:]))
    done = lambda s, part: rows(s.dedup(frame(part)).select("doc_id", "text", "line_dedup.n_lines"), "doc_id", "text", "n_lines")
    assert done(store, texts) == brute_lines(texts)
    gone = {i for i, _ in texts if i % 3 == 1 or i > 25}
    left = [x for x in texts if x[0] not in gone]
    store = store.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert done(store, left) == brute_lines(left)
    assert done(store.insert(frame([x for x in texts if x[0] in gone])), texts) == brute_lines(texts)


def test_cuckoo():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    f = CuckooFilter.sized(4000)  # more keys than places: the rest overflows
    f.insert(keys)
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(-(2**62), 2**62, 20000)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(f"WORD{i}" for i in range(20, 50))), (2, "one"), (2, "nowhere to be found"), (3, None), (None, "bar"), (10, "b a b")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def expected(t):
        w, hit, found = word.findall(lower(t)), set(), set()
        for r in items.collect():
            x = word.findall(lower(r.text))
            n = min(13, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found |= {r.item_id} - {None}
        return len(w), len(hit), tuple(sorted(found))

    index = contamination.build_index(docs)
    for size in (contamination.BLOCK_WORDS, 10):  # one block, several blocks
        contamination.BLOCK_WORDS, was = size, contamination.BLOCK_WORDS
        got = contamination.matches(index, items)
        contamination.BLOCK_WORDS = was
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()) == Counter((i, *expected(t)) for i, t in TEXTS)
    near = contamination.matches(index, spark.createDataFrame([(1, "word40 word36 word38")], "item_id long, text string"), within=5)
    assert {r.doc_id for r in near.where("n_hit > 0").collect()} == {1, 2, 3}
    assert contamination.matches(contamination.build_index(empty), items).count() == 0
    assert contamination.matches(index, items.limit(0)).where("n_hit > 0").count() == 0


def shingles(t, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_minhash(spark, docs, empty):
    rng = np.random.default_rng(5)
    near = []
    for k in range(40):  # variants of one text, some linked through others only
        w = PROSE.split()
        for j in rng.choice(120, rng.integers(1, 9), replace=False):
            w[j] = f"new{k}{j}"
        near.append((100 + k, " ".join(w)))
    texts = TEXTS + near
    sets = [(i, shingles(t)) for i, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, len(s), least.get(find(k)) if s else i, i == (least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(minhash.near_duplicates(frame), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(empty).count() == 0


def test_second_round_finds_links_that_stars_miss(spark):
    """Blocks of one bucket: every link between components, none inside, over several pairs of blocks."""
    texts = [" ".join(f"w{j}" for j in range(40)) + f" end{i % 4}" for i in range(12)]
    sets = minhash.shingle_sets([t.encode() for t in texts], 2)
    sig = minhash.minima_of(sets).astype(np.uint16)
    data = [(0, 7, 2, (i, 0), (i, 0), [1] * minhash.BANDS, sig[:, i].tobytes(), sets[i].tobytes()) for i in range(12)]
    node = "struct<c1:long,c2:long>"
    mixed = spark.createDataFrame(data, f"band int, key long, blocks long, node {node}, root {node}, bands array<long>, sig binary, set binary")
    found = minhash._meetings(minhash._blocks(mixed), 80, f"a {node}, b {node}")
    got = Counter(frozenset((r.a.c1, r.b.c1)) for r in found.collect())
    assert got == Counter(frozenset((a, b)) for a in range(12) for b in range(a))


def test_margin_misses_less_than_the_banding():
    from math import ceil, comb

    n = minhash.MINIMA
    for least in (int((0.8 - minhash.MARGIN) * n), ceil((0.8 - minhash.MARGIN) * n)):  # in the star round and in the second
        missed = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
        assert missed < (1 - 0.8**minhash.ROWS) ** minhash.BANDS


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for k in range(200):
        d = rng.integers(97, 98 + k % 3, rng.integers(0, 90)).astype(np.uint8)
        d = np.tile(d, 3) if k % 4 == 0 else d
        b = d.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(d).tolist() == order
        prefix = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert common_prefixes(d, np.array(order, np.int64)).tolist()[1:] == [prefix(b[i:], b[j:]) for i, j in zip(order, order[1:], strict=False)]


def test_marks():
    d = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint8)
    h = gram_hashes(d, 20)
    assert (h[5] == h).sum() == sum(d[5:25].tobytes() == d[i : i + 20].tobytes() for i in range(2981))
    p = winnow(h, 30)
    assert np.diff(p).max() <= 30 and p[0] < 30


@pytest.mark.parametrize("block", [2_500_000, 900])
def test_repeats(spark, docs, empty, block):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(str(x) for x in rng.integers(0, 10**6, n))
    shared, texts = word(90), list(TEXTS)
    texts += [(200 + k, word(30) + " é" + shared[20 * k : 20 * k + 420] + word(20)) for k in range(8)] + [(300, shared + shared), (301, "x" * 1000)]
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))

    def expected(b):
        spans = []
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 400
                else:
                    spans.append([k, k + 400])
        edges = [0, *(x for s in spans for x in s), len(b)]
        left = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
        return len(b), tuple(map(tuple, spans)), hashlib.sha256(left).hexdigest()

    got = repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), block_bytes=block)
    assert Counter((r.doc_id, r.n_bytes, tuple((s.a, s.b) for s in r.spans), r.kept_sha256) for r in got.collect()) == Counter((i, *expected(b)) for i, b in data)
    assert repeats.remove_repeats(empty).count() == 0


def test_html(spark):
    page = (
        '<html><head><title>T</title><script>"</p>"</script></head><body><div id="top-menu"><a href=x>Menu</a></div><div class="cookie notice">We use cookies, accept.</div>'
        "<div class=story><h2>Head &amp; line</h2><p>First  part,\n with <b>bold</b> words. Caf&eacute;.<p>Second one, short.<ul><li>Item a</li><li>Item b</li></ul></div>"
        '<div class="comments"><p>Nice, thanks. Really.</p></div><form>Mail <input></form><footer>&copy; us</footer></body></html>'
    )
    text = "Head & line\n\nFirst part, with bold words. Café.\n\nSecond one, short.\n\nItem a\n\nItem b"
    frame = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, None), (2, None, "", ""), (3, "v", "plain &lt;text&gt;", "x"), (4, "v", "<p>a<p>b<!-- c", "x")], "page_id long, url string, html string, text string")
    got = htmltext.extract(frame)
    assert rows(got, "page_id", "text") == Counter([(1, text), (2, ""), (2, ""), (3, "plain <text>"), (4, "a\n\nb")])
    assert htmltext.extract(frame.limit(0)).count() == 0
    long = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    assert htmltext.main_text(long) == "deep, text."


def test_html_of_the_given_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert htmltext.main_text(r.html) == "\n\n".join(x for x in blocks if x)


def test_html_container_is_the_whole_article():
    body = "".join(f"<p>Paragraph {i} of the body, long enough to hold most of the text, as bodies do.</p>" for i in range(20))
    rows_ = "".join(f"<tr><td>Cell {i}, with a long sentence in it, and more of it.</td></tr>" for i in range(40))
    lines = [f"Paragraph {i} of the body, long enough to hold most of the text, as bodies do." for i in range(20)]
    cells = [f"Cell {i}, with a long sentence in it, and more of it." for i in range(40)]
    for around in ("article", "main", "div"):
        page = f"<html><body><div id=x1><a href=/>Home</a></div><{around}><h1>Title</h1><p>lead</p><div class='body'>{body}</div></{around}></body></html>"
        assert htmltext.main_text(page).split("\n\n") == ["Title", "lead", *lines]
        page = f"<body><{around}><h1>Title</h1><p>before</p><table>{rows_}</table><p>after</p></{around}></body>"
        assert htmltext.main_text(page).split("\n\n") == ["Title", "before", *cells, "after"]


def test_html_marks_are_whole_words_and_overruled_by_content():
    body = "".join(f"<p>Paragraph {i} of the page, with text.</p>" for i in range(9))
    text = "\n\n".join(f"Paragraph {i} of the page, with text." for i in range(9))
    for wrapper in ("div class='content with-sidebar'", "div id=page class=no-sidebar", "div class='content sidebar'", "div class=widget", "form action='/p?id=search'"):
        assert htmltext.main_text(f"<body><{wrapper}>{body}</{wrapper.split()[0]}></body>") == text
    inner = "<h2 id='related-work'>Work</h2><section id='social-impact'><p>Impact, too.</p></section><p>Now <span class='share-price'>12</span> <a href='/hidden-valley'>x</a> <a title='a hidden gem'>y</a> <a href='/p?id=search'>z</a> <a href=/p?id=search>w</a> <i data-id=ad>v</i>.</p>"
    assert htmltext.main_text(f"<article>{body}{inner}</article>") == text + "\n\nWork\n\nImpact, too.\n\nNow 12 x y z w v."
    aside = "<div class='x ad'>Buy, now.</div><div id=site_footer>Us, only.</div><p hidden>a, b.</p><p aria-hidden='true'>c, d.</p><div class=comments>" + body[:180] + "</div><form>Mail, please.</form>"
    assert htmltext.main_text(f"<body><div>{body}{aside}</div></body>") == text


def test_html_paths_choose_inside_the_article():
    lines = [f"Paragraph {i} of the article, long enough to be chosen by its ratios, as it has marks, too." for i in range(8)]
    body = "".join(f"<p>{x}</p>" for x in lines)
    boxes = "<div class=tools><a href=/t>Tweet this</a> <a href=/m>Mail, now.</a></div><div class=offer77>Buy shoes</div><section class=more><ul><li><a href=/x>Read. This.</a></li></ul></section>"
    short = "<header class=top><div>By me</div></header><p>So.</p><h2>Part</h2><div class=row><p>Short one.</p></div><div class=scroll><table><tr><td>1</td><td>2</td></tr></table></div><section class=impact><h3>Impact</h3></section>"
    for around in ("article", "main"):
        got = htmltext.main_text(f"<body><{around}><h1>Title</h1>{body}{boxes}{short}{body}</{around}></body>")
        assert got.split("\n\n") == ["Title", *lines, "By me", "So.", "Part", "Short one.", "1", "2", "Impact", *lines]


def test_html_raw_elements_end():
    assert htmltext.main_text("<html><head><title>T</title><style>a</style><meta name=x><body><p>One, two.<p>Three.") == "One, two.\n\nThree."
    assert htmltext.main_text("<head><title>T</title><script>x()</script><p>One, two.") == "One, two."
    for empty in ("<svg class=i viewBox='0 0 1 1'/>", "<math/>", "<svg><path d='M0'/><title>t</title><text>no</text></svg>", "<svg><g><text>no</text></svg>"):
        assert htmltext.main_text(f"<article><p>One, {empty} two.</p><p>Three.</p></article>") == "One, two.\n\nThree."
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x=1</annotation></semantics></math>"
    assert htmltext.main_text(f"<article><p>So {formula}, here.</p></article>") == "So x=1, here."


def test_token_counts(spark, docs, empty):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    encoding, _ = tokencounts._encoding(ranks, P.PATTERN)
    got = tokencounts.section_tokens(docs, ranks, P.PATTERN)
    assert rows(got, "doc_id", "n_tokens") == Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t in TEXTS)
    for r in got.collect():
        assert sum(s.n_tokens for s in r.sections) == r.n_tokens
    given = spark.createDataFrame([(1, "é!!!!\n\n\n\nab cd", [(0, 3), (3, 7), (7, 14)]), (2, None, None)], "doc_id long, text string, s array<struct<start:long,stop:long>>")
    pieces = [encoding.decode_single_token_bytes(i) for i in encoding.encode_ordinary("é!!!!\n\n\n\nab cd")]
    for rule in tokencounts.RULES:
        want, at = Counter(), 0
        cuts = [(0, 4), (4, 8), (8, 15)]  # the same sections in bytes
        for p in pieces:
            held = [max(0, min(at + len(p), b) - max(at, a)) for a, b in cuts]
            want[held.index(max(held)) if rule == "most" else next(k for k, (a, b) in enumerate(cuts) if a <= at < b)] += 1
            at += len(p)
        r = {x.doc_id: x for x in tokencounts.section_tokens(given, ranks, P.PATTERN, rule, "s").collect()}
        assert [s.n_tokens for s in r[1].sections] == [want[k] for k in range(3)] and r[2].sections == []
    assert tokencounts.section_tokens(empty, ranks, P.PATTERN).count() == 0


def test_licenses(spark, docs, empty):
    texts = [(1, "x\nReleased under the MIT License.\ny"), (1, "Released under the MIT License."), (2, "License: ask us first"), (3, None), (None, "Licensed under CC BY-SA 4.0."), (4, licenses.TEMPLATES["MIT grant"] + " today")]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(got, "doc_id", "line", "license", "confirmed") == Counter([(1, 1, "MIT", True), (1, 0, "MIT", True), (None, 0, "CC-BY-SA-4.0", True), (4, 0, "MIT grant", True)] + [(2, 0, r.license, False) for r in got.where("doc_id = 2").collect()])
    assert got.where("doc_id = 4").first().added == ["today"]
    assert got.where("doc_id = 2").count() == 1 and licenses.scan(empty).count() == 0


def test_licenses_over_lines_and_inside_them(spark):
    import textwrap

    T = licenses.TEMPLATES
    wrap = lambda name, lead: "\n".join(lead + x for x in textwrap.wrap(T[name], 60, break_on_hyphens=False))
    prose = "some words of prose about nothing " * 60
    texts = [
        (1, "x y\n\n" + wrap("MIT grant", "// ") + "\n\nmore"),
        (2, wrap("GPL-3.0 notice", " * ") + "\n" + wrap("Apache-2.0 notice", "# ")),
        (3, "(c) 2024 X. Licensed under CC BY 4.0."),
        (4, "Available under CC BY-SA 4.0."),
        (5, prose + "Released under the MIT License. " + prose),
        (6, "This work is licensed under the GNU General Public License, version 2."),
        (7, "This work is licensed under the GNU General Public License, version 1."),
        (8, "  " + wrap("BSD", "  ").replace("permitted", "allowed")),
        (9, "a license\nb\nc license " + prose),
        (10, "We redistribute\nthis free\nsoftware"),
    ]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"))
    found = rows(got.where("confirmed"), "doc_id", "line", "license")
    want = [(1, 2, "MIT grant"), (2, 0, "GPL-3.0 notice"), (2, 5, "Apache-2.0 notice"), (3, 0, "CC-BY-4.0"), (4, 0, "CC-BY-SA-4.0 mention"), (5, 0, "MIT"), (6, 0, "GPL-2.0"), (8, 0, "BSD")]
    assert found == Counter(want)
    assert rows(got.where("not confirmed"), "doc_id", "line") == Counter([(7, 0), (9, 0), (9, 2)])
    for name, wording in T.items():  # each wording is found as itself, also in prose
        for text in (wording, wrap(name, "# "), prose + wording + " " + prose):
            assert [(x[2], x[-1]) for x in licenses._Scanner(T, 0.1).scan(text)] == [(name, True)], (name, text)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    status, note, *_ = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert status in ("ok", "rows-only") and not note.startswith("0 rows"), note


def test_pipeline(spark):
    """The stages one by one against plain Python."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in queries.op3_quality_rules(spark, SF).where("kept").collect()}
    data = {i: t for i, t in data.items() if i in kept}
    data = {i: t for i, t, _ in brute_lines(list(data.items()))}
    sets, comp = {i: shingles(t, corpus_pipeline.WORDS) for i, t in data.items()}, {i: i for i in data}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    data = {i: t for i, t in data.items() if comp[i] == i}
    frame = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    found = contamination.matches(contamination.build_index(frame), spark.read.parquet(f"{SF}/benchmark.parquet"))
    gone = {r.doc_id for r in found.where(contamination.contaminated()).collect()}
    t = Tokenizer.from_str(queries.vocabulary_json())
    want = Counter()
    for i, x in data.items():
        if i not in gone:
            own = t.encode(x, add_special_tokens=False).ids
            want[(i, len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())] += 1
    assert rows(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "ids_sha256") == want
    mid = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert mid.columns == docs.columns and mid.where("n_chars <> length(text)").count() == 0
