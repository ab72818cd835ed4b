import hashlib
import importlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from faultline.llm import decontam, huffman, ibltdiff, linededup, ngramjoin, pieces, secretscan, styletree, toxchain, urltrees
from faultline.llm.bytebpe import WordCache
from faultline.llm.components import components
from faultline.llm.textscan import WORD_BYTES, span_hashes, text_buffer, word_spans
from pyspark.sql import functions as F

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = prose(1, 6000)
    base = [prose(i, 80) for i in range(2, 12)]
    near = [" ".join([*base[0].split()[:-k], *prose(100 + k, k).split()]) for k in range(1, 9)]
    lines = ["\n".join([prose(7, 20), prose(200 + i, 20), prose(8, 20)]) for i in range(4)]
    rows = [None, "", "  \n", "One two", "a b c d", "A B c D", long, long, *base, *base[:3], *near, *lines]
    return list(enumerate(rows)) + [(30, base[0]), (None, base[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, token string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (7, 9), (None, 4), (2, 1)], "src long, dst long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    assert components(edges.limit(0)).isEmpty()


def test_token_files(spark, docs, nothing, texts):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(BPE), 0
    got = sorted(huffman.token_digests(docs, BPE).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert huffman.token_digests(nothing, BPE).isEmpty()


def test_huffman_round_trip_and_limit():
    counts = np.array([2**i for i in range(30)] + [0, 5])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and lengths[30] == 0
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.random.RandomState(1).choice(np.flatnonzero(counts), 5000)
    bits, marks = huffman.pack(ids, huffman.canonical_codes(lengths), lengths)
    assert (huffman.Decoder(lengths).unpack(bits, marks, len(ids)) == ids).all()
    only = huffman.code_lengths(np.array([0, 7]))
    assert only.tolist() == [0, 1]


def test_word_cuts_equal_the_library():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ab'sS treveldm  \n\t\r　é日1²!?_<|endoftext|>😀") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    words = [*words, "'s", "x's", "a 's", "\n's", "''s", "it's'll", "a  b", "q<|endoftext|>r"]
    cache = WordCache(BPE)
    for group in (words, [w.replace("<|endoftext|>", "") for w in words]):
        ids, counts = cache.encode(*text_buffer(pa.array(group)))
        ends = np.cumsum(counts)
        want = [e.ids for e in cache.tokenizer.encode_batch(group, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == want


def test_every_code_point_cuts_like_the_library():
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)] if c >= 128]
    cache = WordCache(BPE)
    for at in range(0, len(chars), 100_000):
        group = ["".join(f"a{c}'s" for c in chars[i : i + 500]) for i in range(at, min(at + 100_000, len(chars)), 500)]
        ids, counts = cache.encode(*text_buffer(pa.array(group)))
        want = cache.tokenizer.encode_batch_fast(group, add_special_tokens=False)
        assert ids.tolist() == [i for e in want for i in e.ids]


def thue_morse(bits):
    word = "ab"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [9, 10, 12, 14])
def test_words_built_by_a_rule_do_not_meet(bits):
    one, two = thue_morse(bits)
    cache = WordCache(BPE)
    ids, counts = cache.encode(*text_buffer(pa.array([one, two, one])))
    want = [e.ids for e in cache.tokenizer.encode_batch([one, two, one], add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    data, offsets = text_buffer(pa.array([f"x {one} {two} y", f"{one}"]))
    hashes = span_hashes(data, *word_spans(data, offsets)[:2])
    assert hashes[1] != hashes[2] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4


def test_documents_of_rule_built_words(spark):
    one, two = thue_morse(10)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_jaccard(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_distinct_tokens_whose_key_bits_are_equal(monkeypatch):
    tokens = np.random.RandomState(2).randint(0, 1 << 62, 500).astype(np.uint64)
    rows = np.repeat(np.arange(5), 100)
    many = np.concatenate((tokens, tokens, tokens ^ np.uint64(1)))
    classes = np.zeros(1 << ngramjoin.BUCKET_BITS, np.uint8)
    tokens, owner, _, sizes = ngramjoin._ordered(many, np.tile(rows, 3), 5, 0, classes)
    assert len(tokens) == 1000 and sizes.tolist() == [200] * 5
    monkeypatch.setattr(ngramjoin, "mix", lambda x: x >> np.uint64(40))  # other tokens, equal keys
    tokens, owner, _, sizes = ngramjoin._ordered(many, np.tile(rows, 3), 5, 0, classes)
    assert len(tokens) == 1000 and sizes.tolist() == [200] * 5


def test_unspaced_scripts_are_split():
    text = "日本語ab ไทย 한국어 é漢,x"
    data, offsets = text_buffer(pa.array([text]))
    starts, ends, _ = word_spans(data, offsets, WORD_BYTES, split_unspaced=True)
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert got == ["日", "本", "語", "ab", "ไ", "ท", "ย", "한국어", "é", "漢", "x"]


def test_leak_in_a_script_without_spaces(spark):
    item = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    rnd = random.Random(4)
    noise = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(60)) for _ in range(40)]
    rows = [*enumerate(noise), (100, noise[0] + item + noise[1]), (101, noise[2] + item.replace("風", "火") + noise[3])]
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted({r.doc_id for r in found.collect()}) == [100, 101]


@pytest.mark.parametrize(("alphabet", "length", "share"), [("a", 16, 0.8), ("a", 32, 0.95), ("aA", 16, 0.95), ("aA1", 16, 0.95), ("A", 20, 0.95)])
def test_random_strings_are_found(alphabet, length, share):
    rnd, encoding = random.Random(6), secretscan._encoding(RANKS)
    chars = "".join({"a": string.ascii_lowercase, "A": string.ascii_uppercase, "1": string.digits}[c] for c in alphabet)
    count = lambda s: len(encoding.encode_ordinary(s))
    found = [secretscan.random_spans("".join(rnd.choices(chars, k=length)), [], count, secretscan.RATIO) for _ in range(300)]
    assert sum(map(bool, found)) >= share * 300


def test_identifiers_are_no_secrets():
    encoding = secretscan._encoding(RANKS)
    names = ["internationalization", "getUserAccountSettings", "HTTP_PROXY_CONF_ID", "src/main/resources/app", "build-2024-11-03-final"]
    names += ["node-12-rack-44-zone-b", "a" * 40, "-" * 30, "1234567890123456789", hashlib.md5(b"x").hexdigest()]
    names += ["Donaudampfschifffahrt", "8f14e45f-ceea-467f-a8f0-1a2b3c4d5e6f"]
    count = lambda s: len(encoding.encode_ordinary(s))
    assert [n for n in names if secretscan.random_spans(n, [], count, secretscan.RATIO)] == []


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]


def test_url_rules_and_trees(spark):
    rows = [(i, f"http://{'w' * (i % 9)}a{i % 5}.example.org/{'es' if i % 3 else 'fr'}/{i * (10**6 if i % 3 else 1)}") for i in range(120)]
    rows += [(200, None), (201, "no scheme"), (202, "HTTP://X.Org"), (203, "a://EXAMPLE.org/en/12?q=1#f"), (204, "x://b.net/es/999000000"), (204, "x://b.net/es/999000000")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urltrees.judge(pages, RULES).collect()}
    assert (got[200].host, got[200].path, got[200].rule) == ("", "", None) == (got[201].host, got[201].path, got[201].rule)
    assert (got[202].host, got[202].path, got[202].rule) == ("x.org", "", None)
    assert (got[203].host, got[203].path, got[203].rule, got[203].verdict) == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[1].rule == "example.org/es/" and got[0].rule == "org/" and got[0].verdict == "allow"
    assert got[204].rule is None and got[204].verdict == "block"  # looks like the blocked ones
    assert urltrees.judge(pages.limit(0), RULES).isEmpty()


def test_leaks(spark, docs, nothing):
    item = prose(50, 40).split()
    edited = [w if k % 9 else "zzz" for k, w in enumerate(item)]
    rows = [(1, prose(51, 300) + " " + " ".join(item).upper() + ". " + prose(52, 50)), (2, "x, " + "  ".join(edited)), (3, prose(53, 400)), (4, None), (5, ""), (None, " ".join(item))]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item)), (None, "a b c d e")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(own, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7].score == 1.0 and rows[0][1][got[1, 7].start : got[1, 7].end].lower() == " ".join(item)
    assert 0.5 < got[2, 7].score < 1
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(own, items, block_items=1).collect()} == set(got)
    assert decontam.leaks(nothing, items).isEmpty() and decontam.leaks(own, items.limit(0)).isEmpty()


def test_leak_around_an_insertion(spark):
    item = prose(60, 40).split()
    copy = [*item[:10], "zzz", *item[11:20], *prose(61, 25).split(), *item[20:30], "yyy", *item[31:]]
    words = [*prose(62, 200).split(), *copy, *prose(63, 200).split()]
    own = spark.createDataFrame([(1, " ".join(words)), (2, prose(64, 400))], "doc_id long, text string")
    got = decontam.leaks(own, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    number = {w: k for k, w in enumerate(sorted({*words, *item}))}
    best = decontam.align(np.array([number[w] for w in item]), np.array([number[w] for w in words]))[0] / 80
    assert [(r.doc_id, r.score) for r in got] == [(1, best)] and best >= 0.6125


def test_alignment_is_smith_waterman():
    rnd = random.Random(5)
    for _ in range(40):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(np.array(a), np.array(b))[0] == h.max()


def test_toxicity_held_out(spark, nothing):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = prose(i, rnd.randint(40, 200)).split() + [rnd.choice(("uglyone", "uglytwo"))] * (2 * toxic)
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if i % 4 == 1 else 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "uglyone uglytwo"), (2002, "UglyOne, uglytwo!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 600] + [(0, 1, 0), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxchain.toxic_documents(docs, known).collect()}
    right = sum(got[i].toxic == bool(t) for i, _, t in labels if i >= 600)
    assert right >= 290  # of 300; 225 by calling nothing toxic
    assert not got[2000].toxic and not got[2001].toxic and got[2002].toxic and got[None].toxic
    none = toxchain.toxic_documents(docs, known.limit(0))
    assert none.count() == len(rows) and none.filter("toxic").isEmpty()
    assert toxchain.toxic_documents(nothing, known).isEmpty()


def test_ngram_jaccard(docs, nothing, texts):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, words(t)) for i, t in texts]
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    want = sorted((i is not None, i or 0, len(s), least.get(find(x))) for x, (i, s) in enumerate(sets) if s or i is not None)
    got = [(r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngramjoin.ngram_jaccard(docs).collect() if r.n_shingles or r.doc_id is not None]
    assert sorted(got) == want
    assert ngramjoin.ngram_jaccard(nothing).isEmpty()


def test_copies_with_many_edits(spark, monkeypatch):
    rnd, base, texts = random.Random(5), prose(90, 145).split(), []
    for i in range(150):  # those with up to three edits are alike with the base, those with more with nothing
        words = list(base)
        for k in rnd.sample(range(5, 135), (0, 1, 2, 3, 4, 5, 5)[i % 7]):
            words[k] = f"edit{i}x{k}"
        texts.append(" ".join(words))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts]  # noqa: B905
    root = list(range(len(sets)))
    for _ in root:
        before = list(root)
        for x, a in enumerate(sets):
            root[x] = min(root[y] for y, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b))
        if root == before:
            break
    made, across = [], ngramjoin._across
    monkeypatch.setattr(ngramjoin, "_across", lambda rows, percent: made.append(across(rows, percent)) or made[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngramjoin.ngram_jaccard(docs).collect()} == dict(enumerate(root))
    assert 40 < len(set(root)) < 100
    assert made[0].count() < 150  # of 150 * 149 / 2 pairs


def test_texts_are_worked_on_in_small_slices(monkeypatch):
    texts = [prose(k % 50, 300) for k in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts)], ["id", "text"])
    seen, hashes = [], ngramjoin.span_hashes
    monkeypatch.setattr(ngramjoin, "span_hashes", lambda data, *ends: seen.append(len(data)) or hashes(data, *ends))
    found = [b for b in ngramjoin._set_keys(5)([batch])][:-1]
    assert sum(seen) == sum(map(len, texts)) > 2 << 20 and max(seen) <= 1 << 19
    assert [i for b in found for i in b.column("id").to_pylist()] == list(range(2500))
    assert len({tuple(b.column(c)[i].as_py() for c in "nab") for b in found for i in range(b.num_rows)}) == 50


def test_bins_that_overflow(spark):
    big = " ".join(f"w{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, big), (2, big + " tail one two three")], "doc_id long, text string")
    assert {r.component_id for r in ngramjoin.ngram_jaccard(docs).collect()} == {1}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>One<br>two<p>Three <script>x="</p>"</script>four</p><div class="post-comments">Nice!</div></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""
PLAIN = "<body><div class=top>Same on all</div><div class=body><p>Own {}</p></div><form>Q</form>"


def test_main_text(spark):
    rows = [(1, "http://a/x", PAGE), (2, None, None), (2, None, ""), (3, "http://a", "a < b &lt; c")]
    rows += [(10 + i, "http://B.c/1", PLAIN.format(i)) for i in range(6)] + [(20, "http://d/", PLAIN.format("z"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {}
    for r in styletree.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["Head & more\n\nOne two\n\nThree four"]
    assert got[2] == ["", ""] and got[3] == ["a < b < c"]
    assert got[12] == ["Own 2"]  # the branch that looks alike on all pages of the host is gone
    assert got[20] == ["Same on all\n\nOwn z"]
    assert styletree.extract(pages.limit(0)).isEmpty()


def test_named_inline_elements_end():
    text = lambda body: styletree.main_text(f"<body>{body}</body>")
    assert text('<a class="skip-link">Skip</a><article><p>One</p></article>') == "One"
    assert text('<article><p>A <span class="share">x</span> B</p><p>C</p></article>') == "A B\n\nC"
    assert text('<p>A <span class="share">x <span>y</span> z</span> B</p>') == "A B"
    assert text('<p>A <span hidden>x</p><p>B</p>') == "A\n\nB"


def test_class_words_do_not_take_the_article():
    text = lambda body: styletree.main_text(f"<body>{body}</body>")
    assert text('<article class="no-sidebar"><p>One</p></article>') == "One"
    assert text('<div class="comments-open"><article><p>One</p><div class="comments">C</div></article></div>') == "One"
    assert text('<div class="layout-sidebar"><article><p>One two</p><p class="ad">X</p></article></div><p>z</p>') == "One two"
    assert text('<p>The text of the page</p><div class="related"><article>Teaser</article></div>') == "The text of the page"


def test_unimportant_parts_of_articles(spark):
    page = "<article><div class=x>Read our other stories</div><p>Own text {}</p></article>"
    pages = spark.createDataFrame([(i, "http://a/x", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in styletree.extract(pages).collect()} == {i: f"Own text {i}" for i in range(6)}
    assert styletree.main_text("<div>The long text of the page</div><article>Teaser</article>") == "The long text of the page\n\nTeaser"
    assert styletree.main_text("<article>Same</article>", {"/article"}) == "Same"


def test_paragraph_sketches(docs, nothing, texts):
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    parts = lambda t: {p for p in t.split("\n") if p}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(parts(t), parts(edited)), 9), round(like(parts(t), parts(nxt)), 9)))
    rows = ibltdiff.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == sorted(want)
    assert ibltdiff.fingerprints(nothing).isEmpty()


def test_line_dedup(docs, nothing, texts):
    got = {(r.doc_id, r.n): r for r in linededup.dedup_lines(docs.filter("doc_id is not null")).collect()}
    assert got[0, 1].text is None and got[1, 1].text == "" and got[3, 1].text == "One two"
    first = next(i for i, t in texts if t and t.count("\n") == 2 and i is not None and i > 5)
    assert got[first, 1].n_dropped == 0
    for i in range(first + 1, first + 4):
        assert got[i, 1].text == dict(t for t in texts if t[0] is not None and t[0] != 30)[i].split("\n")[1] if i != 30 else True
    assert got[7, 1].text == "" and got[6, 1].n_dropped == 0
    assert linededup.dedup_lines(nothing).isEmpty()


def test_fuzzy_lines(spark):
    line = prose(70, 40)
    edited = line.replace(line.split()[20], "changed", 1)
    rows = [(1, "x\n" + line), (2, edited + "\ny"), (3, prose(71, 40)), (4, "short"), (5, "short")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "y", 3: rows[2][1], 4: "short", 5: "short"}


def _dropped(lines):
    """The lines that are not the first of their component, of all pairs of lines."""
    sets = [{t[k : k + 10] for k in range(max(1, len(t) - 9))} for t in lines]
    root = list(range(len(lines)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common * 100 >= (len(a) + len(sets[j]) - common) * 80:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i for i in range(len(lines)) if top(i) != i}


@pytest.mark.parametrize("families", [300, 560])
def test_template_lines(spark, families):
    template = prose(300, 40)
    lines = []
    for i in range(families):  # strangers share the template, the lines of a family all but one word
        own = prose(1000 + i, 9).split()
        lines += [f"{template} {' '.join(own)}", f"{template} {' '.join([*own[:4], 'changed', *own[5:]])}"]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in linededup.dedup_lines(df).collect() if r.n_dropped}
    assert got == _dropped(lines) and len(got) == families


def test_small_buckets_list_their_pairs(spark, monkeypatch):
    template, left = prose(310, 40), []
    lines = [f"{template} {prose(400 + k // 2, 13)} {'abc'[k % 2]}" for k in range(60)]
    across = linededup._across
    monkeypatch.setattr(linededup, "_across", lambda mixed, sets: left.append(mixed.count()) or across(mixed, sets))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in linededup.dedup_lines(docs).collect() if r.n_dropped}
    assert got == _dropped(lines) and len(got) >= 30
    assert left == [0]  # no line of a small bucket goes through the join on shingles


def test_pairs_across_are_made_once_and_tested_where_they_meet(spark):
    template = prose(320, 40)  # strangers share the template; in the last two all but one word agree
    lines = [f"{template} {prose(2000 + k, 12)}" for k in range(40)]
    lines.append(lines[0].replace(lines[0].split()[45], "changed", 1))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    places = linededup._lines(docs).select("doc_id", "rid", "pos", "k1", "k2").cache()
    sets = linededup._texts(docs, places)
    mixed = places.select("k1", F.lit(1).alias("band"), F.lit(len(lines)).alias("n"), F.col("k1").alias("root"))
    met = linededup._across(mixed, sets)
    k1 = {r.doc_id: r.k1 for r in places.collect()}
    assert (max(k1[0], k1[40]), min(k1[0], k1[40])) in [tuple(r) for r in met.collect()]
    assert met.count() < 5  # of 41 * 40 / 2 pairs
    joins = re.findall(r"Join \[(\w+)", met._jdf.queryExecution().executedPlan().toString())
    assert {re.sub(r"\d+$", "", k) for k in joins} == {"s"}  # no join lists pairs before their bitmaps are tested


def test_unlike_neighbours_are_not_verified(spark):
    words = [prose(k, 30).split() for k in (501, 502)]
    lines = [" ".join(words[0]), " ".join([*words[0][:-1], "other"]), " ".join(words[1])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    places = linededup._lines(docs).select("doc_id", "rid", "pos", "k1", "k2")
    k1 = {r.doc_id: r.k1 for r in places.collect()}
    pairs = spark.createDataFrame([(k1[0], k1[1]), (k1[0], k1[2]), (k1[1], k1[2])], "u long, v long")
    assert [tuple(r) for r in linededup._allowed(pairs, linededup._texts(docs, places)).collect()] == [(k1[0], k1[1])]


def test_rounds_over_few_edges_make_few_files(spark, monkeypatch):
    rounds = importlib.import_module("faultline.llm.components")
    made, cut = [], rounds.cut_lineage
    monkeypatch.setattr(rounds, "cut_lineage", lambda df: made.append(df.rdd.getNumPartitions()) or cut(df))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "src long, dst long")
        got = {r.node: r.root for r in rounds.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 10 * (i > 9) for i in range(21)}
    assert len(made) > 4 and max(made[1:]) == 1


def test_secrets(spark, nothing):
    digest = hashlib.sha1(b"x").hexdigest()
    key = "zQ7xK9vB2mW5tR8yP3nL"
    text = f'é Password: "hunter22", token=abc AKIA{"A1" * 9} {digest} {key} snake_case_name2 deadbeef'
    rows = [(1, text), (2, None), (3, ""), (None, key)]
    got = {r.doc_id: r for r in secretscan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), RANKS).collect()}
    r = got[1]
    assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == (1, 1, 1, 1)
    spans = [x.split(":") for x in r.spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("assign", 'Password: "hunter22'), ("access", "AKIA" + "A1" * 9), ("hex", digest), ("random", key)]
    assert r.base_sha256 == hashlib.sha256(",".join(":".join(x) for x in spans[:3]).encode()).hexdigest()
    assert got[2].spans == got[3].spans == "" and got[None].n_random == 1
    assert secretscan.find_secrets(nothing, RANKS).isEmpty()


def test_pieces(docs, nothing, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(i), tuple(lib.encode(t or "", add_eos=True)), lib.decode(lib.encode(t or "", add_eos=True))) for i, t in texts)
    coded = pieces.encode_pieces(docs, PIECES)
    rows = coded.collect()
    for r in rows:
        assert len(r.ids) == len(r.starts) == len(r.ends) and all(a <= b for a, b in zip(r.starts, r.ends, strict=True))
    back = [(str(r.doc_id), r.text) for r in pieces.decode_pieces(coded, PIECES).collect()]
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == [x[:2] for x in want]
    assert sorted(back) == sorted((x[0], x[2]) for x in want)
    digests = sorted((str(r.doc_id), r.ids_sha256) for r in pieces.piece_digests(docs, PIECES).collect())
    assert digests == sorted((i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids, _ in want)
    assert pieces.encode_pieces(nothing, PIECES).isEmpty()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(own.serialized_model_proto())
    codec = pieces.PieceCodec(PIECES)
    codec.map, codec.squeeze = pieces.CharMap(model.normalizer_spec.precompiled_charsmap), True
    for text in ("", " a  b ", "ﬁ ｱｲ① ²é▁", "　x\u2028", "".join(map(chr, range(1, 0x250)))):
        normal, source = codec.normalise(text)
        assert normal.decode() == own.normalize(text)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all()
