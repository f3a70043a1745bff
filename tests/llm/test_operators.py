"""Each operator against a plain brute-force version, on generated and on hard tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from ballast.llm import decontam, html_text, huffman, mixing, neardup, quality, secrets, sharding, substrings, warc
from tests.llm.helpers import hard_documents, prose, read, rows_of, tables


@pytest.fixture(scope="module", params=["generated", "hard"])
def folder(request, sf, tmp_path_factory):
    return sf if request.param == "generated" else tables(tmp_path_factory.mktemp("hard"))


@pytest.fixture(scope="module")
def hollow(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), empty=True)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_op1_base_counts(spark, folder):
    want = []
    for d in read(folder, "documents"):
        t = d["text"] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else _many(grams)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((d["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.op1(spark, folder).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def _many(grams):
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    return {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}


def test_op1_rejects_foreign_distributions(spark):
    rows = [(i, " ".join(["the house of the man and the dog is in the garden with a cat"] + [f"w{i}x{j}" for j in range(60)]), "en") for i in range(40)]
    rows += [(100, " ".join(f"{j * 7919}" for j in range(80)), "en"), (101, " ".join("$%^&*()"[j % 7] * 5 + str(j) for j in range(80)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(40)) and not got[100] and not got[101]


def test_op2_components(spark, folder):
    """Null ids and repeated ids are nodes like any others."""
    docs = [(d["doc_id"], d["text"]) for d in read(folder, "documents")]
    want = [(d, n, c, d == c) for d, n, c in neardup.brute_force(docs)]
    assert rows_of(neardup.op2(spark, folder)) == sorted(want, key=key)


def test_op2_rows_without_id_and_with_one_id(spark):
    """Rows of one id, or of none, with different texts are told apart, and linked by their own texts."""
    texts = [prose(i, 40) for i in range(12)]
    rows = [(None, t) for t in texts] + [(5, texts[3] + " tail"), (5, texts[3] + " tail"), (8, texts[1].upper()), (8, texts[7] + " end"), (8, prose(99, 30)), (9, prose(99, 30) + " x")]
    want = neardup.brute_force(rows, 5)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, doc int")
    got = [(None if x["doc"] == neardup.NO_ID else x["doc"], x["n_shingles"], None if x["component"] == neardup.NO_ID else x["component"]) for x in neardup.group(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = neardup.keep_first(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=key) == sorted([(None, t) for t in texts] + [(8, prose(99, 30))], key=key)


def test_op2_hot_lists(spark):
    """Many near copies that share most shingles; unlinked and linked documents around frequent passages."""
    import random

    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    common = [f"c{i}" for i in range(60)]
    blocks = [[f"d{k}_{i}" for i in range(25)] for k in range(6)]
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(150, 300):
        rows.append((i, " ".join(common + [f"u{i}_{j}" for j in range(r.randrange(2, 40))])))
    for i in range(300, 420):  # nothing but frequent blocks, in some order
        rows.append((i, " ".join(w for b in r.sample(blocks, r.randrange(2, 6)) for w in b)))
    for i in range(420, 500):
        rows.append((i, rows[r.randrange(150, 420)][1] + f" t{i} t{i + 1}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = neardup.brute_force(rows, 5)
    got = [(x["doc"], x["n_shingles"], x["component"]) for x in neardup.group(df).collect()]
    assert sorted(got) == sorted(want)
    assert 20 < len({c for _, _, c in want}) < 480


def test_op2_lists_of_any_size_give_the_same(spark, monkeypatch):
    """Where all lists count as hot, or none, the links are the same."""
    import random

    r = random.Random(8)
    rows = [(i, prose(r.randrange(60), 90) if i % 3 else " ".join(r.choice("abcde") for _ in range(50))) for i in range(200)]
    rows = [(i, t + " " + " ".join(f"{i}_{j}" for j in range(r.randrange(8)))) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(neardup.brute_force(rows, 5))
    for size in (1, 1000):
        monkeypatch.setattr(neardup, "HOT", size)
        assert sorted((x["doc"], x["n_shingles"], x["component"]) for x in neardup.group(df).collect()) == want


def test_op2_keep_first(spark):
    rows = [(3, "a b c d e f g h i j", 1), (1, "A B C D E F G H I J", 2), (2, "other words here", 3), (2, "other words here", 4), (7, None, 5), (8, "", 6), (8, "", 7)]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, _doc int"))
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 2, 7, 8, 8]
    assert kept.columns == ["doc_id", "text", "_doc"]


def test_op3_pages(spark, folder):
    got = html_text.op3(spark, folder).collect()
    assert len(got) == len(read(folder, "pages"))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    if by.get(1, "").startswith("Head"):
        assert by[1] == by[2] == "Head & tail\nFirst para graph with bold text.\nSecond."
        assert by[3] == by[4] == ""


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><p>Body text</p><div class='comments'><p>Nice post</p></div></main>", "Body text"),
        ("<article><p>a&nbsp;b &lt;i&gt; &#233;</p><script>x='<p>no</p>'</script><form><p>mail</p></form><p>c</p></article>", "a b <i> é\nc"),
        ("<article><p>open<p>next<br>line</article><aside><p>side</p></aside>", "open\nnext line"),
        ("<!-- <article>x</article> -->", ""),
    ],
)
def test_op3_cases(page, text):
    assert html_text.main_text(page) == text


LONG = "A paragraph that is long enough to be a surge by itself, since it has more than eighty-six characters."


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body class="no-sidebar"><article><p>Body</p></article></body>', "Body"),
        ('<html class="nav"><body id="menu" class="sidebar"><main><p>Body</p></main></body></html>', "Body"),
        ('<div class="layout has-sidebar"><article><p>Body</p></article><div class="sidebar"><p>side</p></div></div>', "Body"),
        ('<div id="page-header-fixed"><article><p>Body</p></article></div>', "Body"),
        ('<div class="layout sidebar"><p>menu</p><div><article><p>Body</p></article></div><p>more</p></div>', "Body"),
        ('<article><header class="article-header"><h1>Title</h1></header><p>Body</p></article>', "Title\nBody"),
        ('<article><header class="header"><h1>Title</h1></header><p>Body</p></article>', "Title\nBody"),
        ('<article><div class="cookie-banner"><p>ok?</p></div><p>Body</p><div class="box ad"><p>buy</p></div></article>', "Body"),
        ('<main><p>Body</p></main><div class="comments"><article><p>Nice</p></article></div>', "Body"),
        ('<main><p>Body</p><div class="related"><article><p>Other</p></article></div></main>', "Body"),
        ('<nav><article><p>teaser</p></article></nav><article><p>Body</p></article>', "Body"),
        ('<div class="sidebar"><nav><article><p>teaser</p></article></nav></div><article><p>Body</p></article>', "Body"),
        ('<div class="sidebar"><nav><article><p>teaser</p></article></nav></div>', ""),
        (f'<body class="has-sidebar"><div class="sidebar"><p>{LONG}</p></div><div class="no-menu"><p>{LONG}</p></div></body>', LONG),
        (f'<div><p>{LONG}</p></div><div class="comments"><article><p>Nice</p></article></div>', f"{LONG}\nNice"),
    ],
)
def test_op3_names_of_wrappers(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='ad'><p>buy</p></div><p>{LONG}</p><div class='ad'><p>buy this</p></div><p>Short end.</p>", f"{LONG}\nShort end."),
        (f"<p>{LONG}</p><div class='ad'><p>a</p><p>b</p><p>c</p></div><p>Short end.</p>", LONG),
        (f"<p>{LONG}</p><p><a href='x'>only a link</a></p><p>{LONG} Two.</p>", f"{LONG}\n{LONG} Two."),
        (f"<p><a href='x'>{LONG}</a></p>", ""),
        ("<p>Home</p><p>About</p>", ""),
    ],
)
def test_op3_windows_on_unmarked_pages(page, text):
    assert html_text.main_text(page) == text


def _by_the_rule(page: str, window: int, surge: int) -> str:
    """The window rule line by line, each window summed anew: outside until a surge, then up to a dive."""
    lines = html_text.lines_of(page)
    best = max([m for _, n, m in lines if n], default=0)
    counted = []
    for text, n, m in lines:
        marked = best > 0 and m == best
        if marked and n == 0:
            continue
        counted.append((text, n + html_text.SURGE // 3 if marked else n // html_text.OUTSIDE if best == 2 or m else n))
    window_at = lambda i: sum(n for _, n in counted[i : i + window])
    densest = max([window_at(i) for i in range(len(counted))], default=0)
    out, state = [], "outside"
    for i, (text, n) in enumerate(counted):
        if n > 0 and window_at(i) > (min(surge, densest // 2) if densest >= html_text.SCANT else surge):
            state = "inside"
        if state == "inside":
            out += [text] * (n > 0)
            if window_at(i + 1) == 0:
                state = "outside"
    return "\n".join(out)


def test_op3_windows_decide_on_marked_pages(sf):
    """Texts follow the rule at any window and surge, and both change what is taken from pages that mark their article."""
    pages = [p["html"] for p in read(sf, "pages") if p["html"]]
    assert len(pages) > 20 and all(re.search("<(article|main)", p) for p in pages)
    unmarked = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    for kw in ({"window": 3, "surge": 86}, {"window": 1, "surge": 86}, {"window": 1, "surge": 10**6}, {"window": 5, "surge": 300}, {"window": 2, "surge": 5}):
        for p in pages + unmarked:
            assert html_text.main_text(p, **kw) == _by_the_rule(p, **kw)
    changed = lambda **kw: sum(html_text.main_text(p, **kw) != html_text.main_text(p) for p in pages)
    assert changed(window=1) >= len(pages) // 10 and changed(window=1, surge=10**6) >= len(pages) // 2
    same = sum(html_text.main_text(u) == html_text.main_text(p) for u, p in zip(unmarked, pages))
    assert same >= 0.9 * len(pages)  # windows find the article without its mark


def test_op3_short_articles_and_dense_blocks():
    assert html_text.main_text("<h1>Title</h1><p>Short one.</p><p>Short two.</p>") == "Title\nShort one.\nShort two."
    assert html_text.main_text("<nav><a href=x>Menu</a></nav><div><p>Only this one sentence.</p></div><footer>Foot</footer>") == "Only this one sentence."
    assert html_text.main_text("<ul><li><a href=x>Menu one</a></li><li><a href=y>Menu two</a></li></ul>") == ""
    assert html_text.main_text("<article><p>One.</p></article>") == "One."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p class='advert'>Buy now</p><p>Body</p><h2 class='cookie notice'>We use</h2><p>More</p></article>", "Body\nMore"),
        ("<article><div class='article-header'><h1>Title</h1><p>Lead</p></div><p>Body</p></article>", "Title\nLead\nBody"),
        (f"<p>{LONG * 9}</p><article><p>Body</p></article><p>Aside.</p>", f"{LONG * 9}\nBody"),  # dense text outside the mark surges too
        (f"<p>{LONG}</p><article></article>", LONG),  # a mark without text is none
        ("<article><p title='a > b'>x<br/>y</p><p title='open>z</p></article>", "x y\nz"),
    ],
)
def test_op3_marks_weigh_and_windows_decide(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("part", ["<![CDATA[", '<a "', "<script ", "<!", "<div><ul>", "<body>", "<p class='x", "<!--", "<div class='a' id=\"b"])
def test_op3_hostile_pages_take_linear_time(part):
    import time

    began = time.time()
    html_text.main_text(part * (1_000_000 // len(part)) + "</div>" * 1000)
    assert time.time() - began < 5


def test_op4_round_trip(spark, folder):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = [d for d in read(folder, "documents")]
    got = {}
    for r in huffman.op4(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    assert sum(map(len, got.values())) == len(docs)
    start = 0
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [x for x in got[d["doc_id"]] if x[1] == start]
        assert mine == [(d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))]
        start += len(ids)


def test_op4_special_token_in_a_text(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one<|endoftext|>two three <|endoftext|>four", "a <|endoftext|>", "<|endoftext|> <|endoftext|>\n<|endoftext|> b <|endoftext| >"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in huffman.op4(spark, str(tmp_path)).collect()) == want
    assert 50256 in tok.encode(texts[1], add_special_tokens=False).ids


def test_op4_encoder_is_the_library(monkeypatch):
    """Any text, through caches of any size, gives the library's ids."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok, r = Tokenizer.from_file(path), random.Random(4)
    chars = ["a", "B", "é", "ß", "1", "²", "ª", " ", " ", "\n", "\t", "\r", "'", "s", "'ll", ".", "#", "\xa0", "\x85", "\x1c", "\u2003", "\u200b", "日", "ا", "🙂", "\u0301", "<|endoftext|>", "\x00", "ǆ", "Ā"]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(3000)] + ["don't we'll  it's\n\n  x   ", "  ", " ", "\n", "a " * 500]
    for most in (3, 200_000):
        monkeypatch.setattr(huffman, "CACHE_WORDS", most)
        enc = huffman.Encoder(path)
        for t in texts:
            assert enc.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, enc.kind).tobytes(), t


def test_op4_small_files(spark, folder, monkeypatch):
    """Files that roll after a few tokens give the same result."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = rows_of(huffman.op4(spark, folder))
    monkeypatch.setattr(huffman, "FILE_TOKENS", 500)
    where, manifest = huffman.write(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    assert manifest.count() > 8 and rows_of(huffman.read(where, manifest)) == want


def test_op4_code_lengths():
    import numpy as np

    r = np.random.default_rng(1)
    counts = (r.pareto(0.4, 500) + 1).astype(np.int64).clip(1, 10**9)
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() <= 12 and (2.0 ** -lengths).sum() <= 1
    free = huffman.code_lengths(counts, 40)
    import heapq

    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * free).sum()) == cost <= int((counts * lengths).sum())


def _hits(doc: list[bytes], windows: dict) -> tuple[set, set]:
    hit, items = set(), set()
    sizes = {len(w) for w in windows}
    for n in sizes:
        for i in range(len(doc) - n + 1):
            if found := windows.get(tuple(doc[i : i + n])):
                hit.update(range(i, i + n))
                items |= found
    return hit, items


def test_op5_hits(spark, folder):
    words = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    windows: dict = {}
    for b in read(folder, "benchmark"):
        w = words(b["text"])
        if b["item_id"] is not None:
            for i in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(b["item_id"]))
    want = []
    for d in read(folder, "documents"):
        w = words(d["text"])
        hit, items = _hits(w, windows)
        want.append((d["doc_id"], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert rows_of(decontam.op5(spark, folder)) == sorted(want, key=key)
    assert any(r[2] for r in want)


def test_op5_blocks_and_shards(spark, folder, monkeypatch):
    """Small blocks of phrases, small shards, and shards held for one or several passes over the blocks give the same result."""
    want = rows_of(decontam.op5(spark, folder))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    for held in (decontam.HELD_BYTES, 10000):
        monkeypatch.setattr(decontam, "HELD_BYTES", held)
        found = decontam.scan(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), shard_bytes=3000)
        got = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), "contaminated")
        assert rows_of(got) == want


def test_op6_spans(spark, folder):
    rules = [
        ("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    want = []
    for d in read(folder, "documents"):
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in re.finditer(p, d["text"] or "") if len(m[g]) >= n)
        count = [sum(k == x for _, k, _ in found) for x in range(3)]
        want.append((d["doc_id"], *count, hashlib.sha256(",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()))
    got = sorted((tuple(r)[:5] for r in secrets.op6(spark, folder).collect()), key=key)
    assert got == sorted(want, key=key)
    if "sf0" not in folder:
        assert any(sum(w[1:4]) for w in want)


def test_op6_automata_match_like_expressions():
    """Random texts near the rules, against the expressions' own leftmost matches."""
    import random

    import numpy as np

    r = random.Random(6)
    parts = ["password", "PassWd", "api_key", "apikey", "ſecret", "secret", "toKen", "=", ":", " ", "  ", "'", '"', "a" * 8, "deadbeef" * 4, "0" * 31, "AKIA", "AKIA" + "Q" * 16, "é", "x", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "\n", "ghp_" + "a" * 22, "eyJ" + "a" * 9 + ".", "b" * 12, "==", "Z1"]
    scanner = secrets.Scanner()
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        data = np.frombuffer(text.encode(), np.uint8)
        mask = int(scanner.anywhere.scan(data, np.array([0, len(data)]))[0])
        want = sorted((m.start(), k, m.end()) for k, (_, _, head, body, least) in enumerate(secrets.RULES) for m in re.finditer(f"(?a:{head})({body})", text) if len(m[1]) >= least)
        assert scanner.spans(data, mask) == want, text


def test_op6_long_runs_are_linear():
    import time

    import numpy as np

    data = np.frombuffer(b"password=" + b"a" * 1_000_000 + b" " + b"password " * 100_000, np.uint8)
    began = time.time()
    scanner = secrets.Scanner()
    assert [k for _, k, _ in scanner.spans(data, 7)] == [0, 2] and time.time() - began < 20


def test_op6_added_rules_and_redaction(spark):
    text = "é ghp_" + "a" * 30 + " x -----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s["kind"] for s in row["secrets"]] == ["forge", "pem"]
    assert secrets.redacted(text, [(s["start"], s["end"]) for s in row["secrets"]]) == "é <secret> x <secret>"


def test_op6_long_text_among_short_ones(spark):
    long = "z " * 40_000 + "AKIA" + "Q" * 16
    rows = [(i, "nothing") for i in range(200)] + [(999, long)]
    got = {r["doc_id"]: len(r["secrets"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999] == 1 and sum(got.values()) == 1


def _expected_spans(text: str, rule) -> list:
    kind, _, head, body, least = rule
    out, at, whole = [], 0, re.compile(f"(?:{head})(?:{body})")
    while (m := whole.search(text, at)) is not None:
        at = max(m.end(), m.start() + 1)
        start = re.compile(head).match(text, m.start()).end() if head else m.start()
        if m.end() - start >= least:
            out.append((m.start(), m.end()))
    return out


@pytest.mark.parametrize("k", range(len(secrets.RULES)))
def test_op6_repeated_openings_are_linear(k):
    """Each rule on a megabyte of its own opening, and on shorter runs that the expression itself can search."""
    import time

    import numpy as np

    opening = ["token=", "AKIA", "0f", "ghp_", "xoxb-", "AIza", "sk_live_", "eyJ", "-----BEGIN RSA PRIVATE KEY-----"][k]
    scanner = secrets.Scanner()
    began = time.time()
    data = np.frombuffer((opening * (1_000_000 // len(opening))).encode(), np.uint8)
    scanner.spans(data, 1 << k)
    assert time.time() - began < 10  # 5 s on an idle machine
    for text in (opening * 200, (opening * 60 + ".") * 9, (opening * 40 + " x ") * 7 + opening + "abcdefgh.eyJabcdefgh.abcdefgh", opening):
        got = [(s, e) for s, _, e in scanner.spans(np.frombuffer(text.encode(), np.uint8), 1 << k)]
        assert got == _expected_spans(text, secrets.RULES[k]), text[:80]


def test_op6_backward_ends_equal_forward_ones(monkeypatch):
    import random

    import numpy as np

    r = random.Random(9)
    pieces = ["eyJ", "abcdefgh", ".", "-", " ", "token", "=", '": "', "AKIA", "Z9", "deadbeef" * 5, "ghp_", "xoxb-", "A" * 24, "\n", "é", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "sk_live_", "secret:"]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 60))) for _ in range(300)]
    scanner, whole = secrets.Scanner(), (1 << len(secrets.RULES)) - 1
    forward = [scanner.spans(np.frombuffer(t.encode(), np.uint8), whole) for t in texts]
    monkeypatch.setattr(secrets, "WALKS", 0)
    assert [scanner.spans(np.frombuffer(t.encode(), np.uint8), whole) for t in texts] == forward
    assert sum(map(len, forward)) > 300


def test_op7_mixture(spark, folder):
    docs = read(folder, "documents")
    tokens: dict = {}
    for d in docs:
        tokens[d["source"]] = tokens.get(d["source"], 0) + len(WORD.findall(d["text"] or ""))
    got = mixing.op7(spark, folder).collect()
    most = max(tokens.values())
    for s, n in tokens.items():
        mine = [r for r in got if r["source"] == s]
        first = [r for r in mine if r["epoch"] == 0]
        assert len(first) == sum(d["source"] == s for d in docs)  # no document is dropped
        if n:
            passes = sum(r["n_tokens"] for r in mine) / n
            longest = max(r["n_tokens"] for r in mine) / n
            assert 1 <= passes <= mixing.MAX_REPEATS + longest
            assert n < most or passes == 1
    places = [(r["source"], r["epoch"], r["block"], r["place"]) for r in got]
    assert len(places) == len(set(places))


def test_op7_targets(spark):
    rows = [(i, "w " * (10 if i < 90 else 1), "big" if i < 90 else "small") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", mixing.token_count(__import__("pyspark").sql.functions.col("text")))
    plan = {r["_source"]: r for r in mixing.plan(docs, target_entropy=0.9).collect()}
    import math

    w = [r["weight"] for r in plan.values()]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * math.log2(x) for x in w) - 0.9) < 1e-3
    budget = mixing.mix(docs, budget=500, target_entropy=0.9).groupBy("source").sum("n_tokens").collect()
    for r in budget:
        assert abs(r[1] - 500 * plan[r[0]]["weight"]) <= 10


def test_op7_keeps_each_rows_own_values(spark):
    """Rows that differ in a nested value alone, or in which of two columns is null, keep what they hold."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import Row

    extra = [({"k": 1}, [{"k": 1}], None, "x"), ({"k": 2}, [{"k": 1}], None, "x"), ({"k": 1}, [{"k": 2}], "x", None), ({"k": None}, [], "x", None), ({}, [None], "x", None), (None, None, None, None), ({"k": 1}, [{"k": 1}], None, "x")]
    rows = [(1, "some words in a text", "s", *e) for e in extra] + [(2, "one", "t", {"k": 5}, [], "y", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, l array<map<string,int>>, a string, b string").withColumn("s", F.struct("m", "a"))
    got = mixing.mix(df).filter("epoch = 0").drop("n_tokens", "epoch", "block", "place").collect()
    want = [Row(doc_id=r[0], text=r[1], source=r[2], m=r[3], l=r[4], a=r[5], b=r[6]) for r in rows]
    assert sorted(map(repr, (r.asDict() | {"s": 0} for r in got))) == sorted(map(repr, (r.asDict() | {"s": 0} for r in want)))
    assert all(r["s"]["m"] == r["m"] and r["s"]["a"] == r["a"] for r in got)


def test_op8_removed_bytes(spark, folder):
    """Rows without id are documents in the order of their texts' hashes; equal rows are one document."""
    import xxhash

    order = lambda i, t: i if i is not None else substrings.NO_ID + (xxhash.xxh64_intdigest((t or "").encode(), seed=42) & ((1 << 61) - 1))
    docs = [(order(d["doc_id"], d["text"]), d["text"], d["doc_id"]) for d in read(folder, "documents")]
    want = substrings.brute_force(list({k: (k, t) for k, t, _ in docs}.values()))
    got = rows_of(substrings.op8(spark, folder))
    assert got == sorted(((i, *want[k]) for k, _, i in docs), key=key)
    assert any(v[1] for v in want.values())


def test_op8_rows_without_id_and_names_of_its_own(spark):
    import xxhash

    texts = [prose(i, 60) for i in range(6)]
    rows = [(None, texts[0] + " a"), (None, texts[0] + " b"), (None, texts[1]), (3, texts[1] + texts[2]), (4, texts[2]), (5, None), (6, ""), (7, texts[3] * 3)]
    order = lambda i, t: i if i is not None else substrings.NO_ID + (xxhash.xxh64_intdigest(t.encode(), seed=42) & ((1 << 61) - 1))
    want = substrings.brute_force([(order(i, t), t) for i, t in rows])
    names = "doc_id long, text string, doc int, tie int, _doc int, _Tie int, lo int, edges int, kept int"
    got = substrings.deduplicate(spark.createDataFrame([(i, t, k, k, k, k, k, k, k) for k, (i, t) in enumerate(rows)], names)).collect()
    for r in got:
        assert want[order(r["doc_id"], r["text"])] == (r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest())
        assert r["doc"] == r["tie"] == r["_doc"] == r["_Tie"] == r["lo"] == r["edges"] and rows[r["doc"]] == (r["doc_id"], r["text"])
    assert len(got) == len(rows)


def test_op8_many_texts_of_one_id(spark):
    """Different texts of one id never stand in for each other, however many there are; a copy under a larger id goes."""
    import random

    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=110)) for _ in range(12_000)]
    rows = [(7, t) for t in texts] + [(1, texts[0]), (9, texts[1]), (9, texts[2]), (9, "own " * 3)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {(x["doc_id"], bytes(x["kept"]).decode()): x["n_bytes"] - len(x["kept"]) for x in got}
    assert len(got) == len(rows)
    assert all(gone[7, t] == 0 for t in texts[1:]) and gone[7, ""] == 110 and gone[1, texts[0]] == 0
    assert gone[9, ""] == 110 and gone[9, "own " * 3] == 0


def test_op8_lengths_that_it_takes(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for least, gram in ((50, 36), (400, 36), (100, 100)):
        with pytest.raises(ValueError):
            substrings.deduplicate(df, least=least, gram=gram)
    rows = [(i, prose(i % 3, 40)[i:]) for i in range(9)]
    want = substrings.brute_force(rows, 40)
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), least=40, gram=16).collect()
    assert {r["doc_id"]: sum(x["end"] - x["start"] for x in r["removed"]) for r in got} == {k: v[1] for k, v in want.items()}


def test_op8_hot_anchor(spark):
    """Anchors with very many different stretches, and self-overlapping runs."""
    import random

    r = random.Random(3)
    core = "the very common passage that stands everywhere in this table ok"
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(r.randrange(120))) + core + "".join(r.choice("abcdef ") for _ in range(60)) + ("q" * 250 if i % 5 == 0 else "")) for i in range(150)]
    rows += [(1000 + i, rows[i][1][10:-5]) for i in range(0, 150, 7)]
    want = substrings.brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (3, 2000):
        got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["start"] for s in x["removed"]), len(x["removed"]), hashlib.sha256(x["kept"]).hexdigest()) for x in substrings.deduplicate(df, group=group).collect()}
        assert got == want


def test_op9_law(spark, folder):
    docs = read(folder, "documents")
    got = sharding.op9(spark, folder).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(((d["doc_id"], size(d["text"]), zlib.crc32((d["text"] or "").encode())) for d in docs), key=key)
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    shards: dict = {}
    for r in got:
        shards.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_op9_minimax_is_least():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = r.integers(1, 50, r.integers(1, 9))
        k = int(r.integers(1, 4))
        ends, whole = np.cumsum(sizes), np.ones(len(sizes), bool)
        best = min(max(x.sum() for x in np.split(sizes, c)) for m in range(k) for c in itertools.combinations(range(1, len(sizes)), m))
        capacity = sharding.least_capacity(ends, whole, k)
        cuts = sharding.greedy(ends, whole, capacity)
        assert capacity == best and np.diff([0, *cuts, ends[-1]]).max() == best


@pytest.mark.parametrize("shape", ["even", "heavy", "few"])
def test_op9_equals_minimax_over_all_groups(spark, shape):
    """Finer and finer ranges end at the capacity and the cuts over single groups."""
    import numpy as np

    r = np.random.default_rng(7)
    n = {"even": 20_000, "heavy": 5_000, "few": 9}[shape]
    h = np.sort(r.choice(2**62, n, replace=False).astype(np.int64) * 2 - 2**62)
    sizes = (r.pareto(0.7, n) * 20 + 8).astype(np.int64).clip(8, 10**7) if shape == "heavy" else r.integers(8, 900, n)
    import pandas as pd

    groups = spark.createDataFrame(pd.DataFrame({"h": h, "bytes": sizes}).sample(frac=1, random_state=1))
    ends, whole = np.cumsum(sizes), np.ones(n, bool)
    capacity = sharding.least_capacity(ends, whole, 24)
    want = [int(h[np.searchsorted(ends, c, side="right")]) for c in sharding.greedy(ends, whole, capacity)]
    for ranges in (8, 64, 1 << 16):
        assert sharding.cut_hashes(groups, 24, ranges) == (capacity, want)


def test_op10_records(spark, folder):
    pages = [(p["page_id"], (p["html"] or "").encode()) for p in read(folder, "pages")]
    first: dict = {}
    for i, h in sorted(pages):
        first.setdefault(h, i)
    want = []
    for i, h in pages:
        again = len(h) >= 100 and first[h] != i
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert rows_of(warc.op10(spark, folder)) == sorted(want, key=key)


def test_op10_archives_are_deterministic(spark, folder, monkeypatch):
    """Any order and partitioning of the pages gives the same files."""
    monkeypatch.setattr(warc, "BLOCK_IDS", 4)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = [sorted((r["file"], r["records"], r["sha256"]) for r in warc.write(p, roll_bytes=1000, part_bytes=20_000)[1].collect()) for p in (pages, pages.orderBy("html"), pages.repartition(7))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 1


def test_op10_archives_of_a_large_table_are_deterministic(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = [sorted((r["file"], r["records"], r["sha256"]) for r in warc.write(p, part_bytes=1 << 20)[1].collect()) for p in (pages, pages.repartition(13))]
    assert found[0] == found[1] and len(found[0]) > 6


def test_op10_many_pages_without_id(spark):
    """Rows without id are spread over parts; equal payloads among them have one response, or revisit the smallest id."""
    rows = [(None, f"u{k}", f"page {k % 150} " + "x" * 200) for k in range(300)] + [(7, "v", "page 0 " + "x" * 200), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, manifest = warc.write(pages, part_bytes=5000)
    assert manifest.count() > 3
    found = warc.read(folder, manifest).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert kinds == {(None, "response", None): 149, (None, "revisit", None): 149, (None, "revisit", 7): 2, (7, "response", None): 1, (9, "response", None): 1}
    again = warc.write(pages.repartition(7), part_bytes=5000)[1]
    assert sorted(manifest.collect()) == sorted(again.collect())


@pytest.mark.parametrize("op", [quality.op1, neardup.op2, html_text.op3, huffman.op4, decontam.op5, secrets.op6, mixing.op7, substrings.op8, sharding.op9, warc.op10])
def test_empty_tables(spark, hollow, op):
    assert op(spark, hollow).count() == 0


def test_clashing_and_extra_columns(spark, tmp_path):
    """General interfaces pass extra columns on, whatever their names, with each row's own values; columns named as results are replaced."""
    import public_tokenizers
    from pyspark.sql import functions as F

    folder = tables(tmp_path)
    taken = ["_words", "_lines", "_common", "_length", "_upper", "_lang", "_by", "class_hist", "word_hist", "_class_ref", "_source", "_key", "_keys", "_a", "_b", "_doc", "_tie", "_spans", "_h", "_block", "_before", "_rank", "_first", "_chunk", "class", "label", "h", "v", "n", "mark", "Doc"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}-"), F.col("extra").cast("string")) for n in taken})
    n = len(hard_documents())
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    for df in (quality.judge(docs), secrets.scan(docs), decontam.scan(docs, bench), mixing.mix(docs).where("epoch = 0"), sharding.shard(docs), substrings.deduplicate(docs)):
        rows = df.select("extra", *taken).collect()
        assert sorted(r["extra"] for r in rows) == list(range(n))
        assert all(r[x] == f"{x}-{r['extra']}" for r in rows for x in taken)
    kept = neardup.keep_first(docs).collect()
    assert 0 < len(kept) < n and all(r[x] == f"{x}-{r['extra']}" for r in kept for x in taken)
    assert quality.judge(docs).schema["kept"].dataType.typeName() == "boolean"
    assert html_text.extract(spark.read.parquet(f"{folder}/pages.parquet").withColumn("_text", F.lit(3))).where("_text = 3").select("record_type", "text").count() == 8
    where, manifest = huffman.write(docs.withColumns({"id": F.lit(1), "ids": F.lit(2), "tie": F.lit(3)}), str(public_tokenizers.path("byte_bpe_50k.json")))
    assert huffman.read(where, manifest).count() == n
    pages = spark.read.parquet(f"{folder}/pages.parquet").withColumns({"sha": F.lit(1), "part": F.lit(2), "kind": F.lit(3), "first": F.lit(4)})
    assert warc.read(*warc.write(pages)).count() == 8
