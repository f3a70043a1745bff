"""Small tables for the tests: the generated ones at the smallest scale, and hand-made hard cases."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

WORDS = [f"word{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def hard_documents() -> list[dict]:
    """Nulls in every column, empty, wordless and very long texts, ties, repeated rows, near copies."""
    a, b = prose(1, 120), prose(2, 300)
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, a + " tail", "en", None), (4, None, None, "s2"), (5, "", "fr", "s2"),
        (6, " \n\t ", "de", "s2"), (7, "one", "es", "s3"), (8, "One", "xx", "s3"), (9, b, "en", "s1"), (9, b, "en", "s1"),
        (10, b.upper(), None, "s1"), (11, prose(3, 30_000), "fr", "s1"), (12, "é" * 300 + " " + a, "fr", "s1"), (13, "a b c " * 90, "en", "s1"),
        (14, "line one\n" * 40, "en", "s4"), (None, prose(4, 60), "en", "s1"), (16, "   \x1c x\x85y " + b[:500], "en", "s1"),
        (17, "password = hunter2hunter2 AKIA" + "Z9" * 10 + " " + "deadbeef" * 5 + ' "token": "short"', "en", "s1"),
        (18, 'Api-key secret: "abcd.efgh+1" API_KEY:' + "q" * 50 + "f" * 40, "de", "s1"), (19, "x" * 5000, "en", "s1"), (20, "x" * 5000, "en", "s2"),
    ]
    return [{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": None if t is None else len(t), "kept": "clash", "n_words": 7, "extra": k} for k, (i, t, lang, s) in enumerate(rows)]


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("extra", pa.int64())])
PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.int64()), ("record_type", pa.string())])
ITEM_SCHEMA = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("n_hit", pa.int64())])


def put(folder, name: str, rows: list[dict], schema: pa.Schema) -> None:
    pq.write_table(pa.Table.from_pylist(rows, schema), f"{folder}/{name}.parquet")


def tables(folder, empty: bool = False) -> str:
    """A folder of hard ``documents``, ``benchmark`` and ``pages`` (or empty ones)."""
    docs = [] if empty else hard_documents()
    passage = prose(2, 300).split()
    items = [{"item_id": 1, "text": " ".join(passage[20:45]), "n_hit": 1}, {"item_id": 2, "text": "nowhere to be found in all of these texts at any time"}, {"item_id": 3, "text": "one"}, {"item_id": 4, "text": None}, {"item_id": 5, "text": "!!"}, {"item_id": None, "text": "x"}, {"item_id": 10, "text": " ".join(passage[30:41])}]
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; tail</h1><p>First  para\ngraph with <b>bold</b> text.</p><p>Second.</p></article><footer>Foot</footer></body></html>"
    pages = [{"page_id": 1, "url": "http://a/1", "html": page, "text": 5}, {"page_id": 2, "url": None, "html": page}, {"page_id": 3, "url": "http://a/3", "html": None}, {"page_id": 4, "url": "http://a/4", "html": ""}, {"page_id": 4, "url": "http://a/4", "html": ""}, {"page_id": 5, "url": "http://a/5", "html": "<p>small"}, {"page_id": 6, "url": "http://a/5 é", "html": "<p>small"}, {"page_id": 7, "url": "http://a/7", "html": "<body>" + "<p>" + prose(9, 40) + "</p>" * 3 + "é" * 50_000}]
    put(folder, "documents", docs, DOC_SCHEMA)
    put(folder, "benchmark", [] if empty else items, ITEM_SCHEMA)
    put(folder, "pages", [] if empty else pages, PAGE_SCHEMA)
    return str(folder)


def read(folder: str, name: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def rows_of(df, *order) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
