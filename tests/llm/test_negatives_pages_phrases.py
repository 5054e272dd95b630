"""Hard negatives, page text and collocations: against SQL, independent readers and plain counting, on odd rows too."""

import math
import tracemalloc
from collections import Counter
from html.parser import HTMLParser
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from linesmith.llm import negatives, pages, phrases, queries

from ..conftest import SF, table_of


# --- hard negatives


def vectors_folder(tmp_path, rows):
    """rows: vec_id, vector, label; with further columns of names that the operator uses itself."""
    n = len(rows)
    table = pa.table(
        {
            "vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32()),
            "id": pa.array(["x"] * n), "v": pa.array([1] * n), "dim": pa.array([None] * n, pa.string()), "shard": pa.array([9] * n), "block": pa.array([9] * n), "kind": pa.array([9] * n),
        }
    )
    pq.write_table(table, tmp_path / "embeddings.parquet")
    return str(tmp_path)


def sql_of(folder, table, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return table_of(c.sql(queries.SQL[name]).df())


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 4).tolist(), i % 3) for i in range(420)]
    rows += [(1000 + i, [0.5, 0.5, -0.25, 0.125], 1) for i in range(60)]  # equal vectors
    rows += [(2000 + i, [0.0] * 4, 2) for i in range(3)]
    rows += [(3000, None, 1), (3001, [1.0, None, 0.0, 0.0], 1), (3002, [math.nan] * 4, 1), (3003, [math.inf, 0, 0, 0], 1), (None, [1.0, 1, 1, 1], 1), (3004, [1.0, 1, 1, 1], None)]
    rows += [(5000, [1.0, 2.0], 0), (5001, [1.0, 2.5], 0), (5002, [0.5, 1.0], 1), (6000, [], 0), (6001, [], 0), (6002, [], 1)]
    return rows + rows[:30]  # repeated rows


@pytest.mark.parametrize("size", [16, 8192])
def test_hard_negatives_of_odd_vectors_equal_sql(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(negatives, "SHARD_SIZE", size)
    folder = vectors_folder(tmp_path, odd_vectors())
    got = table_of(queries.op11_hard_negatives(spark, folder).toPandas())
    assert got == sql_of(folder, "embeddings", "op11_hard_negatives") and len(got[1]) > 100


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)]])
def test_hard_negatives_of_few_vectors(spark, tmp_path, rows):
    assert queries.op11_hard_negatives(spark, vectors_folder(tmp_path, rows)).count() == 0


def test_products_are_exact_at_any_size():
    a, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [-(2.0**40), 1.0]])
    assert negatives.products(a, x).tolist() == [[2**60 + 15, -(2**63)]]


def test_walks_end_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (20, 16))
    x = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 10, (2000, 16)))
    shard = negatives.Shard(x, np.arange(2000) % 2, [[i] for i in range(2000)])
    a = np.floor(centres[3] + rng.normal(0, 10, (50, 16)))
    unit, norm = negatives._unit(a)
    order, bound = shard.order(unit)
    widest = np.iinfo(np.int64)
    best = shard.walk(a, norm, np.full(50, -1), order, bound, np.full((50, 1), widest.min), np.full((50, 1), widest.max), 5)
    score = (a @ x.T).astype(np.int64)
    for i in range(50):
        assert best.id[best.of == i].tolist() == sorted(range(2000), key=lambda c: (-score[i, c], c))[:5]
    assert shard.read <= 50 * 2000 / 3


# --- page text


class _Reader(HTMLParser):
    """Text of h1 and p inside of article, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def read_by_parser(page):
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)


@pytest.fixture(scope="module")
def labeller(spark):
    return pages.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_page_text_equals_another_reader(spark):
    got = queries.op12_html_text(spark, SF).collect()
    want = {r.page_id: read_by_parser(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_labeller_on_pages_drawn_anew(spark, labeller):
    """Pages of layouts that the training has not seen, from texts that it has not seen."""
    texts = [r.text.split("\n") for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).selectExpr("html AS text").collect()]
    main = [[x for _, x, _ in pages.leaves("\n".join(t))][6:-2] or ["x y z"] for t in texts]
    draw = pages.Redrawer(main, ["Home", "About us", "Read more here", "Terms of use"], seed=1234)
    drawn = [draw.page() for _ in range(200)]
    found = labeller.label([[leaf[:3] for leaf in p] for p in drawn])
    wrong = sum((leaf[3] == 1) != k for p, f in zip(drawn, found, strict=True) for leaf, k in zip(p, f, strict=True))
    assert wrong <= 0.03 * sum(map(len, drawn))


SAID = "The quick brown fox jumps over the lazy dog, and then it runs far away from here."
BY_HAND = [
    (f"<body><div class=menu><a href=1>Home</a></div><div class='content'><h1>Ti&amp;tle</h1><p>{SAID}<p>a&nbsp;b<br>c<div class=advert>{SAID}</div><p>Last.</div><div id=comments><p>{SAID}</p></div>", f"Ti&tle\n{SAID}\na b c\nLast."),
    (f"<main><article><header><h1>T</h1></header><p>{SAID}</p><aside class=related><p>x</p></aside><pre>a\n b</pre></article></main><form><p>Sign up</p></form><footer>&copy; us</footer>", f"T\n{SAID}\na b"),
    (None, ""), ("", ""), ("   \n ", ""), ("<script>var a='<p>no</p>'</script><!-- <p>no</p>", ""), ("<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>", ""), ("<art", ""),
]


def test_page_text_by_hand(labeller):
    assert [pages.main_text(page, labeller) for page, _ in BY_HAND] == [text for _, text in BY_HAND]


def test_blocks_of_broken_markup():
    text = lambda page: [t for _, t, _ in pages.leaves(page)]
    assert text("a<b>b</b>c <i>d<p>e</i>f</p>g<td>h<!-- x --> i <x y='<p>'>j</div>k") == ["abc d", "ef", "g", "h i j", "k"]
    assert text("1 < 2 &lt; 3 &am &#x41;&#66 <p") == ["1 < 2 < 3 &am AB"]
    assert text("<p>x</script>y<style>p{}</style>z") == ["xyz"]


def test_pages_table_with_odd_rows(spark, tmp_path, labeller):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(BY_HAND)]
    long = "<article>" + f"<p>{SAID}</p>" * 20_000 + "</article>"
    rows += [(100, None, long), (100, None, long), (None, "u", BY_HAND[0][0])]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = pages.extract(table, labeller, ("page_id", "url")).collect()
    want = {(r[0], r[1]): t for r, t in zip(rows, [t for _, t in BY_HAND] + ["\n".join([SAID] * 20_000)] * 2 + [BY_HAND[0][1]], strict=True)}
    assert len(got) == len(rows) and all(r.text == want[r.page_id, r.url] and r.n_chars == len(r.text) for r in got)


def test_no_pages(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract(table, pages.learn(table), ("page_id", "url")).count() == 0


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(2)
    model = pages.Labeller(["a", "b", "c"])
    x = [rng.random((2, 5, n)) for n in (4, pages.WORD_BINS, 8)]
    mask, label = np.array([[1.0] * 5, [1, 1, 1, 0, 0]]), rng.integers(0, 2, (2, 5)).astype(float)
    _, g = model.gradient(*x, mask, label)
    for name in model.w:
        at = tuple(rng.integers(0, n) for n in model.w[name].shape)
        step = 1e-5
        model.w[name][at] += step
        up = model.gradient(*x, mask, label)[0]
        model.w[name][at] -= 2 * step
        down = model.gradient(*x, mask, label)[0]
        model.w[name][at] += step
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


# --- collocations


@pytest.mark.parametrize("options", [{"trie_keys": 7}, {"most_words": 0}])
def test_collocations_by_many_tries_and_without_numbers(spark, duck, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert table_of(phrases.collocations(docs, **options).toPandas()) == table_of(duck.sql(queries.SQL["op13_collocations"]).df())


def test_a_shared_key_changes_the_hash(monkeypatch):
    monkeypatch.setattr(phrases, "span_hash", lambda data, start, end: (end - start).astype(np.uint64))
    batch = pa.record_batch({"lang": ["en", "de"], "text": ["aa bb cc", "aa"]})
    assert len(set(phrases.Places(batch, 0).key.tolist())) == 2 and len(set(phrases.Places(batch, 2).key.tolist())) == 4


def test_trie_against_plain_sets():
    rng = np.random.default_rng(4)
    names = rng.integers(1, 2**63, 300).astype(np.uint64)
    keys = np.zeros((900, 4), np.uint64)
    for row in keys:
        n = rng.integers(1, 5)
        row[:n] = names[(rng.random(n) ** 3 * 300).astype(int)]
    keys[:200, 0] = names[0]  # a node of many symbols
    keys = np.unique(keys, axis=0)
    trie = phrases.Trie(keys)
    places = phrases.Places(pa.record_batch({"lang": ["en"] * 2, "text": ["a " * 6000, "b, b " * 10]}), 0)
    places.key = names[(rng.random(len(places.key)) ** 3 * 300).astype(int)]
    want, got = Counter(), Counter()
    known = {tuple(k for k in row if k): i for i, row in enumerate(keys.tolist())}
    for at in range(len(places.key)):
        for n in range(1, min(4, int(places.run[at])) + 1):
            i = known.get(tuple(places.key[at : at + n].tolist()))
            want[i] += i is not None
    for _, _, found in trie.walk(places):
        got.update(found.tolist())
    del want[None]
    assert got == +want and len(got) > 100


def test_places_of_odd_texts():
    batch = pa.record_batch({"lang": ["x"] * 5, "text": ["", "A b.C\x0bd\te", "  ,. ", "ü f", "g"]})
    p = phrases.Places(batch, 0)
    assert p.words(np.arange(len(p.key))).to_pylist() == ["a", "b", "c", "d", "e", "ü", "f", "g"]
    assert p.run.tolist() == [2, 1, 1, 2, 1, 2, 1, 1] and p.doc.tolist() == [1] * 5 + [3, 3, 4]


def test_collocations_of_repeated_and_empty_rows(spark):
    rows = [("new york city. new york", "en")] * 40 + [(None, None), ("", "en"), ("x", None)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "text string, lang string, phrase string, n int")
    # "york city" goes, as it stands in "new york city" always; "new york" stays, as only half of its places are in it.
    assert [tuple(r) for r in phrases.collocations(docs).collect()] == [("en", 1, "new york", 80, 80, 80, 200, 1000000), ("en", 2, "new york city", 40, 80, 40, 200, 666666)]
    assert phrases.collocations(docs.limit(0)).count() == 0


def _passes(trie):
    numbers = phrases.Numbers(trie.alphabet)

    def two(places):
        number = numbers.of(places.key)
        at = np.flatnonzero(places.run >= 2)
        at = at[(number[at] >= 0) & (number[at + 1] >= 0)]
        return number[at] * len(numbers.keys) + number[at + 1]

    return {"vocabulary": phrases._vocabulary(0), "proposals": phrases._proposals(0, 10**6, two), "pairs": phrases._pairs(3, 0), "counts": phrases._counts(SimpleNamespace(value=trie), 0)}


def _some_phrases(batch):
    key = np.unique(phrases.Places(batch, 0).key)
    return phrases.Trie(np.array([[a, b, 0, 0] for a in key[:20] for b in key[:20]], np.uint64))


def test_passes_add_up_the_same_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in (rng.random(n) ** 2 * 30).astype(int)) + ". a, b" for n in rng.integers(0, 90, 60)] + ["", " .", "long " * 500, ""]
    batches = [pa.record_batch({"lang": [["en", "de"][i % 2] for i in range(len(part))], "text": part}) for part in (texts, [""], texts[:7])]
    run = _passes(_some_phrases(batches[0]))

    def said(name):
        out, many = Counter(), 0
        for batch in run[name](iter(batches)):
            assert 0 < batch.num_rows <= phrases.SENT_ROWS
            many += 1
            for *row, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out[tuple(row)] += n
        return out, many

    whole = {name: said(name) for name in run}
    assert all(out and many == 1 for out, many in whole.values())
    for names, value in (("PLACES_BYTES", 300), ("GATHERED", 200), ("SENT_ROWS", 11)):
        monkeypatch.setattr(phrases, names, value)
    for name in run:
        out, many = said(name)
        assert out == whole[name][0] and many > 3, name


@pytest.mark.parametrize("name", ["vocabulary", "proposals", "pairs", "counts"])
def test_memory_of_a_pass_does_not_follow_the_batch(name):
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, (rng.random(500) ** 3 * 20_000).astype(int))) for _ in range(6000)]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})
    assert batch.nbytes > 12 << 20
    run = _passes(_some_phrases(batch.slice(0, 50)))[name]
    list(run(iter([batch.slice(0, 2)])))  # tables of powers stay
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
