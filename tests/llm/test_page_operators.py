"""Pages, archives, conversations, vectors and the pipeline."""

import hashlib
import io
import itertools
import random
import struct
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from sightline.llm import ann, chat, queries, warc, wrappers
from tests.oracle import connect, rows_of, rows_of_sql

PAGE = "page_id long, url string, html string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "old") for i, (u, h) in enumerate(rows)], PAGE)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = queries.queries()[name](spark, sf)
        assert rows_of(df) == rows_of_sql(connect(sf), queries.oracle_sql()[name], df.columns)


# --- main text -------------------------------------------------------------------------------------------------------

SHELL = "<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>{}<aside><p>side</p></aside><footer>&copy; us</footer></body></html>"


def test_main_text(spark):
    article = "<article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three<br>four<p>five<script>var t='</p>'</script><div class='ad-box'><div>buy</div></div><ul><li>x<li>y</ul><!-- no --><form><p>q</p></form></article>"
    plain = "<div id=main-column><h2>T</h2><p>" + "long text " * 30 + "</p></div><div class='user comments'><p>" + "so true " * 60 + "</p></div><div class='cookie-notice'>ok?</div>"
    rows = [
        ("http://a.example/1", SHELL.format(article)), ("http://a.example/2", SHELL.format(article.replace("<h1>", "<h1> ").replace("five", "six"))), ("http://b.example/1", SHELL.format(plain)),
        (None, None), ("", ""), ("not a url", "<p>only"), ("http://c.example/", "<div>" * 3000 + "deep"), ("http://c.example/", "x" * 200_000), ("http://c.example/2", "<nav>menu"), ("http://a.example/1", SHELL.format(article)),
    ]
    got = {r["page_id"]: r for r in wrappers.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[0]["text"] == "A & B\nOne two three four\nfive\nx\ny" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "A & B\nOne two three four\nsix\nx\ny" and got[9]["text"] == got[0]["text"]
    assert got[2]["text"] == "T\n" + ("long text " * 30).strip()
    assert [got[i]["text"] for i in (3, 4, 8)] == ["", "", ""] and got[5]["text"] == "only" and got[6]["text"] == "deep"
    assert wrappers.extract(pages(spark, rows).limit(0)).count() == 0


def wrapper(*sources):
    out = wrappers.Page(sources[0]).wrapper
    for x in sources[1:]:
        out = out.align(wrappers.Page(x).wrapper)
    return out


def test_wrappers_have_groups_and_slots():
    """Optional and repeated groups, template strings (=) and slots (#), whatever the order of alignment."""
    a, b, c = "<body><div><p>a<p>b<p>c</div></body>", "<body><div><h2>t</h2><p>a</div></body>", "<body><div><h2>t</h2><p>x</p></div>end</body>"
    assert wrapper(a).pattern() == "<body><div>(<p>#</>)+</></>"
    assert wrapper(a, b).pattern() == wrapper(b, a).pattern() == "<body><div>(<h2>#</>)?(<p>#</>)+</></>"
    assert {wrapper(*x).pattern() for x in itertools.permutations((a, b, c))} == {"<body><div>(<h2>=</>)?(<p>#</>)+</>(#)?</body>".replace("</body>", "</>")}
    # siblings that come in both orders
    assert wrapper("<div><h2>t</h2><p>a</div>", "<div><p>b</p><h2>u</h2></div>").pattern() == "<div>((<h2>#</>)?(<p>#</>)?)+</>"
    assert wrappers.Wrapper.loads(wrapper(a, b, c).dumps()).dumps() == wrapper(a, b, c).dumps()


def test_rare_paths_and_strings_are_forgotten(monkeypatch):
    monkeypatch.setattr(wrappers, "MANY_PATHS", 40)
    monkeypatch.setattr(wrappers, "MANY", 20)
    monkeypatch.setattr(wrappers, "RARE", 0.1)
    text = "varying text " * 5
    w = wrapper(*[f"<body><div class=c{i}x><p>{text}{i}</div><p>fixed</body>" for i in range(60)])
    assert len(w.key) <= 41 + 3 and all(len(s) <= 21 for s in w.strings) and w.pages == 60
    assert sum(c[3] for c in w.counts) == sum(len(f"{text}{i}") + 5 for i in range(60))
    assert [h for hs in w.root()[1] for h in hs] == [wrappers.digest(w.path[w.at[w.at[1, "p"], "#"]], "fixed")]


LONG = "words of this page that no other has "


def boilerplate(k, n=1):
    own = " ".join(f"{LONG}{k}-{j}" for j in range(n))
    return f"<body><div><p>Welcome to the journal of long and constant greetings, which is read by many.</div><div><p>{own}<p>All rights reserved by those who had them before.</div></body>", own


def test_alignment_tells_template_text(spark):
    """Without the host's other pages the unclassed greetings are part of the text; a wrapper drops them."""
    sources = [boilerplate(k) for k in range(5)]
    rows = [("http://h.example/", h) for h, _ in sources] + [("http://alone.example/", sources[0][0])]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(spark, rows)).collect()}
    assert [got[k] for k in range(5)] == [own for _, own in sources]
    assert got[5].startswith("Welcome") and got[5].endswith("before.")
    inside = [f"<body><article><p>Read this first.<p>{LONG}{k}<p>Share it.</article></body>" for k in range(5)]
    found = wrappers.reading(wrapper(*inside))
    assert [wrappers.text_of(wrappers.Page(h), found) for h in inside] == [f"{LONG}{k}" for k in range(5)]
    assert wrappers.text_of(wrappers.Page(inside[0]), None) == f"Read this first.\n{LONG}0\nShare it."


def test_copies_and_titles_are_no_template():
    """A host of near copies, or of pages that share a heading which is their title, keeps its texts."""
    copies = [f"<body><article><h1>T</h1><p>{LONG}<p>{LONG}more<p>{k}</article></body>" for k in range(6)]
    found = wrappers.reading(wrapper(*copies))
    assert [wrappers.text_of(wrappers.Page(h), found) for h in copies] == [f"T\n{LONG.strip()}\n{LONG}more\n{k}" for k in range(6)]
    titled = [f"<head><title>Daily news</title></head><body><article><h1>Daily news</h1><p>{LONG * 9}{k}</article></body>" for k in range(6)]
    found = wrappers.reading(wrapper(*titled))
    assert wrappers.text_of(wrappers.Page(titled[0]), found) == f"Daily news\n{LONG * 9}0"


def test_container_without_marks():
    """Text above and beside the fullest part is kept, lists of links are not."""
    links = "".join(f"<li><a href=/{i}>link number {i}</a>" for i in range(9))
    page = f"<body><div class=top><ul>{links}</ul></div><div class=content><h1>T</h1><p>lead</p><div class=body><p>{LONG * 20}</div><ul>{links}</ul><ul><li>item</ul></div></body>"
    assert wrappers.text_of(wrappers.Page(page), None) == f"T\nlead\n{(LONG * 20).strip()}\nitem"


@pytest.mark.parametrize("page", ["<div>" * 5000 + "deep text", "<ul>" + "<li><ul>" * 2000 + "<li>deep text", "<body>" + "".join(f"<p class=k{i}z>t{i}" for i in range(50_000))])
def test_large_pages_take_linear_time(page):
    start = time.time()
    w = wrapper(page, page)
    text = wrappers.text_of(wrappers.Page(page), wrappers.reading(w))
    assert text == "deep text" or text.count("\n") == 49_999
    assert len(wrappers.Wrapper.loads(w.dumps()).key) == len(w.key) and time.time() - start < 60


def test_hot_hosts_and_clashing_names(spark, monkeypatch):
    """Any number of shares, a join of results by shuffle and extra columns of helper names change nothing."""
    sources = [boilerplate(k) for k in range(40)]
    rows = [(k, "http://hot.example/" if k % 4 else f"http://h{k}.example/", h, 1, 2, 3, 4, 5) for k, (h, _) in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, host int, root int, template int, _root int").repartition(7)
    want = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert all(want[k] == own for k, (_, own) in enumerate(sources) if k % 4)
    monkeypatch.setattr(wrappers, "SHARE", 2)
    monkeypatch.setattr(wrappers, "SMALL_BYTES", 0)
    monkeypatch.setattr(wrappers, "HOT", 0.5)
    out = wrappers.extract(df)
    assert out.columns == [*df.columns, "text", "n_chars"]
    assert {r["page_id"]: r["text"] for r in out.collect()} == want


class Plain(HTMLParser):
    """The blocks of the article element by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.out, self.cur, self.inside = [], "", False
        self.feed(source)
        self.close()

    def flush(self):
        if self.inside and self.cur.split():
            self.out.append(" ".join(self.cur.split()))
        self.cur = ""

    def handle_starttag(self, tag, _):
        if tag in wrappers.BLOCKS:
            self.flush()
        self.cur += " " if tag == "br" else ""
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in wrappers.BLOCKS:
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.cur += data


def test_pages_against_their_article(spark):
    """Exactly the blocks of the article, on all pages."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op1_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == "\n".join(Plain(r["html"]).out)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


@pytest.mark.parametrize(
    "body",
    [
        "<div class='layout has-sidebar'><article><p>{0}</p></article></div>", "<div class=no-sidebar><div><p>{0}</p></div></div>", "<div class=page-with-menu><main><p>{0}</p></main></div>",
        "<section class=social-science><p>{0}</p></section>", "<div class=search-result><p>{0}</p><div class=sidebar>menu</div></div>", "<p class=ad>x<p>{0}</p>", "<ul><li class=ad>x<li>{0}</ul>",
        "<svg/><p>{0}</p><svg><text>no</text></svg>", "<form><article><p>{0}</p></article><p>q</p></form>", "<div class=has-comments><article><p>{0}</p></article></div>",
        "<div class='promo-story'><article><p>{0}</p></article></div>", "<div class=related><p>{0}</p></div>", "<article><header><p>{0}</p><nav>menu</nav></header><footer>by</footer></article>",
    ],
)
def test_names_and_implied_ends_keep_the_article(body):
    text = ("long text " * 30).strip()
    page = wrappers.Page(f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{body.format(text)}<div class=comments><article>so true</article></div></body></html>")
    assert wrappers.text_of(page, None) == text and [t for _, t, _ in page.texts] == [text]


# --- archives --------------------------------------------------------------------------------------------------------


def test_revisits_by_brute_force(spark):
    big, small = "<p>" + "é" * 600, "<p>short"
    rows = [("http://x/1", big), ("http://x/2\n", big), (None, None), ("u", ""), ("u", small), ("u", small), ("http://x/3", big), ("v", "z" * 300_000), ("v", "y" * 1000), ("v", "y" * 1000), ("v", "y" * 999), ("v", "y" * 999)]
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark, pages(spark, rows)).collect()}
    for i, (_, h) in enumerate(rows):
        body = (h or "").encode()
        same = [j for j, (_, x) in enumerate(rows) if (x or "").encode() == body]
        top = max(same) if len(body) >= 1000 else i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if top == i else ("revisit", top))
    assert len(got) == len(rows) and warc.archive_round_trip(spark, pages(spark, rows).limit(0)).count() == 0


def test_repeated_pages(spark):
    """A row that occurs twice comes back twice, and an id with two payloads once for each."""
    x, y = "x" * 1500, "y" * 1500
    rows = [(1, "u", x), (1, "u", x), (2, "u", x), (1, "u", y), (3, "u", y), (3, "u", y), (4, "u", "short")]
    got = warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, sha(x), 2), (1, sha(x), 2), (2, sha(x), None), (1, sha(y), 3), (3, sha(y), None), (3, sha(y), None), (4, sha("short"), None)]
    assert sorted(((r["page_id"], r["payload_digest"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)


def test_few_records_have_a_dictionary_too():
    """Where none can be trained, the first records' bytes are the dictionary."""
    for samples in ([b"WARC/1.1 record"] * 3, [b"WARC/1.1"] * 9):
        assert warc.train_dictionary(samples)
    assert warc.train_dictionary([b"one record"]) == b"one record"


def test_payloads_come_back(spark, tmp_path):
    rng = random.Random(0)
    data = [(i, f"u{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), None) for i in range(60)]
    written = warc.write_archives(spark.createDataFrame(data, "record_id long, uri string, payload binary, refers_to long").coalesce(2), f"file://{tmp_path}/w").persist()
    back = {r["record_id"]: r for r in warc.read_archives(written).collect()}
    assert {i: (back[i]["uri"], bytes(back[i]["payload"])) for i in back} == {i: (u, p) for i, u, p, _ in data}


def archive(dictionary, *records):
    packed = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return io.BytesIO(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(packer.compress(r) for r in records))


def test_broken_archives_are_refused():
    good = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").digest(), None)
    assert warc.parse_record(next(iter(warc.read_archive(archive(b"", good)))))["payload"] == b"hello"
    for bad in (good.replace(b"hello", b"hellO"), good + b"x", good[:-5], good.replace(b"WARC/1.1", b"WURC/1.1"), good.replace(b"WARC-Type: response", b"WARC-Type: metadata"), b""):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)
    for raw in (b"", b"1234567", archive(b"", good).getvalue()[8:], archive(b"", good).getvalue()[:-4]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(raw)))


def test_pages_without_an_id(spark):
    """Null ids come back as nulls, in full; a page with an id never refers to one without."""
    big = "z" * 2000
    rows = [(None, "u", big), (None, "v", big), (1, "w", big), (2, "x", big), (None, None, None), (None, "y", "y" * 1500), (None, "y", "y" * 1500)]
    got = warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, u or "", len(h or ""), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, u, h in rows]
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["payload_digest"] for r in got} == {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}


# --- conversations ---------------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no <|im_end|>"), (1, 2, "user", "why"), (2, 0, None, None), (3, 0, "user", ""),
        (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "user", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_pairs(chat.pair_neighbours(chat.gather(turns))).collect()}
    assert got[0]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and got[0]["prompt_turns"] == 1
    r = got[0]
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]] == ["yes<|im_end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["no <\\|im_end|><|im_end|>"]
    assert got[1]["prompt_turns"] == 1 and got[1]["chosen"] == "" == got[1]["rejected"]
    assert got[2]["prompt_turns"] == 0 and got[2]["rejected"] == "" and "alone" in got[2]["chosen"]
    assert got[3]["prompt_turns"] == 1 and got[3]["chosen"] == "" and got[3]["rejected"] != ""
    assert len(got) == 4 and chat.format_pairs(chat.pair_neighbours(chat.gather(turns.limit(0)))).count() == 0


# --- vectors ---------------------------------------------------------------------------------------------------------


def exact(ids, x, q, k):
    s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    order = [i for i in np.lexsort((ids, -np.round(s, 12))) if i != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_neighbours_of_few(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[30:60] = x[0]
    x[7] = 2 * x[8]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(120)]
    odd = [(200, None, 1), (250, [0.0] * 8, 1), (300, [float("nan")] * 8, 1), (350, [1.0] * 3, 1), (400, [None] * 8, 1), (450, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df, k=5, every=10, effort=1e9).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 120, 10))
    for q, found in got.items():
        want = exact(np.arange(120), x.astype(float), q, 5)
        assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], atol=1e-12)
    assert ann.nearest(df.filter("vec_id >= 200")).count() == 0
    assert ann.nearest(df.filter("vec_id in (0, 50, 51)"), effort=1e9).filter("query_id = 0").count() == 2


def recall(x, ids, found, queries):
    """The share of each query's five nearest that were found, by brute force in blocks."""
    out = []
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, g in found.groupby("query_id"):
        at = int(np.searchsorted(ids, q))
        s = unit @ unit[at]
        s[at] = -2
        out.append(np.mean(g["score"].to_numpy() >= np.partition(s, len(s) - 5)[len(s) - 5] - 1e-12))
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
    assert len(out) == queries
    return np.mean(out)


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(d["embedding"]).astype(float), d["vec_id"].to_numpy()
    assert recall(x, ids, queries.op10_nearest(spark, sf).toPandas(), (ids % 50 == 0).sum()) >= 0.9


def test_recall_and_effort_on_clusters(spark, tmp_path):
    """200 000 vectors in clusters: the calibrated effort finds the nearest and visits a small part of the leaves."""
    rng = np.random.default_rng(5)
    n, d = 200_000, 32
    x = (rng.normal(size=(4000, d))[rng.integers(0, 4000, n)] + 0.25 * rng.normal(size=(n, d))).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), f"{tmp_path}/v.parquet", row_group_size=20_000)
    unit = ann.unit_rows(x[rng.permutation(n)[: ann.SAMPLE_ROWS]].astype(float))
    rows = ann.calibrate(unit, n, 5)
    assert rows < 0.1 * n
    found = ann.nearest(spark.read.parquet(f"{tmp_path}/v.parquet"), every=2000).toPandas()
    assert recall(x.astype(float), np.arange(n), found, n // 2000) >= 0.9


def test_shares_of_cells_change_nothing(spark, monkeypatch):
    """Cells dealt in shares of vectors and queries, hits cut down early and short answers asked again."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 6)), rng.normal(size=6) + 1e-3 * rng.normal(size=(600, 6))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, ann.nearest(df, every=10, effort=1e9).collect()))
    for q in range(0, len(x), 300):
        assert [(i, pytest.approx(s, abs=1e-12)) for i, s in exact(np.arange(len(x)), x.astype(float), q, 5)] == [(w[2], w[3]) for w in want if w[0] == q]
    for name, value in (("CELL_ROWS", 300), ("VECTOR_SHARE", 100), ("QUERY_SHARE", 7), ("HITS", 50)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, ann.nearest(df, every=10, effort=1e9).collect())) == want
    # one leaf each can hold too few: such queries visit all
    assert all(n == 5 for n in ann.nearest(df.filter("vec_id < 140"), every=10, effort=1e-9).groupBy("query_id").count().toPandas()["count"])


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages_chain(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert len(c.STAGES) == 5
    for name, stage in c.STAGES[:-1]:
        out = c.materialize(stage(spark, docs, sf), "test")
        assert out.columns == docs.columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0 and 0 < out.count() <= docs.count()
        docs = out
    last = c.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.filter("not round_trip").count() == 0
    bad = docs.join(labels.filter("quality = 0"), "doc_id").count()
    assert bad <= 0.05 * labels.filter("quality = 0").count()
    assert {r["doc_id"] for r in c.run(spark, sf).select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_by_a_plain_version(spark):
    """The decisions of the stages that have a plain form, on what each stage was given."""
    import corpus_pipeline as c
    from tests.llm.test_text_operators import rules, truth

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = c.quality_stage(spark, docs, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in kept.collect():
        n = rules(texts[r["doc_id"]])
        assert n[0] >= 50 and 100 * n[4] <= 50 * n[0]
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    want = truth([t for _, t in rows])
    deduped = {r["doc_id"] for r in c.near_duplicate_stage(spark, kept, sf).collect()}
    assert deduped == {rows[i][0] for i, k in want.items() if i == k}
    assert spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id").isNull()).count() == 0


def odd_documents(spark, sf):
    """The smallest documents with nulls in every column, empty and very long texts, ties, repeated rows and extra columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(r["text"] or "" for r in docs.filter("lang = 'en'").limit(60).collect())
    some = [tuple(r) for r in docs.orderBy("doc_id").limit(12).collect()]
    rows = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, " \n", "en", "s", 2), (10**6 + 3, long, None, "s", len(long)), (None, some[3][1], "en", None, 1), (None, None, None, None, None)]
    made = docs.unionByName(spark.createDataFrame([*rows, *some, some[0], (10**6 + 4, *some[5][1:])], docs.schema))
    return made.withColumns({c: F.lit(1) for c in ("_gone", "gone", "kept", "quality", "lang_pred", "rate", "ids", "label", "class_id", "n_copies")}), 10**6 + 3


def test_stages_on_odd_rows(spark):
    """What each stage says of nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs, long = odd_documents(spark, sf)
    out = {name: [tuple(r) for r in stage(spark, docs, sf).collect()] for name, stage in c.STAGES}
    count = docs.count()
    for name, stage in c.STAGES:
        ids = [r[0] for r in out[name]]
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name != c.STAGES[-1][0]:
            assert stage(spark, docs, sf).columns == c.COLUMNS and 0 < len(ids) <= count
            assert long in ids or name == "mixing to target weights", name  # that one draws, and the long text has toxic parts
    texts = {name: [r[1] for r in rows] for name, rows in out.items()}
    for name in ("quality rules", "language id"):
        assert all(t and t.strip() for t in texts[name]) and len(out[name]) > len(set(out[name])), name  # repeated rows stay
    near = out["minhash near-dedup"]
    assert len([r for r in near if r[0] is not None]) == len({r[0] for r in near} - {None}) and [r[0] for r in near].count(None) == 2
    assert 10**6 + 4 not in [r[0] for r in near] and {10**6, 10**6 + 1, 10**6 + 2} <= {r[0] for r in near}
    assert [r[0] for r in out["mixing to target weights"]].count(None) == 2
    coded = out["sentencepiece encoding"]
    assert len(coded) == count and all(r[-1] for r in coded)


def test_mixing_and_language_stages_by_a_plain_version(spark):
    """The decisions of the stages that learn, from the operators' own figures row by row."""
    import corpus_pipeline as c
    from sightline.llm import langid, mixing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    said = langid.label(docs, model).collect()
    want = set()
    for r in said:
        words = (r["text"] or "").split()
        own = [s["lang"] for s in r["spans"] for w in words[s["start"] : s["end"]] if any(x.isalpha() for x in w)]
        top = max(sorted(set(own)), key=own.count, default="und")
        if top in c.LANGUAGES and own.count(top) >= c.MIN_SHARE * len(own):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in c.language_stage(spark, docs, sf).collect()} == want
    labels = mixing.domains_of(spark.read.parquet(f"{sf}/labels.parquet"))
    mixed = {r["doc_id"]: r for r in mixing.mix(docs, labels, c.TARGETS, limit=c.MAX_RATE).collect()}
    assert {r["doc_id"] for r in c.mixing_stage(spark, docs, sf).collect()} == {i for i, r in mixed.items() if r["n_copies"] > 0}
    assert all(r["n_copies"] == 1 for r in mixed.values() if r["rate"] == 1) and max(r["rate"] for r in mixed.values()) <= 1
