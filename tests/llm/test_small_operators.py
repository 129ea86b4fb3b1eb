"""Chat, language, toxicity, HTML, top-k and sharding on small inputs: properties, brute force, odd rows."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from spanward.llm import chat, html, language, queries, sharding, topk, toxicity

ODD = [(1, None, "x"), (2, "", "y"), (3, " ", "z"), (None, "Ein Wort", "z"), (5, "Ein Wort", "z"), (5, "Ein Wort", "z"), (6, "long " * 5000, "z")]


def docs_of(spark, rows=ODD):
    """Documents with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    return df.selectExpr("doc_id", "text", "n", "n AS doc_key", "n AS fp", "n AS held_out", "n AS shard", "n AS size", "'en' AS lang", "n AS score")


# -- chat ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    parts = ["### ", "### Assistant: ", "</turn>", "</turn>\n", "</role>", "\\", "#", "<", "a", "\n", "### Role ", "😀", ""]
    random.seed(4)
    roles = ["user", "assistant", "system", "tool", "a\nb</role>", "", None]
    rows = [
        (c, t, random.choice(roles), "".join(random.choice(parts) for _ in range(random.randint(0, 7))) if random.random() < 0.9 else None)
        for c in range(40) for t in range(random.randint(1, 6))
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("segments")).alias("loss"), "formatted", "segments")
    for r in read.collect():
        want = [(role or "", text or "") for c, _, role, text in sorted(rows, key=lambda x: x[1]) if c == r.conv_id]
        assert [tuple(x) for x in r.t] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert "".join(r.formatted[s.start : s.start + s.length] for s in r.segments) == r.formatted


def test_chat_order_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [
        (1, 0, "system", "s", "x"), (1, 1, "user", "u", "x"), (1, 2, "assistant", "a", "x"), (2, 0, "user", "u", "x"), (2, 1, "user", "u", "x"),
        (3, 0, "assistant", "a", "x"), (4, 0, "user", "u", "x"), (4, None, "user", "first", "x"), (None, 0, "user", None, "x"), (5, 1, "user", "u", "x"),
        (5, 2, "assistant", "a", "x"), (5, 2, "assistant", "a", "x"),
    ]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: False}
    assert got[5].n_turns == 3 and got[5].loss_chars == 2
    assert got[4].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\nu\n").hexdigest()
    empty = spark.createDataFrame([], schema)
    assert chat.digests(chat.format_chats(empty)).count() == 0


def test_chat_query_equals_sql(spark, data):
    df = queries.QUERIES["op1_chat_formatting"](spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    cur = con.execute(queries.ORACLES["op1_chat_formatting"])
    columns = [c[0] for c in cur.description]
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, cur.fetchall())
    assert df.where("conv_id = -7").count() == 1


# -- language ------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, data):
    got = queries.QUERIES["op2_language_id"](spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert got.count() == truth.count() and got.where("score < 0 OR score > 1").count() == 0


def test_language_counts_and_odd_rows(spark):
    doc, gram, n = language.gram_counts(["Ab ab", "", "é1é"], np.arange(3))
    code = lambda s: sum(ord(c) << 21 * (2 - i) for i, c in enumerate(s))
    got = {(int(d), int(g)): int(k) for d, g, k in zip(doc, gram, n)}
    want = {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, code(s)): v for s, v in want.items()}
    assert got[(2, code("é"))] == 2 and got[(2, code(" é "))] == 2 and not [k for k in got if k[0] == 1]
    profiles = language.learn_profiles(spark.createDataFrame([("das ist ein Wort", "de"), ("this is the word", "en"), ("x", None)], "text string, lang string"))
    rows = language.identify(docs_of(spark), profiles).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.lang_pred for r in rows} == {1: "und", 2: "und", 3: "und", None: "de", 5: "de", 6: rows[-1].lang_pred}
    assert {r.lang_pred for r in language.identify(docs_of(spark), {}).collect()} == {"und"}
    assert language.identify(docs_of(spark).limit(0), profiles).count() == 0


# -- toxicity ------------------------------------------------------------------------------


def toxic_table(spark):
    random.seed(9)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = [random.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text[random.randrange(60)] = random.choice(["dolt", "grumpnase", "grumpling", "grumpkopf"])
        rows.append((i, " ".join(text) + ".", "z"))
        labels.append((i, int(toxic)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_words_and_stems(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.train(docs, labels)
    assert "dolt" in model.lexicon.words and "grump" in model.lexicon.stems
    rows = toxicity.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and 470 <= kept.count() <= 490


def test_toxicity_contexts(spark):
    model = toxicity.Lexicon({"dolt": (50, 0)}, {}, 60, 1000)
    sums = dict(zip(("threat", "reported", "negated", "targeted", "plain"), [[]] * 5))
    grammar = toxicity.Grammar(model)
    for text, context in [
        ("a dolt.", "plain"), ("you are a dolt", "targeted"), ("it is not a dolt", "negated"), ("somebody said: such, reported a dolt", "reported"),
        ("kill you dolt", "threat"), ("dolt, you", "plain"), ("not this is in truth a dolt", "plain"),
    ]:
        values = grammar.sums(text)[:5]
        assert [c for c, v in zip(sums, values) if v > 0] == [context], text


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (None, 1), (6, None), (7, 3)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark), labels)
    rows = toxicity.score(docs_of(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.train(docs_of(spark).limit(0), labels.limit(0))
    assert toxicity.score(docs_of(spark).limit(0), none).count() == 0


# -- html ----------------------------------------------------------------------------------

PAGES = [
    ("<p>a</p><p>b &amp; c<br>d</p>", "a\n\nb & c d"),
    (
        "<html><head><title>T</title></head><body><nav><a href=x>m</a></nav><div class='ad'>buy</div><article><h1>H</h1><p><b>Long text here<br>"
        "<p>short<p>more text <i>in</i> it</article><aside>side</aside><section id=comments><article class=comment><p>nice post</p></article></section><footer>&copy; f</footer>",
        "H\n\nLong text here\n\nshort\n\nmore text in it",
    ),
    (
        "<body><div id=header><a>home</a></div><div class=content><p>One two three four five six seven eight.</p><ul><li>x</li><li>y</li></ul><p>end of it all</p></div>"
        "<div class='sidebar'><p>some links here of others and others</p></div><form><p>mail</p></form></body>",
        "One two three four five six seven eight.\n\nx\n\ny\n\nend of it all",
    ),
    ("<nav><ul><li>unclosed menu<article><p>the text that matters is here</p></article>", "the text that matters is here"),
    ("<main><p>kept whole</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><p>too</p></main>", "kept whole\n\ntoo"),
    ("<article><p>body of the text</p><div class='cookie-notice'>We use cookies</div><p>rest</p></article>", "body of the text\n\nrest"),
    ("", ""), (None, ""), ("<p>", ""), ("plain text only", "plain text only"), ("<div hidden>x</div>", ""), ("a &lt;b&gt; &#233;&nbsp; c", "a <b> é c"),
]


def test_html_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (want, len(want)), PAGES[i]
    assert html.extract(df.limit(0)).count() == 0
    deep = "<div>" * 3000 + "<p>deep text</p>"
    assert html.main_text(deep) == "deep text" and html.main_text("<p>" + "x" * 500_000) == "x" * 500_000


def test_html_regions_lose_no_part():
    """Parts outside the element with most of the text, and marks on what holds the page."""
    body = "".join(f"<p>A sentence of the body with a number of words, {i}.</p>" for i in range(20))
    text = "\n\n".join(f"A sentence of the body with a number of words, {i}." for i in range(20))
    menu, lead = "<nav><a href=x>menu</a></nav>", "A lead that sums up what the text says in some words."
    top = f"Title of it\n\n{lead}\n\n"
    assert html.main_text(f"<body>{menu}<div><div><h1>Title of it</h1><p>{lead}</p></div><div>{body}</div></div></body>") == top + text
    assert html.main_text(f"<body>{menu}<div>{body}</div><div><p>{lead}</p></div></body>") == f"{text}\n\n{lead}"
    assert html.main_text(f"<body>{menu}<main><h1>Title of it</h1><p>{lead}</p><article>{body}</article></main></body>") == top + text
    for wrapper in ("div class='with-sidebar'", "div class='no-sidebar'", "div id='search-page'", "form action=x", "div class='no-comments'"):
        page = f"<body>{menu}<{wrapper}><div>{body}</div><div class='sidebar'><p>others</p></div></{wrapper.split()[0]}></body>"
        assert html.main_text(page) == text, wrapper
    comments = "<section class='comments'>" + body * 3 + "</section>"
    assert html.main_text(f"<body>{menu}<div>{body}</div>{comments}</body>") == text


def test_html_of_the_tables(spark, data):
    """The generator's pages: the article's blocks, whatever surrounds them."""
    import html as entities
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.QUERIES["op8_html_extraction"](spark, data).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# -- top-k ---------------------------------------------------------------------------------


def brute_top(rows, k):
    vectors = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in vectors), default=0)
    vectors = [(i, np.pad(v, (0, width - len(v)))) for i, v in vectors]
    out = set()
    for q in sorted({i for i, _ in vectors if i % 100 == 0}):
        asked = min((tuple(v) for i, v in vectors if i == q))
        scored = sorted((-int(np.dot(asked, v)), i) for i, v in vectors if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + 3 * rng.random()) * np.array([3.0] * 3 + [0.2] * 9)]) for i in range(700)]
    rows += [(800, rows[3][1]), (801, rows[3][1]), (802, rows[3][1]), (900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")] * 12)]
    rows += [(904, [2.0, 1.0]), (905, []), (None, rows[4][1]), (800, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, norm int").repartition(3)
    small = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SEEDS", 50)
    monkeypatch.setattr(topk, "CHUNK", 3)
    vectors = topk.integer_vectors(df)
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()}
    assert got == brute_top(small, 10)


def test_top_k_over_file_borders(spark, monkeypatch):
    """A block that begins with short vectors and goes on with long ones, and many small files in one task."""
    from types import SimpleNamespace

    import pyarrow as pa

    ids, q = np.array([0]), np.array([[10.0, 0.0]])
    part = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([[1.0, 0.0], [900.0, 0.0]]), pa.array([1.0, 900.0])], ["vec_id", "v", "norm"]
    )
    sent = SimpleNamespace(value=(ids, q, np.array([5000.0]), np.eye(2), 1))
    assert [b.to_pydict() for b in topk._search(sent, 1)(iter([part]))] == [{"query_id": [0], "vec_id": [2], "score": [9000]}]

    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=2 + i % 9) * 4.0 ** rng.integers(0, 5)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "SEEDS", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        vectors = topk.integer_vectors(df)
        got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_top(rows, 10)


@pytest.mark.parametrize("low, high, width", [(1e5, 1e6, 8), (-1e6, 1e6, 8), (1.0, 2e7, 2)])
def test_top_k_of_large_components(spark, low, high, width):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(low, high, width) / (1 if width > 2 else 12)]) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(5)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 10 = 0")).collect()}
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in [i for i in ints if i % 10 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        assert {r[1:] for r in got if r[0] == q} == {(n, i, -s) for n, (s, i) in enumerate(scores, 1)}


def test_products_of_any_size():
    rng = np.random.default_rng(6)
    for bits in (3, 20, 26, 29, 30):
        a, b = (np.floor(rng.uniform(-(2.0**bits), 2.0**bits, (5, 7))) for _ in range(2))
        assert topk.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
    with pytest.raises(OverflowError):
        topk.products(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(df)
    assert [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# -- sharding ------------------------------------------------------------------------------


def test_shards_are_exact_and_gapless(spark):
    df = docs_of(spark, [*ODD, *[(i, f"t{i % 40}", "z") for i in range(10, 330)]]).repartition(5)
    rows = sharding.shuffle_into_shards(df, 8, seed=1).collect()
    assert len(rows) == 327
    by_shard = {j: sorted(r.slot for r in rows if r.shard == j) for j in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    assert sorted(map(len, by_shard.values())) == [40] + [41] * 7
    for r in rows:
        if r.doc_id == 1:
            assert (r.size, r.text_crc32) == (1, 0)
        if r.doc_id == 10:
            assert (r.size, r.text_crc32) == (4, zlib.crc32(b"t10"))
    again = {tuple(r) for r in sharding.shuffle_into_shards(df, 8, seed=1).collect()}
    assert sharding.shuffle_into_shards(df.limit(0), 8).count() == 0 and len(again) >= 320


def test_slots_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    df = docs_of(spark, [(i, f"t{i}", "z") for i in range(200)])
    rows = sharding.shuffle_into_shards(df, 3, seed=2).collect()
    for j in range(3):
        slots = sorted(r.slot for r in rows if r.shard == j)
        assert slots == list(range(len(slots))) and len(slots) in (66, 67)
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert order != sorted(order)


def test_communication_matrix_is_hypergeometric(spark):
    counts = spark.createDataFrame([(0, 3), (1, 5), (2, 4)], "source int, n long")
    first = []
    for seed in range(40):
        m = {r.source: r.counts for r in sharding.communication_matrix(counts, 2, seed).collect()}
        assert [sum(c) for c in zip(*m.values())] == [6, 6] and [sum(m[i]) for i in range(3)] == [3, 5, 4]
        first.append(m[0][0])
    # three of twelve into six: mean 1.5, variance 0.61
    assert 1.1 < np.mean(first) < 1.9 and 0.2 < np.var(first) < 1.2
