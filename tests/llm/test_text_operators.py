import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import boosting, chat, decontaminate, html_text, quality, weighted_sampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ----------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header class="site-header"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, on this site for many reasons.</p></div>
<div id="wrap"><div class="sidebar"><p>Side, bar, with, many, commas, and a long enough text to score on its own.</p></div>
<div class="post-content"><h1>A &amp; B</h1><p>First paragraph, with commas, and&nbsp;text that is <b>long</b> enough to count for something.
<p>Second &#8212; paragraph, unclosed, with <a href="/x">a link</a>, and more words to read here.<div class="ad">Buy now, cheap, good, best.</div>
<ul><li>One item<li>Two items</ul><form>Name <input name=n> <button>Send</button></form><p>Short.</p></div>
<div class="comments"><p>A reader, says, many, things, in, a, long, comment, with, commas, and so on and on.</p></div></div>
<footer>&copy; site</footer></body></html>"""


def test_page_keeps_the_article_only():
    assert html_text.main_text(PAGE) == (
        "A & B First paragraph, with commas, and text that is long enough to count for something. Second — paragraph, unclosed, with a link, and more words to read here. One item Two items Short."
    )


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""), ("<p>Only one.</p>", "Only one."), ("plain words", "plain words"), ("<nav>menu</nav>", ""), ("<script>x</script>", ""),
        ("<article><p>a  b\n\tc</p><p>&lt;d&gt;</p></article>", "a b c <d>"), ("<article><p>one<br>two</p></article>", "one two"),
        ("<body><article><h1>T</h1><p><b>bold open<br><p>next</p></article><footer>f</footer></body>", "T bold open next"),
        ('<body><div class="page-header"><p>Site, name, and, slogan</p></div><div class="content"><div class="post-header"><h1>T</h1></div><p>Body, text, that is long enough.</p><figure><figcaption>Caption</figcaption></figure></div></body>', "T Body, text, that is long enough. Caption"),
        ("<table><tr><td>left cell text, long<td>right cell text, long</table>", "left cell text, long right cell text, long"),
    ],
)
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    [
        '<body><div class="layout has-sidebar"><p>{}</p></div></body>', '<body><div class="content no-sidebar"><p>{}</p></div></body>', '<body><div class="row hidden-xs"><p>{}</p></div></body>',
        '<body><article class="post comments-open"><p>{}</p></article></body>', "<head><title>T</title><body><p>{}</p></body>", "<head><meta charset=utf-8><p>{}</p>", "<head><title>T</title><div><p>{}</p></div>",
        '<body><div class="layout has-header"><p>{}</p></div></body>', '<body><div id="site-widget"><p>{}</p></div><div><p>Short.</p></div></body>',
    ],
)
def test_main_text_does_not_vanish(html):
    text = "A paragraph, with commas, that is long enough to be the text of the page."
    assert text in html_text.main_text(html.format(text))


LONG = "A paragraph, with commas, that is long enough to be the text of the page. " * 6


@pytest.mark.parametrize(
    "rest",
    ["<ul><li>First, of a list</li></ul>", "<ol><li>First, of a list</li></ol>", "<dl><dt>Term<dd>What it means</dl>", "<pre>x = 1</pre>", "<table><tr><td>cell</td></tr></table>", "<figure><figcaption>Caption</figcaption></figure>",
     "<section><p>One last paragraph of the article, which ends it.</p></section>", "<div><p>One last paragraph of the article, which is longer than the others here, and ends it.</p></div>"],
)
def test_text_beside_the_best_container_stays(rest):
    want = re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", rest)).strip()
    for page in (f"<body><div><p>{LONG}</p></div>{rest}</body>", f"<body><div><div><p>{LONG}</p></div></div>{rest}</body>"):
        assert html_text.main_text(page) == f"{LONG.strip()} {want}"
    links = '<ul><li><a href="/a">Another page</a></li><li><a href="/b">One more</a></li></ul>'
    assert html_text.main_text(f"<body><div><p>{LONG}</p></div>{links}</body>") == LONG.strip()


def test_linked_items_of_an_article_stay():
    page = f'<body><article><p>{LONG}</p><ul><li><a href="/a">Ann Other</a></li><li><a href="/b">A reference</a></li></ul></article></body>'
    assert html_text.main_text(page) == f"{LONG.strip()} Ann Other A reference"


def test_junk_goes_by_its_name():
    text = "A paragraph, with commas, that is long enough to be the text of the page. " * 3
    for name in ("sidebar", "left-sidebar", "ad", "cookieNotice", "widget box", "visually-hidden"):
        assert html_text.main_text(f'<body><div><p>{text}</p></div><div class="{name}"><p>Other, words, of some length, that nobody reads.</p></div></body>') == text.strip()


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "u", "<p>long " + "word " * 50_000 + "</p>", "z")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.count() == 3 and {r.n_chars for r in got.collect()} >= {0, 5 + 5 * 50_000 - 1}
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert html_text.extract_pages(got.limit(0).select("page_id", "url", F.col("text").alias("html"))).count() == 0


def test_deep_pages_do_not_exhaust_the_stack():
    assert html_text.main_text("<div>" * 5000 + "<p>deep text, here</p>") == "deep text, here"


# -------------------------------------------------------- decontamination

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short item!"), (3, None), (4, "..."), (2, "short  ITEM"), (None, "no id item"), (10, "é" * 3 + " 12a")]
TEXTS = ["ONE two, three four five-six seven eight nine ten eleven twelve thirteen x", "a short item; short item", "shortitem", "no id item here", "x ééé 12A y", "two three four five six seven eight nine ten eleven twelve thirteen fourteen."]


def brute_contamination(text, items, size=13):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            part = w[k : k + size]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_contamination_against_brute_force(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # small: several automata one after another
    docs = odd.select("doc_id", "text", "score").union(spark.createDataFrame([(1000 + k, t, 0.0) for k, t in enumerate(TEXTS)], "doc_id long, text string, score double"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    items = [*ITEMS, (77, texts[30][1]), (78, texts[31][1])]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), spans=True, carry=["doc_id", "text"]).collect()
    assert sorted(repr((r.carried.doc_id, (r.n_words, r.n_hit, list(r["items"])))) for r in got) == sorted(repr((d, brute_contamination(t, items))) for d, t in texts)
    for r in got:
        words = sum(len(WORD.findall(r.carried.text[s.begin : s.end].translate(LOWER))) for s in r.spans)
        assert words == r.n_hit


def test_contamination_without_rows(spark, odd, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, nothing).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, nothing).count() == 0


# ------------------------------------------------------ weighted sampling


def bag(text):
    words = (text or "").lower().split()
    return collections.Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else collections.Counter(words)


def jaccard(a, b):
    a, b = bag(a), bag(b)
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


@pytest.mark.parametrize("range_rows", [2000, 5])
def test_edits_and_likeness(odd, monkeypatch, range_rows):
    monkeypatch.setattr(weighted_sampling, "RANGE_ROWS", range_rows)
    w = weighted_sampling
    got = w.fingerprints(odd).select("doc_id", "text", "edited", w.likeness(F.col("sig"), F.col("edited_sig")).alias("a"), w.likeness(F.col("sig"), F.col("next_sig")).alias("b"), w.as_text(F.col("sig")).alias("f")).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    prints = {}
    errors = []
    for k, (r, (doc_id, text)) in enumerate(zip(got, rows, strict=True)):
        other = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        assert (r.doc_id, r.text, r.edited) == (doc_id, text, edited)
        assert prints.setdefault(text, r.f) == r.f and 0 <= r.a <= 1 and 0 <= r.b <= 1
        errors += [r.a - jaccard(text, edited), r.b - jaccard(text, other)]
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.15


def test_collision_rate_is_the_weighted_jaccard(spark):
    """Many pairs of one known likeness: weights 3 and 1 against 1 and 1 of shared terms, and terms of their own."""
    rows = []
    for k in range(300):
        a = " ".join(f"{k}x{i} {k}y{i} | " * 3 for i in range(40))
        b = " ".join(f"{k}x{i} {k}y{i} | " for i in range(40))
        rows.append((k, a, b))
    w = weighted_sampling
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.select("a", "b", w.likeness(w.signature(F.col("a")), w.signature(F.col("b"))).alias("x")).collect()
    want = np.mean([jaccard(r.a, r.b) for r in got])
    assert abs(np.mean([r.x for r in got]) - want) < 0.02


@pytest.mark.parametrize(("heavy", "other", "shared", "own"), [(1000, 1000, 0, 100), (200, 20, 62, 0), (300, 100, 20, 40)])
def test_likeness_holds_for_one_heavy_term(spark, heavy, other, shared, own):
    """One word pair occurs far more often than the others, which occur once in both texts or in one."""
    rows = []
    for k in range(40):
        both = " ".join(f"{k}s{i}" for i in range(shared))
        texts = [" ".join([f"{k}h"] * (n + 1) + [both] + [f"{k}{side}{i}" for i in range(own)]) for n, side in ((heavy, "a"), (other, "b"))]
        rows.append((k, *texts))
    w = weighted_sampling
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.select("a", "b", w.likeness(w.signature(F.col("a")), w.signature(F.col("b"))).alias("x")).collect()
    want = np.mean([jaccard(r.a, r.b) for r in got])
    assert abs(np.mean([r.x for r in got]) - want) < 0.05


def test_sampling_is_native(odd):
    plan = weighted_sampling.fingerprints(odd)._jdf.queryExecution().toString() + chat.rotate(odd.select(F.col("doc_id").alias("conv_id"), F.col("part").alias("turn"), F.col("lang").alias("role"), "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sampling_of_nothing(empty):
    assert weighted_sampling.fingerprints(empty).count() == 0


# ------------------------------------------------------------------ chat

TALK = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"), (1, 2, "bob", "yo é"), (1, None, None, None), (2, 0, "system", "alone"), (None, 1, "", "x"), (1, 5000, "ann", "late")]


def brute_rotation(rows):
    said = [(c, t, s or "unknown", x or "") for c, t, s, x in rows]
    out = []
    for conv in {r[0] for r in said}:
        turns = sorted((r for r in said if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for who in {r[2] for r in turns} - {"system"}:
            at = 0
            for c, t, s, x in turns:
                role = "system" if s == "system" else "assistant" if s == who else "user"
                head = f"<|im_start|>{role}" + (f" name={s}" if role == "user" else "") + "\n"
                text = f"{head}{x}<|im_end|>\n"
                own = role == "assistant"
                out.append((c, who, t, role, s if role == "user" else None, text, at + len(head) if own else None, at + len(text) if own else None, at, at + len(text)))
                at += len(text)
    return sorted(out, key=repr)


def test_rotation(spark, odd):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1))
    assert sorted((tuple(r) for r in chat.rotate(df).collect()), key=repr) == brute_rotation(TALK)
    assert chat.rotate(df.limit(0)).count() == 0


def test_rotation_of_one_long_conversation(spark):
    rows = [(1, k, f"s{k % 3}", f"text {k}") for k in range(3000)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_rotation(rows)


# --------------------------------------------------------------- quality


def test_trees_learn_a_rule_and_traverse_like_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], trees=40)
    assert ((model.probability(x[2000:]) > 0.5) == (y[2000:] == 1)).mean() > 0.97
    for row, raw in zip(x[:50], model.raw(x[:50]), strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert total == pytest.approx(raw)


def test_trees_without_two_classes():
    model = boosting.fit(np.zeros((5, 3)), np.ones(5))
    assert model.probability(np.zeros((2, 3))) == pytest.approx([6 / 7] * 2)
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((1, 3))) == pytest.approx([0.5])


def test_scores_of_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(100, 160)] + [(None, 1, 0), (101, None, 1)], "doc_id long, quality int, score int")
    model = quality.train(odd, labels)
    got = quality.with_score(odd, model)
    assert got.columns == [*(c for c in odd.columns if c != "score"), "score"] and got.count() == odd.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.with_score(empty, model).count() == 0
    assert quality.train(empty, labels).probability(np.zeros((1, quality.WIDTH))) == pytest.approx([0.5])
    again = quality.train(odd.repartition(7), labels)
    assert np.array_equal(again.threshold, model.threshold) and np.array_equal(again.value, model.value)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.with_score(docs, quality.train(docs, labels)).where(quality.is_held_out()).join(labels, "doc_id")
    assert scored.agg(F.avg((quality.predicted() == F.col("quality")).cast("double"))).first()[0] > 0.9


def test_empty_hash():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_grouped_signatures_are_the_expression(odd):
    w = weighted_sampling
    rows = odd.select(F.monotonically_increasing_id().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.union(odd.sparkSession.createDataFrame([(10**9, "a " * 500 + "b"), (10**9 + 1, " \n"), (10**9 + 2, "A"), (10**9 + 3, "é x y")], "k long, text string"))
    want = {r.k: r.s for r in rows.select("k", w.signature(F.col("text")).alias("s")).collect()}
    assert {r.k: r.sig for r in w.signatures(rows, ["k"], "text").collect()} == want
    assert want[10**9 + 1] == [] and len(want[10**9]) > 20


@pytest.mark.parametrize("ids", [range(3000), [7] * 600 + list(range(100)), [k * 10**12 for k in range(-600, 600)], [None] * 300 + [1]])
def test_ranges_keep_order_and_neighbours(spark, ids):
    w = weighted_sampling
    docs = spark.createDataFrame([(i, f"t{k:05d}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    rows, n = w._ranges(docs)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.range) for r in rows.collect())
    seen = [g[3] for g in got]
    assert seen == sorted(seen) and set(seen) == set(range(n))
    assert n == 1 or len(set(ids)) < 200 or max(map(seen.count, set(seen))) < len(ids) / 4
    led = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in w._beside_next(docs).collect())
    assert [x[3] for x in led] == [x[2] for x in led[1:] + led[:1]]
