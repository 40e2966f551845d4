import hashlib
import random
import time

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import functions as F

from rollmeter.llm import bpe, decontam, fingerprint, html, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_fingerprints_against_the_definition(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["ab", "cdé", "x" * 9, "中"]) for _ in range(r.choice([0, 1, 2, 30, 300]))) for _ in range(60)]
    texts[7], texts[20] = texts[8], None
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(r.sample(rows, 60), "doc_id long, text string")).collect()}
    plain = [t or "" for t in texts]
    assert len(got) == 60
    for i, t in enumerate(plain):
        after, x = plain[(i + 1) % 60], got[3 * i]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        root, sketch = fingerprint.sketches([t, changed, after])
        assert [x.fingerprint, x.edited_fingerprint] == fingerprint.text_of(root, sketch)[:2]
        assert np.isclose(x.near_edited, fingerprint.likeness(sketch[:1], sketch[1:2])[0]) and np.isclose(x.near_next, fingerprint.likeness(sketch[:1], sketch[2:])[0])
    assert got[21].fingerprint == got[24].fingerprint


def test_fingerprints_of_repeated_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, "abc def"), (1, "abc def"), (None, "q"), (2, "")], "doc_id long, text string")
    assert fingerprint.fingerprints(df).count() == 4
    one = fingerprint.fingerprints(df.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_ids_are_dealt_by_binary_search(spark):
    bounds = [-5, 0, 3, 3 + 2**40, 2**62]
    df = spark.createDataFrame([(i,) for i in [-9, -5, -4, 0, 1, 3, 4, 2**41, 2**62, 2**63 - 1]], "id long")
    assert [r[0] for r in df.select(fingerprint._below(bounds, F.col("id"))).collect()] == [sum(b < r.id for b in bounds) for r in df.collect()]
    assert df.select(fingerprint._below([], F.col("id")).alias("n")).first().n == 0


def test_phrases_do_not_depend_on_the_offset():
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh ") for _ in range(4000))
    _, s = fingerprint.sketches([t, "zz qq " * 3 + t])
    assert fingerprint.likeness(s[:1], s[1:])[0] > 0.8


def brute_windows(text, item, threshold):
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
    w, q = split(text), split(item)
    k = min(5, len(q))
    grams = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    return q and any(w[i : i + len(q)] == q for i in range(len(w) - len(q) + 1)), grams(w), grams(q)


def test_decontamination_finds_planted_items_and_no_others(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 15, 15, 30, 59, 0, 30])]
    docs, want = [], set()
    for d in range(80):
        words = [r.choice(vocab) for _ in range(r.choice([0, 10, 200]))]
        if d % 3 == 0:
            i, t = items[d % len(items)]
            q = t.split()
            if len(q) > 25 and d % 2:
                q[0] = "edited"
            if q:
                at = r.randint(0, len(words))
                words[at:at] = [x.upper() for x in q]
                want.add((d, i))
        docs.append((d, " , ".join(words)))
    docs.append((80, None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), items[1]], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.find(df, bench).collect()}
    assert set(got) == want
    assert all(0.8 - 1e-9 <= x.similarity <= 1 for x in got.values())
    kept = {x.doc_id for x in decontam.without(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_of_texts_shorter_than_an_item(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(59)]
    items = [(1, " ".join(words)), (2, " ".join(r.choice(words) for _ in range(70))), (3, "one two three")]
    docs = [(1, words[:58]), (2, words[1:]), (3, words[2:]), (4, words[:40]), (5, words[:2]), (6, words[:4]), (7, ["one", "two"]), (8, words)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.find(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (8, 1)}  # 54, 54, 53 and 55 of 55 shingles
    assert [round(got[d, 1].similarity * 55) for d in (1, 2, 3, 8)] == [54, 54, 53, 55]
    assert [(got[d, 1].first_word, got[d, 1].n_words) for d in (1, 2, 3, 8)] == [(0, 58), (0, 58), (0, 57), (0, 59)]
    assert {x.doc_id for x in decontam.without(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {4, 5, 6, 7}


def test_decontamination_does_not_depend_on_the_passes(spark, monkeypatch):
    r = random.Random(10)
    stem = [f"s{i}" for i in range(30)]
    items = [(i, " ".join(stem[: r.choice([0, 8, 30])] + [f"i{i}x{k}" for k in range(r.choice([6, 12]))])) for i in range(40)]
    docs = []
    for d in range(160):
        w = items[d % 40][1].split()
        w[-1 if d % 4 else r.randrange(len(w))] = "edited"
        docs.append((d, " ".join(["before"] * (d % 3) + w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.first_word) for x in decontam.find(df, bench).collect())
    whole = rows()
    monkeypatch.setattr(decontam, "PASS_ITEMS", 7)
    assert rows() == whole and len(whole) > 20


def test_decontamination_in_pieces_and_of_odd_tables(spark, monkeypatch):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([5, 8, 12, 30, 40])]
    docs = []
    for d in range(40):
        words = [r.choice(vocab) for _ in range(r.choice([30, 900]))]
        for _, t in r.sample(items, 2):
            q = t.split()
            q[r.randrange(len(q))] = "edited" if len(q) > 25 else q[0]
            at = r.randint(0, len(words))
            words[at:at] = q
        docs.append((d // 2 if d < 10 else d, " ".join(words), "x"))
    docs += [docs[0], (99, "", "x"), (None, items[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (3, items[4][1]), (None, "a b c d e f"), (8, " "), (9, None)], "item_id long, text string")
    rows = lambda: sorted(((-1 if x.doc_id is None else x.doc_id), x.item_id, round(x.similarity, 9), x.first_word, x.n_words) for x in decontam.find(df, bench).collect())
    whole = rows()
    assert len(whole) >= 15 and (-1, 0, 1.0, 0, 5) in whole
    per_row = {}
    for x in whole:
        per_row.setdefault(x[0], []).append(x[1])
    assert all(per_row[d].count(i) <= 3 for d in per_row for i in per_row[d])  # once for each of at most three rows of an id
    monkeypatch.setattr(decontam, "PIECE_WORDS", 16)
    monkeypatch.setattr(decontam, "PIECE_PAIRS", 64)
    assert rows() == whole
    assert decontam.find(df.limit(0), bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0
    assert decontam.without(df, bench.limit(0)).count() == len(docs)


def test_multi_index_guarantees_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 20).astype(np.uint64)
    group = decontam.Group(9, list(range(20)), [{1: 1.0}] * 20, prints)
    queries = prints[rng.integers(0, 20, 300)].copy()
    for k in range(300):
        for b in rng.choice(64, rng.integers(0, decontam.RADIUS + 1), replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(b)
    w, i, bits = group.within(queries)
    want = {(a, b) for a in range(300) for b in range(20) if np.bitwise_count(queries[a] ^ prints[b]) <= decontam.RADIUS}
    assert set(zip(w.tolist(), i.tolist())) == want


def test_token_counts_add_up(spark):
    texts = ["", "one line", "a  b\n\n c é中\n'tis the\r\nend\n", " \n \n", "x" * 300 + "\n" + "yé" * 50]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    rows = tokencount.attribute(df, PATH).collect()
    own = bpe.load(PATH)
    for d, t in enumerate(texts):
        mine = sorted((x.section, x.start, x.end, x.n_tokens) for x in rows if x.doc_id == d)
        assert sum(x[3] for x in mine) == len(own.encode(t))
        assert "".join(t[a:b] for _, a, b, _ in mine) == t and len(mine) == len(t.splitlines(keepends=True)) if "\r" not in t else True
    assert not [x for x in rows if x.doc_id == 9]


def test_token_counts_of_given_sections(spark):
    text = "alpha beta gamma"
    df = spark.createDataFrame([(1, text, [(0, 7), (6, 99), (3, 3)])], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = {x.section: x for x in tokencount.attribute(df, PATH, "s").collect()}
    assert sum(x.n_tokens for x in got.values()) == len(bpe.load(PATH).encode(text))
    assert (got[1].start, got[1].end) == (7, len(text)) and got[2].n_tokens == 0


def test_token_counts_equal_a_plain_recount(spark):
    r, own = random.Random(4), bpe.load(PATH)
    rows = []
    for d in range(60):
        text = "".join(r.choice(["word", " ", "é", "中文", "\n", "12345", " the", "'s", "𝒳", "!!!"]) for _ in range(r.randint(0, 40)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(2 * r.randint(0, 4)))
        rows.append((d, text, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])] + [None, (None, 3)], "x"))
    df = spark.createDataFrame([*rows, rows[0], (99, None, [(0, 1)], "x"), (98, "a b", None, "x")], "doc_id long, text string, s array<struct<start:long,end:long>>, n_tokens string")
    got = {}
    for x in tokencount.attribute(df, PATH, "s").collect():
        got.setdefault((x.doc_id, x.section), []).append(x.n_tokens)
    for d, text, sections, _ in rows:
        place = [len(text[:i].encode()) for i in range(len(text) + 1)]
        spans = sorted((place[a], place[b], k) for k, (a, b) in enumerate(sections[:-2]) if b > a)
        edges, at = [], 0
        for a, b, k in spans:
            edges += [(at, a, -1), (a, b, k)]
            at = b
        edges.append((at, place[-1], -1))
        want, at = {}, 0
        for i in own.encode(text):
            end = at + len(own.token[i])
            k = max(edges, key=lambda e: (min(end, e[1]) - max(at, e[0]), -e[0]))[2]  # the larger part, then the earlier
            want[k] = want.get(k, 0) + 1
            at = end
        mine = {k: sum(n) // (2 if d == 0 else 1) for (e, k), n in got.items() if e == d}
        assert {k: n for k, n in mine.items() if n} == want
        assert all(mine[k] == 0 for k in (len(sections) - 2, len(sections) - 1)) or not text
    assert got[98, -1] == [2] and (99, 0) not in got or got[99, 0] == [0]
    assert tokencount.attribute(df.limit(0), PATH, "s").count() == 0


def test_html_of_the_given_pages(spark, sf):
    rows = html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert all(r.n_chars == len(r.text) > 0 for r in rows)
    for r in rows:
        ad = regex.search(r'<div class="ad">(.*?)</div>', raw[r.page_id])
        assert not ad or ad[1] not in r.text
        assert "track(" not in r.text and "©" not in r.text


def test_html_cases():
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='content'><h2>Head line</h2>"
        "<p>A long paragraph, with text; more of it, yes. &lt;b&gt; &amp;amp;</p><p>Another  one,\n quite long, too. Fine.<p>Third one, here it is."
        "<script>var a='<p>no</p>'</script></div><div class='sidebar'><p>About us, all.</p></div><section id=comments><p>Great post, thanks! Yes.</p></section>"
        "<form><p>Name</p></form><div class='cookie-notice'>We use cookies, really.</div><footer>bye</footer></body></html>"
    )
    assert html.main_text(page) == "Head line\nA long paragraph, with text; more of it, yes. <b> &amp;\nAnother one, quite long, too. Fine.\nThird one, here it is."
    assert [html.main_text(x) for x in (None, "", "<p", "<!-- a", "just text.")] == ["", "", "", "", "just text."]


def test_html_goes_on_behind_empty_and_unclosed_markup():
    body = "<p>First one, here it is.</p>{}<p>Second one, here it is.</p>{}<p>Third one, here it is.</p>"
    want = "First one, here it is.\nSecond one, here it is.\nThird one, here it is."
    page = lambda *x: html.main_text("<html><body><article>" + body.format(*x) + "</article></body></html>")
    for a, b in (('<svg width="1"/>', "<math/>"), ('<svg class="i" />', "<svg><text>no</text></svg>"), ("<svg>", ""), ("<math>", ""), ("<template>", ""), ("<noscript>", ""), ("<svg/>", "<svg>no</svg>")):
        assert page(a, b) == want
    assert page("<script>", "") == "First one, here it is."


def test_fingerprints_of_texts_whose_power_sums_cancel():
    one = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    root, sketch = fingerprint.sketches([one, other, one])
    assert root[0] == root[2] != root[1]
    assert fingerprint.text_of(root, sketch)[0] == fingerprint.text_of(root, sketch)[2]


def test_html_quotes_only_behind_equals_signs():
    assert html.main_text("<body><p title=it's>One, two. Three here.</p><p>They don't mind, it's fine.</p>") == "One, two. Three here.\nThey don't mind, it's fine."
    assert html.main_text("<body><p title='a > b' x=\"</p>\" y>One, two. Three here.</p>") == "One, two. Three here."
    assert html.main_text("<body><p it's>One, two. Three here.</p>") == "One, two. Three here."
    assert html.main_text("<body><!--><p>One, two. Three here.</p><!-- <p>no</p> --></ ><p>Four, five. Six.</p>") == "One, two. Three here.\nFour, five. Six."


def test_html_of_many_open_tags_takes_seconds():
    n = 100_000
    began = time.time()
    for page in ("<div>" * n, "<div>" * n + "</p>" * n, "<p>" + "<b>x" * n, "<p><table>" + "<div>y" * n, "<svg>" * n, "<a href=\"" * n, "<p a=" * n, "<" * n, "<div class=x>t" * n):
        html.main_text(page)
    assert time.time() - began < 60


def brute_main_text(tree):
    """The definition on a tree of (name, class or "", [child or text]) with tuples of all ancestors as paths; no dead elements, no links."""
    paths, blocks = {}, []

    def walk(node, above):
        name, mark, inner = node
        path = (*above, f"{name}.{mark}" if mark else name)
        at = paths.setdefault(path, [0, 0, 0])
        at[2] += 1
        for x in inner:
            if isinstance(x, str):
                at[0], at[1] = at[0] + len(x), at[1] + sum(c in ".,;:!?" for c in x)
                blocks.append((path, x))
            else:
                walk(x, path)

    walk(tree, ())
    texts = {p: v for p, v in paths.items() if v[0]}
    score = {}
    for p, (length, points, tags) in texts.items():
        a, b, weight, up = length / tags, points / tags, html.SMOOTH, p[:-1]
        while True:
            beside = [v for q, v in texts.items() if q != p and (q[:-1] == up and q or q == up)]
            if beside or not up:
                break
            up, weight = up[:-1], weight * html.DECAY
        if beside:
            n = sum(v[2] for v in beside)
            a, b = (1 - weight) * a + weight * sum(v[0] for v in beside) / n, (1 - weight) * b + weight * sum(v[1] for v in beside) / n
        score[p] = (a * (b + 0.25)) ** 0.5
    if not score:
        return ""
    mass, total = 0, sum(v[0] for v in texts.values())
    for p in sorted(score, key=score.get):
        mass += texts[p][0]
        if mass >= total / 2:
            typical = score[p]
            break
    good = {p for p in score if score[p] >= html.SHARE * typical}
    held = {p: sum(score[q] * texts[q][0] for q in good if q[: len(p)] == p) for p in paths}
    named = [p for p in paths if p[-1].split(".")[0] in ("article", "main") and held[p]]
    if not named:
        return None  # the deepest container with most of the content, tested apart
    home = max((p for p in named if held[p] >= 0.8 * max(held[q] for q in named)), key=len)
    return "\n".join(x for p, x in blocks if p in good and p[: len(home)] == home)


def test_html_equals_the_table_of_paths():
    r, dropped = random.Random(3), 0

    def node(depth, name):
        inner = []
        for _ in range(r.randint(1, 4)):
            if depth and r.random() < 0.6:
                inner.append(node(depth - 1, r.choice(["div", "section", "blockquote", "ul"])))
            else:
                inner.append(("p", r.choice(["", "a", "b"]), [" ".join(r.choice(["one", "two,", "three.", "x"]) for _ in range(r.choice([1, 1, 2, 30, 200])))]))
        return name, r.choice(["", "k"]), inner

    def text(n):
        return f"<{n[0]}" + (f" class={n[1]}" if n[1] else "") + ">" + "".join(x if isinstance(x, str) else text(x) for x in n[2]) + f"</{n[0]}>"

    for _ in range(300):
        tree = ("body", "", [("div", "", [node(3, "article")]), node(2, "div")])
        want = brute_main_text(tree)
        if want is None:
            continue
        assert html.main_text(text(tree)) == want
        dropped += any(x not in want for x in regex.findall(r">([^<]+)<", text(tree)[: text(tree).index("</article>")]))
    assert dropped > 10  # texts of an article that are below the threshold


def test_html_a_short_path_of_low_score_is_dropped():
    long = "<p>A long paragraph, with text; more of it, yes, and then some more of it. So it goes on, line by line.</p>" * 4
    deep = "<div>" * 7 + "<span>Tap</span>" + "</div>" * 7
    got = html.main_text(f"<body><div class=text><h1>Head line</h1>{long}<ul><li>Short</li></ul>{deep}</div><div class=more><div>Buy now</div></div></body>")
    assert got.startswith("Head line\nA long") and got.endswith("line.\nShort") and "Tap" not in got and "Buy" not in got


def test_html_frames(spark):
    rows = [(1, "u", "<p>a, b. c</p>", "x", 7), (1, "u", "<p>a, b. c</p>", "x", 7), (2, None, None, None, None), (None, "v", "", "", 0), (3, "w", "<p>" + "word, and. " * 200_000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 7), (1, 7), (2, 0), (3, 2_199_999)]
    assert all(r.text == "" for r in got if not r.n_chars) and html.extract(df.limit(0)).count() == 0
