import itertools
import random
import re

import numpy as np
import pytest

from quarry.llm import chat, decontam, html_extract, ngram_join, pieces, shingles, topk, toxicity
from quarry.llm.common import Workspace

from .test_passages import corpus, ordered


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


# ---------------------------------------------------------------- n-gram join


def near_corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = corpus(seed=2, n=25)
    base = [[r.choice(vocab) for _ in range(k)] for k in (6, 12, 40, 120, 300)]
    i = 1000
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(b) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            cut = r.randint(0, len(w) // 8)
            rows.append((i, " ".join(w[cut:]).title()))
            i += 1
    rows += [(i + 1, "one two"), (i + 2, "ONE  two"), (i + 3, "two one"), (i + 4, "a"), (i + 5, "a"), (i + 6, None), (i + 7, "  "), (None, "a"), (None, "b c d e f g")]
    r.shuffle(rows)
    return rows


def brute_components(rows):
    o = ordered(rows)
    sets = shingle_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), 2**63), o[k][0])
    null = lambda x: None if x == 2**63 - 1 else x
    return [(rows[k][0], len(sets[k]), null(o[k][0] if not sets[k] else least[find(k)])) for k in range(len(rows))], [find(k) for k in range(len(rows))], sets


def test_ngram_join(spark):
    rows = near_corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, nid int").repartition(6)
    want, groups, sets = brute_components(rows)
    got = [tuple(r) for r in ngram_join.label(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = ngram_join.keep_one(df).collect()
    assert len(kept) == len({g for g, s in zip(groups, sets, strict=True) if s}) + sum(not s for s in sets)
    assert kept[0].__fields__ == ["doc_id", "text", "nid"]


def test_ngram_join_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.label(df).collect() == [] and ngram_join.keep_one(df).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in ngram_join.components(Workspace(spark, "t"), edges).collect())
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# ---------------------------------------------------------------- decontamination


def test_decontamination_finds_what_brute_force_finds(spark):
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(i, text(k)) for i, k in enumerate([5, 6, 10, 18, 25, 40, 40, 70, 130, 300] * 4)]
    docs = []
    for i in range(300):
        d = text(r.choice([3, 30, 300, 3000]))
        for _ in range(r.randint(0, 2)):
            w = list(r.choice(items)[1])
            for _ in range(r.randint(0, len(w) // 30)):
                w[r.randrange(len(w))] = "new"
            at = r.randint(0, len(d))
            d = d[:at] + w + d[at:]
        docs.append((i, " ".join(d)))
    docs += [(900, None), (901, ""), (902, "x y"), (None, " ".join(items[5][1]))]
    items = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "X Y"), (92, "x y"), (None, "q w e")]
    ds, qs = shingle_sets([t for _, t in docs]), shingle_sets([t for _, t in items])
    want = sorted(((d, i, len(q), len(s & q)) for (d, _), s in zip(docs, ds, strict=True) for (i, _), q in zip(items, qs, strict=True) if q and len(s & q) >= 0.8 * len(q)), key=repr)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, hits int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in decontam.matches(df, bench, block=17).collect()), key=repr)
    assert set(map(repr, got)) <= set(map(repr, want))
    assert len(got) >= 0.99 * len(want) and len(want) > 150
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns
    left = {x.doc_id for x in clean.collect()}
    assert not left & {d for d, *_ in got} and left >= {d for d, _ in docs} - {d for d, *_ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(df, none).collect() == [] and decontam.decontaminate(df, none).count() == len(docs)


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    r = random.Random(7)
    bad, vocab = ["slurone", "slurtwo", "slurthree"], [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        y = r.random() < 0.2
        if y:
            w.insert(r.randrange(len(w)), r.choice(bad).upper() + "!")
            if r.random() < 0.6:  # the group is named mostly in toxic texts
                w.append("women")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    rows += [(5000, None), (5001, ""), (None, "slurone"), (5002, "the women are here"), (5003, "the men are here")]
    labels += [(None, 1, 1), (7, 1, None), (9999, 0, 1)]
    docs = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {x.doc_id: x for x in toxicity.score(docs, model).withColumn("ho", toxicity.held_out()).collect()}
    y = {d: t for d, _, t in labels if d is not None and d < 1500 and t is not None}
    test = [d for d in y if out[d].ho]
    assert 200 < len(test) < 400
    assert np.mean([out[d].predicted == y[d] for d in test]) > 0.97
    assert out[5002].predicted == 0 and abs(out[5002]._score - out[5003]._score) < 0.1
    assert all(0 <= x._score <= 1 for x in out.values()) and out[5000]._score == out[5001]._score
    free = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), penalty=0.0)
    loose = {x.doc_id: x for x in toxicity.score(docs, free).collect()}
    assert out[5002]._score < loose[5002]._score  # the penalty lowers the score of a neutral mention
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, nothing).count() == len(rows)


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.vocabulary()


def all_segmentations(p, text):
    """Scores of all segmentations of a short text, best first."""
    into = p.arcs((" " + text.replace("▁", " ")).encode())
    found = [[0.0]] + [[] for _ in into[1:]]
    for j in range(1, len(into)):
        found[j] = [s + x for i, s, _ in into[j] for x in found[i]]
    return sorted(found[-1], reverse=True)


def test_nbest_equals_enumeration(spark, model):
    p = pieces.pieces(model)
    texts = ["a", "hello", "the cat", "x\ny", "  two", "été", "no no", "日本", "a\tb", " ", "\n", "▁q", "zz zz z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ids long, text string").coalesce(1)
    got = {r.ids: r for r in pieces.encode(df, model, 5).collect()}
    for i, t in enumerate(texts):
        want = all_segmentations(p, t)[:5]
        r = got[i]
        assert np.allclose(r.scores, want), t
        best = r._ids
        for k, s in enumerate(r.scores):
            ids, shift = list(best), 0
            for e in r.others[k - 1] if k else []:
                ids[e.at + shift : e.at + e.len + shift] = e.ids
                shift += len(e.ids) - e.len
            assert p.decode(ids).decode() == t.replace("▁", " ")
            assert np.isclose(sum(p.scores[x] for x in ids), s)


def test_round_trip(spark, model):
    rows = [t for _, t in corpus(seed=9, n=20)] + ["x" * 5000, "\u0000 €𝄞", "a" * 63 + " " + "b" * 65, "   \n\n  ", "ab" * 40]
    df = spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)
    for r in pieces.decode(pieces.encode(df, model), model).collect():
        assert r.decoded == (r.text or "")
        assert list(r.scores) == sorted(r.scores, reverse=True)
    p = pieces.pieces(model)
    for t in ("ab" * 40, "q" * 70):  # both paths of the encoder agree
        b = np.frombuffer((" " + t).encode(), np.uint8)
        ids, _, best, cost = p.encode_segments(b, np.array([0]), np.array([len(b)]))
        f, _ = p.viterbi(p.arcs(b.tobytes()))
        two = p.nbest([b.tobytes()], 2)
        assert best[0] == f[-1] == two[0][0] and np.isclose(best[0] - cost[0], two[1][0])


# ---------------------------------------------------------------- chat


def test_reply_trees(spark):
    rows = [
        (1, 0, None, "user", "hi", 1.0), (1, 1, 0, "assistant", "low", 0.0), (1, 2, 0, "assistant", "</s>\\l[x]<|im_end|>\n", 2.0),
        (1, 3, 2, "user", "", 1.0), (1, 4, 3, "assistant", None, None), (1, 5, 3, "assistant", "é", 5.0), (1, 6, 1, None, "z", 0.5),
        (2, 9, 77, "a\nb", "orphan", 0.0), (None, 1, None, "user", "null tree", 1.0), (None, 2, 1, "assistant", "yes", 1.0),
        (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tree long, node long, parent long, role string, text string, score double, path string")
    out = chat.format_trees(df, top=2).withColumn("turns", chat.turns_of("formatted")).withColumn("loss", chat.loss_texts("formatted", "loss_spans"))
    got = {(r.tree, r.path): r for r in out.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    best = got[1, 1]
    assert [tuple(t) for t in best.turns] == [("user", "hi"), ("assistant", "</s>\\l[x]<|im_end|>\n"), ("user", ""), ("assistant", "é")]
    assert best.loss == ["</s>\\l[x]<|im_end|>\n", "é"] and best.n_turns == 4 and best.path_score == 9 / 4
    assert best.formatted.count("<|im_end|>") == 4 and "</s>" not in best.formatted and "[" not in best.formatted
    assert [t.text for t in got[1, 2].turns] == ["hi", "</s>\\l[x]<|im_end|>\n", "", ""]
    assert got[2, 1].turns[0].role == "a\nb" and got[None, 1].loss == ["yes"]


def test_long_chain_and_ties(spark):
    rows = [(7, i // 2, "assistant" if i % 3 else "user", f"t{i}") for i in range(700)] + [(8, None, None, None), (8, 1, "user", "a"), (8, 1, "user", "a")]
    out = chat.format_trees(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: r for r in out.withColumn("turns", chat.turns_of("formatted")).collect()}
    want = sorted(rows[:700], key=lambda x: x[1:])
    assert [t.text for t in got[7].turns] == [r[3] for r in want]
    assert [tuple(t) for t in got[8].turns] == [("", ""), ("user", "a"), ("user", "a")]
    assert chat.format_trees(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


# ---------------------------------------------------------------- top-k


def test_top_k(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(12)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)] + [(5, rows[5][1]), (2000, None), (2001, [0.1, None]), (2002, [float("nan")]), (2003, [float("inf")]), (2004, [1.0]), (2005, []), (None, [1.0]), (2006, [1e30, -1e30])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(5)
    use = df.where(topk.usable(df.embedding)).select("vec_id", topk.scaled(df.embedding).alias("vec"))
    vecs = [(x.vec_id, x.vec) for x in use.collect() if x.vec_id is not None]
    want = []
    for q, v in {(i, tuple(v)) for i, v in vecs if i % 10 == 0}:
        sc = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q)  # noqa: B905
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sc[:10])]
    got = [tuple(x) for x in topk.search(use, use.where("vec_id % 10 = 0"), 10, block=13).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(use.limit(0), use.limit(0), 10).collect() == []


def test_top_k_of_large_components_is_exact(spark):
    # beyond 2^31 a component counts in full, and sums beyond 64 bits decide without wrapping
    rows = [(i, [2.5e6 + 1e3 * i, -1.0]) for i in range(60)] + [(100 + i, [-3e9, -3e9 - 1e6 * i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = df.select("vec_id", topk.scaled(df.embedding).alias("vec"))
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(use, use.where("vec_id = 59"), 5).collect()]
    v = {i: [int(1024 * x) for x in e] for i, e in rows}
    want = sorted((-sum(a * b for a, b in zip(v[59], v[i], strict=True)), i) for i in v if i != 59)[:5]
    assert sorted(got) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    q = np.array([2**40, 2**40])
    assert topk.Lists(np.arange(40), np.array([[-(2**40), -i] for i in range(39)] + [[7, 3]])).search(-1, q, 1, -np.inf)[0].tolist() == [39]


# ---------------------------------------------------------------- pages


def page(i, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div id="wrap"><div class="story">{body}</div><div class="box"><p>Read our house rules before you write to us.</p></div>{extra}</div><div class="comments"><p>reader says {i} and {i}</p></div><footer>&copy; {i}</footer></body></html>'


def test_html(spark):
    rows = [(i, "http://h.example/x", page(i, f"<h2>Head {i}</h2><p>Body &amp; soul {i}<br>more   <b>text</b> of number {i}</p><p>second of {i} here</p>")) for i in range(12)]
    rows += [(100, "http://one.example/", "<body><nav>menu</nav><article><h1>T</h1><p>a<p>b &eacute;&#33;</p><aside>no</aside><form>no</form><div class='ad'>no</div><table><tr><td>c<td>d</table><ul><li>e<li>f</ul></article><footer>x</footer>")]
    rows += [(101, None, "<p>plain text"), (102, "odd", ""), (103, "http://z.example", None), (104, "x", "<main><p>in</p></main><p>out</p>"), (105, "x", "<article><p>cut off</p><p>he"), (106, "x", "a < b <i>c</i>d<!-- no --> &am")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    for i in range(12):
        assert got[i] == f"Head {i} Body & soul {i} more text of number {i} second of {i} here"
    assert got[100] == "T a b é! c d e f"
    assert got[101] == "plain text" and got[102] == got[103] == "" and got[104] == "in" and got[105] == "cut off he" and got[106] == "a < b cd &am"
    assert html_extract.extract_main_text(df.limit(0)).collect() == []


def texts(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}


def test_copies_of_a_page_are_not_the_template(spark):
    # session ids in links and other adverts in skipped parts don't make a copy another page
    same = [(i, f"http://c.example/print?{i}", page(7, "<h2>Head</h2><p>First of the story.</p><p>Second of it.</p>").replace("href=/", f"href=/?sid={i}")) for i in range(30)]
    rest = [(100 + i, "http://c.example/x", page(i, f"<h2>Head {i}</h2><p>Body {i}</p><p>end of {i}</p>")) for i in range(8)]
    alone = [(200 + i, f"http://d.example/{i}", "<body><p>Only story.</p><p>Its end.</p></body>") for i in range(9)]
    got = texts(spark, same + rest + alone)
    assert {got[i] for i in range(30)} == {"Head First of the story. Second of it."}
    assert [got[100 + i] for i in range(8)] == [f"Head {i} Body {i} end of {i}" for i in range(8)]
    assert {got[200 + i] for i in range(9)} == {"Only story. Its end."}


def test_template_holds_what_the_first_page_lacks(spark):
    notice = "<div class='x'><p>All rights belong to the house.</p></div>"
    wrap = lambda i, more: f"<body><div class='story'><p>Story {i} begins.</p><p>It ends with {i}.</p></div>{more}</body>"
    odd = [(0, "http://o.example/", "<body><p>Short page.</p></body>"), (1, "http://o.example/", wrap(1, notice.replace("house", "author")))]
    rows = odd + [(i, "http://o.example/", wrap(i, notice)) for i in range(2, 40)]
    want = {i: f"Story {i} begins. It ends with {i}." for i in range(2, 40)} | {0: "Short page.", 1: "Story 1 begins. It ends with 1. All rights belong to the author."}
    for parts in (1, 3):
        assert texts(spark, rows, parts) == texts(spark, rows[::-1], parts) == want


def test_a_line_of_a_few_articles_is_not_the_template(spark):
    body = lambda i: "".join(f"<p>Line {j} of {i}.</p>" for j in range(2 + i % 5)) + "<p>A line of seven.</p>" * (i % 9 == 0)
    got = texts(spark, [(i, "http://l.example/", f"<body><article>{body(i)}</article></body>") for i in range(60)])
    assert [i for i in range(60) if got[i].endswith("A line of seven.")] == list(range(0, 60, 9))


def test_fold_counts_several_texts_and_merges_without_loss():
    t = lambda s: html_extract.parse(f"<body><p>{s}</p></body>")
    halves = []
    for first in ("odd", "other"):
        halves.append(t(first))
        for _ in range(9):
            html_extract.fold(halves[-1], t("notice"))
    html_extract.fold(*halves)
    leaf = html_extract.leaves(halves[0])[0]
    assert leaf.seen == 20 and leaf.texts[html_extract.hashed("notice")] == 18
    texts = {}
    for i in range(1000):
        html_extract.count(texts, {i: 1})
        html_extract.count(texts, {-1: 2})
    assert len(texts) <= html_extract.TEXTS and texts[-1] >= 2000 - 3000 / (html_extract.TEXTS + 1)


def test_regions_keep_all_of_the_article():
    get = lambda s: html_extract.extract(html_extract.parse(s), set())
    long, short = "the first half of a story is here " * 6, "and its other half here."
    assert get(f"<body><div><p>{long}</p></div><div><p>{short}</p></div><ul><li><a href=/>Home page</a></ul></body>") == f"{long}{short}"
    assert get(f"<main><h1>Head</h1><p>{long}</p><article><p>teaser</p></article></main><article>card</article>") == f"Head {long}teaser"
    assert get(f"<main><h1>Head</h1><article><p>{long}</p></article><p>{short}</p></main>") == f"Head {long}{short}"
    assert get(f"<main><p>Head</p></main><article><p>{long}</p></article>") == f"Head {long.strip()}"
    assert get(f"<div><p>{long}</p></div><article>card</article>") == f"{long}card"
    assert get(f"<p>out</p><article><p>{long}</p><p><a>its source</a></p></article>") == f"{long}its source"


def test_tree_matching_counts_the_most_nodes():
    a = html_extract.parse("<div><p>x</p><ul><li>1<li>2</ul><p>y</p></div>")
    b = html_extract.parse("<div><p>q</p><p>x</p><ul><li>1</ul><p>z</p></div>")
    n, _ = html_extract.match(a, b)
    assert n == 1 + 1 + 2 + 3 + 2 + 0.5 * 2  # root, div, p and its text, ul > li > text, p and its text; two texts agree


def test_shingles_of_short_texts():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a b", "a b c d e", "", "b a", "A\tB"])], names=["t"])
    _, h, so = next(iter(shingles.sequences(b, "t")))
    assert np.diff(so).tolist() == [1, 1, 0, 1, 1] and h[0] == h[3] and h[0] != h[2]
