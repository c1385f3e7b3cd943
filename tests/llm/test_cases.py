"""Registered queries against brute force, and the odd cases of operators and pipeline stages."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import chat, html_extract, ngram_join, phrase_dedup, queries, rolling, suffix_dedup, topk, toxicity

from .test_operators import brute_components, page, shingle_sets
from .test_passages import brute_windows, corpus, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small documents, labels and pages as the queries read them."""
    root = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(4)
    rows, seen = [], set()
    for d, t in corpus(seed=6, n=25):
        if d is not None and d not in seen and len(t or "") < 20000:
            seen.add(d)
            rows.append((d, t, "en", "s", len(t or "")))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(d, 1, int(r.random() < 0.3)) for d, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    pages = [(i, "http://h.example/x", page(i, f"<h2>Head {i}</h2><p>Body of {i}</p>")) for i in range(8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root, [(d, t) for d, t, *_ in rows], labels


def test_op5_query(spark, folder):
    root, rows, _ = folder
    want = []
    for (d, _), (u, gone) in zip(rows, brute_windows(rows, lambda t: list((t or "").encode()), 50), strict=True):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        want.append((d, len(u), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    got = queries.QUERIES["op5_suffix_array_dedup"](spark, root).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) > 1000


def test_op3_query(spark, folder):
    root, rows, labels = folder
    got = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, root).collect()}
    import zlib

    assert set(got) == {d for d, _ in rows}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())


def test_op6_and_op8_queries(spark, folder):
    root, rows, _ = folder
    got = {r.page_id: r for r in queries.QUERIES["op6_html_extraction"](spark, root).collect()}
    assert [(got[i].text, got[i].n_chars) for i in range(8)] == [(f"Head {i} Body of {i}", len(f"Head {i} Body of {i}")) for i in range(8)]
    out = queries.QUERIES["op8_sentencepiece"](spark, root).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    scores = [[float(x) for x in r.scores.split(",")] for r in out]
    assert all(s == sorted(s, reverse=True) for s in scores) and any(len(set(s)) > 2 for s in scores)  # this model's scores are whole numbers


# ---------------------------------------------------------------- toxicity, by plain formulas


def test_logistic_fit_is_that_of_plain_formulas():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 60, 12)) for _ in range(200)]
    y = np.array([float(5 in x) for x in rows])
    w, b = toxicity.fit(rows, y, penalty=0.0, l1=0.0, l2=0.05, steps=2000)
    x = np.zeros((200, 60))
    for i, v in enumerate(rows):
        x[i, v] = 1
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).mean() + 0.025 * (w**2).sum()

    best, g = loss(w[:60], b), np.zeros(61)
    for i in range(61):  # no direction leads further down
        e = np.zeros(61)
        e[i] = 1e-4
        g[i] = (loss(w[:60] + e[:60], b + e[60]) - loss(w[:60] - e[:60], b - e[60])) / 2e-4
    assert np.abs(g).max() < 0.01 and w[5] == w.max() and best < loss(np.zeros(60), 0.0)


def test_threshold_is_the_best_by_brute_force():
    r = np.random.default_rng(2)
    for _ in range(20):
        y = (r.random(60) < 0.4).astype(float)
        z = np.round(y + r.normal(0, 1, 60), 1)
        gain = lambda t: (z[y == 1] >= t).mean() - 4 * (z[y == 0] >= t).mean()
        assert np.isclose(gain(toxicity.threshold(z, y, 4.0)), max(gain(t) for t in [*np.unique(z) - 0.05, z.max() + 1]))


def test_the_driver_learns_nothing(spark, monkeypatch):
    """A task fits the model; what it says is that of a fit here, constants and empty tables too."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["kind", "plain", "vile"][: 2 + i % 2]) for _ in range(12)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").where(~toxicity.held_out())
    used = [x.doc_id for x in labels.orderBy("doc_id").collect()]
    raw = [rows[i][1].encode() for i in used]
    f, o = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    want = toxicity.calibrated([f[o[i] : o[i + 1]] for i in range(len(raw))], np.array([rows[i][2] for i in used], float))
    none = toxicity.calibrated([], np.zeros(0))

    def here(*_, **__):
        raise AssertionError("fitted by the driver")

    monkeypatch.setattr(toxicity, "fit", here)
    got = toxicity.train(docs, labels)
    assert np.array_equal(got[0], want[0]) and got[1] == want[1] and np.any(got[0])
    monkeypatch.undo()
    assert toxicity.train(docs, labels.limit(0))[1] == none[1] == toxicity.train(docs.limit(0), labels)[1]


def test_swapped_terms_move_no_score(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(900):
        y = r.random() < 0.3
        t = [r.choice(vocab) for _ in range(12)] + (["slurone"] if y else []) + (["muslims"] if r.random() < (0.5 if y else 0.02) else [])
        rows.append((i, " ".join(t), int(y)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    text = "w1 {} w2 w3"
    test = spark.createDataFrame([(i, text.format(t)) for i, t in enumerate(("muslims", "christians", "jews", "w4"))], "doc_id long, text string")
    s = [x.score for x in toxicity.score(test, model).orderBy("doc_id").collect()]
    assert max(s) < 0.5 and max(s) - min(s) < 0.1
    assert toxicity.score(test.limit(0), model).collect() == []


# ---------------------------------------------------------------- methods


def test_without_hits_no_word_goes(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40))) for i in range(3)], "doc_id long, text string")
    assert sorted(r.n_removed for r in phrase_dedup.dedup_phrases(df).collect()) == [0, 40, 40]
    import pyarrow as pa

    text = pa.table({"t": ["a b c d e f g h i j k l m n"] * 2, "o": [1, 2], "h": pa.array([7, 7], pa.int32())})
    from quarry.llm import rolling as R

    buf = np.frombuffer(b"a b c d e f g h i j k l m n", np.uint8)
    starts, ends, _ = R.words(buf, np.array([0, len(buf)]))
    w = phrase_dedup._window_hashes(R.prefix(R.word_hashes(buf, starts, ends)), np.array([0, 1]), 13)
    found = pa.table({"w": w.view(np.int64), "mn": [1, 1], "place": [7 << 32, (7 << 32) | 1]})
    gone = lambda: phrase_dedup._locate(text, found, ("t", "o", "h"), 13, 100)[1].to_pylist()
    assert gone() == [0, 14]
    monkeypatch.setattr(phrase_dedup, "_hits", lambda *a: np.zeros(0, np.int64))
    assert gone() == [0, 0]


def test_lists_are_not_read_to_the_end():
    r = np.random.default_rng(3)
    v = r.integers(-500, 500, (4000, 24))
    lists = topk.Lists(np.arange(4000), v)
    for i in range(20):
        score = v @ v[i]
        floor = np.sort(np.delete(score, i)[::2])[-10]
        ids, got = lists.search(i, v[i], 10, float(floor))
        want = sorted((-s, j) for j, s in enumerate(score.tolist()) if j != i)[:10]
        assert list(zip((-got).tolist(), ids.tolist(), strict=True)) == want
    assert 0 < lists.read < 0.8 * lists.total


def test_dense_group_of_near_copies(spark):
    # most pairs of the group are candidates and a part of them links; some copies link with none
    r = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(170):
        w = list(base)
        for at in r.sample(range(90), r.randint(1, 5)):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    want, _, sets = brute_components(rows)
    assert 3 < len({c for _, _, c in want}) < 170 and len(sets) == 170
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x) for x in ngram_join.label(df).collect()) == sorted(want)


# ---------------------------------------------------------------- pages


def text_of(s):
    return html_extract.extract(html_extract.parse(s), set())


def test_names_inside_an_article_drop_no_article():
    assert text_of('<article class="commentary"><p>a</p><div class="side-by-side">b</div><div class="legal">c</div><fieldset>d</fieldset></article>') == "a b c d"
    assert text_of('<article><p>a</p><div class="comments">x</div><section id="comment-list">x</section><div class="ad-box">x</div><div class="share">x</div></article>') == "a"
    assert text_of('<article><p>a</p></article><article class="comment">x</article><div class="legal">x</div>') == "a"


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 2990 + "<p>out</p>"
    long = ["".join(f"<p>{w} {i if i % 7 else 'x'}.</p>" for i in range(1500)) for w in ("a", "b", "c", "d", "e", "f")]
    rows = [(i, "http://d.example/", deep) for i in range(6)] + [(10 + i, "http://l.example/", f"<body>{t}<div>Notice to all readers.</div></body>") for i, t in enumerate(long)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "in out"
    for i, t in enumerate(long):
        assert got[10 + i] == " ".join(re.findall("<p>(.*?)</p>", t))


def plain_match(a, b):
    """Simple tree matching by its definition, texts that agree count a half more."""
    if a.label != b.label:
        return 0
    if a.texts is not None:
        return 1.5 if b.key in a.texts else 1
    x, y = a.kids, b.kids
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_match(x[i], y[j]))
    return 1 + m[-1][-1]


def test_matching_equals_its_definition():
    r = random.Random(9)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return f"<p>{r.choice('abc')}</p>"
        return "<div>" + "".join(tree(depth - 1) for _ in range(r.randint(1, 4))) + "</div>"

    for _ in range(60):
        a, b = (html_extract.parse("<body>" + tree(3) + tree(2) + "</body>") for _ in range(2))
        assert html_extract.match(a, b)[0] == plain_match(a, b)


def test_long_lists_match_as_short_ones(monkeypatch):
    r = random.Random(17)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return f"<p>{r.choice('abcdef')}</p>"
        tag = r.choice(["div", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 3))) + f"</{tag}>"

    flat = lambda pairs: [(id(a), id(b), flat(below)) for a, b, below in pairs]
    for cells in (0, 4, 12):
        for _ in range(25):
            a, b, c = (html_extract.parse("<body>" + "".join(tree(3) for _ in range(r.randint(1, 7))) + "</body>") for _ in range(3))
            html_extract.fold(a, c)
            want = html_extract.match(a, b)
            with monkeypatch.context() as m:
                m.setattr(html_extract, "CELLS", cells)
                got = html_extract.match(a, b)
            assert got[0] == want[0] == plain_match(a, b) and flat(got[1]) == flat(want[1])


def test_long_lists_match_the_most_nodes():
    """A section moved from the top to the end takes no paragraph's match."""
    many = lambda w: "".join(f"<p>{w} {i}</p>" for i in range(200))
    x = html_extract.parse(f"<body><section><p>top</p></section>{many('a')}</body>")
    y = html_extract.parse(f"<body>{many('b')}<section><p>end</p></section></body>")
    assert html_extract.match(x, y)[0] == 1 + 1 + 200 * 2


# ---------------------------------------------------------------- rows


def test_repeated_and_null_nodes(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a", 0.0), (1, 1, 0, "assistant", "a", 0.0), (1, None, 0, "assistant", "lost", 9.0), (1, 2, 1, "user", "z", 0.0), (1, 2, 1, "user", "y", 0.0)]
    out = chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")).withColumn("turns", chat.turns_of("formatted")).collect()
    assert [[t.text for t in r.turns] for r in out] == [["q", "a", "y"]]


@pytest.mark.parametrize("op", [suffix_dedup.dedup_passages, phrase_dedup.dedup_phrases])
def test_null_ids_are_dealt_out(spark, op):
    long = " ".join(f"w{j}" for j in range(60))
    rows = [(None, f"{i} {long}") for i in range(30)] + [(7, "x " + long)]
    got = [r.n_removed for r in op(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got)[0] == 0 and sum(g > 0 for g in got) == 30  # all lose to 7, none to another null id


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    root = str(tmp_path)
    copy = " ".join(f"c{j}" for j in range(30))
    rows = [(None, None, "t"), (None, "", "t"), (1, copy, "t"), (1, copy, "t"), (None, copy, "t"), (2, "  ", "t"), (3, "line of ten chars\n" + copy + " d", "t"), (4, "line of ten chars", "t")]
    docs = spark.createDataFrame([(d, t, None, "s", None, x, "h") for d, t, x in rows], DOCS + ", t string, hits string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs.write.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    count = {"toxicity": 8, "line dedup": 8, "n-gram Jaccard join": 5, "benchmark decontamination": 8, "SentencePiece encoding and decoding": 8}
    for name, stage in stages.items():
        out = stage(spark, docs, root)
        assert out.columns[: len(docs.columns)] == docs.columns or out.columns == docs.columns
        assert out.count() == count[name], name
        assert stage(spark, docs.limit(0), root).count() == 0, name
    assert len(words(copy)) == 30 and len(shingle_sets([copy])[0]) == 26


# ---------------------------------------------------------------- a worker's memory


def peak(f):
    """MB that f takes at once."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts_of(mb):
    """Texts of 2 KB of words that repeat seldom."""
    ws = np.random.default_rng(5).integers(0, 10**6, (mb * 500, 286)).tolist()
    return [" ".join(f"{x:06d}" for x in row) for row in ws]


def test_powers_grow_by_an_eighth():
    rolling._powers.clear()
    for n in (1_000_000, 1_000_001, 1_130_000):
        rolling.prefix(np.ones(n, np.uint64))
    assert len(rolling._powers["up"]) < 1_300_000


def test_op7_reads_a_batch_in_small_parts():
    t = texts_of(8)
    b = pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t)], names=["o", "t"])
    rolling._powers.clear()
    assert peak(lambda: [x.num_rows for x in phrase_dedup._find([b], 13, 5)]) < 60


def test_op10_reads_pairs_in_small_parts():
    t = texts_of(8)
    y = t[1:] + t[:1]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array([*range(1, len(t)), 0]), pa.array(t), pa.array(y)], names=["a", "b", "x", "y"])
    rolling._powers.clear()
    assert peak(lambda: [x.num_rows for x in ngram_join._overlaps([b], 5)]) < 60


def test_op10_prefixes_leave_part_by_part():
    t = texts_of(8)
    b = pa.RecordBatch.from_arrays([pa.array(t)], names=["t"])
    rolling._powers.clear()
    assert peak(lambda: [x.num_rows for x in ngram_join._prefixes([b], 5, 4, 5, np.ones(ngram_join.BUCKETS))]) < 60


def test_op10_parts_give_the_overlaps_of_whole_batches(monkeypatch):
    r = random.Random(8)
    t = [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(60)]
    t.append("a b c d e f")
    i = [(r.randrange(61), r.randrange(61)) for _ in range(300)]
    cols = [[x for x, _ in i], [y for _, y in i], [t[x] for x, _ in i], [t[y] for _, y in i]]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "x", "y"])
    sets = shingle_sets(t)
    want = [(x, y, len(sets[x] & sets[y]), len(sets[x]) + len(sets[y])) for x, y in i]
    for size in (1, 100, 1 << 22):
        monkeypatch.setattr(ngram_join, "PAIRS", size)
        got = [tuple(row.values()) for part in ngram_join._overlaps([b.slice(0, 0), b], 5) for row in part.to_pylist()]
        assert got == want
