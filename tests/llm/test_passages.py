import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from quarry.llm import line_dedup, phrase_dedup, suffix_dedup

SPACE = " \t\n\x0b\x0c\r"


def words(t):
    out, cur = [], []
    for ch in t or "":
        if ch in SPACE:
            if cur:
                out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    return out + (["".join(cur)] if cur else [])


def ordered(rows):
    return [(2**63 - 1 if d is None else d, t) for d, t in rows]


def brute_windows(rows, split, window):
    """For each row: its units and which go."""
    rows = ordered(rows)
    first = {}
    for d, t in rows:
        u = split(t)
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        u = split(t)
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((u, gone))
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: "".join(r.choice(vocab) + r.choice(["  ", " ", "\n", "\t", " "]) for _ in range(k))
    passages = [text(k) for k in (9, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(n):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            t += r.choice(passages) + text(r.randint(0, 20))
        rows.append((i, t))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, rows[7][1].replace("a", "e", 3)), (5, text(40) + passages[4]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(None, passages[5]), (None, "x" + passages[5]), (200, None), (201, ""), (202, "   "), (203, "ab " * 300), (204, "ab " * 310), (205, "z" * 200), (-3, passages[2] * 2), (206, "q" * 49), (207, "q" * 49)]
    big = text(3000)
    rows += [(300, big), (301, text(50) + big + passages[1]), (302, big[100:-100])]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, o int")
    return df.repartition(5)


def check(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_suffix_dedup(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    want = []
    for (d, _), (u, gone) in zip(rows, brute_windows(rows, lambda t: list((t or "").encode()), 50), strict=True):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        want.append((d, len(u), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    got = suffix_dedup.dedup_passages(frame(spark, rows)).collect()
    check([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got], want)


@pytest.mark.parametrize("opts", [{}, {"block_bytes": 3000, "shard_patterns": 7}])
def test_phrase_dedup(spark, rows, opts):
    want = []
    for (d, _), (u, gone) in zip(rows, brute_windows(rows, words, 13), strict=True):
        want.append((d, len(u), sum(gone), " ".join(w for w, g in zip(u, gone, strict=True) if not g)))
    got = phrase_dedup.dedup_phrases(frame(spark, rows), **opts).collect()
    check([(r.doc_id, r.n_words, r.n_removed, r._kept) for r in got], want)


def test_line_dedup(spark, rows):
    rows = [*rows, (400, "AAAA bbbb Cc\n\n\nshort\nshort\n\xa0éé tail line here "), (401, "\taaaa BBBB cC \nshort\n\xa0éé tail line here"), (402, "\n"), (402, "aaaa bbbb cc")]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    docs_of = {}
    for d, t in ordered(rows):
        for x in (t or "").split("\n"):
            docs_of.setdefault(key(x), set()).add(d)
    want = []
    for (d, t), (o, _) in zip(rows, ordered(rows), strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(docs_of[key(x)]) < 2 or o == min(docs_of[key(x)])]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    check([(r.doc_id, r.n_lines, r.n_dropped, r._kept) for r in got], want)


@pytest.mark.parametrize("op", [suffix_dedup.dedup_passages, phrase_dedup.dedup_phrases, line_dedup.dedup_lines])
def test_empty(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", min_size=4, max_size=12)), min_size=1, max_size=12))
def test_suffix_sort_order(items):
    """The mergesort orders suffixes by group and content; runs are the equal ones."""
    items.sort(key=lambda x: x[0])
    raw = b"".join(t.encode() for _, t in items) + b"\0" * 4
    buf = np.frombuffer(raw, np.uint8)
    starts = np.cumsum([0] + [len(t) for _, t in items[:-1]])
    group = np.array([g for g, _ in items])
    order, run = suffix_dedup.Suffixes(buf, 4).runs(starts, group)
    key = [(int(group[i]), raw[starts[i] : starts[i] + 4]) for i in order]
    assert key == sorted(key)
    for a in range(1, len(key)):
        assert (run[a] == run[a - 1]) == (key[a] == key[a - 1])


def test_collision_falls_back_to_bytes(monkeypatch):
    buf = np.frombuffer(b"abcdabceabcd\0\0\0\0", np.uint8)
    monkeypatch.setattr(suffix_dedup.Suffixes, "extension", lambda self, x, y: np.full(len(x), self.depth))
    order, run = suffix_dedup.Suffixes(buf, 4).runs(np.array([0, 4, 8]), np.zeros(3, np.int64))
    assert run[-1] - run[0] == 1 and order[-1] == 1
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def one_anchor(tails, window=12):
    """repeats() of contexts of one anchor (four bytes, eight in front of them) and what each ends with; which windows it sorts."""
    ctx = [b"%08d" % i + b"abcd" + t for i, t in enumerate(tails)]
    buf = np.frombuffer(b"".join(ctx), np.uint8)
    offs = np.append(0, np.cumsum([len(c) for c in ctx]))
    sorted_ = []
    runs = suffix_dedup.Suffixes.runs

    def counted(self, starts, group):
        sorted_.extend(starts.tolist())
        return runs(self, starts, group)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_dedup.Suffixes, "runs", counted)
        got = suffix_dedup.repeats(np.zeros(len(ctx), np.uint64), np.full(len(ctx), 8), buf, offs, np.arange(len(ctx)), window)
    first, want = {}, []
    for i, c in enumerate(ctx):
        want += [first.setdefault(c[s : s + window], i) for s in range(len(c) - window + 1)]
    return got.tolist(), want, len(sorted_)


def test_contexts_that_share_an_anchor_by_chance_are_not_sorted():
    got, want, n = one_anchor([b"%04d0000" % i for i in range(200)])
    assert got == want and n == 0


def test_contexts_that_share_more_than_an_anchor_are_sorted():
    got, want, n = one_anchor([b"%04d0000" % (i // 3 if i < 9 else i) for i in range(200)] + [b"00010000", b"0002000x"])
    assert got == want and len(set(got)) < len(got) and 0 < n < len(got)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=30, max_size=33).map(lambda t: "a" * 20 + t[:13])), max_size=12))
def test_suffix_sort_of_long_ties(depth, items):
    items.sort(key=lambda x: x[0])
    raw = "".join(t for _, t in items).encode()
    starts = np.arange(len(items)) * 33
    group = np.array([g for g, _ in items], np.int64)
    order = suffix_dedup.Suffixes(np.frombuffer(raw, np.uint8), depth).sort(starts, group)
    assert order.tolist() == sorted(range(len(items)), key=lambda i: (group[i], raw[starts[i] : starts[i] + depth], i))
