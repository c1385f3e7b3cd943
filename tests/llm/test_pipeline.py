"""The pipeline on a small fixture, against the stages' rules applied by plain Python."""

import random

import corpus_pipeline
from quarry.llm import line_dedup, toxicity
from quarry.llm.common import read

from .test_operators import shingle_sets


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(800)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    item = text(40)
    rows, labels = [], []
    for i in range(400):
        t = text(r.randint(20, 80))
        y = int(r.random() < 0.3)
        if y:
            t = f"{t} slurone {text(3)} slurtwo"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, y))
    line = "this very line is in many documents"
    clean = [(1000, text(60)), (1001, text(60) + "\n" + line), (1002, line + "\n" + text(60)), (1003, None), (1004, "")]
    copy = text(120)
    odd = [(1010, copy), (1011, copy), (1012, copy + " end"), (1013, text(30) + " " + item + " " + text(30)), (1014, text(20) + " slurone slurtwo")]
    rows += [(i, t, None, "t", None) for i, t in clean + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = read(spark, str(tmp_path), "documents")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.train(docs, read(spark, str(tmp_path), "labels"))
    fine = {x.doc_id for x in toxicity.score(docs, model).where("predicted = 0").collect()}
    kept = {x.doc_id: x.kept if x.text is not None else None for x in line_dedup.dedup_lines(docs.where(docs.doc_id.isin(list(fine)))).collect()}
    ids = sorted(kept)
    sets = dict(zip(ids, shingle_sets([kept[i] for i in ids]), strict=True))
    (q,) = shingle_sets([item])
    want = {}
    for i in ids:
        near = [j for j in ids if j < i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        if not near and len(q & sets[i]) < 0.8 * len(q):
            want[i] = kept[i]
    assert {i: x.text for i, x in out.items()} == want
    assert set(out) >= {1000, 1001, 1002, 1003, 1004, 1010} and not set(out) & {1012, 1013, 1014}
    assert out[1011].text == ""  # its one line stays in 1010
    assert out[1002].n_chars == len(out[1002].text) and line not in out[1002].text and line in out[1001].text
    assert len(corpus_pipeline.STAGES) == 5 and all(x.ids for x in out.values() if x.text)
