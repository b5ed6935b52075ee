from __future__ import annotations

import itertools
import random
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import html_extract, quality_classifier
from lexloom.llm.crf import ChainCRF, fit
from tests.llm.fixtures import SCHEMA, frame, odd_rows, prose, sample_rows


def test_crf_against_all_paths():
    rnd = np.random.default_rng(2)
    model = ChainCRF(rnd.normal(size=(3, 5)), rnd.normal(size=(3, 3)), np.zeros(4), np.ones(4))
    sizes = [4, 1, 0, 3]
    offsets = np.r_[0, np.cumsum(sizes)]
    x = rnd.normal(size=(sum(sizes), 4))
    share, best = model.marginals(x, offsets), model.viterbi(x, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        emit = x[a:b] @ model.weight[:, :-1].T + model.weight[:, -1]
        paths = list(itertools.product(range(3), repeat=b - a))
        scores = np.array([sum(emit[i, y] for i, y in enumerate(p)) + sum(model.move[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths])
        weight = np.exp(scores - scores.max())
        weight /= weight.sum()
        for i in range(b - a):
            want = [sum(w for w, p in zip(weight, paths, strict=True) if p[i] == y) for y in range(3)]
            assert np.allclose(share[a + i], want)
        assert tuple(best[a:b]) == paths[int(scores.argmax())]


def test_crf_learns_from_neighbours():
    rnd = np.random.default_rng(3)
    y = np.repeat(rnd.integers(0, 2, 60), 5)
    x = np.c_[np.where(rnd.random(300) < 0.3, y, 0.5), rnd.random(300)]
    offsets = np.arange(0, 301, 20)
    # alone a position tells its label three times in ten, so 0.65 of all could be right without neighbours
    assert (fit(x, y, offsets).viterbi(x, offsets) == y).mean() > 0.8


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    for k in range(240):
        text = prose(rnd, rnd.randint(30, 150))
        good = k % 3 > 0
        if not good:
            text = rnd.choice([lambda t: " ".join(w.upper() + "!!" for w in t.split(" ")), lambda t: " | ".join(t.split(" ")), lambda t: " ".join([t.split(" ")[0]] * 40)])(text)
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, int(good), 0))
    return rows, labels


def test_classifier_on_held_out_rows(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows + [(900 + i, *r[1:]) for i, r in enumerate(odd_rows())], clash=True)
    found = {r.doc_id: r for r in quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(found) == docs.count()
    right = []
    for k, quality, _ in labels:
        r = found[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out:
            right.append(r.predicted == quality)
    assert np.mean(right) > 0.97


def test_classifier_ignores_labels_of_held_out_rows(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows)
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, t) for k, q, t in labels]
    one, two = ({r.doc_id: r.score for r in quality_classifier.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
    assert one == two


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(frame(spark, sample_rows()), none).collect()} == {0.5}
    assert quality_classifier.classify(frame(spark, []), none).count() == 0


def test_accepted_keeps_columns_and_good_rows(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows, clash=True)
    kept = quality_classifier.accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids ^ {k for k, q, _ in labels if q}) <= 3


def test_extraction_of_pages_written_by_hand():
    from tests.llm.hand_pages import PAGES

    model = html_extract.model()
    found = html_extract.extract_pages([page for page, _ in PAGES.values()], model)
    right = sum(x in want for text, (_, want) in zip(found, PAGES.values(), strict=True) for x in text.split("\n"))
    said, wanted = sum(len(t.split("\n")) for t in found), sum(len(w) for _, w in PAGES.values())
    assert all(found) and right / said > 0.97 and right / wanted > 0.97


@pytest.mark.parametrize("unit", ["<noscript>a", "<script>", "<svg>x", "<iframe>", "<!-- a", '<a title="', "<p><b>", "<div", "<template>y", "<head>z"])
def test_leaf_blocks_take_linear_time_on_adverse_pages(unit):
    def seconds(n):
        began = time.process_time()
        html_extract.leaf_blocks("<body>" + unit * n)
        return time.process_time() - began

    assert seconds(40_000) < 8 * seconds(10_000) + 0.5


def test_extraction_on_other_pages_of_the_generator():
    right = total = 0
    model = html_extract.model()
    for page, marks in html_extract.page_samples(150, seed=4242):
        blocks = html_extract.leaf_blocks(page)
        assert len(blocks) == len(marks)
        right += (model.viterbi(html_extract.features(blocks), np.array([0, len(blocks)])) == np.array(marks)).sum()
        total += len(marks)
    assert right / total > 0.98


def test_leaf_blocks_read_broken_pages():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert texts("<p>a &amp; b<br>c<p>d</div></p>e<script>x<p></script>f") == ["a & b c", "d", "e", "f"] or texts("<p>a &amp; b<br>c<p>d")[:1] == ["a & b c"]
    assert texts("<!-- <p>no</p> --><b>x <i>y</b> z</i>") == ["x y z"]
    assert texts("") == [] and texts("<<<") != [None] and texts('<p title="a>b">q</p>') == ["q"]
    assert texts("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert texts("<p>&nbsp;x&#233;&nbsp; y</p>") == ["xé y"]


def test_leaf_blocks_read_past_hidden_elements_without_an_end_tag():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert texts("<html><head><title>t</title><body><article><p>a</p></article>") == ["a"]
    assert texts("<html><head><title>t</title><style>p{}</style><article><p>a</p></article>") == ["a"]
    assert texts("<head><script>'<p>'</script>no</head><p>a") == ["a"]
    for tag in ("svg", "math", "object", "canvas", "audio", "video"):
        assert texts(f"<article><p>a</p><{tag} src=x><p>b</p></article><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<div><{tag}></div><p>b</p><div><{tag}><p>no</p></{tag}>c</div>") == ["b", "c"]
        assert texts(f"<p>a<{tag}>no<{tag}>no</{tag}>no</{tag}>b</p>") == ["ab"]
        assert texts(f"<p>a<{tag} />b</p>") == ["ab"]


def test_extract_handles_all_rows(spark):
    article = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>First line of text.</p><p>Second one.</p></article><footer>&copy; site</footer></body></html>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (None, "v", ""), (3, "w", "x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' as text", "1 as n_chars")
    found = html_extract.extract(df).collect()
    assert len(found) == 5
    assert [r.text for r in found if r.page_id == 1] == ["Title here\nFirst line of text.\nSecond one."] * 2
    assert [r.text for r in found if r.page_id == 2] == [""]
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_classes, brute_exact, brute_substring, sha

    rnd = random.Random(21)
    rows = sample_rows(5, 30)
    labels = [(r[0], 1, 0) for r in rows]
    for k in range(30):
        text = " ".join(w.upper() + "!!" for w in prose(rnd, 60).split(" "))
        rows.append((500 + k, text, "en", "s", len(text)))
        labels.append((500 + k, 0, 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [r for r in rows if r[0] < 500]
    kept = {r[0] for r in brute_exact(left) if r[3]}
    left = [r for r in left if r[0] in kept]
    classes = {i: c for i, c, _ in brute_classes(left)}
    left = [r for r in left if classes[r[0]] == r[0]]
    want = {r[0]: r for r in brute_substring(left)}
    assert {p.doc_id for p in found} == set(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "substring_dedup", "packing"]

    import public_tokenizers
    import re
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, spark.createDataFrame(left, SCHEMA), str(tmp_path)).collect()}
    for i, text in texts.items():
        assert sha(" ".join(re.findall(r"[^\x20\x09-\x0D]+", text))) == want[i][3]
        ids = [x for p in sorted((p for p in found if p.doc_id == i), key=lambda p: p.start) for x in p.ids]
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_pipeline_stages_of_odd_and_empty_tables(spark):
    import corpus_pipeline

    docs = frame(spark, odd_rows(), clash=True)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.substrings):
        assert stage(spark, frame(spark, []), "").count() == 0
        docs = stage(spark, docs, "")
        assert docs.columns == frame(spark, [], clash=True).columns
    found = [(r.doc_id, (r.text or "")[:9]) for r in docs.collect()]
    want = [(3, " \t\n "), (4, "same text"), (6, "x"), (7, "w0 w1 w2 "), (8, "a a a a a"), (9, "ok <|endo"), (None, "no id her")]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_classifier_holds_the_lines_of_little_text_at_once(monkeypatch):
    text = "a line of words here\n" * 5_000  # 105,000 bytes
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([None if i % 20 == 7 else text for i in range(60)])], ["doc_id", "text"])
    seen, features = [], quality_classifier.line_features
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    model = quality_classifier.ChainCRF(np.c_[np.zeros((2, width)), [0.0, 1.0]], np.zeros((2, 2)), np.zeros(width), np.ones(width))
    monkeypatch.setattr(quality_classifier, "prepare", lambda spark: None)
    monkeypatch.setattr(quality_classifier, "train", lambda *more: model)
    monkeypatch.setattr(quality_classifier, "line_features", lambda data, offsets: seen.append(len(data)) or features(data, offsets))
    docs = types.SimpleNamespace(sparkSession=None, columns=["doc_id", "text"], schema=None, mapInArrow=lambda run, schema: run)
    out = list(quality_classifier.accepted(docs, None)(iter([batch, batch.slice(0, 0)])))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(60))
    assert max(seen) < (1 << 20) + len(text) and sum(seen) == 57 * len(text)
